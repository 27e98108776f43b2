"""Readers over byte ranges and record batches beside sequential ones."""

import csv
import json
import random

import pyarrow as pa
import pytest

from juryloom.sources import arrow_files, corpus, lines, sinks

RANGE_CONFS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture
def cut_at(spark):
    """Sets the bytes of a range; the session's own settings come back after the test."""
    before = {c: spark.conf.get(c) for c in RANGE_CONFS}

    def cut(size: int) -> None:
        spark.conf.set(RANGE_CONFS[0], str(size))
        spark.conf.set(RANGE_CONFS[1], "1")

    yield cut
    for c, v in before.items():
        spark.conf.set(c, v)


def dialogues(n, seed=1):
    rng = random.Random(seed)
    bits = ["a,b", 'say ""hi"', "", "é\r\nx", "plain", ",", '"', "tab\t"]
    return [(f"f{i:04d}", rng.choice(["mdd", "control"]), 'm "q" x', "t", "\n".join(rng.choice(bits) for _ in range(rng.randrange(1, 6)))) for i in range(n)]


def write_csv(path, rows, header=corpus.COLUMNS, **options):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, **options)
        out.writerow(header)
        out.writerows(rows)
    return str(path)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_rows_do_not_hang_on_ranges(spark, tmp_path, cut_at, end):
    rows = dialogues(60)
    path = write_csv(tmp_path / "x.csv", rows, quoting=csv.QUOTE_MINIMAL, lineterminator=end)
    size = (tmp_path / "x.csv").stat().st_size
    for cut in (40, 211, size + 1):
        cut_at(cut)
        assert sorted(tuple(r) for r in corpus.read_csv(spark, path).collect()) == rows
        assert lines._lines(spark, path).rdd.getNumPartitions() >= min(size // cut, 8)
    cut_at(40)
    found = lines.csv_records(spark, path).orderBy("record").collect()
    assert [r["record"] for r in found] == list(range(61))
    first, at = [], 0
    for text in (",".join(corpus.COLUMNS), *(r["text"] for r in found[1:])):
        first.append(at)
        at += text.count("\n") + 1
    assert [r["line"] for r in found] == first
    lines_ = lines._lines(spark, path)
    assert lines_.join(lines._range_states(lines_, '"'), ["file", "begin"]).count() == lines_.count()


def test_csv_without_a_broadcast_of_ranges(spark, tmp_path, cut_at, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_RANGES", 0)
    rows = dialogues(40, 2)
    path = write_csv(tmp_path / "x.csv", rows, quoting=csv.QUOTE_ALL)
    cut_at(50)
    assert sorted(tuple(r) for r in corpus.read_csv(spark, path).collect()) == rows


def test_csv_of_odd_shapes(spark, tmp_path, cut_at):
    cut_at(9)
    path = tmp_path / "x.csv"
    path.write_text('extra,dialogue,file_id,condition,client_model,therapist_model\n\n1,"a\n\n\nb",x,mdd,c,t\n2,,y,mdd,c\n3,"","z",mdd,c,t', encoding="utf-8")
    got = sorted(tuple(r) for r in corpus.read_csv(spark, str(path)).collect())
    assert got == [("x", "mdd", "c", "t", "a\n\n\nb"), ("y", "mdd", "c", "", ""), ("z", "mdd", "c", "t", "")]
    path.write_text("file_id,dialogue\nx,y\n", encoding="utf-8")
    with pytest.raises(ValueError, match="columns missing"):
        corpus.read_csv(spark, str(path))
    typed = corpus.read_csv(spark, write_csv(tmp_path / "t.csv", [("a", 1, ""), ("b", "", 2.5)], ("k", "n", "x")), "k string, n int, x double")
    assert sorted(tuple(r) for r in typed.collect()) == [("a", 1, None), ("b", None, 2.5)]
    assert corpus.read_csv(spark, write_csv(tmp_path / "e.csv", [])).collect() == []


def test_line_numbers_over_files_and_ranges(spark, tmp_path, cut_at):
    rng, want = random.Random(4), []
    for name in ("b.txt", "a.txt", "deep/c.txt", "empty.txt"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        some = [] if name == "empty.txt" else ["x" * rng.randrange(0, 40) + rng.choice(["", "é", '"']) for _ in range(rng.randrange(50, 200))]
        path.write_bytes("".join(s + rng.choice(["\n", "\r\n"]) for s in some).encode())
        want += [(name, i, s) for i, s in enumerate(some)]
    for cut in (41, 100_000):
        cut_at(cut)
        got = sinks.by_line(spark, str(tmp_path)).collect()
        assert sorted((r["file"].split(f"{tmp_path}/")[1], r["line"], r["value"]) for r in got) == sorted(want)


def test_last_line_of_a_key_wins(spark, tmp_path, cut_at):
    rng, want = random.Random(5), {}
    for name in ("a.jsonl", "b.jsonl"):
        some = [{"file_id": f"k{rng.randrange(20)}", "n": rng.randrange(1000), "other": "x" * rng.randrange(30)} for _ in range(200)]
        (tmp_path / name).write_text("\n".join(json.dumps(s) for s in some) + "\n\n")
        want |= {s["file_id"]: s["n"] for s in some}
    schema = spark.createDataFrame([], "file_id string, n int").schema
    for cut in (64, 100_000):
        cut_at(cut)
        got = corpus.read_last_lines(spark, str(tmp_path), schema, "file_id").collect()
        assert {r["file_id"]: r["n"] for r in got} == want and len(got) == len(want)
    for text, message in (("", "no lines"), ("[1]\n", "without an object"), ('{"n": 1}\n', "without an object"), ("{bad\n", "without an object")):
        path = tmp_path / "bad" / "x.jsonl"
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
        with pytest.raises(Exception, match=message):
            corpus.read_last_lines(spark, str(path), schema, "file_id").collect()


def test_human_labels_keep_their_line(spark, tmp_path, cut_at):
    cut_at(30)
    rows = [("f1", "ann", "12", "Yes", "two\nlines"), ("f1", "ann", "13", "", ""), ("f2", "bob", "0", "n/a", "x")]
    path = write_csv(tmp_path / "h.csv", rows, ("file_id", "annotator_id", "phq8_total", "self_harm_flag", "notes"))
    got = [tuple(r) for r in corpus.read_human_labels(spark, path).orderBy("line").collect()]
    assert got == [(1, "f1", "ann", 12, True), (2, "f1", "ann", 13, None), (3, "f2", "bob", 0, None)]
    bad = write_csv(tmp_path / "b.csv", [("f1", "", "1")], ("file_id", "annotator_id", "phq8_total"))
    with pytest.raises(ValueError, match="break the contract"):
        corpus.read_human_labels(spark, bad)
    flag = write_csv(tmp_path / "f.csv", [("f1", "a", "1", "maybe")], ("file_id", "annotator_id", "phq8_total", "self_harm_flag"))
    with pytest.raises(Exception, match="not a boolean: maybe"):
        corpus.read_human_labels(spark, flag).collect()


def test_transcripts_in_file_order(spark, tmp_path, cut_at):
    cut_at(40)
    for n in (300, 301):
        folder = tmp_path / f"{n}_P"
        folder.mkdir()
        rows = [(i // 3, i, "Participant" if i % 4 else "Ellie", "" if i == 5 else f"w{n}.{i}") for i in range(30)]
        write_csv(folder / f"{n}_TRANSCRIPT.csv", rows, ("start_time", "stop_time", "speaker", "value"), delimiter="\t")
        (folder / "other.csv").write_text("no\n")
    got = {r["id"]: r["text"] for r in corpus.read_transcripts(spark, str(tmp_path)).collect()}
    assert got == {str(n): " ".join(f"w{n}.{i}" for i in range(30) if i % 4 and i != 5) for n in (300, 301)}


def arrow_folder(tmp_path, stream, n=100, per_batch=7):
    rows = dialogues(n, 3)
    schema = pa.schema([("extra", pa.list_(pa.int64())), *((c, pa.large_string() if c == "dialogue" else pa.string()) for c in corpus.COLUMNS)])
    table = pa.Table.from_pylist([{"extra": [1] * 5, **dict(zip(corpus.COLUMNS, r, strict=True))} for r in rows], schema=schema)
    table = table.set_column(2, "condition", table["condition"].dictionary_encode())
    for split, part in (("train", table.slice(0, 60)), ("test", table.slice(60))):
        folder = tmp_path / split
        folder.mkdir(parents=True)
        with open(folder / "data-00000.arrow", "wb") as f, (pa.ipc.new_stream if stream else pa.ipc.new_file)(f, part.schema) as out:
            for batch in part.combine_chunks().to_batches(max_chunksize=per_batch):
                out.write_batch(batch)
    return rows


@pytest.mark.parametrize("stream", [True, False])
def test_arrow_batches_are_dealt_over_tasks(spark, tmp_path, stream):
    rows = arrow_folder(tmp_path, stream)
    df = corpus.read_arrow(spark, str(tmp_path), task_bytes=1 << 10)
    assert sorted(tuple(r) for r in df.collect()) == rows
    assert df.rdd.getNumPartitions() > 8
    some = arrow_files.read_batches(spark, corpus._arrow_files(spark, str(tmp_path), ("train",))[0], spark.createDataFrame([], "file_id string, none long").schema, place=True)
    got = sorted((r["__batch"], r["__row"], r["file_id"], r["none"]) for r in some.collect())
    assert got == [(i // 7, i % 7, rows[i][0], None) for i in range(60)]


def test_limit_counts_across_splits(spark, tmp_path):
    rows = arrow_folder(tmp_path, True)
    ids = lambda **k: sorted(r["file_id"] for r in corpus.read_splits(spark, str(tmp_path), **k).collect())
    assert ids(limit=70) == [r[0] for r in rows[:70]]
    assert ids(limit=5, splits=("test", "train")) == [r[0] for r in rows[60:65]]
    assert ids() == [r[0] for r in rows]
    with pytest.raises(ValueError, match="unknown splits"):
        ids(splits=("dev",))
