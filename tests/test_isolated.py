"""Broken files and lines are set aside, whatever is wrong with them; all others are read."""

import pytest
from pyspark.sql import functions as F

from juryloom.sources import corpus, isolated, lines

HEAD = "start_time\tstop_time\tspeaker\tvalue\n"


def tree(tmp_path, texts, name="{n}_TRANSCRIPT.csv"):
    for n, text in texts.items():
        folder = tmp_path / f"{n}_P"
        folder.mkdir()
        (folder / name.format(n=n)).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(tmp_path)


def row(speaker, value):
    return f"1\t2\t{speaker}\t{value}\n"


def test_broken_transcripts_leave_the_others(spark, tmp_path):
    me = lambda v: row("Participant", v)
    path = tree(
        tmp_path,
        {
            "300": HEAD + me("one") + row("Ellie", "asked") + me("") + "\n" + me('"two\ttabs ""and"" quotes"') + "1\t2\tParticipant\n" + me("three").rstrip("\n"),
            "301": HEAD + row("Ellie", "nobody answers"),
            "302": b"",
            "303": HEAD.encode() + me("x").encode() + b"1\t2\tParticipant\t\xff\xfe\n" + me("y").encode(),
            "304": "start_time\tvalue\n1\tx\n",
            "305": HEAD + me("x") + me("too\tmany\tfields") + me("y"),
            "306": "value\tspeaker\r\nother order\tParticipant\r\n",
            "307": HEAD + me("cut") * 50,
            "308": HEAD + me('"open quote') + me("x"),
        },
    )
    (tmp_path / "307_P" / ".307_TRANSCRIPT.csv.crc").write_bytes(b"crc\x00\x00\x00\x02\x00wrong")
    (tmp_path / "empty_P").mkdir()
    (tmp_path / "300_P" / "notes.txt").write_text("no transcript")
    got = {r["id"]: (r["text"], r["error"]) for r in isolated.transcripts(spark, path).collect()}
    assert got.pop("307")[1].startswith("unreadable: ")
    assert got == {
        "300": ('one two\ttabs "and" quotes three', None),
        "301": ("", None),
        "302": (None, "empty file"),
        "303": (None, "not UTF-8"),
        "304": (None, "no column speaker"),
        "305": (None, "record 2: 6 fields, 4 expected"),
        "306": ("other order", None),
        "308": (None, "record 1: 7 fields, 4 expected"),
    }
    read = {r["id"] for r in corpus.read_transcripts(spark, path).collect()}
    assert {"300", "301", "306"} <= read and not read & {"302", "303", "304", "305", "307"}
    kinds = {r["kind"]: (r["n"], r["first"]["file"].rsplit("/", 1)[1]) for r in isolated.warnings(isolated.transcripts(spark, path)).collect()}
    assert kinds["record #: # fields, # expected"] == (2, "305_TRANSCRIPT.csv") and kinds["empty file"][0] == 1
    every = {r["id"]: r["text"] for r in isolated.transcripts(spark, path, None).filter("id in ('300', '301', '304')").collect()}
    assert every == {"300": 'one asked two\ttabs "and" quotes three', "301": "nobody answers", "304": "x"}


def test_first_transcript_of_a_folder_counts(spark, tmp_path):
    path = tree(tmp_path, {"7": HEAD + row("Participant", "b")}, "b{n}_TRANSCRIPT.csv")
    (tmp_path / "7_P" / "a7_TRANSCRIPT.csv").write_text(HEAD + row("Participant", "a"))
    assert [tuple(r) for r in isolated.transcripts(spark, path).select("id", "text").collect()] == [("7", "a")]


@pytest.mark.parametrize("cut", [16, 1 << 20])
def test_json_lines_set_broken_ones_aside(spark, tmp_path, cut):
    body = ['{"a": 1, "b": "x"}', "", "{", "[1]", "3", '"s"', "null", '{"a": "one"}', '{"b": null, "c": 2}', "{}"]
    (tmp_path / "x.jsonl").write_bytes("\n".join(body).encode() + b'\n{"b": "\xff"}\n')
    schema = spark.createDataFrame([], "a int, b string").schema
    spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        found = isolated.json_lines(spark, str(tmp_path), schema, "*.jsonl")
        good, bad = isolated.divided(found)
        assert {r["line"]: r["error"] for r in bad.collect()} == {2: "not JSON", 3: "not an object: ARRAY", 4: "not an object: BIGINT", 5: "not an object: STRING", 6: "not an object: VOID", 7: "wrong type"}
        assert {r["line"]: r["row"] and tuple(r["row"]) for r in good.collect()} == {0: (1, "x"), 8: (None, None), 9: (None, None), 10: (None, "�")}
        loose = isolated.json_lines(spark, str(tmp_path), glob="*.jsonl").select("line", F.try_variant_get("row", "$.c", "int").alias("c"), "error")
        assert {r["line"]: r["c"] for r in loose.filter("error is null").collect()} == {0: None, 7: None, 8: 2, 9: None, 10: None}
        kinds = {r["kind"]: (r["n"], r["first"]["line"]) for r in isolated.warnings(found).collect()}
        assert kinds["wrong type"] == (1, 7) and len(kinds) == 6
        with pytest.raises(Exception, match="UTF-8|utf-8|Unicode|utf8"):  # the strict readers still fail
            lines.csv_records(spark, str(tmp_path / "x.jsonl")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
