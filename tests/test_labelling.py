"""Small exact expectations of the labelling operators, readers and resumable runs."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from juryloom.config import ITEMS, ScoringConfig
from juryloom.functions import numeric as N
from juryloom.functions.hashing import sha256, sha_mod4, sha_mod10
from juryloom.operators import aggregate, calibration, contracts, corpus, diagnostics, dialogue, export, jury
from juryloom.plans import scoring
from juryloom.sources import corpus as sources
from juryloom.streaming.resume import score_stream

CONFIG = ScoringConfig()


def talk(spark, *texts):
    rows = [(f"f{i}", ["mdd", "control"][i % 2], "c", "t", t) for i, t in enumerate(texts)]
    return sources.with_split(spark.createDataFrame(rows, sources.DIALOGUE))


def test_hash_arithmetic(spark):
    import hashlib

    rows = spark.createDataFrame([(f"id{i}",) for i in range(300)], "k string").select("k", sha_mod10(sha256(F.col("k"))).alias("m"), sha_mod4(sha256(F.col("k"))).alias("q"))
    for r in rows.collect():
        n = int(hashlib.sha256(r["k"].encode()).hexdigest(), 16)
        assert (r["m"], r["q"]) == (n % 10, n % 4)


def test_parser(spark):
    got = dialogue.parsed(talk(
        spark,
        "stray line\nTherapist: Hello\n\nclient:  Hi there\nand more\nNurse: ignored\nstill me",
        'Therapist:, no markdown.\nClient: Fine. [/END] Bye [insert name].\nClient: Hello?"" This uses meta words',
        "Client: " + "word " * 205,
        None,
    )).orderBy("file_id").collect()
    kept = [[(u["speaker"], u["text"]) for u in r["utterances"] if u["text"] is not None] for r in got]
    assert kept[0] == [("therapist", "Hello"), ("client", "Hi there\nand more\nstill me")]
    assert (got[0]["unknown_speaker_count"], got[0]["orphan_line_count"]) == (1, 1)
    assert kept[1] == [("client", "Fine. Bye."), ("client", "Hello?")]
    assert [u["meta_removed"] for u in got[1]["utterances"]] == [True, True, True]
    assert len(kept[2][0][1].split()) == 200 and got[2]["utterances"][0]["truncated"]
    assert kept[3] == []


def test_question_context(spark):
    text = "Therapist: Q1\nClient: A1\nClient: A2\nTherapist: Q2\nClient: 8."
    r = dialogue.views(talk(spark, text)).first()
    assert r["client_qa_text"] == "Therapist: Q1\nClient: A1\nClient: A2\nTherapist: Q2\nClient: 8."
    assert (r["client_utterance_count"], r["therapist_utterance_count"], r["short_answer_count"]) == (3, 2, 3)


def one_item(spark, votes, config=CONFIG):
    rows = [("f", f"m{i}", 1, "sleep", 2, s is not None, s, a, None if s is None else 0.7, [] if s is None else ["e"]) for i, (s, a) in enumerate(votes)]
    ddl = "file_id string, model_id string, run_number int, item string, item_idx int, discussed boolean, score int, assertion string, confidence double, evidence array<string>"
    return aggregate.item_aggregates(aggregate.collect_votes(spark.createDataFrame(rows, ddl)), config).first()


def test_consensus(spark):
    na, two, maybe = (None, "not_mentioned"), (2, "present"), (1, "possible")
    r = one_item(spark, [na] * 6)
    assert (r["consensus_assertion"], r["posterior"], r["needs_arbitration"]) == ("not_mentioned", None, False)
    r = one_item(spark, [na] * 3 + [two] * 3)
    assert (r["consensus_score"], r["consensus_assertion"], r["needs_arbitration"]) == (2, "present", True)
    assert one_item(spark, [na] * 4 + [two] * 2)["consensus_score"] is None
    assert one_item(spark, [maybe] * 4 + [(1, "present")] * 2)["consensus_assertion"] == "possible"
    r = one_item(spark, [(0, "denied")] * 6)
    assert (r["consensus_score"], r["consensus_assertion"], r["arbitration_reason"]) == (0, "denied", None)
    assert r["posterior"] == [6.5 / 8, 0.5 / 8, 0.5 / 8, 0.5 / 8]


def test_convolution_and_interval(spark):
    one = spark.range(1)
    points = F.array(*[F.array(*map(F.lit, (0.0, 1.0, 0.0, 0.0)))] * 8)
    halves = F.array(*[F.array(*map(F.lit, (0.5, 0.5, 0.0, 0.0)))] * 8)
    r = one.select(N.convolve(points).alias("a"), N.convolve(halves).alias("b")).select("a", "b", N.quantile_index(N.cdf(F.col("b")), 0.05).alias("lo"), N.quantile_index(N.cdf(F.col("b")), 0.95).alias("hi")).first()
    assert len(r["a"]) == 25 and r["a"][8] == 1.0
    assert math.isclose(sum(i * p for i, p in enumerate(r["b"])), 4.0) and (r["lo"], r["hi"]) == (2, 6)


def test_proration(spark):
    def row(scores):
        return spark.createDataFrame([(scores,)], "s array<int>").select(F.transform("s", lambda x: F.struct(x.alias("consensus_score"))).alias("i")).select(*(c.alias(k) for k, c in aggregate.totals(F.col("i")).items())).first()

    assert row([2] * 7 + [None])["total_prorated"] == 16.0
    assert row([2] * 6 + [1, None])["total_prorated_rounded"] == 15
    assert row([2] * 6 + [None, None])["total_prorated"] is None


def test_tails_of_t_and_f():
    assert math.isclose(N.t_two_sided(2.0, 10), 0.07338803, rel_tol=1e-6)
    assert math.isclose(N.f_quantile(0.95, 5, 10), 3.32583453, rel_tol=1e-6)


def test_alpha_of_perfect_agreement(spark):
    rows = spark.createDataFrame([([6, 0, 0, 0], "a"), ([0, 0, 6, 0], "a")], "vote_counts array<long>, item string")
    assert math.isclose(diagnostics.krippendorff(rows).first()["alpha"], 1.0)
    same = rows.limit(1)
    assert diagnostics.krippendorff(same).first()["alpha"] is None


def test_agreement_of_reversed_labels(spark):
    names = calibration.NAMES
    pairs = spark.createDataFrame([(a, b) for a, b in zip(names, reversed(names), strict=True)], "truth string, predicted string")
    r = calibration.agreement(calibration.confusion(pairs)).first()
    assert math.isclose(r["accuracy"], 0.2) and r["weighted_kappa"] < 0


def test_vote_contract(spark):
    votes = jury.fake_votes(spark.createDataFrame([("f", "some text"), ("g", None)], "file_id string, scoring_text string"), CONFIG.jurors, (0, 1))
    assert votes.count() == 2 * 6 * 8 and jury.vote_violations(votes).count() == 0
    assert jury.vote_violations(votes.withColumn("score", F.lit(9))).count() == votes.count()


def test_dedupe_and_checks(spark):
    rows = talk(spark, "Client: a").drop("computed_split")
    assert sources.dedupe(rows.unionByName(rows)).count() == 1
    with pytest.raises(Exception, match="different texts"):
        sources.dedupe(rows.unionByName(rows.withColumn("dialogue", F.lit("other")))).collect()
    with pytest.raises(ValueError, match="unknown condition"):
        sources.checked(rows.withColumn("condition", F.lit("x")))


def test_readers(spark, tmp_path):
    import pyarrow as pa

    cols = {c: [f"{c}1", f"{c}2"] for c in sources.COLUMNS} | {"condition": ["mdd", "control"], "dialogue": ["Client: a, \"b\"\nmore", "Client: c"]}
    for name in ("train", "test"):
        (tmp_path / "hf" / name).mkdir(parents=True)
        data = {k: ([f"{name}{x}" for x in v] if k == "file_id" else v) for k, v in cols.items()}
        with pa.OSFile(str(tmp_path / "hf" / name / "data.arrow"), "wb") as f, pa.ipc.new_stream(f, pa.table(data).schema) as w:
            w.write_table(pa.table(data))
    assert sources.read_corpus(spark, f"file://{tmp_path}/hf").count() == 4
    import pandas as pd

    (tmp_path / "csv").mkdir()
    pd.DataFrame(cols).to_csv(tmp_path / "csv" / "x.csv", index=False)
    got = sources.read_corpus(spark, f"file://{tmp_path}/csv").orderBy("file_id").collect()
    assert [r["dialogue"] for r in got] == cols["dialogue"]


def test_run_resumes(spark, tmp_path):
    docs = talk(spark, *(f"Therapist: q\nClient: answer {i} {i}" for i in range(6)))
    run = scoring.Run(spark, f"file://{tmp_path}/run", CONFIG)
    assert run.run_once(docs.filter("file_id < 'f4'"), 0) == 4
    assert run.run_once(docs, 1) == 2
    assert run.rows().count() == 6 and run.pending(docs).count() == 0
    manifest = run.finish(docs)
    assert manifest["completed"] == 6 and sum(manifest["counts"].values()) == 6
    with pytest.raises(ValueError, match="another configuration"):
        scoring.Run(spark, run.folder, ScoringConfig(alpha=1.0)).run_once(docs, 2)


def test_a_repeated_batch_keeps_finished_rows(spark, tmp_path):
    docs = talk(spark, *(f"Therapist: q\nClient: answer {i} {i}" for i in range(6)))
    run = scoring.Run(spark, f"file://{tmp_path}/run", CONFIG)
    assert run.run_once(docs.filter("file_id < 'f4'")) == 4
    assert run.run_once(docs) == 2  # the same batch again, with more dialogues
    assert run.run_once(docs) == 0  # and replayed after its events
    assert run.rows().count() == run.rows().select("file_id").distinct().count() == 6
    assert run.pending(docs).count() == 0


def test_limit_is_of_the_corpus(spark, tmp_path):
    docs = talk(spark, *(f"Client: answer {i}" for i in range(6)))
    run = scoring.Run(spark, f"file://{tmp_path}/run", ScoringConfig(limit=3))
    assert [run.run_once(docs), run.run_once(docs)] == [3, 0]


def test_failing_juror_and_external_judge(spark, tmp_path):
    docs = talk(spark, *(f"Client: answer {i}" for i in range(4)))
    broken = tmp_path / "broken"
    broken.write_text("x")

    def ask(text):
        if "answer 2" in text and broken.exists():
            raise ConnectionError("no line " * 200)
        field = {"discussed": True, "confidence": 0.9, "evidence": ["x"], "assertion": "present"}
        return [{"model_id": "m", "run_number": r, "item": i, "score": 1 + r, **field} for r in (0, 1, 2) for i in ITEMS]

    def judge(items):
        return items.select("file_id", "item", F.lit(0).alias("final_score"), F.lit("denied").alias("assertion"))

    run = scoring.Run(spark, f"file://{tmp_path}/run", CONFIG, lambda t: jury.external_votes(t, ask, 2), judge)
    assert run.run_once(docs) == 3
    bad = [r["file_id"] for r in run.latest().filter("status = 'failed'").collect()]
    assert len(bad) == 1 and run.job(bad[0])["attempt"] == 1
    assert run.job(bad[0])["error_code"] == "ConnectionError" and len(run.job(bad[0])["error_message"]) == 500
    with pytest.raises(KeyError):
        run.job("nobody")
    with pytest.raises(RuntimeError, match="1 dialogues failed"):
        scoring.Run(spark, run.folder, CONFIG, run.jurors, judge, fail_fast=True).run_once(docs)
    broken.unlink()
    assert run.run_once(docs) == 1 and run.job(bad[0])["attempt"] == 3
    got = run.rows()
    assert got.count() == 4 and got.filter("final_source = 'judge_override' and final_total = 0").count() == 4
    assert scoring.ledger_totals(run.latest()).first()["failed"] == 0


def test_stream_scores_each_dialogue_once(spark, tmp_path):
    run = scoring.Run(spark, f"file://{tmp_path}/run", CONFIG)
    for i in range(2):
        talk(spark, "Client: one", "Client: two").withColumn("file_id", F.concat("file_id", F.lit(f"_{i}"))).drop("computed_split").write.mode("append").parquet(f"{tmp_path}/in")
        score_stream(spark, run, f"file://{tmp_path}/in", 10).awaitTermination(300)
    assert run.rows().count() == 4


def test_exports_hold_their_contract(spark):
    docs = talk(spark, *(f"Therapist: q\nClient: answer {i}" for i in range(4)))
    seen = scoring.texts(docs, CONFIG)
    rows = scoring.score(seen, CONFIG, (0, 1, 2)).join(seen.select("file_id", "scoring_text"), "file_id")
    flat, nested = export.flat(rows, "r", "v"), export.nested(rows, "v", "judge")
    assert export.flat_problems(flat).count() == 0 and export.nested_problems(nested).count() == 0
    assert export.flat_problems(flat.withColumn("phq8_total", F.lit(99))).count() == 4
    lines = flat.select(F.to_json(F.struct("*")).alias("value")).unionByName(spark.createDataFrame([("{broken",)], "value string")).withColumn("line", F.monotonically_increasing_id())
    assert [r["error"] for r in export.validate_lines(lines, flat.schema.simpleString()[7:-1].replace(":", " ")).collect()] == ["not a record"]


def test_label_repair(spark):
    ddl = "id string, " + ", ".join(f"{i} int" for i in ITEMS) + ", total int, binary int"
    rows = [("a", *[1] * 7, None, 10, 1), ("b", *[1] * 7, None, 30, 1), ("c", *[1] * 6, None, None, 9, 0), ("d", *[1] * 8, 8, 0), ("e", *[1] * 8, 8, 1)]
    fixed, problems = corpus.repair_labels(spark.createDataFrame(rows, ddl), ITEMS, "total", "binary", "id")
    assert {r["id"]: r[ITEMS[-1]] for r in fixed.collect()} == {"a": 3, "d": 1}
    assert {r["id"] for r in problems.collect()} == {"b", "c", "e"}


def test_judge_contract(spark):
    ddl = "file_id string, item string, discussed boolean, final_score int, assertion string, confidence double, evidence array<string>, rationale string"
    good = [("f", "sleep", True, 1, "possible", 0.5, ["e"], "r"), ("g", "sleep", False, None, "not_mentioned", None, [], "r")]
    bad = [("f", "x", True, 1, "present", 0.5, ["e"], "r"), ("f", "sleep", True, 2, "possible", 0.5, ["e"], "r"), ("f", "sleep", True, 2, "present", 0.5, [], "r"), ("f", "sleep", False, 0, "not_mentioned", None, [], " ")]
    assert contracts.judge_violations(spark.createDataFrame(good, ddl)).count() == 0
    assert contracts.judge_violations(spark.createDataFrame(bad, ddl)).count() == 4
    assert [r["file_id"] for r in contracts.judge_violations(spark.createDataFrame(good, ddl), na_aware=False).collect()] == ["g"]


def test_self_harm_reports(spark):
    ddl = "file_id string, model_id string, run_number int, mentions_self_harm boolean, self_harm_evidence array<string>"
    rows = [("f", "b", 1, True, ["second"]), ("f", "a", 2, False, None), ("f", "a", 1, None, ["first"]), ("g", "a", 1, None, None), ("h", "a", 1, True, ["a", "b", "c", "d"]), ("h", "b", 1, True, [" "])]
    reports = spark.createDataFrame(rows, ddl)
    got = {r["file_id"]: (r["mentions_self_harm"], r["self_harm_evidence"]) for r in contracts.self_harm(reports).collect()}
    assert got["f"] == (True, ["first", "second"]) and got["g"] == (False, [])
    assert {(r["file_id"], r["model_id"]) for r in contracts.self_harm_violations(reports).collect()} == {("h", "a"), ("h", "b")}


def test_ranges_and_totals(spark):
    docs = talk(spark, *(f"Therapist: q\nClient: answer {i}" for i in range(4)))
    seen = scoring.texts(docs, CONFIG)
    items = scoring.item_table(seen, CONFIG, (0, 1, 2))
    assert contracts.view_violations(seen).count() == 0 and contracts.item_violations(items).count() == 0
    assert contracts.item_violations(items.withColumn("p_not_mentioned", F.lit(1.5))).count() == items.count()
    rows = scoring.score(seen, CONFIG, (0, 1, 2))
    assert contracts.aggregate_violations(rows).count() == 0
    assert contracts.aggregate_violations(rows.withColumn("final_bucket", F.lit("x"))).count() == 4
    assert contracts.validation_report(4, contracts.aggregate_violations(rows)) == {"total": 4, "invalid": 0, "valid_lines": 4, "valid": True}


def test_whole_evaluation(spark):
    human = spark.createDataFrame([("a", "p", 3), ("b", "q", 12), ("b", "p", 8)], "file_id string, annotator_id string, phq8_total int")
    own = spark.createDataFrame([("a", 4), ("b", 11)], "file_id string, final_total int")
    got = calibration.evaluate(calibration.joined(human, own))
    assert (got["sample_size"], got["annotators"], got["bias"]) == (3, ["p", "q"], (1 - 1 + 3) / 3)
    table, passed = calibration.report(got)
    assert passed and table.splitlines()[1] == "0-4,1,0,0,0,0"
    with pytest.raises(ValueError, match="no labels"):
        calibration.evaluate(calibration.joined(human.limit(0), own))
