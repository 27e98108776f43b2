"""Claims of dialogues in a stream: each once, again after failures and time-outs, forgotten after their time."""

import time

import pytest
from pyspark.sql import functions as F

pytest.importorskip("google.protobuf")

from juryloom.config import ScoringConfig  # noqa: E402
from juryloom.operators import jury  # noqa: E402
from juryloom.plans import scoring  # noqa: E402
from juryloom.sources.corpus import COLUMNS  # noqa: E402
from juryloom.streaming.claims import NEWS, STORE, Terms, claim_stream, claims  # noqa: E402

CONFIG = ScoringConfig()


def test_a_limit_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no limit"):
        claim_stream(spark, scoring.Run(spark, f"file://{tmp_path}/run", ScoringConfig(limit=1)), str(tmp_path))


class Steps:
    """A stream of claims over files that a test adds one after another; each step starts it anew from its checkpoint."""

    def __init__(self, spark, folder, terms):
        self.spark, self.folder, self.terms = spark, folder, terms
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
        self.seen = 0

    def __call__(self, *news):
        """news: (id, kind, attempt, text); gives the claims they lead to."""
        rows = [(i, "mdd", "c", "t", text, kind, attempt) for i, kind, attempt, text in news]
        self.spark.createDataFrame(rows, NEWS).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = claims(self.spark.readStream.schema(NEWS).parquet(f"{self.folder}/in"), self.terms)
        out = []
        q = stream.writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", f"{self.folder}/state").trigger(once=True).start()
        q.awaitTermination(120)
        return sorted((r["file_id"], r["attempt"], r["reason"], r["dialogue"]) for r in out)


def test_claims_follow_the_ends_of_attempts(spark, tmp_path):
    step = Steps(spark, tmp_path, Terms(attempts=2))
    come = lambda i, text="x": (i, "arrived", 0, text)
    assert step(come("a"), come("b"), come("b"), come(None), come("c", None)) == [("a", 1, "new", "x"), ("b", 1, "new", "x"), ("c", 1, "new", None)]
    assert step(come("a"), come("b", "other")) == [("b", 0, "conflict", "other")]  # a is being scored
    assert step(("a", "done", 1, None), ("b", "failed", 1, None)) == [("b", 2, "failed", "x")]
    assert step(come("a"), ("b", "failed", 1, None)) == []  # done; the end of an attempt before
    assert step(("b", "failed", 2, None), ("z", "done", 1, None)) == [("b", 2, "given up", "x")]
    assert step(come("b"), ("c", "failed", 1, None), ("c", "failed", 2, None)) == [("c", 2, "failed", None), ("c", 2, "given up", None)]


def test_lost_attempts_come_again_and_old_ends_are_forgotten(spark, tmp_path):
    step = Steps(spark, tmp_path, Terms(attempts=2, stuck_ms=1500, keep_ms=1500))
    assert step(("a", "arrived", 0, "x"), ("b", "arrived", 0, "x")) == [("a", 1, "new", "x"), ("b", 1, "new", "x")]
    time.sleep(2)
    assert step(("b", "done", 1, None)) in ([("a", 2, "stuck", "x")], [("a", 2, "stuck", "x"), ("b", 2, "stuck", "x")])
    time.sleep(2)
    got = step(("b", "done", 1, None), ("c", "arrived", 0, "x"))
    assert ("a", 2, "given up", "x") in got and ("c", 1, "new", "x") in got
    time.sleep(2)
    assert ("a", 1, "new", "y") in step(("a", "arrived", 0, "y"))


def test_claimed_dialogues_are_scored_once_over_restarts(spark, tmp_path):
    def ask(text):
        if "never" in text or ("later" in text and not (tmp_path / "open").exists()):
            raise RuntimeError("no answer")
        vote = {"model_id": "m", "run_number": 1, "discussed": True, "assertion": "present", "confidence": 0.9, "evidence": ["x"], "score": 1}
        return [{**vote, "item": i} for i in jury.ITEMS]

    run = scoring.Run(spark, f"file://{tmp_path}/run", CONFIG, lambda t: jury.external_votes(t, ask, 1))

    def add(rows):
        spark.createDataFrame([(i, "mdd", "c", "t", f"Client: {t}") for i, t in rows], ", ".join(f"{c} string" for c in COLUMNS)).write.mode("append").parquet(f"{tmp_path}/in")

    def go():
        q = claim_stream(spark, run, f"file://{tmp_path}/in", Terms(attempts=2), once=True)
        q.awaitTermination(300)
        assert q.exception() is None

    add([("a", "sound"), ("b", "later"), ("c", "never")])
    go()
    first = {r["file_id"]: (r["status"], r["attempt"]) for r in run.latest().collect()}
    assert first == {"a": ("done", 1), "b": ("failed", 1), "c": ("failed", 1)}
    (tmp_path / "open").touch()
    add([("a", "sound"), ("d", "sound")])
    go()
    second = {r["file_id"]: (r["status"], r["attempt"]) for r in run.latest().collect()}
    assert second == {"a": ("done", 1), "b": ("done", 2), "c": ("failed", 2), "d": ("done", 1)}
    go()
    assert sorted(r["file_id"] for r in run.rows().collect()) == ["a", "b", "d"]
    given = run.events().filter("file_id = 'c' and error_message = 'given up'").collect()
    assert [r["attempt"] for r in given] == [0]
    batch = run.events().filter("file_id = 'd' and status = 'done'").first()["batch"]
    again = spark.createDataFrame([("d", "mdd", "c", "t", "Client: sound", 1, "new", "train")], ", ".join(f"{c} string" for c in COLUMNS) + ", attempt int, reason string, computed_split string")
    assert run.run_claimed(again, batch) == 0  # a repeated batch finds its own events
    assert run.rows().count() == 3
    assert run.events().filter(F.col("file_id") == "d").filter("status = 'done'").count() == 1
