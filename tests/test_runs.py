"""Runs that meet broken jurors and judges, what they report, resets, and the ledger's snapshots."""

import pytest
from pyspark.sql import functions as F

from juryloom.config import ITEMS, ScoringConfig
from juryloom.operators import calibration, contracts, jury
from juryloom.plans import scoring
from juryloom.plans.ledger import EVENT, Ledger, last_events

from .test_labelling import talk

CONFIG = ScoringConfig()


def votes_of(run, text):
    """A juror's eight votes; what the text says decides what is wrong with them."""
    vote = {"model_id": "m", "run_number": run, "discussed": True, "assertion": "present", "confidence": 0.9, "evidence": ["x"]}
    out = [{**vote, "item": i, "score": 1 + k % 3} for k, i in enumerate(ITEMS)]
    if "unknown" in text:
        out.insert(0, {**vote, "item": "appetite?", "score": 3})
    if "lacking" in text:
        out.pop(3)
    if "boolean" in text:
        out[0]["score"] = True
    if "string" in text:
        out[0]["discussed"] = "true"
    if "snippets" in text:
        out[0]["evidence"] = ["a", 3]
    if "unsound" in text:
        out[0] |= {"assertion": "denied", "score": 2}
    for v in out:
        v |= {"input_tokens": 10 * run, "output_tokens": None, "total_tokens": 11, "mentions_self_harm": "harm" in text and run == 2, "self_harm_evidence": [f"said {run}"] if "harm" in text else []}
    return out


def ask(text):
    return votes_of(1, text if "second" not in text else "") + votes_of(2, text)


def test_broken_votes_fail_their_dialogue_alone(spark, tmp_path):
    kinds = ["sound", "unknown item", "lacking item", "boolean score", "string flag", "bad snippets", "unsound vote", "second lacking", "harm said"]
    docs = talk(spark, *(f"Client: {k}" for k in kinds))
    run = scoring.Run(spark, f"file://{tmp_path}/run", CONFIG, lambda t: jury.external_votes(t, ask, 2))
    assert run.run_once(docs) == 2
    said = {r["file_id"]: r["scoring_text"] for r in scoring.texts(docs, CONFIG).collect()}
    got = {said[r["file_id"]].removeprefix("Client: "): (r["status"], r["error_code"], r["error_message"]) for r in run.latest().collect()}
    assert got["sound"] == ("done", None, None) and got["harm said"][0] == "done"
    assert got["unknown item"] == ("failed", "contract", "m/1/appetite?: unknown item")
    assert got["lacking item"] == ("failed", "contract", "m/1: 7 of 8 items answered, 7 votes")
    assert got["second lacking"] == ("failed", "contract", "m/2: 7 of 8 items answered, 7 votes")
    assert got["boolean score"] == ("failed", "TypeError", "score is bool: True")
    assert got["string flag"] == ("failed", "TypeError", "discussed is str: 'true'")
    assert got["bad snippets"][:2] == ("failed", "TypeError") and got["bad snippets"][2].startswith("evidence is list")
    assert got["unsound vote"] == ("failed", "contract", "m/1/anhedonia: denied needs score 0")
    rows = {said[r["file_id"]].removeprefix("Client: "): r for r in run.rows().collect()}
    assert [len(r["items"]) for r in rows.values()] == [8, 8]
    assert rows["sound"]["final_item_scores"] == [1 + k % 3 for k in range(8)]
    assert not rows["sound"]["mentions_self_harm"] and rows["sound"]["self_harm_evidence"] == []
    assert rows["harm said"]["mentions_self_harm"] and rows["harm said"]["self_harm_evidence"] == ["said 1", "said 2"]
    judged = sum(1 for r in rows.values() for _ in (r["judge_resolution"] or {}))
    manifest = run.finish(docs)
    assert (manifest["completed"], manifest["failed"]) == (2, 7)
    assert manifest["input_tokens"] == 2 * 30 + judged * jury.JUDGE_USAGE[0] and manifest["output_tokens"] == judged * jury.JUDGE_USAGE[1]


def test_judges_that_break_their_contract(spark, tmp_path):
    kinds = ["fine", "no answer", "twice", "unasked", "unsound", "too high"]
    docs = talk(spark, *(f"Client: {k}" for k in kinds))
    said = {r["file_id"]: r["scoring_text"].removeprefix("Client: ") for r in scoring.texts(docs, CONFIG).collect()}
    of = F.create_map(*(F.lit(x) for kv in said.items() for x in kv))

    def jurors(t):
        return jury.external_votes(t, lambda text: [{**v, "score": s} for r, s in ((1, 1), (2, 3), (3, 3)) for v in votes_of(r, "")], 2)

    def judge(items):
        usage = F.struct(F.lit(5).alias("input_tokens"), F.lit(None).cast("long").alias("output_tokens"), F.lit(1).alias("reasoning_tokens"), F.lit(6).alias("total_tokens"))
        kind = of[F.col("file_id")]
        rows = items.select("file_id", "item", kind.alias("k"), F.when(kind == "too high", 4).otherwise(2).alias("final_score"), F.when(kind == "unsound", "possible").otherwise("present").alias("assertion"), usage.alias("usage"))
        rows = rows.filter("not (k = 'no answer' and item = 'sleep')")
        more = rows.filter("k = 'twice' and item = 'sleep'").unionByName(rows.filter("k = 'unasked' and item = 'sleep'").withColumn("item", F.lit("mood")))
        return rows.unionByName(more).drop("k")

    run = scoring.Run(spark, f"file://{tmp_path}/run", CONFIG, jurors, judge)
    assert run.run_once(docs) == 1
    got = {said[r["file_id"]]: r["error_message"] for r in run.latest().collect()}
    assert got == {
        "fine": None, "no answer": "sleep: no answer", "twice": "sleep: several answers", "unasked": "mood: not asked for",
        "unsound": f"{min(ITEMS)}: possible needs score 1", "too high": f"{min(ITEMS)}: score out of range",
    }
    row = run.rows().first()
    assert row["final_item_scores"] == [2] * 8 and row["token_usage"].asDict() == {"input_tokens": 60 + 40, "output_tokens": 0, "reasoning_tokens": 8, "total_tokens": 33 + 48}


def test_types_of_votes():
    good = {"model_id": "m", "run_number": 1, "item": "sleep", "discussed": True, "score": 1, "assertion": "present", "confidence": 1, "evidence": ["e"]}
    assert jury.ill_typed(good) is None and jury.ill_typed({k: None for k in good}) is None
    for name, x in (("score", False), ("score", "1"), ("score", 1.0), ("discussed", 1), ("confidence", True), ("evidence", "e"), ("run_number", True), ("input_tokens", "5")):
        assert jury.ill_typed({**good, name: x}).startswith(f"{name} is ")


def test_a_reset_keeps_the_old_run_aside(spark, tmp_path):
    docs = talk(spark, "Client: one", "Client: two")
    old = scoring.Run(spark, f"file://{tmp_path}/run", CONFIG)
    assert old.reset() is None and old.run_once(docs) == 2
    new = scoring.Run(spark, old.folder, ScoringConfig(alpha=1.0))
    with pytest.raises(ValueError, match="another configuration"):
        new.run_once(docs)
    aside = new.reset()
    assert new.run_once(docs) == 2 and new.rows().count() == 2
    assert spark.read.parquet(f"{aside}/rows").count() == 2


def test_unscored_positives_are_errors(spark):
    human = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "b", True), (4, "c", True), (5, "c", None)], "line long, file_id string, self_harm boolean")
    flagged = spark.createDataFrame([("b", True), ("c", False)], "file_id string, mentions_self_harm boolean")
    assert calibration.self_harm_recall(human, flagged).first().asDict() == {"positives": 2, "found": 1, "recall": 0.5}
    assert calibration.self_harm_recall(human.filter("not self_harm"), flagged).first()["recall"] == 1.0
    with pytest.raises(Exception, match="not scored: c"):
        calibration.self_harm_recall(human, flagged.filter("file_id = 'b'")).collect()


def event(i, status, attempt, second, part="p"):
    return (f"f{i}", status, attempt, None, None, f"2024-01-01 00:00:{second:02d}", 0, part, *([attempt] * 4))


def write(spark, ledger, rows):
    df = spark.createDataFrame(rows, EVENT.replace("at timestamp", "at string")).withColumn("at", F.col("at").cast("timestamp"))
    ledger.append(df.coalesce(2))


def state(ledger):
    done = ledger.events().filter("status = 'done'")
    return sorted(map(str, ledger.latest().collect())), sorted(map(str, last_events(done).collect()))


ROUNDS = [
    [event(i, "running", 1, 1) for i in range(6)] + [event(i, "done" if i % 2 else "failed", 1, 2, "a") for i in range(6)],
    [event(i, "running", 2, 3) for i in (0, 1, 2)] + [event(0, "done", 2, 4, "b"), event(2, "failed", 2, 4, "b")],
    [event(1, "failed", 2, 6, "c"), event(9, "running", 1, 7)],
]


def test_snapshots_keep_what_is_known(spark, tmp_path):
    plain, folded = Ledger(spark, f"file://{tmp_path}/plain"), Ledger(spark, f"file://{tmp_path}/folded")
    assert folded.events().count() == 0
    for n, rows in enumerate(ROUNDS, 1):
        write(spark, plain, rows)
        write(spark, folded, rows)
        assert state(folded) == state(plain)
        assert folded.compact() == n and folded.event_files() == []
        assert state(folded) == state(plain)
    assert folded.events().count() < plain.events().count()
    assert folded._names(f"{folded.folder}/snapshots") == ["3"]


@pytest.mark.parametrize("step", ["_write", "_publish", "_vacuum", "within _write", "within _vacuum"])
def test_a_compaction_may_break_off_anywhere(spark, tmp_path, monkeypatch, step):
    plain, folded = Ledger(spark, f"file://{tmp_path}/plain"), Ledger(spark, f"file://{tmp_path}/folded")
    for ledger in (plain, folded):
        write(spark, ledger, ROUNDS[0])
    folded.compact()
    for ledger in (plain, folded):
        write(spark, ledger, ROUNDS[1])

    def broken(self, *a):
        if step == "within _write":
            spark.createDataFrame([], EVENT).write.parquet(f"{self.folder}/snapshots/{a[0]}/events")
        if step == "within _vacuum":
            fs, p = self._fs(f"{self.folder}/events/{a[1][0]}")
            fs.delete(p, False)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Ledger, step.split()[-1], broken)
        with pytest.raises(RuntimeError, match="lost"):
            folded.compact()
    assert state(folded) == state(plain)
    for ledger in (plain, folded):
        write(spark, ledger, ROUNDS[2])
    assert state(folded) == state(plain)
    folded.compact()
    assert state(folded) == state(plain) and folded.event_files() == []


def test_appends_during_a_compaction_stay(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    write(spark, ledger, ROUNDS[0])
    inner = Ledger._publish

    def late(self, number):
        write(spark, self, ROUNDS[1])
        inner(self, number)

    monkeypatch.setattr(Ledger, "_publish", late)
    ledger.compact()
    plain = Ledger(spark, f"file://{tmp_path}/plain")
    write(spark, plain, ROUNDS[0] + ROUNDS[1])
    assert state(ledger) == state(plain)


def test_a_run_goes_on_from_a_snapshot(spark, tmp_path):
    docs = talk(spark, *(f"Client: answer {i}" for i in range(4)))
    run = scoring.Run(spark, f"file://{tmp_path}/run", CONFIG)
    assert run.run_once(docs.filter("file_id < 'f2'")) == 2
    run.ledger.compact()
    assert run.pending(docs).count() == 2 and run.rows().count() == 2
    assert run.run_once(docs) == 2 and run.rows().count() == 4 and run.job("f0")["attempt"] == 1
    assert contracts.aggregate_violations(run.rows()).count() == 0
