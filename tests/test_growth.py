"""Offline votes, texts and the judge at size: what is done once for each text, what is shuffled, and exact ties."""

from fractions import Fraction
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from juryloom.config import ITEMS
from juryloom.functions import text as T
from juryloom.operators import aggregate, contracts, export, jury
from juryloom.plans import scoring
from juryloom.queries import CONFIG, NA_DIGITS, QUERIES

SF = "/root/testdata/sf0.001"


def optimised(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def texts(spark, rows):
    return spark.createDataFrame([(i, "mdd", "train", x) for i, x in rows], "file_id string, condition string, computed_split string, scoring_text string")


def test_snippets_are_cut_before_votes_repeat_a_text(spark):
    plan = optimised(QUERIES["fake_votes"](spark, SF))
    above, below = plan.split("Generate explode", 1)
    assert "regexp_extract_all" not in above
    assert "regexp_extract_all" in below


def test_votes_in_place_equal_collected_ones(spark):
    seen = texts(spark, [("a", "Client: sleep is bad\nClient: yes"), ("b", None), ("c", ""), ("d", "x" * 500)])
    for digits in ((), NA_DIGITS):
        long = aggregate.collect_votes(jury.fake_votes(seen, CONFIG.jurors, digits, scoring.KEEP), scoring.KEEP)
        wide = jury.fake_collected(seen, tuple(reversed(CONFIG.jurors)), digits, scoring.KEEP).select(*long.columns)
        assert long.schema["votes"].dataType.simpleString() == wide.schema["votes"].dataType.simpleString()
        assert sorted(map(repr, long.collect())) == sorted(map(repr, wide.collect()))


def test_item_posteriors_shuffle_turns_only(spark):
    assert optimised(QUERIES["item_posteriors_na"](spark, SF)).count("Aggregate [") == 1


def test_judge_agreement_reads_turns_once(spark):
    assert optimised(QUERIES["judge_agreement_na"](spark, SF)).count("Relation [") == 1


def test_flat_export_parses_texts_once(spark):
    plan = optimised(QUERIES["flat_export_na"](spark, SF))
    assert "conv_id" not in plan


def test_answers_of_items_nobody_mentions_hold_their_contract(spark):
    vote = "struct<model_id:string,run_number:int,discussed:boolean,score:int,assertion:string,confidence:double,evidence:array<string>>"
    none = [("m", k, False, None, "not_mentioned", None, []) for k in (1, 2)]
    rows = spark.createDataFrame([("f", "sleep", none, True)], f"file_id string, item string, votes array<{vote}>, contested boolean")
    answers = jury.fake_resolutions(rows).withColumn("discussed", F.lit(True))
    assert answers.first()["evidence"] == [jury.NO_SNIPPET]
    assert contracts.judge_violations(answers).count() == 0


#: Numbers of texts with an item that nobody mentions, and juror totals so far apart that the judge is asked for all.
SILENT = (418, 492, 524, 1115, 1404, 1419)


def test_nested_records_of_judged_rows_have_no_problem(spark):
    seen = texts(spark, [(f"f{n}", f"Client: w{n}") for n in SILENT])
    judged = aggregate.overlay_in_row(aggregate.scored(scoring.item_table(seen, CONFIG, NA_DIGITS), CONFIG, scoring.KEEP), jury.fake_resolution)
    silent = judged.filter(F.size("judge_resolution") == len(ITEMS)).filter(F.exists("items", lambda i: F.forall(i["votes"], lambda v: v["score"].isNull())))
    assert silent.count() == len(SILENT)
    assert export.nested_problems(export.nested(judged, CONFIG.prompt_version, "judge")).count() == 0


def _exact(text: str) -> tuple[int, int]:
    """The interval in fractions."""
    masses = [Fraction(1)]
    for item in ITEMS:
        last = [sha256(f"{m}|{r}|{item}|{text}".encode()).digest()[-1] for m, r in CONFIG.jurors]
        scores = [b % 4 for b in last if b >> 4 not in NA_DIGITS]
        if 2 * len(scores) < len(last):
            continue
        p = [Fraction(2 * scores.count(k) + 1, 2 * len(scores) + 4) for k in range(4)]
        masses = [sum(masses[t - k] * p[k] for k in range(4) if 0 <= t - k < len(masses)) for t in range(len(masses) + 3)]
    reached = lambda q: next(t for t in range(len(masses)) if sum(masses[: t + 1]) >= q)
    return reached(Fraction(1, 20)), reached(Fraction(19, 20))


#: Numbers of texts whose cumulated mass equals 0.05 or 0.95 at some total.
TIED = (28783, 256848, 260050, 323836, 342235, 428905, 505545, 649478, 807901, 864642, 927272, 1035642, 1100881, 1193878, 1217149, 1235814, 1248661, 1288786, 1299224, 1301845, 1320431, 1388000, 1406117, 1493589)


def test_interval_of_masses_that_equal_a_quantile(spark):
    seen = texts(spark, [(str(n), f"Client: w{n}") for n in TIED])
    rows = aggregate.scored(scoring.item_table(seen, CONFIG, NA_DIGITS), CONFIG, scoring.KEEP).select("file_id", "ci_low", "ci_high").collect()
    assert {int(r[0]): (r[1], r[2]) for r in rows} == {n: _exact(f"Client: w{n}") for n in TIED}


@pytest.mark.parametrize("n", [200, 201, 300])
def test_long_texts_by_words_of_one_letter(spark, n):
    row = spark.range(1).select(F.lit(" ".join("a" * n)).alias("x")).select(T.is_long(F.col("x")).alias("l"), T.truncate(F.col("x")).alias("t")).first()
    assert row["l"] == (n > 200)
    assert row["t"] == " ".join("a" * min(n, 200))
