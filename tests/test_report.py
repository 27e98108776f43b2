"""The one-row report beside the single figures, and tails of t and F beside known values."""

import pytest
from pyspark.sql import functions as F

from juryloom.config import ITEMS, ScoringConfig
from juryloom.functions import numeric as N
from juryloom.functions import tails
from juryloom.operators import aggregate, diagnostics, report
from juryloom.plans import scoring

from .test_labelling import talk

CONFIG = ScoringConfig()


def test_tails_of_t_and_f(spark):
    # Fixed values, from tables: two-sided 5 % points of t, 97.5 % points of F.
    known_t = [(12.706, 1.0), (2.228, 10.0), (1.984, 100.0), (1.96, 1e6)]
    known_f = [(1.0, 1.0, 647.789), (5.0, 10.0, 4.2361), (10.0, 5.0, 6.6192), (30.0, 60.0, 1.8152)]
    t = spark.createDataFrame(known_t, "t double, df double").select(tails.t_two_sided(F.col("t"), F.col("df")).alias("p"))
    assert all(abs(r["p"] - 0.05) < 1e-4 for r in t.collect())
    f = spark.createDataFrame(known_f, "d1 double, d2 double, want double").select("want", tails.f_quantile(0.975, F.col("d1"), F.col("d2")).alias("q"))
    assert all(abs(r["q"] / r["want"] - 1) < 1e-4 for r in f.collect())
    some = [(0.3, 2.5), (-4.0, 17.0), (8.0, 3.0), (0.0, 5.0)]
    got = spark.createDataFrame(some, "t double, df double").select("t", "df", tails.t_two_sided(F.col("t"), F.col("df")).alias("p")).collect()
    assert all(abs(r["p"] - N.t_two_sided(r["t"], r["df"])) < 1e-9 for r in got)
    assert spark.range(1).select(tails.t_two_sided(F.lit(None).cast("double"), F.lit(3.0)).alias("p")).first()["p"] is None


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs = talk(spark, *(f"Therapist: q\nClient: answer {i}" for i in range(14)))
    items = scoring.item_table(scoring.texts(docs, CONFIG), CONFIG, (0, 1, 2, 3))
    path = str(tmp_path_factory.mktemp("report"))
    items.write.parquet(f"{path}/items")
    items = spark.read.parquet(f"{path}/items")
    scoring.score(scoring.texts(docs, CONFIG), CONFIG, (0, 1, 2, 3)).write.parquet(f"{path}/judged")
    return items, spark.read.parquet(f"{path}/judged")


def near(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) < 1e-9)


def test_report_holds_the_single_figures(spark, tables):
    items, judged = tables
    found = report.report(judged)
    assert found["n_dialogues"] == 14 and near(found["alpha"], diagnostics.krippendorff(items).first()["alpha"])
    by_item = {r["item"]: r["alpha"] for r in diagnostics.krippendorff(items, ("item",)).collect()}
    assert all(near(found["alpha_by_item"][i], by_item[i]) for i in ITEMS)
    assert all(near(found["icc"][k], v) for k, v in diagnostics.icc(items).items())
    assert near(found["cronbach"], diagnostics.cronbach(judged).first()["alpha"])
    assert all(near(found["item_total"][r["item"]], r["r"]) for r in diagnostics.item_total_correlation(judged).collect())
    cov = diagnostics.coverage(judged).first().asDict()
    assert all(near(found["coverage"][k], cov[k]) for k in found["coverage"] if k != "item_coverage")
    assert [found["coverage"]["item_coverage"][i] for i in ITEMS] == pytest.approx(cov["item_coverage"])
    sep = diagnostics.separation(judged)
    assert found["separation"]["gate_basis"] == sep["gate_basis"]
    for basis in ("imputed", "prorated"):
        assert (basis in sep) == (found["separation"][basis] is not None)
        assert all(near(found["separation"][basis][k], v) for k, v in sep.get(basis, {}).items())
    rates = {r["item"]: r["rate"] for r in diagnostics.arbitration_rates(judged).collect()}
    assert near(found["arbitration"]["overall"], rates["overall"]) and all(near(found["arbitration"]["by_item"][i], rates[i]) for i in ITEMS)
    assert found["passes"] is False
    text = report.markdown(found)
    assert text.startswith("# Diagnostics\n\nOverall: FAIL") and f"| alpha | {found['alpha']} |" in text


def test_report_of_a_clean_run_passes(spark, tmp_path):
    """Five dialogues that score low and five that score high, six jurors that agree: every gate passes."""
    votes = [
        (f"f{d}", "mdd" if d % 2 else "control", m, r, k, i, s := 2 * (d % 2) + (k < d // 2), "denied" if s == 0 else "present")
        for d in range(10) for m in "abc" for r in (1, 2) for k, i in enumerate(ITEMS)
    ]
    df = spark.createDataFrame(votes, "file_id string, condition string, model_id string, run_number int, item_idx int, item string, score int, assertion string")
    df = df.withColumns({"discussed": F.lit(True), "confidence": F.lit(0.9), "evidence": F.array(F.lit("x"))})
    rows = aggregate.scored(aggregate.item_aggregates(aggregate.collect_votes(df, ("condition",)), CONFIG), CONFIG, ("condition",))
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    found = report.report(rows)
    assert found["passes"] and all(found["gates"].values())
    assert found["alpha"] == 1.0 and found["icc"] == {"icc3": 1.0, "icc3_low": 1.0, "icc3_high": 1.0, "icc2": 1.0}
    assert found["judge_agreement"] == 1.0 and found["arbitration"]["overall"] == 0.0
    with pytest.raises(Exception, match="two dialogues of each condition"):
        report.report(rows.filter("condition = 'mdd'"))
    with pytest.raises(Exception, match="no scored rows"):
        report.report(rows.limit(0))
    fewer = F.when(F.col("file_id") == "f1", F.transform("items", lambda i: i.withField("votes", F.slice(i["votes"], 1, 2)))).otherwise(F.col("items"))
    with pytest.raises(Exception, match="different numbers of jurors"):
        report.report(rows.withColumn("items", fewer))


def test_report_takes_two_jobs(spark, tables):
    from juryloom.operators.report import report_row

    plan = report_row(tables[1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange hashpartitioning") <= 1
