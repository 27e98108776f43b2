"""Agreement with human labels, and the choice of dialogues for annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BUCKETS
from ..functions import numeric as N

NAMES = tuple(BUCKETS)


def joined(human: DataFrame, scored: DataFrame) -> DataFrame:
    """(file_id, annotator_id, truth, predicted, human_total, system_total): each label's line counts; an id that the
    system has not scored is an error."""
    own = scored.select("file_id", F.col("final_total").alias("system_total"))
    both = human.join(own, "file_id", "left")
    total = F.when(F.col("system_total").isNull(), F.raise_error(F.concat(F.lit("not scored: "), "file_id")).cast("int")).otherwise(F.col("system_total"))
    return both.select("file_id", "annotator_id", F.col("phq8_total").alias("human_total"), total.alias("system_total")).select(
        "*", N.bucket_of(F.col("human_total")).alias("truth"), N.bucket_of(F.col("system_total")).alias("predicted")
    )


def confusion(pairs: DataFrame) -> DataFrame:
    """(t, p, n) for all 5 x 5 cells of bucket indices."""
    place = lambda c: (F.array_position(F.array(*map(F.lit, NAMES)), F.col(c)) - 1).cast("int")
    got = pairs.groupBy(place("truth").alias("t"), place("predicted").alias("p")).agg(F.count("*").alias("n"))
    spark = pairs.sparkSession
    side = lambda c: spark.range(len(NAMES)).select(F.col("id").cast("int").alias(c))
    cells = side("t").crossJoin(side("p"))  # 25 rows
    return cells.join(F.broadcast(got), ["t", "p"], "left").select("t", "p", F.coalesce("n", F.lit(0)).alias("n"))


def agreement(cells: DataFrame) -> DataFrame:
    """One row from confusion cells: n, accuracy, kappa, weighted_kappa (quadratic)."""
    row = cells.groupBy("t").agg(F.sum("n").alias("rt"))
    col = cells.groupBy("p").agg(F.sum("n").alias("cp"))
    full = cells.join(row, "t").join(col, "p").crossJoin(cells.agg(F.sum("n").alias("total")))  # 25 rows
    weight = F.pow((F.col("t") - F.col("p")) / float(len(NAMES) - 1), F.lit(2))
    chance = F.col("rt") * F.col("cp") / F.col("total")
    got = full.agg(
        F.first("total").alias("n"),
        (F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)) / F.first("total")).alias("accuracy"),
        (F.sum(F.when(F.col("t") == F.col("p"), chance).otherwise(0.0)) / F.first("total")).alias("pe"),
        F.sum(weight * F.col("n")).alias("seen"),
        F.sum(weight * chance).alias("expected"),
    )
    return got.select(
        "n",
        "accuracy",
        F.when(F.col("pe") >= 1, 1.0).otherwise((F.col("accuracy") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"),
        F.when(F.col("expected") == 0, 1.0).otherwise(1 - F.col("seen") / F.col("expected")).alias("weighted_kappa"),
    )


def class_metrics(cells: DataFrame) -> DataFrame:
    """(bucket, precision, recall, f1, support); 0 where undefined."""
    row = cells.groupBy(F.col("t").alias("k")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    col = cells.groupBy(F.col("p").alias("k")).agg(F.sum("n").alias("called"))
    both = row.join(col, "k")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = both.select("k", ratio("hit", "called").alias("precision"), ratio("hit", "support").alias("recall"), "support")
    pr = F.col("precision") + F.col("recall")
    name = F.get(F.array(*map(F.lit, NAMES)), F.col("k"))
    return out.select(name.alias("bucket"), "precision", "recall", F.when(pr > 0, 2 * F.col("precision") * F.col("recall") / pr).otherwise(0.0).alias("f1"), "support")


def bias(pairs: DataFrame) -> DataFrame:
    """One row: mean of system minus human, and the annotators in order."""
    return pairs.agg(F.avg(F.col("system_total") - F.col("human_total")).alias("bias"), F.array_sort(F.collect_set("annotator_id")).alias("annotators"))


def self_harm_recall(human: DataFrame, flagged: DataFrame) -> DataFrame:
    """One row: positives, found and recall (1 without positives); an id's last line decides, and a positive that is not
    scored is an error.

    human has line, file_id and self_harm; flagged has file_id and mentions_self_harm.
    """
    last = human.filter("self_harm is not null").groupBy("file_id").agg(F.max_by("self_harm", "line").alias("truth")).filter("truth")
    both = last.join(flagged.select("file_id", "mentions_self_harm"), "file_id", "left")
    scored = F.when(F.col("mentions_self_harm").isNull(), F.raise_error(F.concat(F.lit("not scored: "), "file_id")).cast("boolean")).otherwise(F.col("mentions_self_harm"))
    got = both.agg(F.count("*").alias("positives"), F.count_if(scored).alias("found"))
    return got.withColumn("recall", F.when(F.col("positives") > 0, F.col("found") / F.col("positives")).otherwise(1.0))


def evaluate(pairs: DataFrame, recall: DataFrame | None = None) -> dict:
    """The whole comparison with people, as a dictionary: from joined labels (every line counts) and self_harm_recall's
    row, whose recall is 1 where it is left out. Only fixed numbers of cells come to the driver. No labels: an error."""
    cells = confusion(pairs).orderBy("t", "p").collect()  # 25 rows
    if not sum(r["n"] for r in cells):
        raise ValueError("no labels")
    frame = pairs.sparkSession.createDataFrame(cells, "t int, p int, n long")
    overall, side = agreement(frame).first(), bias(pairs).first()
    return {
        "sample_size": overall["n"],
        "annotators": side["annotators"],
        "accuracy": overall["accuracy"],
        "kappa": overall["kappa"],
        "weighted_kappa": overall["weighted_kappa"],
        "confusion": [[r["n"] for r in cells if r["t"] == t] for t in range(len(NAMES))],
        "classes": {r["bucket"]: {c: r[c] for c in ("precision", "recall", "f1", "support")} for r in class_metrics(frame).collect()},
        "bias": side["bias"],
        "self_harm_recall": 1.0 if recall is None else recall.first()["recall"],
    }


def report(evaluation: dict) -> tuple[str, bool]:
    """The confusion table as lines of comma-separated text, and whether the evaluation passes: every self-harm
    positive found."""
    head = "true\\pred," + ",".join(NAMES)
    rows = [f"{name}," + ",".join(map(str, row)) for name, row in zip(NAMES, evaluation["confusion"], strict=True)]
    return "\n".join([head, *rows]) + "\n", evaluation["self_harm_recall"] >= 1.0


def features(scored: DataFrame) -> DataFrame:
    """(file_id, triggered_arbitration, mean_entropy, max_range); items without votes have no entropy."""
    known = lambda f: F.filter(F.transform("items", lambda i: i[f]), lambda x: x.isNotNull())
    h = known("entropy")
    mean: Column = F.when(F.size(h) > 0, N.total(h) / F.size(h)).otherwise(0.0)
    return scored.select("file_id", "triggered_arbitration", mean.alias("mean_entropy"), F.coalesce(F.array_max(known("vote_range")), F.lit(0)).alias("max_range"))


def most_uncertain(scored: DataFrame, k: int) -> DataFrame:
    """The k most uncertain dialogues: arbitrated, mean entropy above 1, or votes two apart."""
    rows = features(scored).filter("triggered_arbitration or mean_entropy > 1.0 or max_range >= 2")
    return rows.orderBy(F.desc("triggered_arbitration"), F.desc("mean_entropy"), F.desc("max_range"), F.desc("file_id")).limit(k)


def sample(scored: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n dialogues for annotation: half the most uncertain, the rest by a seeded hash of the id; sorted by id.

    The choice depends on the ids and the seed alone, not on the order or partitioning of rows.
    """
    if n > scored.count():
        raise ValueError("more dialogues asked for than there are")
    first = most_uncertain(scored, n // 2).select("file_id")
    rest = scored.select("file_id").join(first, "file_id", "left_anti")
    more = rest.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), "file_id"), 256), "file_id").limit(n - first.count())
    return first.unionByName(more).orderBy("file_id")


def template(chosen: DataFrame) -> DataFrame:
    """The annotators' sheet: only file_id is filled."""
    blank = ["annotator_id", "phq8_total", *(f"phq8_item_{i}" for i in range(1, 9)), "self_harm_flag", "notes"]
    return chosen.select("file_id", *(F.lit("").alias(c) for c in blank))
