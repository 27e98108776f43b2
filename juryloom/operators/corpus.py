"""Corpus statistics: integrity, repeated contents, keyword coverage, comparison of corpora, label repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONDITIONS, ITEMS, SPLITS
from ..functions.hashing import sha256
from ..functions.text import word_count
from . import dialogue
from .aggregate import once
from .digests import digest_tree, root_digest

# Two patterns for each item that hint at its being talked about.
KEYWORDS = {
    "anhedonia": (r"\b(interest|enjoy|pleasure|fun|hobby|hobbies)\b", r"\b(don'?t care|nothing matters|pointless)\b"),
    "depressed_mood": (r"\b(depress|sad|down|hopeless|unhappy|miserable|blue)\b", r"\b(feeling low|feel down|felt down)\b"),
    "sleep": (r"\b(sleep|insomnia|tired|exhausted|rest|awake|wake up)\b", r"\b(can'?t sleep|trouble sleeping|sleeping too much)\b"),
    "fatigue": (r"\b(tired|fatigue|exhausted|energy|worn out|drained)\b", r"\b(no energy|low energy|feel tired)\b"),
    "appetite": (r"\b(appetite|eat|eating|food|hungry|weight)\b", r"\b(lost appetite|no appetite|overeating|not eating)\b"),
    "guilt": (r"\b(guilt|guilty|failure|worthless|blame|fault)\b", r"\b(let .* down|disappoint|ashamed)\b"),
    "concentration": (r"\b(concentrat|focus|attention|distract|think clearly)\b", r"\b(can'?t focus|hard to concentrate|mind wander)\b"),
    "psychomotor": (r"\b(slow|restless|fidget|agitat|moving|pace|pacing)\b", r"\b(can'?t sit still|feel slow|slowed down)\b"),
}


def integrity(dialogues: DataFrame) -> DataFrame:
    """One row: rows, distinct and repeated ids, counts by split and condition, ids in several splits, empty texts,
    dialogues with lines of unknown speakers or before any speaker."""
    seen = dialogue.parsed(dialogues).withColumn("__unknown", F.col("unknown_speaker_count") + F.col("orphan_line_count") > 0)
    by_id = seen.groupBy("file_id").agg(
        F.count("*").alias("rows"), F.min("computed_split").alias("lo"), F.max("computed_split").alias("hi"),
        *(F.count_if(F.col("computed_split") == s).alias(f"n_{s}") for s in SPLITS),
        *(F.count_if(F.col("condition") == c).alias(f"n_{c}") for c in CONDITIONS),
        F.count_if(F.trim(F.coalesce("dialogue", F.lit(""))) == "").alias("empty"),
        F.count_if("__unknown").alias("unknown"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by_id.agg(
        total("rows").alias("total"), F.count("*").alias("distinct_ids"), F.count_if(F.col("rows") > 1).alias("repeated_ids"), F.count_if(F.col("lo") != F.col("hi")).alias("leaking_ids"),
        *(total(f"n_{x}").alias(f"n_{x}") for x in (*SPLITS, *CONDITIONS)), total("empty").alias("empty_dialogues"), total("unknown").alias("unknown_speaker_dialogues"),
    )


def counts_by(dialogues: DataFrame) -> DataFrame:
    """(condition, computed_split, n) over the whole domain, zeros too."""
    spark = dialogues.sparkSession
    domain = spark.createDataFrame([(c, s) for c in CONDITIONS for s in SPLITS], "condition string, computed_split string")
    got = dialogues.groupBy("condition", "computed_split").agg(F.count("*").alias("n"))
    return domain.join(F.broadcast(got), ["condition", "computed_split"], "left").select("condition", "computed_split", F.coalesce("n", F.lit(0)).alias("n"))  # 6 rows


def content_groups(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(content_hash, least_id, ids) of contents that several ids have; ids of one content are counted, not gathered."""
    return rows.select(F.col(key).alias("id"), sha256(text).alias("content_hash")).groupBy("content_hash").agg(F.min("id").alias("least_id"), F.count_distinct("id").alias("ids")).filter("ids > 1")


def dataset_fingerprint(dialogues: DataFrame) -> str:
    """The root of the digest tree over ids and texts: the whole corpus, in any order."""
    return root_digest(digest_tree(dialogues, "file_id", "dialogue"))


def keyword_hits(text: Column) -> dict[str, Column]:
    low = F.lower(F.coalesce(text, F.lit("")))
    return {item: F.regexp_count(low, F.lit(a)) + F.regexp_count(low, F.lit(b)) for item, (a, b) in KEYWORDS.items()}


def keyword_coverage(rows: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Matches of each item's patterns, mentioned_count, coverage and word_count of each text; null counts as empty."""
    out = rows.select(key, *keep, *(c.cast("int").alias(i) for i, c in keyword_hits(F.col(text)).items()), word_count(F.coalesce(text, F.lit(""))).alias("word_count"))
    said = sum(((F.col(i) > 0).cast("int") for i in ITEMS[1:]), (F.col(ITEMS[0]) > 0).cast("int"))
    return out.withColumn("mentioned_count", said).withColumn("coverage", F.col("mentioned_count") / F.lit(8.0))


def corpus_stats(covered: DataFrame, by: str) -> DataFrame:
    """Per corpus: size, mention rates, mean coverage, word counts; the median is the upper one.

    The upper median comes from counts of each word count, not from a sorted list of all.
    """
    sums = covered.groupBy(by).agg(
        F.count("*").alias("corpus_size"),
        *(F.avg((F.col(i) > 0).cast("double")).alias(f"{i}_rate") for i in ITEMS),
        F.avg("coverage").alias("avg_coverage"), F.min("word_count").alias("words_min"), F.max("word_count").alias("words_max"), F.avg("word_count").alias("words_mean"),
    )
    counts = covered.groupBy(by, "word_count").agg(F.count("*").alias("c"))
    table = counts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("word_count", "c"))).alias("w"), F.sum("c").alias("n"))  # distinct lengths only
    step = lambda s, x: F.struct((s["seen"] + x["c"]).alias("seen"), F.when((s["seen"] <= F.floor(F.col("n") / 2)) & (s["seen"] + x["c"] > F.floor(F.col("n") / 2)), x["word_count"]).otherwise(s["m"]).alias("m"))
    median = F.aggregate("w", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("m")), step)["m"]
    return sums.join(table.select(by, median.alias("words_median")), by)


def compare(stats: DataFrame, by: str, left: str, right: str, flag: float = 0.15) -> DataFrame:
    """(item, left_rate, right_rate, delta, flagged, verdict) of two corpora's mention rates."""
    rows = stats.select(by, F.explode(F.array(*(F.struct(F.lit(i).alias("item"), F.col(f"{i}_rate").alias("rate")) for i in ITEMS))).alias("r"))
    side = lambda name, c: rows.filter(F.col(by) == name).select("r.item", F.col("r.rate").alias(c))
    both = side(left, "left_rate").join(side(right, "right_rate"), "item").withColumn("delta", F.col("left_rate") - F.col("right_rate"))
    size = F.abs("delta")
    return both.withColumn("flagged", size > flag).withColumn("verdict", F.when(size < 0.1, "close").when(size < 0.2, "moderate").otherwise("far"))


def repair_labels(rows: DataFrame, items: tuple[str, ...], total: str, binary: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(repaired rows, problems): a single missing item is the total less the others, if that is 0 to 3.

    Rows with several missing items, a missing total, or sums that do not hold are problems and are not repaired.
    """
    scores = F.array(*(F.col(i).cast("int") for i in items))
    row = once(rows, {"__scores": scores})
    missing = F.size(F.filter("__scores", lambda x: x.isNull()))
    lack = F.col(total) - F.aggregate("__scores", F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    row = once(row, {"__missing": missing, "__lack": lack})
    missing, lack = F.col("__missing"), F.col("__lack")
    problem = (
        F.when(missing > 1, "several items missing")
        .when(F.col(total).isNull(), "total missing")
        .when((missing == 1) & ~lack.between(0, 3), "missing item out of range")
        .when((missing == 0) & (lack != 0), "items do not sum to the total")
        .when(F.col(binary) != (F.col(total) >= 10).cast("int"), "binary label does not match")
    )
    marked = row.withColumn("__problem", problem)
    good = marked.filter("__problem is null")
    fixed = good.select(*(F.coalesce(F.col(c), lack).cast("int").alias(c) if c in items else F.col(c) for c in rows.columns))
    return fixed, marked.filter("__problem is not null").select(key, F.col("__problem").alias("problem"))
