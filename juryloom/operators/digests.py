"""A digest of a whole table as a tree of SHA-256 over ranges of hashes: no order, layout or number of tasks changes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sha256
from ..sources.shared import scratch

#: Different lines that a leaf has at most on average; the depth follows from it and from the table's lines alone.
LEAF_LINES = 256
#: A node has one child for each hex digit.
FAN = 16
_NO_LINES = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # of the empty text


def _digest(parts: Column) -> Column:
    return sha256(F.array_join(F.array_sort(F.collect_list(parts)), "\n"))


def depth_of(lines: int, leaf_lines: int = LEAF_LINES) -> int:
    """The least depth at which the leaves of so many different lines have leaf_lines of them on average or fewer."""
    depth = 0
    while leaf_lines * FAN**depth < lines:
        depth += 1
    return depth


def digest_tree(rows: DataFrame, key: str, text: str, leaf_lines: int = LEAF_LINES) -> DataFrame:
    """(prefix, n_rows, digest): every node, from the root of empty prefix to the leaves.

    A row's line is the SHA-256 of key, colon and the text's SHA-256; null counts as empty. A leaf hashes the lines that
    begin with its prefix, sorted, each with a colon and how often it is there; a node hashes its children's prefixes and
    digests likewise. Lines are spread evenly, whatever the keys are, and repeated rows are counted before they are
    dealt, so every leaf is small. Rows are read once; their lines are written, 64 characters for each. A table
    without rows has no nodes.
    """
    spark, folder = rows.sparkSession, scratch(rows.sparkSession)
    empty = F.lit("")
    line = sha256(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), empty), sha256(F.coalesce(text, empty))))
    rows.select(line.alias("line")).groupBy("line").agg(F.count("*").alias("n")).write.parquet(f"{folder}/lines")
    lines = spark.read.parquet(f"{folder}/lines")
    depth = depth_of(lines.count(), leaf_lines)
    leaves = lines.groupBy(F.substring("line", 1, depth).alias("prefix")).agg(F.sum("n").alias("n_rows"), _digest(F.concat_ws(":", "line", F.col("n").cast("string"))).alias("digest"))
    leaves.write.parquet(f"{folder}/leaves")
    level = tree = spark.read.parquet(f"{folder}/leaves")
    for size in reversed(range(depth)):
        level = level.groupBy(F.substring("prefix", 1, size).alias("prefix")).agg(F.sum("n_rows").alias("n_rows"), _digest(F.concat_ws(":", "prefix", "digest")).alias("digest"))
        tree = tree.unionByName(level)
    return tree


def root_digest(tree: DataFrame) -> str:
    """The root's digest; the empty text's hash for a table without rows."""
    root = tree.filter("prefix = ''").first()
    return root["digest"] if root else _NO_LINES


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """(prefix, left_rows, right_rows) of the ranges of hashes in which two tables differ, at the deepest level that
    both trees have; 0 rows where one has no such node. Equal tables have none, and only rows whose line begins with
    one of these prefixes need be compared."""
    deepest = [t.agg(F.coalesce(F.max(F.length("prefix")), F.lit(0)).alias("d")).first()["d"] for t in (left, right)]
    level = lambda t, side: t.filter(F.length("prefix") == min(deepest)).select("prefix", F.col("n_rows").alias(f"{side}_rows"), F.col("digest").alias(f"{side}_digest"))
    both = level(left, "left").join(level(right, "right"), "prefix", "full")
    wanted = both.filter(~F.col("left_digest").eqNullSafe(F.col("right_digest")))
    return wanted.select("prefix", *(F.coalesce(f"{s}_rows", F.lit(0)).alias(f"{s}_rows") for s in ("left", "right")))
