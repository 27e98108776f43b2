"""Groups of rows with equal content, with all their members in pages of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import sha256
from ..sources.shared import scratch
from . import dialogue

#: Ids in a page.
PAGE = 1000


def content_pages(rows: DataFrame, key: str, text: Column, page: int = PAGE) -> DataFrame:
    """(content_hash, members, page, ids) of every content that several ids have.

    ids are sorted within a page and from page to page; pages count from 0 and all but a group's last have `page` ids.
    A group may hold any share of all rows: (content, id) pairs are dealt by ranges of both, so that a large group
    lies over many pieces, and a row for each group and piece tells how many members come before it. Null ids are
    no members.
    """
    if page < 1:
        raise ValueError("a page needs room for an id")
    spark, folder = rows.sparkSession, scratch(rows.sparkSession)
    pairs = rows.filter(F.col(key).isNotNull()).select(sha256(text).alias("content_hash"), F.col(key).alias("id")).distinct()
    dealt = pairs.repartitionByRange("content_hash", "id").sortWithinPartitions("content_hash", "id")
    dealt.withColumn("piece", F.spark_partition_id()).write.parquet(f"{folder}/pairs")  # pieces must not change after they are counted
    members = spark.read.parquet(f"{folder}/pairs")
    whole = Window.partitionBy("content_hash")
    before = whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = members.groupBy("content_hash", "piece").agg(F.count("*").alias("n"))
    counts = counts.select("content_hash", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("members")).filter("members > 1")
    here = F.row_number().over(Window.partitionBy("content_hash", "piece").orderBy("id")) - 1
    placed = members.join(counts, ["content_hash", "piece"]).withColumn("page", F.floor((F.col("before") + here) / page))
    return placed.groupBy("content_hash", "members", "page").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # of one page


def dialogue_pages(dialogues: DataFrame, page: int = PAGE) -> DataFrame:
    """As content_pages, of dialogues that are equal once they are cleaned."""
    seen = dialogue.views(dialogues)
    return content_pages(seen, "file_id", F.col("dialogue_clean"), page)
