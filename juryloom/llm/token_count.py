"""Token counts of flat token files: a vectorised separator scan, stitched over blocks by a prefix scan.

A flat file is a run of token ids without an index; every document ends with an end-of-document id. Blocks of the
file are scanned on their own: each gives its separators' places, its number of separators and the tokens before
the first and after the last of them. A prefix scan over these few numbers a block then gives every document's
number, start and length, also where a document spans several blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import materialize, shared_dir, text_of

#: Tokens of a block.
BLOCK_TOKENS = 65_536
#: Documents of one flat file that the query writes.
SHARD_DOCS = 4_096


def read_blocks(spark: SparkSession, path: str, itemsize: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (shard, block, tokens) of flat files of any size. Spark lists names and lengths alone; then each block is
    a row, and tasks read its byte range (local, HDFS and object stores, as pyarrow.fs opens them)."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("shard"), "length")
    size = itemsize * block_tokens
    at = F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long")))
    ranges = files.select("shard", at.alias("block", "start")).repartition("shard", "block")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, rows in batch.groupby("shard"):
                store, name = FileSystem.from_uri(shard)
                with store.open_input_file(name) as file:
                    for block, start in zip(rows["block"], rows["start"], strict=True):
                        yield pd.DataFrame({"shard": [shard], "block": [block], "tokens": [file.read_at(size, start)]})

    return ranges.mapInPandas(read, "shard string, block long, tokens binary")


def scan_separators(blocks: DataFrame, separator: int, itemsize: int = 2) -> DataFrame:
    """(shard, block, n_separators, head, tail, lengths) of each block.

    head: tokens before the first separator, all of them if there is none; tail: tokens after the last one;
    lengths: of the documents that begin and end within the block.
    """
    kind = np.dtype(f"<u{itemsize}")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for shard, block, tokens in zip(batch["shard"], batch["block"], batch["tokens"], strict=True):
                ids = np.frombuffer(tokens or b"", kind)
                ends = np.flatnonzero(ids == separator)
                if len(ends):
                    out.append((shard, block, len(ends), int(ends[0]), len(ids) - 1 - int(ends[-1]), np.diff(ends) - 1))
                else:
                    out.append((shard, block, 0, len(ids), len(ids), np.zeros(0, np.int64)))
            yield pd.DataFrame(out, columns=["shard", "block", "n_separators", "head", "tail", "lengths"])

    shard = blocks.schema["shard"].dataType.simpleString()
    ddl = f"shard {shard}, block long, n_separators long, head long, tail long, lengths array<long>"
    return blocks.select("shard", "block", "tokens").mapInPandas(scan, ddl)


def document_lengths(scanned: DataFrame) -> DataFrame:
    """Stitch scanned blocks: (shard, doc_no, n_tokens), a document's number counting separators before its end.

    Separators are not counted as tokens. Tokens after a shard's last separator are a document without an end and
    are given as well, with complete = false; a shard that ends with a separator has none.
    """
    order = Window.partitionBy("shard").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # Tokens carried into a block: the tails since the last block with a separator.
    run = F.sum(F.when(F.col("n_separators") > 0, 1).otherwise(0)).over(before)
    marked = scanned.withColumn("done", F.coalesce(F.sum("n_separators").over(before), F.lit(0))).withColumn("run", F.coalesce(run, F.lit(0)))
    within = Window.partitionBy("shard", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = F.coalesce(F.sum(F.when(F.col("n_separators") == 0, F.col("tail"))).over(within), F.lit(0))
    last = F.last(F.when(F.col("n_separators") > 0, F.col("tail")), True).over(before)
    marked = marked.withColumn("carry", carry + F.coalesce(last, F.lit(0)))
    lengths = F.concat(F.array(F.col("carry") + F.col("head")), F.col("lengths"))
    ended = marked.filter("n_separators > 0").select("shard", "done", F.posexplode(lengths).alias("i", "n_tokens"))
    ended = ended.select("shard", (F.col("done") + F.col("i")).alias("doc_no"), "n_tokens", F.lit(True).alias("complete"))
    latest = marked.withColumn("next", F.lead("block").over(order)).filter("next is null")
    rest = F.when(F.col("n_separators") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    loose = latest.select("shard", (F.col("done") + F.col("n_separators")).alias("doc_no"), rest.alias("n_tokens"), F.lit(False).alias("complete"))
    return ended.unionByName(loose.filter("n_tokens > 0"))


def token_counts(blocks: DataFrame, separator: int, itemsize: int = 2) -> DataFrame:
    """(shard, doc_no, n_tokens, complete) of all documents of flat token blocks (shard, block, tokens).

    A block without tokens is allowed; null tokens count as none; an empty table gives no rows.
    """
    return document_lengths(scan_separators(blocks, separator, itemsize))


def write_flat(docs: DataFrame, folder: str, vocabulary: str, separator: int, shard_docs: int = SHARD_DOCS, block_tokens: int = BLOCK_TOKENS, itemsize: int = 2) -> tuple[DataFrame, DataFrame]:
    """Encode documents into flat shards of ids of itemsize bytes; gives blocks (shard, block, tokens) and the order of the
    documents in the shards (shard, doc_no, doc_id).

    A shard holds what one task has read, at most shard_docs documents. The ordinary text never makes the
    separator's id, so a text that contains its string cannot split a document.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = bpe.load(vocabulary)
        pending, shard, n_docs, block, shards = bytearray(), None, 0, 0, 0
        size = itemsize * block_tokens
        kind = np.dtype(f"<u{itemsize}")

        def cut(whole: bool) -> list[tuple]:
            nonlocal block
            out = []
            while len(pending) >= size or (whole and pending):
                out.append((shard, block, bytes(pending[:size]), None, None))
                del pending[:size]
                block += 1
            return out

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["shard", "block", "tokens", "doc_no", "doc_id"], dtype=object)
            return out.astype({"block": "Int64", "doc_no": "Int64"})

        for batch in batches:
            rows = []
            for part, doc_id, text in zip(batch["part"], batch["doc_id"], batch["text"], strict=True):
                if shard is None or n_docs == shard_docs:
                    rows += cut(True)
                    # Part and counter name the shard, alike in every attempt.
                    shard, n_docs, block, shards = f"{part}-{shards}", 0, 0, shards + 1
                ids = np.frombuffer(encoder.encode_ordinary(text), "<u4")
                pending += np.append(ids, np.uint32(separator)).astype(kind).tobytes()
                rows.append((shard, None, None, n_docs, doc_id))
                n_docs += 1
                rows += cut(False)
                if len(rows) >= 256:
                    yield frame(rows)
                    rows = []
            yield frame(rows)
        if shard is not None:
            yield frame(cut(True))

    rows = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").cast("string").alias("doc_id"), text_of(docs).alias("text"))
    ddl = "shard string, block long, tokens binary, doc_no long, doc_id string"
    written = materialize(rows.mapInPandas(encode, ddl), folder, "flat")
    return (
        written.filter("block is not null").select("shard", "block", "tokens"),
        written.filter("doc_no is not null").select("shard", "doc_no", F.col("doc_id").cast("long").alias("doc_id")),
    )


def count_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write documents into flat token shards, count their tokens by separator scan, and name the documents.

    Returns doc_id, n_tokens (without the separator), shard, doc_no. Null and empty text have no tokens; repeated
    rows are documents of their own; further columns are ignored.
    """
    folder = shared_dir(docs.sparkSession)
    vocabulary = vocabulary or bpe.default_vocabulary()
    encoder = bpe.load(vocabulary)
    separator = encoder.special["<|endoftext|>"]
    itemsize = 2 if len(encoder.tokens) <= 1 << 16 else 4
    blocks, order = write_flat(docs, folder, vocabulary, separator, itemsize=itemsize)
    counted = token_counts(blocks, separator, itemsize).filter("complete")
    return order.join(counted, ["shard", "doc_no"]).select("doc_id", "n_tokens", "shard", "doc_no")
