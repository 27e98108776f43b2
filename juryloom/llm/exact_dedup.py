"""Exact deduplication with a log-structured merge index of text digests.

Memtables (one bounded dictionary per task) flush sorted runs of digests, each with a filter; the filters of all
runs together show which digests can occur more than once, so that only those are compacted; the texts of those that
do occur more than once are verified byte by byte. Compaction keeps the smallest identifier, in the order (longest original text, smallest doc_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE, hot_join, materialize, shared_dir, text_of

#: Entries of a memtable before it is flushed.
MEMTABLE_ROWS = 100_000
#: A filter's bits for each row, and bounds of its size as powers of two. Beyond the upper one (16 MiB) filters let
#: more and more digests pass, and compaction, which is exact without them, sees these as well.
BITS_A_ROW, LEAST_BITS, MOST_BITS = 16, 22, 27
PAGE_BYTES = 4096
#: Rows of a group that one salt of the verification join takes.
SALT_ROWS = 512
#: Stands for a null doc_id in comparisons: after all others.
LAST_ID = 2**63 - 1

_ENTRY = "digest binary, keep_points long, keep_id long, keep_row long, n long"
_RUN = f"{_ENTRY}, page int, bits binary"


def filter_bits(rows: int) -> int:
    """Bits of the filters of that many rows: a power of two."""
    return 1 << min(MOST_BITS, max(LEAST_BITS, (BITS_A_ROW * rows).bit_length()))


def normalized(docs: DataFrame) -> Column:
    return F.regexp_replace(text_of(docs), SPACE + "+", "")


def _bit(digest: bytes, bits: int) -> int:
    return int.from_bytes(digest[:4], "big") & (bits - 1)


def flush_runs(bits: int):
    """Rows (digest, points, doc_id, row) to sorted runs: entries in digest order, then the pages of the run's filter.

    Two bit planes: a digest seen by the run, and a digest that the run has seen more than once.
    """

    def flush(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memtable: dict[bytes, tuple[int, int, int, int]] = {}

        def run() -> Iterator[pd.DataFrame]:
            keys = sorted(memtable)
            entries = {"digest": keys} | {c: [memtable[k][i] for k in keys] for i, c in enumerate(("keep_points", "keep_id", "keep_row", "n"))}
            yield pd.DataFrame(entries).assign(page=pd.array([None] * len(keys), "Int32"), bits=None)
            bit = np.fromiter((_bit(k, bits) for k in keys), np.int64, len(keys))
            order = np.sort(bit)
            again = np.unique(np.concatenate([order[1:][order[1:] == order[:-1]], bit[np.array(entries["n"]) > 1]]))
            pages = []
            for page in np.unique(bit >> 15).tolist():  # 8 * PAGE_BYTES bits each
                planes = np.zeros((2, 8 * PAGE_BYTES), np.uint8)
                for plane, some in zip(planes, (order, again), strict=True):
                    plane[some[np.searchsorted(some, page << 15) : np.searchsorted(some, (page + 1) << 15)] & 0x7FFF] = 1
                pages.append((page, np.packbits(planes, axis=1).tobytes()))
            memtable.clear()
            for at in range(0, len(pages), 512):
                some = pd.DataFrame(pages[at : at + 512], columns=["page", "bits"])
                yield some.assign(digest=None, **{c: pd.array([None] * len(some), "Int64") for c in ("keep_points", "keep_id", "keep_row", "n")})

        for batch in batches:
            for digest, points, doc_id, row in zip(batch["digest"], batch["points"], batch["id"], batch["row"], strict=True):
                old = memtable.get(digest)
                if old is None:
                    memtable[digest] = (points, doc_id, row, 1)
                    if len(memtable) >= MEMTABLE_ROWS:
                        yield from run()
                else:
                    better = (-points, doc_id, row) < (-old[0], old[1], old[2])
                    memtable[digest] = (*((points, doc_id, row) if better else old[:3]), old[3] + 1)
        if memtable:
            yield from run()

    return flush


def merge_filters(runs: DataFrame, bits: int) -> bytes:
    """The bits that more than one entry has set."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for page, both in zip(batch["page"], batch["bits"], strict=True):
                new = np.frombuffer(both, np.uint8).reshape(2, -1)
                old = seen.get(page)
                seen[page] = new if old is None else np.stack([old[0] | new[0], old[1] | new[1] | (old[0] & new[0])])
        if seen:
            yield pd.DataFrame({"page": list(seen), "bits": [x.tobytes() for x in seen.values()]})

    merged = runs.filter("page is not null").select("page", "bits").repartition("page").mapInPandas(merge, "page int, bits binary")
    mask = np.zeros(bits // 8, np.uint8)
    for row in merged.select("page", F.substring("bits", PAGE_BYTES + 1, PAGE_BYTES).alias("bits")).toLocalIterator():  # bits / 8 / PAGE_BYTES rows at most
        mask[row["page"] * PAGE_BYTES : (row["page"] + 1) * PAGE_BYTES] = np.frombuffer(row["bits"], np.uint8)
    return mask.tobytes()


def repeated_entries(runs: DataFrame, mask: bytes) -> DataFrame:
    """The runs' entries whose bit more than one entry has set."""
    held = runs.sparkSession.sparkContext.broadcast(mask)

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            bit = np.fromiter((_bit(d, 8 * len(whole)) for d in batch["digest"]), np.int64, len(batch))
            yield batch[(whole[bit >> 3] >> (7 - (bit & 7)) & 1).astype(bool)]

    return runs.filter("page is null").select(*(c.split(" ")[0] for c in _ENTRY.split(", "))).mapInPandas(test, _ENTRY)


def exact_dedup(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """Groups of documents whose texts are equal once every separator character is deleted.

    Returns per row: doc_id, keep_id, group_size, kept, text_sha256. Null text counts as empty; all empty texts form
    one group. The row with the most code points in its original text stays, then the one of smallest doc_id, a null
    doc_id after all others; of rows that are equal in these too, just one stays. An empty table gives an empty
    result; other columns of docs are ignored. digest_bytes shortens the index's digests (for tests); byte
    verification keeps results right at any length.
    """
    folder = shared_dir(docs.sparkSession)
    source = docs.select(docs["doc_id"], docs["text"])
    hashed = source.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        F.length(text_of(source)).cast("long").alias("points"),
        F.sha2(normalized(source), 256).alias("text_sha256"),
    )
    digest = F.substring(F.unhex("text_sha256"), 1, digest_bytes)
    digests = materialize(hashed.withColumn("digest", digest), folder, "digests")
    bits = filter_bits(digests.count())
    runs = materialize(digests.select("digest", "points", "id", "row").mapInPandas(flush_runs(bits), _RUN), folder, "runs")

    best = F.min(F.struct((-F.col("keep_points")).alias("order"), "keep_id", "keep_row")).alias("best")
    entries = repeated_entries(runs, merge_filters(runs, bits))
    compacted = entries.groupBy("digest").agg(best, F.sum("n").alias("group_size")).filter("group_size > 1")
    compacted = materialize(compacted.select("digest", "best.keep_id", "best.keep_row", "group_size"), folder, "compacted")
    found = materialize(hot_join(digests, compacted, "digest", "row", "left"), folder, "found")

    hits = materialize(_hits(source, found.filter("group_size is not null"), digest_bytes), folder, "hits")
    bad = _unverified(hits)
    if not bad.isEmpty():
        found = _regrouped(found, hits, bad)
    own = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(own, F.col("id")).otherwise(F.col("keep_id")).alias("keep"),
        F.when(own, F.lit(1)).otherwise(F.col("group_size")).cast("long").alias("group_size"),
        (own | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    ).select("doc_id", F.when(F.col("keep") != LAST_ID, F.col("keep")).alias("keep_id"), "group_size", "kept", "text_sha256")


def _hits(source: DataFrame, members: DataFrame, digest_bytes: int) -> DataFrame:
    """Normalised texts of the members of groups. Texts move by doc_id, if at all, so that no group is in one task."""
    members = members.select("id", "digest", "keep_id", "group_size").distinct()
    if members.count() <= BROADCAST_ROWS:
        members = F.broadcast(members)
    texts = source.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), "text")
    rows = texts.join(members, "id").select("id", "digest", "keep_id", "group_size", normalized(texts).alias("norm"))
    return rows.filter(F.substring(F.unhex(F.sha2("norm", 256)), 1, digest_bytes) == F.col("digest"))


def _unverified(hits: DataFrame) -> DataFrame:
    """Digests of which some hit's bytes differ from the keeper's. Hot groups are dealt over salts."""
    salts = (F.col("group_size") / SALT_ROWS).cast("int") + 1
    salted = hits.withColumn("salt", F.pmod(F.xxhash64("id", "norm"), salts).cast("int")).select("digest", "salt", "norm").distinct()
    keepers = hits.filter("id = keep_id").select("digest", "group_size", F.col("norm").alias("keep_norm")).distinct()
    keepers = keepers.select("digest", "keep_norm", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return salted.join(keepers, ["digest", "salt"]).filter("norm <> keep_norm").select("digest").distinct()


def _regrouped(found: DataFrame, hits: DataFrame, bad: DataFrame) -> DataFrame:
    """Digest collisions: group the rows of those digests by their bytes instead."""
    texts = hits.join(bad, "digest", "left_semi").select("id", "digest", "norm").distinct()
    rows = found.select("id", "digest", "points", "row", "text_sha256").join(texts, ["id", "digest"])
    rows = rows.filter(F.sha2("norm", 256) == F.col("text_sha256"))
    best = F.min(F.struct((-F.col("points")).alias("order"), "id", "row")).alias("best")
    groups = rows.groupBy("norm").agg(best, F.count("*").alias("true_size"))
    fixed = rows.join(groups, "norm").select("row", F.col("best.id").alias("true_id"), F.col("best.row").alias("true_row"), "true_size")
    joined = found.join(fixed, "row", "left")
    for old, new in (("keep_id", "true_id"), ("keep_row", "true_row"), ("group_size", "true_size")):
        joined = joined.withColumn(old, F.coalesce(new, old))
    return joined


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; as exact_dedup decides.

    Ids that several rows have, and null ones, are settled by id and text; all others by id alone.
    """
    folder = shared_dir(docs.sparkSession)
    marked = materialize(exact_dedup(docs).select("doc_id", "text_sha256", "kept"), folder, "marked")
    ids = materialize(marked.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("kept").alias("stay")), folder, "ids")
    gone = ids.filter("n = 1 and stay = 0 and doc_id is not null").select("doc_id")
    odd = ids.filter("n > 1 or doc_id is null").select(F.col("doc_id").alias("odd_id"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    out = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    if odd.isEmpty():
        return out
    rest = out.join(odd, out["doc_id"].eqNullSafe(odd["odd_id"]), "left_anti")
    some = docs.join(odd, docs["doc_id"].eqNullSafe(odd["odd_id"]), "left_semi")
    whole = F.struct(*(some[c] for c in some.columns)).alias("doc")
    some = some.select(whole, some["doc_id"].alias("id"), F.sha2(normalized(some), 256).alias("sha")).dropDuplicates(["id", "sha"])
    stay = marked.filter("kept").select(F.col("doc_id").alias("stay_id"), F.col("text_sha256").alias("stay_sha")).distinct()
    some = some.join(stay, some["id"].eqNullSafe(stay["stay_id"]) & (some["sha"] == stay["stay_sha"]), "left_semi")
    return rest.select(docs.columns).unionByName(some.select("doc.*"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, struct_pack(a := -points, b := doc_id)) AS keep_id
  FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept,
       sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
