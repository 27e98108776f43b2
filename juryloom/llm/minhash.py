"""Near-duplicates: universal-hash minima, banding, signature verification, exact links, components.

Documents with the same shingle set are first put together under one representative. A band's bucket is not
expanded into pairs: its members are compared with the bucket's first member; only where the members of a bucket
are then still in different components are they compared among each other, in bounded blocks of signatures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, hot_join, materialize, mix64, shared_dir, shingle_set, text_of, through_python
from .components import connected_components

#: 32 bands of 4 minima find a pair of similarity 0.85 with probability 1 - 6e-11, one of 0.8 with 1 - 5e-8.
BANDS, BAND_ROWS = 32, 4
MINIMA = BANDS * BAND_ROWS
#: Standard errors of the signature's estimate below the threshold at which a candidate is given up.
SIGNATURE_ERRORS = 5.0
#: Signatures of a bucket that are compared with as many others in one task.
BLOCK = 512
#: Signatures or sets up to which a table of them is broadcast.
FEW = 4_000

_rng = np.random.Generator(np.random.PCG64(20240501))
_A = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The 32-bit minima of MINIMA multiply-shift hashes."""
    least = np.full(MINIMA, 0xFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[at : at + 1024]
        least = np.minimum(least, ((part[:, None] * _A + _B) >> np.uint64(32)).min(axis=0))
    return least.astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, BAND_ROWS).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64)
    for i in range(BAND_ROWS):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return h.astype(np.int64)


def sign(rows: DataFrame, key: str, text: Column, width: int) -> DataFrame:
    """key, n_shingles, set_key (128 bits of the whole set; null without words), sig, bands."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text in zip(batch[key], batch["text"], strict=True):
                s = shingle_set(text.encode("utf-8"), width)
                if not len(s):
                    out.append((k, 0, None, None, None))
                    continue
                sig = signature(s)
                whole = np.array([np.bitwise_xor.reduce(mix64(s)), mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64)
                out.append((k, len(s), whole.tobytes(), sig.tobytes(), band_keys(sig)))
            yield pd.DataFrame(out, columns=[key, "n_shingles", "set_key", "sig", "bands"])

    ddl = f"{key} string, n_shingles long, set_key binary, sig binary, bands array<long>"
    return through_python(rows.select(key, text.alias("text")), key, lambda r: r.mapInPandas(one, ddl))


def _with_both(pairs: DataFrame, side: DataFrame, value: str) -> DataFrame:
    """Pairs (a, b) with the value of each one's id; a may stand in any share of the pairs, b in a few."""
    pairs = pairs.join(side.select(F.col("id").alias("b"), F.col(value).alias(f"{value}_b")), "b")
    return hot_join(pairs, side.select(F.col("id").alias("a"), F.col(value).alias(f"{value}_a")), "a", "b", few=FEW)


def _intersections(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, size_a, size_b) on full sets."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [
                len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                for x, y in zip(batch["set_a"], batch["set_b"], strict=True)
            ]
            size = [[len(x) // 8 for x in batch[c]] for c in ("set_a", "set_b")]
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "both": both, "size_a": size[0], "size_b": size[1]})

    joined = _with_both(pairs, sets, "set")
    return joined.select("a", "b", "set_a", "set_b").mapInPandas(count, "a long, b long, both long, size_a long, size_b long")


def _sets(rows: DataFrame, ids: DataFrame, key: str, text: Column, width: int) -> DataFrame:
    """(id, set) of the rows whose key is among ids, a written table."""

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "set": [shingle_set(t.encode("utf-8"), width).tobytes() for t in batch["text"]]})

    wanted = rows.select(F.col(key).cast("long").alias("id"), text.alias("text")).join(bounded(ids), "id", "left_semi")
    return wanted.mapInPandas(shingles, "id long, set binary").distinct()


def agreement_floor(threshold: float) -> int:
    """Equal minima below which a pair of that similarity is not expected (SIGNATURE_ERRORS standard errors)."""
    return int(MINIMA * threshold - SIGNATURE_ERRORS * (MINIMA * threshold * (1 - threshold)) ** 0.5)


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()


def _star_candidates(reps: DataFrame, floor: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """Members of the buckets that have several, and their signature-verified pairs with the bucket's first."""
    banded = reps.select("id", F.explode("bands").alias("bucket"))
    several = banded.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count("*").alias("size")).filter("size > 1")
    members = materialize(banded.join(several, "bucket"), folder, "members")
    pairs = members.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    pairs = materialize(pairs, folder, "candidates")
    ids = materialize(_ids(pairs), folder, "candidate-ids")
    sig = materialize(reps.select("id", "sig").join(bounded(ids), "id", "left_semi"), folder, "candidate-signatures")

    def agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            equal = [
                int((np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).sum())
                for x, y in zip(batch["sig_a"], batch["sig_b"], strict=True)
            ]
            yield batch.loc[np.array(equal, dtype=int) >= floor, ["a", "b"]]

    return members, _with_both(pairs, sig, "sig").select("a", "b", "sig_a", "sig_b").mapInPandas(agree, "a long, b long")


def _mixed_members(members: DataFrame, component: DataFrame, folder: str) -> DataFrame:
    """(bucket, pivot, size, id, component) of the buckets whose members are still in several components."""
    labelled = members.filter("size > 2").join(component, "id", "left")
    labelled = materialize(labelled.withColumn("component", F.coalesce("component", "id")), folder, "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    return hot_join(labelled, materialize(mixed.select("bucket"), folder, "mixed-buckets"), "bucket", "id")


def _rest_candidates(mixed: DataFrame, ids: DataFrame, reps: DataFrame, sets: DataFrame, floor: int, percent: int) -> DataFrame:
    """Pairs within a bucket, of different components and not yet compared, whose signatures and sets agree.

    A bucket's members are dealt over blocks; a task compares two blocks. A pair that shares several buckets is
    taken in the first band in which its minima agree. Sets are compared by 32-bit halves of their hashes here,
    so that only what will be a link, but for a chance of about 1e-6, leaves the task.
    """
    sig = reps.join(bounded(ids), "id", "left_semi")
    labelled = mixed.join(sig, "id")
    labelled = labelled.withColumn("band", F.array_position("bands", F.col("bucket")).cast("int") - 1).drop("bands")

    def halves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            half = [np.unique((np.frombuffer(x, np.uint64) >> np.uint64(32)).astype(np.uint32)).tobytes() for x in batch["set"]]
            yield pd.DataFrame({"id": batch["id"], "half": half})

    labelled = labelled.join(sets.mapInPandas(halves, "id long, half binary"), "id")
    blocks = (F.col("size") / BLOCK).cast("int") + 1
    labelled = labelled.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = labelled.select("*", other).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    dealt = dealt.select("bucket", "band", "pivot", "id", "component", "sig", "half", "block", "x", "y")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        sig = np.stack([np.frombuffer(s, np.uint32) for s in group["sig"]])
        half = [np.frombuffer(s, np.uint32) for s in group["half"]]
        size = np.array([len(h) for h in half])
        ids, comp, block = (group[c].to_numpy() for c in ("id", "component", "block"))
        before = int(group["band"].iat[0]) * BAND_ROWS
        lo, hi = group["x"].iat[0], group["y"].iat[0]
        members = ids != group["pivot"].iat[0]
        left, right = np.flatnonzero((block == lo) & members), np.flatnonzero((block == hi) & members)
        out = []
        for i in left:
            js = right if lo != hi else right[ids[right] > ids[i]]
            small, large = np.minimum(size[js], size[i]), np.maximum(size[js], size[i])
            js = js[(comp[js] != comp[i]) & (100 * (small + 1) >= percent * large)]
            equal = sig[js] == sig[i]
            first = ~equal[:, :before].reshape(len(js), before // BAND_ROWS, BAND_ROWS).all(axis=2).any(axis=1)
            js = js[(equal.sum(axis=1) >= floor) & first]
            if not len(js):
                continue
            # How many of each one's hashes are in i's set, two collisions allowed.
            every = np.concatenate([half[j] for j in js])
            at = np.minimum(np.searchsorted(half[i], every), size[i] - 1)
            both = np.add.reduceat((half[i][at] == every).astype(np.int64), np.cumsum(size[js]) - size[js]) + 2
            js = js[100 * both >= percent * (size[js] + size[i] - both)]
            out += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in js]
        return pd.DataFrame(out, columns=["a", "b"])

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """compare for rows of equal (bucket, x, y), which follow each other."""
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            key = batch[["bucket", "x", "y"]].to_numpy()
            edge = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            if held and (held[-1][["bucket", "x", "y"]].to_numpy()[-1] != key[0]).any():
                yield compare(pd.concat(held, ignore_index=True))
                held = []
            if held and len(edge) > 2:
                yield compare(pd.concat([*held, batch[: edge[1]]], ignore_index=True))
                held, edge = [], edge[1:]
            done = [compare(batch[a:b]) for a, b in zip(edge[:-2], edge[1:-1], strict=True)]
            if done:
                yield pd.concat(done, ignore_index=True)
            held.append(batch[edge[-2] :])
        if held:
            yield compare(pd.concat(held, ignore_index=True))

    dealt = dealt.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return dealt.mapInPandas(groups, "a long, b long").distinct()


def near_duplicates(rows: DataFrame, percent: int = 85, width: int = 5, key: str = "doc_id", text: Column | None = None) -> DataFrame:
    """Components of rows linked by 100 * intersection >= percent * union of their shingle sets.

    Returns per row: doc_id, n_shingles, component_id (least id reachable, itself included), kept. key is an
    integer column. Words are lower-cased in A-Z; a row with fewer words than width is one shingle; null text and
    text without words have no shingle, link with nothing and are kept. Rows of equal id are one node, which any of
    their sets can link, and are kept together; rows of null id link with nothing, have no component and are kept; an empty table gives none; further columns
    are ignored.
    """
    folder = shared_dir(rows.sparkSession)
    text = text if text is not None else text_of(rows)
    floor = agreement_floor(percent / 100)
    signed = materialize(sign(rows, key, text, width).withColumnRenamed(key, "id"), folder, "signed")
    kind = signed.schema["id"].dataType
    signed = signed.withColumn("id", F.col("id").cast("long"))
    full = signed.filter("n_shingles > 0 and id is not null")
    repeated = full.groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("size")).filter("size > 1")
    repeated = materialize(repeated.select("set_key", "rep"), folder, "repeated")
    known = hot_join(full, repeated, "set_key", "id", "left")
    reps = known.filter("rep is null").unionByName(known.filter("id = rep").dropDuplicates(["set_key"]))
    reps = materialize(reps.select("id", "sig", "bands"), folder, "reps")

    members, star = _star_candidates(reps, floor, folder)
    star = materialize(star, folder, "star")
    linked = f"100 * both >= {int(percent)} * (size_a + size_b - both)"
    sets = materialize(_sets(rows, materialize(_ids(star), folder, "star-ids"), key, text, width), folder, "star-sets")
    first = materialize(_intersections(star, sets).filter(linked).select("a", "b"), folder, "links-1")
    component = connected_components(first, folder, "first").select(F.col("node").alias("id"), "component")
    mixed = materialize(_mixed_members(members, component, folder), folder, "mixed")
    final = component
    if not mixed.isEmpty():
        ids = materialize(mixed.select("id").distinct(), folder, "mixed-ids")
        sets = materialize(_sets(rows, ids, key, text, width), folder, "sets")
        rest = materialize(_rest_candidates(mixed, ids, reps, sets, floor, percent), folder, "rest")
        second = materialize(_intersections(rest, sets).filter(linked).select("a", "b"), folder, "links-2")
        if not second.isEmpty():
            final = connected_components(first.unionByName(second), folder, "final").select(F.col("node").alias("id"), "component")

    final = materialize(final, folder, "components")
    classes = repeated.join(final.withColumnRenamed("id", "rep"), "rep", "left")
    classes = materialize(classes.select("set_key", F.coalesce("component", "rep").alias("of_class")), folder, "classes")
    out = hot_join(signed.select("id", "n_shingles", "set_key"), classes, "set_key", "id", "left")
    out = out.join(bounded(final), "id", "left")
    found = F.when(F.col("id").isNotNull(), F.coalesce("of_class", "component", "id"))
    return out.select(F.col("id").cast(kind).alias(key), "n_shingles", found.alias("component_id"), F.col("id").eqNullSafe(found).alias("kept"))


ORACLE = r"""
WITH RECURSIVE
words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
        lambda i: array_to_string(w[i:i + 4], ' '))) AS s
    FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
near AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (
    SELECT a, b FROM near
    UNION SELECT r.doc_id, n.b FROM reached r JOIN near n ON r.other = n.a),
least AS (SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id,
    least(doc_id, coalesce(other, doc_id)) = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
