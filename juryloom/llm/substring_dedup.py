"""Removal of repeated byte strings: suffix arrays of shards, merged across shards by binary search.

Every string of WIDTH bytes has an anchor: its first substring of ANCHOR bytes of least hash. Equal strings have
equal anchors, so only runs of strings whose anchor occurs in several documents can repeat; these runs are dealt
to buckets by their anchor, where equal strings meet. A bucket's distinct runs are cut into shards of bounded
size; each gets a suffix array, whose common prefixes show the classes of equal strings and the least document of
each; classes of different shards are merged by binary search. What a chunk of documents sends is put together
first, so that a run that very many documents share reaches its bucket once from each chunk.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, shared_dir, text_of
from .suffix import common_prefixes, suffix_array

WIDTH, ANCHOR = 50, 20
#: Positions at which the anchor of a string can start.
SPAN = WIDTH - ANCHOR + 1
#: Bytes of a chunk of documents, each counted with DOC_BYTES more; a longer document is a chunk's only or last one.
CHUNK_BYTES, DOC_BYTES = 16_000_000, 64
#: Chunks of one partition that have numbers of their own; what follows goes to the last of them.
PARTITION_CHUNKS = 4_096
#: Stands for a null doc_id in comparisons: after all others.
LAST_ID = 2**63 - 1
#: Buckets of the table of chunks at most: each task that writes it makes a file for each bucket that it has.
MOST_BUCKETS = 65_536
#: Bytes of texts whose keys are found together.
BATCH_BYTES = 1 << 20
#: Characters of the corpus for each bucket.
BUCKET_CHARS = 4_000_000
#: Bytes of a shard.
SHARD_BYTES = 1_000_000
#: Anchors whose surroundings are looked at together.
ANCHOR_BLOCK = 16_384

_P = 0x9E3779B97F4A7C15


def _rolling(buf: np.ndarray) -> np.ndarray:
    """Hashes of all substrings of ANCHOR bytes, by doubling."""
    out, size, power = None, 0, _P
    part, part_size, part_power = buf.astype(np.uint64) + np.uint64(1), 1, _P
    for bit in range(ANCHOR.bit_length()):
        if ANCHOR >> bit & 1:
            if out is None:
                out, size = part, part_size
            else:
                n = len(part) - size
                out = out[:n] * np.uint64(part_power) + part[size:]
                size += part_size
        n = len(part) - part_size
        part = part[:n] * np.uint64(part_power) + part[part_size:]
        part_size *= 2
        part_power = part_power * part_power & (2**64 - 1)
    return mix64(out[: len(buf) - ANCHOR + 1])


def _slide(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = best(values[:-size], values[size:])
        size *= 2
    return best(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def anchors(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all positions, positions that have the least hash of some string)."""
    if len(buf) < WIDTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x = _rolling(buf)
    edge = np.zeros(SPAN - 1, np.uint64)
    least = _slide(np.concatenate([edge, _slide(x, SPAN, np.minimum), edge]), SPAN, np.maximum)
    return x, np.flatnonzero(least == x)


def anchor_runs(x: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last starts of the strings whose anchor each of the positions is (last < first: none)."""
    around = np.concatenate([np.full(SPAN, 2**64 - 1, np.uint64), x, np.full(SPAN, 2**64 - 1, np.uint64)])
    windows = np.lib.stride_tricks.sliding_window_view(around, 2 * SPAN + 1)
    back, ahead = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    for i in range(0, len(at), ANCHOR_BLOCK):
        some = slice(i, i + ANCHOR_BLOCK)
        view, own = windows[at[some]], x[at[some]][:, None]
        earlier = view[:, 1:SPAN] <= own  # positions at - (SPAN - 1) ... at - 1
        back[some] = np.where(earlier.any(axis=1), np.argmax(earlier[:, ::-1], axis=1), SPAN - 1)
        later = view[:, SPAN + 1 : 2 * SPAN] < own  # positions at + 1 ... at + SPAN - 1
        ahead[some] = np.where(later.any(axis=1), np.argmax(later, axis=1), SPAN - 1)
    return np.maximum(at - back, 0), np.minimum(at - (SPAN - 1) + ahead, n - WIDTH)


def parts_by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its entries), for the buckets that occur."""
    order = np.argsort(bucket, kind="stable")
    present, start = np.unique(bucket[order], return_index=True)
    for b, own in zip(present.tolist(), np.split(order, start[1:]), strict=True):
        yield b, own


def anchor_keys(texts: list[bytes]) -> list[np.ndarray]:
    found = (anchors(np.frombuffer(t, np.uint8)) for t in texts)
    return [np.unique(x[at]) for x, at in found]


def in_batches(texts: Iterable[str]) -> Iterator[list[bytes]]:
    """Runs of texts, as bytes, of BATCH_BYTES or one text."""
    batch, size = [], 0
    for text in texts:
        data = text.encode("utf-8")
        batch.append(data)
        size += len(data)
        if size >= BATCH_BYTES:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def code_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Keys as they are compared: the bucket, and 32 bits within it, which tell a bucket's keys apart at any size of the
    corpus, as buckets are bounded. A chance agreement makes a needless candidate, no wrong result."""
    rest = keys - keys // np.uint64(buckets) * np.uint64(buckets)  # faster than %
    return rest << np.uint64(32) | keys >> np.uint64(32)


_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack_sorted(values: np.ndarray) -> bytes:
    """Rising 32-bit numbers: their differences, byte by byte."""
    steps = np.diff(values, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4)
    return _PACK.compress(np.ascontiguousarray(steps.T).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    steps = np.frombuffer(_UNPACK.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(steps.T).view("<u4").ravel(), dtype=np.uint32)


def chunked_keys(buckets: int, keys_of: Callable[[list[bytes]], list[np.ndarray]]):
    """Per chunk and bucket: the keys, and those that several of keys_of's arrays, or one of them repeatedly, have."""

    def rows(chunk: int, found: list[np.ndarray]) -> pd.DataFrame:
        every, n = np.unique(code_of(np.concatenate(found), buckets), return_counts=True)
        bucket, short = (every >> np.uint64(32)).astype(np.int64), every.astype(np.uint32)
        out = [(chunk, b, pack_sorted(short[own]), pack_sorted(short[own][n[own] > 1])) for b, own in parts_by_bucket(bucket)]
        return pd.DataFrame(out, columns=["chunk", "bucket", "hashes", "repeated"])

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, found = None, []
        for batch in batches:
            for chunk, part in batch.groupby("chunk", sort=False):
                if chunk != current and found:
                    yield rows(current, found)
                    found = []
                current = chunk
                for texts in in_batches(part["text"]):
                    found += [k for k in keys_of(texts) if len(k)]
        if found:
            yield rows(current, found)

    return find


def shared_keys(group: pd.DataFrame) -> pd.DataFrame:
    """Which keys of a bucket occur several times, told to each chunk that has them."""
    parts = [unpack_sorted(h) for h in group["hashes"]]
    repeated = [unpack_sorted(h) for h in group["repeated"]]
    every, n = np.unique(np.concatenate([*parts, *repeated]), return_counts=True)
    shared = every[n > 1]
    out = []
    for chunk, bucket, part in zip(group["chunk"], group["bucket"], parts, strict=True):
        at = np.minimum(np.searchsorted(shared, part), max(0, len(shared) - 1))
        mine = part[shared[at] == part] if len(shared) else part[:0]
        if len(mine):
            out.append((chunk, bucket, pack_sorted(mine)))
    return pd.DataFrame(out, columns=["chunk", "bucket", "shared"])


def shared_codes(info: pd.DataFrame) -> np.ndarray:
    """The shared keys that a chunk was told, in order."""
    parts = [np.uint64(b) << np.uint64(32) | unpack_sorted(s).astype(np.uint64) for b, s in zip(info["bucket"], info["shared"], strict=True)]
    return np.sort(np.concatenate(parts))


def code_cells(shared: np.ndarray) -> tuple[np.uint64, np.ndarray]:
    """A shift, and for each value of shifted codes the place in shared of the first code that is not below it."""
    shift = max(0, int(shared[-1]).bit_length() - len(shared).bit_length() - 1)
    cell = (shared >> np.uint64(shift)).astype(np.int64)
    return np.uint64(shift), np.append(0, np.cumsum(np.bincount(cell)))


def are_shared(keys: np.ndarray, shared: np.ndarray, buckets: int, cells: tuple[np.uint64, np.ndarray] | None = None) -> np.ndarray:
    codes = code_of(keys, buckets)
    if cells is None:
        return shared[np.minimum(np.searchsorted(shared, codes), len(shared) - 1)] == codes
    shift, start = cells
    last = len(shared) - 1
    at = np.minimum(start[np.minimum((codes >> shift).astype(np.int64), len(start) - 1)], last)
    found = shared[at]
    below = np.flatnonzero(found < codes)
    while len(below):  # on to the next code of the cell
        step = np.minimum(at[below] + 1, last)
        at[below] = step
        found[below] = shared[step]
        below = below[(shared[step] < codes[below]) & (step < last)]
    return found == codes


def shared_by_chunk(rows: DataFrame, buckets: int, keys_of: Callable[[list[bytes]], list[np.ndarray]]) -> DataFrame:
    """(chunk, bucket, shared): the keys of each chunk that occur several times; rows as by_chunk gives."""
    ddl = "chunk long, bucket int, hashes binary, repeated binary"
    found = rows.select("chunk", "text").mapInPandas(chunked_keys(buckets, keys_of), ddl)
    return found.groupBy("bucket").applyInPandas(shared_keys, "chunk long, bucket int, shared binary")


def _collect_runs(buckets: int):
    """A chunk's distinct runs, by bucket, and where each occurs."""

    def collect(docs: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        cols = ["chunk", "bucket", "runs", "sizes", "least", "row", "at", "run"]
        if not len(docs) or not len(info):
            return pd.DataFrame([], columns=cols)
        docs = docs.sort_values("row", ignore_index=True)
        shared = shared_codes(info)
        known: dict[bytes, int] = {}
        least: list[int] = []
        bucket: list[int] = []
        row_of, at_of, run_of = [], [], []
        for row, doc_id, text in zip(docs["row"], docs["doc_id"], docs["text"], strict=True):
            data = text.encode("utf-8")
            x, at = anchors(np.frombuffer(data, np.uint8))
            if not len(at):
                continue
            h = x[at]
            at = at[are_shared(h, shared, buckets)]
            if not len(at):
                continue
            lo, hi = anchor_runs(x, at, len(data))
            on = hi >= lo
            at, lo, hi = at[on], lo[on], hi[on]
            ids = []
            for a, b, k in zip(lo.tolist(), (hi + WIDTH).tolist(), (x[at] % np.uint64(buckets)).tolist(), strict=True):
                string = data[a:b]
                i = known.setdefault(string, len(least))
                if i == len(least):
                    least.append(doc_id)
                    bucket.append(k)
                elif doc_id < least[i]:
                    least[i] = doc_id
                ids.append(i)
            row_of.append(np.full(len(ids), row))
            at_of.append(lo)
            run_of.append(np.array(ids))
        if not least:
            return pd.DataFrame([], columns=cols)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        strings, least_of = list(known), np.array(least, np.int64)
        chunk = docs["chunk"].iat[0]
        out = []
        for b, own in parts_by_bucket(np.array(bucket)):
            some = [strings[i] for i in own]
            sizes = np.array([len(s) for s in some], np.uint8)
            out.append((chunk, b, b"".join(some), sizes.tobytes(), least_of[own].tobytes(), None, None, None))
        places = (np.concatenate(row_of), np.concatenate(at_of).astype(np.int64), place[np.concatenate(run_of)])
        out.append((chunk, -1, None, None, None, *(x.astype(np.int64).tobytes() for x in places)))
        return pd.DataFrame(out, columns=cols)

    return collect


def least_documents(runs: list[bytes], least: np.ndarray, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each run and each string in it: the least document that has this string in any of the runs.

    Runs are distinct. Shards of at most shard_bytes have a suffix array each; classes of equal strings that lie in
    several shards are found by binary search in the shards' sorted class lists.
    """
    shards, size = [[]], 0
    for i, r in enumerate(runs):
        if size + len(r) > shard_bytes and shards[-1]:
            shards.append([])
            size = 0
        shards[-1].append(i)
        size += len(r)
    solved = []
    for own in shards:
        text = np.frombuffer(b"".join(runs[i] for i in own), np.uint8)
        sizes = np.array([len(runs[i]) for i in own])
        starts = np.cumsum(sizes) - sizes
        steps = sizes - WIDTH + 1
        order = suffix_array(text)
        prefix = common_prefixes(text, order, starts, steps, WIDTH)
        string = np.zeros(len(text), bool)
        at = np.repeat(starts - (np.cumsum(steps) - steps), steps) + np.arange(steps.sum())
        string[at] = True
        # Suffixes that start no string of a run lie between; a class goes on over them if both sides agree.
        slots = np.flatnonzero(string[order])
        here = order[slots]
        new = np.ones(len(slots), bool)
        near = np.flatnonzero(slots[1:] == slots[:-1] + 1) + 1
        new[near] = prefix[slots[near]] < WIDTH
        far = np.setdiff1d(np.arange(1, len(slots)), near, assume_unique=True)
        if len(far):
            window = np.arange(WIDTH)
            new[far] = (text[here[far][:, None] + window] != text[here[far - 1][:, None] + window]).any(axis=1)
        kind = np.cumsum(new) - 1
        doc = np.repeat(least[own], steps)
        of = np.empty(len(text), np.int64)
        of[at] = np.arange(len(at))
        best = np.full(kind[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(best, kind, doc[of[here]])
        solved.append((own, steps, at, of, here, kind, best, text, here[new]))
    if len(solved) > 1:
        keys = []
        for *_, text, first in solved:
            block = np.full((len(first), WIDTH + 1), 1, np.uint8)  # the last byte keeps trailing zeros significant
            block[:, :WIDTH] = text[first[:, None] + np.arange(WIDTH)]
            keys.append(np.ascontiguousarray(block).view(f"S{WIDTH + 1}").ravel())
        merged = [s[6].copy() for s in solved]
        for a in range(len(solved)):
            for b in range(len(solved)):
                if a != b:
                    found = np.minimum(np.searchsorted(keys[b], keys[a]), len(keys[b]) - 1)
                    same = keys[b][found] == keys[a]
                    merged[a][same] = np.minimum(merged[a][same], solved[b][6][found[same]])
    else:
        merged = [solved[0][6]]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(runs)
    for (own, steps, at, of, here, kind, *_), best in zip(solved, merged, strict=True):
        value = np.empty(len(at), np.int64)
        value[of[here]] = best[kind]
        for i, part in zip(own, np.split(value, np.cumsum(steps)[:-1]), strict=True):
            out[i] = part
    return out


def _solve_bucket(group: pd.DataFrame) -> pd.DataFrame:
    """Answer every chunk: for each of its runs, from which string on the least document is which."""
    known: dict[bytes, int] = {}
    least: list[int] = []
    asked = []
    for runs, sizes, docs in zip(group["runs"], group["sizes"], group["least"], strict=True):
        size = np.frombuffer(sizes, np.uint8).astype(np.int64)
        end = np.cumsum(size)
        ids = np.empty(len(size), np.int64)
        for j, (a, b, doc) in enumerate(zip((end - size).tolist(), end.tolist(), np.frombuffer(docs, np.int64).tolist(), strict=True)):
            i = known.setdefault(runs[a:b], len(least))
            if i == len(least):
                least.append(doc)
            elif doc < least[i]:
                least[i] = doc
            ids[j] = i
        asked.append(ids)
    values = least_documents(list(known), np.array(least, np.int64))
    size = np.array([len(v) for v in values])
    start = np.cumsum(size) - size
    flat = np.concatenate(values)
    change = np.ones(len(flat), bool)
    change[1:] = flat[1:] != flat[:-1]
    change[start] = True
    which = np.flatnonzero(change)
    owner = np.repeat(np.arange(len(values)), size)[which]
    first = np.searchsorted(owner, np.arange(len(values) + 1))
    out = []
    for chunk, bucket, ids in zip(group["chunk"], group["bucket"], asked, strict=True):
        n = first[ids + 1] - first[ids]
        pick = np.repeat(first[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        offset = which[pick] - start[owner[pick]]
        out.append((chunk, bucket, n.astype(np.uint8).tobytes(), offset.astype(np.uint8).tobytes(), flat[which[pick]].tobytes()))
    return pd.DataFrame(out, columns=["chunk", "bucket", "pieces", "offsets", "docs"])


def _spans(doc_id: int, at: np.ndarray, run: np.ndarray, size: np.ndarray, first: np.ndarray, offset: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Mask of the bytes that strings of smaller documents cover."""
    pieces = first[run + 1] - first[run]
    pick = np.repeat(first[run] - (np.cumsum(pieces) - pieces), pieces) + np.arange(pieces.sum())
    owner = np.repeat(np.arange(len(run)), pieces)
    begin = at[owner] + offset[pick]
    last = np.append(owner[1:] != owner[:-1], True)
    end = np.where(last, (at + size[run])[owner], np.append(begin[1:], 0))
    gone = doc[pick] < doc_id
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begin[gone], 1)
    np.add.at(edge, np.minimum(end[gone] - 1 + WIDTH, n), -1)
    return np.cumsum(edge)[:n] > 0


def _remove(docs: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    by: dict[int, tuple[int, int]] = {}
    if len(info):
        answers = info[info["row"].isna()].sort_values("bucket")
        places = info[info["row"].notna()]

        def joined(name: str, kind: type) -> np.ndarray:
            return np.concatenate([np.frombuffer(x, kind) for x in answers[name]]).astype(np.int64)

        pieces, offset, least = joined("pieces", np.uint8), joined("offsets", np.uint8), joined("docs", np.int64)
        size = joined("sizes", np.uint8) - WIDTH + 1
        first = np.append(0, np.cumsum(pieces))
        row, at, run = (np.frombuffer(places[c].iat[0], np.int64) for c in ("row", "at", "run"))
        order = np.argsort(row, kind="stable")
        row, at, run = row[order], at[order], run[order]
        rows, begin = np.unique(row, return_index=True)
        by = {r: (a, b) for r, a, b in zip(rows.tolist(), begin.tolist(), [*begin[1:].tolist(), len(row)], strict=True)}
    out = []
    for r, doc_id, text in zip(docs["row"], docs["doc_id"], docs["text"], strict=True):
        data = text.encode("utf-8")
        removed = spans = 0
        if r in by:
            a, b = by[r]
            gone = _spans(doc_id, at[a:b], run[a:b], size, first, offset, least, len(data))
            removed = int(gone.sum())
            if removed:
                spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
                data_kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((doc_id, len(data), removed, spans, hashlib.sha256(data_kept).hexdigest()))
                continue
        out.append((doc_id, len(data), removed, spans, hashlib.sha256(data).hexdigest()))
    return pd.DataFrame(out, columns=cols)


def chunk_numbers(size: Column) -> Column:
    """A chunk's number for each row of a partition, in order, from the bytes before it; texts stay out of Python."""

    @F.pandas_udf("long")
    def number(sizes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        total, first = 0, TaskContext.get().partitionId() * PARTITION_CHUNKS
        for some in sizes:
            before = total + some.cumsum() - some
            total += int(some.sum())
            yield first + (before // CHUNK_BYTES).clip(upper=PARTITION_CHUNKS - 1)

    return number(size)


def by_chunk(docs: DataFrame, folder: str) -> DataFrame:
    """Rows (chunk, row, doc_id, text) in a table bucketed by chunk, so that joins by chunk do not move texts.

    Null texts are empty ones; a null doc_id is LAST_ID. There are as many buckets as the texts have chunks, but for
    the session's shuffle partitions at least. The table is in the shared folder.
    """
    text = text_of(docs)
    doc_id = F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST_ID))
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select(chunk_numbers(F.octet_length("text").cast("long") + DOC_BYTES).alias("chunk"), "row", "doc_id", "text")
    spark = docs.sparkSession
    name = f"juryloom_chunks_{uuid.uuid4().hex}"
    size = docs.agg(F.sum(F.octet_length(text) + F.lit(DOC_BYTES))).first()[0] or 0
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, math.ceil(size / CHUNK_BYTES)))
    writer = rows.write.bucketBy(buckets, "chunk").sortBy("chunk").option("path", f"{folder}/chunks").option("compression", "zstd")
    writer.saveAsTable(name)
    return spark.table(name)


def key_buckets(rows: DataFrame) -> int:
    return max(1, math.ceil((rows.agg(F.sum(F.length("text"))).first()[0] or 0) / BUCKET_CHARS))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Take from each document the bytes that a 50-byte string covers which starts in a document of smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed stretches), kept_sha256. Strings are those of the
    input; repeats within a document or between rows of equal doc_id stay. A null doc_id is larger than all others.
    Null and empty texts have no bytes; texts under 50 bytes are kept whole; an empty table gives none; further
    columns are ignored.
    """
    folder = shared_dir(docs.sparkSession)
    rows = by_chunk(docs, folder)
    buckets = key_buckets(rows)
    shared = shared_by_chunk(rows, buckets, anchor_keys)
    ddl = "chunk long, bucket int, runs binary, sizes binary, least binary, row binary, at binary, run binary"
    runs = rows.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInPandas(_collect_runs(buckets), ddl)
    runs = materialize(runs, folder, "runs")
    asked = runs.filter("bucket >= 0").select("chunk", "bucket", "runs", "sizes", "least")
    answers = asked.groupBy("bucket").applyInPandas(_solve_bucket, "chunk long, bucket int, pieces binary, offsets binary, docs binary")
    info = runs.filter("bucket >= 0").select("chunk", "bucket", "sizes").join(answers, ["chunk", "bucket"])
    info = info.unionByName(runs.filter("bucket < 0").select("chunk", "bucket", "row", "at", "run"), allowMissingColumns=True)
    info = info.select("chunk", "bucket", "sizes", "pieces", "offsets", "docs", "row", "at", "run")
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    out = rows.groupBy("chunk").cogroup(info.groupBy("chunk")).applyInPandas(_remove, ddl)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")))


ORACLE = r"""
WITH
bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (
    SELECT doc_id, base, substr(h, 2 * base + 1, 1098) AS p
    FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49, 500)) AS base FROM bytes)),
starts AS (
    SELECT doc_id, base + k AS i, substr(p, 2 * k + 1, 100) AS s
    FROM (SELECT doc_id, base, p, unnest(range(0, len(p) // 2 - 49)) AS k FROM pieces)),
firsts AS (SELECT s, min(doc_id) AS first FROM starts GROUP BY s HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, i FROM starts JOIN firsts USING (s) WHERE first < doc_id),
marked AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS fresh FROM hits),
numbered AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked),
spans AS (SELECT doc_id, span, min(i) AS start, max(i) + 50 AS stop FROM numbered GROUP BY ALL),
edges AS (
    SELECT doc_id, sum(stop - start) AS removed, count(*) AS spans,
        list_concat(list(start ORDER BY start), [1099511627776]) AS starts, list_concat([0], list(stop ORDER BY start)) AS stops
    FROM spans GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
    sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE array_to_string(list_transform(range(1, spans + 2),
        lambda k: substr(h, 2 * stops[k] + 1, 2 * (least(starts[k], len(h) // 2) - stops[k]))), '') END)) AS kept_sha256
FROM bytes LEFT JOIN edges USING (doc_id)
"""
