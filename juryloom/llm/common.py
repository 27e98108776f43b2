"""What the corpus operators share: shared storage, document columns, splits and byte-level word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Character class of the word separators: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    The session's own setting is read. Where it is unset, a local session gets a folder of its own; on a cluster
    that is an error, since no other folder is known to be shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/juryloom-{uuid.uuid4().hex}"


def materialize(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{folder}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(docs["text"], F.lit(""))


def through_python(rows: DataFrame, key: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run(rows), a Python stage, with the column key as text on its way: pandas would round wide ids beside a null."""
    kind = rows.schema[key].dataType
    done = run(rows.withColumn(key, F.col(key).cast("string")))
    return done.withColumn(key, F.col(key).cast(kind))


def crc_fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id written as text, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


#: Rows up to which a written table is broadcast; the tables concerned have rows of some hundred bytes at most.
BROADCAST_ROWS = 50_000
#: Parts over which the rows of one key are dealt in a salted join.
SALTS = 128


def bounded(written: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, broadcast if it is counted to have few rows; else a join with it shuffles."""
    return F.broadcast(written) if written.count() <= rows else written


def hot_join(rows: DataFrame, written: DataFrame, key: str, by: str, how: str = "inner", few: int = BROADCAST_ROWS) -> DataFrame:
    """rows joined (inner or left) with a written table that has one row at most for each key, though one key may
    have any share of rows.

    A table of few rows is broadcast. Beyond that a key's rows are dealt over salts by the column by, and the
    table's row goes to those salts alone that the key has.
    """
    if written.count() <= few:
        return rows.join(F.broadcast(written), key, how)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    wanted = salted.select(key, "__salt").distinct().join(written, key)
    return salted.join(wanted, [key, "__salt"], how).drop("__salt")


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of a text that are hashed at once: what is made of them fits a core's cache.
PIECE_BYTES = 1 << 16
#: Words up to which a hash is one polynomial.
_BLOCK = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(PIECE_BYTES + _BLOCK, _BASE, dtype=np.uint64), dtype=np.uint64)
    _INVERSE = np.cumprod(np.append(np.uint64(1), np.full(PIECE_BYTES + _BLOCK, _BACK, dtype=np.uint64)), dtype=np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all input bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def is_space(buf: np.ndarray) -> np.ndarray:
    return ((buf - np.uint8(9)) < 5) | (buf == 32)


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-separator bytes."""
    word = np.zeros(len(buf) + 2, dtype=bool)
    np.logical_not(is_space(buf), out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[0::2], edge[1::2]


def _piece_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, end = word_spans(buf)
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    size = end - start
    if size.max() > _BLOCK or len(buf) > len(_POWERS):
        sums = _long_sums(buf, start)
    else:  # a word's polynomial is the difference of two sums from the piece's start, moved to the word's
        total = np.zeros(len(buf) + 1, np.uint64)
        np.add(buf, np.uint64(1), out=total[1:], casting="unsafe", dtype=np.uint64)
        total[1:] *= _POWERS[: len(buf)]
        np.cumsum(total, out=total)
        sums = (total[end] - total[start]) * _INVERSE[start]
    return mix64(sums ^ (size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), start, end


def _long_sums(buf: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of words of any length: polynomials of blocks, with the block's number folded in from the second on, so that
    very long words still differ by position."""
    at = np.arange(len(buf), dtype=np.int64)
    first = np.zeros(len(buf), dtype=np.int64)
    first[start] = start
    offset = at - np.maximum.accumulate(first)
    terms = (buf.astype(np.uint64) + np.uint64(1)) * _POWERS[offset & (_BLOCK - 1)]
    space = is_space(buf)
    terms[space] = 0
    block = (offset >> 12).astype(np.uint64)
    terms = np.where(block > 0, mix64(terms + block), terms)
    terms[space] = 0
    return np.add.reduceat(terms, start)


def word_hashes(data: bytes, piece: int = PIECE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of UTF-8 data, A-Z lower-cased. Hashes depend on the bytes alone.

    Long data is worked on in pieces that end between words, so that memory beside the result stays small.
    """
    buf = np.frombuffer(data.translate(_LOWER), dtype=np.uint8)
    if len(buf) <= piece:
        return _piece_hashes(buf)
    found, begin = [], 0
    while begin < len(buf):
        end = min(begin + piece, len(buf))
        while end < len(buf):  # on to the next separator
            space = np.flatnonzero(is_space(buf[end : end + piece]))
            end += int(space[0]) if len(space) else piece
            if len(space):
                break
        end = min(end, len(buf))
        h, first, last = _piece_hashes(buf[begin:end])
        found.append((h, first + begin, last + begin))
        begin = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


#: Bytes of texts that are hashed together.
TOGETHER_BYTES = 1 << 18


def hashed_texts(texts: Iterable[bytes], more: Callable[[np.ndarray], np.ndarray] = lambda words: words) -> Iterator[tuple]:
    """Each text with what word_hashes gives for it, and with what more makes, from all words on, of its words; short
    texts are hashed together."""

    def found(held: list[bytes]) -> Iterator[tuple]:
        words, first, last = word_hashes(b"\n".join(held))
        made = more(words)
        at = np.cumsum([0, *(len(x) + 1 for x in held)])
        edge = np.searchsorted(first, at).tolist()
        for data, a, b, start in zip(held, edge, edge[1:], at.tolist(), strict=False):
            yield data, words[a:b], first[a:b] - start, last[a:b] - start, made[a:b]

    held, size = [], 0
    for data in texts:
        held.append(data)
        size += len(data)
        if size >= TOGETHER_BYTES:
            yield from found(held)
            held, size = [], 0
    if held:
        yield from found(held)


def cut_up(data: bytes, size: np.ndarray) -> list[bytes]:
    end = np.cumsum(size)
    return [data[a:b] for a, b in zip((end - size).tolist(), end.tolist(), strict=True)]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted and distinct."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def shingle_set(data: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; with fewer words the whole sequence is one shingle."""
    words = word_hashes(data)[0]
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(width, n)
    total = np.zeros(n - width + 1, dtype=np.uint64)
    for i in range(width):
        total = mix64(total ^ words[i : n - width + 1 + i])
    return np.unique(total ^ np.uint64(width))
