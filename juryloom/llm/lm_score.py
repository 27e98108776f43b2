"""Language-model scores of whole documents: word counts of all training text and a gated recurrent model.

The recurrent model predicts the words of a shortlist, in classes, and for any other word its class by ending;
such a word's probability within its class comes from the counts, which cover every training document. Frequent
counts (at most FREQUENT words) go to every task; the words beyond them are looked up by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import crc_fold, cut_up, materialize, shared_dir, text_of, through_python, word_hashes
from .substring_dedup import in_batches

#: Bound of the words whose counts every task holds (12 bytes each).
FREQUENT = 1 << 18
#: Tokens that a task trains on or scores at once.
CHUNK_TOKENS = 1_500_000
#: Tokens and documents at most of the first, common steps of training, before the parts train on their own.
WARM_TOKENS, WARM_DOCS = 300_000, 1_000
#: Training tokens of a part. Rows are dealt over parts by their content, so scores do not hang on the input's layout.
PART_TOKENS = 4_000_000
#: Parts whose parameters are averaged in one group, before the groups are, level by level.
MEAN_PARTS = 32
#: Words counted at once.
COUNT_CHUNK = 2_000_000
END = np.uint64(0x0E0D)
_BLOCKS = 16


def held_out(doc_id: Column) -> Column:
    return crc_fold(doc_id) == 1


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and tail classes of the words of texts, with an end after each text's, and how many each text has."""
    joined = b"\n".join(texts)
    words, first, end = word_hashes(joined)
    last = np.frombuffer(joined, np.uint8)[end - 1].astype(np.int64)
    low = np.where((last >= 65) & (last <= 90), last + 32, last)
    mixed = (low * 2654435761 >> 7) % gru.TAIL_CLASSES
    stop = np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts]))
    return np.insert(words, stop, END), np.insert(mixed, stop, 0).astype(np.uint8), np.diff(stop, prepend=0) + 1


def count_words(rows: DataFrame) -> DataFrame:
    """(word, tail, n) over all rows' texts; word is a 64-bit hash."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def summed() -> pd.DataFrame:
            words, tails = (np.concatenate(x) for x in zip(*held, strict=True))
            word, first, n = np.unique(words, return_index=True, return_counts=True)
            return pd.DataFrame({"word": word.astype(np.int64), "tail": tails[first].astype(np.int32), "n": n})

        for batch in batches:
            for texts in in_batches(batch["text"]):
                held.append(hashed(texts)[:2])
                size += len(held[-1][0])
                if size >= COUNT_CHUNK:
                    yield summed()
                    held, size = [], 0
        if held:
            yield summed()

    parts = rows.mapInPandas(count, "word long, tail int, n long")
    return parts.groupBy("word").agg(F.first("tail").alias("tail"), F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """What every task knows of the counts: totals, the frequent words and the shortlist."""

    tokens: int
    types: int
    word: np.ndarray  # frequent words, sorted
    n: np.ndarray
    rank: np.ndarray  # their place on the shortlist, or -1
    tail_weight: np.ndarray  # denominator of each tail class
    shares: np.ndarray

    def split(self, words: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(model tokens, counts with -1 where the word is not frequent, which are tail words)."""
        at = np.minimum(np.searchsorted(self.word, words), max(0, len(self.word) - 1))
        found = self.word[at] == words if len(self.word) else np.zeros(len(words), bool)
        rank = np.where(found, self.rank[at], -1) if len(self.word) else np.full(len(words), -1)
        n = np.where(found, self.n[at], -1) if len(self.word) else np.full(len(words), -1)
        return np.where(rank >= 0, rank, gru.SHORTLIST + tails.astype(np.int64)).astype(np.uint16), n, rank < 0

    @property
    def base_weight(self) -> float:
        return self.tokens + 0.5 * (self.types + 1)


def vocabulary(counts: DataFrame, frequent: int = FREQUENT) -> tuple[Vocabulary, int]:
    """The vocabulary, and the least count of its frequent words."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    levels = sorted((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect())
    least, room = None, frequent
    for k, n in reversed(levels):  # a level is 1/16 of a doubling: a thousand levels at most
        room -= n
        if room < 0:
            break
        least = k
    keep = counts.filter(level >= (least if least is not None else 1 << 20)).toArrow()  # at most `frequent` rows
    word = keep["word"].to_numpy().astype(np.uint64)
    n, tail = keep["n"].to_numpy(), keep["tail"].to_numpy()
    order = np.argsort(word)
    word, n, tail = word[order], n[order], tail[order]
    rank = np.full(len(word), -1, np.int64)
    top = np.lexsort((word, -n, word != END))[: gru.SHORTLIST]
    top = top[np.lexsort((word[top], -n[top]))]
    rank[top] = np.arange(len(top))
    sums = {r["tail"]: (r["n"], r["v"]) for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    tail_n = np.array([sums.get(t, (0, 0))[0] for t in range(gru.TAIL_CLASSES)], float) - np.bincount(tail[top], n[top], gru.TAIL_CLASSES)
    tail_v = np.array([sums.get(t, (0, 0))[1] for t in range(gru.TAIL_CLASSES)], float) - np.bincount(tail[top], minlength=gru.TAIL_CLASSES)
    tokens, types = sum(x[0] for x in sums.values()), sum(x[1] for x in sums.values())
    shares = np.zeros(gru.TOKENS)
    shares[: len(top)] = n[top]
    shares[gru.SHORTLIST :] = tail_n + 0.5
    weight = tail_n + 0.5 * (tail_v + 1)
    return Vocabulary(tokens, types, word, n, rank, weight, shares / shares.sum()), 0 if least is None else least


def index(rows: DataFrame, known: Vocabulary) -> DataFrame:
    """Per row: model tokens, sums over frequent words, and the words that have to be looked up."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for texts in in_batches(batch["text"]):
                words, tails, size = hashed(texts)
                ids, n, tail = known.split(words, tails)
                common = n >= 0
                log = np.where(common, np.log10(np.where(common, n, 0) + 0.5), 0.0)
                within = np.where(tail, log - np.log10(known.tail_weight)[tails], 0.0)
                begin = np.cumsum(size) - size
                sums = [np.add.reduceat(x, begin).tolist() for x in (common.astype(np.int64), log, within)]
                rare, n_rare = words[~common].astype(np.int64), size - np.add.reduceat(common.astype(np.int64), begin)
                out += zip(size.tolist(), *sums, cut_up(ids.tobytes(), 2 * size), cut_up(rare.tobytes(), 8 * n_rare), strict=True)
            cols = ["n_tokens", "n_common", "log_common", "log_within", "ids", "rare"]
            yield pd.concat([batch.drop(columns="text"), pd.DataFrame(out, columns=cols, index=batch.index)], axis=1)

    ddl = "row long, doc_id string, held_out boolean, n_tokens long, n_common long, log_common double, log_within double, ids binary, rare binary"
    return through_python(rows.select("row", "doc_id", "held_out", "text"), "doc_id", lambda r: r.mapInPandas(one, ddl))


def _chunks(batches: Iterator[pd.DataFrame], tokens: int = CHUNK_TOKENS) -> Iterator[tuple[list, list[np.ndarray]]]:
    rows: list = []
    docs: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for row, ids in zip(batch["row"], batch["ids"], strict=True):
            rows.append(row)
            docs.append(np.frombuffer(ids, np.uint16).astype(np.int32))
            size += len(docs[-1])
            if size >= tokens:
                yield rows, docs
                rows, docs, size = [], [], 0
    if rows:
        yield rows, docs


def _mean(models: DataFrame, span: int) -> DataFrame:
    """(block, source, weight, flat) averaged, by weight and in the order of source, over each span of sources."""

    def mean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, weight, total = None, 0.0, np.zeros(0)

        def done() -> pd.DataFrame:
            return pd.DataFrame({"block": [key[0]], "source": [key[1]], "weight": [weight], "flat": [(total / weight).tobytes()]})

        for batch in batches:
            for block, group, w, flat in zip(batch["block"], batch["group"], batch["weight"], batch["flat"], strict=True):
                if (block, group) != key:
                    if key is not None:
                        yield done()
                    key, weight, total = (block, group), 0.0, np.zeros(len(flat) // 8)
                weight += w
                total = total + w * np.frombuffer(flat)
        if key is not None:
            yield done()

    grouped = models.withColumn("group", F.floor(F.col("source") / span))
    ordered = grouped.repartition("block", "group").sortWithinPartitions("block", "group", "source")
    return ordered.mapInPandas(mean, "block int, source long, weight double, flat binary")


def train(indexed: DataFrame, shares: np.ndarray, tokens: int, part_tokens: int = PART_TOKENS) -> gru.Params:
    """Train on every row: common first steps on a bounded part, then a pass of each part, then the parts' mean.

    Rows are dealt over parts, and ordered within them, by a hash of id and tokens; tokens, the number of them, fixes
    the number of parts. Means are formed by blocks of the parameter vector; only that vector comes to the driver.
    """
    start = gru.fresh(shares)
    rows = indexed.select(F.xxhash64("doc_id", "ids").alias("row"), "ids")

    def warm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = gru.Trainer(start)
        _, docs = next(_chunks(batches, WARM_TOKENS), ([], []))
        for _ in range(2):
            model.train(docs)
        yield pd.DataFrame({"flat": [gru.pack(model.p).tobytes()]})

    first = rows.orderBy("row").limit(WARM_DOCS).coalesce(1).sortWithinPartitions("row").mapInPandas(warm, "flat binary").first()
    shared = gru.unpack(np.frombuffer(first["flat"], np.float32), start) if first else start

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = gru.Trainer(shared)
        for _, docs in _chunks(batches):
            model.train(docs)
        if model.tokens:
            blocks = [x.astype(np.float64).tobytes() for x in np.array_split(gru.pack(model.p), _BLOCKS)]
            yield pd.DataFrame({"block": range(_BLOCKS), "source": TaskContext.get().partitionId(), "weight": float(model.tokens), "flat": blocks})

    parts = max(1, -(-tokens // part_tokens))
    models = rows.repartition(parts, "row").sortWithinPartitions("row").mapInPandas(local, "block int, source long, weight double, flat binary")
    models = _mean(models, MEAN_PARTS)
    while (parts := -(-parts // MEAN_PARTS)) > MEAN_PARTS:
        models = _mean(models, MEAN_PARTS)
    got = _mean(models, 1 << 40).collect()  # one vector
    if not got:
        return shared
    return gru.unpack(np.concatenate([np.frombuffer(r["flat"]) for r in sorted(got, key=lambda r: r["block"])]), start)


def score(indexed: DataFrame, params: gru.Params) -> DataFrame:
    """(row, log_model): log10 of the model's share of the probability."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, docs in _chunks(batches):
            yield pd.DataFrame({"row": rows, "log_model": gru.log_likelihoods(params, docs) / np.log(10)})

    return indexed.select("row", "ids").mapInPandas(one, "row long, log_model double")


def look_up(indexed: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """(row, log_rare, n_rare_known) of the words beyond the frequent ones, joined with their counts; a word asks once
    for each text, however often it occurs there."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.unique(np.frombuffer(x, np.int64), return_counts=True) for x in batch["rare"]]
            size = [len(words) for words, _ in found]
            words, times = (np.concatenate(x) for x in zip(*found, strict=True)) if found else ([], [])
            yield pd.DataFrame({"row": np.repeat(batch["row"].to_numpy(), size), "word": words, "times": times})

    asked = indexed.filter(F.length("rare") > 0).select("row", "rare").mapInPandas(spread, "row long, word long, times long")
    level = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    rest = counts.filter(level < least).select("word", "n")
    met = asked.join(rest, "word", "left")
    log = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    known = F.sum(F.when(F.col("n").isNotNull(), F.col("times")))
    return met.groupBy("row").agg(F.sum(log).alias("log_rare"), known.alias("n_rare_known"))


def score_documents(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Learn from the rows that are not held out, then score every row.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10). Null text is an empty
    one, a single end token; repeated rows count and are scored as often as they occur; without training rows every
    word is unknown; further columns are ignored; an empty table gives no rows. Scores do not hang on the order or
    the partitions of the input, but for rounding.
    """
    folder = shared_dir(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(held_out(docs["doc_id"]), F.lit(False)).alias("held_out"), text_of(docs).alias("text")
    )
    counts = materialize(count_words(rows.filter("not held_out")), folder, "counts")
    known, least = vocabulary(counts, frequent)
    indexed = materialize(index(rows, known), folder, "indexed")
    params = train(indexed.filter("not held_out"), known.shares, known.tokens)
    rare = look_up(indexed, counts, least)
    whole = indexed.drop("ids", "rare").join(score(indexed, params), "row").join(rare, "row", "left")
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    base = F.col("log_common") + log_rare - F.col("n_tokens") * float(np.log10(known.base_weight))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce("n_rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(known.tokens)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("log_model") + F.col("log_within") + log_rare).alias("score"),
    )
