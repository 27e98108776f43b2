"""Alignment of two tokenizers over a corpus, by postings of token pairs that are dealt over side ids.

Every text is encoded twice; tokens whose byte ranges overlap are linked. A document's distinct pairs with their
multiplicities are postings. These are shuffled by the pair's B id, as sorted streams that may spill: each stream has
the corpus-wide counts of its ids first, from which the greatest count of every B id is found in place, then the
postings, which give each document its share. A last shuffle sums the shares by document.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import materialize, shared_dir

#: Parts that B ids are dealt over, and postings up to which a part stays whole; a larger one is split by blocks.
PARTS, PART_POSTINGS = 64, 2_000_000
#: Merging tasks of each part's counts, before their results are merged.
MERGES = 16
#: Postings and documents of a block.
BLOCK_POSTINGS, BLOCK_DOCS = 250_000, 60_000
#: Stretches between blanks that a Python worker keeps aligned; it starts anew beyond that.
STRETCHES = 300_000
#: Stretches that are encoded in one piece.
JOINED = 2000
#: Characters of a text that are worked on at once, up to the next blank.
TEXT_CHARS = 1 << 20
_BITS = 24  # of an id
_CUT = re.compile(r"(?<=\S)(?= )")


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    key, count = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1]]))
    return key[new], np.add.reduceat(count, new) if len(new) else count


def byte_level(vocabulary: str) -> tuple[list[bytes], Callable[[str], list[int]]]:
    """(bytes of each id, encoder without special tokens) of a byte-level BPE vocabulary file.

    Where ids grow as merges do, they are ranks, by which the faster of two libraries gives the same ids.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    ids, stand_in = spec["model"]["vocab"], bpe.byte_alphabet()
    raw = {i: bytes(stand_in[c] for c in token) for token, i in ids.items()}
    raw |= {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
    merged = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    special = {x["id"] for x in spec["added_tokens"]}
    ranks = {raw[i]: i for i in raw if i not in special}
    if all(x < y for x, y in zip(merged, merged[1:], strict=False)) and len(ranks) == len(merged) + 256:
        import public_tokenizers
        import tiktoken

        encode = tiktoken.Encoding("byte level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    else:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.encode_special_tokens = True
        encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    return [raw[i] for i in range(len(raw))], encode


class Aligner:
    """Aligns texts by a byte-level BPE vocabulary (A) and a sentencepiece model (B).

    Neither tokenizer joins bytes across a blank that follows another character: A's patterns begin a piece there, and
    no B piece has a blank after something else (which is checked). So stretches between such places are aligned
    apart, once for each worker, and a text's alignment is that of its stretches one after another.
    """

    def __init__(self, vocabulary: str, model: str) -> None:
        import sentencepiece

        self.a_bytes, self.encode_a = byte_level(vocabulary)
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.begin, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.sums, self.flat, self.used = np.zeros((1024, 3), np.int64), np.zeros(8192, np.int64), 0

    def align(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(A ids, B ids, group ends in both) of a text that begins with a blank; None if either's bytes differ."""
        a = np.array(self.encode_a(text), dtype=np.int64)
        b = np.array(self.b.encode(text[1:]), dtype=np.int64)
        raw = text.encode()
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            return None
        return a, b, np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])

    def links(self, a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(b << 24 | a, place of the A token) of each link, in order of the A tokens."""
        first = np.searchsorted(b_end, a_end - self.a_size[a], side="right")
        after = np.searchsorted(b_end - self.b_size[b], a_end, side="left")
        n = after - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return b[at] << _BITS | np.repeat(a, n), np.repeat(np.arange(len(a)), n)

    def groups_of(self, a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(a1,a2|b1 of each group, ends in A tokens, ends in B tokens): cut where tokens of both end."""
        a_cut = np.flatnonzero(np.isin(a_end, b_end, assume_unique=True)) + 1
        b_cut = np.flatnonzero(np.isin(b_end, a_end, assume_unique=True)) + 1
        a_text, b_text, out, i, j = list(map(str, a.tolist())), list(map(str, b.tolist())), [], 0, 0
        for x, y in zip(a_cut.tolist(), b_cut.tolist(), strict=True):
            out.append(f"{a_text[i] if x - i == 1 else ','.join(a_text[i:x])}|{b_text[j] if y - j == 1 else ','.join(b_text[j:y])}")
            i, j = x, y
        return out, a_cut, b_cut

    def learn(self, stretches: list[str]) -> None:
        """Align and keep those stretches that are not known; -1 stands for one that either tokenizer does not give back.

        Many are encoded in one piece, as they would be within a text. One that ends with white space has the end of
        a text in its meaning and is encoded alone.
        """
        new = [x for x in dict.fromkeys(stretches) if x not in self.known]
        if len(self.known) + len(new) > STRETCHES:
            self.forget()
            new = list(dict.fromkeys(stretches))
        alone = [x for x in new if x[-1:].isspace()]
        some = [x for x in new if not x[-1:].isspace()]
        for i in range(0, len(some), JOINED):
            part = some[i : i + JOINED]
            found = self.align("".join(part))
            if found is None or not self._keep(part, *found):
                alone += part
        for x in alone:
            found = self.align(x)
            if found is None or not self._keep([x], *found):
                self.known[x] = -1

    def _keep(self, texts: list[str], a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> bool:
        """Keep the alignment of stretches that were encoded in one piece, cut at their ends; whether both end there."""
        ends = np.cumsum([len(t.encode()) for t in texts])
        groups, a_cut, b_cut = self.groups_of(a, b, a_end, b_end)
        last = np.searchsorted(a_end[a_cut - 1], ends)  # each stretch's last group
        if not np.array_equal(a_end[a_cut[np.minimum(last, len(a_cut) - 1)] - 1], ends):
            return False
        a_to, b_to, g_to = a_cut[last], b_cut[last], last + 1
        pairs, of = self.links(a, b, a_end, b_end)
        sizes = np.diff(np.concatenate([[0], np.searchsorted(of, a_to)]))
        at, n, k = len(self.groups), len(pairs), len(texts)
        while at + k > len(self.begin):
            self.begin, self.size, self.sums = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.sums))
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.known.update(zip(texts, range(at, at + k), strict=True))
        cuts = [0, *g_to.tolist()]
        self.groups += [";".join(groups[i:j]).encode() for i, j in zip(cuts, cuts[1:], strict=False)]
        self.begin[at : at + k], self.size[at : at + k] = self.used + np.cumsum(sizes) - sizes, sizes
        self.sums[at : at + k] = np.diff(np.stack([a_to, b_to, g_to], axis=1), axis=0, prepend=0)
        self.flat[self.used : self.used + n] = pairs
        self.used += n
        return True

    def parts(self, text: str) -> Iterator[list[str]]:
        """The stretches of a blank and the text, some at a time."""
        whole, begin = f" {text}", 0
        if not self.cuts:
            yield [whole]
            return
        while begin < len(whole):
            cut = _CUT.search(whole, min(begin + TEXT_CHARS, len(whole)))
            end = cut.start() if cut else len(whole)
            yield _CUT.split(whole[begin:end])
            begin = end

    def document(self, text: str | None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, distinct pairs, multiplicities); all empty without tokens."""
        nothing = np.zeros(0, np.int64)
        if not text:
            return 0, 0, 0, 0, "", nothing, nothing
        digest, sums, keys, counts = hashlib.sha256(), np.zeros(3, np.int64), [], []
        for n, some in enumerate(self.parts(text)):
            at = [self.known.get(x) for x in some]
            if None in at:
                self.learn(some)
                at = [self.known[x] for x in some]
            if -1 in at:
                return self.whole(text)
            digest.update((b";" if n else b"") + b";".join([self.groups[i] for i in at]))
            place, times = np.unique(np.array(at, dtype=np.int64), return_counts=True)
            size = self.size[place]
            sums += (self.sums[place] * times[:, None]).sum(axis=0)
            where = np.repeat(self.begin[place] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            keys.append(self.flat[where])
            counts.append(np.repeat(times, size))
            if len(keys) > 32:
                keys, counts = ([x] for x in summed(keys, counts))
        pairs, times = summed(keys, counts)
        return *map(int, sums), int(times.sum()), digest.hexdigest(), pairs, times

    def whole(self, text: str) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """As document, of the text in one piece: for texts that some stretch does not give back."""
        found = self.align(f" {text}")
        if found is None:
            return self.document(None)
        groups = self.groups_of(*found)[0]
        pairs, times = np.unique(self.links(*found)[0], return_counts=True)
        return len(found[0]), len(found[1]), len(groups), int(times.sum()), hashlib.sha256(";".join(groups).encode()).hexdigest(), pairs, times


_LOADED: dict[tuple[str, str], Aligner] = {}


def load(vocabulary: str, model: str) -> Aligner:
    """One aligner for each Python worker and pair of files."""
    if (vocabulary, model) not in _LOADED:
        _LOADED[vocabulary, model] = Aligner(vocabulary, model)
    return _LOADED[vocabulary, model]


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _blocks(rows: Iterator[tuple[object, str | None]], aligner: Aligner, number: int) -> Iterator[tuple[int, list[tuple], list[np.ndarray], list[np.ndarray]]]:
    """(block, documents' results, their pairs, their multiplicities) of BLOCK_POSTINGS or BLOCK_DOCS at least."""
    block, done, keys, times, postings = number << 32, [], [], [], 0
    for some in _some(rows):
        aligner.learn([x for _, t in some if t and len(t) <= TEXT_CHARS for part in aligner.parts(t) for x in part])
        for doc_id, text in some:
            *sums, digest, pairs, n = aligner.document(text)
            done.append((doc_id, *sums, digest))
            keys.append(pairs)
            times.append(n)
            postings += len(pairs)
            if postings >= BLOCK_POSTINGS or len(done) >= BLOCK_DOCS:
                yield block, done, keys, times
                block, done, keys, times, postings = block + 1, [], [], [], 0
    if done:
        yield block, done, keys, times


def _some(rows: Iterator[tuple[object, str | None]]) -> Iterator[list[tuple]]:
    """Rows of about TEXT_CHARS characters in all."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[1] or "") + 1
        if size >= TEXT_CHARS // 4:
            yield out
            out, size = [], 0
    if out:
        yield out


def part_of(key: np.ndarray) -> np.ndarray:
    """The part of a pair, which its B id alone decides."""
    return ((key >> _BITS) * 0x9E3779B1 & 0xFFFFFFFF) * PARTS >> 32


def _packed(*arrays: np.ndarray) -> bytes:
    return b"".join(x.tobytes() for x in arrays)


def _counts_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(data, np.int64)
    return both[: len(both) // 2], both[len(both) // 2 :]


def encode_blocks(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """Blocks of documents and of their postings, each posting once.

    Rows with at: a document of the block: its results. Rows with part: the block's postings of a part, as its
    distinct pairs and their sums (counts), and runs of (document, multiplicity) in the order of pairs (postings).
    """
    kind = docs.schema["doc_id"].dataType
    schema = f"block long, at int, doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, part int, size long, counts binary, postings binary"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str | None]]:
        for batch in batches:
            ids = batch.column(0)
            for i, text in enumerate(batch.column(1)):
                yield ids[i], text.as_py()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, done, keys, times in _blocks(rows(batches), load(vocabulary, model), TaskContext.get().partitionId()):
            n = len(done)
            ids, *sums, digests = zip(*done, strict=True)
            own = pa.array([x.as_py() for x in ids], type=ids[0].type)
            doc = np.repeat(np.arange(n), [len(k) for k in keys])
            key, time = np.concatenate(keys), np.concatenate(times)
            part = part_of(key)
            order = np.lexsort((doc, key, part))
            key, time, doc, part = key[order], time[order], doc[order], part[order]
            parts, begin = np.unique(part, return_index=True)
            some = []
            for p, i, j in zip(parts.tolist(), begin, [*begin[1:], len(key)], strict=True):
                distinct, at, runs = np.unique(key[i:j], return_index=True, return_counts=True)
                sums_of = np.add.reduceat(time[i:j], at)
                head = np.array([len(distinct), j - i], np.int64)
                some.append((p, j - i, _packed(distinct, sums_of), _packed(head, distinct, runs.astype(np.int64), time[i:j], doc[i:j].astype(np.uint16))))
            m = len(some)
            blank = lambda t, k: pa.nulls(k, t)
            columns = [
                pa.array([block] * (n + m), pa.int64()),
                pa.concat_arrays([pa.array(range(n), pa.int32()), blank(pa.int32(), m)]),
                pa.concat_arrays([own, blank(own.type, m)]),
                *(pa.concat_arrays([pa.array(x, pa.int64()), blank(pa.int64(), m)]) for x in sums),
                pa.concat_arrays([pa.array(digests, pa.string()), blank(pa.string(), m)]),
                *(pa.concat_arrays([blank(t, n), pa.array([x[k] for x in some], t)]) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["block", "at", "doc_id", *_COUNTS, "groups_sha256", "part", "size", "counts", "postings"])

    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def _merge(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row (part, counts) for each value of by, part among them: sums of counts by pair."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, keys, times, held = None, [], [], 0

        def out() -> pd.DataFrame:
            return pd.DataFrame({"part": [here[0]], "counts": [_packed(*summed(keys, times))]})

        for batch in batches:
            for *at, data in batch.itertuples(index=False):
                if at != here:
                    if here is not None:
                        yield out()
                    here, keys, times, held = at, [], [], 0
                key, time = _counts_of(data)
                keys.append(key)
                times.append(time)
                held += len(key)
                if held > 4 * max(500_000, len(keys[0])):
                    keys, times = ([x] for x in summed(keys, times))
                    held = len(keys[0])
        if here is not None:
            yield out()

    return rows.repartition(*by).sortWithinPartitions(*by).select(*by, "counts").mapInPandas(merge, "part int, counts binary")


def _shares(streams: DataFrame) -> DataFrame:
    """(block, shares) of streams (part, salt, kind, block, data): a part's counts (kind 0) come before its postings.

    shares: documents of the block, n_best and count_sum of each. One part's counts are held at a time.
    """

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = count = best = None
        for batch in batches:
            out = []
            for kind, block, data in zip(batch["kind"], batch["block"], batch["data"], strict=True):
                if kind == 0:
                    key, count = _counts_of(data)
                    side, first = np.unique(key >> _BITS, return_index=True)
                    best = count == np.repeat(np.maximum.reduceat(count, first), np.diff([*first, len(key)]))
                    continue
                n, m = np.frombuffer(data, np.int64, 2)
                numbers = np.frombuffer(data, np.int64, 2 * n + m, 16)
                doc = np.frombuffer(data, np.uint16, m, 16 + 8 * (2 * n + m))
                at = np.repeat(np.searchsorted(key, numbers[:n]), numbers[n : 2 * n])
                times = numbers[2 * n :]
                docs, place = np.unique(doc, return_inverse=True)
                sums = np.zeros((2, len(docs)), np.int64)
                np.add.at(sums[0], place, np.where(best[at], times, 0))
                np.add.at(sums[1], place, times * count[at])
                out.append((block, _packed(docs.astype(np.int64), sums[0], sums[1])))
            yield pd.DataFrame(out, columns=["block", "shares"])

    return streams.mapInPandas(share, "block long, shares binary")


def _summed_shares(shares: DataFrame) -> DataFrame:
    """(block, at, n_best, count_sum): shares summed by document; a block has PARTS rows of shares at most."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, sums = None, np.zeros((3, 1 << 16), np.int64)

        def out() -> pd.DataFrame:
            at = np.flatnonzero(sums[0])
            return pd.DataFrame({"block": here, "at": at.astype(np.int32), "n_best": sums[1][at], "count_sum": sums[2][at]})

        for batch in batches:
            for block, data in zip(batch["block"], batch["shares"], strict=True):
                if block != here:
                    if here is not None:
                        yield out()
                    here = block
                    sums[:] = 0
                docs, n_best, count_sum = np.frombuffer(data, np.int64).reshape(3, -1)
                sums[0][docs] = 1
                sums[1][docs] += n_best
                sums[2][docs] += count_sum
        if here is not None:
            yield out()

    return shares.repartition("block").sortWithinPartitions("block").mapInPandas(add, "block long, at int, n_best long, count_sum long")


def align_documents(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a blank and the text by the vocabulary, B the text by the model, which adds the blank; special tokens are
    plain text. Texts that are null or empty, or that the tokens of A or B do not give back, have no tokens: zeros and
    an empty groups_sha256. Null doc_ids stay, repeated rows count each, other columns are ignored, an empty table
    gives no rows. Long texts are worked on in pieces that end between words; memory beside a text grows with its
    distinct pairs. A B id may have any share of links: its part's postings are split by blocks over salts, each of
    which gets the part's counts. Both files must exist on every executor.
    """
    first, second = default_files()
    folder = shared_dir(docs.sparkSession)
    encoded = materialize(encode_blocks(docs, vocabulary or first, model or second), folder, "encoded")
    posted = encoded.filter("part is not null")
    split = F.broadcast(posted.groupBy("part").agg(F.ceil(F.sum("size") / PART_POSTINGS).cast("int").alias("salts")))  # PARTS rows at most
    partial = _merge(posted.select("part", F.pmod(F.xxhash64("block"), F.lit(MERGES)).alias("merge"), "counts"), ["part", "merge"])
    counts = materialize(_merge(partial, ["part"]), folder, "counts").join(split, "part")
    heads = counts.select("part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), F.col("counts").alias("data"))
    tails = posted.join(split, "part").select("part", F.pmod(F.xxhash64("block"), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), "block", F.col("postings").alias("data"))
    streams = heads.unionByName(tails).repartition("part", "salt").sortWithinPartitions("part", "salt", "kind", "block")
    sums = _summed_shares(_shares(streams))
    found = encoded.filter("at is not null").drop("part", "size", "counts", "postings").join(sums, ["block", "at"], "left")
    none = F.lit(0).cast("long")
    return found.select("doc_id", *_COUNTS, F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
