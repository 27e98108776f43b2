"""Removal of repeated paragraphs: MinHash banding, exact Jaccard, components of paragraphs.

Lines and stretches between blank lines are paragraphs. Passages also repeat at any other place of a text, so further
paragraphs are cut by content: a word is a cut where the hash of it and its neighbours is the least around; a paragraph
runs from each cut (and the text's start) to the first cut PARAGRAPH_WORDS further on, so that equal passages hold
equal paragraphs wherever they stand. Paragraphs overlap and together cover the text.

A paragraph that is similar to another one has most of its shingles in common with it. Which shingles occur several
times is found on packed arrays; only paragraphs of which SHARED percent do so go on. Equal ones are put together, in a
chunk of documents first, then by parts of their digests; a chunk sends each part one row with all of its contents, and
gets one with what becomes of them, so that rows do not grow with what is repeated. Every different one has BANDS keys
of BAND_ROWS minima of its shingles; those that share a key meet in its bucket, where their whole shingle sets are
compared; very long ones are compared as near-duplicate texts are. Linked ones form components. Of each component the
paragraphs of the document with the smallest doc_id stay, all others are removed, with the words on either side that are
also those beside the one that stays: a passage's edges lie outside its cuts. Only places, keys and the sets of paragraphs
that share a key move between tasks; texts stay in their chunks, but for very long paragraphs that share a key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash
from .common import bounded, cut_up, distinct, hashed_texts, hot_join, materialize, mix64, shared_dir, word_hashes
from .components import connected_components
from .substring_dedup import LAST_ID, are_shared, by_chunk, code_cells, in_batches, key_buckets, parts_by_bucket, shared_by_chunk, shared_codes

#: Bands in which contents meet: 8 of 3 minima find a pair of similarity 0.8 with probability 0.997, one of 0.9 with
#: 1 - 3e-5, and leave out most paragraphs that only overlap.
BANDS, BAND_ROWS = 8, 3
MINIMA = BANDS * BAND_ROWS
#: Equal minima below which a pair is not compared: 5 standard errors below those of similarity 0.8.
AGREE = 9
#: Percent of a paragraph's shingles that occur several times in the corpus. Similar paragraphs of different places
#: have 80 in common; the rest is for those that are similar to such a one by overlapping it in the same text.
SHARED = 60
#: Shingles up to which contents are compared in their buckets, and beyond which as texts. The ranges overlap, as a
#: pair's sizes are at most 4 to 5.
SMALL, LARGE = 400, 320
#: Contents of a bucket that are compared with as many others in one task; members of a group from which on they are
#: compared by tables; pairs that are compared together.
BLOCK, MANY, PAIRS = 512, 64, 1 << 11
#: Shingles whose band keys are found together.
BATCH_SHINGLES = 1 << 18
#: Band keys of a part, in which those that are equal are found.
PART_KEYS = 1 << 20
#: Buckets of shingles from which on they grow rather than become more, as a chunk sends a row to each of them and these
#: rows would grow with the square of the corpus; and times their usual size up to which they grow.
BUCKETS, GROWN = 512, 8
#: Words on either side that a cut's hash must beat, and the least words of a paragraph.
REACH, PARAGRAPH_WORDS = 2, 8
#: Words on either side of a removed paragraph that are compared with those beside the one that stays.
AROUND = 24
#: Words of the paragraph that stays, at either end, in which a removed one's shingles are looked for.
EDGE = 12
WIDTH, PERCENT = 5, 80
#: Bits of a content's number within its chunk.
NUMBER_BITS = 26

_rng = np.random.Generator(np.random.PCG64(606))
_A = _rng.integers(0, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32)
#: Odd bases of the polynomials that tell contents apart.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


@dataclass(frozen=True)
class Paragraphs:
    """Several texts' words (hash, first and last byte in the texts joined by line feeds), the place of each text's
    first word and first byte, and the paragraphs' first words and ends, in order."""

    words: np.ndarray
    first: np.ndarray
    last: np.ndarray
    bounds: np.ndarray
    bytes_at: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    def text_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, words, side="right") - 1


def cuts(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Places of words at which a paragraph may begin or end; they depend on the words around them alone. text: the
    number of each word's text."""
    if len(words) < 2 * REACH + 3:
        return np.zeros(0, np.int64)
    h = mix64(words[:-2] * np.uint64(3) ^ mix64(words[1:-1] * np.uint64(5) ^ mix64(words[2:])))
    least = text[: -2 * REACH - 2] == text[2 * REACH + 2 :]
    mid = h[REACH : len(h) - REACH]
    for i in range(1, REACH + 1):
        least &= (mid < h[REACH - i : len(h) - REACH - i]) & (mid <= h[REACH + i : len(h) - REACH + i])
    return np.flatnonzero(least) + REACH + 1


def natural(buf: np.ndarray, first: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(first word, end) of the lines and of the stretches between blank lines; first: the words' first bytes."""
    newline = buf == 10
    newline[:-1] |= (buf[:-1] == 13) & (buf[1:] != 10)
    after = np.searchsorted(first, np.flatnonzero(newline))  # the word after each line's end
    after, n = np.unique(after[(after > 0) & (after < len(first))], return_counts=True)
    out = []
    for least in (1, 2):
        at = distinct(np.concatenate([bounds, after[n >= least]]))
        out.append(np.stack([at[:-1], at[1:]], axis=1))
    return np.concatenate(out)


def paragraphs(texts: list[bytes]) -> Paragraphs:
    """The paragraphs of texts: lines and stretches that have a shingle, and those between cuts; a text's start and end
    are cuts too."""
    joined = b"\n".join(texts)
    words, first, last = word_hashes(joined)
    bytes_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    bounds = np.searchsorted(first, bytes_at)
    n = len(words)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Paragraphs(words, first, last, bounds, bytes_at, none, none)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    at = cuts(words, text)
    begin = distinct(np.concatenate([at, bounds[:-1][np.diff(bounds) > 0]]))
    ends = distinct(np.concatenate([at, bounds[1:]]))
    whole = bounds[text[begin] + 1]
    end = np.minimum(ends[np.minimum(np.searchsorted(ends, begin + PARAGRAPH_WORDS), len(ends) - 1)], whole)
    # A paragraph cut short by the text's end is within the one before, but for the first.
    last_ones = np.flatnonzero(end == whole)
    keep = np.ones(len(begin), bool)
    of = text[begin[last_ones]]
    keep[last_ones[1:][of[1:] == of[:-1]]] = False
    own = natural(np.frombuffer(joined, np.uint8), first, bounds)
    own = own[own[:, 1] - own[:, 0] >= WIDTH]
    both = distinct(np.concatenate([begin[keep], own[:, 0]]) * (n + 1) + np.concatenate([end[keep], own[:, 1]]))
    return Paragraphs(words, first, last, bounds, bytes_at, both // (n + 1), both % (n + 1))


def _shingles(words: np.ndarray) -> np.ndarray:
    n = max(0, len(words) - WIDTH + 1)
    out = np.zeros(n, np.uint64)
    for i in range(WIDTH):
        out = mix64(out ^ words[i : n + i])
    return out


def _minima(shingles: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[np.ndarray]:
    """For each hash function the minima over the stretches of shingles, none of which is empty."""
    edge = np.stack([begin, end], axis=1).ravel()
    padded = np.append((shingles >> np.uint64(32)).astype(np.uint32), np.uint32(0))
    for a, b in zip(_A, _B, strict=True):
        yield np.minimum.reduceat(padded * a + b, edge)[::2]


def band_keys(shingles: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """stretches x BANDS keys."""
    out = np.zeros((BANDS, len(begin)), np.uint64)
    for i, least in enumerate(_minima(shingles, begin, end)):
        band = i // BAND_ROWS
        out[band] = mix64(out[band] + least + np.uint64(band + 1))
    return out.T


def text_shingles(texts: list[bytes]) -> list[np.ndarray]:
    """Every occurrence of a shingle."""
    joined = b"\n".join(texts)
    words, first, _ = word_hashes(joined)
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), first, side="right")
    within = text[: max(0, len(words) - WIDTH + 1)] == text[WIDTH - 1 :]
    return [_shingles(words)[within]]


def stretch_digests(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each stretch of words, from two running polynomials over all words."""
    out = np.empty((len(begin), 2), np.uint64)
    for i, base in enumerate(_BASES):
        up, down = (np.cumprod(np.full(len(words) + 1, b, np.uint64)) for b in (base, pow(base, -1, 1 << 64)))
        total = np.append(np.zeros(1, np.uint64), np.cumsum(mix64(words ^ np.uint64(base)) * up[:-1]))
        out[:, i] = mix64((total[end] - total[begin]) * down[begin] ^ (end - begin).astype(np.uint64))
    return out


#: What is packed field by field, with numbers for each entry: a chunk's contents of a part (spread: from the least to
#: the greatest doc_id), the classes whose place is in a chunk, and what a chunk is told of its contents.
_CONTENT = (("digest", "u8", 2), ("least", "i8", 1), ("spread", "i8", 1), ("doc", "i4", 1), ("first", "i4", 1), ("words", "i4", 1))
_CLASS = (("digest", "u8", 2), ("own", "i8", 1), ("number", "i4", 1), ("doc", "i4", 1), ("first", "i4", 1), ("words", "i4", 1))
_ANSWER = (("number", "i4", 1), ("rep", "i8", 1), ("own", "i8", 1), ("component_least", "i8", 1), ("first_rep", "i8", 1))


def _pack(fields: tuple, columns: dict[str, np.ndarray], some: np.ndarray | slice) -> bytes:
    return b"".join(columns[c][some].astype(kind).tobytes() for c, kind, _ in fields)


def _unpack(fields: tuple, packed: Iterable[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The columns of all packed rows, and how many entries each row has."""
    packed = list(packed)
    n = np.array([len(x) for x in packed], np.int64) // sum(np.dtype(kind).itemsize * m for _, kind, m in fields)
    at, out = np.zeros(len(packed), np.int64), {}
    for c, kind, m in fields:
        some = [np.frombuffer(x, kind, k * m, a) for x, k, a in zip(packed, n.tolist(), at.tolist(), strict=True)]
        every = np.concatenate([np.zeros(0, kind), *some])
        out[c] = every.reshape(-1, m) if m > 1 else every
        at += n * m * np.dtype(kind).itemsize
    return out, n


_CANDIDATE = "chunk long, part int, base long, contents binary, places binary, docs binary"


def part_of(digest: np.ndarray, parts: int) -> np.ndarray:
    """The part of digests; it rises with them."""
    return ((digest[:, 0] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _candidates(buckets: int, parts: int):
    """A chunk's distinct contents of shared shingles, by parts of their digests, with the place of least doc_id; they have
    numbers from base on. And, as part -1, where each stands: places (document, number, first word, end) and docs (doc_id,
    words, paragraphs)."""
    names = [c.split(" ")[0] for c in _CANDIDATE.split(", ")]

    def collect(docs: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame([], columns=names)
        docs = docs.sort_values("row", ignore_index=True)
        chunk, ids = int(docs["chunk"].iat[0]), docs["doc_id"].tolist()
        shared = shared_codes(info) if len(info) else np.zeros(0, np.uint64)
        cells = code_cells(shared) if len(shared) else None
        digests = [np.zeros((0, 2), np.uint64)]
        places = [np.zeros((0, 3), np.int64)]
        of_docs: list[np.ndarray] = []
        done = 0
        for texts in in_batches(docs["text"]):
            found = paragraphs(texts)
            per_text = np.diff(np.searchsorted(found.begin, found.bounds))
            of_docs.append(np.stack([ids[done : done + len(texts)], np.diff(found.bounds), per_text], axis=1).astype(np.int64))
            some = np.flatnonzero(found.end - found.begin >= WIDTH)
            if len(shared) and len(some):
                begin, end = found.begin[some], found.end[some]
                n = np.append(0, np.cumsum(are_shared(_shingles(found.words), shared, buckets, cells)))
                on = 100 * (n[end - WIDTH + 1] - n[begin]) >= SHARED * (end - WIDTH + 1 - begin)
                begin, end = begin[on], end[on]
                text = found.text_of(begin)
                start = found.bounds[text]
                digests.append(stretch_digests(found.words, begin, end))
                places.append(np.stack([text + done, begin - start, end - start], axis=1))
            done += len(texts)
        digest, place = np.concatenate(digests), np.concatenate(places)
        doc = np.array(ids, np.int64)[place[:, 0]]
        order = np.lexsort((doc, digest[:, 1], digest[:, 0]))
        new = _changes(digest[order])
        first, last = order[new], order[np.append(new[1:], True)[: len(order)]]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        whole = {
            "digest": digest[first],
            "least": doc[first],
            "spread": doc[last] - doc[first],
            "doc": place[first, 0],
            "first": place[first, 1],
            "words": place[first, 2] - place[first, 1],
        }
        part = part_of(whole["digest"], parts)
        edge = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]).tolist()
        out = [(chunk, part[a], a, _pack(_CONTENT, whole, slice(a, b)), None, None) for a, b in zip(edge, [*edge[1:], len(part)], strict=False)]
        stands = np.column_stack([place[:, 0], number, place[:, 1:]]).astype(np.int32)
        out.append((chunk, -1, 0, None, stands.tobytes(), np.concatenate(of_docs).tobytes()))
        return pd.DataFrame(out, columns=names)

    return collect


def _changes(digest: np.ndarray) -> np.ndarray:
    """Which of digests in order differ from the one before."""
    return np.append(True, (digest[1:] != digest[:-1]).any(axis=1))[: len(digest)]


@dataclass(frozen=True)
class Classes:
    """A part's contents (columns, chunk, number) in the order of digest, doc_id and chunk, the class of each, and the
    places of the classes' first contents. A class is named by the chunk and number of its first content."""

    columns: dict[str, np.ndarray]
    chunk: np.ndarray
    number: np.ndarray
    of: np.ndarray
    head: np.ndarray

    @property
    def reps(self) -> np.ndarray:
        return self.chunk[self.head] << NUMBER_BITS | self.number[self.head]


def _in_classes(part: pd.DataFrame) -> Classes:
    part = part.sort_values("chunk")
    columns, n = _unpack(_CONTENT, part["contents"])
    chunk = np.repeat(part["chunk"].to_numpy(np.int64), n)
    number = np.arange(n.sum()) + np.repeat(part["base"].to_numpy(np.int64) - (np.cumsum(n) - n), n)
    order = np.lexsort((columns["least"], columns["digest"][:, 1], columns["digest"][:, 0]))
    columns = {c: x[order] for c, x in columns.items()}
    new = _changes(columns["digest"])
    return Classes(columns, chunk[order], number[order], np.cumsum(new) - 1, np.flatnonzero(new))


def _classes(part: pd.DataFrame) -> pd.DataFrame:
    """(chunk, part, n, classes): the classes of equal contents, at the place of least doc_id, by its chunk."""
    found = _in_classes(part)
    columns = {c: found.columns[c][found.head] for c in ("digest", "doc", "first", "words")}
    columns |= {"own": found.columns["least"][found.head], "number": found.number[found.head]}
    own_part = part["part"].iat[0]
    out = [(chunk, own_part, len(own), _pack(_CLASS, columns, own)) for chunk, own in parts_by_bucket(found.chunk[found.head])]
    return pd.DataFrame(out, columns=["chunk", "part", "n", "classes"])


def _answers(part: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """(chunk, answers): for the contents that stand in a document beyond the least of their component, which this is. Of
    others (rep, component_least, first_rep) are the classes that are similar to others."""
    found = _in_classes(part)
    reps, own = found.reps, found.columns["least"][found.head]
    least, first = own.copy(), reps.copy()
    if len(others):
        order = np.argsort(reps)
        at = order[np.searchsorted(reps, others["rep"].to_numpy(np.int64), sorter=order)]
        least[at], first[at] = others["component_least"].to_numpy(np.int64), others["first_rep"].to_numpy(np.int64)
    some = np.flatnonzero(found.columns["least"] + found.columns["spread"] > least[found.of])
    of = found.of[some]
    columns = {"number": found.number[some], "rep": reps[of], "own": own[of], "component_least": least[of], "first_rep": first[of]}
    out = [(chunk, _pack(_ANSWER, columns, own)) for chunk, own in parts_by_bucket(found.chunk[some])] if len(some) else []
    return pd.DataFrame(out, columns=["chunk", "answers"])


def _places(info: pd.DataFrame, wanted: bool) -> dict[str, np.ndarray]:
    """The classes that a chunk's rows hold, in the order of their documents, with rep and part; of these those alone whose
    rep is wanted by other rows, if so."""
    held = info[info["classes"].notna()]
    columns, n = _unpack(_CLASS, held["classes"])
    columns["part"] = np.repeat(held["part"].to_numpy(np.int64), n)
    columns["rep"] = np.repeat(held["chunk"].to_numpy(np.int64), n) << NUMBER_BITS | columns["number"]
    order = np.argsort(columns["doc"], kind="stable")
    if wanted:
        asked = info.loc[info["classes"].isna(), "rep"].to_numpy(np.int64)
        order = order[np.isin(columns["rep"][order], asked)]
    return {c: x[order] for c, x in columns.items()}


def _at_places(docs: pd.DataFrame, places: dict[str, np.ndarray]) -> Iterator[tuple]:
    """For each document with places, which are in the order of documents: their slice, first words and ends, the document's
    bytes, its words' hashes, first and last bytes, and its shingles, with some more at the end."""
    texts = docs.sort_values("row")["text"].tolist()
    first, stop = places["first"].astype(np.int64), places["first"].astype(np.int64) + places["words"]
    edge = np.searchsorted(places["doc"], np.arange(len(texts) + 1)).tolist()
    own = [slice(a, b) for a, b in zip(edge, edge[1:], strict=False) if a < b]
    wanted = (text.encode("utf-8") for a, b, text in zip(edge, edge[1:], texts, strict=False) if a < b)
    for some, found in zip(own, hashed_texts(wanted, _shingles), strict=True):
        yield some, first[some], stop[some], *found


def _bands(parts: int):
    """(part, keys, reps) for each band of the classes at their places: those whose key modulo parts is part, packed."""

    def found(docs: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        k, rep = _keys_at(docs, _places(info, False))
        dealt = parts_by_bucket((k % np.uint64(parts)).astype(np.int32)) if len(k) else ()
        out = [(part, k[own].tobytes(), rep[own].tobytes()) for part, own in dealt]
        return pd.DataFrame(out, columns=["part", "keys", "reps"])

    return found


def _keys_at(docs: pd.DataFrame, places: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(key, rep) for each band of the contents at places."""
    keys: list[np.ndarray] = [np.zeros((0, BANDS), np.uint64)]
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> None:
        begin, end = (np.concatenate([x[i] for x in held]) for i in (1, 2))
        keys.append(band_keys(np.concatenate([x[0] for x in held]), begin, end))
        held.clear()

    for _, first, stop, _, _, _, _, shingles in _at_places(docs, places):
        held.append((shingles, first + size, stop + size - WIDTH + 1))
        size += len(shingles)
        if size >= BATCH_SHINGLES:
            flush()
            size = 0
    if held:
        flush()
    return np.concatenate(keys).ravel(), np.repeat(places["rep"], BANDS)


_SET = "rep long, size int, small binary, text string, part int, own long, digest binary"


def _sets(docs: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
    """The shingle sets of the wanted classes, and the texts of long ones, with what tells the class."""
    places = _places(info, True)
    reps = places["rep"]
    out = [pd.DataFrame([], columns=["rep", "size", "small", "text"])]
    held: list[tuple] = []

    def flush() -> None:
        at = np.cumsum([0, *(len(h[1]) for h in held)]).tolist()
        begin, end = (np.concatenate([h[i] + a for h, a in zip(held, at, strict=False)]) for i in (2, 3))
        found, size = distinct_sets(np.concatenate([h[1] for h in held]), begin, end - WIDTH + 1)
        small: list[bytes | None] = cut_up(found.tobytes(), 8 * size)
        texts: list[str | None] = [None] * len(size)
        for i in np.flatnonzero(size > SMALL).tolist():
            small[i] = None
        of = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
        for i in np.flatnonzero(size > LARGE).tolist():
            data, first, last = held[of[i]][4:]
            texts[i] = data[first[begin[i] - at[of[i]]] : last[end[i] - at[of[i]] - 1]].decode("utf-8")
        out.append(pd.DataFrame({"rep": np.concatenate([h[0] for h in held]), "size": size, "small": small, "text": pd.Series(texts, dtype=object)}))
        held.clear()

    n = 0
    for own, begin, end, data, _, first, last, shingles in _at_places(docs, places):
        held.append((reps[own], shingles, begin, end, data, first, last))
        n += int((end - begin).sum())
        if n >= BATCH_SHINGLES:
            flush()
            n = 0
    if held:
        flush()
    sets = pd.concat(out, ignore_index=True)
    digest = cut_up(places["digest"].tobytes(), np.full(len(reps), 16))
    return sets.assign(part=places["part"], own=places["own"], digest=pd.Series(digest, dtype=object))


def distinct_sets(shingles: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each stretch's shingles sorted and distinct, one after the other, and how many. Stretches of one length are sorted
    together."""
    size = end - begin
    start = np.cumsum(size) - size
    every = shingles[np.arange(size.sum()) + np.repeat(begin - start, size)]
    new = np.ones(len(every), bool)
    order = np.argsort(size, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        at = start[own][:, None] + np.arange(size[own[0]])
        some = np.sort(every[at], axis=1)
        every[at] = some
        new[at[:, 1:]] = some[:, 1:] != some[:, :-1]
    return every[new], np.add.reduceat(new.astype(np.int64), start)


def _groups(part: pd.DataFrame) -> pd.DataFrame:
    """Of a part's (keys, reps): each group of reps that have a key in common, with two hashes of its members. Groups of
    up to BLOCK members are rows of their own; of larger ones each block is."""
    k, rep = (np.concatenate([np.frombuffer(x, kind) for x in part[c]]) for c, kind in (("keys", np.uint64), ("reps", np.int64)))
    order = np.argsort(k, kind="stable")
    several = np.empty(len(k), bool)
    same = k[order[1:]] == k[order[:-1]]
    several[1:], several[0] = same, False
    several[:-1] |= same
    order = order[several]
    order = order[np.lexsort((rep[order], k[order]))]
    k, rep = k[order], rep[order]
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1])[: len(k)])
    size = np.diff(np.append(start, len(k)))
    at = np.arange(len(k)) - np.repeat(start, size)
    cut = np.flatnonzero(at % BLOCK == 0)
    ends = np.append(cut[1:], len(k))
    first, second = (np.add.reduceat(mix64(rep.astype(np.uint64) ^ np.uint64(b)), cut) if len(cut) else np.zeros(0, np.uint64) for b in _BASES)
    whole = np.repeat(size <= BLOCK, -(-size // BLOCK))
    # A block of a larger group is told from all others by the group's key.
    first, second = np.where(whole, first, k[cut]), np.where(whole, second, (at[cut] // BLOCK).astype(np.uint64))
    reps = cut_up(rep.tobytes(), 8 * (ends - cut))
    cols = {"first": first.astype(np.int64), "second": second.astype(np.int64), "whole": whole, "k": k[cut].astype(np.int64), "block": at[cut] // BLOCK}
    return pd.DataFrame(cols | {"reps": pd.Series(reps, dtype=object)})


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(k, rep, block) of groups in the order of their hashes; of groups with equal members, one."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        key = batch[["whole", "first", "second"]].to_numpy(np.int64)
        new = np.append(last is None or bool((key[0] != last).any()), (key[1:] != key[:-1]).any(axis=1))
        last = key[-1]
        some = batch[new]
        reps = some["reps"].tolist()
        n = np.array([len(r) // 8 for r in reps], np.int64)
        rep = np.frombuffer(b"".join(reps), np.int64)
        yield pd.DataFrame({"k": np.repeat(some["k"].to_numpy(), n), "rep": rep, "block": np.repeat(some["block"].to_numpy(), n)})


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """sets x MINIMA."""
    size = np.array([len(s) for s in sets])
    end = np.cumsum(size)
    return np.stack(list(_minima(np.concatenate(sets), end - size, end)), axis=1)


def bucket_links(group: np.ndarray, second: np.ndarray, ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links within groups, whose members follow each other, that connect whatever the similar sets of a group connect.

    Members with second are compared with those without alone, and these with them; a group without any has all its
    members compared. Pairs whose minima differ too much are left out, and those that links already connect.
    """
    n = len(ids)
    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    stops = np.append(edge[1:], n)
    of = np.repeat(np.arange(len(edge)), stops - edge)
    n_second = np.bincount(of, second, minlength=len(edge)).astype(np.int64)
    sig, size = signatures(sets), np.array([len(s) for s in sets])
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # Shingles as numbers, with the number of the set before them: these rise from set to set and within each.
    start = np.cumsum(size) - size
    value = np.unique(np.concatenate(sets), return_inverse=True)[1]
    place = np.repeat(np.arange(n) << 32, size) | value
    out = []

    def settle(left: np.ndarray, right: np.ndarray) -> None:
        """Links of pairs whose minima agree. Many pairs are compared together: the values of each one's smaller set are
        looked up among those of the other."""
        for at in range(0, len(left), PAIRS):
            i, j = left[at : at + PAIRS], right[at : at + PAIRS]
            swap = size[i] > size[j]
            x, y = np.where(swap, j, i), np.where(swap, i, j)
            many = size[x]
            first = np.cumsum(many) - many
            wanted = np.repeat(y << 32, many) | value[np.arange(many.sum()) + np.repeat(start[x] - first, many)]
            found = place[np.minimum(np.searchsorted(place, wanted), len(place) - 1)] == wanted
            both = np.add.reduceat(found.astype(np.int64), first)
            on = 100 * both >= PERCENT * (size[i] + size[j] - both)
            for x, y in zip(i[on].tolist(), j[on].tolist(), strict=True):
                a, b = root(x), root(y)
                if a != b:
                    out.append((ids[x], ids[y]))
                    parent[b] = a

    # Groups of many members: whole tables of equal minima.
    many = stops - edge > MANY
    for g in np.flatnonzero(many).tolist():
        a, b, c = edge[g], stops[g] - n_second[g], stops[g]
        right = slice(b, c) if n_second[g] else slice(a, c)
        for at in range(a, b, MANY):
            left = slice(at, min(at + MANY, b))
            equal = np.zeros((left.stop - at, right.stop - right.start), np.uint8)
            for m in range(MINIMA):
                equal += sig[left, m][:, None] == sig[right, m][None, :]
            near = (equal >= AGREE) & (100 * np.minimum.outer(size[left], size[right]) >= PERCENT * np.maximum.outer(size[left], size[right]))
            i, j = np.nonzero(near)
            i, j = i + at, j + right.start
            settle(i[i < j], j[i < j])
    # All others: lists of pairs over many groups.
    one = np.flatnonzero(~many[of] & ~second)
    follow = np.where(n_second[of] > 0, stops[of] - n_second[of], np.arange(n) + 1)[one]
    total = np.append(0, np.cumsum(stops[of][one] - follow))
    for low in range(0, len(one), MANY * 8):
        high = min(low + MANY * 8, len(one))
        count = np.diff(total[low : high + 1])
        left = np.repeat(one[low:high], count)
        right = np.repeat(follow[low:high], count) + np.arange(total[high] - total[low]) - np.repeat(total[low:high] - total[low], count)
        near = 100 * np.minimum(size[left], size[right]) >= PERCENT * np.maximum(size[left], size[right])
        left, right = left[near], right[near]
        near = (sig[left] == sig[right]).sum(axis=1) >= AGREE
        settle(left[near], right[near])
    return out


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links within groups of equal (k, x, y), whose rows follow each other, those of block x first."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        small = rows["small"].tolist()
        ends = np.cumsum([len(s) // 8 for s in small]).tolist()
        every = np.frombuffer(b"".join(small), np.uint64)
        sets = [every[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        second = ((rows["x"] != rows["y"]) & (rows["block"] == rows["y"])).to_numpy()
        found = bucket_links(rows["group"].to_numpy(), second, rows["rep"].to_numpy(), sets)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    held, before = None, 0
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        key = rows[["k", "x", "y"]].to_numpy()
        rows["group"] = np.append(0, np.cumsum((key[1:] != key[:-1]).any(axis=1)))
        last = rows["group"] == rows["group"].iat[-1]
        if not last.all():
            yield links(rows[~last])
        held = rows[last].drop(columns="group")
    if held is not None and len(held):
        yield links(held.assign(group=0))


def similar_contents(members: DataFrame, small: DataFrame, folder: str) -> DataFrame:
    """Links (a, b) of contents that share a bucket (members: k, rep, block) and whose shingle sets (small: rep, small)
    are similar."""
    hot = members.filter("block > 0").groupBy("k").agg((F.max("block") + 1).alias("blocks"))
    hot = materialize(hot, folder, "hot")
    dealt = hot_join(members, hot, "k", "rep", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("k", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "rep")
    dealt = dealt.join(small, "rep").repartition("k", "x", "y").sortWithinPartitions("k", "x", "y", "block", "rep")
    return dealt.select("k", "x", "y", "block", "rep", "small").mapInPandas(_compare, "a long, b long").distinct()


def large_links(large: DataFrame) -> DataFrame:
    """(a, b) of long contents (rep, text): each with the least of its component of near-duplicate texts."""
    near = minhash.near_duplicates(large, PERCENT, WIDTH, "rep", large["text"]).filter("not kept")
    return near.select(F.col("rep").alias("a"), F.col("component_id").alias("b"))


_STRETCH = "chunk long, number long, like long, spans binary, lefts binary, rights binary, docs binary"


def _stretches(packed: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """What goes from each document of a chunk, as stretches of words, and whose surroundings are asked for.

    As number -1: spans (document, first word, end), lefts and rights (document, first word, end, like), the paragraphs
    at the spans' edges, and docs (paragraphs, removed ones, class); like rows: (number, like).
    """
    names = [c.split(" ")[0] for c in _STRETCH.split(", ")]
    if not len(packed):
        return pd.DataFrame([], columns=names)
    chunk = int(packed["chunk"].iat[0])
    docs = np.frombuffer(packed["docs"].iat[0], np.int64).reshape(-1, 3)
    doc, number, a, b = np.frombuffer(packed["places"].iat[0], np.int32).reshape(-1, 4).astype(np.int64).T
    gone = np.stack([docs[:, 2], np.zeros(len(docs), np.int64), docs[:, 0]], axis=1)
    likes: dict[int, int] = {}
    spans = np.zeros((0, 3), np.int64)
    edges: list[np.ndarray] = [np.zeros((0, 4), np.int64)] * 2
    if len(answers):
        told, _ = _unpack(_ANSWER, answers["answers"])
        slot = np.full(int(number.max()) + 1, -1)
        slot[told["number"]] = np.arange(len(told["number"]))
        least, own = told["component_least"], told["own"]
        out = np.flatnonzero((slot[number] >= 0) & (docs[doc, 0] > least[slot[number]]))
        out = out[np.lexsort((a[out], doc[out]))]
        doc, a, b, answer = doc[out], a[out], b[out], slot[number[out]]
        gone[:, 1] = np.bincount(doc, minlength=len(docs))
        np.minimum.at(gone[:, 2], doc, least[answer])
        if len(out):
            reach = np.maximum.accumulate(doc << 32 | b)
            new = np.append(True, (doc[1:] << 32 | a[1:]) > reach[:-1])
            span = np.cumsum(new) - 1
            last = np.append(np.flatnonzero(new)[1:], len(out)) - 1
            spans = np.stack([doc[new], a[new], reach[last] & 0xFFFFFFFF], axis=1)
            for side, at in enumerate((np.flatnonzero((a == spans[span, 1]) & (a > 0)), np.flatnonzero((b == spans[span, 2]) & (b < docs[doc, 1])))):
                found = []
                for i in at.tolist():
                    k = answer[i]
                    like = told["rep" if docs[doc[i], 0] > own[k] else "first_rep"][k]
                    found.append((doc[i], a[i], b[i], likes.setdefault(int(like), len(likes))))
                edges[side] = np.array(found, np.int64).reshape(-1, 4)
    rows = [(chunk, i, like, None, None, None, None) for like, i in likes.items()]
    rows.append((chunk, -1, None, spans.astype(np.int64).tobytes(), *(e.tobytes() for e in edges), gone.tobytes()))
    return pd.DataFrame(rows, columns=names)


def _surroundings(docs: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
    """The hashes of up to AROUND words before and after each wanted class's place, with up to EDGE of its own beside them."""
    places = _places(info, True)
    out = []
    for own, begin, end, _, words, _, _, _ in _at_places(docs, places):
        for like, a, b in zip(places["rep"][own].tolist(), begin.tolist(), end.tolist(), strict=True):
            out.append((like, words[max(0, a - AROUND) : min(b, a + EDGE)].tobytes(), words[max(a, b - EDGE) : b + AROUND].tobytes()))
    return pd.DataFrame(out, columns=["like", "before", "after"])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def _beyond(outside: np.ndarray, own: np.ndarray, stays: np.ndarray) -> int:
    """How many words of outside, which goes on after own, are those of stays after the last shingle of both."""
    for t in range(len(own), max(WIDTH, len(own) - EDGE + WIDTH) - 1, -1):
        some = own[t - WIDTH : t]
        for at in np.flatnonzero(stays == some[0]).tolist():
            if len(stays) >= at + WIDTH and (stays[at : at + WIDTH] == some).all():
                return max(0, _common(np.concatenate([own[t:], outside]), stays[at + WIDTH :]) - (len(own) - t))
    return 0


def _remove(docs: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
    names = ["doc_id", "n_bytes", "n_paragraphs", "n_repeated", "n_removed", "n_spans", "class_id", "kept_sha256"]
    docs = docs.sort_values("row", ignore_index=True)
    packed, around = info[info["number"] < 0], info[info["number"] >= 0]
    spans = np.frombuffer(packed["spans"].iat[0], np.int64).reshape(-1, 3)
    edges = [np.frombuffer(packed[c].iat[0], np.int64).reshape(-1, 4) for c in ("lefts", "rights")]
    gone = np.frombuffer(packed["docs"].iat[0], np.int64).reshape(-1, 3)
    sides = [dict(zip(around["number"], around[c], strict=True)) for c in ("before", "after")]
    own = [np.searchsorted(x[:, 0], np.arange(len(docs) + 1)).tolist() for x in (spans, *edges)]
    out = []
    changed = hashed_texts(text.encode("utf-8") for text, n in zip(docs["text"], gone[:, 1].tolist(), strict=True) if n)
    for d, (doc_id, text) in enumerate(zip(docs["doc_id"], docs["text"], strict=True)):
        data = text.encode("utf-8")
        n_removed = n_spans = 0
        kept = data
        if gone[d, 1]:
            _, words, first, last, _ = next(changed)
            mask = np.zeros(len(data), bool)
            for _, a, b in spans[own[0][d] : own[0][d + 1]].tolist():
                mask[first[a] : last[b - 1]] = True
            for _, a, b, like in edges[0][own[1][d] : own[1][d + 1]].tolist():
                stays = np.frombuffer(sides[0][like], np.uint64)
                same = _beyond(words[max(0, a - AROUND) : a][::-1], words[a:b][::-1], stays[::-1])
                mask[first[a - same] : first[a]] |= same > 0
            for _, a, b, like in edges[1][own[2][d] : own[2][d + 1]].tolist():
                same = _beyond(words[b : b + AROUND], words[a:b], np.frombuffer(sides[1][like], np.uint64))
                mask[last[b - 1] : last[b + same - 1]] |= same > 0
            for k in np.flatnonzero(mask[first[:-1]] & mask[first[1:]] & ~mask[last[:-1]]).tolist():
                mask[last[k] : first[k + 1]] = True
            n_removed, n_spans = int(mask.sum()), int((mask[1:] & ~mask[:-1]).sum() + mask[0])
            kept = np.frombuffer(data, np.uint8)[~mask].tobytes()
        out.append((doc_id, len(data), gone[d, 0], gone[d, 1], n_removed, n_spans, gone[d, 2], hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(out, columns=names)


def _beside(rows: DataFrame, places: DataFrame, make, ddl: str) -> DataFrame:
    """What make finds in a chunk's documents at the chunk's places."""
    return rows.groupBy("chunk").cogroup(places.groupBy("chunk")).applyInPandas(make, ddl)


def _wanted(classes: DataFrame, reps: DataFrame) -> DataFrame:
    """classes, and the wanted reps as rows of the chunk that has their place."""
    none = F.lit(-1).cast("long").alias("rep")  # no null, beside which pandas would round
    asked = reps.select(F.shiftright("rep", NUMBER_BITS).alias("chunk"), F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("classes"), "rep")
    return classes.select("chunk", "part", "classes", none).unionByName(asked)


def content_links(rows: DataFrame, classes: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between similar contents of classes, and (rep, part, own, digest) of those that can have one."""
    count = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-BANDS * count // PART_KEYS))
    keyed = _beside(rows, classes, _bands(parts), "part int, keys binary, reps binary")
    groups = keyed.groupBy("part").applyInPandas(_groups, "first long, second long, whole boolean, k long, block long, reps binary")
    groups = groups.repartition("first", "second").sortWithinPartitions("whole", "first", "second", "k")
    members = materialize(groups.mapInPandas(_members, "k long, rep long, block long"), folder, "members")
    met = _wanted(classes, members.select("rep").distinct())
    sets = materialize(_beside(rows, met, _sets, _SET), folder, "sets")
    links = similar_contents(members, sets.filter(F.col("size") <= SMALL).select("rep", "small"), folder)
    large = materialize(sets.filter(F.col("size") > LARGE).select("rep", "text"), folder, "large")
    links = links if large.isEmpty() else links.unionByName(large_links(large))
    return links, sets.select("rep", "part", "own", "digest")


def shingle_buckets(buckets: int) -> int:
    """How many buckets of shingles a corpus has that would have so many of the usual size."""
    return max(min(buckets, BUCKETS), -(-buckets // GROWN))


def repeated_paragraphs(rows: DataFrame, folder: str) -> DataFrame:
    """For each chunk what _stretches finds, with before and after of the like rows; rows as by_chunk gives."""
    buckets = shingle_buckets(key_buckets(rows))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets)
    shared = shared_by_chunk(rows, buckets, text_shingles)
    candidates = materialize(_beside(rows, shared, _candidates(buckets, parts), _CANDIDATE), folder, "candidates")
    contents = candidates.filter("part >= 0").select("chunk", "part", "base", "contents")
    classes = materialize(contents.groupBy("part").applyInPandas(_classes, "chunk long, part int, n long, classes binary"), folder, "classes")
    links, known = content_links(rows, classes, folder)
    links = materialize(links, folder, "links")

    linked = connected_components(links, folder, "paragraphs").select(F.col("node").alias("rep"), "component")
    linked = materialize(known.join(bounded(linked), "rep"), folder, "linked")
    first = linked.groupBy("component").agg(F.min(F.struct("own", "digest", "rep")).alias("first"))
    first = materialize(first.select("component", F.col("first.own").alias("component_least"), F.col("first.rep").alias("first_rep")), folder, "first")
    others = materialize(hot_join(linked, first, "component", "rep").select("part", "rep", "component_least", "first_rep"), folder, "others")

    answers = contents.groupBy("part").cogroup(others.groupBy("part")).applyInPandas(_answers, "chunk long, answers binary")
    packed = candidates.filter("part < 0").select("chunk", "places", "docs")
    stretches = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_stretches, _STRETCH)
    stretches = materialize(stretches, folder, "stretches")

    likes = stretches.filter("number >= 0").select("chunk", "number", "like")
    wanted = _wanted(classes, likes.select(F.col("like").alias("rep")).distinct())
    around = _beside(rows, wanted, _surroundings, "like long, before binary, after binary")
    return stretches.filter("number < 0").unionByName(likes.join(around, "like"), allowMissingColumns=True)


def remove_paragraphs(docs: DataFrame) -> DataFrame:
    """Take out of each document the paragraphs that are near-duplicates of one in a document of smaller doc_id.

    With a paragraph at the edge of what is taken out go the words beside it, up to AROUND, that equal those beside the
    first equal paragraph (else the component's first), and the separators between removed words.
    Two paragraphs are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more; links
    form components. Returns per document: doc_id, n_bytes, n_paragraphs, n_repeated (paragraphs taken out),
    n_removed (bytes), n_spans (maximal removed stretches), class_id (the smallest doc_id that holds one of its
    removed paragraphs, else its own), kept_sha256. Repeats within a document or between rows of equal doc_id stay; a
    null doc_id is larger than all others. Words are lower-cased in A-Z. Null and empty texts have no paragraphs;
    paragraphs of fewer than five words link with nothing; an empty table gives none; further columns are ignored.
    """
    folder = shared_dir(docs.sparkSession)
    rows = by_chunk(docs, folder)
    gone = repeated_paragraphs(rows, folder)
    ddl = "doc_id long, n_bytes long, n_paragraphs long, n_repeated long, n_removed long, n_spans long, class_id long, kept_sha256 string"
    out = _beside(rows, gone, _remove, ddl)
    none = {c: F.when(F.col(c) != LAST_ID, F.col(c)) for c in ("doc_id", "class_id")}
    return out.withColumns(none)
