"""Byte-level BPE by backtracking, and decoding through an offset table.

An Aho-Corasick automaton over the vocabulary finds, at each position, the longest token; a pair-compatibility
table (filled on demand) says whether two adjacent tokens can stand side by side in the result of the merges; if
they cannot, shorter tokens are tried and, failing these, the encoder steps back. Every position is given up at
most once, so a piece is encoded in time linear in its length, with exactly the ids the merge rules give.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import text_of, through_python

#: Pieces whose ids a Python worker keeps; it starts anew beyond that.
PIECE_CACHE = 800_000
#: Pairs whose compatibility a Python worker keeps.
PAIR_CACHE = 2_000_000
#: Longer pieces are not kept.
CACHED_PIECE_CHARS = 64

# Letters and numbers up to U+024F, as the pattern below needs them: fixed values.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
_BLANKS = "\t-\r \u0085 "
_PLAIN = re.compile("[\x00-ɏ]*")
_PLAIN_PIECE = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_BLANKS}{_LETTERS}{_NUMBERS}]+"
    f"|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+"
)


def _any_piece():
    import regex

    blank = r"\t-\r \u0085   -     　"
    return regex.compile(
        r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + blank + r"\p{L}\p{N}]+|[" + blank + r"]+(?![^" + blank + r"])|["
        + blank + r"]+"
    )


def byte_alphabet() -> dict[str, int]:
    """The vocabulary file's printable stand-ins for bytes: printable Latin-1 for itself, the rest from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class BacktrackingBpe:
    def __init__(self, vocabulary: str) -> None:
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        stand_in = byte_alphabet()
        ids = spec["model"]["vocab"]
        raw = {i: bytes(stand_in[c] for c in token) for token, i in ids.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        raw |= {i: s.encode() for s, i in self.special.items()}
        self.tokens = [raw[i] for i in range(len(raw))]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            whole = ids[left + right]
            self.rank[ids[left], ids[right]] = (rank, whole)
            self.parts.setdefault(whole, (ids[left], ids[right]))
        self.merged_at = {whole: self.rank[pair][0] for whole, pair in self.parts.items()}
        by_text = {raw[i]: i for i in ids.values() if i in self.parts or len(raw[i]) == 1}
        self.longest = ahocorasick.Automaton()
        for token, i in by_text.items():
            self.longest.add_word(token.decode("latin-1"), i)
        self.shorter: dict[int, int | None] = {}
        for token, i in by_text.items():
            self.shorter[i] = next((by_text[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in by_text), None)
        self.longest.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.tokens])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.known: dict[str, bytes] = {}
        self._wide = None
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def pair_fits(self, left: int, right: int) -> bool:
        """Whether no merge across the boundary comes before the merges that make the two tokens."""
        found = self.compatible.get((left, right))
        if found is None:
            if len(self.compatible) >= PAIR_CACHE:
                self.compatible.clear()
            found = self.compatible[left, right] = self._pair_fits(left, right)
        return found

    def _pair_fits(self, left: int, right: int) -> bool:
        limit = len(self.rank)
        never = -1
        while True:
            merge = self.rank.get((left, right))
            if merge and merge[0] < limit:
                return False
            a, b = self.merged_at.get(left, never), self.merged_at.get(right, never)
            if a == never and b == never:
                return True
            # Undo the later merge of the two: at equal rank the left one was made first.
            if a > b:
                left, limit = self.parts[left][1], a
            else:
                # A merge across the boundary of this very rank still comes first, being further left.
                right, limit = self.parts[right][0], b + 1

    def encode_piece(self, data: bytes) -> list[int]:
        text = data.decode("latin-1")
        n = len(data)
        at = self._longest_at(text)
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        pos = 0
        token = at[0] if n else None
        while token is not None:
            while True:
                end = pos + len(self.tokens[token])
                if alive[end] and (not out or self.pair_fits(out[-1], token)):
                    out.append(token)
                    pos = end
                    token = at[pos] if pos < n else None
                    break
                shorter = self.shorter[token]
                if shorter is not None:
                    token = shorter
                    continue
                alive[pos] = 0
                token = out.pop()
                pos -= len(self.tokens[token])
        return out

    def _longest_at(self, text: str) -> list[int]:
        """The longest token that starts at each position."""
        best = [0] * len(text)
        size = [0] * len(text)
        for end, token in self.longest.iter(text):
            n = len(self.tokens[token])
            if n > size[end + 1 - n]:
                size[end + 1 - n] = n
                best[end + 1 - n] = token
        return best

    def _piece(self, piece: str) -> bytes:
        ids = np.array(self.encode_piece(piece.encode("utf-8")), dtype="<u4").tobytes()
        if len(piece) <= CACHED_PIECE_CHARS:
            if len(self.known) >= PIECE_CACHE:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def pieces(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _PLAIN_PIECE.findall(text)
        if self._wide is None:
            self._wide = _any_piece()
        return self._wide.findall(text)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; special tokens' strings become their ids."""
        if self._split and any(s in text for s in self.special):
            parts = self._split.split(text)
            return b"".join(
                np.array([self.special[p]], "<u4").tobytes() if i % 2 else self.encode_ordinary(p) for i, p in enumerate(parts) if p
            )
        return self.encode_ordinary(text)

    def encode_ordinary(self, text: str) -> bytes:
        """As encode, with special tokens' strings taken as ordinary text."""
        known, make = self.known.get, self._piece
        return b"".join([known(p) or make(p) for p in self.pieces(text)])

    def decode(self, ids: np.ndarray) -> bytes:
        """Concatenated bytes of the tokens, by one gather through the offset table."""
        ids = ids.astype(np.int64)
        size = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return b""
        at = np.repeat(self.offsets[ids] - (ends - size), size) + np.arange(ends[-1])
        return self.bytes[at].tobytes()


_LOADED: dict[str, BacktrackingBpe] = {}


def load(vocabulary: str) -> BacktrackingBpe:
    """One encoder for each Python worker and vocabulary file."""
    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = BacktrackingBpe(vocabulary)
    return _LOADED[vocabulary]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encode and decode every text. Returns per row: doc_id, n_tokens, ids (binary, little-endian uint32), decoded.

    Null text counts as empty and has no tokens. Rows are independent: repeated rows give repeated results, other
    columns are ignored, an empty table gives none. The vocabulary file must exist on every executor.
    """
    return _encoded(docs, vocabulary or default_vocabulary(), digests=False)


def encode_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """As encode_documents, with SHA-256 of ids and of the decoded text in their place."""
    return _encoded(docs, vocabulary or default_vocabulary(), digests=True)


def _encoded(docs: DataFrame, vocabulary: str, digests: bool) -> DataFrame:
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(vocabulary)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch["text"]]
            out = pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(x) // 4 for x in ids]})
            decoded = (bpe.decode(np.frombuffer(x, "<u4")).decode("utf-8", "replace") for x in ids)
            if digests:
                out["ids_sha256"] = [hashlib.sha256(x).hexdigest() for x in ids]
                out["decoded_sha256"] = [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in decoded]
            else:
                out["ids"] = ids
                out["decoded"] = list(decoded)
            yield out

    rows = docs.select("doc_id", text_of(docs).alias("text"))
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string"
    return through_python(rows, "doc_id", lambda r: r.mapInPandas(encode, f"doc_id string, n_tokens long, {rest}"))
