"""Language identification by rank-order profiles of character n-grams and their out-of-place distance."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_fold

#: Length of a document's and of a language's profile.
PROFILE = 300
#: Characters worked on at once while counting.
CHUNK_CHARS = 1_000_000
_SALTS = 16
_NONE = np.uint64(0x1FFFFF)  # beyond the last code point: stands for "no character"
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def ngram_codes(text: str) -> np.ndarray:
    """Codes of the 1- to 3-grams of the lower-cased letters; any other character is a word boundary, which may
    stand at an n-gram's edge but not inside it."""
    chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_letters()[chars], chars, 0).astype(np.uint64)
    on = c > 0
    one = (c[on] << np.uint64(42)) | (_NONE << np.uint64(21)) | _NONE
    two = (c[:-1] << np.uint64(42)) | (c[1:] << np.uint64(21)) | _NONE
    three = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    return np.concatenate([one, two[on[:-1] | on[1:]], three[on[1:-1]]])


def document_profile(text: str) -> np.ndarray:
    """The most frequent n-grams, ties by code."""
    codes, n = np.unique(ngram_codes(text), return_counts=True)
    return codes[np.argsort(-n, kind="stable")[:PROFILE]]


def count_ngrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """n-gram counts by language of all a task's texts."""
    held: dict[str, list[str]] = defaultdict(list)
    chars: dict[str, int] = defaultdict(int)
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush(lang: str) -> None:
        codes, n = np.unique(ngram_codes(" ".join(held.pop(lang))), return_counts=True)
        chars[lang] = 0
        if lang in sums:
            codes, at = np.unique(np.concatenate([sums[lang][0], codes]), return_inverse=True)
            n = np.bincount(at, np.concatenate([sums[lang][1], n])).astype(np.int64)
        sums[lang] = codes, n

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            held[lang].append(text)
            chars[lang] += len(text)
            if chars[lang] >= CHUNK_CHARS:
                flush(lang)
    for lang in list(held):
        flush(lang)
    for lang, (codes, n) in sums.items():
        yield pd.DataFrame({"lang": lang, "code": codes.astype(np.int64), "n": n})


class Profiles:
    """Language profiles: rank of every n-gram in each language, PROFILE where it is missing."""

    def __init__(self, tops: dict[str, list[int]]) -> None:
        self.langs = sorted(tops)
        self.codes = np.unique(np.array([c for t in tops.values() for c in t], dtype=np.uint64))
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, np.array(tops[lang], np.uint64))] = np.arange(len(tops[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = document_profile(text) if text else np.zeros(0, np.uint64)
        if not len(grams) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.codes, grams)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == grams[known]
        rank = self.ranks[:, np.where(known, at, len(self.codes))]
        distance = np.where(rank < 0, PROFILE, np.abs(rank - np.arange(len(grams)))).sum(axis=1)
        best = int(np.argmin(distance))  # ties: the first language by name
        return self.langs[best], float(1 - distance[best] / (PROFILE * len(grams)))


def learn(docs: DataFrame) -> Profiles:
    """Profiles of all languages from every row with text and lang.

    To the driver come at most 16 x PROFILE n-grams of each language, whatever the corpus.
    """
    rows = docs.filter("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    counts = rows.mapInPandas(count_ngrams, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang", F.pmod("code", F.lit(_SALTS))).orderBy(F.desc("n"), "code")
    tops = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PROFILE).collect()
    by: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for r in tops:
        by[r["lang"]].append((-r["n"], r["code"]))
    return Profiles({lang: [code for _, code in sorted(x)[:PROFILE]] for lang, x in by.items()})


def prediction(text: Column, profiles: Profiles) -> Column:
    """A struct (lang_pred, score) of each text; only the texts go to Python."""

    @F.pandas_udf("lang_pred string, score double")
    def label(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])

    return label(text)


def held_out(doc_id: Column) -> Column:
    return crc_fold(doc_id) == 0


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, then predict every document.

    Returns doc_id, held_out, lang_pred, score (1: its n-grams stand as in the language's profile, 0: none do).
    Text that is null or has no letter gives `und` and 0, as does every text when nothing could be learned. Rows of
    null lang teach nothing; repeated rows count as often as they occur; further columns are ignored.
    """
    profiles = learn(docs.filter(~held_out(docs["doc_id"])))
    rows = docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), prediction(docs["text"], profiles).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


ORACLE = r"""
WITH
bits AS (
    SELECT doc_id, text, lang, flatten(list_transform(regexp_extract_all(doc_id::VARCHAR, '.'),
        lambda d: list_transform(range(8), lambda k: (ascii(d) >> k) & 1))) AS b
    FROM documents),
folds AS (
    SELECT doc_id, text, lang, xor(4294967295, list_reduce(b,
        lambda c, x: xor(c >> 1, CASE WHEN xor(c & 1, x) = 1 THEN 3988292384 ELSE 0 END), 4294967295)) % 5 = 0 AS held_out
    FROM bits),
chars AS (
    SELECT doc_id, list_concat([0::BIGINT], list_transform(regexp_extract_all(lower(text), '(?s).'),
        lambda x: CASE WHEN regexp_full_match(x, '\pL') THEN unicode(x)::BIGINT ELSE 0 END), [0::BIGINT]) AS c
    FROM documents WHERE text IS NOT NULL),
grams AS (
    SELECT doc_id, unnest(list_concat(
        list_transform(list_filter(c, lambda x: x > 0), lambda x: (x << 42) + 4398046511103),
        list_transform(list_filter(range(1, len(c)), lambda i: c[i] > 0 OR c[i + 1] > 0),
            lambda i: (c[i] << 42) + (c[i + 1] << 21) + 2097151),
        list_transform(list_filter(range(1, len(c) - 1), lambda i: c[i + 1] > 0),
            lambda i: (c[i] << 42) + (c[i + 1] << 21) + c[i + 2]))) AS code
    FROM chars),
counted AS (SELECT doc_id, code, count(*) AS n FROM grams GROUP BY ALL),
profiles AS (
    SELECT doc_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, code) - 1 AS place
    FROM counted QUALIFY place < 300),
learned AS (
    SELECT lang, code, sum(n) AS n FROM counted JOIN folds USING (doc_id)
    WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL),
langs AS (
    SELECT lang, code, row_number() OVER (PARTITION BY lang ORDER BY n DESC, code) - 1 AS place
    FROM learned QUALIFY place < 300),
sizes AS (SELECT doc_id, count(*) AS size FROM profiles GROUP BY doc_id),
met AS (
    SELECT p.doc_id, l.lang, sum(300 - abs(p.place - l.place)) AS gain
    FROM profiles p JOIN langs l USING (code) GROUP BY ALL),
distances AS (
    SELECT s.doc_id, l.lang, size, 300 * size - coalesce(gain, 0) AS distance
    FROM sizes s CROSS JOIN (SELECT DISTINCT lang FROM langs) l LEFT JOIN met m ON m.doc_id = s.doc_id AND m.lang = l.lang),
best AS (
    SELECT * FROM distances QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) = 1)
SELECT doc_id, held_out, coalesce(b.lang, 'und') AS lang_pred,
    coalesce(1 - distance::DOUBLE / (300 * size)::DOUBLE, 0.0) AS score
FROM folds LEFT JOIN best b USING (doc_id)
"""
