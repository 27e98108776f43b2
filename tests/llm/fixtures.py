"""Small document tables with the awkward cases, and plain-Python counterparts of the operators."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

DDL = "doc_id long, text string, lang string, source string, n_chars long, digest string, row string, chunk int, bucket int, id string"
_WORDS = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta", "THETA", "iota", "kappa", "lambda", "mu", "straße", "nu", "xi"]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(_WORDS) + str(rng.randrange(400)) for _ in range(n))


def texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    base = [sentence(rng, rng.randrange(20, 160)) for _ in range(40)]
    passage = sentence(rng, 60)
    near = []
    for t in base[:12]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    chain = base[0].split(" ")
    out: list[str | None] = [*base, *near, *base[:5], base[3].replace(" ", "  \n"), base[4].upper().lower()]
    out += [" ".join(chain[: len(chain) - k]) for k in (1, 2, 3)]
    out += [f"{b[:60]} {passage} {b[60:]}" for b in base[20:26]]
    out += [None, "", " \t\n", "one two", "one two", "ONE two", "one two three", "one two three four", "a b c d e f", "😀 emoji " * 12, "x" * 300, "x" * 300, "<|endoftext|> inside", "12345 !!"]
    out.append(" ".join(sentence(rng, 40) for _ in range(150)) + "\n" + passage)
    return out


def rows(some: list[str | None], lang=lambda i: ["en", "de", None][i % 3]) -> list[tuple]:
    return [(i * 3 + 1, t, lang(i), "src", None if t is None else len(t), "d", "r", 1, 2, "i") for i, t in enumerate(some)]


def frame(spark, some: list[str | None] | None = None, partitions: int = 5):
    return spark.createDataFrame(rows(texts() if some is None else some), DDL).repartition(partitions)


def words(text: str | None) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text: str | None, width: int = 5) -> set[tuple[str, ...]]:
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def components(nodes: list[int], edges: list[tuple[int, int]]) -> dict[int, int]:
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out: dict[int, int] = {}
    for n in sorted(nodes):
        todo = [] if n in out else [n]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += near[x]
    return out
