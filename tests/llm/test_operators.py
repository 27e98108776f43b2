"""The corpus operators against brute force, libraries and exact round trips."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from juryloom.llm import bpe, common, components, exact_dedup, gru, langid, lm_score, minhash, mixing, paragraph_dedup, substring_dedup, suffix, token_count, topk

from juryloom.llm.common import word_hashes

from .fixtures import DDL, components as plain_components, crc, frame, rows, sentence, shingles, texts, words


def by_id(df) -> dict:
    got = df.collect()
    out = {r["doc_id"]: r for r in got}
    assert len(out) == len(got)
    return out


def plain(some=None):
    return {r[0]: r[1] for r in rows(texts() if some is None else some)}


def empty(spark):
    return spark.createDataFrame([], DDL)


# --- token counts ---------------------------------------------------------------------------------------------


def test_token_counts_match_encoding(spark):
    got = by_id(token_count.count_documents(frame(spark)))
    enc = bpe.load(bpe.default_vocabulary())
    assert {k: r["n_tokens"] for k, r in got.items()} == {k: len(enc.encode_ordinary(t or "")) // 4 for k, t in plain().items()}
    assert token_count.count_documents(empty(spark)).count() == 0


def test_separator_scan_stitches_blocks(spark):
    rng, sep, data, want = random.Random(4), 7, [], []
    for shard in ("a", "b", "c"):
        ids = [rng.choice([1, 2, 3, 7]) if shard != "b" else 3 for _ in range(500)]
        flat = np.array(ids, "<u2").tobytes()
        data += [(shard, i, flat[at : at + 14]) for i, at in enumerate(range(0, len(flat), 14))]
        size, no = 0, 0
        for x in ids:
            if x == sep:
                want.append((shard, no, size, True))
                size, no = 0, no + 1
            else:
                size += 1
        if size:
            want.append((shard, no, size, False))
    blocks = spark.createDataFrame([*data, ("d", 0, None)], "shard string, block long, tokens binary").repartition(4)
    assert sorted(map(tuple, token_count.token_counts(blocks, sep).collect())) == sorted(want)


def test_flat_files_are_read_by_spark(spark, tmp_path):
    ids = np.array([5, 6, 0, 0, 9, 9, 9, 0, 4], "<u2")
    (tmp_path / "x.bin").write_bytes(ids.tobytes())
    got = token_count.token_counts(token_count.read_blocks(spark, f"file://{tmp_path}/*.bin", block_tokens=2), 0).orderBy("doc_no")
    assert [(r["n_tokens"], r["complete"]) for r in got.collect()] == [(2, True), (0, True), (3, True), (1, False)]


def test_large_flat_files_are_read_in_ranges(spark, tmp_path):
    rng = np.random.default_rng(8)
    want = {}
    for name, size in (("a", 300_000), ("b", 65_536), ("c", 1), ("none", 0)):
        ids = rng.integers(0, 3000, size).astype("<u4")
        (tmp_path / f"{name}.bin").write_bytes(ids.tobytes())
        parts = np.split(ids, np.flatnonzero(ids == 7) + 1)
        want[name] = [len(p) - (p[-1:] == 7).sum() for p in parts if len(p)]
    blocks = token_count.read_blocks(spark, f"file://{tmp_path}/*.bin", itemsize=4, block_tokens=1000)
    assert blocks.groupBy("shard").count().count() == 3  # Spark lists no empty file; it has no documents
    got = token_count.token_counts(blocks, 7, itemsize=4).orderBy("shard", "doc_no").collect()
    found = {k: [r["n_tokens"] for r in got if r["shard"].endswith(f"/{k}.bin")] for k in want}
    assert found == want
    wide = token_count.write_flat(frame(spark), f"{spark.conf.get('spark.checkpoint.dir')}/wide", bpe.default_vocabulary(), 0, itemsize=4)[0]
    assert wide.agg(F.sum(F.length("tokens"))).first()[0] % 4 == 0


# --- suffix arrays --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", [b"banana", b"aaaaaaaaaaaaaaaaaaaaaaaaaa", b"\x00\x00a\x00\x00a\x00", b"x", b"abcabcabcabcabcabcabcabcabc"])
def test_suffix_array(text):
    got = suffix.suffix_array(np.frombuffer(text, np.uint8))
    assert list(got) == sorted(range(len(text)), key=lambda i: text[i:])


def brute_repeats(docs: dict[int, str | None]) -> dict[int, tuple]:
    first: dict[bytes, int] = {}
    data = {k: (t or "").encode() for k, t in docs.items()}
    for k in sorted(data):
        for i in range(len(data[k]) - 49):
            first.setdefault(data[k][i : i + 50], k)
    out = {}
    for k, d in data.items():
        gone = bytearray(len(d))
        for i in range(len(d) - 49):
            if first[d[i : i + 50]] < k:
                gone[i : i + 50] = b"\x01" * 50
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("chunk", "bucket_chars", "shard"), [(16_000_000, 16_000_000, 4_000_000), (3_000, 3_000, 500)])
def test_substring_removal_matches_brute_force(spark, monkeypatch, chunk, bucket_chars, shard):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(substring_dedup, "BUCKET_CHARS", bucket_chars)
    some = [*texts(), "ab" * 90, "ab" * 80, "\x00" * 120, "\x00" * 60]
    random.Random(2).shuffle(some)
    got = by_id(substring_dedup.remove_repeats(frame(spark, some)))
    want = brute_repeats(plain(some))
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in got.items()} == want
    assert sum(w[1] > 0 for w in want.values()) > 10
    runs = [t.encode()[:80] for t in some if t and len(t) > 90]
    runs = list(dict.fromkeys(runs))
    least = np.arange(len(runs))
    whole, cut = (substring_dedup.least_documents(runs, least, n) for n in (10**9, shard))
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_substring_removal_of_nothing(spark):
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


# --- paragraphs ------------------------------------------------------------------------------------------------


def mix(h: int) -> int:
    """The finaliser that word hashes and cuts share."""
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ h >> 33) * by % 2**64
    return h ^ h >> 33


def plain_paragraphs(text: str) -> list[tuple[int, int]]:
    """Paragraphs by the rules of the module's head, word by word."""
    h = [int(x) for x in word_hashes(text.encode())[0]]
    n = len(h)
    three = {i: mix(h[i - 1] * 3 % 2**64 ^ mix(h[i] * 5 % 2**64 ^ mix(h[i + 1]))) for i in range(1, n - 1)}
    r = range(1, paragraph_dedup.REACH + 1)
    at = [i for i in three if all(i - k in three and i + k in three and three[i] < three[i - k] and three[i] <= three[i + k] for k in r)]
    out, cut_short = set(), False
    for i in [0] * (n > 0) + at:
        end = min([e for e in at if e >= i + paragraph_dedup.PARAGRAPH_WORDS], default=n)
        if end < n or not cut_short:
            out.add((i, end))
        cut_short |= end == n
    for breaks in ("\n|\r(?!\n)", "(?:\n|\r(?!\n))[\\x20\\x09-\\x0D]*?(?:\n|\r(?!\n))"):
        i = 0
        for part in re.split(breaks, text):
            k = len(words(part))
            if k >= 5:
                out.add((i, i + k))
            i += k
    return sorted(out)


def brute_paragraphs(docs: dict[int, str | None]) -> dict[int, tuple]:
    """(repeated paragraphs, class, bytes and stretches removed, digest of the rest) by comparing all paragraphs' exact shingle sets."""
    pars, of_doc, place = [], {}, {}
    for k in sorted(docs):
        w = words(docs[k])
        hashes = word_hashes((docs[k] or "").encode())[0]
        of_doc[k] = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w], hashes
        for a, b in plain_paragraphs(docs[k] or ""):
            digest = hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest()
            pars.append((k, a, b, digest, {tuple(w[i : i + 5]) for i in range(a, b - 4)}))
            place.setdefault(digest, (k, a, b))
    full = [i for i, p in enumerate(pars) if p[4]]
    edges = [(i, j) for n, i in enumerate(full) for j in full[n + 1 :] if 100 * len(pars[i][4] & pars[j][4]) >= 80 * len(pars[i][4] | pars[j][4])]
    comp = plain_components(full, edges)
    first: dict[int, tuple] = {}
    for i in full:
        first[comp[i]] = min(first.get(comp[i], (2**63, b"")), (place[pars[i][3]][0], pars[i][3]))
    out = {}
    for k in docs:
        own = [(*pars[i][1:4], first[comp[i]]) for i in full if pars[i][0] == k and first[comp[i]][0] < k]
        data = (docs[k] or "").encode()
        _, begin, end = word_hashes(data)
        gone = {i for a, b, *_ in own for i in range(a, b)}
        more = set()
        for a, b, digest, (_, other) in own:
            x, i, j = place[digest if place[digest][0] < k else other]
            here, there = of_doc[k][0], of_doc[x][0]
            around, edge = paragraph_dedup.AROUND, paragraph_dedup.EDGE
            if a and a - 1 not in gone:
                n = beyond(here[max(0, a - around) : a][::-1], here[a:b][::-1], there[max(0, i - around) : min(j, i + edge)][::-1])
                more |= set(range(a - n, a))
            if b < len(here) and b not in gone:
                more |= set(range(b, b + beyond(here[b : b + around], here[a:b], there[max(i, j - edge) : j + around])))
        gone |= more
        mask = [False] * len(data)
        for i in gone:
            to = begin[i + 1] if i + 1 in gone else end[i]
            mask[begin[i] : to] = [True] * (to - begin[i])
        rest = bytes(c for c, m in zip(data, mask, strict=True) if not m)
        spans = sum(m and not p for m, p in zip(mask, [False, *mask], strict=False))
        out[k] = (len(own), min([p[3][0] for p in own], default=k), sum(mask), spans, hashlib.sha256(rest).hexdigest())
    return out


def beyond(outside: list[str], own: list[str], stays: list[str]) -> int:
    """Words of outside that go on as stays does after the last shingle that own, near its end, has in common with it."""
    for t in range(len(own), max(5, len(own) - paragraph_dedup.EDGE + 5) - 1, -1):
        for at in range(len(stays) - 4):
            if stays[at : at + 5] == own[t - 5 : t]:
                n = 0
                for x, y in zip(own[t:] + outside, stays[at + 5 :], strict=False):
                    if x != y:
                        break
                    n += 1
                return max(0, n - (len(own) - t))
    return 0


@pytest.mark.parametrize("chunk", [16_000_000, 3_000])
def test_paragraph_removal_matches_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(substring_dedup, "BUCKET_CHARS", 4_000)
    some = [t for t in texts() if len(t or "") < 10_000]
    some += [f"{some[1]}\r\n\r\n{some[2]}\n{some[3]}", f"{some[2]}\r{some[1]}\n \n{some[3]}"]
    random.Random(3).shuffle(some)
    docs = plain(some)
    got = by_id(paragraph_dedup.remove_paragraphs(frame(spark, some)))
    want = brute_paragraphs(docs)
    assert {k: (r["n_repeated"], r["class_id"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in got.items()} == want
    assert sum(w[2] > 0 for w in want.values()) > 15
    assert {k: (r["n_bytes"], r["n_paragraphs"]) for k, r in got.items()} == {k: (len((t or "").encode()), len(plain_paragraphs(t or ""))) for k, t in docs.items()}


def test_altered_long_paragraphs_and_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(paragraph_dedup, "BLOCK", 6)
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 9)))
    some, long = [], []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(90, 200))]
        some.append(" ".join(word() for _ in range(30)) + "\n" + " ".join(w))
        w[len(w) // 3] = w[2 * len(w) // 3] = "altered"
        some.append(" ".join(w) + "\n" + " ".join(word() for _ in range(30)))
        long.append(len(" ".join(w)))
    line = [word() for _ in range(40)]  # many variants of one line in the same buckets
    some += [" ".join([*line[:i], f"v{i}", *line[i + 1 :]]) for i in range(40)]
    got = by_id(paragraph_dedup.remove_paragraphs(frame(spark, some)))
    hit = [got[(2 * i + 1) * 3 + 1]["n_removed"] >= n for i, n in enumerate(long)]
    assert sum(hit) >= 0.9 * len(hit)
    assert all(got[i * 3 + 1]["class_id"] == 121 * 3 - 2 for i in range(121, 160))


def test_paragraphs_of_repeated_rows_and_null_ids(spark):
    text = sentence(random.Random(2), 40)
    docs = spark.createDataFrame([(4, text), (4, text), (None, text), (9, "x " + text), (1, None), (None, None)], "doc_id long, text string").repartition(3)
    for of in (paragraph_dedup.remove_paragraphs, substring_dedup.remove_repeats):
        got = sorted(((r["doc_id"], r["n_removed"] > 0) for r in of(docs).collect()), key=str)
        assert got == sorted([(4, False), (4, False), (None, True), (9, True), (1, False), (None, False)], key=str)


def test_planted_passages_are_found_wherever_they_stand(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    some, planted = [], 150
    for _ in range(planted):
        passage = prose(60)
        some += [f"{prose(rng.randrange(40, 90))} {passage} {prose(rng.randrange(40, 90))}" for _ in range(2)]
    some += [prose(120) for _ in range(100)]
    got = by_id(paragraph_dedup.remove_paragraphs(frame(spark, some)))
    flagged = {k for k, r in got.items() if r["n_removed"]}
    assert flagged <= {i * 3 + 1 for i in range(1, 2 * planted, 2)}
    assert len(flagged) >= 0.97 * planted
    assert paragraph_dedup.remove_paragraphs(empty(spark)).count() == 0


def test_short_passages_lines_and_changed_paragraphs_go_whole(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    some, size = [], []
    for i in range(90):
        kind, passage = ("within", "line", "paragraph")[i // 30], prose([rng.randrange(20, 56), rng.randrange(5, 13), 60][i // 30])
        between = {"within": " ", "line": "\n", "paragraph": "\n\n"}[kind]
        some.append(f"{prose(40)}{between}{passage}{between}{prose(40)}")
        if kind == "paragraph":  # 51 of 61 shingles, in two lines
            w = passage.split(" ")
            passage = " ".join(w[:30]) + "\nchanged " + " ".join(w[31:])
        some.append(f"{prose(40)}{between}{passage}{between}{prose(40)}")
        size.append(len(passage))
    got = by_id(paragraph_dedup.remove_paragraphs(frame(spark, some)))
    removed = [got[(2 * i + 1) * 3 + 1]["n_removed"] for i in range(90)]
    assert not any(got[2 * i * 3 + 1]["n_removed"] for i in range(90))
    # A paragraph that ends a word or two outside a passage is similar too.
    whole = [n <= r <= n + 30 for r, n in zip(removed, size, strict=True)]
    off = [(i, r, n) for i, (r, n) in enumerate(zip(removed, size, strict=True)) if not n <= r <= n + 30]
    assert sum(whole[:30]) >= 29 and all(whole[30:60]) and sum(whole[60:]) >= 29, str(off)


# --- language model -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("frequent", [1 << 18, 40])
def test_lm_base_scores_match_brute_force(spark, frequent):
    docs = plain()
    got = by_id(lm_score.score_documents(frame(spark), frequent))
    count = Counter(w for k, t in docs.items() if crc(k) != 1 for w in [*words(t), 0])
    n, v = sum(count.values()), len(count)
    for k, t in docs.items():
        tokens = [*words(t), 0]
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(k) == 1, len(tokens), sum(w in count for w in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), rel_tol=1e-9)
        assert r["score"] < 0
    assert lm_score.score_documents(empty(spark)).count() == 0


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    p = gru.fresh(np.full(gru.TOKENS, 1 / gru.TOKENS))
    docs = [rng.integers(0, gru.TOKENS, n).astype(np.int32) for n in (3, 70, 200)]
    model = gru.Trainer(p)
    before = gru.log_likelihoods(model.p, docs).sum()
    for _ in range(20):
        model.train(docs)
    assert gru.log_likelihoods(model.p, docs).sum() > before
    ends = [np.append(docs[1][:40], t).astype(np.int32) for t in range(gru.TOKENS)]
    whole = gru.log_likelihoods(model.p, ends) - gru.log_likelihoods(model.p, [docs[1][:40]])
    assert math.isclose(np.exp(whole).sum(), 1, rel_tol=1e-3)


def test_lm_gradients(monkeypatch):
    """A step of truncated backpropagation moves parameters as finite differences say."""
    rng = np.random.default_rng(1)
    p = gru.fresh(np.full(gru.TOKENS, 1 / gru.TOKENS))
    docs = [rng.integers(0, gru.TOKENS, 6).astype(np.int32) for _ in range(3)]
    grads: dict = {}

    def note(self, k, grad, where=slice(None)):
        grads.setdefault(k, np.zeros(self.p[k].shape))[where] += grad

    monkeypatch.setattr(gru.Trainer, "_move", note)
    gru.Trainer(p).train(docs)
    for k, at in (("u", (2, 3)), ("u", (1, 20)), ("u", (4, 40)), ("c", (3, 5)), ("x", (gru.START, 35))):
        loss = []
        for eps in (0.02, -0.02):
            q = {n: a.astype(np.float64) for n, a in p.items()}
            q[k][at] += eps
            loss.append(-gru.log_likelihoods(q, docs).sum() / 6)
        assert math.isclose((loss[0] - loss[1]) / 0.04, grads[k][at], rel_tol=0.03, abs_tol=2e-4), k


def test_lm_likelihoods_match_a_plain_recurrent_model():
    """Step by step in double precision, over texts of several windows and with the lanes' states carried."""
    rng = np.random.default_rng(5)
    p = gru.fresh(rng.dirichlet(np.ones(gru.TOKENS)))
    p = {k: a + rng.normal(0, 0.3, a.shape) * (k in ("x", "u", "c", "w")) for k, a in p.items()}
    docs = [rng.integers(0, gru.TOKENS, n).astype(np.int32) for n in (1, 31, 32, 33, 100, 150)]
    size, words = gru.HIDDEN, gru.CLASS_WORDS

    def log_softmax(logits):
        return logits - logits.max() - np.log(np.exp(logits - logits.max()).sum())

    def plain_score(doc):
        h, token, total = np.zeros(size), gru.START, 0.0
        for y in doc:
            gates, carried = p["x"][token], h @ p["u"]
            r, z = (1 / (1 + np.exp(-(gates[i : i + size] + carried[i : i + size]))) for i in (0, size))
            new = np.tanh(gates[2 * size :] + r * carried[2 * size :])
            h = (1 - z) * new + z * h
            kind = y // words if y < gru.SHORTLIST else gru.WORD_CLASSES + y - gru.SHORTLIST
            total += log_softmax(h @ p["c"] + p["cb"])[kind]
            if y < gru.SHORTLIST:
                own = slice(kind * words, (kind + 1) * words)
                total += log_softmax(p["w"][own] @ h + p["wb"][own])[y % words]
            token = y
        return total

    got = gru.log_likelihoods({k: a.astype(np.float32) for k, a in p.items()}, docs)
    assert np.allclose(got, [plain_score(d) for d in docs], rtol=1e-4)


def test_lm_scores_do_not_hang_on_the_layout_and_beat_the_base(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(lm_score.train, "__defaults__", (20_000,))  # several parts
    monkeypatch.setattr(lm_score, "MEAN_PARTS", 2)
    one, other = (by_id(lm_score.score_documents(d)) for d in (docs.coalesce(1), docs.orderBy(F.desc("text")).repartition(7)))
    assert one.keys() == other.keys()
    for k, r in one.items():
        assert math.isclose(r["score"], other[k]["score"], rel_tol=1e-3)
        assert (r["n_tokens"], r["n_known"]) == (other[k]["n_tokens"], other[k]["n_known"])
    unseen = [r for r in one.values() if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


# --- exact dedup ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup_matches_brute_force(spark, digest_bytes):
    docs = plain()
    got = by_id(exact_dedup.exact_dedup(frame(spark), digest_bytes))
    groups: dict[str, list] = {}
    norm = {k: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r") for k, t in docs.items()}
    for k, t in docs.items():
        groups.setdefault(norm[k], []).append((-len(t or ""), k))
    for k in docs:
        g, r = groups[norm[k]], got[k]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(g)[1], len(g), min(g)[1] == k)
        assert r["text_sha256"] == hashlib.sha256(norm[k].encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_of_repeated_rows_and_null_ids(spark):
    data = [(5, "a  b"), (5, "a  b"), (7, "ab"), (None, "a   b"), (None, "c"), (None, "c"), (8, None), (8, None), (9, "d"), (5, "e"), (5, "e"), (3, "d")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(data)], "doc_id long, text string, row int").repartition(4)
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs).collect()]
    want = [(5, None, 4, False)] * 2 + [(7, None, 4, False), (None, None, 4, True), (None, None, 2, True), (None, None, 2, False)]
    want += [(8, 8, 2, True), (8, 8, 2, False), (3, 3, 2, True), (9, 3, 2, False), (5, 5, 2, True), (5, 5, 2, False)]
    assert Counter(got) == Counter(want)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(None, "a   b"), (None, "c"), (8, None), (3, "d"), (5, "e")], key=str)


def test_exact_dedup_compacts_many_runs(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MEMTABLE_ROWS", 7)
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 3)
    some = [["same text", "same  text", "other"][i % 3] for i in range(90)]
    got = by_id(exact_dedup.exact_dedup(frame(spark, some, 3)))
    assert Counter(r["keep_id"] for r in got.values()) == {4: 60, 7: 30}


def test_ids_beyond_double_precision(spark):
    big = 2**60
    docs = spark.createDataFrame([(big + i, "same" if i % 2 else f"own {i}") for i in range(6)], "doc_id long, text string")
    got = by_id(exact_dedup.exact_dedup(docs))
    assert {k - big: r["keep_id"] - big for k, r in got.items()} == {0: 0, 1: 1, 2: 2, 3: 1, 4: 4, 5: 1}
    assert sorted(by_id(token_count.count_documents(docs))) == [big + i for i in range(6)]


# --- top-k search ---------------------------------------------------------------------------------------------


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(260, 12)).astype(np.float32)
    x[40:60] = x[20]
    data = [(i, [float(v) for v in r], "lang", 5) for i, r in enumerate(x)]
    data += [(1000, None, "x", 1), (1050, [None, *[1.0] * 11], "x", 1), (1100, [float("nan"), *[1.0] * 11], "x", 1), (None, [1.0] * 12, "x", 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, block string, n int").repartition(3)
    got = topk.top_k(df, df["vec_id"] % 20 == 0, vector_block=64, query_block=5)
    q = np.floor(256.0 * x.astype(np.float64)).astype(np.int64)
    want = set()
    for i in range(0, 260, 20):
        score = q @ q[i]
        best = sorted((j for j in range(260) if j != i), key=lambda j: (-score[j], j))[:5]
        want |= {(i, n + 1, j, int(score[j])) for n, j in enumerate(best)}
    assert set(map(tuple, got.collect())) == want
    few = df.filter("vec_id < 3")
    assert topk.top_k(few, few["vec_id"] == 0).count() == 2
    none = df.filter("vec_id < 0")
    assert topk.top_k(none, none["vec_id"] == 0).count() == 0


# --- near-duplicates ------------------------------------------------------------------------------------------


def brute_near(docs: dict[int, str | None], percent: int) -> dict[int, int]:
    sets = {k: shingles(t) for k, t in docs.items()}
    ids = sorted(k for k, s in sets.items() if s)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return plain_components(list(docs), edges)


@pytest.mark.parametrize(("block", "percent"), [(512, 85), (3, 80)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block, percent):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(9)
    some = texts()
    start = some[7].split(" ")
    for _ in range(30):  # a drifting chain in which far members are not linked directly
        start = list(start)
        start[rng.randrange(len(start))] = f"w{rng.randrange(10**6)}"
        some.append(" ".join(start))
    docs = plain(some)
    got = by_id(minhash.near_duplicates(frame(spark, some), percent))
    want = brute_near(docs, percent)
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert all(r["n_shingles"] == len(shingles(docs[k])) and r["kept"] == (want[k] == k) for k, r in got.items())
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_long_path(spark, tmp_path):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), str(tmp_path))
    assert {r["node"]: r["component"] for r in got.collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# --- BPE ------------------------------------------------------------------------------------------------------


def test_bpe_matches_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_vocabulary())
    lib.no_truncation()
    lib.no_padding()
    rng = random.Random(5)
    odd = ["".join(rng.choice("ab \n\t'sé中 1²Ⅷ ​　́😀-_") for _ in range(80)) for _ in range(150)]
    some = [*texts(), *odd, "don't we'll I'M", "   leading", "trailing   ", "a\r\nb", "\x1c\x85x", "aaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "<|endoftext|>" * 2]
    docs = plain(some)
    got = by_id(bpe.encode_digests(frame(spark, some)))
    whole = by_id(bpe.encode_documents(frame(spark, some)))
    for k, t in docs.items():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        r = got[k]
        raw = np.array(ids, "<u4").tobytes()
        assert whole[k]["ids"] == raw, t
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(raw).hexdigest())
        text = lib.decode(ids, skip_special_tokens=False)
        assert whole[k]["decoded"] == text == (t or "")
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_digests(empty(spark)).count() == 0


# --- mixing ---------------------------------------------------------------------------------------------------


def test_mixing_meets_targets(spark):
    rng = random.Random(8)
    data, labels = [], []
    for i in range(600):
        kind = rng.choice([0, 0, 0, 0, 1, 2])
        w = [rng.choice(["good", "fine", "text", "word", *(["clear", "sound"] * 2 if kind == 0 else []), *(["bad", "junk"] * 2 if kind == 1 else []), *(["vile", "nasty"] * 3 if kind == 2 else [])]) for _ in range(rng.randrange(10, 80))]
        data.append((i, " ".join(w), "en", 1))
        if i % 2:
            labels.append((i, int(kind != 1), int(kind == 2)))
    docs = spark.createDataFrame([*data, (600, None, None, None), (601, "", "x", 3)], "doc_id long, text string, rate string, copies int")
    marks = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (7777, 1, 1)], "doc_id long, quality int, toxic int")
    got = mixing.mix_documents(docs, marks).toPandas()
    assert len(got) == 602 and (got["rate"] >= 0).all() and np.allclose(got[["p_high", "p_low", "p_toxic"]].sum(axis=1), 1)
    total = got["n_tokens"].sum()
    want = [x * mixing.BUDGET * total for x in mixing.TARGETS.values()]
    have = [(got["rate"] * got["n_tokens"] * got[f"p_{d}"]).sum() for d in mixing.TARGETS]
    assert np.allclose(have, want, rtol=1e-3)
    assert abs((got["copies"] * got["n_tokens"]).sum() / (got["rate"] * got["n_tokens"]).sum() - 1) < 0.1
    mixed = mixing.apply_mix(docs, marks)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == {i: n for i, n in zip(got["doc_id"], got["copies"], strict=True) if n}
    none = mixing.mix_documents(docs.limit(0), marks.limit(0))
    assert none.count() == 0
    assert mixing.mix_documents(docs, marks.limit(0)).count() == 602
    assert (got["shortfall"] < 1e-3).all()
    plain_posteriors(docs, marks, got)
    # Each domain's weights are in the plan once, but for the first domain's, which are 0.
    fitted = mixing.fit(docs, marks)
    spelled = fitted.classifier.with_posteriors(docs.select("doc_id", mixing.buckets(mixing.words(docs["text"])).alias("found")), "found")
    assert spelled._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == len(mixing.TARGETS) - 1


def plain_posteriors(docs, marks, got):
    """Naive Bayes by dictionaries; every labelled row is within the sample's bound here."""
    marked: dict[int, list] = {}
    for r in marks.collect():
        if None not in (r["doc_id"], r["quality"], r["toxic"]):
            marked.setdefault(r["doc_id"], []).append(r)
    kinds = {i: 2 if any(r["toxic"] == 1 for r in rs) else 1 if any(r["quality"] == 0 for r in rs) else 0 for i, rs in marked.items()}
    spark_hash = lambda x: (xxhash.xxh64(x.encode(), seed=42).intdigest() + 2**63) % 2**64 - 2**63
    found = {}
    for r in docs.collect():
        w = [x for x in re.split("[\x20\x09-\x0D]+", (r["text"] or "").lower()) if x]
        found[r["doc_id"]] = {spark_hash(x) % mixing.WORD_BUCKETS for x in w} | {mixing.WORD_BUCKETS + spark_hash(x[-1]) % mixing.SHAPE_BUCKETS for x in w}
    n = [sum(k == d and i in found for i, k in kinds.items()) for d in range(3)]
    seen = [Counter(b for i, k in kinds.items() if k == d and i in found for b in found[i]) for d in range(3)]
    logs: list[dict] = [{}, {}, {}]
    for b in set().union(*seen):
        every = sum(s[b] for s in seen)
        both = (every + 0.5) / (sum(n) + 1)
        for d in range(3):
            own, rest = (seen[d][b] + 0.5) / (n[d] + 1), (every - seen[d][b] + 0.5) / (sum(n) - n[d] + 1)
            error = math.sqrt(both * (1 - both) * (1 / (n[d] + 1) + 1 / (sum(n) - n[d] + 1)))
            logs[d][b] = math.log(own / rest) if abs(own - rest) >= mixing.LEAST_Z * error else 0.0
    none = [0.5 / (n[d] + 1) for d in range(3)], [0.5 / (sum(n) - n[d] + 1) for d in range(3)]
    assert all(abs(a - b) < mixing.LEAST_Z * 0.01 for a, b in zip(*none, strict=True))  # buckets that no label has count for nothing
    for r in got.to_dict("records"):
        s = [math.log((n[d] + 1) / (sum(n) + 3)) + sum(logs[d].get(b, 0.0) for b in found[r["doc_id"]]) for d in range(3)]
        odds = [math.exp(x - max(s)) for x in s]
        assert np.allclose([r["p_high"], r["p_low"], r["p_toxic"]], np.array(odds) / sum(odds), atol=1e-4)


def test_top_k_of_repeated_rows_in_several_partitions(spark):
    rng = random.Random(5)
    data = [(i, [float(rng.randrange(-9, 9)) for _ in range(6)]) for i in range(120)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    twice = df.union(df.filter("vec_id % 20 <> 0")).union(df.filter("vec_id = 7"))
    got = topk.top_k(twice, twice["vec_id"] % 20 == 0, scale=1.0, vector_block=16)
    copies = {i: 1 + (i % 20 != 0) + (i == 7) for i, _ in data}
    want = []
    for q, x in data[::20]:
        every = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in data if i != q for _ in range(copies[i]))[:5]
        want += [(q, rank + 1, i, -int(s)) for rank, (s, i) in enumerate(every)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_threshold_stops_before_all_rows_are_scored():
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((4000, 2)) * 100).astype(np.int64)
    lists = topk.SortedLists(np.arange(4000), x)
    shares = []
    for q in range(50):
        ids, score, scored = lists.top(q, x[q], 5)
        every = x @ x[q]
        every[q] = -(10**12)
        order = np.lexsort((np.arange(4000), -every))[:5]
        assert ids.tolist() == order.tolist() and score.tolist() == every[order].tolist()
        assert len(lists.top(q, x[q], 5, least=int(every.max()) + 1)[0]) <= 5
        shares.append(scored / 4000)
    assert np.mean(shares) < 0.5


# --- language identification ----------------------------------------------------------------------------------


def out_of_place(text: str, tops: dict[str, list[tuple[str, ...]]]) -> str:
    own = plain_profile([text])
    cost = {lang: sum(abs(t.index(g) - i) if g in t else langid.PROFILE for i, g in enumerate(own)) for lang, t in tops.items()}
    return min(sorted(cost), key=cost.get)


def plain_profile(some: list[str]) -> list[tuple]:
    count: Counter = Counter()
    for t in some:
        c = [x if x.isalpha() else "" for x in f" {t.lower()} "]
        code = [ord(x) if x else 0 for x in c]
        none = 0x1FFFFF
        count.update((x, none, none) for x in code if x)
        count.update((a, b, none) for a, b in zip(code, code[1:], strict=False) if a or b)
        count.update(x for x in zip(code, code[1:], code[2:], strict=False) if x[1])
    return [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[: langid.PROFILE]]


def test_language_matches_brute_force(spark):
    stems = {"aa": "the and of water with", "bb": "der und das wasser mit", "cc": "le et de eau avec"}
    rng = random.Random(6)
    some = [(" ".join(rng.choice(stems[g].split()) for _ in range(30))) for _ in range(20) for g in stems] + [None, "", "12 !!", "Ω"]
    langs = ["aa", "bb", "cc"] * 20 + ["aa", "bb", None, "cc"]
    data = rows(some, lambda i: langs[i])
    docs = spark.createDataFrame(data, DDL)
    got = by_id(langid.identify(docs))
    train = [r for r in data if crc(r[0]) != 0 and r[1] is not None and r[2] is not None]
    tops = {g: plain_profile([r[1] for r in train if r[2] == g]) for g in stems}
    for doc_id, text, *_ in data:
        r = got[doc_id]
        assert r["held_out"] == (crc(doc_id) == 0) and 0 <= r["score"] <= 1
        assert r["lang_pred"] == (out_of_place(text, tops) if text and any(c.isalpha() for c in text) else "und")
    assert langid.identify(empty(spark)).count() == 0


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    assert got.filter("lang = lang_pred").count() >= 0.95 * got.count()


def test_paragraph_groups_of_equal_members_are_kept_once():
    """Groups of equal members come from several band keys; blocks of large groups are told apart by their key."""
    big = paragraph_dedup.BLOCK + 3
    keys = np.array([5, 5, 9, 9, 7, 7, 7, 1] + [11] * big + [12] * big, np.uint64)
    reps = np.array([1, 2, 2, 1, 1, 2, 3, 4] + list(range(big)) * 2, np.int64)
    part = pd.DataFrame({"part": 0, "keys": [keys[:3].tobytes(), keys[3:].tobytes()], "reps": [reps[:3].tobytes(), reps[3:].tobytes()]})
    groups = paragraph_dedup._groups(part).sort_values(["whole", "first", "second", "k"], ignore_index=True)
    halves = [groups[:2].reset_index(drop=True), groups[2:].reset_index(drop=True)]
    got = pd.concat(paragraph_dedup._members(iter(halves)))
    assert {k: sorted(own["rep"]) for k, own in got.groupby("k")} == {5: [1, 2], 7: [1, 2, 3], 11: list(range(big)), 12: list(range(big))}
    assert sorted(got[got["k"] == 11]["block"].unique()) == [0, 1]


def test_repeated_paragraphs_move_packed(spark, monkeypatch, tmp_path):
    """Contents go as a row for each chunk and part, also where every paragraph of a corpus is repeated."""
    rng = random.Random(5)
    lines = ["\n".join(sentence(rng, 12) for _ in range(40)) for _ in range(6)]
    monkeypatch.setattr(paragraph_dedup, "shared_dir", lambda spark: str(tmp_path / "shared"))
    got = by_id(paragraph_dedup.remove_paragraphs(frame(spark, lines * 3)))
    assert sum(r["n_repeated"] for r in got.values()) > 500
    written = {t: spark.read.parquet(str(tmp_path / "shared" / t)) for t in ("candidates", "classes")}
    chunks = written["candidates"].select("chunk").distinct().count()
    assert all(t.count() <= chunks * (8 + 1) for t in written.values())


def test_paragraph_buckets_grow_in_size_at_last():
    assert [paragraph_dedup.shingle_buckets(n) for n in (1, 512, 2_700, 4_096, 40_000)] == [1, 512, 512, 512, 5_000]


def test_classes_of_contents_and_answers_match_plain_ones():
    rng = np.random.default_rng(9)
    digests = rng.integers(0, 2**64, (40, 2), dtype=np.uint64)
    digests[1:4, 0] = digests[0, 0]  # told apart by the second half alone
    digests = digests[np.lexsort((digests[:, 1], digests[:, 0]))]
    ids = np.array([-(2**63), -5, 3, 7, 2**61, substring_dedup.LAST_ID])
    rows, held = [], {}
    for chunk in (9, 2, 5):
        some = np.flatnonzero(rng.random(40) < 0.6)
        two = np.sort(rng.choice(ids, (len(some), 2)), axis=1)
        with np.errstate(over="ignore"):
            columns = {"digest": digests[some], "least": two[:, 0], "spread": two[:, 1] - two[:, 0]}
        columns |= {"doc": some * 2, "first": some * 3, "words": some + 8}
        cut = len(some) // 2
        rows += [(chunk, 4, a, paragraph_dedup._pack(paragraph_dedup._CONTENT, columns, slice(a, b))) for a, b in ((cut, len(some)), (0, cut))]
        for number, (d, (least, most)) in enumerate(zip(some.tolist(), two.tolist(), strict=True)):
            held.setdefault(d, []).append((least, chunk, number, most))
    part = pd.DataFrame(rows, columns=["chunk", "part", "base", "contents"])
    rep = {d: min(x)[1] << paragraph_dedup.NUMBER_BITS | min(x)[2] for d, x in held.items()}

    classes = paragraph_dedup._classes(part)
    found = paragraph_dedup._places(classes.assign(rep=-1), False)
    assert dict(zip(map(tuple, found["digest"].tolist()), zip(found["rep"], found["own"], found["doc"], found["first"], found["words"], strict=True), strict=True)) == {
        tuple(digests[d].tolist()): (rep[d], min(x)[0], 2 * d, 3 * d, d + 8) for d, x in held.items()
    }
    assert classes["n"].sum() == len(held)

    others = {d: (-(2**63), 77) for d in list(held)[::3]}
    asked = pd.DataFrame([(4, rep[d], *x) for d, x in others.items()], columns=["part", "rep", "component_least", "first_rep"])
    for given in (asked, asked[:0]):
        want = set()
        for d, x in held.items():
            least, first = others[d] if len(given) and d in others else (min(x)[0], rep[d])
            want |= {(chunk, number, rep[d], min(x)[0], least, first) for _, chunk, number, most in x if most > least}
        got = set()
        for r in paragraph_dedup._answers(part, given).itertuples():
            told, n = paragraph_dedup._unpack(paragraph_dedup._ANSWER, [r.answers])
            got |= set(zip([r.chunk] * n[0], *(told[c].tolist() for c in ("number", "rep", "own", "component_least", "first_rep")), strict=True))
        assert got == want and want


def test_bucket_links_connect_what_similar_sets_connect():
    rng = np.random.default_rng(4)
    sets, group, second = [], [], []
    for g in range(30):
        size = int(rng.choice([1, 9, 40, 300]))
        base = rng.integers(1, 2**64, size, dtype=np.uint64)
        for k in range(int(rng.choice([2, 5, 90]))):
            own = base.copy()
            own[: int(size * rng.choice([0, 0.05, 0.3]))] += np.uint64(k)
            sets.append(np.unique(own))
            group.append(g)
            second.append(g % 3 == 0 and k >= 1)
    group, second, ids = np.array(group), np.array(second), np.arange(len(sets)) * 5
    found = paragraph_dedup.bucket_links(group, second, ids, sets)
    near = []
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            if group[i] == group[j] and (group[i] % 3 or second[i] != second[j]):
                both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
                near += [(ids[i], ids[j])] * (100 * both >= paragraph_dedup.PERCENT * (len(sets[i]) + len(sets[j]) - both))
    assert set(found) <= set(near)
    assert plain_components(ids.tolist(), found) == plain_components(ids.tolist(), near)


def test_texts_hashed_together_have_their_own_hashes(monkeypatch):
    monkeypatch.setattr(common, "TOGETHER_BYTES", 40)
    texts = [b"", b"One two", b" \n ", b"x" * 50, b"three\r\nFour five six seven eight", b"end"]
    got = list(common.hashed_texts(texts, lambda words: words + np.uint64(1)))
    assert [g[0] for g in got] == texts
    for data, words, first, last, made in got:
        for x, y in zip((words, first, last), common.word_hashes(data), strict=True):
            assert x.tolist() == y.tolist()
        assert made.tolist() == (words + np.uint64(1)).tolist()


def test_lm_words_of_texts_hashed_together():
    some = [b"", b"One two", b" \n ", b"three\r\nFour!", b"end"]
    words, tails, size = lm_score.hashed(some)
    assert size.tolist() == [1, 3, 1, 3, 2]
    alone = [lm_score.hashed([t]) for t in some]
    assert words.tolist() == [w for x in alone for w in x[0].tolist()] and tails.tolist() == [w for x in alone for w in x[1].tolist()]
    assert (words[np.cumsum(size) - 1] == lm_score.END).all() and words[1] == word_hashes(b"one")[0][0]


def test_lm_scoring_states_are_those_of_training():
    rng = np.random.default_rng(3)
    params = gru.fresh(np.full(gru.TOKENS, 1 / gru.TOKENS))
    inputs = rng.integers(0, gru.TOKENS + 1, (gru.WINDOW, 5)).astype(np.int32)
    h = rng.standard_normal((5, gru.HIDDEN)).astype(np.float32)
    assert np.allclose(gru._states(params, inputs, h), gru._forward(params, inputs, h, False)[0], atol=1e-6)
    logits = rng.standard_normal((40, 9)).astype(np.float32) * 50
    chosen = rng.integers(0, 40, 9)
    assert np.allclose(gru._log_softmax(logits.copy(), chosen), gru._softmax(logits.T, chosen)[0], atol=1e-4)
