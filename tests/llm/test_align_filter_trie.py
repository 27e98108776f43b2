"""Token alignment, url verdicts and the prefix trie beside plain-Python counterparts."""

import functools
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from juryloom.llm import prefix_sums, prefix_trie, token_align, url_filter
from juryloom.llm.bpe import byte_alphabet
from juryloom.llm.common import hot_join, shared_dir
from pyspark.sql import functions as F

from .fixtures import frame, sentence, texts

ODD = [
    "▁x y", "a  b   c\td\n\n e ", "  lead", "trail  ", "日本語 テキスト ok", " nb sp", "a\x00b c", "<s> hi</s> <|endoftext|>", "word " * 50, "é é ﬁ ｆ",
    "tab\t x", "\x1c y \x85 z", "x" * 5000, " ", "\n",
]


# Operator 11


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    stand_in = byte_alphabet()
    a_bytes = {i: t.encode() if i == 50256 else bytes(stand_in[c] for c in t) for t, i in a.get_vocab().items()}
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in range(b.get_piece_size()))]
    return a, b, a_bytes, b_bytes


def aligned(tokenizers, some):
    """Rows as of op11 without doc_id, by a sweep over token ranges."""
    a, b, a_bytes, b_bytes = tokenizers
    found = []
    for text in some:
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw = (" " + text).encode() if text else None
        if not text or b"".join(a_bytes[i] for i in ids[0]) != raw or b"".join(b_bytes[i] for i in ids[1]) != raw:
            found.append(None)
            continue
        ranges = []
        for side, size in zip(ids, (a_bytes, b_bytes), strict=True):
            at, out = 0, []
            for i in side:
                out.append((at, at + len(size[i]), i))
                at += len(size[i])
            ranges.append(out)
        links, j = [], 0
        for start, end, i in ranges[0]:
            while ranges[1][j][1] <= start:
                j += 1
            k = j
            while k < len(ranges[1]) and ranges[1][k][0] < end:
                links.append((i, ranges[1][k][2]))
                k += 1
        groups, last = [], [0, 0]
        for cut in sorted({r[1] for r in ranges[0]} & {r[1] for r in ranges[1]}):
            part = []
            for s in (0, 1):
                begin = last[s]
                while last[s] < len(ranges[s]) and ranges[s][last[s]][1] <= cut:
                    last[s] += 1
                part.append(",".join(str(r[2]) for r in ranges[s][begin : last[s]]))
            groups.append("|".join(part))
        found.append((len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(x for f in found if f for x in f[3])
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[3]), sum(count[x] == most[x[1]] for x in f[3]), sum(count[x] for x in f[3]), f[4]) for f in found
    ]


def test_alignment_equals_a_sweep(spark, tokenizers):
    some = texts() + ODD
    got = {r["doc_id"]: tuple(r)[1:] for r in token_align.align_documents(frame(spark, some)).collect()}
    want = aligned(tokenizers, some)
    assert [got[3 * i + 1] for i in range(len(some))] == want
    assert any(w[2] == 0 for w in want) and sum(w[5] for w in want) > 10_000


def test_alignment_in_small_pieces_and_split_parts(spark, tokenizers, monkeypatch):
    """Blocks of few postings, texts cut often, a cache that overflows, parts over many salts: the same rows."""
    monkeypatch.setattr(token_align, "PART_POSTINGS", 50)
    monkeypatch.setattr(token_align, "_LOADED", {})
    aligner = token_align.Aligner(*token_align.default_files())
    monkeypatch.setattr(token_align, "STRETCHES", 40)
    monkeypatch.setattr(token_align, "TEXT_CHARS", 64)
    some = texts() + ODD
    for text in some[::3]:
        got, want = aligner.document(text), aligner.whole(text) if text else aligner.document(None)
        assert got[:5] == want[:5] and (got[5] == want[5]).all() and (got[6] == want[6]).all()
    got = {r["doc_id"]: tuple(r)[1:] for r in token_align.align_documents(frame(spark, some, 7)).collect()}
    assert [got[3 * i + 1] for i in range(len(some))] == aligned(tokenizers, some)


def test_alignment_of_awkward_rows(spark, tokenizers):
    big = 1 << 60
    rows = [(big + 1, "alpha beta", 1, 1, 1), (None, "alpha beta", 2, 2, 2), (big + 1, "alpha beta", 3, 3, 3), (big + 3, None, 4, 4, 4), (None, "", 5, 5, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int, part int, at int").coalesce(1)
    got = sorted((tuple(r) for r in token_align.align_documents(df).collect()), key=str)
    want = sorted(((r[0], *w) for r, w in zip(rows, aligned(tokenizers, [r[1] for r in rows]), strict=True)), key=str)
    assert got == want
    assert token_align.align_documents(df.limit(0)).collect() == []


def test_alignment_of_a_long_text(spark, tokenizers):
    rng = random.Random(5)
    long = " ".join(sentence(rng, 50) for _ in range(6000))
    assert len(long) > 2 * token_align.TEXT_CHARS
    aligner = token_align.Aligner(*token_align.default_files())
    got, want = aligner.document(long), aligner.whole(long)
    assert got[:5] == want[:5] and (got[5] == want[5]).all() and (got[6] == want[6]).all()


# Operator 12


def judged(pages, rules=url_filter.RULES):
    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        path = rest[end:]
        stop = min((path.find(c) for c in "?#" if c in path), default=len(path))
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]

    def rule_of(host, path):
        fits = [(v, r) for v, r in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return max(fits, key=lambda x: len(x[1]), default=(None, None))

    import re

    edges, seeds, rows = Counter(), {"trust": Counter(), "distrust": Counter()}, []
    for page_id, url, html in pages:
        host, path = parts(url)
        verdict, rule = rule_of(host, path)
        rows.append((page_id, host, path, rule, verdict))
        if verdict and host:
            seeds["trust" if verdict == "allow" else "distrust"][host] += 1
        for to in re.findall(r"""(?i)<a\s[^>]*href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)""", html or ""):
            to = to.lower()
            if host and to != host:
                edges[host, to] += 1
    masses = {}
    for kind, turn in (("trust", 1), ("distrust", -1)):
        ways = {k[::turn]: n for k, n in edges.items()}
        out = Counter()
        for (a, _), n in ways.items():
            out[a] += n
        start = {h: n * url_filter.MASS * 15 // 100 for h, n in seeds[kind].items()}
        now = dict(start)
        for _ in range(url_filter.STEPS):
            new = Counter(start)
            for (a, b), n in ways.items():
                new[b] += int(now.get(a, 0) * n * 85 / (100 * out[a]))
            now = {h: m for h, m in new.items() if m > 0}
        masses[kind] = now
    return [
        (i, h, p, r, v or ("block" if masses["distrust"].get(h, 0) > masses["trust"].get(h, 0) else "allow"), masses["trust"].get(h, 0), masses["distrust"].get(h, 0))
        for i, h, p, r, v in rows
    ]


def link(*hosts):
    return "<html>" + "".join(f'<p><a class="x" href="https://{h}/page?x=1">to</a></p>' for h in hosts) + '<a href="/own">own</a></html>'


PAGES = [
    (1, "http://good.com/a", link("friend.org", "friend.org", "other.org")),
    (2, "https://WWW.Example.com/en/x?y#z", link("friend.org")),
    (3, "https://a.example.com/en/x", None),
    (4, "https://www.example.com/en", ""),
    (5, "http://bad.net/es/1", link("unseen.org")),
    (6, "http://bad.net/de/1", link("bad.net")),
    (7, "http://points.org/x", link("bad.net")),
    (8, "http://farther.org/x", link("points.org", "Points.ORG")),
    (9, "http://friend.org/x", link("other.org")),
    (10, "http://good.com", None),
    (11, None, link("bad.net")),
    (12, "no scheme/es/", link("bad.net")),
    (None, "http://notnet/es/1", None),
    (13, "http://x://y/z", "<a href='//friend.org'>x</a>"),
    (13, "http://x://y/z", "<a href='//friend.org'>x</a>"),
    (14, "http://a?b/c", "<A HREF=http://friend.org>x</A>"),
    (15, "", "<a href=\"https://good.com\">\n</a>"),
    (16, "http://net/fr/é\n/x", None),
]


@pytest.mark.parametrize("few", [50_000, 0])
def test_verdicts_equal_plain_propagation(spark, few, monkeypatch):
    monkeypatch.setattr(url_filter, "hot_join", functools.partial(hot_join, few=few))
    df = spark.createDataFrame([(*p, "h", 1) for p in PAGES], "page_id long, url string, html string, host string, trust int").repartition(3)
    got = sorted((tuple(r) for r in url_filter.judge_urls(df).collect()), key=str)
    assert got == sorted(judged(PAGES), key=str)
    verdict = {r[0]: r[4] for r in got}
    assert verdict[7] == verdict[8] == "block" and verdict[6] == "block" and verdict[11] == "allow" and verdict[4] == "allow"
    assert url_filter.judge_urls(df.limit(0)).collect() == []


def test_longest_rule_wins(spark):
    rules = (("allow", "com/"), ("block", "a.com/"), ("allow", "com/x/"), ("block", "com/x/"))
    urls = ["http://a.com/x/", "http://b.com/x/", "http://b.com/", "http://b.com", "http://acom/"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id int, url string, html string")
    got = [(r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, rules).orderBy("page_id").collect()]
    assert got == [("a.com/", "block"), ("com/x/", "allow"), ("com/", "allow"), (None, "allow"), (None, "allow")]


# Operator 13


def built(rows, every=5, most=9):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        source = c - (abs(c) % every) * (1 if c >= 0 else -1)
        out[c] = own.get(source, [])[:h] + own[c][h:]
    return out


def trie_of(paths):
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        below[node] = (
            sum(below[c][0] for c in children[node]) if children[node] else 1,
            saved + sum(below[c][1] for c in children[node]),
            1 + sum(below[c][2] for c in children[node]),
        )
    return {
        (min(m), len(n)): (
            min(members[n[:-1]]) if n else None, len(m), len(children[n]), *below[n][:2],
            hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest(), below[n][2],
        )
        for n, m in members.items()
    }


def as_dict(nodes):
    return {
        (r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"], r["end_place"] - r["place"] + 1)
        for r in nodes.collect()
    }


def conversations(spark, rows, partitions=4):
    return spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id long, turn long, role string, text string, rank int, node string").repartition(partitions)


def some_rows():
    rng, rows = random.Random(3), []
    for c in [*range(-6, 40), 1 << 60, (1 << 60) + 1]:
        shared = rng.choice([None, "x", "y"])
        for t in range(rng.randrange(0, 14)):
            text = f"{shared} {t // 3}" if shared and rng.random() < 0.9 else rng.choice([None, "", "é", "own " * rng.randrange(4)])
            rows.append((c, rng.choice([t, t, None, 7]), rng.choice(["user", "assistant", None, ""]) if rng.random() < 0.3 else "user", text))
    rows += [(50 + i, 0, "user", "same") for i in range(30)] + [(90, t, "user", "same") for t in range(200)] + [(None, 1, "user", "lost")]
    rows += [(91, 3, "user", "same")] * 40 + [(92 + i, t, "user", "same") for i in range(5) for t in range(10 * i)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("few", [50_000, 0])
def test_trie_equals_plain_sets(spark, few, monkeypatch):
    monkeypatch.setattr(prefix_trie, "hot_join", functools.partial(hot_join, few=few))
    monkeypatch.setattr(prefix_trie, "LIST_CHARS", 10)
    rows = some_rows()
    nodes = prefix_trie.grafted_trie(conversations(spark, rows)).cache()
    assert as_dict(nodes) == trie_of(built(rows))
    places = sorted(r["place"] for r in nodes.collect())
    assert places == list(range(1, len(places) + 1))


def test_trie_without_grafting_and_preorder(spark):
    rows = some_rows()
    got = prefix_trie.prefix_trie(conversations(spark, rows))
    assert as_dict(got) == trie_of(built(rows, most=1))
    spans = sorted((r["place"], r["end_place"], r["depth"], r["conv_id"], r["parent_conv_id"]) for r in got.collect())
    stack = []
    for place, end, depth, conv, parent in spans:  # in preorder each node's parent is the last open node above it
        while stack and stack[-1][1] < place:
            stack.pop()
        assert end >= place and depth == len(stack) and (parent == stack[-1][2] if stack else parent is None)
        stack.append((place, end, conv))


def test_trie_of_turnless_and_empty_tables(spark):
    lone = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(lone, 1, "user", "a"), (lone, 2, "user", "b")]
    assert as_dict(prefix_trie.grafted_trie(conversations(spark, rows))) == trie_of(built(rows)) == trie_of({lone: []})
    assert prefix_trie.grafted_trie(conversations(spark, rows).limit(0)).collect() == []
    assert prefix_trie.prefix_trie(conversations(spark, [(None, 1, "a", "b")])).collect() == []


def test_running_sums_over_ranges(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, 5]), i, rng.randrange(-50, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, i long, v long").repartition(6)
    folder = shared_dir(spark)
    got = prefix_sums.running_sums(df, [F.asc("g"), F.asc("i")], {"s": "v"}, folder, "grouped", "g")
    total, want = Counter(), {}
    for g, i, v in sorted(rows):
        total[g] += v
        want[i] = total[g]
    assert {r["i"]: r["s"] for r in got.collect()} == want
    whole = prefix_sums.running_sums(df, [F.asc("i")], {"s": "v"}, folder, "whole")
    total, want = 0, {}
    for _, i, v in sorted(rows, key=lambda r: r[1]):
        total += v
        want[i] = total
    assert {r["i"]: r["s"] for r in whole.collect()} == want


# Ids of earlier operators


def test_wide_ids_beside_null_ones(spark):
    """Ids from 2^60 on stay what they are where a batch also holds a null id."""
    from juryloom.llm import bpe, lm_score, minhash, token_count

    big = 1 << 60
    rows = [(big + i, f"text number {i} of some words {'x' * i}") for i in range(6)] + [(None, "text of no id"), (big + 9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = sorted((r[0] for r in rows), key=str)
    for run in (token_count.count_documents, bpe.encode_digests, minhash.near_duplicates, lm_score.score_documents):
        got = run(df)
        assert dict(got.dtypes)["doc_id"] == "bigint"
        assert sorted((r["doc_id"] for r in got.collect()), key=str) == want, run.__name__
    near = minhash.near_duplicates(df).filter("doc_id is not null").collect()
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in near)


def test_shards_of_equal_first_ids_stay_apart(spark):
    from juryloom.llm import token_count

    texts_of = ["one"] * 4096 + ["a b c d e f"] * 4904
    df = spark.createDataFrame([(None, t) for t in texts_of], "doc_id long, text string").coalesce(1)
    got = token_count.count_documents(df).groupBy("n_tokens").count().collect()
    assert {r["n_tokens"]: r["count"] for r in got} == {1: 4096, 6: 4904}
