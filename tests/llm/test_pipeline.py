"""The pipeline's stages against plain counterparts on a small table, each judged on its own input."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from juryloom.llm import bpe, mixing
from juryloom.llm.common import shared_dir, materialize

from .fixtures import components, shingles


def table(spark, path):
    rng = random.Random(21)
    stems = {"en": "the and of water with house river stone".split(), "de": "der und das wasser mit haus fluss stein".split()}
    data = []
    for i in range(60):
        lang = ["en", "de"][i % 2]
        data.append((i, " ".join(rng.choice(stems[lang]) + rng.choice("abcdefgh") for _ in range(60)), lang, "s", 1))
    near = [(100 + i, data[i][1].replace("a ", "a x ", 1), data[i][2], "s", 1) for i in range(8)]
    same = [(200 + i, data[i][1] + "  ", data[i][2], "s", 1) for i in range(10, 16)]
    junk = [(300, None, "en", "s", None), (301, "", None, "s", 0), (302, "12 !! 34", "en", "s", 8)]
    rows = [*data, *near, *same, *junk]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages(spark, tmp_path):
    path = f"file://{tmp_path}"
    table(spark, path)
    docs, folder, seen = spark.read.parquet(f"{path}/documents.parquet"), shared_dir(spark), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = materialize(stage(spark, docs, path), folder, name)
        seen.append((name, before, docs.collect()))
    first = {r["doc_id"] for r in seen[0][1]}
    assert {r["doc_id"] for r in seen[0][2]} == first - {300, 301, 302}

    norm = lambda t: "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
    best: dict[str, tuple] = {}
    for r in seen[1][1]:
        k = norm(r["text"])
        best[k] = min(best.get(k, (1, 0)), (-len(r["text"]), r["doc_id"]))
    assert {r["doc_id"] for r in seen[1][2]} == {v[1] for v in best.values()}

    texts = {r["doc_id"]: r["text"] for r in seen[2][1]}
    sets = {k: shingles(t) for k, t in texts.items()}
    ids = sorted(sets)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    comp = components(ids, edges)
    assert edges and {r["doc_id"] for r in seen[2][2]} == {k for k, c in comp.items() if k == c}

    rates = mixing.mix_documents(spark.read.parquet(f"{folder}/minhash_near_dedup"), spark.read.parquet(f"{path}/labels.parquet")).collect()
    assert Counter(r["doc_id"] for r in seen[3][2]) == {r["doc_id"]: r["copies"] for r in rates if r["copies"]}

    enc = bpe.load(bpe.default_vocabulary())
    assert sorted((r["doc_id"], r["n_tokens"]) for r in seen[4][2]) == sorted((r["doc_id"], len(enc.encode(r["text"])) // 4) for r in seen[4][1])
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(list(rows[0].asDict()) == columns for _, rows, _ in seen)


def test_near_copies_from_080_on_go(spark):
    rng = random.Random(80)
    texts = {i: [f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(60)] for i in range(30)}
    for i in range(12):  # one word changed: 51 of 61 shingles, 0.836
        texts[100 + i] = [*texts[i][:30], "changed", *texts[i][31:]]
    for i in range(12, 20):  # two words changed: below 0.8
        texts[100 + i] = [*texts[i][:15], "changed", *texts[i][16:45], "twice", *texts[i][46:]]
    docs = spark.createDataFrame([(k, " ".join(w), "en") for k, w in texts.items()], "doc_id long, text string, lang string")
    sets = {k: shingles(" ".join(w)) for k, w in texts.items()}
    ids = sorted(sets)
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for i, a in enumerate(ids) for b in ids[i + 1 :]}
    assert sum(0.8 <= s < 0.85 for s in share.values()) == 12
    comp = components(ids, [p for p, s in share.items() if s >= 0.8])
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert {r["doc_id"] for r in kept.collect()} == {k for k, c in comp.items() if k == c}
    assert kept.columns == docs.columns
