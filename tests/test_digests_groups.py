"""Digest trees and paged groups against plain computations, over layouts and hot groups."""

import hashlib
import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from juryloom.operators import corpus, digests, groups

from .test_labelling import talk


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(rows, leaf):
    lines = Counter(sha(f"{k or ''}:{sha(t or '')}") for k, t in rows)
    depth = digests.depth_of(len(lines), leaf)
    level = {}
    for line, n in sorted(lines.items()):
        level.setdefault(line[:depth], []).append((line, n))
    nodes = {p: (sum(n for _, n in found), sha("\n".join(f"{x}:{n}" for x, n in found))) for p, found in level.items()}
    tree = dict(nodes)
    for size in reversed(range(depth)):
        up = {p: list(g) for p, g in itertools.groupby(sorted(nodes), key=lambda p: p[:size])}  # noqa: B023
        nodes = {p: (sum(nodes[c][0] for c in g), sha("\n".join(f"{c}:{nodes[c][1]}" for c in g))) for p, g in up.items()}
        tree |= nodes
    return tree


def table(spark, rows, parts=1):
    return spark.createDataFrame(rows, "k string, t string").withColumn("n_rows", F.lit("x")).repartition(parts)


def test_tree_is_the_plain_one_over_layouts(spark):
    rows = [(f"k{i}", f"text {i % 7}") for i in range(300)] + [("k1", "text 1")] * 200 + [(None, None), ("", ""), (None, "a")]
    want = plain_tree(rows, 4)
    assert max(map(len, want)) == 2
    for parts in (1, 9):
        got = {r["prefix"]: (r["n_rows"], r["digest"]) for r in digests.digest_tree(table(spark, rows, parts), "k", "t", 4).collect()}
        assert got == want


def test_empty_table_has_the_empty_texts_hash(spark):
    tree = digests.digest_tree(table(spark, []), "k", "t")
    assert tree.count() == 0 and digests.root_digest(tree) == sha("")


def test_fingerprint_knows_ids_texts_and_counts(spark):
    docs = talk(spark, "Client: a", "Client: b")
    first = corpus.dataset_fingerprint(docs)
    assert first == corpus.dataset_fingerprint(docs.repartition(5))
    assert first != corpus.dataset_fingerprint(docs.unionByName(docs.limit(1)))
    assert first != corpus.dataset_fingerprint(docs.withColumn("file_id", F.concat("file_id", F.lit("x"))))


def test_differing_ranges_hold_what_changed(spark):
    rows = [(f"k{i}", "t") for i in range(400)]
    other = [r for r in rows if r[0] != "k7"] + [("k9", "changed"), ("new", "t")]
    tree = lambda r: digests.digest_tree(table(spark, r), "k", "t", 8)
    assert digests.differing(tree(rows), tree(list(reversed(rows)))).count() == 0
    found = {r["prefix"]: (r["left_rows"], r["right_rows"]) for r in digests.differing(tree(rows), tree(other)).collect()}
    assert set(found) == {sha(f"{k}:{sha(t)}")[:2] for k, t in (("k7", "t"), ("k9", "changed"), ("new", "t"))}
    assert sum(b - a for a, b in found.values()) == 1
    less = digests.differing(tree(rows), tree([]))  # at the root: the other has no nodes
    assert [tuple(r) for r in less.collect()] == [("", 400, 0)]


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_pages_of_a_hot_group(spark, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        rows = [(i, "hot") for i in range(1000)] + [(i, f"t{i // 3}") for i in range(1000, 1100)] + [(5, "hot")] * 50 + [(None, "hot"), (2000, None), (2001, None)]
        df = spark.createDataFrame(rows, "id long, t string").withColumns({"page": F.lit("x"), "members": F.lit(0)}).repartition(6)
        got = groups.content_pages(df, "id", F.coalesce("t", F.lit("")), 30).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for i, t in set(rows):
        if i is not None:
            want.setdefault(sha(t or ""), []).append(i)
    want = {h: sorted(ids) for h, ids in want.items() if len(ids) > 1}
    pages = {(r["content_hash"], r["page"]): r for r in got}
    assert len(pages) == len(got)
    assert set(pages) == {(h, p) for h, ids in want.items() for p in range((len(ids) + 29) // 30)}
    for (h, p), r in pages.items():
        assert (r["ids"], r["members"]) == (want[h][30 * p : 30 * p + 30], len(want[h]))


def test_dialogues_are_grouped_once_cleaned(spark):
    docs = talk(spark, "Client: yes\n\nTherapist: so", "CLIENT :  yes\nTherapist: so", "Client: no", "", "\n")
    got = [r["ids"] for r in groups.dialogue_pages(docs).collect()]
    assert sorted(got) == [["f0", "f1"], ["f3", "f4"]]
    assert groups.dialogue_pages(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="room"):
        groups.dialogue_pages(docs, 0)


def test_integrity_counts_unknown_speakers(spark):
    docs = talk(spark, "Client: a", "Narrator: b", "early\nClient: c", "")
    row = corpus.integrity(docs.unionByName(docs.limit(1))).first()
    assert (row["total"], row["repeated_ids"], row["unknown_speaker_dialogues"], row["empty_dialogues"]) == (5, 1, 2, 1)
    assert corpus.integrity(docs.limit(0)).first()["unknown_speaker_dialogues"] == 0
