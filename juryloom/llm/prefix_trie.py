"""The prefix trie of conversations by preorder intervals.

A conversation is a path from the root, a node the distinct sequence of its first turns. Conversations are ranked
lexicographically, which makes the members of every node an interval of ranks; nodes in the order of (first member's
rank, depth) are in preorder, and a node with all below it is an interval of places. Leaves and savings of a subtree
are then differences of running sums at the interval's two ends.

Sequences are ranked by short keys instead of whole paths: at every node the child of most members is the heavy one,
and a conversation's key lists the places where it leaves heavy paths, which are log2(conversations) at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize, shared_dir
from .prefix_sums import running_sums

#: Characters of member lists that are digested at once, and about the size of a row of them.
LIST_CHARS = 1 << 16
#: Digests of turns are taken in lanes of 32 bits, so that the sums of any number of them fit in a long.
LANES = ("a", "b", "c", "d")
_NODE = ("depth", "k1", "k2")


def number_turns(conversations: DataFrame, folder: str) -> DataFrame:
    """(conv_id, turn_no from 1, lanes a to d, n_bytes) of conversations (conv_id, turn, role, text), as a written table.

    Turns are ordered by turn, null first; turns of equal number by role and text. Null role or text counts as empty;
    rows of null conv_id are left out. Equal rows are turns of their own.
    """
    turn = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    digest = F.sha2(F.concat(F.sha2("role", 256), "text"), 256)
    lanes = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(c) for i, c in enumerate(LANES)]
    # The last part of the order deals equal rows over several ranges; among them any order is the same.
    rows = turn.select("*", *lanes, F.octet_length("text").cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("__row"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("__row")]
    return running_sums(rows, order, {"turn_no": "one"}, folder, "numbered", "conv_id", ["conv_id", *LANES, "n_bytes"])


def graft(numbered: DataFrame, folder: str, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) in which the first h turns of each conversation c are those of conversation c - c % every.

    h is the unsigned crc32 of c in decimal, modulo most; c's own turns after its first h follow. A conversation that
    is not there has no turns to give. % takes the sign of c, as in SQL.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    sizes = numbered.groupBy("conv_id").agg(F.max("turn_no").alias("size"))
    heads = sizes.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("source"))
    given = sizes.select(F.col("conv_id").alias("source"), F.col("size").alias("has"))
    conv = materialize(heads.join(given, "source", "left").select("conv_id", "h", "source", F.least("h", F.coalesce("has", F.lit(0))).alias("took")), folder, "grafted")
    rest = ["turn_no", *LANES, "n_bytes"]
    lent = numbered.filter(F.col("turn_no") < most).withColumnRenamed("conv_id", "source")
    first = conv.join(lent, "source").filter("turn_no <= h").select("conv_id", *rest)
    own = hot_join(numbered.filter(F.col("turn_no") > h), conv.select("conv_id", "h", "took"), "conv_id", "turn_no")
    own = own.select("conv_id", (F.col("turn_no") - F.col("h") + F.col("took")).alias("turn_no"), *rest[1:])
    return first.unionByName(own), conv.select("conv_id")


def _node(depth: Column, sums: list[Column]) -> list[Column]:
    """The node's key: its depth and 128 bits of the digests of its turns, each mixed with its place."""
    return [depth.alias("depth"), F.xxhash64(F.lit(1), depth, *sums).alias("k1"), F.xxhash64(F.lit(2), depth, *sums).alias("k2")]


def member_rows(turns: DataFrame, conversations: DataFrame, folder: str) -> DataFrame:
    """(conv_id, node, above, n_bytes): a row for each conversation and node on its path, the root too, as a written table.

    A node is a struct of depth and two 64-bit digests over sums of digests of (turn, place); above is the parent.
    """
    placed = turns.select(
        "conv_id", "turn_no", *(F.pmod(F.xxhash64(F.lit(i), "turn_no", *LANES), F.lit(1 << 32)).alias(c) for i, c in enumerate(LANES)), "n_bytes"
    )
    summed = running_sums(placed, [F.asc("conv_id"), F.asc("turn_no")], {f"s{c}": c for c in LANES}, folder, "summed", "conv_id")
    node = F.struct(*_node(F.col("turn_no"), [F.col(f"s{c}") for c in LANES]))
    above = F.struct(*_node(F.col("turn_no") - 1, [F.col(f"s{c}") - F.col(c) for c in LANES]))
    root = F.struct(*_node(F.lit(0).cast("long"), [F.lit(0).cast("long")] * len(LANES)))
    tops = conversations.select("conv_id", root.alias("node"), F.lit(None).cast("struct<depth:bigint,k1:bigint,k2:bigint>").alias("above"), F.lit(0).cast("long").alias("n_bytes"))
    return materialize(summed.select("conv_id", node.alias("node"), above.alias("above"), "n_bytes").unionByName(tops), folder, "members")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ends (node, conv_id): SHA-256 of the decimal conv_ids in ascending order, with commas.

    A digest runs over its list from first to last. Lists are put together in ranges of (node, conv_id), in pieces of
    LIST_CHARS; the pieces of a list, a row for some thousand ids, then run through one digest in their order.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, first, ids, size = None, 0, [], 0
        out: list[tuple] = []
        for batch in batches:
            for depth, k1, k2, conv in zip(batch["depth"], batch["k1"], batch["k2"], batch["conv_id"], strict=True):
                if (depth, k1, k2) != node or size > LIST_CHARS:
                    if ids:
                        out.append((*node, first, ",".join(ids)))
                    node, first, ids, size = (depth, k1, k2), conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if out:
                yield pd.DataFrame(out, columns=["depth", "k1", "k2", "first", "list"])
                out = []
        if ids:
            yield pd.DataFrame([(*node, first, ",".join(ids))], columns=["depth", "k1", "k2", "first", "list"])

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, running = None, None
        for batch in batches:
            out = []
            for *key, text in zip(batch["depth"], batch["k1"], batch["k2"], batch["list"], strict=True):
                if key == node:
                    running.update(b"," + text.encode())
                else:
                    if running:
                        out.append((*node, running.hexdigest()))
                    node, running = key, hashlib.sha256(text.encode())
            yield pd.DataFrame(out, columns=["depth", "k1", "k2", "ends_sha256"])
        if running:
            yield pd.DataFrame([(*node, running.hexdigest())], columns=["depth", "k1", "k2", "ends_sha256"])

    order = [*_NODE, "conv_id"]
    key = "depth long, k1 long, k2 long"
    parts = ends.select("node.*", "conv_id").repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(pieces, f"{key}, first long, list string")
    done = parts.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").select(*_NODE, "list").mapInPandas(digests, f"{key}, ends_sha256 string")
    return done.select(F.struct(*_NODE).alias("node"), "ends_sha256")


def _ranks(members: DataFrame, classes: DataFrame, light: DataFrame, folder: str) -> DataFrame:
    """(conv_id, rank): the lexicographic rank of each distinct sequence, at its representative conversation."""
    left = hot_join(members.select("conv_id", "node"), light, "node", "conv_id").select("conv_id", "node.depth", F.lit(1).alias("kind"), "node.k1", "node.k2")
    left = left.join(classes.select("conv_id"), "conv_id", "left_semi")
    none = F.lit(0).cast("long")
    stop = classes.select("conv_id", (F.col("node.depth") + 1).alias("depth"), F.lit(0).alias("kind"), none.alias("k1"), none.alias("k2"))
    keys = left.unionByName(stop).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "kind", "k1", "k2"))).alias("key"))  # of log2(conversations) + 1
    keys = keys.withColumn("one", F.lit(1).cast("long"))
    return running_sums(keys, [F.asc("key")], {"rank": "one"}, folder, "ranks", keep=["conv_id"])


def trie(turns: DataFrame, conversations: DataFrame, folder: str) -> DataFrame:
    """The nodes of the trie of turns (conv_id, turn_no, lanes, n_bytes), whose conversations may have no turns.

    Returns per node: conv_id (smallest member), depth, parent_conv_id (the root's is null), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, place and end_place (the node's and its subtree's last place in preorder,
    from 1). Two different sequences fall together if 128 bits of their digests agree.
    """
    members = member_rows(turns, conversations, folder)
    nodes = materialize(
        members.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.min("above").alias("above")), folder, "nodes"
    )
    below = nodes.filter("above is not null").groupBy("above").agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", "node")).alias("most"))
    below = materialize(below.select(F.col("above").alias("node"), "n_children", F.col("most.node").alias("heavy")), folder, "children")
    light = nodes.select("node").filter("node.depth > 0").join(below.select(F.col("heavy").alias("node")), "node", "left_anti")
    light = materialize(light, folder, "light")
    ends = members.groupBy("conv_id").agg(F.max("node.depth").alias("depth"))
    ends = hot_join(members.select("conv_id", "node"), materialize(ends, folder, "lengths"), "conv_id", "node").filter("node.depth = depth").select("conv_id", "node")
    ends = materialize(ends, folder, "ends")
    classes = materialize(ends.groupBy("node").agg(F.min("conv_id").alias("conv_id")), folder, "classes")
    ranks = materialize(_ranks(members, classes, light, folder), folder, "ranked")
    reach = hot_join(members.select("conv_id", "node"), ranks, "conv_id", "node").groupBy("node").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))

    whole = nodes.join(reach, "node").join(below.select("node", "n_children"), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    whole = whole.select(
        "node.*", *(F.coalesce(f"above.{k}", F.lit(0)).alias(f"above_{k}") for k in ("k1", "k2")), "conv_id", "n_convs", "n_children", "lo", "hi",
        (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), F.lit(1).cast("long").alias("one")
    )
    sums = {"place": "one", "leaves": "leaf", "savings": "saved"}
    placed = running_sums(whole, [F.asc("lo"), F.asc("depth")], sums, folder, "preorder", keep=[c for c in whole.columns if c != "one"])
    above = F.when(F.col("depth") > 0, F.struct((F.col("depth") - 1).alias("depth"), F.col("above_k1").alias("k1"), F.col("above_k2").alias("k2")))
    placed = materialize(placed.withColumns({"node": F.struct(*_NODE), "above": above}).drop("k1", "k2", "above_k1", "above_k2"), folder, "placed")
    # Sums grow along the preorder, so those of a rank's last node are the greatest ones of the rank.
    last = placed.groupBy("lo").agg(*(F.max(c).alias(f"end_{c}") for c in sums)).withColumnRenamed("lo", "hi")
    found = hot_join(placed, materialize(last, folder, "last"), "hi", "place")
    parents = materialize(nodes.join(below.select("node"), "node", "left_semi").select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id")), folder, "parents")
    found = hot_join(found, parents, "above", "place", "left")
    found = found.join(ends_digests(ends), "node", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return found.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("end_leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("end_savings") - F.col("savings") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
        "place",
        "end_place",
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of a table (conv_id, turn, role, text) as it is; see trie for the result, number_turns for the order.

    Null conv_ids are left out, null roles and texts are empty, repeated rows are repeated turns, other columns are
    ignored. An empty table has no conversation, so no node, not even a root. A conversation may have any share of
    all turns and a node any share of all conversations: both are dealt over ranges or salts.
    """
    folder = shared_dir(conversations.sparkSession)
    numbered = number_turns(conversations, folder)
    return trie(numbered, numbered.select("conv_id").distinct(), folder)


def grafted_trie(conversations: DataFrame) -> DataFrame:
    """As prefix_trie, of conversations rebuilt by graft, some of which may have no turns."""
    folder = shared_dir(conversations.sparkSession)
    return trie(*graft(number_turns(conversations, folder), folder), folder)


ORACLE = r"""
WITH
own AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
    FROM conversations WHERE conv_id IS NOT NULL),
bits AS (
    SELECT conv_id, flatten(list_transform(regexp_extract_all(conv_id::VARCHAR, '.'),
        lambda d: list_transform(range(8), lambda k: (ascii(d) >> k) & 1))) AS b
    FROM (SELECT DISTINCT conv_id FROM own)),
convs AS (
    SELECT conv_id, conv_id - conv_id % 5 AS source, xor(4294967295, list_reduce(b,
        lambda c, x: xor(c >> 1, CASE WHEN xor(c & 1, x) = 1 THEN 3988292384 ELSE 0 END), 4294967295)) % 9 AS h
    FROM bits),
turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS d, role, text FROM (
        SELECT c.conv_id, 0 AS part, o.i, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.source AND o.i <= c.h
        UNION ALL SELECT c.conv_id, 1, o.i, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.i > c.h)),
members AS (
    SELECT conv_id, d, octet_length(encode(text)) AS bytes,
        string_agg(sha256(role || chr(1) || text), '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM turns
    UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
nodes AS (
    SELECT path, max(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved,
        CASE WHEN path <> '' THEN left(path, length(path) - 64) END AS above
    FROM members GROUP BY path),
children AS (SELECT above AS path, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY 1),
pairs AS (
    SELECT DISTINCT a.path AS top, b.path AS path FROM members a JOIN members b ON a.conv_id = b.conv_id AND a.d <= b.d),
sums AS (
    SELECT top, count(*) FILTER (children.path IS NULL) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
    FROM pairs JOIN nodes USING (path) LEFT JOIN children USING (path) GROUP BY top),
ends AS (
    SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS list
    FROM members JOIN (SELECT conv_id, max(d) AS d FROM members GROUP BY conv_id) USING (conv_id, d) GROUP BY path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, s.saved_tokens,
    sha256(coalesce(e.list, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.path = n.above LEFT JOIN children c ON c.path = n.path
    JOIN sums s ON s.top = n.path LEFT JOIN ends e ON e.path = n.path
"""
