"""Prefix trie of conversations: ternary search trees over dictionary-encoded turns, one per range shard.

Every distinct turn gets a number; a conversation is a row of numbers. Equal conversations are
counted together and the distinct ones sorted, so a shard, a run of them, shares a node of the trie
with other shards only along its first and last conversation. Each shard builds a ternary search
tree, the median first, and walks it without recursion. A node belongs to the first shard that has
it; every figure of a node is a sum over its shards of what belongs to them, so the nodes on
a boundary merge by one aggregation and all others are final where they are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.shared import crc32_sql, table, written

# Conversations of a block of this many share the head of its first one; a head has fewer than HEADS turns.
BLOCK = 100
HEADS = 6
# Turns of a shard; conversation ids that are joined to one text before they are hashed.
SHARD_TURNS = 1 << 18
ID_RUN = 4096
NO_IDS = hashlib.sha256(b"").hexdigest()
PARTS = (
    "place string, parent_place string, parent_conv_id long, conv_id long, depth long, n_convs long, "
    "n_children long, n_leaves long, saved long, ends_sha256 string"
)


def encode_turns(conversations: DataFrame) -> DataFrame:
    """`conv_id, turns`: per conversation the number and code points of its turns, in order.

    Turns are told apart by the SHA-256 of role and text, so texts are not shuffled.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    marked = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = written(
        conversations.where("conv_id IS NOT NULL").select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
            F.unhex(marked).alias("digest"), F.char_length(text).alias("points"),
        ), "turns",
    )
    numbers = written(turns.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()), "dictionary")
    # Ties of a turn number are ordered by digest.
    placed = turns.join(numbers, "digest").select("conv_id", F.struct("turn", "digest", "id", "points").alias("t"))
    listed = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["points"].alias("points"))).alias("turns"))


def rebuilt(own: DataFrame, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """Every conversation with the first turns of its block's first one in place of its own."""
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    firsts = own.where(F.pmod("conv_id", F.lit(block)) == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("lead")
    )
    told = own.select("conv_id", "turns", head.alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(block))).alias("base"))
    joined = told.join(firsts, "base", "left")
    lead = F.coalesce(F.slice("lead", 1, F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(lead, rest).alias("turns"))


def hashed_ids(ends: DataFrame) -> DataFrame:
    """`seq, ends_sha256` for `seq, conv_id` rows: SHA-256 of a sequence's ids, ascending, comma-joined.

    Ranges of (seq, id) are joined to texts first, so that one sequence's ids may fill many tasks;
    the texts of one are then hashed as they come, none held.
    """

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            new = batch["seq"].to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1], [True]]))
            rows = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                for k in range(a, b, ID_RUN):
                    ids = batch["conv_id"].iloc[k : min(k + ID_RUN, b)].tolist()
                    rows.append((new[a], ids[0], ",".join(map(str, ids))))
            yield pd.DataFrame(rows, columns=["seq", "first", "ids"])

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, running = None, None
        for batch in batches:
            done = []
            for name, ids in zip(batch["seq"], batch["ids"]):
                if name != seq:
                    if seq is not None:
                        done.append((seq, running.hexdigest()))
                    seq, running = name, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["seq", "ends_sha256"], dtype=object)
        if seq is not None:
            yield pd.DataFrame([(seq, running.hexdigest())], columns=["seq", "ends_sha256"])

    ranged = ends.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    runs = ranged.mapInPandas(joined, "seq string, first long, ids string")
    gathered = runs.repartition("seq").sortWithinPartitions("seq", "first")
    return gathered.mapInPandas(digest, "seq string, ends_sha256 string")


class TernaryTree:
    """Sequences of turn numbers in a ternary search tree; a node of the trie is a node of the tree."""

    def __init__(self) -> None:
        self.turn = [0]
        self.low, self.same, self.high = [-1], [-1], [-1]
        self.parent, self.depth, self.points = [-1], [0], [0]
        self.convs, self.least = [0], [1 << 63]
        self.end: list[str | None] = [None]

    def _new(self, turn: int, parent: int, points: int) -> int:
        self.turn.append(turn)
        for link in (self.low, self.same, self.high):
            link.append(-1)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.points.append(points)
        self.convs.append(0)
        self.least.append(1 << 63)
        self.end.append(None)
        return len(self.turn) - 1

    def _child(self, parent: int, turn: int, points: int) -> int:
        at = self.same[parent]
        if at < 0:
            self.same[parent] = self._new(turn, parent, points)
            return self.same[parent]
        while self.turn[at] != turn:
            side = self.low if turn < self.turn[at] else self.high
            if side[at] < 0:
                side[at] = self._new(turn, parent, points)
                return side[at]
            at = side[at]
        return at

    def insert(self, turns: list[int], points: list[int], convs: int, least: int, end: str) -> list[int]:
        """Add a sequence of `convs` conversations; the nodes on its way, the root first."""
        way = [0]
        for turn, size in zip(turns, points):
            way.append(self._child(way[-1], turn, size))
        for node in way:
            self.convs[node] += convs
            if least < self.least[node]:
                self.least[node] = least
        self.end[way[-1]] = end
        return way

    @staticmethod
    def medians(n: int) -> Iterator[int]:
        """0 to n - 1, the middle of every range before its halves."""
        ranges = [(0, n)]
        while ranges:
            a, b = ranges.pop()
            if a < b:
                middle = (a + b) // 2
                yield middle
                ranges += [(middle + 1, b), (a, middle)]


def _shared(a: list[int] | None, b: list[int] | None) -> int:
    """How many turns two sequences have in common; -1 without one of them."""
    if a is None or b is None:
        return -1
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


def _place(turns: list[int]) -> str:
    return hashlib.sha256(np.array(turns, dtype="<i8").tobytes()).hexdigest()


def shard_nodes(group: pd.DataFrame) -> pd.DataFrame:
    """A shard's nodes with the figures that belong to it; those on a boundary have a `place`.

    Rows: `turns, points` (arrays), `n, conv_id, ends_sha256`, and, equal in all rows, `before` and
    `after`: the last sequence of the shard before and the first one of the shard behind.
    """
    turns = [list(t) for t in group["turns"]]
    order = sorted(range(len(turns)), key=turns.__getitem__)
    first, last = turns[order[0]], turns[order[-1]]
    before, after = ([None if s is None else list(s) for s in group[c].iloc[:1]][0] for c in ("before", "after"))
    ins, outs = _shared(before, first), _shared(last, after)
    tree = TernaryTree()
    points, n, least, ends = (group[c].tolist() for c in ("points", "n", "conv_id", "ends_sha256"))
    ways = {}
    for k in TernaryTree.medians(len(order)):
        row = order[k]
        way = tree.insert(turns[row], list(points[row]), n[row], least[row], ends[row])
        if k in (0, len(order) - 1):
            ways[k] = way
    count = len(tree.turn)
    # The root is on a boundary always; the first way is, as far as the shard before shares it, and so on.
    places: dict[int, str] = {0: _place([])}
    for way, sequence, depth in ((ways[0], first, ins), (ways[len(order) - 1], last, outs)):
        for d in range(1, depth + 1):
            places[way[d]] = _place(sequence[:d])
    others = set(ways[0][: ins + 1])
    children, leaves, saved = [0] * count, [0] * count, [0] * count
    for node in range(count):
        saved[node] = (tree.convs[node] - (node not in others)) * tree.points[node]
        # A conversation that the next shard goes on with ends at no leaf.
        open_end = node == ways[len(order) - 1][-1] and 0 <= outs == tree.depth[node] and len(after) > outs
        leaves[node] = int(tree.same[node] < 0 and not open_end)
    # A node is made after its parent, so the way back meets children first.
    for node in range(count - 1, 0, -1):
        parent = tree.parent[node]
        children[parent] += node not in others
        leaves[parent] += leaves[node]
        saved[parent] += saved[node]
    rows = [
        (
            places.get(node),
            places.get(tree.parent[node]) if node else None,
            tree.least[tree.parent[node]] if node and tree.parent[node] not in places else None,
            tree.least[node], tree.depth[node], tree.convs[node], children[node], leaves[node], saved[node], tree.end[node],
        )
        for node in range(count)
    ]
    made = pd.DataFrame(rows, columns=[c.split()[0] for c in PARTS.split(", ")])
    return made.astype({"parent_conv_id": "Int64"})


def sharded(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """`sequences` with a `shard`: ranges in order of `turns`, and both neighbours' nearest sequences."""
    spark = sequences.sparkSession
    total = sequences.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_turns))
    ranged = sequences.repartitionByRange(shards, "turns").withColumn("shard", F.spark_partition_id())
    ranged = written(ranged, "shards")
    # Two sequences per shard, whose number does not grow faster than the shards'.
    ends = ranged.groupBy("shard").agg(F.min("turns").alias("low"), F.max("turns").alias("top"))
    near = ends.select(
        "shard", F.expr("lag(top) OVER (ORDER BY shard)").alias("before"), F.expr("lead(low) OVER (ORDER BY shard)").alias("after")
    )
    return ranged.join(near, "shard")


def conversation_trie(conversations: DataFrame, block: int = BLOCK, heads: int = HEADS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the prefix trie of the rebuilt `conversations` (`conv_id, turn, role, text`).

    Returns, per distinct sequence of first turns, `conv_id` (the least that starts with it), `depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`. Turns are ordered by
    number, null first; equal numbers by the SHA-256 of role and text, so repeated rows are turns of
    their own. A null role or text is empty. Rows without conv_id belong to no conversation and are
    left out; a conversation may be left without turns, and then ends at the root. An empty table
    gives no node; other columns are ignored. The numbers of a conversation's turns are one row.
    """
    rows = rebuilt(encode_turns(conversations), block, heads).select(
        "conv_id", F.col("turns.id").alias("turns"), F.col("turns.points").alias("points")
    )
    seq = F.sha2(F.array_join(F.col("turns").cast("array<string>"), ","), 256).alias("seq")
    rows = written(rows.select("*", seq), "rebuilt")
    distinct = rows.groupBy("seq").agg(
        F.first("turns").alias("turns"), F.first("points").alias("points"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id")
    )
    sequences = distinct.join(hashed_ids(rows.select("seq", "conv_id")), "seq").drop("seq")
    nodes = written(sharded(sequences, shard_turns).groupBy("shard").applyInPandas(shard_nodes, PARTS), "nodes")
    merged = nodes.where("place IS NOT NULL").groupBy("place").agg(
        F.min("parent_place").alias("parent_place"), F.min("parent_conv_id").alias("parent_conv_id"),
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.max("ends_sha256").alias("ends_sha256"),
    )
    merged = written(merged, "merged")
    whole = nodes.where("place IS NULL").unionByName(merged)
    over = merged.select(F.col("place").alias("parent_place"), F.col("conv_id").alias("over"))
    return whole.join(over, "parent_place", "left").select(
        "conv_id", "depth", F.coalesce("over", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"),
    )


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = f"""
WITH turns AS (
    SELECT conv_id, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
        len(coalesce(text, '')) AS points
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, list({{'id': id, 'points': points}} ORDER BY turn NULLS FIRST, id) AS t FROM turns GROUP BY conv_id
), heads AS (
    SELECT *, {crc32_sql("conv_id::VARCHAR")} % 6 AS h, conv_id - ((conv_id % 100) + 100) % 100 AS base FROM own
), rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(list_slice(b.t, 1, h), []), list_slice(c.t, h + 1, len(c.t))) AS t
    FROM heads c LEFT JOIN own b ON b.conv_id = c.base
), steps AS (
    SELECT conv_id, d, len(t) AS size,
        sha256(array_to_string([x.id FOR x IN t[:d]], ',')) AS node,
        CASE WHEN d > 0 THEN sha256(array_to_string([x.id FOR x IN t[:d - 1]], ',')) END AS parent,
        CASE WHEN d > 0 THEN t[d].points ELSE 0 END AS points,
        [sha256(array_to_string([x.id FOR x IN t[:k]], ',')) FOR k IN range(d + 1)] AS above
    FROM rebuilt, unnest(range(0, len(t) + 1)) AS u(d)
), nodes AS (
    SELECT node, any_value(d) AS depth, any_value(parent) AS parent, any_value(points) AS points, any_value(above) AS above,
        min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = d), '')) AS ends_sha256
    FROM steps GROUP BY node
), children AS (
    SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), subtrees AS (
    SELECT a.node, count(*) FILTER (WHERE c.node IS NULL) AS n_leaves, sum((n_convs - 1) * points) AS saved_tokens
    FROM (SELECT node AS own, unnest(above) AS node, n_convs, points FROM nodes) a
    LEFT JOIN children c ON c.node = a.own GROUP BY a.node
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
    n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.parent = p.node LEFT JOIN children c ON c.node = n.node JOIN subtrees s ON s.node = n.node
"""
