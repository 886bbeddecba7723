"""Embedding near-duplicates: exact cosine pairs by dual traversal of cover trees.

Vectors are compared within their label, as unit vectors: cosine >= t means a distance of at
most sqrt(2 - 2t). Equal vectors count once. Each label has a cover tree over about one
vector in `LEAF`: levels of halving radius, each point of a level within that radius of its
parent. Every vector descends it to a leaf, a full leaf is dealt into chunks of bounded size,
and each node knows the radius that truly covers what is below. Pairs of nodes are followed
from the root and dropped once the distance of their centres exceeds both radii and the
threshold; what is left are pairs of chunks, compared by one matrix product each.

Per vector only its number of links leaves a chunk pair, and one edge to the least vector it
is connected with there, so dense groups give rows by their size and not by their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.components import components
from waymark.llm.shared import small_batches, table, written

THRESHOLD = 0.98
LEAF = 512
# Pivots of a label's tree at most (about), and vectors that descend it in one task group.
PIVOTS = 256
DESCENT = 4096
# Slack of the bounds against rounding; the comparison itself has none.
_SLACK = 1e-9
_NODES = "label int, leaf int, chunk int, cids array<long>, copies array<long>, vectors binary, center array<double>, radius double"


def build_tree(points: np.ndarray) -> tuple[list[int], list[float]]:
    """A cover tree over rows of `points`: each one's parent (-1: root) and its level's radius.

    Nested greedy nets: a point joins at the first level, of radius 2, 1, 1/2, ..., at which
    no earlier point is within the radius; its parent is the nearest point of the level above.
    """
    parents, radii = [-1] * len(points), [2.0] * len(points)
    net, waiting, radius = [0], list(range(1, len(points))), 2.0
    while waiting:
        above, radius = list(net), radius / 2
        rest = []
        for i in waiting:
            gaps = np.sqrt(((points[net] - points[i]) ** 2).sum(axis=1))
            # Equal points never part; below any distance that matters they share a place.
            if gaps.min() > radius or radius < 1e-6:
                parents[i] = above[int(gaps[: len(above)].argmin())]
                radii[i] = radius
                net.append(i)
            else:
                rest.append(i)
        waiting = rest
    return parents, radii


def descend(points: np.ndarray, pivots: np.ndarray, parents: list[int]) -> np.ndarray:
    """The pivot at which each point ends that steps to a nearer child while there is one."""
    children: dict[int, list[int]] = {}
    for i, p in enumerate(parents):
        children.setdefault(p, []).append(i)
    at = np.zeros(len(points), dtype=np.int64)
    best = np.sqrt(((points - pivots[0]) ** 2).sum(axis=1))
    moving = np.arange(len(points))
    while len(moving):
        moved = []
        for pivot in np.unique(at[moving]):
            own = moving[at[moving] == pivot]
            below = children.get(int(pivot), [])
            if not below:
                continue
            gaps = np.sqrt(np.maximum(2 - 2 * points[own] @ pivots[below].T, 0))
            nearest = gaps.argmin(axis=1)
            gap = gaps[np.arange(len(own)), nearest]
            nearer = gap < best[own]
            at[own[nearer]] = np.array(below)[nearest[nearer]]
            best[own[nearer]] = gap[nearer]
            moved.append(own[nearer])
        moving = np.concatenate(moved) if moved else moving[:0]
    return at


def close_leaves(pivots: np.ndarray, parents: list[int], reach: np.ndarray, eps: float) -> list[tuple[int, int]]:
    """Pairs of pivots (i <= j) whose leaves may hold points within `eps`: the dual traversal.

    `reach[i]`: distance from pivot i to its leaf's furthest point, negative where none is.
    """
    below: list[list[int]] = [[] for _ in parents]
    for i, p in enumerate(parents):
        if p >= 0:
            below[p].append(i)
    cover = reach.copy()
    for i in reversed(_top_down(below)):
        for c in below[i]:
            if cover[c] >= 0:
                cover[i] = max(cover[i], float(np.linalg.norm(pivots[i] - pivots[c])) + cover[c])
    found, todo = set(), [(0, 0)]
    seen = {(0, 0)}
    while todo:
        a, b = todo.pop()
        gap = float(np.linalg.norm(pivots[a] - pivots[b]))
        if cover[a] < 0 or cover[b] < 0 or gap > cover[a] + cover[b] + eps + _SLACK:
            continue
        if reach[a] >= 0 and reach[b] >= 0 and gap <= reach[a] + reach[b] + eps + _SLACK:
            found.add((min(a, b), max(a, b)))
        # Open both nodes: each side is its own leaf or one of its children.
        for x in [a, *below[a]]:
            for y in [b, *below[b]]:
                pair = (min(x, y), max(x, y))
                if pair not in seen:
                    seen.add(pair)
                    todo.append(pair)
    return sorted(found)


def _top_down(below: list[list[int]]) -> list[int]:
    order, todo = [], [0]
    while todo:
        i = todo.pop()
        order.append(i)
        todo += below[i]
    return order


def compare(left: np.ndarray, right: np.ndarray, same: bool, threshold: float) -> np.ndarray:
    """Which rows of two blocks of unit vectors link; a block with itself leaves out the diagonal."""
    linked = left @ right.T >= threshold
    if same:
        np.fill_diagonal(linked, False)
    return linked


def _least(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id that each row and column is connected with, within the block."""
    top = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    while True:
        na = np.minimum(a, np.where(linked, b[None, :], top).min(axis=1))
        nb = np.minimum(b, np.where(linked, na[:, None], top).min(axis=0))
        if (na == a).all() and (nb == b).all():
            return a, b
        a, b = na, nb


def _unit(vector: Column) -> Column:
    """The vector as doubles of length one; null unless all are finite and one is not zero."""

    def scale(vectors: pd.Series) -> pd.Series:
        out = []
        for v in vectors:
            x = None if v is None else np.array([np.nan if e is None else e for e in v], dtype=float)
            if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                out.append(None)
                continue
            # By the largest first: squares of great or small numbers leave the range.
            x = x / np.abs(x).max()
            out.append(x / np.sqrt(x @ x) + 0.0)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(scale, "array<double>")(vector)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column])


def cosine_links(vectors: DataFrame, threshold: float = THRESHOLD, leaf: int = LEAF) -> DataFrame:
    """`vec_id, n_links, component_id` per row of `vectors` (`vec_id`, `embedding`, `label`).

    A vector links with every other of its label at a cosine of `threshold` or more (double
    precision), copies included. One that is null, empty, zero, or holds null or non-finite
    parts, or has no label, links with nothing; vectors of different length never link. Null
    ids take part and never name a component but their own; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    # Labels and widths become group numbers, so that a group's vectors are of one width.
    read = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("name"),
        _unit(F.col("embedding")).alias("v"),
    )
    rows = written(read.select("vec_id", F.when(F.col("v").isNotNull() & F.col("name").isNotNull(), F.struct(F.col("name"), F.size("v").alias("width"))).alias("group"), "v"), "unit-vectors")
    valid = rows.where("group IS NOT NULL")
    classes = valid.groupBy("group", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    sizes = classes.groupBy("group").agg(F.count("*").alias("n"))
    sizes = written(sizes.withColumn("label", F.monotonically_increasing_id()), "vector-groups")
    kept = classes.join(sizes, "group").select("label", "n", "cid", "copies", "v")
    # About n / leaf pivots of a label, at most about PIVOTS: those of hash zero.
    stride = F.greatest(F.lit(leaf), F.ceil(F.col("n") / PIVOTS))
    pivots = kept.where(F.pmod(F.xxhash64("cid"), stride) == 0)

    def plant(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cid")
        points = _stack(group["v"])
        parents, _ = build_tree(points)
        return pd.DataFrame({"label": group["label"].iloc[:1], "pivots": [points.ravel().tolist()], "parents": [parents]})

    trees = pivots.select("label", "cid", "v").groupBy("label").applyInPandas(
        plant, "label long, pivots array<double>, parents array<int>"
    )
    trees = written(trees, "cover-trees")
    salts = F.ceil(F.col("n") / DESCENT)
    salted = kept.withColumn("salt", F.pmod(F.hash("cid"), salts).cast("int"))
    spread = trees.join(kept.select("label", "n").distinct(), "label").select(
        "label", F.explode(F.sequence(F.lit(0), (salts - 1).cast("int"))).alias("salt"), "pivots", "parents"
    )

    def settle(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"label": [], "cid": [], "leaf": []})
        # A label too small for a tree is one leaf.
        at = np.zeros(len(left), dtype=np.int64)
        if len(right):
            points = _stack(left["v"])
            at = descend(points, np.array(right["pivots"].iloc[0]).reshape(-1, points.shape[1]), list(right["parents"].iloc[0]))
        return pd.DataFrame({"label": left["label"], "cid": left["cid"], "leaf": at})

    settled = salted.select("label", "salt", "cid", "v").groupBy("label", "salt").cogroup(
        spread.groupBy("label", "salt")
    ).applyInPandas(settle, "label long, cid long, leaf int")
    settled = written(settled, "settled")
    full = settled.groupBy("label", "leaf").agg(F.count("*").alias("held"))
    chunk = F.pmod(F.xxhash64("cid", F.lit(1)), F.ceil(F.col("held") / leaf)).cast("int")
    dealt = settled.join(full, ["label", "leaf"]).select("label", "leaf", chunk.alias("chunk"), "cid")
    members = dealt.join(classes.select("cid", "copies", "v"), "cid")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cid")
        points = _stack(group["v"])
        center = points.mean(axis=0)
        return pd.DataFrame(
            {
                "label": group["label"].iloc[:1],
                "leaf": group["leaf"].iloc[:1],
                "chunk": group["chunk"].iloc[:1],
                "cids": [group["cid"].tolist()],
                "copies": [group["copies"].tolist()],
                "vectors": [points.astype("<f8").tobytes()],
                "center": [center.tolist()],
                "radius": [float(np.sqrt(((points - center) ** 2).sum(axis=1)).max())],
            }
        )

    nodes = members.groupBy("label", "leaf", "chunk").applyInPandas(pack, _NODES.replace("label int", "label long"))
    nodes = written(nodes, "tree-nodes")

    def traverse(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"label": [], "one": [], "other": []})
        label = left["label"].iloc[0]
        if not len(right):
            return pd.DataFrame({"label": [label], "one": [0], "other": [0]})
        width = len(left["center"].iloc[0])
        pivots = np.array(right["pivots"].iloc[0]).reshape(-1, width)
        reach = np.full(len(pivots), -1.0)
        gaps = np.sqrt(((_stack(left["center"]) - pivots[left["leaf"]]) ** 2).sum(axis=1))
        np.maximum.at(reach, left["leaf"].to_numpy(), gaps + left["radius"].to_numpy())
        pairs = close_leaves(pivots, list(right["parents"].iloc[0]), reach, eps)
        return pd.DataFrame({"label": label, "one": [a for a, _ in pairs], "other": [b for _, b in pairs]})

    # One row per leaf, folded to its furthest chunk, so a label's group is its tree's size.
    outline = nodes.groupBy("label", "leaf").agg(F.max_by("center", "radius").alias("center"), F.max("radius").alias("radius"), F.collect_list(F.struct("center", "radius")).alias("all"))
    outline = outline.select("label", "leaf", F.explode("all").alias("c")).select("label", "leaf", "c.center", "c.radius")
    pairs = outline.groupBy("label").cogroup(trees.groupBy("label")).applyInPandas(traverse, "label long, one int, other int")
    spots = nodes.select("label", "leaf", "chunk", "center", "radius")
    one = spots.toDF("label", "one", "c1", "center1", "radius1")
    other = spots.toDF("label", "other", "c2", "center2", "radius2")
    square = F.aggregate(F.zip_with("center1", "center2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)
    close = written(
        pairs.join(one, ["label", "one"]).join(other, ["label", "other"])
        .where((F.col("one") < F.col("other")) | (F.col("c1") <= F.col("c2")))
        .where(F.sqrt(square) <= F.col("radius1") + F.col("radius2") + eps + _SLACK)
        .select("label", "one", "c1", "other", "c2"),
        "chunk-pairs",
    )
    held = nodes.select("label", "leaf", "chunk", "cids", "copies", "vectors")
    joined = close.join(held.toDF("label", "one", "c1", "cids1", "copies1", "v1"), ["label", "one", "c1"]).join(
        held.toDF("label", "other", "c2", "cids2", "copies2", "v2"), ["label", "other", "c2"]
    )

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                same = (r.one, r.c1) == (r.other, r.c2)
                ids1, ids2 = np.asarray(r.cids1), np.asarray(r.cids2)
                x = np.frombuffer(r.v1).reshape(len(ids1), -1)
                y = np.frombuffer(r.v2).reshape(len(ids2), -1)
                linked = compare(x, y, same, threshold)
                a, b = _least(linked, ids1, ids2)
                out = pd.DataFrame({"cid": ids1, "links": linked @ np.asarray(r.copies2), "root": a})
                if not same:
                    more = pd.DataFrame({"cid": ids2, "links": linked.T @ np.asarray(r.copies1), "root": b})
                    out = pd.concat([out, more])
                yield out[out["links"] > 0]

    found = written(joined.mapInPandas(link, "cid long, links long, root long"), "cosine-links")
    totals = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    known = classes.join(totals, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    known = known.select("group", "v", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("root"))
    named = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(named, "root").select(
        F.col("group").alias("g"), F.col("v").alias("w"), (F.col("links") + F.col("copies") - 1).alias("links"), "component"
    )
    return rows.join(known, (rows.group == known.g) & (rows.v == known.w), "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
    )


def op8_cosine_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's links and component within its label."""
    found = cosine_links(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP8_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
        AND list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) > 0
), links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
    AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.98
), reach(a, b) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id,
    vec_id = component_id AS kept
FROM embeddings JOIN least ON a = vec_id
"""
