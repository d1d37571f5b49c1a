"""Approximate nearest neighbours by one small-world graph per shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataloom.llm.common import cut

#: Links of a node on a level, and on the ground level twice as many.
LINKS = 16
#: Nodes that a search keeps in sight on the ground level.
SIGHT = 96
#: Vectors in a shard, about; a shard's build and memory are bounded by it.
SHARD_ROWS = 6000
QUERY_BLOCK = 1024
#: Vectors have fewer components than that; a shard's number times it, and they, name the shard.
WIDTHS = 1_000_000
#: Nodes that an insertion keeps in sight, and nodes that are inserted together.
BUILD_SIGHT = 64
TOGETHER = 1024


def _select(units: np.ndarray, near: np.ndarray, sims: np.ndarray, links: int) -> np.ndarray:
    """Diverse neighbours: going outward, one is taken if no taken one is nearer to it than the node.

    ``near`` are nodes by falling ``sims``, with -1 at the end for none.  What places are
    left are filled with the nearest passed over.
    """
    n, seen = near.shape
    taken = np.zeros((n, seen), bool)
    closest = np.full((n, seen), -2.0, np.float32)
    around = units[near]
    between = around @ around.transpose(0, 2, 1)
    for k in range(seen):
        ok = (closest[:, k] < sims[:, k]) & (near[:, k] >= 0) & (taken.sum(1) < links)
        taken[:, k] = ok
        closest = np.where(ok[:, None], np.maximum(closest, between[:, k]), closest)
    order = np.argsort(~taken * seen + np.arange(seen), axis=1, kind="stable")[:, :links]
    return np.take_along_axis(near, order, 1)


def _link(units: np.ndarray, flat: np.ndarray, new: np.ndarray, near: np.ndarray, sims: np.ndarray) -> None:
    """Gives the ``new`` nodes diverse neighbours of those found ``near``, and these links back.

    A node whose row in ``flat`` would overflow keeps diverse ones of the old and the new.
    """
    width = flat.shape[1]
    chosen = _select(units, near, sims, width // 2)
    flat[new, : chosen.shape[1]] = chosen
    source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
    # a link back that is there already, as between two new nodes, is not made again
    fresh = (target >= 0) & ~(flat[target] == source[:, None]).any(1)
    source, target = source[fresh], target[fresh]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
    turn = np.arange(len(target)) - np.repeat(first, counts)
    for at in range(0, int(counts.max(initial=0)), width):
        some = np.flatnonzero(counts > at)
        for part in np.array_split(some, -(-len(some) // TOGETHER)):
            pool = np.full((len(part), 2 * width), -1, np.int64)
            pool[:, :width] = flat[nodes[part]]
            rows = np.searchsorted(nodes[part], target)
            mine = np.flatnonzero((turn >= at) & (turn < at + width) & (rows < len(part)))
            mine = mine[nodes[part][rows[mine]] == target[mine]]
            pool[rows[mine], width + turn[mine] - at] = source[mine]
            value = np.where(pool >= 0, np.einsum("nd,nkd->nk", units[nodes[part]], units[pool]), -5)
            best = np.argsort(-value, axis=1, kind="stable")[:, : int((pool >= 0).sum(1).max())]
            flat[nodes[part]] = -1
            kept = _select(units, np.take_along_axis(pool, best, 1), np.take_along_axis(value, best, 1), width)
            flat[nodes[part], : kept.shape[1]] = kept


def build_graph(units: np.ndarray, links: int = LINKS, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the ground up: (nodes, flat neighbours) with rows of a fixed length.

    A node's highest level is drawn geometrically.  Levels grow from the top down and
    each by insertion: the nodes of the level above come first, then ``TOGETHER`` at a
    time the others, which search the levels as they stand for their neighbours and look
    at each other; ``_select`` thins what they find.
    """
    random = np.random.Generator(np.random.PCG64(seed))
    heights = np.floor(-np.log(1 - random.random(len(units))) / np.log(links)).astype(int)
    order = np.argsort(-heights, kind="stable")
    own = np.ascontiguousarray(units[order])  # the nodes of a level are the first ones of this
    done: list[tuple[np.ndarray, np.ndarray]] = []
    above = 0
    for level in range(int(heights.max(initial=0)), -1, -1):
        nodes = int((heights >= level).sum())
        flat = np.full((nodes, links if level else 2 * links), -1, np.int64)
        at = 0
        while at < nodes:
            new = np.arange(at, min(max(above, 32) if not at else at + min(at, TOGETHER), nodes))
            sims = own[new] @ own[new].T
            sims[np.arange(len(new)), np.arange(len(new))] = -5
            near = np.broadcast_to(new, sims.shape)
            if at:
                found, value = search_graph(own[:at], [(np.arange(at), flat[:at]), *done[::-1]], own[new], BUILD_SIGHT)
                sims, near = np.concatenate([value, sims], 1), np.concatenate([found, near], 1)
            best = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * links]
            near, sims = np.take_along_axis(near, best, 1), np.take_along_axis(sims, best, 1)
            _link(own, flat, new, np.where(sims > -4, near, -1), sims)
            at = int(new[-1]) + 1
        done.append((np.arange(nodes), flat))
        above = nodes
    levels = [(order[: len(flat)].astype(np.int32), flat.astype(np.int32)) for _, flat in done[-2::-1]]
    ground = np.empty_like(done[-1][1], np.int32)
    ground[order] = np.where(done[-1][1] >= 0, order[done[-1][1]], -1)
    return [(np.arange(len(units), dtype=np.int32), ground), *levels]


def search_graph(units: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, sight: int = SIGHT) -> tuple[np.ndarray, np.ndarray]:
    """(node, similarity) of up to ``sight`` nodes found for each query, nearest first.

    All queries walk together: down the levels greedily, then on the ground level each
    opens its nearest unopened node until no node in sight is unopened.
    """
    n = len(queries)
    here = np.zeros(n, np.int64) + (levels[-1][0][0] if len(levels) > 1 else 0)
    best = np.einsum("qd,qd->q", queries, units[here])
    for nodes, flat in levels[:0:-1]:
        places = np.full(len(units), -1, np.int64)
        places[nodes] = np.arange(len(nodes))
        active = np.arange(n)
        while len(active):
            around = flat[places[here[active]]]
            sims = np.where(around >= 0, np.einsum("qd,qkd->qk", queries[active], units[nodes[around]]), -4)
            k = sims.argmax(1)
            top = sims[np.arange(len(active)), k]
            better = top > best[active]
            moved = active[better]
            here[moved], best[moved] = nodes[around[better, k[better]]], top[better]
            active = moved
    flat = levels[0][1]
    found = np.full((n, sight), -1, np.int64)
    value = np.full((n, sight), -4.0, units.dtype)
    opened = np.ones((n, sight), bool)
    # the way down, and a few nodes drawn alike for all, so that no region is cut off
    starts = np.unique(np.linspace(0, len(units) - 1, min(len(units), sight // 6)).astype(np.int64))
    visited = np.zeros((n, len(units)), bool)
    initial = np.concatenate([here[:, None], np.broadcast_to(starts, (n, len(starts)))], 1)
    initial[:, 1:][initial[:, 1:] == here[:, None]] = -1
    sims = np.where(initial >= 0, np.einsum("qd,qkd->qk", queries, units[initial]), -4)
    found[:, : initial.shape[1]], value[:, : initial.shape[1]], opened[:, : initial.shape[1]] = initial, sims, initial < 0
    visited[np.repeat(np.arange(n), initial.shape[1]), np.where(initial >= 0, initial, here[:, None]).ravel()] = True
    active = np.arange(n)
    while len(active):
        next_value = np.where(opened[active], -5, value[active])
        k = next_value.argmax(1)
        live = next_value[np.arange(len(active)), k] > -4
        active, k = active[live], k[live]
        if not len(active):
            break
        opened[active, k] = True
        around = flat[found[active, k]].astype(np.int64)
        fresh = (around >= 0) & ~visited[active[:, None], around]
        visited[active[:, None], np.where(around >= 0, around, found[active, k][:, None])] = True
        sims = np.where(fresh, np.einsum("qd,qkd->qk", queries[active], units[around]), -4)
        # the same neighbour twice in one row counts once
        order = np.argsort(around, axis=1, kind="stable")
        ordered = np.take_along_axis(around, order, 1)
        again = np.zeros_like(fresh)
        np.put_along_axis(again, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
        sims = np.where(again, -4, sims)
        pool_value = np.concatenate([value[active], sims], 1)
        pool_found = np.concatenate([found[active], around], 1)
        pool_opened = np.concatenate([opened[active], sims <= -4], 1)
        keep = np.argsort(-pool_value, axis=1, kind="stable")[:, :sight]
        value[active], found[active], opened[active] = (np.take_along_axis(x, keep, 1) for x in (pool_value, pool_found, pool_opened))
    order = np.argsort(-value, axis=1, kind="stable")
    return np.take_along_axis(np.where(value > -4, found, -1), order, 1), np.take_along_axis(value, order, 1)


def _usable(vector: str) -> Column:
    """Doubles of a vector with finite components, not all zero; else null."""
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine & F.exists(doubles, lambda x: x != 0), doubles)


def _build(rows: pa.Table) -> pa.Table:
    vectors = np.stack(rows.column("vector").to_pylist())
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    levels = build_graph(units.astype(np.float32))
    out = {
        "shard": pa.array([rows.column("shard")[0].as_py()], pa.int64()),
        "ids": pa.array([rows.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
        "vectors": pa.array([vectors.tobytes()], pa.binary()),
        "width": pa.array([vectors.shape[1]], pa.int64()),
        "nodes": pa.array([[a.tobytes() for a, _ in levels]], pa.list_(pa.binary())),
        "neighbours": pa.array([[b.tobytes() for _, b in levels]], pa.list_(pa.binary())),
    }
    return pa.table(out)


INDEX = "shard long, ids array<array<long>>, vectors binary, width long, nodes array<binary>, neighbours array<binary>"


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: vectors, and for each level its nodes and flat neighbour array.

    Equal vectors are one node with the ``k`` + 1 least keys, all that a query can
    need.  Vectors with different lengths go to different shards.  Shards are dealt by a
    hash of the vector, so each has about ``shard_rows`` nodes.
    """
    usable = vectors.select(F.col(key).cast("long").alias("id"), _usable(vector).alias("vector")).where("id is not null and vector is not null")
    # of each hash part of a group of copies the least keys, then the least of those
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    least = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, k + 1)
    some = usable.withColumn("part", part).groupBy("vector", "part").agg(least(F.collect_list("id")).alias("ids"))
    distinct = cut(some.groupBy("vector").agg(least(F.flatten(F.collect_list("ids"))).alias("ids")))
    shards = -(-distinct.count() // shard_rows) or 1
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)) * WIDTHS + F.size("vector"))
    return dealt.groupBy("shard").applyInArrow(_build, INDEX)


def _search(k: int):
    """Answers blocks of queries; a shard's row, which has no queries, comes before its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for row in range(batch.num_rows):
                value = {name: batch.column(i)[row] for i, name in enumerate(batch.schema.names)}
                if value["query_ids"].as_py() is None:
                    held, width = value["shard"].as_py(), value["width"].as_py()
                    ids = value["ids"].as_py()
                    vectors = np.frombuffer(value["vectors"].as_py()).reshape(-1, width)
                    norms = np.linalg.norm(vectors, axis=1)
                    units = (vectors / norms[:, None]).astype(np.float32)
                    levels = []
                    for a, b in zip(value["nodes"].as_py(), value["neighbours"].as_py(), strict=True):
                        own = np.frombuffer(a, np.int32)
                        levels.append((own, np.frombuffer(b, np.int32).reshape(len(own), -1)))
                    continue
                if held != value["shard"].as_py():  # no vector of this length fell to the shard
                    continue
                queries = np.array(value["query_vectors"].as_py())
                lengths = np.linalg.norm(queries, axis=1)
                found, _ = search_graph(units, levels, (queries / lengths[:, None]).astype(np.float32))
                found = found[:, : 4 * k + 8]
                exact = np.where(found >= 0, np.einsum("qd,qkd->qk", queries, vectors[found]) / (lengths[:, None] * norms[found]), -9)
                q, other, score = [], [], []
                for i, query in enumerate(value["query_ids"].as_py()):
                    rows = [(-s, x, s) for s, j in zip(exact[i].tolist(), found[i].tolist(), strict=True) if j >= 0 for x in ids[j] if x != query]
                    for _, x, s in sorted(rows)[:k]:
                        q.append(query)
                        other.append(x)
                        score.append(s)
                yield pa.record_batch([pa.array(q, pa.int64()), pa.array(other, pa.int64()), pa.array(score, pa.float64())], ["query_id", "id", "score"])

    return run


def nearest(index: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found for each of ``queries`` in all shards.

    Every block of queries goes to every shard of its vectors' length, and every shard to
    one task, which holds its graph and answers the blocks one after another; what is
    shuffled is the index once and the queries once a shard.  The shards' results are
    merged by score, ties to the smaller id.  A query never finds its own id.
    """
    index = cut(index)
    shards = index.agg(F.coalesce(F.max(F.expr(f"shard div {WIDTHS}")) + 1, F.lit(1))).first()[0]
    wanted = queries.select(F.col(key).cast("long").alias("id"), _usable(vector).alias("vector")).where("id is not null and vector is not null").dropDuplicates(["id"])
    wanted = cut(wanted)
    blocks = wanted.count() // QUERY_BLOCK + 1
    packed = wanted.groupBy(F.size("vector").cast("long").alias("width"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "vector")).alias("rows"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("turn")
    packed = packed.select("width", F.col("rows.id").alias("query_ids"), F.col("rows.vector").alias("query_vectors"), every)
    packed = packed.select((F.col("turn") * WIDTHS + F.col("width")).alias("shard"), "query_ids", "query_vectors")
    rows = index.unionByName(packed, allowMissingColumns=True).repartition(max(1, index.count()), "shard").sortWithinPartitions("shard", F.col("query_ids").isNotNull())
    found = rows.select("shard", "ids", "vectors", "width", "nodes", "neighbours", "query_ids", "query_vectors").mapInArrow(_search(k), "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.dropDuplicates(["query_id", "id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def nearest_neighbours(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, key, score) for the rows whose key ``every`` divides, against all rows.

    The score is the cosine of the original vectors in double precision.  Vectors that
    are null, zero or hold null or non-finite components take no part; nor do null keys.
    Of rows with one key, as repeated rows are, each vector is a candidate, and one is
    the query.  Recall is approximate.  An empty table gives an empty result; other
    columns play no part, whatever their names.
    """
    index = build_index(vectors, key, vector, k)
    found = nearest(index, vectors.where(F.col(key) % every == 0), key, vector, k)
    return found.withColumnRenamed("id", key)
