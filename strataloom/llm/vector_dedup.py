"""Near-duplicates among vectors: one small-world graph per shard, searched by all vectors.

Each shard's graph is audited when it is built: probes search it with wider and wider
beams until they find what a scan of the shard finds.  Two shards meet in one task, where
each one's vectors search the other's graph and the cosines of what they find are verified.
A vector whose whole beam is near lies in a dense group; such vectors are gathered in balls,
and angles to a ball's centre tell for most vectors at once that they are near to all of the
ball or to none.  Tasks return counts and one link to a representative, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm.common import cut, join_sized, join_small
from strataloom.llm.hnsw import _usable, build_graph, search_graph
from strataloom.llm.near_dedup import components

#: Most vectors in a shard, and most numbers in their components.
SHARD_ROWS = 1 << 15
SHARD_NUMBERS = 1 << 23
#: Nodes in sight of the narrowest beam; shards of up to twice that are scanned.
BEAM = 24
#: Probes of an audit, and the share of the near vectors that they have to find.
PROBES = 256
AUDIT = 0.995
#: Vectors that search together, and numbers that one product of them makes.
BLOCK = 512
PRODUCT = 1 << 22
#: Cosines of single precision may be off by less than that, and angles in double precision.
SLACK = 1e-5
TURN = 1e-7


class _Shard:
    """Vectors of a shard with their graph, as a task holds them."""

    def __init__(self, row: dict):
        self.nodes, self.copies = (np.frombuffer(row[name], np.int64) for name in ("nodes", "copies"))
        self.vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(len(self.nodes), -1)
        self.norms = np.linalg.norm(self.vectors.astype(np.float64), axis=1)
        self.units = (self.vectors / self.norms[:, None]).astype(np.float32)
        self.beam = row["beam"]
        own = [np.frombuffer(x, np.int32) for x in row["level_nodes"]]
        self.levels = [(x, np.frombuffer(flat, np.int32).reshape(len(x), -1)) for x, flat in zip(own, row["level_links"], strict=True)]

    def cosines(self, mine: np.ndarray, other: _Shard, theirs: np.ndarray) -> np.ndarray:
        """In double precision, of pairs."""
        out = np.empty(len(mine))
        step = max(1, PRODUCT // self.vectors.shape[1])
        for at in range(0, len(mine), step):
            i, j = mine[at : at + step], theirs[at : at + step]
            out[at : at + step] = np.einsum("nd,nd->n", self.vectors[i].astype(np.float64), other.vectors[j].astype(np.float64)) / (self.norms[i] * other.norms[j])
        return out

    def find(self, queries: _Shard, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node) that may be near, and whether a query's beam held nothing but near nodes."""
        if not self.beam:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.ones(len(queries.nodes), bool)
        q, x, full = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for at in range(0, len(queries.nodes), BLOCK):
            found, value = search_graph(self.units, self.levels, queries.units[at : at + BLOCK], self.beam)
            near = (found >= 0) & (value >= least - SLACK)
            full.append(near.all(axis=1))
            rows, places = np.nonzero(near)
            q.append(rows + at)
            x.append(found[rows, places])
        return np.concatenate(q), np.concatenate(x), np.concatenate(full)


def audited_beam(units: np.ndarray, levels: list, least: float, seed: int = 11) -> int:
    """The narrowest beam, doubled from ``BEAM`` on, with which probes find ``AUDIT`` of what is near; 0 for a scan.

    Half of the probes are vectors of the shard, half are vectors turned away from one of
    the shard until they are only just near to it, which are the hardest to find.  What is
    near to a probe is told by a scan of the shard.
    """
    random = np.random.Generator(np.random.PCG64(seed))
    own = random.integers(0, len(units), PROBES)
    probes = units[own].astype(np.float64)
    away = random.normal(size=(PROBES // 2, units.shape[1]))
    away -= np.einsum("nd,nd->n", away, probes[PROBES // 2 :])[:, None] * probes[PROBES // 2 :]
    length = np.linalg.norm(away, axis=1, keepdims=True)
    just = min(1.0, least + 10 * SLACK)
    probes[PROBES // 2 :] = just * probes[PROBES // 2 :] + np.sqrt(1 - just**2) * away / np.where(length > 0, length, 1)
    probes = probes.astype(np.float32)
    near = probes @ units.T >= least
    near[np.arange(PROBES // 2), own[: PROBES // 2]] = False
    beam = BEAM
    while 2 * beam < len(units):
        found, value = search_graph(units, levels, probes, beam)
        full = ((found >= 0) & (value >= least - SLACK)).all(axis=1)
        seen = np.zeros_like(near)
        rows, places = np.nonzero(found >= 0)
        seen[rows, found[rows, places]] = True
        seen[full] = True  # such a query is compared with the whole shard
        if (seen & near).sum() >= AUDIT * near.sum():
            return beam
        beam *= 2
    return 0


_INDEX = "width long, shard long, nodes binary, copies binary, vectors binary, kind string, beam long, level_nodes array<binary>, level_links array<binary>"


def _build(kind: str, least: float):
    def run(rows: pa.Table) -> pa.Table:
        width = rows.column("width")[0].as_py()
        vectors = rows.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, width)
        units = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
        levels = build_graph(units) if len(units) > 2 * BEAM else []
        one = {
            "width": width,
            "shard": rows.column("shard")[0].as_py(),
            "nodes": rows.column("node").to_numpy().astype(np.int64).tobytes(),
            "copies": rows.column("size").to_numpy().astype(np.int64).tobytes(),
            "vectors": vectors.astype(kind).tobytes(),
            "kind": kind,
            "beam": audited_beam(units, levels, least) if levels else 0,
            "level_nodes": [a.astype(np.int32).tobytes() for a, _ in levels],
            "level_links": [b.astype(np.int32).tobytes() for _, b in levels],
        }
        types = {"width": pa.int64(), "shard": pa.int64(), "kind": pa.string(), "beam": pa.int64(), "level_nodes": pa.list_(pa.binary()), "level_links": pa.list_(pa.binary())}
        return pa.table({name: pa.array([value], types.get(name, pa.binary())) for name, value in one.items()})

    return run


class _Sets:
    """Which of some nodes are connected: each points to the root of its set."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            i, j = i[apart], j[apart]
            np.minimum.at(self.root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def _scan(mine: _Shard, dense: np.ndarray, other: _Shard, least: float, link) -> None:
    """Calls ``link(i, j, near)`` for vectors i of ``mine`` in ``dense`` and j of ``other``; near is a matrix, or None for all.

    Dense vectors are gathered in balls of less than half the threshold's angle.  A vector
    whose angle to the centre is smaller than the threshold by the ball's radius is near to
    all of the ball, one beyond by the radius to none; only those between are compared.
    """
    limit = np.arccos(least)
    left = np.flatnonzero(dense)
    own, all_units = (s.vectors / s.norms[:, None] for s in (mine, other))
    angle = lambda units, centre: np.arccos(np.clip(units @ centre, -1, 1))
    while len(left):
        centre = own[left[0]]
        turn = angle(own[left], centre)
        inside = turn <= limit / 2 - TURN
        inside[0] = True
        ball, radius = left[inside], float(turn[inside].max())
        left = left[~inside]
        turn = angle(all_units, centre)
        every = np.flatnonzero(turn + radius <= limit - TURN)
        link(ball, every, None)
        some = np.flatnonzero((turn + radius > limit - TURN) & (turn - radius <= limit + TURN))
        step = max(1, PRODUCT // max(len(some), 1))
        for at in range(0, len(ball) if len(some) else 0, step):
            i = ball[at : at + step]
            product = mine.vectors[i].astype(np.float64) @ other.vectors[some].astype(np.float64).T
            link(i, some, product / (mine.norms[i][:, None] * other.norms[some]) >= least)


def compare(left: _Shard, right: _Shard | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links with copies counted, a node connected to it) of two shards, or of one with itself.

    A pair is a link if the search from either end finds it and its cosine is ``least`` at least.
    """
    own = right is None
    right = left if own else right
    shift = 0 if own else len(left.nodes)
    links = np.zeros(len(left.nodes) + (0 if own else len(right.nodes)), np.int64)
    sets = _Sets(len(links))
    q, x, full_right = left.find(right, least)
    if own:
        q, x, full_left = np.minimum(q, x), np.maximum(q, x), full_right
        q, x = q[q < x], x[q < x]
    else:
        back_q, back_x, full_left = right.find(left, least)
        q, x = np.concatenate([q, back_x]), np.concatenate([x, back_q])
    calm = ~full_right[q] & ~full_left[x]  # the others are found by the scans
    both = np.unique(q[calm] * len(left.nodes) + x[calm])
    q, x = np.divmod(both, len(left.nodes))
    near = right.cosines(q, left, x) >= least
    q, x = q[near], x[near]
    np.add.at(links, q + shift, left.copies[x])
    np.add.at(links, x, right.copies[q])
    sets.join(q + shift, x)

    def linking(mine: _Shard, at: int, other: _Shard, there: int, scanned: np.ndarray):
        def link(i: np.ndarray, j: np.ndarray, near: np.ndarray | None) -> None:
            counted = ~scanned[j]  # a vector that is scanned itself counts its links then
            if near is None:
                if own:
                    links[i] -= mine.copies[i] * np.isin(i, j)
                links[i + at] += other.copies[j].sum()
                links[j[counted] + there] += mine.copies[i].sum()
                if len(j):
                    sets.join(i + at, np.full(len(i), j[0] + there))
                    sets.join(j + there, np.full(len(j), i[0] + at))
            else:
                if own:
                    near = near & (i[:, None] != j)
                links[i + at] += near @ other.copies[j]
                links[j[counted] + there] += mine.copies[i] @ near[:, counted]
                a, b = np.nonzero(near)
                sets.join(i[a] + at, j[b] + there)

        return link

    _scan(right, full_right, left, least, linking(right, shift, left, 0, full_left))
    if not own:
        _scan(left, full_left, right, least, linking(left, 0, right, shift, full_right))
    nodes = left.nodes if own else np.concatenate([left.nodes, right.nodes])
    some = np.flatnonzero(links > 0)
    return nodes[some], links[some], nodes[sets.root[some]]


def _meet(least: float):
    def run(rows: pa.Table) -> pa.Table:
        both = rows.column("low")[0] != rows.column("high")[0]
        shards = [_Shard(row) for row in sorted(rows.to_pylist(), key=lambda row: row["shard"])]
        if both and len(shards) == 1:  # no vector fell to the other shard
            found = (np.zeros(0, np.int64),) * 3
        else:
            found = compare(shards[0], shards[1] if both else None, least)
        return pa.table([pa.array(x) for x in found], ["node", "links", "root"])

    return run


def vector_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(key, n_links, component_id, kept) for every row.

    Vectors are linked if their cosine, in double precision, is ``least`` at least, from 0.5 to
    below 1; ``n_links`` counts the other rows linked to a row, ``component_id`` is the least
    key reachable.  Links are those that the searches find: none below ``least``, and as many
    of the others as the audits of the graphs demand.

    Equal vectors become one node before shards are dealt, so copies add no pairs.  Vectors
    that are null, zero or hold null or non-finite components link with nothing; nor do
    vectors of different lengths with each other.  A row with a null key links like any other,
    and its component is null if no key is reachable.  Repeated keys and repeated rows are
    rows of their own.  An empty table gives an empty result; other columns play no part.
    """
    kind = "f4" if isinstance(vectors.schema[vector].dataType.elementType, T.FloatType) else "f8"
    rows = vectors.select(F.col(key).cast("long").alias("id"), _usable(vector).alias("vector"))
    usable = rows.where("vector is not null")
    nodes = usable.groupBy("vector").agg(F.min("id").alias("least"), F.count("*").alias("size")).withColumn("node", F.monotonically_increasing_id())
    nodes = cut(nodes.withColumn("width", F.size("vector").cast("long")))
    most = F.greatest(F.lit(1), F.least(F.lit(shard_rows), F.expr(f"int({SHARD_NUMBERS} / width)")))
    widths = cut(nodes.groupBy("width").agg(F.count("*").alias("n")).select("width", F.ceil(F.col("n") / most).alias("shards")))
    dealt = join_small(nodes, widths, "width", "inner", 16).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")))
    index = cut(dealt.groupBy("width", "shard").applyInArrow(_build(kind, least), _INDEX))
    # a shard meets itself and every other of its width once, in the task of the lesser and the greater number
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("with")
    meeting = join_small(index, widths, "width", "inner", 16).select(*index.columns, every)
    meeting = meeting.withColumns({"low": F.least("shard", "with"), "high": F.greatest("shard", "with")}).drop("with")
    found = cut(meeting.groupBy("width", "low", "high").applyInArrow(_meet(least), "node long, links long, root long"))

    parts = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    known = parts.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("first"))
    reached = parts.join(known, "component").select("node", "first")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    told = nodes.join(counts, "node", "left").join(reached, "node", "left")
    links = (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")
    told = cut(told.select("vector", "size", links, F.coalesce("first", "least").alias("component_id")))
    row_bytes = 64 + 8 * (widths.agg(F.max("width")).first()[0] or 0)
    out = join_sized(usable, told, "vector", row_bytes).select("id", "n_links", "component_id")
    alone = rows.where("vector is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
