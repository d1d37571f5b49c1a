"""Near-duplicate vectors against all pairs compared."""

import numpy as np
import pytest

from strataloom.llm.hnsw import build_graph
from strataloom.llm.vector_dedup import _Shard, _Sets, audited_beam, compare, vector_duplicates


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, least=0.9):
    good = [(n, i, np.array(v, float)) for n, (i, v) in enumerate(rows) if usable(v)]
    links = {n: set() for n in range(len(rows))}
    for a, _, v in good:
        for b, _, w in good:
            if a < b and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= least:
                links[a].add(b)
                links[b].add(a)
    out, seen = [None] * len(rows), set()
    for n in range(len(rows)):
        if n in seen:
            continue
        group, todo = [], [n]
        seen.add(n)
        while todo:
            m = todo.pop()
            group.append(m)
            todo += links[m] - seen
            seen |= links[m]
        keys = [rows[m][0] for m in group if rows[m][0] is not None]
        for m in group:
            first = min(keys, default=None)
            out[m] = (rows[m][0], len(links[m]), first, rows[m][0] == first)
    return sorted(out, key=repr)


def planted(seed, width=24):
    """Random vectors with near and exact copies, a chain, a dense group and a wide one about the threshold."""
    random = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    base = unit(random.normal(size=(500, width)))
    near = unit(base[:40] + 0.05 * random.normal(size=(40, width)))
    chain = [base[50]]
    for _ in range(8):
        step = random.normal(size=width)
        step -= step @ chain[-1] * chain[-1]
        chain.append(unit(0.93 * chain[-1] + np.sqrt(1 - 0.93**2) * unit(step)))
    dense = unit(base[60] + 0.02 * random.normal(size=(150, width)))
    wide = unit(base[61] + 0.07 * random.normal(size=(120, width)))
    rows = np.concatenate([base, near, chain[1:], dense, wide, np.repeat(base[70:71], 30, 0), 3 * base[80:90]])
    rows = rows * random.uniform(0.5, 2, size=(len(rows), 1)).round(2)
    rows[-40:-10] = base[70]
    return [(int(i) + 5, v.tolist()) for i, v in zip(random.permutation(len(rows)), rows, strict=True)]


@pytest.mark.parametrize("shard_rows", [1 << 15, 150])
def test_planted_groups(spark, shard_rows):
    rows = planted(2)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, node string, size int")
    got = sorted(map(tuple, vector_duplicates(frame, shard_rows=shard_rows).collect()), key=repr)
    want = brute(rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found <= there and found >= 0.99 * there
    assert np.mean([a == b for a, b in zip(got, want, strict=True)]) >= 0.97
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))  # no link below the threshold


def test_whole_table(spark):
    from strataloom.llm.queries import op13_embedding_near_dedup

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = op13_embedding_near_dedup(spark, "/root/testdata/sf0.01")
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(4, [1.0, 0.0]), (3, [2.0, 0.1]), (9, [0.0, 0.0]), (10, [nan, 1.0]), (11, [inf, 1.0]), (12, None), (13, [None, 1.0]), (14, []), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (20, [1.0, 0.0, 0.0])]
    rows += [(None, [1.0, 0.05]), (None, None), (30, [-0.0, 5.0]), (31, [0.0, 5.0]), (None, [-1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute([(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert sorted(map(tuple, vector_duplicates(frame).collect()), key=repr) == want
    assert vector_duplicates(frame.limit(0)).count() == 0


def shard(vectors, first, beam):
    vectors = np.asarray(vectors, float)
    levels = build_graph((vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32))
    row = {"nodes": np.arange(first, first + len(vectors)).tobytes(), "copies": np.arange(1, len(vectors) + 1).tobytes(), "vectors": vectors.tobytes(), "kind": "f8", "beam": beam}
    return _Shard(row | {"level_nodes": [a.tobytes() for a, _ in levels], "level_links": [b.tobytes() for _, b in levels]})


def test_shards_without_vectors(spark):
    """As many shards as vectors: some stay empty, and no link counts twice."""
    rows = [(i, [1.0, 0.01 * (i % 4)]) for i in range(12)] + [(20, [-1.0, 0.3]), (21, [0.0, 1.0])]
    got = vector_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=1)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("beam", [0, 24, 64])
def test_two_shards_meet(beam):
    """Narrow beams send dense groups to the balls, and wide ones leave them to the search: the counts agree."""
    vectors = np.array([v for _, v in planted(5)])
    half = len(vectors) // 2
    copies = np.concatenate([np.arange(1, half + 1), np.arange(1, len(vectors) - half + 1)])
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = units @ units.T >= 0.9
    np.fill_diagonal(near, False)
    for own in (True, False):
        left, right = shard(vectors[:half], 0, beam), shard(vectors[half:], half, beam)
        node, links, root = compare(left, None if own else right, 0.9)
        mask = near.copy()
        mask[half:, half:] = mask[:half, :half] = False
        want = near[:half, :half] @ copies[:half] if own else mask @ copies
        got = np.zeros(len(want), np.int64)
        got[node] = links
        assert (got <= want).all() and got.sum() >= 0.99 * want.sum()
        sets = _Sets(len(vectors))
        sets.join(*np.nonzero(near if not own else near & (np.arange(len(vectors)) < half) & (np.arange(len(vectors)) < half)[:, None]))
        assert (sets.root[node] == sets.root[root]).all()


def test_beams_widen():
    random = np.random.default_rng(1)
    units = random.normal(size=(3000, 48)).astype(np.float32)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    levels = build_graph(units)
    assert audited_beam(units, levels, 0.9) in (24, 48, 96)
    broken = [(nodes, np.where(random.random(flat.shape) < 0.93, -1, flat)) for nodes, flat in levels]
    assert audited_beam(units, broken, 0.9) != audited_beam(units, levels, 0.9)
