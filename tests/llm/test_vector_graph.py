from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest

from tallyline.llm import vector_graph

SCHEMA = "vec_id long, embedding array<float>, label int, size int, rep long"


def _expected(ids, vectors, threshold=0.9):
    """Links and components by brute force."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    least = vector_graph._smallest_reachable(linked, np.array(ids, np.int64))
    return {i: (int(n), int(c)) for i, n, c in zip(ids, linked.sum(axis=1), least)}


def _result(spark, rows, **sizes):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, 2) for i, v in rows], SCHEMA)
    return vector_graph.near_duplicates(df, **sizes).collect()


def _clusters(n, copies, seed=0, dim=16, noise=0.05):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n, dim))
    out = [c / np.linalg.norm(c) + rng.normal(0, noise / np.sqrt(dim), dim) for c in centre for _ in range(1 + rng.integers(copies))]
    return np.array(out, np.float32).astype(np.float64)


def _beside_a_hot_group(seed=1):
    """400 near copies of one vector, then small groups."""
    hot = _clusters(1, 1, 5) + np.random.default_rng(seed).normal(0, 0.01, (400, 16))
    return np.concatenate([hot, _clusters(60, 4, 9)]).astype(np.float32).astype(np.float64)


@pytest.mark.parametrize("sizes", [{}, {"shard": 40, "block": 32, "each": 3}])
def test_against_brute_force(spark, sizes):
    vectors = _clusters(150, 6)
    want = _expected(range(len(vectors)), vectors)
    got = _result(spark, list(enumerate(vectors)), **sizes)
    true = sum(n for n, _ in want.values())
    assert sum(r.n_links for r in got) >= 0.95 * true and got[0].audited_recall >= 0.9
    assert all(r.n_links <= want[r.vec_id][0] for r in got)
    assert np.mean([r.component_id == want[r.vec_id][1] for r in got]) > 0.95
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_a_large_group_is_split_into_blocks(spark):
    vectors = np.concatenate([_clusters(1, 1, 5) + np.random.default_rng(1).normal(0, 0.01, (300, 16)), _clusters(100, 2, 9)])
    vectors = vectors.astype(np.float32).astype(np.float64)
    want = _expected(range(len(vectors)), vectors)
    got = {r.vec_id: r for r in _result(spark, list(enumerate(vectors)), shard=50, block=40)}
    assert all(got[i].n_links >= 0.95 * want[i][0] for i in range(300))
    assert len({got[i].component_id for i in range(300)}) == 1


@pytest.mark.parametrize("sizes", [{}, {"shard": 50, "block": 60}])
def test_links_beside_a_hot_group_are_found(spark, sizes):
    vectors = _beside_a_hot_group()
    want = _expected(range(len(vectors)), vectors)
    got = {r.vec_id: r for r in _result(spark, list(enumerate(vectors)), **sizes)}
    outside = range(400, len(vectors))
    assert sum(got[i].n_links for i in outside) >= 0.95 * sum(want[i][0] for i in outside) > 0
    assert np.mean([got[i].component_id == want[i][1] for i in range(len(vectors))]) > 0.95


@pytest.mark.parametrize("block", [1024, 16])
def test_pairs_count_whichever_shard_found_them(spark, block):
    vectors = _beside_a_hot_group()
    want = _expected(range(len(vectors)), vectors)
    rows = [(i, 1, v.tobytes()) for i, v in enumerate(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))]
    units = spark.createDataFrame([(i, n, bytearray(v)) for i, n, v in rows], "rep long, size long, vector binary")
    components = spark.createDataFrame([(i, c) for i, (n, c) in want.items() if n], "node long, component long")
    counts = vector_graph.counted_links(units, components, 0.9, block).groupBy("rep").sum("n_links").collect()
    assert {r[0]: r[1] for r in counts} == {i: n for i, (n, _) in want.items() if n}


def test_links_of_a_component_are_all_counted(spark):
    vectors = _beside_a_hot_group()
    want = _expected(range(len(vectors)), vectors)
    # No single shard of so few vectors finds all links of the large group.
    got = _result(spark, list(enumerate(vectors)), shard=20, block=30, each=2, target_recall=0.0)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want


def _units(spark, vectors):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return spark.createDataFrame([(i, 1, bytearray(v.tobytes())) for i, v in enumerate(unit)], "rep long, size long, vector binary")


def test_audit_is_not_outweighed_by_a_large_group(spark):
    vectors = _beside_a_hot_group()
    want = _expected(range(len(vectors)), vectors)
    found = {i: n for i, (n, _) in want.items() if n and i < 400}
    counts = spark.createDataFrame(list(found.items()), "rep long, n_links long")
    true = sum(n > 0 for n, _ in want.values())
    recall = vector_graph.audit(_units(spark, vectors), counts, 0.9)
    assert recall == pytest.approx(len(found) / true) and recall < 0.95


def test_audit_sees_rare_links(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(3000, 48))
    vectors[1] = vectors[0] + 0.001
    nothing = spark.createDataFrame([], "rep long, n_links long")
    assert vector_graph.audit(_units(spark, vectors), nothing, 0.9) == 0.0


def test_a_missed_target_ends_in_an_exact_comparison(spark):
    rng = np.random.default_rng(8)
    vectors = np.concatenate([rng.normal(size=(300, 24)), np.zeros((300, 24))])
    vectors[300:] = vectors[:300] + rng.normal(0, 0.44, (300, 24))
    vectors = vectors.astype(np.float32).astype(np.float64)
    want = _expected(range(len(vectors)), vectors)
    got = _result(spark, list(enumerate(vectors)), shard=20, block=30, each=1, target_recall=1.0)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and got[0].audited_recall == 1.0


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1, 0]), (1, [2, 0]), (2, [0, 0]), (3, None), (4, [nan, 1]), (5, [inf, 0]), (6, [None, 1]), (7, [1, 0]),
        (8, [1e-30, 0]), (9, [1e30, 1e29]), (None, [1, 0]), (10, []), (11, [0, -1]), (11, [0, -1]), (12, [-0.0, -1]), (3, None),
    ]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in _result(spark, rows)), key=str)
    linked = {0, 1, 7, 8, 9}
    down = {11, 12}
    want = []
    for i, _ in rows:
        if i in linked:
            want.append((i, len(linked) - 1, 0, i == 0))
        elif i in down:
            want.append((i, 2, 11, i == 11))
        else:
            want.append((i, 0, i, True))
    assert got == sorted(want, key=str)


def test_tiny_tables(spark):
    assert _result(spark, []) == []
    assert [(r.n_links, r.component_id) for r in _result(spark, [(5, [1, 2])])] == [(0, 5)]
    assert [(r.n_links, r.component_id) for r in _result(spark, [(5, None)])] == [(0, 5)]


def test_pruned_lists_keep_the_nearest_and_spread():
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(200, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = vectors @ vectors.T
    graph = vector_graph.robust_prune(sims)
    np.fill_diagonal(sims, -1)
    assert (graph[:, 0] == sims.argmax(axis=1)).all()
    assert (graph != np.arange(200)[:, None]).all()
    for i in range(20):
        taken = graph[i][graph[i] >= 0]
        assert len(set(taken.tolist())) == len(taken)


def test_given_table(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    table = pq.read_table(path).to_pandas()
    want = _expected(table.vec_id.tolist(), np.array(table.embedding.tolist(), np.float64))
    got = vector_graph.near_duplicates(spark.read.parquet(path)).collect()
    assert sum(r.n_links for r in got) >= 0.95 * sum(n for n, _ in want.values())
    assert all(r.n_links <= want[r.vec_id][0] for r in got) and len(got) == len(table)


def test_ids_that_repeat_and_lengths_that_differ(spark):
    """One row for each row, whatever their ids; a vector is linked with others of its length only."""
    a, near, b, other = [1.0, 0.0, 0.0], [1.0, 0.01, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, a), (1, b), (1, near), (2, near), (2, b), (3, other), (4, [1.0, 0.0]), (5, [1.0, 0.001]), (6, [1.0]), (7, a), (1, a)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_graph.near_duplicates(df).collect())
    assert got == sorted(
        [(1, 4, 1, True), (1, 1, 1, True), (1, 4, 1, True), (2, 4, 1, False), (2, 1, 1, False), (3, 0, 3, True)]
        + [(4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True), (7, 4, 1, False), (1, 4, 1, True)]
    )
