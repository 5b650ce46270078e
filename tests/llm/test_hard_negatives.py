from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import hard_negatives, queries
from tests.llm.helpers import LARGER, SF, table

VECTORS = "vec_id long, embedding array<float>, label int, q string, place int, slice string"
IDS_BY_TEN = "vec_id % 10 = 0"


def brute_force(rows, is_anchor, n_positives=5, n_negatives=5, low=80, high=100, scale=256):
    """Every anchor against every row, in Python's whole numbers."""
    usable = []
    for vec_id, values, label in rows:
        if vec_id is None or label is None or not values or any(x is None or not math.isfinite(x) for x in values):
            continue
        usable.append((vec_id, label, [math.floor(scale * float(np.float64(x))) for x in values]))
    out = []
    for a, (anchor_id, label, q) in enumerate(usable):
        if not is_anchor(anchor_id):
            continue
        scored = [(-sum(x * y for x, y in zip(q, r)), vec_id, other) for i, (vec_id, other, r) in enumerate(usable) if i != a and len(r) == len(q)]
        scored.sort()
        for score, positive_id, _ in [s for s in scored if s[2] == label][:n_positives]:
            score = -score
            inside = [s for s in scored if s[2] != label and low * score <= 100 * -s[0] <= high * score][:n_negatives]
            out += [(anchor_id, positive_id, rank, s[1], score, -s[0]) for rank, s in enumerate(inside, 1)]
    return sorted(out)


def mined(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS)


def clustered(seed, n=400, dim=12, clusters=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    of = rng.integers(0, clusters, n)
    x = (centres[of] + 0.3 * rng.normal(size=(n, dim))).astype(np.float32)
    return [(int(i), [float(v) for v in row], int(label)) for i, (row, label) in enumerate(zip(x, np.where(rng.random(n) < 0.7, of, of + 1) % clusters))]


@pytest.mark.parametrize(("block", "per_slice", "group"), [(16, 4, 8), (64, 2, 64)])
def test_against_brute_force(spark, block, per_slice, group):
    rows = clustered(block)
    found = hard_negatives.mine_hard_negatives(vectors(spark, rows), F.expr(IDS_BY_TEN), block=block, per_slice=per_slice, group=group)
    expected = brute_force(rows, lambda i: i % 10 == 0)
    assert mined(found) == expected
    assert len(expected) > 300


def test_ties_equal_rows_and_a_hot_vector(spark):
    """A third of all rows are one vector; small whole components make many equal scores."""
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(v) / 256 for v in rng.integers(-2, 3, 4)], int(rng.integers(0, 3))) for i in range(200)]
    rows += [(int(200 + i), [1.0 / 256, 2.0 / 256, 0.0, 0.0], i % 3) for i in range(100)]
    rows += [(10, [1.0 / 256, 0.0, 0.0, 1.0 / 256], 1), (20, [0.5, 0.5, 0.5, 0.5], 2), (20, [0.5, 0.5, 0.5, 0.5], 2)]
    found = hard_negatives.mine_hard_negatives(vectors(spark, rows).repartition(7), F.expr(IDS_BY_TEN), block=32, per_slice=2, group=4)
    assert mined(found) == brute_force(rows, lambda i: i % 10 == 0)


def test_awkward_rows(spark):
    rows = [
        (0, [0.5, 0.25], 1), (1, [0.5, 0.26], 1), (2, [0.5, 0.2], 2), (3, [0.45, 0.25], None), (4, None, 2), (5, [0.4, None], 2), (6, [float("nan"), 0.1], 2),
        (7, [float("inf"), 0.1], 2), (8, [], 2), (9, [0.45, 0.25], 3), (10, [0.1, 0.2, 0.3], 1), (11, [0.1, 0.2, 0.3], 1), (12, [0.1, 0.2, 0.29], 2),
        (None, [0.5, 0.25], 2), (20, [-0.5, -0.25], 4), (21, [0.5, 0.25], 4), (30, [0.0, 0.0], 5), (31, [0.0, 0.0], 5), (32, [0.0, 0.0], 6),
        (40, [1e30, 1.0], 1), (50, [9000.0, -9000.0, 1.0, 1.0], 1), (51, [9000.0, -9000.0, 1.0, 1.0], 1), (52, [9000.0, -8999.0, 1.0, 1.0], 2), (60, [0.1], 9),
    ]
    found = mined(hard_negatives.mine_hard_negatives(vectors(spark, rows), F.expr(IDS_BY_TEN)))
    # A vector whose score with itself could overflow a long takes no part.
    assert found == brute_force([r for r in rows if r[0] != 40], lambda i: i % 10 == 0)
    assert {r[0] for r in found} >= {0, 10, 30, 50}


def test_empty_tables_and_wrong_sizes(spark):
    empty = vectors(spark, clustered(1, 5)).limit(0)
    assert mined(hard_negatives.mine_hard_negatives(empty, F.expr(IDS_BY_TEN))) == []
    assert mined(hard_negatives.mine_hard_negatives(vectors(spark, clustered(1, 5)), F.lit(False))) == []
    with pytest.raises(ValueError):
        hard_negatives.mine_hard_negatives(empty, F.expr(IDS_BY_TEN), n_positives=0)


def test_other_names_and_numbers(spark):
    rows = clustered(3, 150, 5)
    renamed = vectors(spark, rows).select(F.col("vec_id").alias("id"), F.col("label").alias("kind"), F.col("embedding").alias("x"), "q")
    found = hard_negatives.mine_hard_negatives(renamed, F.col("id") % 10 == 0, 2, 3, 50, 90, 10, "id", "kind", "x", block=20)
    assert mined(found) == brute_force(rows, lambda i: i % 10 == 0, 2, 3, 50, 90, 10)


def test_the_curve_visits_every_cell_by_single_steps():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
        places = hard_negatives.hilbert_places(cells, bits)
        assert sorted(places.tolist()) == list(range(len(cells)))
        along = cells[np.argsort(places)]
        assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_score():
    rng = np.random.default_rng(2)
    anchors, q = rng.integers(-300, 300, (20, 9)), rng.integers(-300, 300, (50, 9))
    least, greatest = hard_negatives.score_bounds(anchors, q.min(axis=0)[None], q.max(axis=0)[None])
    values = hard_negatives.scores(anchors, q)
    assert (values == anchors @ q.T).all()
    assert (least <= values).all() and (values <= greatest).all()


def test_blocks_outside_the_bounds_are_not_read(spark, monkeypatch):
    """Two far clusters: the anchors of one read no block that only holds the other's rows."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(5, 0.1, (512, 6)), rng.normal(-5, 0.1, (512, 6))])
    rows = [(int(i), [float(v) for v in row], int(i % 2)) for i, row in enumerate(x)]
    chosen = []
    stage = hard_negatives.stage
    monkeypatch.setattr(hard_negatives, "stage", lambda df, label: chosen.append((label, stage(df, label))) or chosen[-1][1])
    found = hard_negatives.mine_hard_negatives(vectors(spark, rows), (F.col("vec_id") % 10 == 0) & (F.col("vec_id") < 512), block=32, per_slice=8, group=16)
    assert mined(found) == brute_force(rows, lambda i: i % 10 == 0 and i < 512)
    written = dict(chosen)
    blocks = written["candidate-blocks"].select("block", "ids").collect()
    far = {b.block for b in blocks if np.frombuffer(b.ids, np.int64).min() >= 512}
    read = {block for r in written["block-reads"].select("read").collect() for block in r.read}
    assert far and not read & far


def test_query_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in table("embeddings", LARGER)]
    assert mined(queries.queries()["op13_hard_negatives"](spark, LARGER)) == brute_force(rows, lambda i: i % 100 == 0)


def test_sql_oracle(spark):
    from tests.compare import differences, oracle_rows

    name = "op13_hard_negatives"
    assert differences(queries.queries()[name](spark, SF), oracle_rows(SF, queries.oracle_sql()[name])) == ""
