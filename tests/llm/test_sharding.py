from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyline.llm import queries, sharding
from tests.llm.helpers import AWKWARD, SF, documents


def _plain_table(shards, slots):
    """The same table with the whole permutations spelled out."""
    orders = []
    for name in shards:
        offset, skip = sharding._number("offset", name) % slots, sharding._number("skip", name) % (slots - 1) + 1
        orders.append(iter([(offset + j * skip) % slots for j in range(slots)]))
    owner = {}
    while len(owner) < slots:
        for i, order in enumerate(orders):
            slot = next((s for s in order if s not in owner), None)
            if slot is not None:
                owner[slot] = i
    return [owner[s] for s in range(slots)]


@pytest.mark.parametrize("n", [1, 2, 5, 13])
def test_table_equals_brute_force(n):
    shards = [f"s{i}" for i in range(n)]
    assert sharding.lookup_table(shards, 131) == _plain_table(shards, 131)


def test_shards_own_equal_parts():
    counts = Counter(sharding.lookup_table([f"s{i}" for i in range(64)]))
    assert max(counts.values()) - min(counts.values()) <= 1


def test_losing_a_shard_moves_little():
    shards = [f"s{i}" for i in range(20)]
    before, after = sharding.lookup_table(shards, 10_007), sharding.lookup_table(shards[:-1], 10_007)
    moved = sum(a != b for a, b in zip(before, after) if b != 19 and a != 19)
    assert moved < 0.15 * len(before)


@pytest.mark.parametrize("shards, slots", [([], 7), (["a", "a"], 7), (["a"], 8), (list("abcdefgh"), 7)])
def test_bad_parameters(shards, slots):
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, slots)


def test_rows_keep_their_columns_and_equal_keys_meet(spark):
    df = documents(spark, AWKWARD, ids=[None, None, 1, 1, *range(2, 10)])
    placed = sharding.place_rows(df, ["doc_id"], ["a", "b", "c"])
    assert placed.columns == [*df.columns, "slot", "shard"] and placed.count() == len(AWKWARD)
    owner = sharding.lookup_table(["a", "b", "c"])
    per_key = {}
    for r in placed.collect():
        assert r.shard == "abc"[owner[r.slot]]
        assert per_key.setdefault(r.doc_id, r.slot) == r.slot
    assert "Exchange hashpartitioning" not in placed._jdf.queryExecution().toString()


def test_null_keys_differ_by_place(spark):
    df = spark.createDataFrame([(None, 1), (1, None)], "a int, b int")
    assert len({r.slot for r in sharding.place_rows(df, ["a", "b"], ["x", "y"]).collect()}) == 2


def test_empty_table_and_files(spark, tmp_path):
    assert sharding.place_rows(documents(spark, []), ["doc_id"], ["a"]).count() == 0
    df = documents(spark, [f"t{i}" for i in range(50)])
    sharding.write_shards(sharding.place_rows(df, ["doc_id"], ["a", "b"]), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_the_query_places_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    placed = queries.queries()["op5_sharding"](spark, SF)
    assert placed.columns == [*docs.columns, "slot", "shard"]
    assert placed.select(*docs.columns).exceptAll(docs).isEmpty() and placed.count() == docs.count()


def test_keys_and_columns_named_as_the_results_are(spark, tmp_path):
    df = spark.createDataFrame([(i, f"s{i}", "x", "y") for i in range(40)], "slot long, shard string, c0 string, place string")
    by_slot = {r.place_of: r.shard for r in sharding.place_rows(df.withColumn("place_of", F.col("slot")), ["slot"], ["a", "b", "c"], 101).collect()}
    other = df.withColumnRenamed("slot", "k").withColumn("place_of", F.col("k"))
    assert by_slot == {r.place_of: r.shard for r in sharding.place_rows(other, ["k"], ["a", "b", "c"], 101).collect()}
    placed = sharding.place_rows(df, ["slot", "shard"], ["a", "b", "c"], 101, "home")
    assert placed.columns == ["shard", "c0", "place", "slot", "home"]
    sharding.write_shards(placed, str(tmp_path / "shards"), shard_col="home")
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 40
