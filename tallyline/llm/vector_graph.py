"""Near-duplicate vectors through robust-pruned graphs on overlapping shards.

Vectors are dealt to the shards of their nearest centroids, several each, so that neighbours share a
shard. On every shard a flat graph is built whose edges survive robust pruning; a vector's
adjacency lists from all its shards are united, and edges are followed both ways. A greedy search from the
vector itself, the medoids and every part that these do not reach, which goes on as long as it meets vectors in
range, then finds each vector's neighbours. The links that it finds make the components, and inside a component every pair
is verified in double precision and counted once, so that it does not matter which shard found it. A sample of queries against all vectors audits the recall; if it falls short,
the shards are compared exactly, then with more shards for each vector, at last as one shard of all vectors. A shard of very many vectors is split into blocks, and
every pair of its blocks is searched by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.components import connected_components
from tallyline.sources.staging import stage

SHARD = 512
"""Vectors per centroid, about."""
MAX_CENTROIDS = 4096
SAMPLE = 8192
"""Vectors the centroids are fitted to, those with the smallest hashes. All vectors are indexed."""
BLOCK = 1024
SHARDS_OF_EACH = 4
DEGREE, POOL, ALPHA = 16, 48, 1.2
BEAM = 24
AT_ONCE = 1 << 17
"""Pairs whose vectors are laid side by side at once."""
AUDITED = 200
ENOUGH, MOST_AUDITED = 50, 8192
"""Queries with true links that an audit needs, and the most queries that it draws for that."""
TARGET_RECALL = 0.95
_VECTOR = "rep long, size long, vector binary"


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``values, dim, least_id, size, rep``: equal usable vectors are one row with the smallest id, their number and a number of their own."""
    values = F.col(vector_col).cast("array<double>")
    usable = (
        F.col(id_col).isNotNull()
        & values.isNotNull()
        & (F.size(values) > 0)
        & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(values, lambda x: x != 0)
    )
    return (
        vectors.filter(F.coalesce(usable, F.lit(False)))
        .groupBy(values.alias("values"))
        .agg(F.min(F.col(id_col).cast("long")).alias("least_id"), F.count("*").alias("size"))
        .select("values", F.size("values").alias("dim"), "least_id", "size", F.monotonically_increasing_id().alias("rep"))
    )


def unit_vectors(distinct: DataFrame) -> DataFrame:
    """``rep, size, vector``: the distinct vectors at length 1, as doubles."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for row in batch["values"].to_pylist():
                x = np.array(row, np.float64)
                # Divided by the largest first, so that no square overflows or vanishes.
                x = x / np.abs(x).max()
                blobs.append((x / np.sqrt(x @ x)).tobytes())
            yield pa.RecordBatch.from_arrays([batch["rep"], batch["size"], pa.array(blobs, pa.binary())], names=["rep", "size", "vector"])

    return distinct.select("rep", "size", "values").mapInArrow(scale, _VECTOR)


def _matrix(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1) if len(blobs) else np.zeros((0, 1))


def centroids(vectors: DataFrame, n: int, seed: int = 3, rounds: int = 4) -> np.ndarray:
    """Directions of ``n`` clusters of a bounded sample."""
    rows = vectors.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vector").collect()
    sample = _matrix([r.vector for r in rows])
    found = sample[np.random.default_rng(seed).permutation(len(sample))[:n]]
    for _ in range(rounds):
        nearest = (sample @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), found)
    return found


def deal(vectors: DataFrame, centres: np.ndarray, each: int) -> DataFrame:
    """Each vector with the numbers of the shards it is dealt to, in order."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = _matrix(batch["vector"].to_pylist()) @ centres.T
            top = np.sort(np.argpartition(-sims, each - 1, axis=1)[:, :each], axis=1) if each < len(centres) else np.tile(np.arange(len(centres)), (len(sims), 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(top.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["rep", "size", "vector", "shards"]
            )

    return vectors.mapInArrow(nearest, f"{_VECTOR}, shards array<int>")


def robust_prune(sims: np.ndarray, degree: int = DEGREE, pool: int = POOL, alpha: float = ALPHA) -> np.ndarray:
    """Neighbour lists of a shard, -1 where there are fewer.

    Of a node's nearest candidates the nearest is taken, those that are nearer to it than to the node, by
    the factor alpha, are dropped, and so on. Distances are Euclidean between directions.
    """
    n = len(sims)
    pool, own = min(pool, n - 1), sims.copy()
    np.fill_diagonal(own, -np.inf)
    candidates = np.argpartition(-own, pool - 1, axis=1)[:, :pool] if pool else np.zeros((n, 0), np.int64)
    near = np.take_along_axis(own, candidates, axis=1)
    out = np.full((n, degree), -1, np.int64)
    rows = np.arange(n)
    for k in range(min(degree, pool)):
        best = near.argmax(axis=1)
        some = near[rows, best] > -np.inf
        if not some.any():
            break
        chosen = candidates[rows, best]
        out[some, k] = chosen[some]
        between = np.maximum(2 - 2 * sims[chosen[:, None], candidates], 0)
        gone = alpha**2 * between <= np.maximum(2 - 2 * near, 0)
        gone[rows, best] = True
        near = np.where(gone, -np.inf, near)
    return out


def both_ways(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct edges between ``n`` nodes and their reverses: where each node's neighbours begin, and the neighbours."""
    code = np.unique(np.concatenate([a * n + b, b * n + a]))
    return np.searchsorted(code, np.arange(n + 1) * n), code % n


def parts(begin: np.ndarray, neighbours: np.ndarray) -> np.ndarray:
    """For each node the smallest node of the part of the graph that it hangs together with."""
    label = np.arange(len(begin) - 1)
    owner = np.repeat(label, np.diff(begin))
    while True:
        low = label.copy()
        np.minimum.at(low, owner, label[neighbours])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def search(
    vectors: np.ndarray, begin: np.ndarray, neighbours: np.ndarray, starts: list[int], reach: float, beam: int = BEAM
) -> np.ndarray:
    """Cosines of all pairs that the greedy search of each vector meets, -inf for the others.

    A search starts at the vector itself and at ``starts``. It expands the nearest node it has met and not expanded. It
    ends when it has expanded a beam's worth and the next node is out of range, and so takes in all in-range nodes that hang together.
    """
    n = len(vectors)
    met, open_ = np.full((n, n), -np.inf), np.full((n, n), -np.inf)
    met[:, starts] = open_[:, starts] = vectors @ vectors[starts].T
    np.fill_diagonal(met, 1.0)
    np.fill_diagonal(open_, 1.0)
    active, expanded = np.arange(n), 0
    while len(active):
        near = open_[active].argmax(axis=1)
        best = open_[active, near]
        go = (best > -np.inf) & ((best >= reach) | (expanded < beam))
        active, near = active[go], near[go]
        if not len(active):
            break
        open_[active, near] = -np.inf
        degree = begin[near + 1] - begin[near]
        who = np.repeat(active, degree)
        found = neighbours[np.arange(len(who)) + np.repeat(begin[near] - np.cumsum(degree) + degree, degree)]
        new = met[who, found] == -np.inf
        who, found = who[new], found[new]
        for i in range(0, len(who), AT_ONCE):
            a, b = who[i : i + AT_ONCE], found[i : i + AT_ONCE]
            met[a, b] = open_[a, b] = np.einsum("ij,ij->i", vectors[a], vectors[b])
        expanded += 1
    return met


def _smallest_reachable(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    least = ids.copy()
    while True:
        step = np.minimum(least, np.where(linked, least[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (step == least).all():
            return least
        least = step


def _block_graph(rows: pd.DataFrame) -> pd.DataFrame:
    vectors = _matrix(rows["vector"].tolist())
    lists = robust_prune(vectors @ vectors.T)
    ids = rows["rep"].to_numpy()
    return pd.DataFrame({"rep": ids, "near": [ids[near[near >= 0]].tolist() for near in lists]})


def _compare_blocks(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """As ``_search_blocks``, by comparing all pairs."""
    ids, vectors, blocks = rows["rep"].to_numpy(), _matrix(rows["vector"].tolist()), rows["block"].to_numpy()
    linked = vectors @ vectors.T >= threshold
    np.fill_diagonal(linked, False)
    if rows["one"].iloc[0] != rows["two"].iloc[0]:
        linked &= blocks[:, None] != blocks[None, :]
    some = linked.any(axis=1)
    return pd.DataFrame({"rep": ids[some], "least": _smallest_reachable(linked, ids)[some]})


def _search_blocks(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Those with links between the two blocks at hand (or inside the one), and the smallest that they reach by these."""
    rows = rows.sort_values("rep", kind="stable").reset_index(drop=True)
    ids, vectors = rows["rep"].to_numpy(), _matrix(rows["vector"].tolist())
    blocks = rows["block"].to_numpy()
    lists = [np.array(x, np.int64) for x in rows["near"]]
    owner, wanted = np.repeat(np.arange(len(ids)), [len(x) for x in lists]), np.concatenate([np.zeros(0, np.int64), *lists])
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    here = ids[at] == wanted
    owner, at = owner[here], at[here]
    begin, neighbours = both_ways(len(ids), owner, at)
    starts = []
    for block in np.unique(blocks):
        inside = np.flatnonzero(blocks == block)
        starts.append(int(inside[(vectors[inside] @ vectors[inside].mean(axis=0)).argmax()]))
    # Besides the medoids, one node of every part that hangs together with neither.
    part = parts(begin, neighbours)
    several = len(starts) > 1
    starts += np.setdiff1d(part, part[starts]).tolist()
    found = search(vectors, begin, neighbours, starts, threshold)
    linked = (found >= threshold) | (found >= threshold).T
    np.fill_diagonal(linked, False)
    if several:
        linked &= blocks[:, None] != blocks[None, :]
    some = linked.any(axis=1)
    return pd.DataFrame({"rep": ids[some], "least": _smallest_reachable(linked, ids)[some]})


def found_links(vectors: DataFrame, centres: np.ndarray, each: int, threshold: float, block: int, exact: bool = False) -> DataFrame:
    """``rep, least`` for every vector and pair of blocks in which it has links. ``exact`` compares the blocks instead of searching them."""
    dealt = stage(deal(vectors, centres, min(each, len(centres))), "dealt")
    entries = dealt.withColumn("shard", F.explode("shards"))
    n_blocks = entries.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("n_blocks"))
    placed = entries.join(F.broadcast(n_blocks), "shard").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int"))
    if exact:
        near, links_between = placed.withColumn("near", F.lit(None).cast("array<long>")), _compare_blocks
    else:
        graphs = placed.select("shard", "block", "rep", "vector").groupBy("shard", "block").applyInPandas(_block_graph, "rep long, near array<long>")
        # At most the shards of each vector times the degree.
        united = stage(graphs.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "adjacency")
        near, links_between = placed.join(united, "rep"), _search_blocks
    pairs = (
        near.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .withColumn("one", F.least("block", "other"))
        .withColumn("two", F.greatest("block", "other"))
    )
    return pairs.select("shard", "one", "two", "block", "rep", "vector", "near").groupBy("shard", "one", "two").applyInPandas(
        lambda rows: links_between(rows, threshold), "rep long, least long"
    )


def _count_pairs(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of each member inside its component: between the two blocks at hand, or inside the one."""
    rows = rows.sort_values(["component", "block"], kind="stable")
    ids, sizes, blocks = (rows[name].to_numpy() for name in ("rep", "size", "block"))
    vectors, component = _matrix(rows["vector"].tolist()), rows["component"].to_numpy()
    across = rows["one"].iloc[0] != rows["two"].iloc[0]
    n_links = np.zeros(len(rows), np.int64)
    edges = np.flatnonzero(component[1:] != component[:-1]) + 1
    for lo, hi in zip([0, *edges], [*edges, len(rows)]):
        linked = vectors[lo:hi] @ vectors[lo:hi].T >= threshold
        if across:
            linked &= blocks[lo:hi, None] != blocks[None, lo:hi]
        else:
            np.fill_diagonal(linked, False)
        n_links[lo:hi] = linked @ sizes[lo:hi]
    return pd.DataFrame({"rep": ids, "n_links": n_links})


def counted_links(vectors: DataFrame, components: DataFrame, threshold: float, block: int) -> DataFrame:
    """``rep, n_links`` for the members of components, in one row or several.

    Each pair of a component is compared once, in whatever shard its link was found, and also if it was found in none. Small
    components are compared many at a time, large ones two blocks at a time.
    """
    n_members = components.groupBy("component").agg(F.count("*").alias("members"))
    # At most one row per block's worth of vectors.
    large = n_members.filter(F.col("members") > block).select("component", F.ceil(F.col("members") / block).cast("int").alias("n_blocks"))
    members = vectors.join(components.withColumnRenamed("node", "rep"), "rep").join(F.broadcast(large), "component", "left")
    bins = max(1, -(-4 * components.count() // block))
    placed = (
        members.withColumn("large", F.col("n_blocks").isNotNull())
        .withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
        .withColumn("bin", F.when(F.col("large"), F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(bins))))
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .withColumn("one", F.least("block", "other"))
        .withColumn("two", F.greatest("block", "other"))
    )
    return placed.select("large", "bin", "one", "two", "block", "component", "rep", "size", "vector").groupBy("large", "bin", "one", "two").applyInPandas(
        lambda rows: _count_pairs(rows, threshold), "rep long, n_links long"
    )


def linked_components(found: DataFrame) -> DataFrame:
    """``node, component`` for the vectors that have links."""
    links = stage(found.select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct(), "reached")
    return stage(connected_components(links), "components")


def audit(vectors: DataFrame, counts: DataFrame, threshold: float, n: int = AUDITED) -> float | None:
    """Recall of the links, averaged over the vectors that have true links: some queries against all vectors, in blocks.

    Queries are drawn by hash from the vectors with found links and, ten times as many, from those without, and count for as
    many as they stand for, so that a large group does not speak for the rest. Where too few of them have true links, more are
    drawn. None if links are so rare that none of ``MOST_AUDITED`` has one.
    """
    got = counts.groupBy("rep").agg(F.sum("n_links").alias("got")).filter("got > 0")
    drawn = stage(vectors.join(got, "rep", "left").select("rep", "vector", F.coalesce("got", F.lit(0)).alias("got")), "audited")
    n_with, n_all = drawn.filter("got > 0").count(), drawn.count()
    order = F.xxhash64(F.lit("audit"), "rep"), "rep"
    while True:
        some = drawn.filter("got > 0").orderBy(*order).limit(n).collect()
        others = drawn.filter("got = 0").orderBy(*order).limit(min(10 * n, MOST_AUDITED)).collect()
        rows = [*some, *others]
        ids, queries, found = np.array([r.rep for r in rows], np.int64), _matrix([r.vector for r in rows]), np.array([r.got for r in rows])
        stands_for = np.repeat([n_with / max(len(some), 1), (n_all - n_with) / max(len(others), 1)], [len(some), len(others)])

        def compare(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, queries: np.ndarray = queries) -> Iterator[pa.RecordBatch]:
            true = np.zeros(len(ids), np.int64)
            for batch in batches:
                for k in range(0, len(batch), BLOCK):
                    part = batch.slice(k, BLOCK)
                    near = queries @ _matrix(part["vector"].to_pylist()).T >= threshold
                    near &= ids[:, None] != part["rep"].to_numpy()[None, :]
                    true += near @ part["size"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[true > 0]), pa.array(true[true > 0])], names=["rep", "links"])

        links = {r.rep: r.links for r in vectors.mapInArrow(compare, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links")).collect()}
        true = np.array([links.get(i, 0) for i in ids.tolist()], np.int64)
        if (true > 0).sum() >= ENOUGH or 10 * n >= min(n_all, MOST_AUDITED):
            break
        n *= 4
    if not true.any():
        return 1.0 if len(rows) == n_all else None
    recall = np.minimum(found, true) / np.maximum(true, 1)
    return float(np.average(recall, weights=stands_for * (true > 0)))


def _linked_classes(distinct: DataFrame, threshold: float, each: int, shard: int, block: int, target_recall: float) -> DataFrame:
    """``rep, links, component, recall`` for the distinct vectors of one length."""
    units = stage(unit_vectors(distinct), "vectors")
    n = units.count()
    centres = centroids(units, int(min(MAX_CENTROIDS, max(1, n // shard))))
    exact = False
    while True:
        components = linked_components(found_links(units, centres, each, threshold, block, exact))
        counts = stage(counted_links(units, components, threshold, block), "vector-links")
        recall = audit(units, counts, threshold)
        enough = recall is not None and recall >= target_recall
        # Links too rare to be measured are sought exactly once, in the shards.
        if enough or (exact and (recall is None or len(centres) == 1)):
            break
        # First the same shards, then larger ones, at last one of all vectors, which misses nothing.
        each = 2 * each if exact else each
        exact = True
        if each >= len(centres):
            centres, each = centres[:1], 1
    others = counts.groupBy("rep").agg(F.sum("n_links").alias("others"))
    return (
        units.select("rep", "size")
        .join(others, "rep", "left")
        .join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "rep",
            (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"),
            F.coalesce("component", "rep").alias("component"),
            F.lit(recall).cast("double").alias("recall"),
        )
    )


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.9,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    each: int = SHARDS_OF_EACH,
    shard: int = SHARD,
    block: int = BLOCK,
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept, audited_recall``.

    Two vectors are linked when their cosine in double precision is at least ``threshold``. Vectors that are
    null, empty or zero or hold null or non-finite numbers are linked with nothing and are components of their own, and so are
    vectors with a null id. Equal vectors are linked; rows of one id with different vectors are vectors of their own, each with its row. Vectors of different
    lengths are not linked; those of each length are searched by themselves. ``audited_recall`` is null where links are too rare to tell, even
    after the shards were compared exactly. An empty table gives an empty result. Writes several tables on the way.
    """
    values = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), values.alias("values"))
    distinct = stage(distinct_vectors(rows, "vec_id", "values"), "distinct-vectors")
    # As many as there are models in the table; one, as a rule.
    lengths = sorted(r.dim for r in distinct.select("dim").distinct().collect())
    parts = [_linked_classes(distinct.filter(F.col("dim") == dim), threshold, each, shard, block, target_recall) for dim in lengths]
    nothing = distinct.limit(0).select("rep", F.lit(0).cast("long").alias("links"), F.col("rep").alias("component"), F.lit(1.0).alias("recall"))
    classes = reduce(DataFrame.unionByName, parts, nothing)
    smallest = classes.join(distinct.select("rep", "least_id"), "rep").groupBy("component").agg(F.min("least_id").alias("component_id"))
    told = distinct.select(F.col("values").alias("same"), "rep").join(classes, "rep").join(smallest, "component")
    # Rows find their class by the vector itself; many equal ones are rows of one key, which Spark splits.
    joined = rows.join(told, F.col("values") == F.col("same"), "left").withColumn("usable", F.col("component").isNotNull() & F.col("vec_id").isNotNull())
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id",
        F.when(F.col("usable"), F.col("links")).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
        F.col("recall").alias("audited_recall"),
    )
