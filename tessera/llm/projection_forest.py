"""Operator 6: near-duplicate vectors by a forest of random-projection trees.

Equal vectors are one node with a number of copies. A bounded sample (at most `sample_rows` vectors,
the least by hash) is split on the driver into `trees` trees: at each tree node the sample is
projected on a random direction, which a seed gives, and cut at the median; vectors within a margin
of the cut go both ways. A tree node that no direction cuts well, as the middle of a dense group, is a
leaf. All nodes then go down all trees, and are compared within leaves, in double precision. A leaf
of more than `block` nodes is compared in pairs of blocks, so no task holds more.

A link found in several leaves counts in the first of those that both vectors share, which each row
knows from the list of its own leaves; so neither pairs nor partners are shuffled. Each leaf gives a
node the count of its links and one edge to the least node it is connected with there.

The search is approximate: a pair that no tree keeps together is missed. With the defaults, tests and
the README compare it with brute force. Leaves hold about `leaf_rows` nodes while there are up to
leaf_rows / 8 times as many nodes as sampled rows, and grow with the input beyond that.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have no
links; vectors of different length have none with each other; repeated rows are copies and link; a
null vec_id is a row like others, and no component's name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._io import materialise
from tessera.llm.components import components

SIMILARITY = 0.9
TREES = 8
LEAF_ROWS = 512
SAMPLE_ROWS = 1 << 15
BLOCK = 2048
#: Margin of a cut in standard deviations of a random unit vector's projection.
MARGIN = 0.126
_TRIES = 3


def direction(seed: int, tree: int, at: int, n_dims: int) -> np.ndarray:
    x = np.random.default_rng([seed, tree, at, n_dims]).standard_normal(n_dims)
    return (x / np.linalg.norm(x)).astype(np.float32)


class Forest:
    """Trees as arrays: the seed and threshold of each inner node's cut, its children, and leaves numbered over all trees."""

    def __init__(self, sample: np.ndarray, leaf_rows: int, trees: int, seed: int):
        self.n_dims, self.margin, self.trees = sample.shape[1], MARGIN / np.sqrt(sample.shape[1]), []
        self.n_leaves, self.seed = 0, seed
        for tree in range(trees):
            nodes: list[tuple] = []
            self.grow(sample, np.arange(len(sample)), tree, nodes, max(8, leaf_rows))
            self.trees.append(nodes)

    def grow(self, x: np.ndarray, own: np.ndarray, tree: int, nodes: list, leaf_rows: int) -> int:
        at = len(nodes)
        nodes.append(None)
        best = None
        for k in range(_TRIES) if len(own) > leaf_rows else ():
            p = x[own] @ direction(self.seed, tree, _TRIES * at + k, self.n_dims)
            cut = float(np.median(p))
            left, right = p <= cut + self.margin, p >= cut - self.margin
            size = max(left.sum(), right.sum())
            if best is None or size < best[0]:
                best = (size, k, cut, left, right)
        if best is None or best[0] > 0.8 * len(own):
            nodes[at] = (self.n_leaves,)
            self.n_leaves += 1
        else:
            _, k, cut, left, right = best
            a = self.grow(x, own[left], tree, nodes, leaf_rows)
            b = self.grow(x, own[right], tree, nodes, leaf_rows)
            nodes[at] = (_TRIES * at + k, cut, a, b)
        return at

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and their leaves, a row once for each leaf."""
        rows, leaves = [], []
        for tree, nodes in enumerate(self.trees):
            todo = [(0, np.arange(len(x)))]
            while todo:
                at, own = todo.pop()
                if len(nodes[at]) == 1:
                    rows.append(own)
                    leaves.append(np.full(len(own), nodes[at][0], np.int64))
                elif len(own):
                    seed, cut, a, b = nodes[at]
                    p = x[own] @ direction(self.seed, tree, seed, self.n_dims)
                    todo += [(a, own[p <= cut + self.margin]), (b, own[p >= cut - self.margin])]
        return np.concatenate(rows), np.concatenate(leaves)


def matrix(column, dtype) -> np.ndarray:
    """Rows of equal length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=dtype)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    most = np.abs(x).max(axis=1, keepdims=True)
    x = x / most  # neither overflow nor underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def compare(table: pa.Table, similarity: float) -> pa.Table:
    """node, links, peer for the rows of a leaf, or of two of its blocks."""
    leaf, i, j = (table.column(k)[0].as_py() for k in ("leaf", "i", "j"))
    block = np.asarray(table.column("own"))
    node, copies = np.asarray(table.column("node")), np.asarray(table.column("copies"))
    x = unit(matrix(table.column("embedding"), np.float64))
    a, b = (np.arange(len(x)),) * 2 if i == j else (np.flatnonzero(block == i), np.flatnonzero(block == j))
    found = [np.zeros((2, 0), np.int64)]
    for s in range(0, len(a), 512):
        r, c = np.nonzero(x[a[s : s + 512]] @ x[b].T >= similarity)
        r, c = a[s + r], b[c]
        keep = r < c if i == j else np.ones(len(r), bool)
        found.append(np.stack([r[keep], c[keep]]))
    one, two = np.concatenate(found, axis=1)
    links = np.zeros(len(x), np.int64)
    if len(one):
        own = np.unique(np.concatenate([one, two]))
        place = np.zeros(len(x), np.int64)
        place[own] = np.arange(len(own))
        lists = table.column("leaves").combine_chunks().take(pa.array(own))
        of, value = np.repeat(np.arange(len(own)), np.diff(np.asarray(lists.offsets))), np.asarray(lists.flatten())
        earlier = value < leaf
        names, column = np.unique(value[earlier], return_inverse=True)
        held = np.zeros((len(own), len(names)), np.float32)
        held[of[earlier], column] = 1
        first = np.ones(len(one), bool)
        for s in range(0, len(one), 1 << 16):
            p, q = place[one[s : s + (1 << 16)]], place[two[s : s + (1 << 16)]]
            if len(names) * len(p) <= 1 << 25:
                first[s : s + (1 << 16)] = ~((held[p] * held[q]).any(axis=1))
            else:
                for u in range(0, len(p), 4096):
                    first[s + u : s + u + 4096] = ~((held[p[u : u + 4096]] * held[q[u : u + 4096]]).any(axis=1))
        np.add.at(links, one[first], copies[two[first]])
        np.add.at(links, two[first], copies[one[first]])
    # the least node reachable within this task
    peer = node.copy()
    while len(one):
        least = np.minimum(peer[one], peer[two])
        before = peer.copy()
        np.minimum.at(peer, one, least)
        np.minimum.at(peer, two, least)
        if (before == peer).all():
            break
    keep = (links > 0) | (peer != node)
    return pa.table({"node": pa.array(node[keep], pa.int64()), "links": pa.array(links[keep], pa.int64()), "peer": pa.array(peer[keep], pa.int64())})


def near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY, trees: int = TREES, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    valid = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)"
    rows = rows.withColumn("h1", F.when(F.expr(f"coalesce({valid}, false)"), F.xxhash64("embedding"))).withColumn("h2", F.hash("embedding"))
    distinct = rows.filter("h1 is not null").groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = materialise(distinct)
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("dims", F.size("embedding")))
    forests = {}
    for dims, n in nodes.groupBy("dims").count().collect():  # as many rows as there are lengths of vectors
        few = nodes.filter(F.col("dims") == dims).orderBy(F.xxhash64("h1", F.lit(seed)), "h1", "h2").limit(sample_rows).select("embedding").toArrow()
        sample = unit(matrix(few.column(0), np.float64)).astype(np.float32)
        forests[dims] = Forest(sample, leaf_rows * len(sample) // n, trees, seed)
    first_leaf, total = {}, 0
    for dims, forest in forests.items():
        first_leaf[dims] = total
        total += forest.n_leaves
    sent = spark.sparkContext.broadcast((forests, first_leaf))  # thresholds of trees over a bounded sample

    def route(batches):
        held, starts = sent.value
        for batch in batches:
            dims = np.asarray(batch.column(2))
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d))
                r, leaf = held[int(d)].route(unit(matrix(own.column(3), np.float64)).astype(np.float32))
                leaf = leaf + starts[int(d)]
                order = np.lexsort((leaf, r))
                r, leaf = r[order], leaf[order]
                ends = np.cumsum(np.bincount(r, minlength=own.num_rows))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(leaf, pa.int64()))
                by = pa.array(r)
                for a in range(0, len(r), 4096):
                    part = by.slice(a, 4096)
                    yield pa.RecordBatch.from_arrays([pa.array(leaf[a : a + 4096], pa.int64()), own.column(0).take(part), own.column(1).take(part), own.column(3).take(part), lists.take(part)], names=["leaf", "node", "copies", "embedding", "leaves"])

    routed = nodes.select("node", "copies", "dims", "embedding").mapInArrow(route, f"leaf long, node long, copies long, embedding {kind}, leaves array<long>")
    routed = materialise(routed)
    large = routed.groupBy("leaf").count().filter(F.col("count") > block).select("leaf", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    dealt = routed.join(large, "leaf", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.expr("cast(pmod(xxhash64(node), parts) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    schema = "node long, links long, peer long"
    found = materialise(dealt.select("leaf", "i", "j", "own", "node", "copies", "embedding", "leaves").groupBy("leaf", "i", "j").applyInArrow(lambda t: compare(t, similarity), schema))

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    named = nodes.select("node", "h1", "h2", "copies", "least").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
