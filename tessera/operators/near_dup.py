"""Near-duplicate clusters: MinHash signatures in Arrow, bands, and links verified on the shingles.

dedup.near_duplicate_clusters stays an interface that raises; this is the function that does the work. Rows
with the same set of shingles (by its size and two hashes of 64 bits) are one node from the start. A first pass keeps
numbers and bands of each row alone; sets of shingles, which are larger than the texts, are made again for nodes of pairs. Nodes that agree in a band meet in a bucket, and
there each is held against the bucket's least node alone; what this connects needs no further pair. Only nodes
that are not connected to their bucket's least node are held against the bucket's others. All links are
Jaccard similarities of whole sets of shingles (as 64-bit hashes); a pair can be missed only if it shares no
band, with a chance below 1 - RECALL at the threshold itself and less above it.

Defined results: null and blank texts link with nothing; a text of fewer words than a shingle is one shingle;
rows that repeat a key are one node; a row without key is a cluster of its own with a null id; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.batches import bounded, joined, slices
from tessera.sources.shared import drop, materialise

WIDTH = 5
RECALL = 0.99


def rows_per_band(num_perm: int, threshold: float, recall: float = RECALL) -> int:
    """The longest band with which pairs at the threshold share one of num_perm // length bands at least so often."""
    fit = [r for r in range(1, num_perm + 1) if 1 - (1 - threshold**r) ** (num_perm // r) >= recall]
    return max(fit, default=1)


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is worked out once, though expressions over it name it many times."""
    return rows.select("*", F.explode(F.array(F.struct(value.alias("v")))).alias("_made")).select(*rows.columns, F.col("_made.v").alias(name))


def shingles(words: Column, width: int = WIDTH) -> Column:
    """Sorted distinct hashes of each `width` words in a row; null where there are no words."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - width + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, width), " ")))
    return F.when(F.size(words) > 0, F.array_sort(F.array_distinct(runs)))


def signature(hashes: Column, num_perm: int) -> Column:
    """For each of num_perm hash functions the least value over all shingles; null where there are none.

    Functions of 64 bits (exclusive or, odd factor, shift, odd factor) over a slice of rows at a time: lambdas of Spark, which are not
    compiled, would be run num_perm times a shingle.
    """
    bounded()

    @F.arrow_udf("array<bigint>")
    def least(column: pa.Array) -> pa.Array:
        rng = np.random.Generator(np.random.PCG64(1))
        salt, one, two = (rng.integers(0, 1 << 64, num_perm, dtype=np.uint64) for _ in range(3))
        one, two = one | np.uint64(1), two | np.uint64(1)
        kind, out = pa.list_(pa.int64()), []
        for part in slices(column, 8):
            n = np.asarray(pc.fill_null(pc.list_value_length(part), 0), np.int64)
            filled = np.flatnonzero(n)
            starts = (np.cumsum(n) - n)[filled]
            values = np.asarray(part.flatten()).view(np.uint64)
            found = np.empty((len(filled), num_perm), np.int64)
            for k in range(num_perm if len(filled) else 0):
                x = (values ^ salt[k]) * one[k]
                found[:, k] = np.minimum.reduceat((x ^ (x >> np.uint64(32))) * two[k], starts).view(np.int64)
            bounds = np.concatenate([[0], np.cumsum(np.where(n > 0, num_perm, 0))])
            out.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found.ravel()), mask=pa.array(n == 0)))
        return joined(out, kind)

    return least(hashes)


def bands(signature_: Column, num_perm: int, length: int) -> Column:
    """A key for each band."""
    starts = F.sequence(F.lit(1), F.lit(num_perm // length * length), F.lit(length))
    return F.transform(starts, lambda i: F.xxhash64(i, F.slice(signature_, i, length)))


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node that links a - b reach from it.

    Each round hangs every root below the least root beside any of its nodes, then shortens the way up; the number
    of rounds grows with the logarithm of the longest path in practice.
    """
    edges = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = materialise(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    while True:
        beside = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        up = materialise(labels.join(beside, F.col("node") == F.col("a")).groupBy("root").agg(F.min(F.least("root", "near")).alias("up")))
        if up.filter("root <> up").isEmpty():
            return labels
        for _ in range(2):  # a root's root's root
            higher = up.select(F.col("root").alias("up"), F.col("up").alias("higher"))
            up = up.join(higher, "up", "left").select("root", F.coalesce("higher", "up").alias("up"))
        labels = materialise(labels.join(up, "root").select("node", F.col("up").alias("root")))


def _linked(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs a, b whose sets reach the threshold."""
    sets = nodes.select("node", "hashes")
    both = pairs.join(sets.toDF("a", "one"), "a").join(sets.toDF("b", "other"), "b")
    shared = F.size(F.array_intersect("one", "other"))
    return both.filter(shared >= threshold * (F.size("one") + F.size("other") - shared) - 1e-9).select("a", "b")


def clusters(df: DataFrame, key: str, text: str = "text", threshold: float = 0.8, num_perm: int = 128, width: int = WIDTH) -> DataFrame:
    """Every row's key, with cluster (the least key that links reach) and n_shingles."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be within (0, 1]")
    length = rows_per_band(num_perm, threshold)
    words = F.filter(F.split(tx.fold_ws(F.col("text")), " "), lambda w: w != "")
    shingled = _once(_once(df.select(F.col(key).alias("id"), F.col(text).alias("text")), "words", words), "hashes", shingles(F.col("words"), width))
    prints = {"n": F.size("hashes"), "same": F.when(F.col("hashes").isNotNull(), F.xxhash64("hashes")), "other": F.when(F.col("hashes").isNotNull(), F.xxhash64(F.lit(1), "hashes"))}
    signed = _once(shingled, "signature", signature(F.col("hashes"), num_perm))
    rows = materialise(signed.select("id", *[x.alias(c) for c, x in prints.items()], bands(F.col("signature"), num_perm, length).alias("bands")))
    named = rows.filter("id is not null and same is not null").select("id", "n", "same", "other")
    nodes = materialise(named.groupBy("n", "same", "other").agg(F.min("id").alias("node")))
    copies = named.join(nodes, ["n", "same", "other"]).filter("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b"))
    # a node's bands are those of any of its rows
    once = rows.filter("same is not null").join(nodes.withColumnRenamed("node", "id"), ["id", "n", "same", "other"], "left_semi").dropDuplicates(["id", "n", "same", "other"])
    keyed = materialise(once.select(F.col("id").alias("node"), "n", F.explode("bands").alias("band")))
    hubs = keyed.groupBy("band").agg(F.min(F.struct("node", "n")).alias("least"), F.count("*").alias("members")).filter("members > 1")
    members = materialise(keyed.join(hubs.select("band", F.col("least.node").alias("hub"), F.col("least.n").alias("hub_n")), "band"))
    drop(keyed)
    fit = "least({0}, {1}) >= " + repr(threshold) + " * greatest({0}, {1}) - 1e-9"  # sizes that can reach the threshold
    first = materialise(members.filter("node <> hub and " + fit.format("n", "hub_n")).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())

    def sets(pairs: DataFrame) -> DataFrame:
        """The sets of the nodes of pairs, from the texts."""
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        own = nodes.withColumnRenamed("node", "id").join(ids, "id")
        texts = df.select(F.col(key).alias("id"), F.col(text).alias("text")).join(ids, "id", "left_semi")
        made = _once(_once(texts, "words", words), "hashes", shingles(F.col("words"), width)).select("id", "hashes", *[x.alias(c) for c, x in prints.items()])
        return materialise(made.join(own, ["id", "n", "same", "other"]).dropDuplicates(["id", "n", "same", "other"]).select(F.col("id").alias("node"), "hashes"))

    own_sets = sets(first)
    linked = materialise(_linked(first, own_sets, threshold))
    drop(own_sets)
    roots = components(linked)
    rooted = members.join(roots.toDF("node", "root"), "node", "left").join(roots.toDF("hub", "hub_root"), "hub", "left")
    rooted = rooted.select("band", "node", "n", F.coalesce("root", "node").alias("root"), (F.coalesce("root", "node") != F.coalesce("hub_root", "hub")).alias("apart"))
    rooted = materialise(rooted)
    left, right = (rooted.toDF("band", f"{s}_node", f"{s}_n", f"{s}_root", f"{s}_apart") for s in "lr")
    # the pairs of a bucket with a node that its hub did not connect, each once, of sizes that can reach the threshold
    once = "l_apart and l_root <> r_root and (not r_apart or l_node < r_node)"
    rest = left.join(right, "band").filter(f"{once} and {fit.format('l_n', 'r_n')}").select(F.least("l_node", "r_node").alias("a"), F.greatest("l_node", "r_node").alias("b"))
    rest = materialise(rest.distinct().join(first, ["a", "b"], "left_anti"))
    drop(rooted)
    drop(members)
    own_sets = sets(rest)
    links = materialise(linked.union(_linked(rest, own_sets, threshold)).union(copies))
    drop(own_sets)
    found = components(links).select(F.col("node").alias("id"), F.col("root").alias("cluster"))
    return rows.join(found, "id", "left").select(F.col("id").alias(key), F.coalesce("cluster", "id").alias("cluster"), F.expr("if(same is null, 0, n)").cast("long").alias("n_shingles"))
