"""Operator 8: near-duplicate documents by an exact Jaccard join on word shingles.

1. One scan takes each text's distinct shingles (64-bit hashes), its class (texts with equal sets are
   one node from here on) and, per chunk of text, how many sets hold each shingle. These counts
   travel as sorted, compressed arrays by range of the hash, not as a row per shingle.
2. Ranges add the counts up and tell each chunk which of its shingles stand in two sets or more.
3. Each chunk orders every set rare-first and drops sets too few of whose shingles occur elsewhere.
   The prefix n - ceil(t n) + 1 of the others is indexed; shingles of one set alone need no entry.
4. Every node is first checked against one hub, of all nodes in its prefix lists the one whose shingles
   are the most common, which joins groups of copies with as many comparisons as members. Then all pairs that share a prefix shingle and lie
   in different components pass the length and positional filters, are made distinct, and are
   verified once, the suffix filter before the exact count. Pairs within a component cannot change it.

No pair is dropped: a pair above the threshold shares a prefix shingle whatever the order is, and
only pairs already connected are passed over. Hashes of 64 bits stand for shingles and for sets.

Defined results: texts without words (null, empty, blank) have n_shingles 0 and are their own
component; with fewer words than the width the whole sequence is the one shingle; repeated rows and
repeated doc_ids are rows of their own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _text as t
from tessera.llm._io import CHUNK_BYTES, arrow_limits, id_and_text, drop, materialise, rows_of, text_bytes
from tessera.llm.components import components

WIDTH = 5
PERCENT = 75
#: Shingles in one range of hashes, which one task adds up.
RANGE_SHINGLES = 1 << 21


def at_least(percent: int, n):
    """The least overlap that lets a set of n be similar to any other: ceil(t n)."""
    return -((-percent * n) // 100)


def _pack(slots: np.ndarray, counts: np.ndarray) -> bytes:
    import zstandard

    steps = np.diff(slots, prepend=slots[:1] * 0).astype("<u8").view(np.uint8).reshape(-1, 8).T
    many = counts.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([np.ascontiguousarray(steps), np.ascontiguousarray(many)]).tobytes())


def _unpack(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8).reshape(12, -1)
    steps = np.ascontiguousarray(raw[:8].T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64), np.ascontiguousarray(raw[8:].T).view("<u4").ravel()


def _node(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _scan(documents: DataFrame, width: int, bits: int, range_bits: int, chunk_bytes: int) -> DataFrame:
    """kind 0: a chunk's doc_ids, set sizes, nodes and texts; kind 1: a chunk's counts within a range."""
    schema = "kind int, chunk long, range long, doc_ids array<long>, sizes array<long>, nodes array<long>, blob binary"

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        names = ["kind", "chunk", "range", "doc_ids", "sizes", "nodes", "blob"]

        def rows(*found):
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), types, strict=True)], names=names)

        def chunk():
            slots, counts = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), return_counts=True)
            cuts = np.searchsorted(slots >> np.uint64(bits - range_bits), np.arange((1 << range_bits) + 1, dtype=np.uint64))
            for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if b > a:
                    yield rows((1, at, r, None, None, None, _pack(slots[a:b], counts[a:b])))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("text", pa.large_string())])) as writer:
                for x in texts:
                    writer.write_batch(pa.RecordBatch.from_arrays([x.cast(pa.large_string())], names=["text"]))
            yield rows((0, at, None, docs, sizes, nodes, zstandard.ZstdCompressor(level=3).compress(sink.getvalue())))

        docs, sizes, nodes, texts, hashes, seen, size = [], [], [], [], [], set(), 0
        for batch in batches:
            for a, b in t.pieces(batch.column(1)):
                column = batch.column(1).slice(a, b - a)
                found = t.Shingles(column, width)
                own = [_node(found[i]) if found.sizes[i] else None for i in range(len(column))]
                new = np.zeros(len(column), bool)
                for i, x in enumerate(own):  # equal sets count once in a chunk
                    if x is not None and x not in seen:
                        seen.add(x)
                        new[i] = True
                hashes.append(found.hashes[new[found.of]] >> np.uint64(64 - bits))
                docs += batch.column(0).slice(a, b - a).to_pylist()
                sizes += found.sizes.tolist()
                nodes += own
                texts.append(column)
                size += column.nbytes
                if size >= chunk_bytes:
                    yield from chunk()
                    docs, sizes, nodes, texts, hashes, seen, size, at = [], [], [], [], [], set(), 0, at + 1
        if docs:
            yield from chunk()

    return documents.mapInArrow(run, schema)


def _shared(counts: DataFrame) -> DataFrame:
    """chunk, range, blob: the slots of each chunk that occur twice or more in all, with their counts."""

    def run(table: pa.Table) -> pa.Table:
        chunks, blobs = table.column("chunk").to_pylist(), table.column("blob").to_pylist()
        slots = [_unpack(b) for b in blobs]
        every, where = np.unique(np.concatenate([s for s, _ in slots]), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate([c for _, c in slots]), minlength=len(every)).astype(np.int64)
        out, at = ([], [], []), 0
        for chunk, (own, _) in zip(chunks, slots, strict=True):
            many = total[where[at : at + len(own)]]
            at += len(own)
            keep = many > 1
            if keep.any():
                out[0].append(chunk)
                out[1].append(int(table.column("range")[0].as_py()))
                out[2].append(_pack(own[keep], many[keep]))
        return pa.table({"chunk": pa.array(out[0], pa.int64()), "range": pa.array(out[1], pa.int64()), "blob": pa.array(out[2], pa.binary())})

    return counts.groupBy("range").applyInArrow(run, "chunk long, range long, blob binary")


def _index(scanned: DataFrame, shared: DataFrame, keepers: DataFrame, width: int, percent: int, bits: int) -> DataFrame:
    """node, size, shared, weight, hashes (rare-first), prefix.

    shared: how many shingles of the set occur elsewhere; no other one can be common to two sets, so
    bounds on overlap count these alone. prefix: the hash of each entry and its position among them.
    weight: the mean logarithm of the counts, which is highest at the middle of a group of copies.
    """
    right = shared.select("chunk", "range", "blob", F.lit(None).cast("int").alias("index")).unionByName(keepers.select("chunk", F.lit(None).cast("long").alias("range"), F.lit(None).cast("binary").alias("blob"), "index"))
    left = scanned.filter("kind = 0").select("chunk", "nodes", "blob")
    names = ["node", "size", "shared", "weight", "hashes", "prefix"]

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        import zstandard

        rows, heads = ([], [], [], [], []), ([np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [0])
        kept = set(told.column("index").drop_null().to_pylist())
        blobs = sorted((r, b) for r, b in zip(told.column("range").to_pylist(), told.column("blob").to_pylist(), strict=True) if b is not None)
        parts = [_unpack(b) for _, b in blobs]
        slots = np.concatenate([s for s, _ in parts] or [np.zeros(0, np.uint64)])
        many = np.concatenate([c for _, c in parts] or [np.zeros(0, np.uint32)])
        nodes, at = texts.column("nodes")[0].as_py(), 0
        with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(texts.column("blob")[0].as_py())) as reader:
            for batch in reader:
                found = t.Shingles(batch.column(0), width)
                own = found.hashes >> np.uint64(64 - bits)
                place = np.minimum(np.searchsorted(slots, own), max(0, len(slots) - 1))
                count = np.where(slots[place] == own, many[place], 1) if len(slots) else np.ones(len(own), np.int64)
                elsewhere = np.concatenate([[0], np.cumsum(count > 1)])
                for i in range(len(batch)):
                    a, b = found.bounds[i], found.bounds[i + 1]
                    n = int(b - a)
                    shared = int(elsewhere[b] - elsewhere[a])
                    if n and at + i in kept and shared >= at_least(percent, n):
                        order = np.lexsort((found.hashes[a:b], count[a:b]))
                        hashes = found.hashes[a:b][order]
                        head = hashes[n - shared : n - at_least(percent, n) + 1]
                        rows[0].append(nodes[at + i])
                        rows[1].append(n)
                        rows[2].append(shared)
                        rows[3].append(float(np.log2(count[a:b]).mean()))
                        rows[4].append(hashes.astype("<u8").tobytes())
                        heads[0].append(head)
                        heads[1].append(np.arange(len(head)))
                        heads[2].append(heads[2][-1] + len(head))
                at += len(batch)
        entries = pa.StructArray.from_arrays([pa.array(np.concatenate(heads[0]).view(np.int64), pa.int64()), pa.array(np.concatenate(heads[1]), pa.int32())], names=["h", "pos"])
        prefix = pa.ListArray.from_arrays(pa.array(heads[2], pa.int32()), entries)
        types = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary()]
        return pa.Table.from_arrays([*(pa.array(c, k) for c, k in zip(rows, types, strict=True)), prefix], names=names)

    return left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(run, "node long, size int, shared int, weight double, hashes binary, prefix array<struct<h: long, pos: int>>")


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int = 3) -> int:
    """A lower bound of the symmetric difference of two sorted arrays, by halving around a probe."""
    if depth == 0 or len(a) == 0 or len(b) == 0:
        return abs(len(a) - len(b))
    middle = len(b) // 2
    probe = b[middle]
    i = int(np.searchsorted(a, probe))
    found = i < len(a) and a[i] == probe
    return suffix_bound(a[:i], b[:middle], depth - 1) + suffix_bound(a[i + found :], b[middle + 1 :], depth - 1) + (not found)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets pass: the suffix filter, then the exact count."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    # 100 o >= p (|a| + |b| - o); difference = |a| + |b| - 2 o
    least = -((-percent * (len(a) + len(b))) // (100 + percent))
    if suffix_bound(a, b) > len(a) + len(b) - 2 * least:
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) >= least


def _sorted_set(blob: bytes) -> np.ndarray:
    return np.sort(np.frombuffer(blob, dtype="<u8"))


def _check_hubs(index: DataFrame, hubs: DataFrame, percent: int, partitions: int) -> DataFrame:
    """a, b for each node that is similar to its hub; sets meet by hub, the hub's own first, and stream by."""
    own = index.select("node", "hashes")
    members = own.join(hubs, "node")
    rows = members.select("hub", F.lit(1).alias("rank"), "node", "hashes").unionByName(own.join(hubs.select(F.col("hub").alias("node")).distinct(), "node").select(F.col("node").alias("hub"), F.lit(0).alias("rank"), "node", "hashes"))

    def run(batches):
        hub, held = None, None
        for batch in batches:
            a, b = [], []
            for h, rank, node, blob in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if rank == 0:
                    hub, held = h, _sorted_set(blob)
                elif h == hub and similar(held, _sorted_set(blob), percent):
                    a.append(node)
                    b.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition(partitions, "hub").sortWithinPartitions("hub", "rank").mapInArrow(run, "a long, b long")


def _check_pairs(index: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    one, two = index.select(F.col("node").alias("a"), F.col("hashes").alias("x")), index.select(F.col("node").alias("b"), F.col("hashes").alias("y"))

    def run(batches):
        for batch in batches:
            keep = [similar(_sorted_set(x.as_py()), _sorted_set(y.as_py()), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _open_pairs(entries: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of nodes in different components that share a prefix entry and pass the filters.

    In each list every component but its largest is paired with the rest of the list, so a large
    group that is one component costs nothing by itself. The positional filter takes the entry for the
    pair's first common one: all overlap lies from it on. A similar pair passes there, and need not
    pass at its later common entries, which keeps it from coming up once for each.
    """
    e = entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = e.groupBy("h", "root").agg(F.count("*").alias("many"))
    lists = sizes.groupBy("h").agg(F.max(F.struct("many", "root")).alias("top"), F.count("*").alias("parts")).filter("parts > 1").select("h", F.col("top.root").alias("largest"))
    open_ = e.join(lists, "h")
    x = open_.filter("root <> largest").select("h", F.col("node").alias("n1"), F.col("size").alias("s1"), F.col("shared").alias("c1"), F.col("pos").alias("p1"), F.col("root").alias("r1"))
    y = open_.select("h", F.col("node").alias("n2"), F.col("size").alias("s2"), F.col("shared").alias("c2"), F.col("pos").alias("p2"), F.col("root").alias("r2"), "largest")
    least = f"{percent} * (s1 + s2)"
    passed = x.join(
        y,
        (x.h == y.h)
        & F.expr("r1 <> r2 and (r2 = largest or n1 < n2)")
        & F.expr(f"100 * least(s1, s2) >= {percent} * greatest(s1, s2)")
        & F.expr(f"{100 + percent} * least(c1 - p1, c2 - p2) >= {least}"),
    )
    return passed.select(F.least("n1", "n2").alias("a"), F.greatest("n1", "n2").alias("b")).distinct()


def near_duplicates(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    spark = documents.sparkSession
    arrow_limits(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    documents = id_and_text(documents)
    most = max(1, text_bytes(documents) // 2)  # shingles there can be
    bits = min(60, max(24, math.ceil(math.log2(most)) + 5))
    range_bits = max(0, math.ceil(math.log2(most / 3 / RANGE_SHINGLES))) if most > 3 * RANGE_SHINGLES else 0
    scanned = materialise(_scan(documents, width, bits, range_bits, chunk_bytes), "kind")
    texts = scanned.filter("kind = 0")
    members = materialise(texts.select("chunk", F.posexplode(F.arrays_zip("doc_ids", "sizes", "nodes")).alias("index", "d")).select("chunk", "index", "d.*").toDF("chunk", "index", "doc_id", "n_shingles", "node"))
    keepers = members.filter("node is not null").groupBy("node").agg(F.min(F.struct("chunk", "index")).alias("k")).select("k.*")
    index = materialise(_index(scanned, _shared(scanned.filter("kind = 1").select("range", "chunk", "blob")), keepers, width, percent, bits))
    drop(scanned)

    entries = index.select("node", "size", "shared", "weight", F.explode("prefix").alias("p")).select("p.h", "p.pos", "node", "size", "shared", "weight")
    hubs = entries.groupBy("h").agg(F.max(F.struct("weight", "node")).alias("hub"), F.count("*").alias("many")).filter("many > 1")
    chosen = entries.select("h", "node").join(hubs, "h").groupBy("node").agg(F.max("hub").alias("hub")).select("node", F.col("hub.node").alias("hub")).filter("hub <> node")
    linked = materialise(_check_hubs(index, chosen, percent, partitions))
    roots = materialise(components(linked))
    pairs = materialise(_open_pairs(entries, roots, percent))
    more = materialise(_check_pairs(index, pairs, percent))
    if more.limit(1).count():
        roots = components(linked.unionByName(more))

    firsts = members.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    rooted = firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("node", "component_id")
    return members.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: that of the least doc_id (null last). Rows are told apart by
    doc_id and text; texts without words are nobody's duplicates, so all their rows stay."""
    version = F.xxhash64(F.col("text").cast("string"))
    # a text, by its hash, is in one component whatever its rows are
    of_text = near_duplicates(docs.select(version.alias("doc_id"), "text")).select(F.col("doc_id").alias("version"), "n_shingles", F.col("component_id").alias("root"))
    of_text = materialise(of_text.groupBy("version").agg(F.max("n_shingles").alias("n_shingles"), F.min("root").alias("root")))
    firsts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), version.alias("version")).groupBy("version").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first"))
    least = firsts.join(of_text.filter("n_shingles > 0"), "version").groupBy("root").agg(F.min(F.struct("first", "version")).alias("kept"))
    kept = least.select(F.col("kept.first.doc_id").alias("doc_id"), F.col("kept.version").alias("version"))
    own = uuid.uuid4().hex  # no column of docs has such a name
    worded = rows_of(docs, kept).withColumn(own, version).dropDuplicates(["doc_id", own]).drop(own)
    blank = of_text.filter("n_shingles = 0").select(F.col("version").alias(own))
    if blank.count() <= 1 << 18:
        blank = F.broadcast(blank)
    return worded.unionByName(docs.join(blank, version == F.col(own), "left_semi"))
