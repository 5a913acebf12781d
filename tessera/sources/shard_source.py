"""The data source "shards": numbered JSON lines files of token ids, with a listing of what each one holds.

Reading: spark.read.format("shards").load(folder) gives a row per line, with its shard and line; a task
takes several files of about `split_bytes` together, so ten thousand files are one plan node. Files come
from the listing, else from manifest.json, else by name; those that are missing are passed over.

Writing: rows with shard, place, input_ids and text_preview, those of a shard together and in order (shards.write()
sees to it), go to files in a folder of the job's own. On commit, the files of the tasks that count are moved
to their names and the listing is written; a task that fails, or is run twice, leaves nothing behind, nor does
a job that is called off. mode("append") adds shards, mode("overwrite") takes the place of those there are.

Executors and driver must share the folder as a mounted path. A line that is no object gives null ids.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tessera.functions.batches import SLICE_BYTES
from tessera.sources import merkle

READ = "shard string, line long, input_ids array<int>, text_preview string"
LISTING = "_shards.json"
SPLIT_BYTES = 64 << 20


def mounted(path: str) -> str:
    """A path that open() takes."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"shards need a mounted folder, not {path}")
    return path


def listing(folder: str) -> list[dict]:
    """name, records, tokens, size and sha256 of each shard, as written; empty if there is no listing."""
    path = os.path.join(mounted(folder), LISTING)
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as file:
        return json.load(file)["shards"]


def names(folder: str) -> list[str]:
    """The shards of a folder in order."""
    folder = mounted(folder)
    listed = [x["name"] for x in listing(folder)]
    manifest = os.path.join(folder, "manifest.json")
    if not listed and os.path.exists(manifest):
        with open(manifest, encoding="utf-8") as file:
            listed = json.load(file).get("shard_files") or []
    return listed or sorted(x for x in os.listdir(folder) if x.startswith("shard-") and x.endswith(".jsonl"))


def leaves(listed: list[dict]) -> list[str]:
    return [merkle.leaf(x["name"], x["size"], x["sha256"]) for x in listed]


def parts(folder: str, files: list[str]) -> list[dict]:
    """The listings of the subfolders that files ("train/shard-00000.jsonl", ...) are in, names with their folder."""
    out = []
    for part in dict.fromkeys(os.path.dirname(x) for x in files):
        out += [x | {"name": os.path.join(part, x["name"])} for x in listing(os.path.join(folder, part))]
    return out


def changed(spark, folder: str, only_sizes: bool = False) -> list[str]:
    """Names of the shards that are missing or no longer what the listing says; sizes are looked at first, and
    contents are read in the executors unless only_sizes."""
    listed, base = listing(folder), mounted(folder)
    size = lambda x: os.path.getsize(p) if os.path.isfile(p := os.path.join(base, x["name"])) else None
    odd = [x["name"] for x in listed if size(x) != x["size"]]
    if only_sizes:
        return odd
    rest = [x for x in listed if x["name"] not in set(odd)]
    now = {r["path"]: (r["size"], r["sha256"]) for r in merkle.digests(spark, [os.path.join(base, x["name"]) for x in rest]).collect()} if rest else {}
    held = merkle.tree([merkle.leaf(x["name"], *now[os.path.join(base, x["name"])]) for x in rest])
    return sorted(odd + [rest[i]["name"] for i in merkle.differing(merkle.tree(leaves(rest)), held)] if rest else odd)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class ShardReader(DataSourceReader):
    def __init__(self, folder: str, split_bytes: int):
        self.folder, self.split_bytes = mounted(folder), split_bytes

    def partitions(self) -> list[Files]:
        out, size = [[]], 0
        for name in names(self.folder):
            path = os.path.join(self.folder, name)
            if not os.path.isfile(path):
                continue
            own = os.path.getsize(path)
            if out[-1] and size + own > self.split_bytes:
                out.append([])
                size = 0
            out[-1].append(path)
            size += own
        return [Files(tuple(x)) for x in out]

    def read(self, partition: Files) -> Iterator:
        def batch(rows):
            shard, line, ids, preview = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(shard, pa.string()), pa.array(line, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(preview, pa.string())], names=["shard", "line", "input_ids", "text_preview"])

        rows, held = [], 0
        for path in partition.paths:
            with open(path, encoding="utf-8", errors="replace") as file:
                for at, text in enumerate(file):
                    try:
                        record = json.loads(text)
                    except (ValueError, RecursionError):
                        record = None
                    record = record if isinstance(record, dict) else {}
                    ids, preview = record.get("input_ids"), record.get("text_preview")
                    whole = isinstance(ids, list) and (not ids or {int, bool}.issuperset(map(type, ids)) and -(1 << 31) <= min(ids) and max(ids) < 1 << 31)
                    rows.append((os.path.basename(path), at, ids if whole else None, preview if isinstance(preview, str) else None))
                    held += len(text)
                    if held > 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)


@dataclass
class Written(WriterCommitMessage):
    files: tuple[dict, ...]


def lines(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """shard, number of ids and JSON line of each row; ids become text in Arrow, a slice of rows at a time."""
    at = 0
    sizes = pc.fill_null(pc.list_value_length(batch.column("input_ids")), 0).to_pylist()
    while at < len(sizes):
        end, held = at, 0
        while end < len(sizes) and (end == at or held + 8 * sizes[end] <= SLICE_BYTES):
            held += 8 * sizes[end]
            end += 1
        part = batch.slice(at, end - at)
        ids = part.column("input_ids")
        texts = pc.cast(ids.flatten(), pa.string())
        bounds = pa.array([0, *itertools.accumulate(sizes[at:end])], pa.int32())
        named = pc.if_else(pc.is_null(texts), "null", texts) if texts.null_count else texts
        made = pc.binary_join(pa.ListArray.from_arrays(bounds, named), ",").to_pylist()
        for shard, n, some, text, preview in zip(part.column("shard").to_pylist(), sizes[at:end], ids.is_valid().to_pylist(), made, part.column("text_preview").to_pylist(), strict=True):
            listed = f"[{text}]" if some else "null"
            yield shard, n, ('{"input_ids":' + listed + ',"text_preview":' + json.dumps(preview, ensure_ascii=False) + "}\n").encode("utf-8", "replace")
        at = end


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, prefix: str, overwrite: bool):
        self.folder, self.prefix, self.overwrite = mounted(folder), prefix, overwrite
        self.staging = os.path.join(self.folder, f"_staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        """One task: a file for each shard it sees, under a name that no other try of it uses."""
        os.makedirs(self.staging, exist_ok=True)
        out, file, shard = [], None, None

        def finish():
            if file is not None:
                file.close()
                out[-1]["sha256"] = out[-1].pop("digest").hexdigest()

        for own, n, line in (x for batch in iterator for x in lines(batch)):
            if file is None or own != shard:
                finish()
                shard = own
                path = os.path.join(self.staging, uuid.uuid4().hex)
                file = open(path, "wb")
                out.append({"name": f"{self.prefix}-{shard:05d}.jsonl", "path": path, "records": 0, "tokens": 0, "size": 0, "digest": hashlib.sha256()})
            file.write(line)
            last = out[-1]
            last["digest"].update(line)
            last["records"] += 1
            last["tokens"] += n
            last["size"] += len(line)
        finish()
        return Written(tuple(out))

    def commit(self, messages: list[Written | None]) -> None:
        new = sorted((x for m in messages if m is not None for x in m.files), key=lambda x: x["name"])
        kept = [] if self.overwrite else [x for x in listing(self.folder)]
        twice = {x["name"] for x in new} & {x["name"] for x in kept}
        if twice or len({x["name"] for x in new}) < len(new):
            self.abort(messages)
            raise ValueError(f"shards written twice, or there already: {sorted(twice)[:5]}")
        os.makedirs(self.folder, exist_ok=True)
        if self.overwrite:
            for x in os.listdir(self.folder):
                if x.startswith(f"{self.prefix}-") and x.endswith(".jsonl"):
                    os.remove(os.path.join(self.folder, x))
        for x in new:
            os.replace(x.pop("path"), os.path.join(self.folder, x["name"]))
        listed = kept + new
        path = os.path.join(self.folder, LISTING)
        with open(path + ".tmp", "w", encoding="utf-8") as file:
            json.dump({"root": merkle.root(leaves(listed)), "shards": listed}, file, indent=1)
        os.replace(path + ".tmp", path)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class ShardSource(DataSource):
    """Options: path; prefix (of names written, "shard"); split_bytes (read by a task, 64 MB)."""

    @classmethod
    def name(cls) -> str:
        return "shards"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], self.options.get("prefix", "shard"), overwrite)


def register(spark) -> None:
    spark.dataSource.register(ShardSource)
