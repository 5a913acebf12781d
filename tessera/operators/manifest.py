"""The identity of a dataset: what it was made from, how, and what came out."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, field, fields
from datetime import UTC, datetime

from tessera import __version__
from tessera.sources import merkle, shard_source
from tessera.sources.shared import save_json


def hash_config(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def hash_files(paths: list[str]) -> str:
    """Over name, NUL, contents, NUL of each file that exists."""
    digest = hashlib.sha256()
    for path in paths:
        if os.path.exists(path):
            digest.update(str(path).encode() + b"\0")
            with open(path, "rb") as file:
                while block := file.read(1 << 16):
                    digest.update(block)
            digest.update(b"\0")
    return digest.hexdigest()


@dataclass
class Manifest:
    name: str = ""
    version: str = ""
    source_files: list[str] = field(default_factory=list)
    source_hash: str = ""
    n_source_records: int = 0
    processing_config: dict = field(default_factory=dict)
    processing_hash: str = ""
    tokenizer_path: str = ""
    tokenizer_version: str = ""
    n_records: int = 0
    n_tokens: int = 0
    n_train_records: int = 0
    n_val_records: int = 0
    shard_count: int = 0
    shard_files: list[str] = field(default_factory=list)
    seed: int = 42
    context_length: int = 0
    identity_hash: str = ""
    created_at: str = ""
    engine_version: str = __version__
    tokenizer_hash: str = ""  # of the vocabulary, which a version does not tell apart
    content_root: str = ""  # over what the shards hold and the tokenizer's hash; not part of the identity

    def identity(self) -> str:
        parts = (self.name, self.version, self.source_hash, self.processing_hash, self.tokenizer_version, self.n_records, self.n_tokens, self.context_length)
        self.identity_hash = hashlib.sha256("".join(map(str, parts)).encode()).hexdigest()
        return self.identity_hash

    def to_dict(self) -> dict:
        self.identity()
        return asdict(self)

    def save(self, path: str) -> None:
        save_json(self.to_dict(), path)

    @classmethod
    def load(cls, path: str) -> Manifest:
        known = {f.name for f in fields(cls)}
        with open(path, encoding="utf-8") as file:
            found = cls(**{k: v for k, v in json.load(file).items() if k in known})
        found.identity()
        return found

    def seal(self, folder: str) -> Manifest:
        """Takes the root over the listings of the shards in folder."""
        self.content_root = merkle.root(shard_source.leaves(shard_source.parts(folder, self.shard_files)), self.tokenizer_hash)
        return self

    def verify(self, folder: str) -> bool:
        """Whether folder holds a manifest of this identity and all its shards, in size and listing what they were.

        No shard is read; changed() reads them.
        """
        path = os.path.join(folder, "manifest.json")
        if not os.path.exists(path) or Manifest.load(path).identity() != self.identity():
            return False
        held = {x["name"]: x["size"] for x in shard_source.parts(folder, self.shard_files)}
        there = all(os.path.isfile(p := os.path.join(folder, x)) and held.get(x, os.path.getsize(p)) == os.path.getsize(p) for x in self.shard_files)
        return there and (not self.content_root or Manifest(shard_files=self.shard_files, tokenizer_hash=self.tokenizer_hash).seal(folder).content_root == self.content_root)

    def changed(self, spark, folder: str) -> list[str]:
        """The shards whose contents are not those listed, read in the executors."""
        own = dict.fromkeys(os.path.dirname(x) for x in self.shard_files)
        return [os.path.join(part, x) for part in own for x in shard_source.changed(spark, os.path.join(folder, part))]


def create(**given) -> Manifest:
    config, files, shards = given.get("processing_config", {}), [str(x) for x in given.get("source_files", [])], given.get("shard_files") or []
    made = Manifest(**{**given, "source_files": files, "source_hash": hash_files(files), "processing_hash": hash_config(config), "n_source_records": given.get("n_records", 0), "shard_files": shards, "shard_count": len(shards), "created_at": datetime.now(UTC).isoformat()})
    made.identity()
    return made
