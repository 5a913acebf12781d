"""From raw JSON lines to shards and a manifest, and the checks before training."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import clean, dedup, manifest, pack, split, validate
from tessera.operators.bpe import Tokenizer
from tessera.operators.validate import ConfigError
from tessera.sources import jsonl, shards
from tessera.sources.shared import materialise


@dataclass
class PipelineConfig:
    name: str = "dataset"
    version: str = "0.1.0"
    input_paths: list[str] = field(default_factory=list)
    text_field: str = "text"
    min_chars: int = 1
    max_chars: int = 1_000_000
    unicode_normalization: str = "NFC"
    normalize_whitespace: bool = True
    remove_control_chars: bool = True
    remove_empty: bool = True
    remove_excessive_repetition: bool = True
    dedup_normalization: str = "whitespace"
    validation_ratio: float = 0.05
    test_ratio: float = 0.0
    seed: int = 42
    tokenizer_path: str = ""
    context_length: int = 256
    shard_size: int = 10_000
    output_dir: str = "data/processed"
    write_test: bool = False
    enforce_validation: bool = False

    def hashed(self) -> dict:
        """What decides the output, and so the dataset's identity."""
        names = "text_field min_chars max_chars unicode_normalization normalize_whitespace remove_control_chars remove_empty remove_excessive_repetition dedup_normalization validation_ratio test_ratio seed context_length shard_size".split()
        return {n: getattr(self, n) for n in names}

    def cleaning(self) -> clean.CleaningConfig:
        return clean.CleaningConfig(self.unicode_normalization, self.normalize_whitespace, self.remove_control_chars, self.remove_empty, self.remove_excessive_repetition)


@dataclass
class PipelineResult:
    n_input: int
    n_valid: int
    n_clean: int
    n_unique: int
    n_train: int
    n_val: int
    n_tokens: int
    n_shards: int
    output_dir: str
    manifest: manifest.Manifest

    def to_dict(self) -> dict:
        return asdict(self) | {"manifest": self.manifest.to_dict()}


def run(spark: SparkSession, config: PipelineConfig) -> PipelineResult:
    """Validate (a report only, unless enforced), clean, deduplicate, split, tokenize, shard, manifest.

    The cleaned, deduplicated texts are written once; ids are made on the way into the shards.
    """
    files = jsonl.expand(config.input_paths)
    report = validate.validate_files(spark, files, validate.ValidationConfig(config.text_field, config.min_chars, config.max_chars, check_duplicates=False))
    loaded = jsonl.load(spark, files, config.text_field)
    if config.enforce_validation:
        within = F.length("text").between(config.min_chars, config.max_chars or (1 << 31) - 1)
        loaded = loaded.filter(within)
    cleaned = materialise(clean.clean(loaded, "text", config.cleaning()).select("file", "block", "seq", "text"))
    n_clean = cleaned.count()
    unique = materialise(dedup.first_wins(cleaned, "file", "block", "seq", normalization=config.dedup_normalization))
    n_unique = unique.count()
    n_train, n_val, _ = split.sizes(n_unique, config.validation_ratio, config.test_ratio)
    parts = split.seeded(unique, "file", "block", "seq", validation_ratio=config.validation_ratio, test_ratio=config.test_ratio, seed=config.seed)
    tokenizer = Tokenizer.load(config.tokenizer_path)
    ids = tokenizer.encode_column(F.col("text"), spark, add_eos=True)
    rows = materialise(parts.select("split", "split_rank", pack.truncate(ids, config.context_length).alias("input_ids"), tx.preview(F.col("text")).alias("text_preview")))
    names: list[str] = []
    n_tokens = 0
    for part in ("train", "val", *(["test"] if config.write_test else [])):
        own = shards.assign(rows.filter(F.col("split") == part), "split_rank", shard_size=config.shard_size)
        own = materialise(own)
        names += [f"{part}/{x}" for x in shards.write(own, os.path.join(config.output_dir, part))]
        n_tokens += int(own.agg(F.coalesce(F.sum(F.size("input_ids")), F.lit(0))).first()[0])
    made = manifest.create(name=config.name, version=config.version, source_files=files, processing_config=config.hashed(), tokenizer_path=config.tokenizer_path, tokenizer_version=tokenizer.VERSION, tokenizer_hash=manifest.hash_config({"merges": tokenizer.merges}), n_records=n_unique, n_tokens=n_tokens, n_train_records=n_train, n_val_records=n_val, shard_files=names, seed=config.seed, context_length=config.context_length)
    made.seal(config.output_dir).save(os.path.join(config.output_dir, "manifest.json"))
    return PipelineResult(report.records_scanned, report.valid, n_clean, n_unique, n_train, n_val, n_tokens, len(names), config.output_dir, made)


def resumable(config: PipelineConfig) -> bool:
    """Whether output_dir already holds the dataset that config would make from its files as they are."""
    path = os.path.join(config.output_dir, "manifest.json")
    if not os.path.exists(path):
        return False
    found = manifest.Manifest.load(path)
    same = found.source_hash == manifest.hash_files(jsonl.expand(config.input_paths)) and found.processing_hash == manifest.hash_config(config.hashed())
    return same and found.verify(config.output_dir)


def preflight(dataset_dir: str, tokenizer_path: str, max_context_length: int, vocab_size: int) -> None:
    """ConfigError for the first thing that does not fit together: manifest, tokenizer, context length, versions, vocabulary."""
    path = os.path.join(dataset_dir, "manifest.json")
    if not os.path.exists(path):
        raise ConfigError("the dataset has no manifest", "dataset_dir", dataset_dir, "build the dataset first")
    if not os.path.exists(tokenizer_path):
        raise ConfigError("there is no tokenizer", "tokenizer_path", tokenizer_path, "train a tokenizer first")
    if max_context_length <= 0:
        raise ConfigError("the model's context length must be positive", "max_context_length", max_context_length)
    made, tokenizer = manifest.Manifest.load(path), Tokenizer.load(tokenizer_path)
    if made.context_length > 0 and made.context_length != max_context_length:
        raise ConfigError("the dataset's context length is not the model's", "context_length", f"{made.context_length} and {max_context_length}", "build the dataset anew or change the model")
    if tokenizer.VERSION != made.tokenizer_version:
        raise ConfigError("the dataset was made with another tokenizer version", "tokenizer_version", f"{tokenizer.VERSION} and {made.tokenizer_version}", "tokenize the dataset anew")
    if made.tokenizer_hash and manifest.hash_config({"merges": tokenizer.merges}) != made.tokenizer_hash:
        raise ConfigError("the dataset was made with another vocabulary", "tokenizer_path", tokenizer_path, "tokenize the dataset anew")
    if tokenizer.vocab_size() != vocab_size:
        raise ConfigError("the tokenizer's vocabulary is not the model's", "vocab_size", f"{tokenizer.vocab_size()} and {vocab_size}", "train the tokenizer anew or change the model")
