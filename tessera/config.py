"""Settings of models, training runs and generation: ranges, presets, files; unknown keys are dropped."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from tessera.functions.sampling import approx_params
from tessera.operators.validate import ConfigError
from tessera.sources.shared import save_json


def _need(ok: bool, message: str, field: str, value) -> None:
    if not ok:
        raise ConfigError(message, field, value)


class _Config:
    def to_dict(self) -> dict:
        return asdict(self)

    def save(self, path: str) -> None:
        save_json(self.to_dict(), path)

    @classmethod
    def from_dict(cls, given: dict):
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in given.items() if k in known})

    @classmethod
    def load(cls, path: str):
        with open(path, encoding="utf-8") as file:
            return cls.from_dict(json.load(file))


@dataclass
class ModelConfig(_Config):
    name: str = "experimental"
    version: str = "0.1.0"
    vocab_size: int = 4096
    hidden_dim: int = 128
    n_layers: int = 4
    n_heads: int = 4
    head_dim: int = 32
    max_context_length: int = 256
    ffn_dim: int = 512
    dropout: float = 0.1

    def __post_init__(self):
        for name in ("vocab_size", "hidden_dim", "n_layers", "n_heads", "head_dim", "max_context_length", "ffn_dim"):
            _need(getattr(self, name) > 0, "must be positive", name, getattr(self, name))
        _need(self.n_heads * self.head_dim == self.hidden_dim, "n_heads x head_dim must be hidden_dim", "hidden_dim", self.hidden_dim)
        _need(0 <= self.dropout < 1, "must be within [0, 1)", "dropout", self.dropout)

    def approx_params(self, tied: bool = True) -> int:
        return approx_params(self.vocab_size, self.hidden_dim, self.n_layers, self.ffn_dim, tied)


@dataclass
class TrainingConfig(_Config):
    run_name: str = "run-1"
    model_name: str = "experimental"
    batch_size: int = 8
    grad_accum_steps: int = 4
    learning_rate: float = 3e-4
    max_steps: int = 2000
    eval_every_steps: int = 250
    save_every_steps: int = 500
    precision: str = "fp32"
    schedule: str = "cosine"
    warmup_steps: int = 50
    min_lr_ratio: float = 0.1

    def __post_init__(self):
        for name in ("batch_size", "grad_accum_steps", "learning_rate", "max_steps"):
            _need(getattr(self, name) > 0, "must be positive", name, getattr(self, name))
        _need(self.schedule in ("cosine", "linear", "constant"), "unknown schedule", "schedule", self.schedule)
        _need(self.precision in ("fp32", "fp16", "bf16", "auto"), "unknown precision", "precision", self.precision)


@dataclass
class GenerationConfig(_Config):
    max_new_tokens: int = 128
    temperature: float = 0.8
    top_k: int = 50
    top_p: float = 0.95
    repetition_penalty: float = 1.0

    def __post_init__(self):
        _need(self.max_new_tokens >= 1, "must be at least 1", "max_new_tokens", self.max_new_tokens)
        _need(self.temperature >= 0, "must not be negative", "temperature", self.temperature)
        _need(self.top_k >= 0, "must not be negative", "top_k", self.top_k)
        _need(0 < self.top_p <= 1, "must be within (0, 1]", "top_p", self.top_p)
        _need(self.repetition_penalty >= 1, "must be at least 1", "repetition_penalty", self.repetition_penalty)


# The presets.
MODELS = {
    "experimental": ModelConfig(),
    "small": ModelConfig("small", "0.1.0", 8192, 256, 6, 8, 32, 512, 1024),
}
TRAINING = {
    "experimental": TrainingConfig(),
    "small": TrainingConfig("run-1", "small", 4, 8, 3e-4, 5000),
}


def preset(table: dict, name: str):
    """A preset by name; KeyError names those there are."""
    if name not in table:
        raise KeyError(f"{name!r} is not one of {sorted(table)}")
    return table[name]
