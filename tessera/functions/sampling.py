"""Sampling and network arithmetic on arrays of doubles: expressions that stay in the JVM, but for natural_exp."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

NEG_INF = float("-inf")


def let(value: Column, then) -> Column:
    """then(value) with value worked out once: an expression that stands in a lambda runs for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def temperature(logits: Column, t: float) -> Column:
    """Divided by t; 0 leaves them, for a greedy choice."""
    return F.transform(logits, lambda x: x / t) if t > 0 else logits


def repetition_penalty(logits: Column, seen: Column, penalty: float) -> Column:
    """Logits of ids already seen (from 0) divided by penalty, negative ones too."""
    return F.transform(logits, lambda x, i: F.when(F.array_contains(seen, i), x / penalty).otherwise(x)) if penalty != 1.0 else logits


def top_k(logits: Column, k: int) -> Column:
    """-inf for all below the k-th largest; ties with it stay. k <= 0: all stay."""
    if k <= 0:
        return logits
    bound = F.element_at(F.sort_array(logits, asc=False), F.least(F.lit(k), F.size(logits)))
    return let(bound, lambda least: F.transform(logits, lambda x: F.when(x < least, F.lit(NEG_INF)).otherwise(x)))


def softmax(logits: Column) -> Column:
    shifted = let(F.array_max(logits), lambda most: F.transform(logits, lambda x: F.exp(x - most)))
    return let(shifted, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def top_p(logits: Column, p: float) -> Column:
    """-inf where the running sum of the sorted probabilities exceeds p; the largest always stays."""
    if p >= 1.0:
        return logits
    probabilities = softmax(logits)
    ranked = F.array_sort(F.transform(probabilities, lambda x, i: F.struct((-x).alias("n"), i.alias("i"))))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("kept"))

    def step(a: Column, s: Column) -> Column:
        reached = a["sum"] - s["n"]
        keep = (F.size(a["kept"]) == 0) | (reached <= p)
        return F.struct(reached.alias("sum"), F.when(keep, F.concat(a["kept"], F.array(s["i"]))).otherwise(a["kept"]).alias("kept"))

    kept = F.aggregate(ranked, start, step, lambda a: a["kept"])
    return let(kept, lambda own: F.transform(logits, lambda x, i: F.when(F.array_contains(own, i), x).otherwise(F.lit(NEG_INF))))


def argmax(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)) - 1


def categorical(probabilities: Column, draw: Column) -> Column:
    """The first index whose running sum passes draw, uniform in [0, 1)."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("at"), F.lit(0).alias("i"))

    def step(a: Column, p: Column) -> Column:
        s = a["sum"] + p
        return F.struct(s.alias("sum"), F.when((a["at"] < 0) & (s > draw), a["i"]).otherwise(a["at"]).alias("at"), (a["i"] + 1).alias("i"))

    return F.aggregate(probabilities, start, step, lambda a: F.when(a["at"] < 0, F.size(probabilities) - 1).otherwise(a["at"]))


def stops(text: Column, sequences: list[str]) -> Column:
    found = F.lit(False)
    for s in sequences:
        found = found | F.contains(text, F.lit(s))
    return found


def cross_entropy(logits: Column, target: Column, ignore: int = 0) -> Column:
    """-log softmax(logits)[target]; null for the target that is ignored."""
    most = F.array_max(logits)
    lse = let(most, lambda m: m + F.log(total(F.transform(logits, lambda x: F.exp(x - m)))))
    return F.when(target != ignore, lse - F.element_at(logits, target + 1))


def rms_norm(x: Column, eps: float = 1e-6) -> Column:
    scale = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.size(x) + eps)
    return let(scale, lambda s: F.transform(x, lambda v: v / s))


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    centred = let(total(x) / F.size(x), lambda mean: F.transform(x, lambda v: v - mean))
    return let(centred, lambda c: let(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v) / F.size(c) + eps), lambda d: F.transform(c, lambda v: v / d)))


def rope(x: Column, position: Column, base: float = 10000.0) -> Column:
    """Rotary position embedding; the second half of the vector holds the partners of the first."""
    half = (F.size(x) / 2).cast("int")

    def turn(v: Column, i: Column) -> Column:
        k = i % half
        angle = position / F.pow(F.lit(base), 2 * k / F.size(x))
        partner = F.when(i < half, -F.element_at(x, i + half + 1)).otherwise(F.element_at(x, i - half + 1))
        return v * F.cos(angle) + partner * F.sin(angle)

    return F.transform(x, turn)


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def lr_multiplier(step: Column, kind: str = "cosine", warmup: int = 50, steps: int = 500, floor: float = 0.1) -> Column:
    """Linear warm-up, then cosine, linear or constant."""
    if kind not in ("cosine", "linear", "constant"):
        raise ValueError(f"unknown schedule: {kind!r}")
    progress = F.least(F.lit(1.0), (step - warmup) / max(1, steps - warmup))
    after = {
        "cosine": floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * progress)),
        "linear": 1.0 - (1 - floor) * progress,
        "constant": F.lit(1.0),
    }[kind]
    return F.when(step < warmup, step / max(1, warmup)).otherwise(after)


def natural_exp(x: Column) -> Column:
    """exp by the C library, as databases have it; the JVM's differs in the last bit for one value in ten."""

    def of(v: float | None) -> float | None:
        try:
            return None if v is None else math.exp(v)
        except OverflowError:
            return math.inf

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([of(v) for v in column.to_pylist()], pa.float64())

    return run(x.cast("double"))


def round_scaled(x: Column, digits: int) -> Column:
    """The multiple of 10 ** -digits nearest to x as doubles have it: the product is rounded, not x's decimal form."""
    return F.round(x * 10.0**digits) / 10.0**digits


def perplexity(loss: Column, cap: float | None = None) -> Column:
    return natural_exp(loss) if cap is None else F.when(loss < cap, natural_exp(loss)).otherwise(F.lit(float("inf")))


def throughput(n: Column, elapsed: Column) -> Column:
    return F.when(elapsed > 0, n / elapsed).otherwise(F.lit(0.0))


def approx_params(vocab: int, dim: int, layers: int, ffn: int, tied: bool = True) -> int:
    body = vocab * dim + layers * (4 * dim * dim + 2 * dim * ffn + 4 * dim)
    return body if tied else body + vocab * dim


def swiglu_width(ffn: int) -> int:
    return (int(ffn * 2 / 3) + 7) // 8 * 8
