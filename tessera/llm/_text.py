"""Whole Arrow batches of text as byte arrays: words, shingles and hashes without a Python loop over words."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Primes and bases of the two sums of a byte range's hash. A prime modulus, unlike 2 ** 64, leaves no texts
#: (such as Thue-Morse words) whose sums agree under every base.
_PRIMES = ((2147483647, 1358979403), (2147483629, 982451653))
#: Values below 2 ** 39 that a sum of 64 bits holds.
_MOST = 1 << 24


def _power(prime: int, root: int, n: int) -> np.ndarray:
    """root ** 0..n modulo prime."""
    # kept by the interpreter, not by this module, whose contents travel with each function sent out
    kept = sys.__dict__.setdefault("_tessera_powers", {})
    have = kept.get((prime, root))
    if have is None or len(have) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        have = np.ones(1, dtype=U)
        while len(have) < size:
            have = np.concatenate([have, have * U(pow(root, len(have), prime)) % U(prime)])
        if size <= 1 << 23:
            kept[(prime, root)] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and each text's offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    n, first = len(column), column.offset
    if n == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[first : first + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of `inside` that do not cross a text's bounds."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets[offsets <= n]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def owner(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The text that holds each start; empty texts hold none."""
    return np.searchsorted(offsets, starts, side="right") - 1


def _sums(data: np.ndarray, prime: int, root: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial of each byte range modulo prime, wherever the range stands."""
    n = len(data)
    powers, sums = _power(prime, root, n), np.zeros(n + 1, dtype=U)
    for a in range(0, n, _MOST):
        b = min(n, a + _MOST)
        np.cumsum((data[a:b].astype(U) + U(1)) * powers[a:b], out=sums[a + 1 : b + 1])
        if a:
            sums[a + 1 : b + 1] += sums[a] % U(prime)
    inverse = _power(prime, pow(root, -1, prime), n)
    return (sums[ends] % U(prime) + U(prime) - sums[starts] % U(prime)) % U(prime) * inverse[starts] % U(prime)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes wherever they stand."""
    one, two = (_sums(data, prime, root, starts, ends) for prime, root in _PRIMES)
    with np.errstate(over="ignore"):
        return mix((one << U(33)) ^ (two << U(2)) ^ (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def joined(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each `width` neighbours, from the hashes of the single ones; width - 1 shorter."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out = np.zeros(n, dtype=U)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * U(0x9DDFEA08EB382D69) + hashes[k : k + n]
        return mix(out)


def pieces(column, most: int = 1 << 20):
    """Row ranges of a text column that hold about `most` bytes each; a longer text stands alone."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += int(n)
    if start < len(lengths):
        yield start, len(lengths)


class Shingles:
    """Distinct `width`-word shingles of each text of a batch, as sorted 64-bit hashes."""

    def __init__(self, column, width: int = 5):
        data, offsets = utf8(column)
        data = lower_ascii(data)
        starts, ends = spans(~blank(data), offsets)
        words, texts = span_hashes(data, starts, ends), owner(starts, offsets)
        n = len(offsets) - 1
        per = np.bincount(texts, minlength=n)
        hashes = joined(words, width)
        of = texts[: len(hashes)]
        inside = texts[width - 1 :] == of if len(hashes) else np.zeros(0, bool)
        hashes, of = hashes[inside], of[inside]
        few = np.flatnonzero((per > 0) & (per < width))
        if len(few):  # the whole sequence as one shingle
            begin = np.concatenate([[0], np.cumsum(per)])[:-1]
            short = np.array([int(_sequence(words[begin[i] : begin[i] + per[i]])) for i in few], dtype=U)
            hashes, of = np.concatenate([hashes, short]), np.concatenate([of, few])
        order = np.lexsort((hashes, of))
        hashes, of = hashes[order], of[order]
        keep = np.ones(len(hashes), dtype=bool)
        keep[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
        self.hashes, self.of = hashes[keep], of[keep]
        self.sizes = np.bincount(self.of, minlength=n)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])

    def __getitem__(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]


def _sequence(words: np.ndarray) -> np.uint64:
    return joined(words, len(words))[0] ^ U(len(words))
