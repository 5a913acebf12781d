"""Hashes decide equality in several operators: different words and lines must not share one."""

import numpy as np
import pyarrow as pa

from tessera.llm import _grams, license_scan, quality_rules
from tessera.llm import _text as t


def thue_morse(k):
    word = "a"
    for _ in range(k):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


PAIRS = [thue_morse(k) for k in range(8, 15)]


def test_lines_and_words_that_defeat_sums_modulo_powers_of_two():
    for a, b in PAIRS:
        found = quality_rules.statistics(pa.array([f"{a}\n{b}", f"{a}\n{a}", f"{a} x y {b} x y"]))
        assert found["n_dup_lines"].tolist() == [0, 1, 0] and found["n_repeat_words"].tolist() == [0, 0, 0]
        keys, bounds = _grams.word_keys(pa.array([a, b]))
        assert keys[bounds[0]] != keys[bounds[1]]
        shingles = t.Shingles(pa.array([a, b, a]))
        assert shingles[0][0] != shingles[1][0] and shingles[0][0] == shingles[2][0]
    assert license_scan  # its bigrams are made of the same hashes


def test_equal_ranges_agree_wherever_they_stand():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 101, rng.integers(1, 7), np.uint8)) for _ in range(20000)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends = t.spans(~t.blank(data), np.array([0, len(data)]))
    hashes = t.span_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(words)) == len(set(zip(words, hashes.tolist(), strict=True)))


def test_long_data_in_blocks(monkeypatch):
    data = np.random.default_rng(2).integers(0, 256, 5000, np.uint8)
    starts, ends = np.arange(0, 4000, 7), np.arange(0, 4000, 7) + 900
    whole = t.span_hashes(data, starts, ends)
    monkeypatch.setattr(t, "_MOST", 64)
    assert (t.span_hashes(data, starts, ends) == whole).all()
