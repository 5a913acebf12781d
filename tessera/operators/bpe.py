"""A byte-level BPE tokenizer: words are counted by Spark, merges are learned on the distinct words.

Ids: 0 pad, 1 begin, 2 end, 3 unknown, 4 + b for byte b, then the merges in order. A word is a mark
(printed as the byte table prints a space) and its bytes.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.batches import bounded, joined, slices
from tessera.sources.shared import save_json

VERSION = "tessera-bpe-0.1"
# The special tokens and their ids.
SPECIAL = {"<pad>": 0, "<bos>": 1, "<eos>": 2, "<unk>": 3}
PAD, BOS, EOS, UNK = SPECIAL.values()


def byte_table() -> list[str]:
    """A printable character for each byte: itself where it prints, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


BYTES = byte_table()
MARK = BYTES[32]


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """word, freq over all texts, words as str.split() has them."""
    words = df.select(F.explode(F.split(tx.fold_ws(F.col(text)), " ")).alias("word")).filter("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("freq"))


def pair_counts(words: DataFrame) -> DataFrame:
    """left, right, freq: neighbours among the symbols (lists in column symbols), weighted by freq."""
    pairs = words.select("freq", F.explode(F.arrays_zip(F.slice("symbols", 1, F.size("symbols") - 1).alias("l"), F.slice("symbols", 2, F.size("symbols") - 1).alias("r"))).alias("p")).filter("p.l is not null")
    return pairs.groupBy(F.col("p.l").alias("left"), F.col("p.r").alias("right")).agg(F.sum("freq").alias("freq"))


def best_pair(pairs: DataFrame) -> DataFrame:
    """The most frequent pair; of equals the largest."""
    return pairs.agg(F.max(F.struct("freq", "left", "right")).alias("b")).select("b.left", "b.right", "b.freq")


def learn(words: dict[str, int], n_merges: int) -> list[tuple[str, str]]:
    """Merges in order, by counts kept up to date where a merge changes words."""
    symbols = [[MARK, *(BYTES[b] for b in w.encode("utf-8"))] for w in words]
    freqs = list(words.values())
    counts: Counter[tuple[str, str]] = Counter()
    holders: dict[tuple[str, str], set[int]] = defaultdict(set)
    for i, s in enumerate(symbols):
        for pair in zip(s, s[1:]):
            counts[pair] += freqs[i]
            holders[pair].add(i)
    import heapq

    def entry(pair):
        return (-counts[pair], _Largest(pair))

    heap = [entry(p) for p in counts]
    heapq.heapify(heap)
    merges: list[tuple[str, str]] = []
    while len(merges) < n_merges and heap:
        minus, top = heapq.heappop(heap)
        pair = top.pair
        if counts.get(pair, 0) != -minus or not -minus:
            if counts.get(pair, 0) > 0:
                heapq.heappush(heap, entry(pair))
            continue
        merges.append(pair)
        changed = set()
        for i in holders.pop(pair):
            s = symbols[i]
            for p in zip(s, s[1:]):
                counts[p] -= freqs[i]
                changed.add(p)
            symbols[i] = s = merge(s, pair)
            for p in zip(s, s[1:]):
                counts[p] += freqs[i]
                holders[p].add(i)
                changed.add(p)
        for p in changed:
            if counts[p] > 0:
                heapq.heappush(heap, entry(p))
            else:
                del counts[p]
    return merges


class _Largest:
    """Orders pairs from the largest."""

    __slots__ = ("pair",)

    def __init__(self, pair):
        self.pair = pair

    def __lt__(self, other):
        return self.pair > other.pair


def merge(symbols: list[str], pair: tuple[str, str]) -> list[str]:
    """Every occurrence of pair joined, from the left, without overlap."""
    out, i = [], 0
    while i < len(symbols):
        if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
            out.append(pair[0] + pair[1])
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


class Tokenizer:
    VERSION = VERSION

    def __init__(self, merges: list[tuple[str, str]] | None = None):
        self.merges = None if merges is None else [tuple(m) for m in merges]
        self.vocab = [*SPECIAL, *BYTES, *(a + b for a, b in self.merges or [])]
        self.token_to_id = {token: i for i, token in enumerate(self.vocab)}  # of equal tokens the later
        self.rank = {pair: i for i, pair in enumerate(self.merges or [])}
        self._bytes: dict[int, bytes] | None = None  # of each token that is not special, for decode()
        self._word = lru_cache(maxsize=1 << 17)(self._word_ids)
        self._tables: tuple[np.ndarray, ...] | None = None  # of the merges, for encode_all()

    def __reduce__(self):
        return (Tokenizer, (self.merges,))

    def __len__(self) -> int:
        return len(self.vocab)

    def __repr__(self) -> str:
        return f"Tokenizer(vocab_size={len(self)}, trained={self.is_trained})"

    @property
    def is_trained(self) -> bool:
        return self.merges is not None

    def vocab_size(self) -> int:
        return len(self.vocab)

    def id_to_token(self, i: int) -> str:
        return self.vocab[i] if 0 <= i < len(self.vocab) else "<unk>"

    @classmethod
    def train(cls, df: DataFrame, vocab_size: int = 4096, text: str = "text", driver_words: int = 1 << 17) -> tuple[Tokenizer, dict]:
        """The tokenizer and what it was trained on. Up to driver_words distinct words are merged on the driver,
        beyond that in Spark (bpe_training), which takes more time a merge and gives the same merges."""
        from tessera.operators import bpe_training
        from tessera.sources.shared import materialise

        if vocab_size < 260:
            raise ValueError("vocab_size must be at least 260: 4 special tokens and 256 bytes")
        n_merges = vocab_size - 260
        if not n_merges:
            return cls([]), {"vocab_size": 260, "n_merges": 0}
        words = materialise(word_counts(df, text))
        n = words.count()
        if n <= driver_words:
            merges = learn({r["word"]: r["freq"] for r in words.collect()}, n_merges)
        else:
            merges = [(left, right) for left, right, _ in bpe_training.train(words, n_merges)]
        made = cls(merges)
        return made, {"vocab_size": len(made), "n_merges": len(made.merges), "n_unique_words": n, "version": VERSION}

    def _word_ids(self, word: str) -> tuple[int, ...]:
        symbols = [MARK, *(BYTES[b] for b in word.encode("utf-8"))]
        while len(symbols) > 1:
            pair = min(zip(symbols, symbols[1:]), key=lambda p: self.rank.get(p, len(self.merges)))
            if pair not in self.rank:
                break
            i = next(i for i, p in enumerate(zip(symbols, symbols[1:])) if p == pair)
            symbols[i : i + 2] = [pair[0] + pair[1]]
        out: list[int] = []
        for s in symbols:
            found = self.token_to_id.get(s)
            out += [found] if found is not None else [self.token_to_id.get(c, UNK) for c in s]
        return tuple(out)

    def _merge_tables(self) -> tuple[np.ndarray, ...]:
        """Pairs of ids (left << 32 | right, ascending) and of each its rank; then by rank the id a merge makes, and
        whether no earlier merge takes that id, so that all occurrences in a word can be merged at once."""
        if self._tables is None:
            known = [(p, r) for p, r in self.rank.items() if p[0] in self.token_to_id and p[1] in self.token_to_id]
            rows = sorted((self.token_to_id[a] << 32 | self.token_to_id[b], r) for (a, b), r in known)
            made = np.zeros(len(self.merges), np.int32)
            alone = np.ones(len(made), bool)
            first: dict[str, int] = {}  # of each symbol the first merge that takes it
            for (a, b), r in sorted(known, key=lambda x: x[1]):
                first.setdefault(a, r), first.setdefault(b, r)
            for (a, b), r in known:
                made[r], alone[r] = self.token_to_id[a + b], first.get(a + b, r + 1) > r
            self._tables = (np.array([c for c, _ in rows], np.int64), np.array([r for _, r in rows], np.int64), made, alone)
        return self._tables

    def encode_all(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (strings), one after another, and how many each has: as _word_ids(), all words a step at a time."""
        codes, ranks, made, alone = self._merge_tables()
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        lengths = np.diff(offsets) + 1
        starts = np.cumsum(lengths) - lengths
        first = np.zeros(lengths.sum(), bool)
        first[starts] = True
        ids = np.full(len(first), 4 + 32, np.int32)
        if len(words):
            ids[~first] = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.int32) + 4
        place, word = np.arange(len(ids)), np.repeat(np.arange(len(words)), lengths)
        stays = np.ones(len(ids), bool)  # by place; place, word, symbols: what is still to be merged
        symbols = ids.copy()
        none = len(made)
        while len(symbols) > 1 and len(codes):
            pair = symbols[:-1].astype(np.int64) << 32 | symbols[1:]
            at = np.searchsorted(codes, pair)
            at[at == len(codes)] = 0
            rank = np.where((codes[at] == pair) & (word[:-1] == word[1:]), ranks[at], none)
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(np.append(rank, none), heads)
            sizes = np.diff(heads, append=len(word))
            own = np.repeat(least, sizes)
            hit = np.flatnonzero((rank == own[:-1]) & (rank < none))
            if not len(hit):
                break
            runs = np.flatnonzero(np.diff(hit, prepend=-2) != 1)  # where a symbol meets itself, every other place
            run_starts = np.repeat(hit[runs], np.diff(runs, append=len(hit)))
            leftmost = np.diff(word[hit], prepend=-1) != 0
            hit = hit[leftmost | (alone[rank[hit]] & ((hit - run_starts) % 2 == 0))]
            symbols[hit] = made[rank[hit]]
            stays[place[hit + 1]] = False
            ids[place[hit]] = symbols[hit]
            live = own < none
            live[hit + 1] = False
            symbols, word, place = symbols[live], word[live], place[live]
        return ids[stays], np.add.reduceat(stays, starts, dtype=np.int64) if len(words) else lengths

    def encode_texts(self, texts: pa.Array, add_bos: bool = False, add_eos: bool = False) -> pa.Array:
        """encode() of each text: the distinct words of all are worked out once, and their ids laid out by position."""
        split = [None if x is None else x.split() for x in texts.to_pylist()]
        n_words = np.array([len(x or ()) for x in split], np.int64)
        coded = pa.array([w for x in split if x for w in x], pa.string()).dictionary_encode()
        ids, many = self.encode_all(coded.dictionary)
        index = coded.indices.to_numpy(zero_copy_only=False)
        # each word's ids, with the ends of texts as two more words
        ids, many = np.concatenate([ids, [BOS, EOS]]).astype(np.int32), np.concatenate([many, [1, 1]])
        full = np.array([x is not None for x in split], bool)
        ends = np.cumsum(n_words)
        spots = np.stack([ends - n_words, ends], 1)  # of each text its begin and its end
        used = full[:, None] & np.array([add_bos, add_eos], bool)
        marks = np.broadcast_to(np.array([len(many) - 2, len(many) - 1]), spots.shape)
        index = np.insert(index.astype(np.int64), spots[used], marks[used])
        taken = many[index]
        out = ids[np.repeat((np.cumsum(many) - many)[index] - (np.cumsum(taken) - taken), taken) + np.arange(taken.sum())]
        sums = np.concatenate([[0], np.cumsum(taken)])
        offsets = np.concatenate([[0], sums[np.cumsum(n_words + used.sum(1))]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out, pa.int32()), mask=pa.array(~full))

    def encode(self, text: str, add_bos: bool = False, add_eos: bool = False) -> list[int]:
        if not self.is_trained:
            raise RuntimeError("the tokenizer is not trained")
        ids = [BOS] if add_bos else []
        for word in text.split():
            ids += self._word(word)
        return ids + [EOS] if add_eos else ids

    def decode(self, ids: list[int]) -> str:
        if self._bytes is None:
            code = {c: b for b, c in enumerate(BYTES)}
            self._bytes = dict(enumerate((bytes(code[c] for c in token) for token in self.vocab[4:]), 4))
        return b"".join([self._bytes.get(i, b"") for i in ids]).removeprefix(b" ").decode("utf-8", "replace")

    def to_dict(self) -> dict:
        return {"version": VERSION, "vocab": self.vocab, "merges": [list(m) for m in self.merges or []], "special_tokens": {k.strip("<>"): k for k in SPECIAL}, "special_ids": {k.strip("<>"): v for k, v in SPECIAL.items()}}

    def save(self, path: str) -> None:
        save_json(self.to_dict(), path)

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as file:
            return cls([tuple(m) for m in json.load(file)["merges"]])

    def vocab_table(self, spark) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.vocab)), "id int, token string")

    # columns: Arrow batches, the model in a broadcast
    def encode_column(self, text: Column, spark, add_bos: bool = False, add_eos: bool = False) -> Column:
        sent = spark.sparkContext.broadcast(self)
        bounded(spark)
        if not self.is_trained:
            raise RuntimeError("the tokenizer is not trained")

        @F.arrow_udf("array<int>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            kind = pa.list_(pa.int32())
            for batch in batches:
                yield joined([sent.value.encode_texts(part, add_bos, add_eos) for part in slices(batch)], kind)

        return run(text)

    def decode_column(self, ids: Column, spark) -> Column:
        sent = spark.sparkContext.broadcast(self)
        bounded(spark)

        @F.arrow_udf("string")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield joined([pa.array([None if x is None else sent.value.decode(x) for x in part.to_pylist()], pa.string()) for part in slices(batch, 8)], pa.string())

        return run(ids)
