"""Benchmark decontamination by SimHash of item-sized windows.

For each length that benchmark items have, windows of that length slide over a
document shingle by shingle. A window's fingerprint comes from running sums of its
shingles' hash bits, each shingle with its weight. The items of that length lie in an
index by blocks of bits, which guarantees that every item within RADIUS bits of a
window is found; what it gives is verified by the exact weighted Jaccard
similarity of the shingles.

A window can reach the similarity only with enough weight in shingles of the
benchmark, of whichever items; others are not fingerprinted. That test only leaves out
what verification would, and which items a window is held against is up to the index.

The benchmark is a stated set of queries, taken in blocks of bounded size; each
block goes to all tasks, and all documents pass by it once. Shingles are weighed
by how many items of the whole benchmark have them, whatever block these are in.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.llm.common import arrow_map, keep_rows, slices

SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits of 64 up to which a window is a candidate. At a similarity of 0.8 some 10 bits differ.
RADIUS = 20
BITS = 64
#: Keys of all indexes of a block of items, at most unless each item has one key a block; more keys make fewer, wider blocks.
ENTRIES = 1 << 20
#: Windows fingerprinted, and pairs compared, at a time.
ROWS = 1 << 13
PAIRS = 1 << 20
#: Bytes of benchmark text in a block.
BLOCK_BYTES = 4 << 20
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles_of(words: list[str]) -> list[tuple[str, ...]]:
    """Runs of SHINGLE words, repeats included; all words if there are fewer; none without words."""
    if len(words) <= SHINGLE:
        return [tuple(words)] if words else []
    return list(zip(*(words[i:] for i in range(SHINGLE)), strict=False))


def votes(shingles: list[tuple[str, ...]], weights: np.ndarray) -> np.ndarray:
    """The weight, in thousandths, or less that for each bit of each shingle's hash."""
    h = np.array([xxhash.xxh64_intdigest(" ".join(s), 42) for s in shingles], np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return (bits.astype(np.int32) * 2 - 1) * np.rint(1000 * weights).astype(np.int32)[:, None]


def print_of(total: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of vote sums."""
    return np.packbits(total > 0, axis=1, bitorder="little").view(np.uint64).ravel()


class BlockIndex:
    """Fingerprints by blocks of bits, each block with a threshold.

    The thresholds, plus one each, add up to radius + 1: a pair over the threshold in
    every block differs in more than radius bits. All values within the threshold of
    a fingerprint's are its keys in the block's table. Of the numbers of blocks whose
    keys are within `entries`, the one with the fewest expected candidates is taken.
    """

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, entries: int = ENTRIES):
        self.prints, self.radius = prints, radius
        plans = [self._plan(m) for m in range(4, max(4, radius + 1) + 1)]
        fits = [p for p in plans if len(prints) * sum(len(flips) for *_, flips in p) <= entries]
        plan = min(fits or plans[-1:], key=self._share)
        self.step = max(1, int(PAIRS / (1 + len(prints) * self._share(plan))))
        self.tables: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for shift, width, flips in plan:
            keys = (self._value(prints, shift, width)[:, None] ^ flips).ravel()
            order = np.argsort(keys, kind="stable")
            self.tables.append((shift, width, keys[order], order // max(1, len(flips))))

    def _plan(self, blocks: int) -> list[tuple[int, int, np.ndarray]]:
        """(first bit, width, flips within the threshold) of each block."""
        edges = np.linspace(0, BITS, blocks + 1).round().astype(int).tolist()
        each, more = divmod(self.radius + 1, blocks)
        out = []
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            values = np.arange(1 << (b - a), dtype=np.uint16)
            out.append((a, b - a, values[np.bitwise_count(values) < each + (k < more)]))
        return out

    @staticmethod
    def _share(plan: list[tuple[int, int, np.ndarray]]) -> float:
        """Expected candidates among unlike fingerprints, as a share of all."""
        return sum(len(flips) / (1 << width) for _, width, flips in plan)

    @staticmethod
    def _value(prints: np.ndarray, shift: int, width: int) -> np.ndarray:
        return ((prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.uint16)

    def near(self, asked: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place in asked, place in prints, differing bits) of all pairs within the radius."""
        for at in range(0, len(asked), self.step):
            some = asked[at : at + self.step]
            found = []
            for shift, width, keys, items in self.tables:
                value = self._value(some, shift, width)
                first = np.searchsorted(keys, value, "left")
                n = np.searchsorted(keys, value, "right") - first
                place = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
                found.append(np.repeat(np.arange(len(some)), n) * len(self.prints) + items[place])
            here, item = np.divmod(np.unique(np.concatenate(found)), max(1, len(self.prints)))
            apart = np.bitwise_count(some[here] ^ self.prints[item])
            good = apart <= self.radius
            yield from zip((at + here[good]).tolist(), item[good].tolist(), apart[good].tolist(), strict=True)


def weight_of(items: int) -> float:
    """Shingles many items share say little; one that no other item has, and any other, weighs 1."""
    return 1 / math.log2(1 + items)


def hash_of(shingle: tuple[str, ...]) -> int:
    return xxhash.xxh3_128_intdigest(" ".join(shingle))


class Benchmark:
    """Items of one block, ready to be looked for. shared: items of the whole benchmark, if that is more, by the hash of a shingle that several have."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, radius: int = RADIUS, shared: dict[int, int] | None = None):
        self.similarity, self.shared = similarity, shared
        words = [words_of(t) for _, t in items]
        keep = [i for i, w in enumerate(words) if w]
        self.ids = [items[i][0] for i in keep]
        self.sizes = [len(words[i]) for i in keep]
        self.bags = [Counter(shingles_of(words[i])) for i in keep]
        df = Counter(s for bag in self.bags for s in bag)
        self.weight = {s: weight_of(n if shared is None else shared.get(hash_of(s), 1)) for s, n in df.items()}
        self.totals = [sum(self.weight[s] * n for s, n in bag.items()) for bag in self.bags]
        self.radius = radius
        #: Words of a shingle -> length of a window in shingles -> items.
        self.lengths: dict[int, dict[int, list[int]]] = {}
        for i, n in enumerate(self.sizes):
            self.lengths.setdefault(min(n, SHINGLE), {}).setdefault(self.window(i), []).append(i)

    @cached_property
    def indexes(self) -> dict[tuple[int, int], BlockIndex]:
        """The items of each length, made where it is first asked for: in a task, not on the driver."""
        out = {}
        for k, lengths in self.lengths.items():
            for length, items in lengths.items():
                bags = [[*self.bags[i].elements()] for i in items]
                prints = [votes(bag, np.array([self.weight[s] for s in bag])).sum(axis=0) for bag in bags]
                out[k, length] = BlockIndex(print_of(np.stack(prints)), self.radius, ENTRIES * len(items) // len(self.ids))
        return out

    def window(self, item: int) -> int:
        """Shingles of an item-sized window."""
        return max(1, self.sizes[item] - SHINGLE + 1)

    def _weight(self, shingle: tuple[str, ...]) -> float:
        if shingle in self.weight or not self.shared:
            return self.weight.get(shingle, 1.0)
        return weight_of(self.shared.get(hash_of(shingle), 1))

    def likeness(self, item: int, bag: Counter) -> float:
        """Sum of the lesser weights over the sum of the greater ones."""
        mine = self.bags[item]
        both = sum(self.weight[s] * min(n, bag[s]) for s, n in mine.items() if s in bag)
        other = sum(self._weight(s) * n for s, n in bag.items())
        return both / (self.totals[item] + other - both)

    def find(self, text: str) -> list[tuple[int, int, int, float]]:
        """(item id, first word, differing bits, similarity) of the best window of each item that is in the text."""
        words = words_of(text)
        out = []
        for k, lengths in self.lengths.items():
            grams = list(zip(*(words[i:] for i in range(k)), strict=False))
            hits = [p for p, s in enumerate(grams) if s in self.weight]
            if hits:
                out += [(self.ids[item], *best) for item, best in self._best(k, lengths, grams, hits).items()]
        return sorted(out)

    def _best(self, k: int, lengths: dict[int, list[int]], grams: list[tuple[str, ...]], hits: list[int]) -> dict[int, tuple[int, int, float]]:
        """Item -> (first word, differing bits, similarity) of its best window."""
        weight = np.array([self._weight(s) for s in grams]) if self.shared else np.ones(len(grams))
        known = np.zeros(len(grams))
        weight[hits] = known[hits] = [self.weight[grams[p]] for p in hits]
        have, total = (np.concatenate([[0.0], np.cumsum(x)]) for x in (known, weight))
        starts, sizes, classes = [], [], []
        for length, items in lengths.items():
            size = min(length, len(grams))
            at = np.arange(max(0, hits[0] - size + 1), min(hits[-1], len(grams) - size) + 1)
            mine, least = have[at + size] - have[at], min(self.totals[i] for i in items)
            at = at[mine >= self.similarity * (least + total[at + size] - total[at] - mine) - 1e-6]
            starts.append(at)
            sizes.append(np.full(len(at), size))
            classes.append(np.full(len(at), length))
        start, size, of = (np.concatenate(x) for x in (starts, sizes, classes))
        order = np.argsort(start, kind="stable")
        start, size, of = start[order], size[order], of[order]
        best: dict[int, tuple[int, int, float]] = {}
        for run in np.split(np.arange(len(start)), np.flatnonzero(np.diff(start) > max(lengths)) + 1):
            for a in range(0, len(run), ROWS):
                rows = run[a : a + ROWS]
                first, end = int(start[rows[0]]), int((start[rows] + size[rows]).max())
                sums = np.concatenate([np.zeros((1, BITS), np.int64), np.cumsum(votes(grams[first:end], weight[first:end]), axis=0, dtype=np.int64)])
                prints = print_of(sums[start[rows] + size[rows] - first] - sums[start[rows] - first])
                for length in np.unique(of[rows]).tolist():
                    mine = np.flatnonzero(of[rows] == length)
                    for w, n, apart in self.indexes[k, length].near(prints[mine]):
                        item, at, wide = lengths[length][n], int(start[rows[mine[w]]]), int(size[rows[mine[w]]])
                        like = self.likeness(item, Counter(grams[at : at + wide]))
                        old = best.get(item)
                        if like >= self.similarity - 1e-9 and (old is None or (like, -apart, -at) > (old[2], -old[1], -old[0])):
                            best[item] = (at, apart, like)
        return best


def _shared(items: DataFrame) -> dict[int, int]:
    """How many items have a shingle, by its hash, of those that several have."""

    def work(batch):
        for part in slices(batch, "t", 1 << 20):
            yield {"h": [hash_of(s).to_bytes(16) for t in part.column("t").to_pylist() for s in set(shingles_of(words_of(t)))]}

    counts = arrow_map(items.select("t"), work, "h binary").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    return {int.from_bytes(r["h"]): r["n"] for r in counts.toLocalIterator()}


def blocks(benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, id_column: str = "item_id", text_column: str = "text") -> Iterator[Benchmark]:
    """Items in blocks of about BLOCK_BYTES, dealt by the hash of their text; null texts are left out."""
    items = benchmark.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).cast("string").alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    shared = _shared(items) if n > 1 else None
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k) if n > 1 else items
        yield Benchmark([(r["i"], r["t"]) for r in part.orderBy("i", "t").toLocalIterator()], similarity, radius, shared)


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start_word, distance, similarity): each item found in a document, at its best window.

    Words are runs of letters, digits and underscores in lower case. Of equally
    good windows the one with fewer differing bits counts, then the first. Null
    texts hold nothing, items without words are in nothing. Repeated rows are
    repeated; equal items are all found.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("t"))
    out = None
    for known in blocks(benchmark, similarity, radius):

        def work(batch, known=known):
            for part in slices(batch, "t"):
                cols: dict[str, list] = {c: [] for c in ("doc_id", "item_id", "start_word", "distance", "similarity")}
                for i, t in zip(part.column("i").to_pylist(), part.column("t").to_pylist(), strict=True):
                    for found in known.find(t or ""):
                        for k, v in zip(cols, (i, *found), strict=True):
                            cols[k].append(v)
                yield cols

        found = arrow_map(rows, work, "doc_id long, item_id long, start_word long, distance int, similarity double")
        out = found if out is None else out.union(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, text_column: str = "text") -> DataFrame:
    """The rows in which no item is found, with all their columns."""
    for known in blocks(benchmark, similarity, radius):
        docs = keep_rows(docs, lambda known=known: lambda texts: [not known.find(t) for t in texts], text_column)
    return docs
