"""SimHash near-dedup by the generalised pigeonhole principle.

A fingerprint's 64 bits are dealt into m parts. If two fingerprints differ by at
most `radius` bits, then for any thresholds t_1 .. t_m that add up to
radius - m + 1 there is a part in which they differ by at most t_i bits (a part
with -1 is not looked at). Correlated bits share a part, and a dynamic program
picks m and the thresholds that cost least by the number of candidates expected
from the corpus' own bits. Each fingerprint is indexed once per part and probes
the variants its threshold allows; what meets there is verified.

Copies are folded before any of this: the work is on distinct fingerprints.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.llm.common import arrow_map, bytes_of, connected, slices, stage

BITS = 64
SEED = 42
#: A bucket with more rows than this is settled through centres or blocks, not by its pairs.
BUCKET = 64


def words(text: bytes) -> list[bytes]:
    """Maximal runs without ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def shingles(text: bytes, size: int) -> list[bytes]:
    """Runs of `size` words, repeats included; all words if there are fewer; none without words."""
    w = words(text)
    if len(w) <= size:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False)))


def hashes(items: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in items), dtype=np.uint64, count=len(items))


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, least significant bit first."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def from_bits(bits: np.ndarray) -> int:
    """64 booleans, least significant first, as a signed long."""
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, size: int) -> int:
    h = hashes(shingles(text, size))
    return from_bits(bit_counts(h) * 2 > len(h))


def fingerprints(docs: DataFrame, size: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of every row's whole text, as a signed long; null text counts as empty, empty is 0."""

    def work(batch):
        for part in slices(batch, "t"):
            yield {"doc_id": part.column("i"), "fp": [fingerprint(t, size) for t in bytes_of(part.column("t"))]}

    rows = docs.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).cast("string").alias("t"))
    return arrow_map(rows, work, "doc_id long, fp long")


# --- the plan: parts and thresholds ---------------------------------------------------------------


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how often each pair of bits is set together, over all fingerprints: 64 x 64 sums, whatever the size."""

    def work(batch):
        n = batch.num_rows
        values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        both = np.zeros((BITS, BITS))
        for i in range(0, n, 1 << 14):
            bits = np.unpackbits(values[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
        cells = np.concatenate([[n], both.ravel()]).astype(np.int64)
        yield {"cell": np.arange(len(cells)), "n": cells}

    got = arrow_map(nodes.select("fp"), work, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(1 + BITS * BITS)
    for r in got:
        cells[r["cell"]] = r["n"]
    return int(cells[0]), cells[1:].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m parts of near-equal width; each part grows by the free bit that is most correlated with it."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, parts = list(range(BITS)), []
    for k in range(m):
        part = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(part[0])
        while len(part) < BITS // m + (k < BITS % m):
            part.append(max(free, key=lambda b: (corr[b, part].sum(), -b)))
            free.remove(part[-1])
        parts.append(sorted(part))
    return parts


def within(q: np.ndarray, most: int) -> list[float]:
    """Chance that at most 0 .. most of independent bits with chances q differ."""
    dist = np.zeros(most + 1)
    dist[0] = 1
    for x in q:
        dist[1:] = dist[1:] * (1 - x) + dist[:-1] * x
        dist[0] *= 1 - x
    return list(np.cumsum(dist))


def allocate(n: int, both: np.ndarray, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is looked at: the cheapest plan whose thresholds guarantee the radius.

    Cost of a part: probes made, plus pairs expected to meet. Over parts and what is
    left of the sum of thresholds, the dynamic program keeps the cheapest choice.
    """
    p = np.diag(both) / max(n, 1)
    best = None
    for m in range(1, min(radius + 2, 5) + 1):
        parts = group_bits(n, both, m)
        state = {radius - m + 1 + m: (0.0, [])}  # thresholds are counted from -1, so that sums stay positive
        for part in parts:
            q = np.sort(2 * p[part] * (1 - p[part]))
            meet = within(q, radius)
            following: dict[int, tuple[float, list[int]]] = {}
            for left, (cost, chosen) in state.items():
                for t in range(-1, min(radius, left - 1) + 1):
                    probes = sum(math.comb(len(part), e) for e in range(t + 1))
                    if probes > 4096:
                        break
                    new = cost + (n * probes + n * n / 2 * meet[t] if t >= 0 else 0)
                    if left - t - 1 not in following or new < following[left - t - 1][0]:
                        following[left - t - 1] = (new, [*chosen, t])
            state = following
        if 0 in state and (best is None or state[0][0] < best[0]):
            best = (state[0][0], [(part, t) for part, t in zip(parts, state[0][1], strict=True) if t >= 0])
    return best[1]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def flips(part: list[int], most: int) -> list[int]:
    """Masks of up to `most` bits of the part."""
    return [signed(sum(1 << b for b in c)) for e in range(most + 1) for c in combinations(part, e)]


def mask(part: list[int]) -> int:
    return signed(sum(1 << b for b in part))


def _variants(number: int, part: list[int], most: int) -> Column:
    """(part, keys): the fingerprint's own bits of the part, with up to `most` of them turned."""
    own = F.col("fp").bitwiseAND(F.lit(mask(part)))
    turned = F.transform(F.array(*[F.lit(x) for x in flips(part, most)]), lambda x: own.bitwiseXOR(x))
    return F.struct(F.lit(number).alias("part"), turned.alias("keys"))


# --- links ------------------------------------------------------------------------------------------


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links of distinct fingerprints (column fp) that connect all that lie within the radius (1 or 2).

    Buckets of up to BUCKET index rows give the pairs that verify. The rows of a
    larger bucket, and what probes it, go through centres instead: two
    fingerprints are at most 2 apart exactly if some value is at most 1 from
    both. All at a centre are within 2 of each other and at most 65 there are,
    so a chain along each centre loses no connection, however many fingerprints
    crowd together. (For radius 1 the chain keeps the pairs that verify, and the
    centre is one of the two.)
    """
    if radius not in (1, 2):
        raise ValueError("radius is 1 or 2")
    plan = allocate(*bit_statistics(nodes), radius)
    fp = F.col("fp")
    keys = F.array(*[F.struct(F.lit(i).alias("part"), fp.bitwiseAND(F.lit(mask(p))).alias("key")) for i, (p, _) in enumerate(plan)])
    index = nodes.select(fp, F.explode(keys).alias("k")).select("fp", "k.part", "k.key")
    counts = index.groupBy("part", "key").agg(F.count("*").alias("n"))
    plain = all(t == 0 for _, t in plan)
    if plain:  # a bucket of one meets nothing
        counts = counts.where("n > 1")
    counts = stage(counts)
    index = stage(index.join(counts, ["part", "key"]))
    if plain:
        probes = index
    else:
        variants = F.array(*[_variants(i, p, t) for i, (p, t) in enumerate(plan)])
        probes = nodes.select(fp, F.explode(variants).alias("k")).select("fp", "k.part", F.explode("k.keys").alias("key"))
        probes = stage(probes.join(counts, ["part", "key"]))
    left, right = probes.where(F.col("n") <= BUCKET), index.where(F.col("n") <= BUCKET)
    pairs = (
        left.select("part", "key", fp.alias("a"))
        .join(right.select("part", "key", fp.alias("b")), ["part", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        .select("a", "b")
    )
    crowd = index.where(F.col("n") > BUCKET).select("fp").union(probes.where(F.col("n") > BUCKET).select("fp")).distinct()
    centres = F.array(*[F.lit(x) for x in flips(list(range(BITS)), 1)])
    at = crowd.select(fp, F.explode(F.transform(centres, lambda x: fp.bitwiseXOR(x))).alias("centre"))
    if radius == 2:
        least = at.groupBy("centre").agg(F.sort_array(F.collect_set("fp")).alias("all")).where(F.size("all") > 1)
        chain = least.select(F.explode(F.arrays_zip(F.expr("slice(all, 1, size(all) - 1)").alias("a"), F.expr("slice(all, 2, size(all) - 1)").alias("b"))).alias("e")).select("e.a", "e.b")
    else:
        chain = at.join(crowd.select(F.col("fp").alias("centre")), "centre").select(fp.alias("a"), F.col("centre").alias("b")).where("a < b")
    return pairs.union(chain).distinct()


def components(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id that links of at most `radius` bits reach.

    prints: doc_id, fp. Repeated rows stay repeated. A null doc_id links like any
    other and never names a component unless nothing else is in it.
    """
    prints = stage(prints)
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected(links(nodes, radius)).withColumnRenamed("node", "fp")
    named = stage(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
