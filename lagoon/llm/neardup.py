"""Groups of near-duplicates: SimHash by the generalised pigeonhole, and the exact similarity of shingles.

Two kinds of links make the groups, and both are closed over together. Texts whose
fingerprints lie within a radius are linked by `simhash.components`, where one is
given. Fingerprints weigh shingles by how often they come, so they bring together
what is mostly one passage over and over, and they miss similar texts a few bits
farther apart. Texts whose sets of shingles are similar are linked by candidates
that hold every such pair and a check of each.

If the Jaccard similarity of two sets is at least t, at most d = (1 - t) * n
members of a set of n are not in the other one. So whatever the order of all
members, as long as it is one for all sets, the first d + 1 members of a set hold
one of the other's: the first common member is among them in both. The order
here is by how many texts have a shingle, rarest first. Shingles that no
other text has come first and match nothing; a text of which they are more than
d has no key at all. So texts that share a passage, a sentence or a licence, but
not nearly everything, never become candidates, and keys are rare ones.

Only the shingles in half of the hashes' range are counted: d bounds what is
not common there, too. Small sets have keys in the whole range instead; sizes
around the border have both. Where a set has not more than d members in the half,
all of them are keys, and one more that all such sets have.

Sets that share a key are chained, not paired: each is linked to the key's first
one. Connected candidates form a family; the family's texts are brought together
in blocks of bounded size, each pair of blocks in its own task, where pairs are
verified by the Jaccard similarity of their sets of shingles, nearest first,
unless they are connected already. Left unverified are pairs that cannot be
similar: their sizes, or bits that count shingles by twos, are too far apart.
So no task holds an unbounded group, no pair of a large group leaves a task, and
what connects two texts is always verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.llm.common import arrow_map, bytes_of, connected, fresh, slices, stage, text_of
from lagoon.llm.simhash import components, fingerprint, hashes, shingles

SHINGLE = 5
SIMILARITY = 0.8
#: Words in a shingle of the fingerprints.
PRINT_SHINGLE = 3
#: Thousands of links that a task holds before repeats among them are dropped.
BUCKET = 64
BLOCK = 1024
#: Bits of the widest parity print.
PRINT_BITS = 4096


def set_of(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the set of shingles."""
    return np.unique(hashes(list(set(shingles(text, shingle)))))


def apart(both: int | np.ndarray, similarity: float) -> int | np.ndarray:
    """How many members are in one set only, at most, if similar sets have `both` members together, common ones twice."""
    return np.floor(both * (1 - similarity) / (1 + similarity) + 1e-6).astype(np.int64)


#: Sets of so many members, and sets similar to these, have keys in the whole range of hashes; larger ones in its lower half.
SMALL = 64
HALF = np.uint64(1 << 63)
_SALT = np.uint64(0x9E3779B97F4A7C15)
#: Keys of sets without members, and of sets that have too few in the half.
_EMPTY, _FEW = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Texts that have a shingle are counted up to so many; the order of more common ones is by hash.
COUNTED = 1000


def members(own: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, int]]:
    """(members to be counted, tag) of a sorted set, once for each range it has keys in.

    tag: twice the number of keys that it needs besides its members that other
    sets have, and the range.
    """
    n = len(own)
    if not n:
        yield np.array([_EMPTY]), 0
        return
    differ = int((1 - similarity) * n + 1e-6)
    if n <= int(SMALL / similarity) + 1:
        yield own, 2 * (differ + 1 - n)
    if n >= SMALL:
        half = own[: np.searchsorted(own, HALF)]
        need = differ + 1 - len(half)
        yield np.append(half, _FEW) ^ _SALT if need > 0 else half ^ _SALT, 2 * need + 1


def _members(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(t, s) → (h, s, tag); copies in one task are one text."""
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "t", 1 << 20):
                h, s, tag, size = [], [], [], []
                for own, text in zip(part.column("s").to_pylist(), bytes_of(part.column("t")), strict=True):
                    if own in seen:
                        continue
                    seen.add(own)
                    for held, t in members(set_of(text, shingle), similarity):
                        h.append(held)
                        s.append(own)
                        tag.append(t)
                        size.append(len(held))
                if h:
                    columns = [pa.array(np.concatenate(h).view(np.int64)), pa.array(np.repeat(s, size), pa.int64()), pa.array(np.repeat(tag, size), pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["h", "s", "tag"])

    return run


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Rows at which a run of equal values begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _columns(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield [batch.column(c).to_numpy() for c in names]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (h, s, tag) → (s, tag, df, h) of what several texts have; a run of more than COUNTED rows is not held."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
    common = last = None  # the common shingle whose rows pass through, and the last text that had it

    def out(h, s, tag, df) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(s), pa.array(tag), pa.array(df.astype(np.int32)), pa.array(h)], ["s", "tag", "df", "h"])

    for columns in _columns(batches, ("h", "s", "tag")):
        h, s, tag = (np.concatenate(x) for x in zip(held, columns, strict=True))
        if common is not None:
            n = int(np.searchsorted(h, common, "right"))
            if n:
                new = np.append(s[0] != last, s[1:n] != s[: n - 1])
                last = s[n - 1]
                yield out(h[:n][new], s[:n][new], tag[:n][new], np.full(new.sum(), COUNTED))
            h, s, tag = h[n:], s[n:], tag[n:]
        if not len(h):
            held = [h, s, tag]
            continue
        common = None
        once = _starts(h, s, tag)  # exact copies from several tasks
        h, s, tag = h[once], s[once], tag[once]
        starts = _starts(h)
        end = starts[-1]  # the last run may go on
        df = np.repeat(np.diff(starts), np.diff(starts))
        some = df > 1
        if some.any():
            yield out(h[:end][some], s[:end][some], tag[:end][some], np.minimum(df[some], COUNTED))
        h, s, tag = h[end:], s[end:], tag[end:]
        if len(h) > COUNTED:
            yield out(h, s, tag, np.full(len(h), COUNTED))
            common, last = h[0], s[-1]
            h, s, tag = h[:0], s[:0], tag[:0]
        held = [h, s, tag]
    h, s, tag = held
    if len(h) > 1:
        yield out(h, s, tag, np.full(len(h), len(h)))


def _rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (s, tag, df, h) → (key, nid): the rarest of each text, as many as it needs. A task holds the rows of one text."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]

    def out(s, tag, h) -> pa.RecordBatch:
        starts = _starts(s, tag)
        size = np.diff(np.append(starts, len(s)))
        rank = np.arange(len(s)) - np.repeat(starts, size)
        keep = rank < np.repeat((tag[starts] >> 1) + size, size)
        return pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(s[keep])], ["key", "nid"])

    for columns in _columns(batches, ("s", "tag", "h")):
        s, tag, h = (np.concatenate(x) for x in zip(held, columns, strict=True))
        end = _starts(s, tag)[-1]
        if end:
            yield out(s[:end], tag[:end], h[:end])
        held = [s[end:], tag[end:], h[end:]]
    if len(held[0]):
        yield out(*held)


def candidates(rows: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(key, nid): texts whose sets are similar share a key. rows: s (a hash of the text, the nid), t."""
    found = rows.select("t", "s").mapInArrow(_members(shingle, similarity), "h long, s long, tag int")
    found = found.repartition("h").sortWithinPartitions("h", "s", "tag").mapInArrow(_shared, "s long, tag int, df int, h long")
    # a text's rows are at most its shingles
    found = stage(found).repartition("s").sortWithinPartitions("s", "tag", "df", "h")
    return found.select("s", "tag", "h").mapInArrow(_rarest, "key long, nid long")


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, nid): a link of each row to the key's first one."""
    last_key, last_first = None, 0
    held: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        links = np.concatenate(held, axis=1)
        links = links[:, np.lexsort(links)]
        links = links[:, np.append(True, (links[:, 1:] != links[:, :-1]).any(axis=0))[: links.shape[1]]]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(links[0], pa.int64()), pa.array(links[1], pa.int64())], ["a", "b"])

    for batch in batches:
        key, nid = batch.column("key").to_numpy(), batch.column("nid").to_numpy()
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = nid[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        if last_key is not None and key[0] == last_key:
            first[: np.append(np.flatnonzero(new[1:]) + 1, len(key))[0]] = last_first
        last_key, last_first = key[-1], first[-1]
        linked = first != nid
        held.append(np.stack([first[linked], nid[linked]]))
        if sum(h.shape[1] for h in held) > BUCKET * 1000:
            yield out()
    if held:
        yield out()


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set, as 64-bit words: whether an odd number of members falls on a bit."""
    bits = int(np.clip(1 << max(len(s) for s in sets).bit_length(), 64, PRINT_BITS))
    out = np.zeros((len(sets), bits), np.uint8)
    for i, s in enumerate(sets):
        out[i] = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of the rows of a and of b, as a matrix: no more than the members that are in one set only."""
    out = np.zeros((len(a), len(b)), np.int16)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted (family, i, j, side): links within a block or between two, that connect what they verify."""
        held: list[tuple[int, int, np.ndarray]] = []
        name = None

        def settle() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            side = np.array([h[0] for h in held])
            prints, sizes = parities([h[2] for h in held]), np.array([len(h[2]) for h in held])
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            within = not len(right)
            right = left if within else right
            found_a, found_b, found_d = [], [], []
            for s in range(0, len(left), 256):
                d = far(prints[left[s : s + 256]], prints[right])
                m, n = sizes[left[s : s + 256], None], sizes[None, right]
                x, y = np.nonzero((d <= apart(m + n, similarity)) & (np.minimum(m, n) >= similarity * np.maximum(m, n) - 1e-6))
                d = d[x, y]
                keep = left[s + x] < right[y] if within else np.ones(len(x), bool)
                found_a.append(left[s + x][keep])
                found_b.append(right[y][keep])
                found_d.append(d[keep])
            a, b, d = (np.concatenate(x) for x in (found_a, found_b, found_d))
            order = np.argsort(d, kind="stable")
            root = list(range(len(held)))

            def top(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            out = []
            for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
                p, q = top(x), top(y)
                if p == q:
                    continue
                if jaccard(held[x][2], held[y][2]) < similarity - 1e-9:
                    continue
                root[max(p, q)] = min(p, q)
                out.append((held[x][1], held[y][1]))
            return pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], ["a", "b"]) if out else None

        for batch in batches:
            for f, i, j, side, nid, s in zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j", "side", "nid", "set")), strict=True):
                if (f, i, j) != name:
                    if name is not None and (links := settle()) is not None:
                        yield links
                    name, held = (f, i, j), []
                if not held or held[-1][:2] != (side, nid):  # a row that is repeated
                    held.append((side, nid, np.frombuffer(s, np.uint64)))
        if name is not None and (links := settle()) is not None:
            yield links

    return run


def links(rows: DataFrame, nodes: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): verified links that connect all of one group.

    nodes: nid, sig, s, least, one for each text. rows: sig, s, i, t.
    """
    keys = candidates(rows, shingle, similarity).repartition("key").sortWithinPartitions("key", "nid")
    chains = stage(keys.mapInArrow(_chains, "a long, b long"))
    family = connected(chains).select(F.col("node").alias("s"), F.col("root").alias("family"))
    family = stage(family.join(nodes, "s").select("family", "nid", "sig", "least"))
    sizes = family.groupBy("family").agg(F.count("*").alias("n"))
    family = stage(family.join(sizes, "family"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    family = family.select("family", "nid", F.col("sig").alias("own"), "least", blocks.alias("blocks"), F.pmod(F.xxhash64("nid"), blocks).cast("int").alias("block"))

    def sets(batch):
        for part in slices(batch, "t", 4 << 20):
            out = {c: part.column(c) for c in ("family", "nid", "blocks", "block")}
            yield out | {"set": [set_of(t, shingle).tobytes() for t in bytes_of(part.column("t"))]}

    same = (F.col("sig") == F.col("own")) & F.col("i").eqNullSafe(F.col("least"))
    brought = rows.join(family, same).select("family", "nid", "blocks", "block", "t")
    brought = arrow_map(brought, sets, "family long, nid long, blocks int, block int, set binary")
    # each row goes to the pairs its block is in: itself, and with every other block
    pair = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda x: F.struct(F.least(x, "block").alias("i"), F.greatest(x, "block").alias("j"), F.when(x == F.col("block"), 0).when(x > F.col("block"), 0).otherwise(1).alias("side")),
    )
    dealt = brought.select("family", "nid", "set", F.explode(pair).alias("p")).select("family", "p.i", "p.j", "p.side", "nid", "set")
    dealt = dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "side", "nid")
    return dealt.mapInArrow(_verified(similarity), "a long, b long")


def fingerprinted(rows: DataFrame) -> DataFrame:
    """(sig, s, i, fp) of rows (sig, s, i, t): the SimHash in place of the text."""

    def work(batch):
        for part in slices(batch, "t"):
            yield {c: part.column(c) for c in ("sig", "s", "i")} | {"fp": [fingerprint(t, PRINT_SHINGLE) for t in bytes_of(part.column("t"))]}

    return arrow_map(rows, work, "sig binary, s long, i long, fp long")


def one_of_each(
    docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text", radius: int | None = None
) -> DataFrame:
    """The rows that stay when one of each group of near-duplicates does: the least id's, with all columns.

    A group is what links connect: of Jaccard similarity of at least `similarity`
    and, with a radius (1 or 2), of SimHash fingerprints that differ in so many bits
    at most. Equal texts are one text from the start; null counts as empty, and all texts
    without words are one group. Of rows that are the same in id and text one
    stays; a null id stays only where its group has no other.
    """
    sig = F.unhex(F.md5(F.encode(text_of(text_column).cast("string"), "UTF-8")))
    text = text_of(text_column).cast("string")
    rows = docs.select(F.col(id_column).cast("long").alias("i"), sig.alias("sig"), F.xxhash64(text).alias("s"), text.alias("t"))
    # one node per text: the row with the least id stands for it
    prints = rows.withColumn("fp", F.lit(0).cast("long")) if radius is None else fingerprinted(rows)
    each = prints.groupBy("sig", "s", "i").agg(F.count("*").alias("copies"), F.min("fp").alias("fp"))
    nodes = each.groupBy("sig", "s").agg(F.min(F.struct(F.col("i").isNull().alias("none"), F.col("i").alias("least"), "copies")).alias("best"), F.min("fp").alias("fp"))
    nodes = stage(nodes.select("sig", "s", "fp", "best.least", "best.copies").withColumn("nid", F.monotonically_increasing_id()))
    found = links(rows, nodes, shingle, similarity)
    if radius is not None:
        near = components(nodes.select(F.col("nid").alias("doc_id"), "fp"), radius)
        found = found.union(near.where("doc_id <> component_id").select("doc_id", "component_id"))
    roots = connected(found).withColumnRenamed("node", "nid")
    named = nodes.select("nid", "sig", "least", "copies").join(roots, "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    best = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "nid", "sig", "copies")).alias("best")
    stay = stage(named.groupBy("root").agg(best).select("best.sig", "best.least", "best.copies"))
    own_sig, own_least, own_copies = (fresh(docs, n) for n in ("__sig", "__least", "__copies"))
    stay = stay.select(F.col("sig").alias(own_sig), F.col("least").alias(own_least), F.col("copies").alias(own_copies))
    kept = docs.withColumn(own_sig, sig).join(stay, own_sig).where(F.col(id_column).cast("long").eqNullSafe(F.col(own_least)))
    once = kept.where(F.col(own_copies) == 1).select(*docs.columns)
    again = kept.where(F.col(own_copies) > 1).dropDuplicates([own_sig]).select(*docs.columns)
    return once.union(again)
