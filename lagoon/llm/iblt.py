"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: lines, within them sentences, long sentences in
runs of words. Each paragraph's digest (the n-th copy of a paragraph has its
own) is added to three cells, one in each third of the sketch: a count, the xor
of digests, the xor of their checks. Sketches of the same size subtract cell by
cell; what both hold is gone, and peeling cells with a single digest recovers
the paragraphs in which the two differ. If peeling gets stuck, both are
sketched again four times as large, with other cells, until it ends.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lagoon.llm.common import as_batch, slices, text_of

#: Cells in each third of the published sketch; factor of a retry; words of a run within one sentence.
CELLS = 8
LARGER = 4
RUN = 32
#: Text of a range of ids; ranges at most.
RANGE_BYTES = 4 << 20
RANGES = 10_000
_SENTENCE = re.compile(rb"(?<=[.!?])[\x20\x09-\x0d]+|\n")
_ODD = np.array([[0x9E3779B97F4A7C15], [0xC2B2AE3D27D4EB4F], [0x165667B19E3779F9]], np.uint64)


def paragraphs(text: bytes) -> list[bytes]:
    out = []
    for sentence in _SENTENCE.split(text):
        if len(sentence) < 2 * RUN:  # too short for a second run
            if sentence := sentence.strip():
                out.append(sentence)
            continue
        w = sentence.split()
        if len(w) <= RUN:
            if w:
                out.append(sentence.strip())
            continue
        out += [b" ".join(w[i : i + RUN]) for i in range(0, len(w), RUN)]
    return out


def digests(text: bytes) -> np.ndarray:
    """64-bit digests of the paragraphs; the n-th copy of one (from 0) is hashed with seed n."""
    found = paragraphs(text)
    digest = xxhash.xxh64_intdigest
    if len(set(found)) == len(found):
        return np.fromiter(map(digest, found), np.uint64, len(found))
    seen: dict[bytes, int] = {}
    out = np.zeros(len(found), np.uint64)
    for i, p in enumerate(found):
        n = seen.get(p, 0)
        seen[p] = n + 1
        out[i] = digest(p, n)
    return out


def _mix(x: np.ndarray, odd: np.ndarray | np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * odd
    return x ^ (x >> np.uint64(32))


def _checks(keys: np.ndarray) -> np.ndarray:
    return _mix(keys, np.uint64(0xD6E8FEB86659FD93)).astype(np.uint32)


def _cells(keys: np.ndarray, third: int) -> np.ndarray:
    """Cell in each third, one third after the other; the size is part of the hash, so a retry places all anew."""
    places = _mix(keys * np.uint64(2 * third + 1), _ODD) % np.uint64(third)
    return (places.astype(np.int64) + np.array([[0], [third], [2 * third]])).ravel()


class Sketch:
    def __init__(self, third: int):
        self.third = third
        self.count = np.zeros(3 * third, np.int32)
        self.keys = np.zeros(3 * third, np.uint64)
        self.checks = np.zeros(3 * third, np.uint32)

    def add(self, keys: np.ndarray, signs: np.ndarray | None = None) -> Sketch:
        at = _cells(keys, self.third)
        self.count += np.bincount(at, None if signs is None else np.concatenate([signs] * 3), 3 * self.third).astype(np.int32)
        np.bitwise_xor.at(self.keys, at, np.concatenate([keys] * 3))
        np.bitwise_xor.at(self.checks, at, np.concatenate([_checks(keys)] * 3))
        return self

    def __sub__(self, other: Sketch) -> Sketch:
        out = Sketch(self.third)
        out.count = self.count - other.count
        out.keys = self.keys ^ other.keys
        out.checks = self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Digests only the first, and only the second text has; None if some cannot be recovered. Empties the sketch."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            alone = np.flatnonzero(np.abs(self.count) == 1)
            alone = alone[_checks(self.keys[alone]) == self.checks[alone]]
            if not len(alone):
                break
            keys, signs = self.keys[alone], self.count[alone]
            if len(keys) > 1:
                order = np.argsort(keys)
                keys, signs = keys[order], signs[order]
                fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
                keys, signs = keys[fresh], signs[fresh]
            found.append((keys, signs))
            if sum(len(k) for k, _ in found) > 9 * self.third:  # false singles go round in circles
                return None
            self.add(keys, -signs)
        if self.count.any() or self.keys.any() or self.checks.any():
            return None
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        keys, signs = (np.concatenate(x) for x in zip(*found, strict=True))
        return keys[signs > 0], keys[signs < 0]

    def dump(self, paragraphs: int) -> str:
        """Text form: number of paragraphs, then the cells."""
        return f"{paragraphs}:" + base64.b64encode(struct.pack("<I", self.third) + self.count.astype("<i2").tobytes() + self.keys.tobytes() + self.checks.tobytes()).decode()


class Fingerprint:
    """Digests of a text and its sketches by size."""

    def __init__(self, text: bytes):
        self.keys = digests(text)
        self.sketches: dict[int, Sketch] = {}

    def sketch(self, third: int) -> Sketch:
        if third not in self.sketches:
            self.sketches[third] = Sketch(third).add(self.keys)
        return self.sketches[third]

    def __str__(self) -> str:
        return self.sketch(CELLS).dump(len(self.keys))


def difference(a: Fingerprint, b: Fingerprint) -> tuple[np.ndarray, np.ndarray]:
    """Paragraph digests only a has, and only b has; sketches grow until they can be peeled."""
    third = CELLS
    while True:
        found = (a.sketch(third) - b.sketch(third)).peel()
        if found is not None:
            return found
        third *= LARGER


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Share of the paragraphs of both that the other has too; 1 for two texts without any."""
    both = len(a.keys) + len(b.keys)
    if not both:
        return 1.0
    mine, theirs = difference(a, b)
    return 1.0 - (len(mine) + len(theirs)) / both


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) of the code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprint_versions(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The following text is the next row's by ascending id (null ids first, equal ids
    by the text's SHA-256), after the last the first row's; a lone row follows
    itself. Null text counts as empty, whose fingerprint is a sketch of nothing.

    Rows go to ranges of ids, each sorted and read as a stream of two rows at a
    time. A range's first row also goes to the range before it, so text is
    shuffled once and no order over all rows is ever made in one task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("i"), text_of(text_column).cast("string").alias("t"))
    n = docs.select(F.col(id_column).cast("long").alias("i"), F.octet_length(F.col(text_column).cast("string")).alias("n"))
    total = n.agg(F.sum("n")).first()[0] or 0
    ranges = int(min(RANGES, max(1, total // RANGE_BYTES)))
    cuts = n.agg(F.percentile_approx("i", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else None
    cuts = np.unique(np.array(cuts or [], np.int64))

    def range_of(ids: pa.Array) -> np.ndarray:
        plain = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(cuts, plain, side="right"))

    def least(batches):
        found: dict[int, int | None] = {}
        for batch in batches:
            ids = batch.column("i")
            where = range_of(ids)
            for r in np.unique(where).tolist():
                own = ids.filter(pa.array(where == r))
                v = None if own.null_count else pa.compute.min(own).as_py()
                found[r] = v if r not in found else None if None in (v, found[r]) else min(v, found[r])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64()), pa.array([v is None for v in found.values()], pa.bool_())], ["r", "i", "none"])

    firsts = n.select("i").mapInArrow(least, "r int, i long, none boolean").groupBy("r").agg(F.max("none").alias("none"), F.min("i").alias("i")).orderBy("r").collect()
    starts = [(x["r"], None if x["none"] else x["i"]) for x in firsts]
    into = {first: starts[k - 1][0] for k, (_, first) in enumerate(starts)}  # the first range's first row goes to the last range

    arrow = to_arrow_schema(StructType.fromDDL("r int, later int, i long, tie binary, t string"))

    def deal(batches):
        ahead: dict[int | None, tuple[bytes, str]] = {}
        for batch in batches:
            for part in slices(batch, "t"):
                ids, texts = part.column("i"), part.column("t").to_pylist()
                ties = [hashlib.sha256(t.encode()).digest() for t in texts]
                for i, tie, t in zip(ids.to_pylist(), ties, texts, strict=True):
                    if i in into and (i not in ahead or tie < ahead[i][0]):
                        ahead[i] = (tie, t)
                yield as_batch({"r": range_of(ids).astype(np.int32), "later": np.zeros(len(texts), np.int32), "i": ids, "tie": ties, "t": texts}, arrow)
        if ahead:
            yield as_batch({"r": [into[i] for i in ahead], "later": [1] * len(ahead), "i": list(ahead), "tie": [x[0] for x in ahead.values()], "t": [x[1] for x in ahead.values()]}, arrow)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    result = to_arrow_schema(StructType.fromDDL(schema))

    def pairs(batches):
        now = None  # (range, id, text, fingerprint)
        for batch in batches:
            for part in slices(batch, "t", 2 << 20):
                out = []
                for r, later, i, t in zip(*(part.column(c).to_pylist() for c in ("r", "later", "i", "t")), strict=True):
                    if later and (now is None or now[0] != r):
                        continue  # closed already
                    following = (r, i, t, Fingerprint(t.encode()))
                    if now is not None:
                        new = edited(now[2], t).encode()
                        print_ = Fingerprint(new)
                        out.append((now[1], len(now[2]), hashlib.sha256(new).hexdigest(), str(now[3]), str(print_), likeness(now[3], print_), likeness(now[3], following[3])))
                    now = None if later else following
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), result, strict=True)], schema=result)

    dealt = rows.mapInArrow(deal, "r int, later int, i long, tie binary, t string")
    sorted_ = dealt.repartition("r").sortWithinPartitions("r", "later", F.asc_nulls_first("i"), "tie")
    return sorted_.drop("tie").mapInArrow(pairs, schema)
