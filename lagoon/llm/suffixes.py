"""Exact removal of repeated passages by longest previous factors.

A byte goes if a string of SPAN bytes that covers it also starts in a document
with a smaller id. A suffix array over the corpus would put equal strings side by
side; then the nearest suffixes before and after with a smaller document are all
the earlier matches there are to look at, and the longer common prefix of the two
is the longest previous factor. No machine holds that array. What makes it
distributed is that only factors of SPAN bytes and more matter:

1. Anchors. Of every run of 35 grams of 16 bytes, that is of every SPAN bytes,
   the grams with the least hash are anchors. The choice looks at those bytes
   alone, so two equal strings of SPAN bytes have the same anchors at the same
   places, and suffixes that share SPAN bytes meet at an anchor's key.
2. Each key's anchors come in order of document, as a stream. Anchors that stand
   in the very context (34 bytes on both sides) the first document has are
   settled: all strings through them are repeats. Only the rest, where texts
   begin to differ, need bytes.
3. For those, the suffixes of the contexts are sorted, for each alignment to the
   anchor, each order induced from the one before. Suffixes with SPAN common bytes form a run; a previous or next smaller
   document exists in the run unless the document is the run's least, so the
   longest previous factor reaches SPAN for all but that one.
4. Each document's repeated starts are gathered and its bytes removed.

Judged on the input: what goes does not depend on what else goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.llm.common import arrow_map, as_batch, bytes_of, fresh, slices, stage, text_of
from lagoon.plans.ranges import range_position

SPAN = 50
GRAM = 16
SIDE = SPAN - GRAM  # bytes of context on either side of an anchor
GRAMS = SIDE + 1  # grams in SPAN bytes, and alignments of SPAN bytes to an anchor
ROW = 96  # bytes that hold an anchor with its context, and nulls
CHUNK = 1 << 20
#: Contexts of one anchor that are sorted in one task; more are matched by the hash of each string.
GROUP = 200_000
TAG = 32  # bits that tell texts of one id apart; above them the position, below 2 ** 31 as in any string

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _words(b: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a number."""
    h = b.astype(np.uint64)
    h = h[:-1] | (h[1:] << np.uint64(8))
    h = h[:-2] | (h[2:] << np.uint64(16))
    return h[:-4] | (h[4:] << np.uint64(32))


def _fold(h: np.ndarray, w: np.ndarray, odd: np.uint64) -> np.ndarray:
    h = (h ^ w) * odd
    return h ^ (h >> np.uint64(29))


def _extreme(x: np.ndarray, size: int, of) -> np.ndarray:
    """Least or greatest of every `size` neighbours."""
    done = 1
    while done * 2 <= size:
        x = of(x[:-done], x[done:])
        done *= 2
    return of(x[: len(x) - (size - done)], x[size - done :]) if done < size else x


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int, bytes, int, int]]:
    """(text, where the piece begins, piece, first start, end of starts): starts of SPAN bytes, with SIDE bytes around."""
    for i, t in enumerate(texts):
        for a in range(0, len(t) - SPAN + 1, CHUNK):
            stop = min(a + CHUNK, len(t) - SPAN + 1)
            begin = max(0, a - SIDE)
            yield i, begin, t[begin : stop + SPAN - 1 + SIDE], a - begin, stop - begin


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash of gram, hash of context) of every anchor; texts of under SPAN bytes have none."""
    found = []
    group: list = []
    held = 0

    def flush() -> None:
        pad = bytes(SIDE)
        joined = np.frombuffer(pad + pad.join(p[2] for p in group) + pad + bytes(8), np.uint8)
        begin = np.cumsum([SIDE] + [len(p[2]) + SIDE for p in group[:-1]])
        w8 = _words(joined)
        n = len(joined) - SPAN - 8
        gram = _fold(_fold(np.full(n + SIDE, _B), w8[: n + SIDE], _A), w8[8 : n + SIDE + 8], _C)
        gram = (gram * _B) | np.uint64(1)
        least = _extreme(gram, GRAMS, np.minimum)
        valid = np.zeros(len(least) + 1, np.int8)
        np.add.at(valid, begin + [p[3] for p in group], 1)
        np.add.at(valid, begin + [p[4] for p in group], -1)
        least[np.cumsum(valid[:-1]) == 0] = 0
        zero = np.zeros(SIDE, np.uint64)
        best = _extreme(np.concatenate([zero, least, zero]), GRAMS, np.maximum)
        at = np.flatnonzero(best[: len(gram)] == gram)
        which = np.searchsorted(begin, at, side="right") - 1
        length = np.array([len(p[2]) for p in group])[which]
        inside = at - begin[which]
        base = np.array([p[1] for p in group])[which]
        text = np.array([p[0] for p in group])[which]
        size = np.array([len(t) for t in texts])[text]
        position = base + inside
        c = np.minimum(position, SIDE).astype(np.uint64) * _A ^ np.minimum(size - position - GRAM, SIDE).astype(np.uint64)
        # the pads are nulls and the sides' lengths are hashed too, so contexts at the ends of a text are told apart
        span = GRAM + 2 * SIDE
        offsets = [*range(0, span - 8, 8), span - 8]
        for o in offsets:
            c = _fold(c, w8[at - SIDE + o], _A)
        c = (c * _C) ^ (c >> np.uint64(32))
        keep = inside + GRAM <= length
        found.append((text[keep], position[keep], gram[at][keep], c[keep]))

    for p in _pieces(texts):
        group.append(p)
        held += len(p[2])
        if held >= CHUNK:
            flush()
            group, held = [], 0
    if group:
        flush()
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    text, position, gram, c = (np.concatenate(x) for x in zip(*found, strict=True))
    if any(len(t) > CHUNK for t in texts):  # pieces overlap
        _, first = np.unique(np.stack([text, position]), axis=1, return_index=True)
        text, position, gram, c = text[first], position[first], gram[first], c[first]
    return text, position, gram, c


def progressions(text: np.ndarray, position: np.ndarray, gram: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that stay, run) of anchors: those of one text with one gram and context, at equal distances, are one row.

    run: distance << 32 | further anchors; 0 for one alone. Text that repeats itself
    for long has as many anchors of one key as periods, and now one row for all.
    """
    key = _fold(_fold(gram, c, _A), text.astype(np.uint64), _C)  # most stand alone in it and need no sorting
    by = np.argsort(key)
    twin = key[by[1:]] == key[by[:-1]]
    several = np.zeros(len(key), bool)
    several[by[1:][twin]] = several[by[:-1][twin]] = True
    alone, several = np.flatnonzero(~several), np.flatnonzero(several)
    order = several[np.lexsort((position[several], c[several], gram[several], text[several]))]
    same = np.zeros(len(order), bool)
    same[1:] = np.all([x[order][1:] == x[order][:-1] for x in (text, gram, c)], axis=0)
    keep, run = np.ones(len(order), bool), np.zeros(len(order), np.int64)
    head = step = -1
    at = position[order]
    for k in np.flatnonzero(same).tolist():
        d = int(at[k] - at[k - 1])
        if not same[k - 1] or head < 0 or (keep[k - 1] and head != k - 1):
            head, step = k - 1, d
        elif keep[k - 1]:
            step = d
        if d == step:
            keep[k] = False
            run[head] = step << 32 | ((run[head] & 0xFFFFFFFF) + 1)
        else:
            head = k
    return np.concatenate([alone, order[keep]]), np.concatenate([np.zeros(len(alone), np.int64), run[keep]])


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Number of the run of equal rows each sorted row is in."""
    fresh = np.zeros(len(columns[0]), bool)
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return np.cumsum(fresh)


def _groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 200_000) -> Iterator[pa.Table]:
    """Sorted batches as tables of about `rows` rows that hold whole groups of the key."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        keys = t.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut).to_batches()
        count = t.num_rows - cut
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


SETTLED = "doc long, spot long, run long, h long, full boolean"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors sorted by gram and document: what the first document's contexts settle, and what is left open.

    Of a group that goes on in the next batch only the first document's anchors are kept.
    """
    arrow = pa.schema([("doc", pa.int64()), ("spot", pa.int64()), ("run", pa.int64()), ("h", pa.int64()), ("full", pa.bool_())])
    names = ("h", "doc", "c", "spot", "run")
    kept = {n: np.zeros(0, np.int64) for n in names}
    shown = np.zeros(0, bool)  # kept rows that went out already
    several: list[pa.RecordBatch] = []

    def some() -> Iterator[dict[str, np.ndarray]]:
        nonlocal several
        count = 0
        for b in batches:
            several.append(b)
            count += b.num_rows
            if count >= 200_000:
                t, several, count = pa.Table.from_batches(several), [], 0
                yield {n: t.column(n).to_numpy() for n in names}
        if several:
            t = pa.Table.from_batches(several)
            yield {n: t.column(n).to_numpy() for n in names}

    for new in some():
        if not len(new["h"]):
            continue
        rows = {n: np.concatenate([kept[n], new[n]]) for n in names}
        known = np.concatenate([np.ones(len(kept["h"]), bool), np.zeros(len(new["h"]), bool)])
        out_already = np.concatenate([shown, np.zeros(len(new["h"]), bool)])
        g = _runs(rows["h"])
        head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        first = rows["doc"] == rows["doc"][head][g]
        pair = _fold(rows["c"].view(np.uint64), g.astype(np.uint64) * _B, _A)
        settled = ~first & np.isin(pair, pair[first])
        open_ = ~first & ~settled
        contested = np.zeros(g[-1] + 1, bool)
        contested[g[open_]] = True
        emit = (settled & ~known) | (open_ & ~known) | (first & contested[g] & ~out_already)
        if emit.any():
            yield as_batch({"doc": rows["doc"][emit], "spot": rows["spot"][emit], "run": rows["run"][emit], "h": rows["h"][emit], "full": settled[emit]}, arrow)
        last = (g == g[-1]) & first
        kept = {n: rows[n][last] for n in names}
        shown = out_already[last] | contested[-1]


SOLVED = "doc long, spot long, run long, mask long"


def solve(gram: np.ndarray, doc: np.ndarray, left: np.ndarray, contexts: list[bytes]) -> np.ndarray:
    """For each context, the alignments (bits) whose SPAN bytes have a longest previous factor of SPAN.

    gram tells groups apart. left: bytes before the anchor. Alignment j starts
    j - SIDE bytes from the anchor. Only the suffixes from the anchor on are sorted
    in full; the order of those a byte longer is induced from them, as in the
    construction of a suffix array, for one alignment after the other.
    """
    n, width = len(doc), GRAM + 2 * SIDE
    padded = np.zeros((n, ROW), np.uint8)
    size = np.array([len(c) for c in contexts], np.int64)
    right = size - left
    inner = size == width
    padded[inner, :width] = np.frombuffer(b"".join(c for c in contexts if len(c) == width), np.uint8).reshape(-1, width)
    for i in np.flatnonzero(~inner).tolist():
        begin = SIDE - left[i]
        padded[i, begin : begin + size[i]] = np.frombuffer(contexts[i], np.uint8)
    group = np.unique(gram, return_inverse=True)[1] << 8
    mask = np.zeros(n, np.int64)
    words = np.ascontiguousarray(padded[:, SIDE : SIDE + 56]).view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], group))
    for j in reversed(range(GRAMS)):
        if j < SIDE:  # the suffixes one byte longer: by that byte, and in equal ones as they were
            order = order[np.argsort(group[order] | padded[order, j], kind="stable")]
        at = order[(left[order] >= SIDE - j) & (right[order] >= SPAN - SIDE + j)]
        if len(at) < 2:
            continue
        rows = padded[at]
        words = [np.ndarray(len(at), np.uint64, rows, o, (ROW,)) for o in (*range(j, j + SPAN - 8, 8), j + SPAN - 8)]
        run = _runs(group[at], *words)
        docs = doc[at]
        least = np.minimum.reduceat(docs, np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])))
        mask[at[docs > least[run]]] |= np.int64(1 << j)
    return mask


def _sorted_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    arrow = pa.schema([("doc", pa.int64()), ("spot", pa.int64()), ("run", pa.int64()), ("mask", pa.int64())])
    for t in _groups(batches, "h", 50_000):
        doc, spot, run, left = (t.column(c).to_numpy() for c in ("doc", "spot", "run", "lft"))
        mask = solve(t.column("h").to_numpy(), doc, left, t.column("context").to_pylist())
        some = mask != 0
        yield as_batch({"doc": doc[some], "spot": spot[some], "run": run[some], "mask": mask[some]}, arrow)


def _strings(batch: pa.RecordBatch):
    """Every SPAN bytes through an anchor, by two hashes of 64 bits."""
    out: dict[str, list] = {c: [] for c in ("a", "b", "doc", "spot", "run", "bit")}
    for doc, spot, run, left, context in zip(*(batch.column(c).to_pylist() for c in ("doc", "spot", "run", "lft", "context")), strict=True):
        for s in range(max(0, left - SIDE), min(left, len(context) - SPAN) + 1):
            digest = hashlib.blake2b(context[s : s + SPAN], digest_size=16).digest()
            for k, v in zip(out, (int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), doc, spot, run, 1 << (s - left + SIDE)), strict=True):
                out[k].append(v)
    yield out


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(doc, tag, starts): for each document with repeats, (position of an anchor, its run, alignments that repeat; -1: all).

    docs: i (id, the greatest long for null), t (text), tag (of `told_apart`).
    """

    def find(batch):
        for part in slices(batch, "t", 4 << 20):
            ids = part.column("i").to_numpy()
            tag = part.column("tag").to_numpy()
            text, position, gram, c = anchors(bytes_of(part.column("t")))
            stay, run = progressions(text, position, gram, c)
            text, position, gram, c = text[stay], position[stay], gram[stay], c[stay]
            yield {"h": gram.view(np.int64), "c": c.view(np.int64), "doc": ids[text], "spot": position << TAG | tag[text], "run": run}

    marks = arrow_map(docs, find, "h long, c long, doc long, spot long, run long")
    marks = marks.repartition("h").sortWithinPartitions("h", "doc")
    marks = stage(marks.mapInArrow(_settle, SETTLED))

    tag, place = F.col("spot").bitwiseAND((1 << TAG) - 1), F.shiftright("spot", TAG)
    open_ = marks.where("not full")
    wanted = open_.select("doc", tag.alias("tag"), "h", place.alias("place"), "run").groupBy("doc", "tag").agg(F.collect_list(F.struct("h", "place", "run")).alias("wanted"))

    def cut(batch):
        for part in slices(batch, "t", 4 << 20):
            texts = bytes_of(part.column("t"))
            wanted = part.column("wanted")
            text = np.repeat(np.arange(len(texts)), wanted.value_lengths().to_numpy())
            h, place, run = (c.to_numpy() for c in wanted.flatten().flatten())
            size = np.array([len(t) for t in texts], np.int64)
            joined, base = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size
            doc, tag = (part.column(c).to_numpy() for c in ("i", "tag"))
            for s in range(0, len(h), 1 << 20):
                k, p = text[s : s + (1 << 20)], place[s : s + (1 << 20)]
                begin = np.maximum(p - SIDE, 0)
                length = np.minimum(p + SPAN, size[k]) - begin
                ends = np.cumsum(length)
                offsets = np.append(0, ends).astype(np.int32)
                data = joined[np.arange(ends[-1]) + np.repeat(base[k] + begin - (ends - length), length)]
                context = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield {"h": h[s : s + len(k)], "doc": doc[k], "spot": p << TAG | tag[k], "run": run[s : s + len(k)], "lft": p - begin, "context": context}

    joined = docs.join(wanted.withColumnRenamed("doc", "i"), ["i", "tag"])
    contexts = arrow_map(joined, cut, "h long, doc long, spot long, run long, lft int, context binary")
    crowded = open_.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("h")
    crowded = stage(crowded)
    if crowded.isEmpty():
        few, many = contexts, None
    else:
        contexts = stage(contexts)
        few, many = contexts.join(crowded, "h", "left_anti"), contexts.join(crowded, "h", "left_semi")
    solved = few.repartition("h").sortWithinPartitions("h").mapInArrow(_sorted_contexts, SOLVED)
    if many is not None:
        strings = stage(arrow_map(many, _strings, "a long, b long, doc long, spot long, run long, bit long"))
        least = strings.groupBy("a", "b").agg(F.min("doc").alias("least"))
        later = strings.join(least, ["a", "b"]).where("doc > least")
        solved = solved.union(later.groupBy("doc", "spot", "run").agg(F.bit_or("bit").alias("mask")))
    solved = stage(solved)
    every = marks.where("full").select("doc", "spot", "run", F.lit(-1).cast("long").alias("mask")).union(solved)
    return every.select("doc", tag.alias("tag"), F.struct(place.alias("place"), "run", "mask").alias("start")).groupBy("doc", "tag").agg(F.collect_list("start").alias("starts"))


def told_apart(rows: DataFrame) -> DataFrame:
    """rows (i, t, ...) with tag: different for different texts of one id, the same for repeated rows.

    A hash of one bit less than TAG, and where texts of one id meet in it, a number
    with that bit. Meetings are found by a second hash of 64 bits; they are few, so that
    the join that renames them is as a rule a broadcast Spark chooses by their size.
    """
    other, meets = fresh(rows, "__other"), fresh(rows, "__meets")
    tagged = rows.withColumn("tag", F.xxhash64("t").bitwiseAND((1 << (TAG - 1)) - 1)).withColumn(other, F.xxhash64(F.lit(TAG), "t"))
    groups = tagged.groupBy("i", "tag").agg(F.min(other).alias("a"), F.max(other).alias("b")).where("a <> b").select("i", "tag")
    groups = stage(groups)
    if groups.isEmpty():
        return tagged.drop(other)
    texts = tagged.select("i", "tag", other).join(groups, ["i", "tag"]).distinct()
    number = range_position(texts, ["i"], [F.asc("tag"), F.asc(other)], meets)
    number = stage(number.withColumn(meets, F.col(meets) + (1 << (TAG - 1))))
    return tagged.join(number, ["i", "tag", other], "left").withColumn("tag", F.coalesce(meets, "tag")).select(*rows.columns, "tag")


def covered(size: int, place: np.ndarray, run: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which of `size` bytes lie in a repeated string."""
    if run.any():
        more = (run & 0xFFFFFFFF) + 1
        nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        place = np.repeat(place, more) + np.repeat(run >> 32, more) * nth
        mask = np.repeat(mask, more)
    first = np.zeros(size + 1, bool)
    whole = place[mask == -1]
    edge = np.zeros(size + 2, np.int64)
    np.add.at(edge, np.maximum(whole - SIDE, 0), 1)
    np.add.at(edge, np.maximum(np.minimum(whole, size - SPAN) + 1, np.maximum(whole - SIDE, 0)), -1)
    first[:size] = np.cumsum(edge)[:size] > 0
    some = mask != -1
    which, bit = np.nonzero((mask[some, None] >> np.arange(GRAMS)) & 1)
    first[place[some][which] - SIDE + bit] = True
    starts = np.cumsum(first[:size])  # so many up to each byte; then those that reach it
    starts[SPAN:] -= starts[:-SPAN].copy()
    return starts > 0


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row.

    Null text counts as empty. Texts of under SPAN bytes keep all. A null id is
    greater than any other, and rows of one id, null or not, are no earlier than
    each other, so they do not remove one another's bytes. kept: the remaining bytes.
    """
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(2**63 - 1)).alias("i"), text_of(text_column).cast("string").alias("t"), F.col(id_column).isNull().alias("none"))
    tagged = told_apart(rows)
    starts = repeated_starts(tagged.select("i", "t", "tag")).withColumnRenamed("doc", "i")

    def work(batch):
        for part in slices(batch, "t", 4 << 20):
            out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else []))}
            for i, none, t, starts in zip(part.column("i").to_pylist(), part.column("none").to_pylist(), bytes_of(part.column("t")), part.column("starts"), strict=True):
                rest, removed, spans = t, 0, 0
                if starts.is_valid and len(starts):
                    fields = starts.values
                    gone = covered(len(t), *(fields.field(c).to_numpy() for c in ("place", "run", "mask")))
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if removed else 0
                    rest = np.frombuffer(t, np.uint8)[~gone].tobytes()
                values = (None if none else i, len(t), removed, spans, hashlib.sha256(rest).hexdigest(), *([rest] if keep_text else []))
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)
            yield out

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    return arrow_map(tagged.join(starts, ["i", "tag"], "left"), work, schema)


#: The query in DuckDB SQL: every string of 50 bytes in hex, its first document, and runs of later starts.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
strings AS (SELECT doc_id, unnest(range(CAST(length(x) // 2 - 49 AS BIGINT))) AS p, x FROM d),
placed AS MATERIALIZED (SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS w FROM strings),
firsts AS (SELECT w, min(doc_id) AS first FROM placed GROUP BY w),
starts AS (SELECT doc_id, p FROM placed JOIN firsts USING (w) WHERE doc_id > first),
marked AS (SELECT doc_id, p, CAST(coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 50, true) AS INTEGER) AS fresh FROM starts),
numbered AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked),
runs AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS z FROM numbered GROUP BY doc_id, k),
gaps AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
kept AS (SELECT g.doc_id, count(*) AS n, sum(z - a) AS gone, max(z) AS tail,
                string_agg(substr(x, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS head
         FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN x ELSE head || substr(x, CAST(2 * tail + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
