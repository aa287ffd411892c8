"""Merkle manifest of a dataset: a tree over each group's rows, a tree over the groups, a proof for every row.

Time-forward processing: a node is worked on when all messages for its label have
come. Labels are (level, place), so children come before their parents; a
priority queue ordered by label delivers the children's digests to the parent.
The reversed sweep goes from the root down and delivers to each child the end of
its proof, that is the siblings of all nodes above it.

The queue is external. Trees are cut into blocks of BLOCK neighbouring nodes,
LEVELS levels high. Within a block it is a heap in memory; between blocks the
messages are rows that Spark partitions and sorts by the receiving block's label.
A block's root is a node of the next round, so a group of n rows takes
log(n) / log(BLOCK) rounds, whatever share of the rows it has.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.llm.common import stage
from lagoon.plans.ranges import range_position

FANOUT = 16
LEVELS = 3
BLOCK = FANOUT**LEVELS
#: A sweep's path: (digests before, digests after) of a node's run, from its own level up to the root.
Path = list[tuple[bytes, bytes]]


def digest(parts: bytes) -> bytes:
    """H of digests that lie one after the other in hexadecimal, in hexadecimal."""
    return hashlib.sha256(parts).hexdigest().encode()


def height(n: int) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while FANOUT**levels < n:
        levels += 1
    return levels


def sweep_up(leaves: Sequence[bytes], levels: int) -> list[list[bytes]]:
    """Digests of a block by level, the given ones first."""
    nodes = [list(leaves), *([] for _ in range(levels))]
    queue = [(1, i // FANOUT, i % FANOUT, d) for i, d in enumerate(leaves)] if levels else []
    heapq.heapify(queue)
    while queue:
        level, place = queue[0][:2]
        inbox = []
        while queue and queue[0][:2] == (level, place):
            inbox.append(heapq.heappop(queue)[3])
        own = digest(b"".join(inbox))
        nodes[level].append(own)
        if level < levels:
            heapq.heappush(queue, (level + 1, place // FANOUT, place % FANOUT, own))
    return nodes


def sweep_down(nodes: list[list[bytes]], path: Path) -> list[Path]:
    """The path of each node of the lowest level, given that of the block's root."""
    if len(nodes) == 1:
        return [path] * len(nodes[0])
    out: list[Path] = [[]] * len(nodes[0])
    queue = [(-(len(nodes) - 1), 0, path)]  # labels in reverse: from the root's level down
    while queue:
        level, place, own = heapq.heappop(queue)
        below = -level - 1
        first = -place * FANOUT
        run = nodes[below][first : first + FANOUT]
        for i in range(len(run)):
            child = [(b"".join(run[:i]), b"".join(run[i + 1 :])), *own]
            if below:
                heapq.heappush(queue, (-below, -(first + i), child))
            else:
                out[first + i] = child
    return out


def fold(leaf: bytes, path: Path) -> bytes:
    """The root that a leaf and its proof give."""
    for before, after in path:
        leaf = digest(before + leaf + after)
    return leaf


def _field(column: str) -> Column:
    c = F.col(column).cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf_of(columns: Sequence[str], replaced: dict[str, Column] | None = None) -> Column:
    """H of the columns' values in order, each `-` if null, else its UTF-8 byte count, `:` and itself; as bytes.

    replaced: another value for some of the columns, a string.
    """
    fields = []
    for c in columns:
        if replaced and c in replaced:
            v = replaced[c]
            fields.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
        else:
            fields.append(_field(c))
    return F.unhex(F.sha2(F.concat(*fields).cast("binary"), 256))


def _hex(raw: pa.Array) -> list[bytes | None]:
    return [None if x is None else x.hex().encode() for x in raw.to_pylist()]


def _blocks(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """((tree, block), rows) of batches sorted by these; a block lies in several batches or one. It has BLOCK rows and a message at most."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(_hex(batch.column(c)) if c in ("digest", "claim") else batch.column(c).to_pylist() for c in ("tree", "block", *columns)), strict=True)

    for name, held in groupby(rows(), key=lambda r: r[:2]):
        yield name, [r[2:] for r in held]


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def ready() -> pa.RecordBatch:
        tree, place, n, raw = zip(*out, strict=True)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(tree, pa.string()), pa.array(place, pa.int64()), pa.array(n, pa.int64()), pa.array(raw, pa.binary())], ["tree", "place", "n", "digest"])

    for (tree, block), held in _blocks(batches, ("n", "digest")):
        n = held[0][0]
        root = sweep_up([d for _, d in held], min(LEVELS, height(n)))[-1][0]
        out.append((tree, block, -(-n // BLOCK), bytes.fromhex(root.decode())))
        if len(out) >= 4096:
            yield ready()
    if out:
        yield ready()


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of nodes by round, and the root of each tree as (tree, place 0, n 1, digest).

    nodes: tree, place from 0, n (nodes of the tree), digest; more columns may follow.
    """
    rounds, longest = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        dealt = rounds[-1].select("tree", F.floor(F.col("place") / BLOCK).alias("block"), "place", "n", "digest")
        dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
        above = stage(dealt.mapInArrow(_up, "tree string, place long, n long, digest binary"))
        longest = -(-longest // BLOCK)
        if longest <= 1:
            return rounds, above
        rounds.append(above)


_PATH = "array<binary>"


def _packed(path: Path) -> list[bytes]:
    return [bytes.fromhex(side.decode()) for pair in path for side in pair]


def _path(sides: list[bytes]) -> Path:
    raw = [s.hex().encode() for s in sides]
    return list(zip(raw[::2], raw[1::2], strict=True))


def _dealt(nodes: DataFrame, messages: DataFrame, more: Sequence[str]) -> DataFrame:
    """Each block's message, then its nodes in order."""
    rows = nodes.select("tree", F.floor(F.col("place") / BLOCK).alias("block"), F.col("place").alias("at"), "n", "digest", *more)
    told = messages.select("tree", F.col("place").alias("block"), F.lit(-1).cast("long").alias("at"), "path", "tops")
    return rows.unionByName(told, allowMissingColumns=True).repartition("tree", "block").sortWithinPartitions("tree", "block", "at")


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (tree, block), held in _blocks(batches, ("n", "digest", "path", "tops")):
        (_, _, sides, tops), rows = held[0], held[1:]
        nodes = sweep_up([r[1] for r in rows], min(LEVELS, height(rows[0][0])))
        paths = [_packed(p) for p in sweep_down(nodes, _path(sides))]
        k = len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([tree] * k, pa.string()), pa.array([block * BLOCK + i for i in range(k)], pa.int64()), pa.array(paths, pa.list_(pa.binary())), pa.array([tops] * k, pa.list_(pa.binary()))],
            ["tree", "place", "path", "tops"],
        )


def descend(rounds: list[DataFrame], messages: DataFrame) -> DataFrame:
    """Messages to the blocks of the lowest round, given those to the trees' roots: (tree, place, path, tops).

    path: digests before and after a node in its run, level by level up to the root; tops: what every node of a tree is told.
    """
    for nodes in reversed(rounds[1:]):
        messages = _dealt(nodes, messages, ()).mapInArrow(_down, f"tree string, place long, path {_PATH}, tops array<binary>")
    return messages


def _proved(with_proofs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _blocks(batches, ("n", "digest", "path", "tops", "id", "claim")):
            (_, _, sides, tops, _, _), rows = held[0], held[1:]
            subroot, root = (t.hex() for t in tops)
            nodes = sweep_up([r[1] for r in rows], min(LEVELS, height(rows[0][0])))
            out: dict[str, list] = {c: [] for c in ("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")}
            proofs = []
            for (_, leaf, _, _, i, claim), path in zip(rows, sweep_down(nodes, _path(sides)), strict=True):
                folded = fold(claim or leaf, path).decode()
                proof = b"".join(side for pair in path for side in pair)
                for c, v in zip(out, (i, leaf.decode(), subroot, root, digest(proof).decode(), folded, folded == root), strict=True):
                    out[c].append(v)
                if with_proofs:
                    proofs.append([side.decode() for pair in path for side in pair])
            arrays = [pa.array(v, pa.int64() if c == "id" else pa.bool_() if c == "verified" else pa.string()) for c, v in out.items()]
            if with_proofs:
                out["proof"] = proofs
                arrays.append(pa.array(proofs, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(arrays, list(out))

    return run


def manifest(leaves: DataFrame, with_proofs: bool = False) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified[, proof]) of every row.

    leaves: tree (string, the group), id (long), leaf (32 bytes) and claim (32
    bytes or null). In a tree leaves ascend by id, null first, then by leaf; while
    several nodes remain, every FANOUT consecutive ones become their digest, the
    last run, however short, too. The trees' roots, null first and then in order of
    their names' bytes, make the last tree. `proof` has, level by level, the
    digests before and after in the run, run together. folded_root is what the
    claim, or else the leaf, and the original siblings give. Rows that are
    repeated are leaves of their own. No rows: no rows.
    """
    leaves = stage(leaves.select("tree", "id", "leaf", "claim"))
    salted = leaves.withColumn("salt", F.monotonically_increasing_id())  # cuts long runs of equal rows, too
    ranked = range_position(salted, ["tree"], [F.asc_nulls_first("id"), F.asc("leaf"), F.asc("claim"), F.asc("salt")], "pos", "n")
    nodes = stage(ranked.select("tree", (F.col("pos") - 1).alias("place"), "n", F.col("leaf").alias("digest"), "id", "claim"))
    rounds, subroots = climb(nodes)
    subroots = stage(subroots)
    tops = range_position(subroots.select(F.col("tree").alias("name"), "digest"), [], [F.asc_nulls_first("name")], "pos", "n")
    tops = stage(tops.select(F.lit("").alias("tree"), (F.col("pos") - 1).alias("place"), "n", "digest", "name"))
    top_rounds, roots = climb(tops)
    start = roots.select("tree", "place", F.array().cast(_PATH).alias("path"), F.array("digest").alias("tops"))
    told = descend(top_rounds, start)
    # the lowest round of the upper tree: one path for each group
    paths = _dealt(tops, told, ()).mapInArrow(_down, f"tree string, place long, path {_PATH}, tops array<binary>")
    named = tops.select("place", "name", F.col("digest").alias("subroot")).join(paths.drop("tree"), "place")
    start = named.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), "path", F.array("subroot", F.get("tops", F.lit(0))).alias("tops"))
    told = descend(rounds, stage(start))
    schema = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _dealt(nodes, told, ("id", "claim")).mapInArrow(_proved(with_proofs), schema + (", proof array<string>" if with_proofs else ""))


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered_documents(docs: DataFrame) -> DataFrame:
    """The leaves of documents, those whose id's crc32 5 divides claimed with the text's A-Z lower-cased. A null id or text is not tampered with."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    claim = F.when(chosen, leaf_of(COLUMNS, {"text": F.translate(F.col("text").cast("string"), UPPER, LOWER)}))
    return docs.select(F.col("source").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("id"), leaf_of(COLUMNS).alias("leaf"), claim.alias("claim"))


#: Levels of the SQL: enough for 16 ** 6 rows of one source.
_SQL_LEVELS = 6


def sql() -> str:
    """The query in DuckDB SQL over the table documents."""
    n = _SQL_LEVELS

    def field(c: str) -> str:
        return f"coalesce(CAST(strlen({c}) AS VARCHAR) || ':' || {c}, '-')"

    def leaf(text: str) -> str:
        others = " || ".join(field(f"CAST({c} AS VARCHAR)") for c in COLUMNS[:-1])
        return f"sha256({others} || {field(text)})"

    bits = "list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, {})"
    crc = f"""xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
        lambda a, x: {bits.format("xor(a, x)")}, CAST(4294967295 AS BIGINT)))"""

    def tree(prefix: str, start: str) -> str:
        """Levels prefix0 .. prefix{n}: (tree, i, d), i from 0; a tree of one node has no more levels."""
        out = [f"{prefix}0 AS MATERIALIZED ({start})"]
        for k in range(n):
            out.append(
                f"""{prefix}{k + 1} AS MATERIALIZED (SELECT tree, i // 16 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d FROM {prefix}{k} a
                WHERE EXISTS (SELECT 1 FROM {prefix}{k} b WHERE b.tree = a.tree AND b.i = 1) GROUP BY tree, i // 16)"""
            )
        return ",\n".join(out)

    def walk(prefix: str, start: str) -> str:
        """walk steps w{prefix}0 .. : (row, tree, i, proof, cur); cur is what the claim has become."""
        out = [f"w{prefix}0 AS MATERIALIZED ({start})"]
        for k in range(n):
            out.append(
                f"""w{prefix}{k + 1} AS MATERIALIZED (SELECT w.r, any_value(w.tree) AS tree, any_value(w.i) // 16 AS i,
                any_value(w.proof) || coalesce(string_agg(s.d, '' ORDER BY s.i) FILTER (WHERE s.i <> w.i), '') AS proof,
                CASE WHEN any_value(m.tree) IS NULL THEN any_value(w.cur)
                     ELSE sha256(string_agg(CASE WHEN s.i = w.i THEN w.cur ELSE s.d END, '' ORDER BY s.i)) END AS cur
                FROM w{prefix}{k} w LEFT JOIN (SELECT DISTINCT tree FROM {prefix}{k} WHERE i = 1) m ON m.tree = w.tree
                LEFT JOIN {prefix}{k} s ON s.tree = w.tree AND s.i // 16 = w.i // 16 AND m.tree IS NOT NULL GROUP BY w.r)"""
            )
        return ",\n".join(out)

    last = f"""(SELECT tree, d FROM (SELECT tree, d, row_number() OVER (PARTITION BY tree ORDER BY k) AS rn FROM (
        {" UNION ALL ".join(f"SELECT tree, d, {k} AS k FROM {{0}}{k} a WHERE i = 0 AND NOT EXISTS (SELECT 1 FROM {{0}}{k} b WHERE b.tree = a.tree AND b.i = 1)" for k in range(n + 1))})) WHERE rn = 1)"""
    return f"""
    WITH leaves AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, coalesce('s' || source, '') AS tree,
        {leaf("text")} AS d, CASE WHEN {crc} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS claim FROM documents),
    placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS i FROM leaves),
    {tree("a", "SELECT tree, i, d FROM placed")},
    subroots AS MATERIALIZED {last.format("a")},
    tops AS MATERIALIZED (SELECT tree, d, row_number() OVER (ORDER BY encode(tree)) - 1 AS i FROM subroots),
    {tree("b", "SELECT 'all' AS tree, i, d FROM tops")},
    roots AS MATERIALIZED {last.format("b")},
    {walk("a", "SELECT r, tree, i, '' AS proof, coalesce(claim, d) AS cur FROM placed")},
    {walk("b", f"SELECT w.r, 'all' AS tree, t.i, w.proof, w.cur FROM wa{n} w JOIN tops t ON t.tree = w.tree")}
    SELECT p.doc_id, p.d AS leaf, s.d AS subroot, q.d AS root, sha256(w.proof) AS proof_sha256, w.cur AS folded_root, w.cur = q.d AS verified
    FROM placed p JOIN wb{n} w ON w.r = p.r JOIN subroots s ON s.tree = p.tree CROSS JOIN roots q"""
