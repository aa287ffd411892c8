"""Secret scan in Spark expressions alone: patterns, and entropy in sliding windows.

Everything is a function of one row's text: nothing is shuffled, and no Python
runs in tasks. A cheap test for each kind keeps texts without a chance from the
pass that finds places.

The entropy method looks at runs of 20 or more characters of one class: hex digits in
lower case, in upper case, and the base64 and URL alphabets. A window of 20
characters moves along a run; counts of its characters, five bits each in a few
numbers, and the sum of n log n over them change only by the character that enters
and the one that leaves. Each class has its own limit: hex digits cannot reach
what base64 reaches. Windows over the limit that touch are one span. The
allow-list is held against the segments between `/`, `_` and `-`: a window that
touches an allowed segment is no secret, whatever stands beside it is.
The work is in proportion to the length of a run.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.llm.common import fresh

WINDOW = 20
#: Pattern, the group that must be long enough, its least length, and a test any match passes.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    "access": (r"AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    "hex": (r"[0-9a-f]+", 0, 32, "[0-9a-f]{32}"),
}
_HEX, _BASE64 = "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-"
#: Kind: the runs of its classes, its characters (hex digits in lower case), and bits per character from which a window is random.
CLASSES = {
    "entropy_hex": (("[0-9a-f]", "[0-9A-F]"), _HEX, 3.01),
    "entropy_base64": (("[A-Za-z0-9+/_-]",), _BASE64, 3.81),
}
#: Runs that are no secrets: without a digit, or of digits alone.
ALLOWED_RUNS = (r"^[^0-9]*$", r"^[0-9]*$")
#: Segments that are no secrets: words, also with a short number behind, digits alone, alphabets in order, one part over and over, placeholders.
ALLOWED = (
    r"^(?:[A-Z]?[a-z]{3,}|[A-Z]{4,})+[0-9]{0,3}$",
    r"^[0-9]+$",
    r"0123456789abcdef|0123456789ABCDEF|(?i:abcdefghijklmnopqrstuvwxyz)",
    r"^(.{1,8}?)\1+.{0,8}$",
    r"(?i:example|placeholder|dummy|changeme|xxxxxx)",
)
#: Counts of a window, in numbers of 64 bits: so many of five bits each.
PACKED, BITS = 12, 5


def _places(text: Column, pattern: str, group: int, least: int, hint: str) -> Column:
    """Array of (start, end, text) of the leftmost non-overlapping matches whose group is long enough."""
    pieces = f"(?s)(.*?)({pattern}|\\z)"
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    found = F.aggregate(
        F.arrays_zip(
            F.regexp_extract_all(text, F.lit(pieces), F.lit(1)).alias("gap"),
            F.regexp_extract_all(text, F.lit(pieces), F.lit(2)).alias("hit"),
            F.regexp_extract_all(text, F.lit(pieces), F.lit(2 + group)).alias("part"),
        ),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
            F.when(
                F.length(x["part"]) >= least,
                F.array_append(a["out"], F.struct((a["at"] + F.length(x["gap"])).alias("start"), (a["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"))),
            )
            .otherwise(a["out"])
            .alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(text.rlike(hint), found).otherwise(none)


def _named(rank: int, kind: str):
    return lambda x: F.struct(x["start"], F.lit(rank).alias("rank"), x["end"], F.lit(kind).alias("kind"))


def _is(kind: str):
    return lambda x: x["kind"] == kind


def _any(text: Column, patterns: Iterable[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(p)
    return found


def _random_parts(run: Column, alphabet: str, limit: float, window: int, allowed: Iterable[str]) -> Column:
    """Array of (start, end) in a run: windows whose entropy exceeds the limit and that touch no allowed segment, joined where they touch."""
    weight = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)])
    # entropy = log2(window) - sum / window, so the sum decides
    most = window * (math.log2(window) - limit)
    words = -(-len(alphabet) // PACKED)
    none = F.array().cast("array<struct<start:int,end:int>>")
    segments = F.split(run, r"(?<=[/_-])|(?=[/_-])")
    flags = F.flatten(F.transform(segments, lambda g: F.array_repeat(_any(g, allowed), F.length(g))))
    # a character's number from 0, and whether it is in an allowed segment; -1 before the run
    symbols = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1)

    def once(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def shifted(n: Column, by: Column) -> Column:
        return F.call_function("shiftleft", n, by)

    def count(a: Column, s: Column) -> Column:
        word = a["w0"]
        for k in range(1, words):
            word = F.when(s >= k * PACKED, a[f"w{k}"]).otherwise(word)
        return F.call_function("shiftright", word, s % PACKED * BITS).bitwiseAND(F.lit((1 << BITS) - 1).cast("bigint")).cast("int")

    def scan(run_symbols: Column, run_flags: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            def moved(p: Column, q: Column) -> Column:
                gain = F.get(weight, q["had"] + 1) - F.get(weight, q["had"])
                loss = F.when(p["leaves"] >= 0, F.get(weight, q["left"]) - F.get(weight, q["left"] - 1)).otherwise(0.0)
                total = a["sum"] + gain - loss
                clear = F.when(F.get(run_flags, i), 0).otherwise(a["clear"] + 1)
                hot = (clear >= window) & (total < most)
                joined = hot & (a["end"] >= i + 1 - window)
                closes = hot & ~joined & (a["end"] > 0)
                one = F.lit(1).cast("bigint")
                packed = []
                for k in range(words):
                    enters = F.when(F.floor(p["enters"] / PACKED) == k, shifted(one, p["enters"] % PACKED * BITS)).otherwise(0)
                    leaves = F.when((p["leaves"] >= 0) & (F.floor(p["leaves"] / PACKED) == k), shifted(one, p["leaves"] % PACKED * BITS)).otherwise(0)
                    packed.append((a[f"w{k}"] + enters - leaves).alias(f"w{k}"))
                return F.struct(
                    *packed,
                    total.alias("sum"),
                    clear.alias("clear"),
                    F.when(hot & ~joined, i + 1 - window).otherwise(a["start"]).alias("start"),
                    F.when(hot, i + 1).otherwise(a["end"]).alias("end"),
                    F.when(closes, F.array_append(a["out"], F.struct(a["start"].alias("start"), a["end"].alias("end")))).otherwise(a["out"]).alias("out"),
                )

            leaving = F.when(i >= window, F.get(run_symbols, i - window)).otherwise(-1)
            pair = F.struct(F.get(run_symbols, i).alias("enters"), leaving.alias("leaves"))

            def with_counts(p: Column) -> Column:
                left = F.when(p["leaves"] >= 0, count(a, p["leaves"]) + (p["enters"] == p["leaves"]).cast("int"))
                return once(F.struct(count(a, p["enters"]).alias("had"), left.alias("left")), lambda q: moved(p, q))

            return once(pair, with_counts)

        zero = F.struct(
            *[F.lit(0).cast("bigint").alias(f"w{k}") for k in range(words)], F.lit(0.0).alias("sum"), F.lit(0).alias("clear"), F.lit(0).alias("start"), F.lit(0).alias("end"), none.alias("out")
        )
        last = lambda a: F.when(a["end"] > 0, F.array_append(a["out"], F.struct(a["start"].alias("start"), a["end"].alias("end")))).otherwise(a["out"])
        return F.aggregate(F.sequence(F.lit(0), F.size(run_symbols) - 1), zero, step, last)

    # looked up once for a run, not once for a character
    return once(F.struct(symbols.alias("s"), flags.alias("f")), lambda x: scan(x["s"], x["f"]))


def spans(text: Column, window: int = WINDOW, allowed: Iterable[str] = ALLOWED) -> Column:
    """Array of (start, rank, end, kind) by start, then kind as listed; code points, end exclusive. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    shape = "array<struct<start:int,rank:int,end:int,kind:string>>"
    parts = []
    for rank, (kind, (pattern, group, least, hint)) in enumerate(BASE.items()):
        parts.append(F.transform(_places(text, pattern, group, least, hint), _named(rank, kind)))

    def random_spans(rank: int, kind: str):
        _, alphabet, limit = CLASSES[kind]

        def of(x: Column) -> Column:
            hit = F.lower(x["hit"]) if alphabet == _HEX else x["hit"]
            named = F.transform(
                _random_parts(hit, alphabet, limit, window, allowed),
                lambda y: F.struct((x["start"] + y["start"]).alias("start"), F.lit(rank).alias("rank"), (x["start"] + y["end"]).alias("end"), F.lit(kind).alias("kind")),
            )
            return F.when(_any(x["hit"], ALLOWED_RUNS), F.array().cast(shape)).otherwise(named.cast(shape))

        return of

    for rank, (kind, (classes, _, _)) in enumerate(CLASSES.items(), len(BASE)):
        for characters in classes:
            runs = _places(text, f"{characters}{{{window},}}+", 0, window, f"{characters}{{{window}}}")
            parts.append(F.flatten(F.transform(runs, random_spans(rank, kind))))
    return F.array_sort(F.concat(*[p.cast(shape) for p in parts]))


def written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, found) of every row: all spans of its whole text, base kinds and entropy kinds. Null text counts as empty."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), spans(F.col(text_column).cast("string")).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts per base kind, the hash of the base spans, and all spans in writing."""
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    counts = [F.size(F.filter("found", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return scanned.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]", text_column: str = "text") -> DataFrame:
    """The rows with every span of the text replaced by the mark; spans that overlap or touch get one. Null texts stay null."""
    text = F.col(text_column)
    none = F.array().cast("array<struct<start:int,end:int>>")

    def join(a: Column, x: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        longer = F.array_append(F.slice(a, F.lit(1), F.size(a) - 1), F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end")))
        return F.when(F.coalesce(last["end"] >= x["start"], F.lit(False)), longer).otherwise(F.array_append(a, F.struct(x["start"].alias("start"), x["end"].alias("end"))))

    name = fresh(docs, "__spans")
    found = docs.withColumn(name, F.aggregate(spans(text), none, join))
    merged = F.col(name)
    before = F.concat(F.array(F.lit(0)), F.transform(merged, lambda x: x["end"]))
    kept = F.transform(merged, lambda x, i: F.substring(text, F.get(before, i) + 1, x["start"] - F.get(before, i)))
    tail = F.substring(text, F.get(before, F.size(merged)) + 1, F.length(text))
    new = F.when(F.size(merged) > 0, F.concat(F.array_join(F.transform(kept, lambda x: F.concat(x, F.lit(mark))), ""), tail)).otherwise(text)
    return found.withColumn(text_column, new).drop(name)
