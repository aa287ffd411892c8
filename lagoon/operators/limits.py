"""Request budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.plans.skew import running_sums

GLOBAL_LIMIT, STRICT_LIMIT, WINDOW = 300, 30, "15 minutes"
# What is never throttled, and what shares the strict budget.
EXEMPT = ["/api/health"]
STRICT = [
    ("GET", "/api/name-check"), ("POST", "/api/auth/signup"), ("POST", "/api/auth/login"), ("POST", "/api/auth/apple"),
    ("POST", "/api/auth/verify/resend"), ("PATCH", "/api/me/name"), ("POST", "/api/blocks"), ("POST", "/api/friends"),
]


def is_exempt(exempt: list[str] | Column = EXEMPT) -> Column:
    return exempt if isinstance(exempt, Column) else F.coalesce(F.col("path").isin(exempt), F.lit(False))


def is_strict(strict: list[tuple[str, str]] | Column = STRICT) -> Column:
    """By method and path: reading a list is not strict where adding to it is."""
    if isinstance(strict, Column):
        return strict
    calls = [f"{method} {path}" for method, path in strict]
    return F.coalesce(F.concat(F.upper("method"), F.lit(" "), "path").isin(calls), F.lit(False))


def throttle_decisions(
    log: DataFrame,
    window: str = WINDOW,
    limit: int = GLOBAL_LIMIT,
    strict_limit: int = STRICT_LIMIT,
    strict: list[tuple[str, str]] | Column = STRICT,
    exempt: list[str] | Column = EXEMPT,
    key: str = "limit_key",
) -> DataFrame:
    """log(request_id, ts, limit_key, method, path) with `decision`: admitted, throttled, or throttled strictly.

    Throttled calls still count. All strict calls share one budget, and calls
    refused globally never reach it: those admitted globally are the first ones
    of their window, so one pass counts both budgets. Windows are aligned to the
    epoch and counted second by second.
    """
    free, tight = is_exempt(exempt), is_strict(strict)
    counts = ~free
    counted = running_sums(
        log.withColumn("_window", F.window("ts", window).start),
        [key, "_window"],
        [F.asc("ts"), F.asc("request_id")],
        F.date_trunc("second", "ts"),
        {"_nth": counts.cast("int"), "_strict_nth": (counts & tight).cast("int")},
    )
    decision = (
        F.when(free, "admitted")
        .when(F.col("_nth") > limit, "throttled")
        .when(tight & (F.col("_strict_nth") > strict_limit), "throttled strictly")
        .otherwise("admitted")
    )
    return counted.select(*log.columns, decision.alias("decision"))


def budget_counts(strict: list[tuple[str, str]] | Column = STRICT, exempt: list[str] | Column = EXEMPT) -> list[Column]:
    """Aggregates of a log: calls that count, and the strict ones among them."""
    counts = ~is_exempt(exempt)
    return [F.count_if(counts).alias("calls"), F.count_if(counts & is_strict(strict)).alias("strict_calls")]


def budget_violations(
    log: DataFrame,
    window: str = WINDOW,
    limit: int = GLOBAL_LIMIT,
    strict_limit: int = STRICT_LIMIT,
    strict: list[tuple[str, str]] | Column = STRICT,
    exempt: list[str] | Column = EXEMPT,
    key: str = "limit_key",
) -> DataFrame:
    """(key, window) groups over either budget; a plain partial aggregate. Exempt calls count in neither.

    strict_calls counts calls refused globally, too: such a window is over budget anyway.
    """
    return (
        log.groupBy(key, F.window("ts", window).alias("w"))
        .agg(*budget_counts(strict, exempt))
        .filter((F.col("calls") > limit) | (F.col("strict_calls") > strict_limit))
        .select(key, F.col("w.start").alias("window_start"), "calls", "strict_calls")
    )
