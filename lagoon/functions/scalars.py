"""Scalar rules as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tile colours, in palette order.
PALETTE = ["#9fd9d3", "#FFB5A7", "#FFD700", "#bfdde6", "#4FC3D9", "#4ADE80", "#FF8C69"]
# Rank colours for places 1 to 3; every later place has the second one.
MEDALS = ["#FFD700", "#8fa8b5", "#c98b4a"]
# Presence text and dot colours, active then idle.
PRESENCE_TEXT = ("#1e8a4a", "#5b7484")
PRESENCE_DOT = ("#4ADE80", "#b9cdd8")

NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*\z"


def avatar_colour(seed: Column) -> Column:
    """Palette entry chosen by the sum of character codes."""
    code = lambda ch: F.ascii(ch)
    unit = lambda c: F.when(c > 65535, 55296 + F.shiftright(c - 65536, 10)).otherwise(c)
    total = F.aggregate(
        F.split(seed, ""), F.lit(0).cast("bigint"), lambda acc, ch: acc + unit(code(ch)).cast("bigint")
    )
    colours = F.array(*[F.lit(c) for c in PALETTE])
    return F.element_at(colours, (total % len(PALETTE) + 1).cast("int"))


def initial_of(name: Column) -> Column:
    return F.upper(F.substring(name, 1, 1))


def whole_hours(minutes: Column) -> Column:
    return F.floor(minutes / F.lit(60)).cast("bigint")


def hours_minutes(minutes: Column) -> Column:
    return F.concat(whole_hours(minutes).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m"))


def medal_colour(rank: Column) -> Column:
    out = F.when(rank == 1, MEDALS[0]).when(rank == 3, MEDALS[2])
    return out.otherwise(MEDALS[1])


def idle_millis(last_seen: Column, as_of: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", last_seen, as_of)


def is_active(last_seen: Column, as_of: Column) -> Column:
    return idle_millis(last_seen, as_of) < 5 * 60_000


def presence(last_seen: Column, as_of: Column) -> Column:
    """"Active now" within five minutes, else the idle time in its largest whole unit."""
    minutes = F.floor(idle_millis(last_seen, as_of) / F.lit(60_000)).cast("bigint")
    hours = F.floor(minutes / F.lit(60)).cast("bigint")
    days = F.floor(hours / F.lit(24)).cast("bigint")
    ago = (
        F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(days.cast("string"), F.lit("d ago")))
    )
    return F.when(is_active(last_seen, as_of), F.lit("Active now")).otherwise(F.concat(F.lit("Last seen "), ago))


def presence_text_colour(last_seen: Column, as_of: Column) -> Column:
    return F.when(is_active(last_seen, as_of), PRESENCE_TEXT[0]).otherwise(PRESENCE_TEXT[1])


def presence_dot_colour(last_seen: Column, as_of: Column) -> Column:
    return F.when(is_active(last_seen, as_of), PRESENCE_DOT[0]).otherwise(PRESENCE_DOT[1])


def parse_number(text: Column) -> Column:
    """Untrusted text to a finite double, else null (no suffixes, no NaN, no infinities)."""
    value = F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def clamp_minutes(text: Column) -> Column:
    """Minutes in [0, 120]; anything that is not a number counts as 0."""
    endless = F.trim(text).rlike(r"^[+]?Infinity\z")
    return F.when(endless, F.lit(120.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(120.0), F.coalesce(parse_number(text), F.lit(0.0))))
    )


def round_half_up(value: Column) -> Column:
    """Halves go up; null for what no int holds."""
    return F.when(F.abs(value) < F.lit(2.0**31 - 1), F.floor(value + F.lit(0.5))).cast("int")


def cap_text(text: Column, units: int = 500) -> Column:
    """The first `units` UTF-16 units; a character that would be cut in half is left out."""
    units16 = F.encode(text, "UTF-16BE")
    split_pair = F.hex(F.substring(units16, 2 * units - 1, 1)).between("D8", "DB")
    cut = F.substring(units16, F.lit(1), F.when(split_pair, 2 * units - 2).otherwise(2 * units))
    # Without characters beyond the basic plane, units and characters coincide.
    wide = F.octet_length(units16) > 2 * F.char_length(text)
    return F.when(wide, F.decode(cut, "UTF-16BE")).otherwise(F.substring(text, 1, units))


def expires_after(start: Column, days: int = 0, hours: int = 0) -> Column:
    return start + F.make_dt_interval(F.lit(days), F.lit(hours))


def session_expiry(start: Column) -> Column:
    return expires_after(start, days=365)


def link_expiry(start: Column) -> Column:
    return expires_after(start, hours=24)


def minted_id(prefix: str, *natural_key: Column, length: int = 32) -> Column:
    """An id derived from the row's natural key, so a retried job mints the same one.

    128 bits of the hash of the key's parts, each with its length before it and a
    dash for null, so that different keys are never the same text.
    """
    parts = [c.cast("string") for c in natural_key]
    key = F.concat(*[F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, length))


def verified_flag(raw: Column) -> Column:
    """True for JSON true or the text "true" only."""
    return F.coalesce(raw == "true", F.lit(False))


def api_names(df: DataFrame) -> DataFrame:
    """Columns renamed from snake_case to the camelCase of the documents."""
    camel = lambda c: c.split("_")[0] + "".join(w.capitalize() for w in c.split("_")[1:])
    return df.select(*[F.col(c).alias(camel(c)) for c in df.columns])
