"""URL filter: rules on hosts and paths first, then a weighted vocabulary.

An Aho-Corasick automaton finds all vocabulary terms of a URL in one pass. A hit
counts where neither neighbour is a letter or digit of ASCII. A strict term
weighs as much as the limit, a soft one less; a URL is rejected when the weights
of its distinct terms reach the limit: one strict term, or several soft ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.llm.common import arrow_map

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LIMIT = 2
STRICT = ("adult", "casino", "escort", "hentai", "malware", "nude", "phishing", "porn", "viagra", "warez", "xxx")
SOFT = (
    "ads", "bet", "bets", "bonus", "cam", "cheap", "click", "dating", "farm", "free", "jackpot", "loan", "loans", "lottery",
    "pills", "poker", "popup", "sex", "slots", "spam", "track", "tracker", "win",
)
WEIGHTS: dict[str, int] = {**dict.fromkeys(STRICT, LIMIT), **dict.fromkeys(SOFT, 1)}


@dataclass(frozen=True)
class Rule:
    """Fits a host, all its subdomains, and paths that start with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*+", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*+([^?#]*+)", 1), F.lit(""))


def first_rule(host: Column, path: Column, rules: Iterable[Rule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, null if none does; of equally long ones the first by name."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def term_hits(text: str, automaton: ahocorasick.Automaton) -> set[str]:
    """Distinct terms with a boundary on both sides; text is lower-cased already."""

    def inside(i: int) -> bool:
        return 0 <= i < len(text) and text[i].isascii() and text[i].isalnum()

    return {term for end, term in automaton.iter(text) if not inside(end + 1) and not inside(end - len(term))}


def filter_urls(
    pages: DataFrame,
    rules: Iterable[Rule] = RULES,
    weights: Mapping[str, int] = WEIGHTS,
    limit: int = LIMIT,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, terms) of every row, repeats included.

    verdict: the rule's, or else block where the distinct terms' weights reach
    `limit` and allow otherwise. A null url has no host, path, rule or term and is
    allowed. Other columns are not read, whatever their names. rules and weights
    are configuration the caller holds, sent to the tasks whole.
    """
    weights = dict(weights)
    lower = str.maketrans(UPPER, LOWER)

    def work(batch):
        automaton = ahocorasick.Automaton()
        for term in weights:
            automaton.add_word(term, term)
        automaton.make_automaton()
        urls = batch.column("u").to_pylist()
        terms = [sorted(term_hits(u.translate(lower), automaton)) if u and weights else [] for u in urls]
        yield {"page_id": batch.column("i"), "u": batch.column("u"), "terms": terms, "score": [sum(weights[t] for t in x) for x in terms]}

    rows = pages.select(F.col(id_column).cast("long").alias("i"), F.col(url_column).cast("string").alias("u"))
    found = arrow_map(rows, work, "page_id long, u string, terms array<string>, score long")
    found = found.select("page_id", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"), "score", "terms")
    rule, verdict = first_rule(F.col("host"), F.col("path"), rules)
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= limit, "block").otherwise("allow")).alias("verdict"), "score", "terms")


def sql(rules: Iterable[Rule] = RULES, weights: Mapping[str, int] = WEIGHTS, limit: int = LIMIT) -> str:
    """The query's columns in DuckDB SQL over the table pages."""
    whens, verdicts = [], []
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
        whens.append(f"WHEN {fits} THEN '{r.name}'")
        verdicts.append(f"WHEN {fits} THEN '{r.verdict}'")
    score = " + ".join(f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])') THEN {w} ELSE 0 END" for t, w in weights.items())
    return f"""
    WITH cut AS (
      SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
        CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (
      SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    scored AS (SELECT *, {score} AS score FROM parts)
    SELECT page_id, host, path, CASE {" ".join(whens)} END AS rule,
      CASE {" ".join(verdicts)} WHEN score >= {limit} THEN 'block' ELSE 'allow' END AS verdict,
      CAST(score AS BIGINT) AS score FROM scored"""
