"""Quality rules, lines first: lines that fail a rule go, then documents that lose too much text.

A line is judged on its own, by what a line of prose does not have: words that
run into repeated marks, or a long line in which no sentence ends (punctuation);
columns of a menu, or a menu's entry alone (navigation); notices that pages carry
around their text (boilerplate). A document is kept if it passes the base
rules on its whole text, and enough of it is left.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.llm.common import arrow_map, slices

SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
#: Words in a window that counts as repeated when it stands in a text twice.
WINDOW = 5
MIN_WORDS = 10
#: Percent of words in repeated windows; percent of a document's word characters that must be left.
MAX_REPEATED = 20
MIN_LEFT = 50
#: A line fails if every so many words carry a run of marks, or if it is this long and no sentence ends in it.
WORDS_A_RUN = 4
LONG_LINE = 400
#: A line fails with this many separators, if there is one for every so many words.
SEPARATORS = 2
WORDS_A_SEPARATOR = 4

RUN_OF_MARKS = "[!?#*$%&=_~^<>]{2,}"
ENDING = "[.!?…。！？]"
SEPARATOR = "[|•·›»→]"
MENU = (
    "about", "about us", "back to top", "contact", "contact us", "help", "home", "log in", "login", "menu", "next", "next page", "previous",
    "previous page", "read more", "register", "search", "share", "sign in", "sign up", "sitemap", "skip to content",
)
NOTICES = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "follow us on", "lorem ipsum", "powered by",
    "privacy policy", "sign up for our newsletter", "subscribe to our", "terms of service", "terms of use", "use of cookies", "we use cookies",
)
REASONS = ("punctuation", "navigation", "boilerplate")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found twice or more, the first one's included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    # ranks of runs of k words make those of k + step, exactly: equal ranks are equal runs
    ranks = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    k = 1
    while k < window:
        step = min(k, window - k)
        pairs = ranks[: len(ranks) - step] * len(words) + ranks[step:]
        ranks = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        k += step
    often = np.bincount(ranks)[ranks] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + window, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


@dataclass(frozen=True)
class Base:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEATED * self.n_words


def word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, _BLANKS))


def base(text: str) -> Base:
    raw = text.encode()
    words = raw.split()  # bytes part at the blanks of ASCII and at nothing else
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return Base(len(words), word_chars(text), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


class Lines:
    def __init__(self):
        self.run = re.compile(RUN_OF_MARKS)
        self.ending = re.compile(ENDING)
        self.separator = re.compile(SEPARATOR)
        self.notice = re.compile("|".join(NOTICES))
        self.menu = frozenset(MENU)

    def fault(self, line: str) -> str | None:
        """Why a line with a word goes."""
        n = len(line.encode().split())
        trimmed = line.strip(_BLANKS)
        if len(self.run.findall(line)) * WORDS_A_RUN >= n or (len(line) >= LONG_LINE and not self.ending.search(line)):
            return "punctuation"
        low = trimmed.translate(_LOWER)
        separators = len(self.separator.findall(line))
        if (separators >= SEPARATORS and separators * WORDS_A_SEPARATOR >= n) or low in self.menu:
            return "navigation"
        if self.notice.search(low):
            return "boilerplate"
        return None

    def clean(self, text: str) -> tuple[str, dict[str, int]]:
        """The text without the lines that fail, and how many went by reason. Lines without a word stay."""
        gone = dict.fromkeys(REASONS, 0)
        stay = []
        for line in text.split("\n"):
            why = self.fault(line) if line.strip(_BLANKS) else None
            if why:
                gone[why] += 1
            else:
                stay.append(line)
        return "\n".join(stay), gone


def clean_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_punctuation, n_navigation,
    n_boilerplate, chars_left, kept, cleaned) of every row, repeats included.

    cleaned is the text without the lines that fail; kept is false where the base
    rules fail, or where less than MIN_LEFT percent of the word characters are
    left. A null text counts as empty: it has no words and fails. Other columns
    are not read. A text is held whole by its task; all else is in proportion to it.
    """

    def work(batch):
        lines = Lines()
        for part in slices(batch, "t"):
            out = {c: [] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *(f"n_{r}" for r in REASONS), "chars_left", "kept", "cleaned")}
            for text in part.column("t").to_pylist():
                text = text or ""
                b = base(text)
                cleaned, gone = lines.clean(text)
                left = word_chars(cleaned)
                kept = not b.failed and 100 * left >= MIN_LEFT * b.word_chars
                for c, v in zip(out, (b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.failed, *gone.values(), left, kept, cleaned), strict=True):
                    out[c].append(v)
            yield {"doc_id": part.column("i"), **out}

    rows = docs.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).cast("string").alias("t"))
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    reasons = ", ".join(f"n_{r} long" for r in REASONS)
    return arrow_map(rows, work, f"doc_id long, {counts}, base_failed boolean, {reasons}, chars_left long, kept boolean, cleaned string")


def sql() -> str:
    """The query in DuckDB SQL over the table documents."""
    word = r"[^\x20\x09-\x0D]+"
    menu = ", ".join(f"'{m}'" for m in MENU)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
    WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    cut AS MATERIALIZED (SELECT r, regexp_extract_all(text, '{word}') AS w FROM docs),
    windows AS (
      SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS i, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS s
      FROM cut WHERE len(w) >= {WINDOW}),
    often AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM windows),
    repeats AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS k FROM often WHERE n > 1) GROUP BY r),
    lines AS (
      SELECT r, line, len(regexp_extract_all(line, '{word}')) AS n, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed
      FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)),
    sized AS (
      SELECT r, line, n, trimmed, len(regexp_extract_all(line, '{SEPARATOR}')) AS seps, translate(trimmed, '{upper}', '{lower}') AS low,
        coalesce(list_sum(list_transform(regexp_extract_all(line, '{word}'), lambda x: length(x))), 0) AS chars,
        len(regexp_extract_all(line, '{RUN_OF_MARKS}')) AS runs FROM lines WHERE n > 0),
    judged AS (
      SELECT r, line, chars, CASE
          WHEN runs * {WORDS_A_RUN} >= n OR (length(line) >= {LONG_LINE} AND NOT regexp_matches(line, '{ENDING}')) THEN 'punctuation'
          WHEN (seps >= {SEPARATORS} AND seps * {WORDS_A_SEPARATOR} >= n) OR low IN ({menu}) THEN 'navigation'
          WHEN regexp_matches(low, '{"|".join(NOTICES)}') THEN 'boilerplate' END AS why FROM sized),
    of_lines AS (
      SELECT r, count(*) - count(DISTINCT line) AS dup, sum(chars) AS chars, coalesce(sum(chars) FILTER (WHERE why IS NULL), 0) AS chars_left,
        {", ".join(f"count(*) FILTER (WHERE why = '{x}') AS n_{x}" for x in REASONS)} FROM judged GROUP BY r),
    whole AS (
      SELECT doc_id, len(w) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[{SYMBOLS}]')) AS n_symbols,
        coalesce(dup, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, CAST(coalesce(chars_left, 0) AS BIGINT) AS chars_left,
        {", ".join(f"coalesce(n_{x}, 0) AS n_{x}" for x in REASONS)}
      FROM docs JOIN cut USING (r) LEFT JOIN of_lines USING (r) LEFT JOIN repeats p USING (r))
    SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
      NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND 100 * chars_left >= {MIN_LEFT} * word_chars AS kept FROM whole"""
