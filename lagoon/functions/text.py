"""Text rules for names, nicknames and addresses: ordered, named reasons (null = fine)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lagoon.functions.moderation import DEFAULT_LEXICON, Lexicon, is_blocked_name

# White space (Unicode's plus U+FEFF, without U+0085), shapes of names, nicknames and addresses, and the longest address.
SPACE = r"[\s\x{FEFF}&&[^\x{85}]]"
NAME_SHAPE = r"\A[\p{L}\p{N} ._-]{2,20}\z"
NICKNAME_SHAPE = r"\A[\p{L}\p{N} ._-]{1,16}\z"
EMAIL_SHAPE = (
    r"(?U)\A[\S\x{85}&&[^\x{FEFF}@]]+@[\S\x{85}&&[^\x{FEFF}@.]]+(?:\.[\S\x{85}&&[^\x{FEFF}@.]]+)+\z"
)
MAX_EMAIL = 254


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / F.lit(2)).cast("int")


def _problem(text: Column, low: int, high: int, shape: str, lexicon: Lexicon) -> Column:
    size = utf16_length(text)
    return (
        F.when(text.isNull() | (size < low), "too short")
        .when(size > high, "too long")
        .when(~text.rlike(shape), "bad characters")
        .when(is_blocked_name(text, lexicon), "blocked")
    )


def name_problem(name: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    return _problem(name, 2, 20, NAME_SHAPE, lexicon)


def nickname_problem(nickname: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    return _problem(nickname, 1, 16, NICKNAME_SHAPE, lexicon)


def normalise_email(email: Column) -> Column:
    return F.lower(trim_all(email))


def email_problem(email: Column) -> Column:
    return (
        F.when(F.coalesce(email, F.lit("")) == "", "missing")
        .when(utf16_length(email) > MAX_EMAIL, "too long")
        .when(~email.rlike(EMAIL_SHAPE), "bad shape")
    )
