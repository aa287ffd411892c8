import base64
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lagoon.functions import moderation as mod
from lagoon.functions import scalars as sc
from lagoon.functions import text as tx
from lagoon.functions import tokens as tk


def values(spark, items, column, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x"))).collect()]


MILD = mod.Lexicon(anywhere=("grump", "14odd", "mess"), exact=("sly", "2000", "yak"), safe=("message", "grumpet"))
CASES = [
    ("Grump", True, "plain"), ("6rump", False, "not a folded digit"), ("m3ss", True, "folded"), ("m.e_s-s", True, "separated"),
    ("MESS", True, "upper case"), ("grrrrump", True, "stretched"), ("meeeess", True, "stretched vowel"),
    ("gr ump", True, "joined words"), ("sly", True, "exact word"), ("a sly fox", True, "exact among others"),
    ("slyly", False, "exact inside a word"), ("s.l.y", True, "exact once collapsed"), ("5ly", True, "exact once folded"),
    ("Message", False, "exempt"), ("message mess", True, "exempt does not cover a neighbour"),
    ("messagemess", True, "longer than the exempt word"), ("grumpet", False, "exempt"), ("2000", True, "digits need the raw text"),
    ("yak2000", False, "not whole"), ("海の人", False, "other scripts"), ("", False, "empty"), ("14odd", False, "unreachable term"),
]


def test_moderation_tiers(spark):
    got = values(spark, [c[0] for c in CASES], lambda c: mod.is_blocked_name(c, MILD))
    assert [(c[0], g) for c, g in zip(CASES, got)] == [(c[0], c[1]) for c in CASES]


def test_twenty_thousand_terms(spark):
    """Against the rule in plain Python; at no letter more branches than there are letters."""
    rnd = random.Random(8)
    word = lambda low, high: "".join(rnd.choice("bcdfghjklmnpqrtuvwxyz-+") for _ in range(rnd.randint(low, high)))
    lexicon = mod.Lexicon(tuple(word(5, 9) for _ in range(20_000)), tuple(word(3, 5) for _ in range(2_000)), tuple(word(4, 8) for _ in range(500)))
    pattern = mod.prefix_pattern(lexicon.anywhere)
    widest = 0
    branches = [1]
    for c in pattern.replace("(?:", "(").replace("\\", ""):
        if c == "(":
            branches.append(1)
        elif c == ")":
            branches.pop()
        elif c == "|":
            branches[-1] += 1
            widest = max(widest, branches[-1])
    assert len(branches) == 1 and 20 <= widest <= 24
    pick = lambda terms: rnd.choice(terms)
    names = [rnd.choice([lambda: word(4, 12), lambda: pick(lexicon.exact), lambda: f"a {pick(lexicon.exact)}", lambda: f"q{pick(lexicon.anywhere)}e", lambda: pick(lexicon.safe), lambda: f"{pick(lexicon.safe)} {pick(lexicon.anywhere)}"])() for _ in range(1500)]

    def plain(name):
        words = [w for w in re.split("[ ._-]+", name) if w]
        joined = "".join(w for w in words if w not in lexicon.safe)
        squeezed = re.sub(r"(.)\1{2,}", r"\1", joined)
        if any(t in joined or t in squeezed for t in lexicon.anywhere):
            return True
        return "".join(words) in lexicon.exact or any(w in lexicon.exact for w in words)

    got = values(spark, names, lambda c: mod.is_blocked_name(c, lexicon))
    want = [plain(n) for n in names]
    assert got == want and 0.2 < sum(want) / len(want) < 0.9


def test_prefix_patterns():
    for terms, pattern in ((["ab", "abc", "ad"], "a[bd]"), (["x"], "x"), (["a.c", "b", "a.d", "a.de"], "(?:b|a\\.[cd])"), (["ab", "cd"], "(?:ab|cd)")):
        assert mod.prefix_pattern(terms) == pattern


def test_lexicon_from_table_and_unreachable_terms(spark):
    rows = [(t, "anywhere") for t in MILD.anywhere] + [(t, "exact") for t in MILD.exact] + [(t, "safe") for t in MILD.safe]
    loaded = mod.Lexicon.from_table(spark.createDataFrame(rows, "term string, tier string"))
    assert {*loaded.anywhere} == {*MILD.anywhere} and {*loaded.safe} == {*MILD.safe}
    assert loaded.unreachable() == ["14odd"]
    assert mod.DEFAULT_LEXICON.unreachable() == ["14words"]


def test_default_lexicon_keeps_real_names(spark):
    fine = ["Cassandra", "Dickson", "Hitchcock", "Scunthorpe", "Titan", "Cumbria", "Assisi", "Adolfo", "Stalingrad", "Canal Diver",
            "Grape", "Sussex", "Therapist", "Jeff", "deep_blue", "ocean.kid", "Marina-77"]
    assert not any(values(spark, fine, mod.is_blocked_name))


def test_names_and_nicknames(spark):
    names = ["Jo", "J", "x" * 20, "x" * 21, "a/b", "ab\n", "😀😀", None, "Ångström 7"]
    assert values(spark, names, tx.name_problem) == [
        None, "too short", None, "too long", "bad characters", "bad characters", "bad characters", "too short", None]
    assert values(spark, ["X", "", "x" * 17], tx.nickname_problem) == [None, "too short", "too long"]


def test_trim_covers_unicode_blanks(spark):
    assert values(spark, ["  a﻿", "　b\n", "\u0085c"], tx.trim_all) == ["a", "b", "\u0085c"]


@pytest.mark.parametrize("mail", ["a@b.co", "diver@example.com", "first.last+tag@sub.domain.co.uk", "o'brien@example.ie"])
def test_good_addresses(spark, mail):
    assert values(spark, [mail], tx.email_problem) == [None]


def test_bad_addresses(spark):
    bad = ["", "diver", "diver@", "@example.com", "diver@example", "a b@example.com", "a@b c.com", "a" * 254 + "@example.com"]
    assert all(values(spark, bad, tx.email_problem))
    assert values(spark, ["  Diver@Example.COM "], tx.normalise_email) == ["diver@example.com"]


def test_bearer(spark):
    heads = ["Bearer abc123", "bearer abc123", "  Bearer   abc123  ", None, "", "abc123", "Basic abc123", "Bearer a b"]
    assert values(spark, heads, tk.bearer_token) == ["abc123"] * 3 + [None] * 5


def seg(o):
    return base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")


def token(head=None, **claims):
    body = {"iss": "i", "aud": "app", "sub": "s", "email": "a@b.co", "email_verified": "true", "exp": 4e9, **claims}
    return f"{seg({'alg': 'RS256', 'kid': 'k', **(head or {})})}.{seg({k: v for k, v in body.items() if v is not None})}.sig"


def test_identity_claims(spark):
    cases = [
        (token(), None), (token(aud=["x", "app"]), None), (token(aud=["x"]), "wrong audience"), (token(aud="x"), "wrong audience"),
        (token({"alg": "none"}), "wrong algorithm"), (token({"kid": ""}), "no key id"), (token(iss="z"), "wrong issuer"),
        (token(exp=1), "expired"), (token(exp=None), "expired"), (token(sub=None), "no subject"), (token(sub=5), "no subject"),
        ("a.b", "malformed"), ("!!.??.x", "malformed"), (None, "malformed"),
    ]
    as_of = F.lit("2024-01-01").cast("timestamp")
    got = values(spark, [c[0] for c in cases], lambda c: tk.identity_claims(c, "i", "app", as_of))
    assert [g.reason for g in got] == [c[1] for c in cases]
    flags = [token(email_verified=v) for v in (True, "true", False, "false", None, 1)]
    got = values(spark, flags, lambda c: tk.identity_claims(c, "i", "app", as_of))
    assert [g.email_verified for g in got] == [True, True, False, False, False, False]


def test_minutes_and_rounding(spark):
    texts = ["12", "12.5", " 7 ", "abc", "1d", "-5", "500", "Infinity", "NaN", "1e2", None]
    assert values(spark, texts, sc.clamp_minutes) == [12, 12.5, 7, 0, 0, 0, 120, 120, 0, 100, 0]
    assert values(spark, [0.5, 1.4999, 2.5], sc.round_half_up, "double") == [1, 1, 3]


def test_capped_text_counts_utf16(spark):
    texts = ["a" * 600, "😀" * 300, "b" + "😀" * 300]
    assert [len(x) for x in values(spark, texts, lambda c: sc.cap_text(c, 500))] == [500, 250, 250]


def test_presence(spark):
    as_of = F.lit("2024-01-02 00:00:00").cast("timestamp")
    seen = ["2024-01-01 23:55:00.001", "2024-01-01 23:55:00", "2024-01-01 23:00:00", "2024-01-01 00:00:00", "2023-12-30 00:00:00"]
    assert values(spark, seen, lambda c: sc.presence(c.cast("timestamp"), as_of)) == [
        "Active now", "Last seen 5m ago", "Last seen 1h ago", "Last seen 1d ago", "Last seen 3d ago"]
