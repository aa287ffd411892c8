"""Two-tier name moderation as native expressions.

A lexicon has two strengths: `anywhere` terms reject as substrings, `exact`
terms only as a whole word or as the whole name. `safe` words are taken out
before the substring pass. A name is split into words once; whole words are looked
up in hash sets, and substrings are sought by one pattern that shares the terms'
beginnings, a prefix tree. At each letter it has as many branches as the alphabet at
most, so a row costs the same whatever the lexicon's length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters read as letters, position by position.
FOLD_FROM, FOLD_TO = "013457@$", "oieastas"

# The default lexicon (a compliance word list, not prose).
ANYWHERE = [
    "fuck", "shit", "bitch", "cunt", "whore", "slut", "wanker", "asshole", "arsehole",
    "dickhead", "jackass", "dumbass", "bullshit", "motherfucker", "cocksucker", "pussy",
    "bollocks", "jerkoff", "bastard", "douchebag", "twatwaffle",
    "nigger", "nigga", "faggot", "retard", "kike", "chink", "wetback", "raghead",
    "tranny", "beaner", "gook", "towelhead", "currymuncher", "shemale", "halfbreed",
    "hitler", "nazi", "holocaust", "siegheil", "heilhitler", "whitepower", "whitepride",
    "aryanbrother", "bloodandsoil", "himmler", "goebbels", "eichmann", "kukluxklan",
    "gaschamber", "masterrace", "ethniccleansing", "lynchmob",
    "thirdreich", "binladen", "polpot", "islamicstate", "alqaeda", "daesh", "14words",
    "blowjob", "handjob", "creampie", "gangbang", "bukkake", "dildo", "masturbat",
    "porn", "hentai", "incest", "bestiality", "ejaculat", "orgasm", "fleshlight",
    "buttplug", "deepthroat",
    "rapist", "pedophile", "paedophile", "childporn", "molest", "killyourself", "selfharm",
]
EXACT = [
    "ass", "arse", "dick", "cock", "prick", "tit", "tits", "cum", "twat", "piss", "crap", "wank",
    "fag", "dyke", "homo", "coon", "spic", "paki", "negro", "spaz", "mongoloid",
    "adolf", "fuhrer", "kkk", "klan", "1488", "stalin",
    "anal", "anus", "penis", "vagina", "boobs", "nude", "sex", "milf", "bdsm", "nsfw", "horny",
    "rape", "kys", "suicide", "genocide", "terrorist",
]
SAFE = [
    "scunthorpe", "penistone", "lightwater", "clitheroe", "sussex", "essex", "middlesex",
    "cockburn", "cockfosters", "shitake", "shiitake", "analysis", "analyst", "assassin",
    "assess", "assets", "assist", "assign", "bassett", "basset", "grape", "therapist",
    "cumbria", "cumbernauld", "scunny",
    "therapy", "grapes", "drape", "scrape", "trapeze", "sextant", "sextet", "saxon",
    "stalingrad", "lynch", "lynchburg", "adolfo", "adolphus", "rudolf", "randolph",
    "canal", "banal", "analogue", "analog", "analyse", "analyze", "manual", "annual",
    "titan", "titanic", "titus", "nudge", "horning", "thorny",
]


@dataclass(frozen=True)
class Lexicon:
    anywhere: tuple[str, ...]
    exact: tuple[str, ...]
    safe: tuple[str, ...] = field(default=())

    @classmethod
    def from_table(cls, df: DataFrame) -> "Lexicon":
        """Load `(term, tier)` rows. A lexicon is configuration: the driver and each task hold it whole."""
        rows = df.select("term", "tier").distinct().collect()
        pick = lambda tier: tuple(sorted(r.term for r in rows if r.tier == tier))
        return cls(pick("anywhere"), pick("exact"), pick("safe"))

    def unreachable(self) -> list[str]:
        """Substring terms that folding rewrites, so that they can never match."""
        folds = str.maketrans(FOLD_FROM, FOLD_TO)
        return [t for t in self.anywhere if t.lower().translate(folds) != t]


DEFAULT_LEXICON = Lexicon(tuple(ANYWHERE), tuple(EXACT), tuple(SAFE))


def fold_leet(text: Column) -> Column:
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[ ._-]+"), lambda w: w != "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(fold_leet(text), "[ ._-]+", "")


def squeeze_runs(text: Column) -> Column:
    """Runs of three or more of one character become one; doubles stay."""
    return F.regexp_replace(text, r"(.)\1{2,}", "$1")


def prefix_pattern(terms) -> str:
    """A pattern that finds any of the terms. Beginnings are shared; what follows the end of a term doesn't matter."""
    tree: dict = {}
    for term in sorted(terms):
        node = tree
        for c in term:
            if node is None:  # a shorter term is found here already
                break
            last, node = node, node.setdefault(c, {})
        else:
            last[c] = None

    def pattern(node: dict) -> str:
        ends = [re.escape(c) for c, below in sorted(node.items()) if below is None]
        branches = [re.escape(c) + pattern(below) for c, below in sorted(node.items()) if below is not None]
        if ends:
            branches.insert(0, ends[0] if len(ends) == 1 else f"[{''.join(ends)}]")
        return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"

    return pattern(tree)


def is_blocked_name(name: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    folded, plain = _words(fold_leet(name)), _words(F.lower(name))
    verdict = F.lit(False)
    anywhere, exact, safe = ([t for t in terms if t] for terms in (lexicon.anywhere, lexicon.exact, lexicon.safe))
    if anywhere:
        kept = F.filter(folded, lambda w: ~w.isin(safe)) if safe else folded
        joined, pattern = F.array_join(kept, ""), prefix_pattern(anywhere)
        verdict = joined.rlike(pattern) | squeeze_runs(joined).rlike(pattern)
    if exact:
        for words in (folded, plain):
            verdict = verdict | F.exists(words, lambda w: w.isin(exact)) | F.array_join(words, "").isin(exact)
    return F.coalesce(verdict, F.lit(False))
