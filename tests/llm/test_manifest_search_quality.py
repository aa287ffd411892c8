"""Merkle manifest, ranked search and quality rules: against SQL, brute force and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from check import compare, duck

from lagoon.llm import lexical, merkle, quality
from lagoon.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", ["op11_merkle", "op12_lexical", "op13_quality"])
def test_sql(name, spark, small):
    text, same = compare(queries()[name](spark, small), duck(small), oracle_sql()[name])
    assert same, text


# --- Merkle manifest -------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """(root, siblings of each leaf as (before, after) by level), level by level."""
    level, runs, place = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, p in enumerate(place):
            run = level[p // 16 * 16 : p // 16 * 16 + 16]
            runs[k].append((run[: p % 16], run[p % 16 + 1 :]))
        place = [p // 16 for p in place]
        level = [h(*level[s : s + 16]) for s in range(0, len(level), 16)]
    return level[0], runs


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""

    def leaf(r, text):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))

    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in names]
    root, tops = plain_tree([t[0] for t in trees])
    out = []
    for name, (subroot, paths), top in zip(names, trees, tops, strict=True):
        for (_, _, own, r), path in zip(sorted(by_source[name], key=lambda x: x[:3]), paths, strict=True):
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            folded = leaf(r, r[4].translate(lower)) if touched else own
            for before, after in path + top:
                folded = h(*before, folded, *after)
            proof = h(*(d for before, after in path + top for d in before + after))
            out.append((r[0], own, subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def documents(spark, rows):
    full = [(*r[:1], r[4], *r[2:3], r[1], r[3], 7, "c", "d") for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, place long, tree string, digest string").repartition(5)


def manifest_of(spark, rows):
    return sorted((tuple(r) for r in merkle.manifest(merkle.tampered_documents(documents(spark, rows))).collect()), key=repr)


@pytest.mark.parametrize("block", [(1, 16), (3, 4096)])
def test_op11_against_the_whole_tree(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "LEVELS", block[0])
    monkeypatch.setattr(merkle, "BLOCK", block[1])
    rng = random.Random(11)
    rows = [(k * 3, "hot", "en", k, f"Text {rng.random()} É") for k in range(4200 if block[1] == 4096 else 700)]
    rows += [(rng.randrange(10**6), f"s{k % 40}", None, None, rng.choice(["A", "b", None, ""])) for k in range(300)]
    rows += [(1, None, "en", 1, "x")] * 20 + [(None, "hot", None, None, None)] * 17 + [(5, "", "é", -1, "\U0001f600\n"), (None, None, None, None, "Only")]
    got = manifest_of(spark, rows)
    assert got == plain_manifest(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 4


def test_op11_edges(spark):
    assert manifest_of(spark, []) == []
    one = manifest_of(spark, [(3, "s", "en", 1, "a")])
    assert one == plain_manifest([(3, "s", "en", 1, "a")]) and one[0][1] == one[0][2] == one[0][3] and one[0][4] == h()
    long = [(k, "s", "en", 1, "Ab" * 500_000) for k in range(3)]
    assert manifest_of(spark, long) == plain_manifest(long)
    proofs = merkle.manifest(merkle.tampered_documents(documents(spark, [(k, "s", "en", 1, "x") for k in range(40)])), with_proofs=True).collect()
    for r in proofs:
        assert h(*r["proof"]) == r["proof_sha256"] and len(r["proof"]) % 2 == 0
        pairs = [(a.encode(), b.encode()) for a, b in zip(r["proof"][::2], r["proof"][1::2], strict=True)]
        assert merkle.fold(r["leaf"].encode(), pairs).decode() == r["root"]


def test_sweeps_in_label_order():
    for n in (1, 2, 16, 17, 256, 257, 900):
        leaves = [h(str(k)).encode() for k in range(n)]
        nodes = merkle.sweep_up(leaves, merkle.height(n))
        root, runs = plain_tree([x.decode() for x in leaves])
        assert nodes[-1] == [root.encode()]
        for leaf, path, run in zip(leaves, merkle.sweep_down(nodes, []), runs, strict=True):
            assert path == [("".join(a).encode(), "".join(b).encode()) for a, b in run] and merkle.fold(leaf, path) == nodes[-1][0]


# --- ranked search ---------------------------------------------------------------------------------


def plain_search(docs, items, best=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    cut = lambda t: pattern.findall((t or "").translate(lower))
    bags = [(i, cut(t)) for i, t in docs]
    bags = [(i, Counter(t), len(t)) for i, t in bags if t]
    n, total = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, tf, _ in bags for t in tf)
    out = []
    for item, text in items:
        asked, scored = set(cut(text)), []
        for i, tf, size in bags:
            m = 10 + (90 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in asked if t in tf)
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:best])]
    return sorted(out, key=repr)


def search_of(frame, spark, rows, items, **more):
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, key string")
    got = lexical.search(frame(rows), asked, **more).collect()
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=repr)


def test_op12_against_all_documents(frame, spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(60)] + ["the"] * 30 + ["Éa", "日本", "x_y", "A1"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 80)))) for k in range(400)]
    rows += [(1000 + k, "w1 w2 the, THE w3.") for k in range(30)] + [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (7, "w5"), (7, "w5"), (9, None), (10, ""), (11, "?! --")]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for k in range(50)]
    items += [(60, None), (61, ""), (62, "..."), (63, "nowhere"), (64, "w1 w2 w3"), (64, "w1 w2 w3"), (None, "the w9"), (65, "éA 日本")]
    want = plain_search(rows, items)
    assert search_of(frame, spark, rows, items) == want
    assert search_of(frame, spark, rows, items, coordinates=4) == want  # loose bounds
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 600)
    assert search_of(frame, spark, rows, items) == want  # several blocks
    assert search_of(frame, spark, rows, [], best=3) == [] and search_of(frame, spark, [], items) == []
    assert search_of(frame, spark, [(1, None), (2, "")], items) == []


def test_bounds_hold_and_spare_work(texts):
    rng = np.random.default_rng(0)
    docs = [(t or "").encode() for _, t in sorted(texts.items())]
    items = lexical.Items.of([(k, " ".join(docs[int(i)].decode().split()[5:35])) for k, i in enumerate(rng.choice(len(docs), 30))])
    bags = [lexical.terms_of(t) for t in docs]
    df = Counter(t for b in bags for t in set(b))
    stats = lexical.Statistics(sum(map(bool, bags)), sum(map(len, bags)), np.array([df[t] for t in items.vocabulary]))
    for coordinates in (64, 1024):
        s = lexical.Sketches(items, stats, coordinates)
        sketch, exact = s.fold(docs)
        bounds = s.bounds(sketch)
        scores = np.array([[sum(e.get(t, 0) for t in terms) for terms in s.lists] for e in exact])
        assert (bounds >= scores).all() and scores.any()
    best = lexical.Best(s, 10)
    for k in range(0, len(docs), 50):
        best.add(list(range(k, k + 50)), docs[k : k + 50])
    assert best.rescored < 0.6 * scores.size
    for item, heap in enumerate(best.heaps):
        assert sorted(x for x, _ in heap) == sorted(np.sort(scores[:, item])[-10:].tolist())[-len(heap) :]


# --- quality rules ---------------------------------------------------------------------------------


def plain_repeats(words):
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)})


def test_repeated_words():
    rng = random.Random(13)
    for _ in range(300):
        words = [rng.choice("abcd") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 60))]
        assert quality.repeated_words([w.encode() for w in words]) == plain_repeats(words)
    assert quality.repeated_words([b"a"] * 100_000) == 100_000


def test_lines():
    lines = quality.Lines()
    for line, why in (
        ("A plain line of words, and its end.", None), ("Really?? Yes!! No!! Ha!!", "punctuation"), ("price $$$ now *** ### go", "punctuation"),
        ("Home | News | About", "navigation"), ("  LOGIN\t", "navigation"), ("a · b · c · d", "navigation"), ("x | y", None),
        ("All Rights Reserved.", "boilerplate"), ("word " * 100, "punctuation"), ("word " * 100 + "end.", None), ("One!! of these many words here is loud.", None),
    ):
        assert lines.fault(line) == why, line
    text = "Good line here.\n\nhome\nAnother good line.\nWe use cookies here"
    assert lines.clean(text) == ("Good line here.\n\nAnother good line.", {"punctuation": 0, "navigation": 1, "boilerplate": 1})


def test_op13_on_labelled_documents(spark, small):
    folder = small.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    rows = queries()["op13_quality"](spark, folder).join(labels, "doc_id").where("not base_failed").select("quality", "kept").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.999 * len(good) and sum(bad) <= 0.05 * len(bad) and len(bad) > 250


def test_op13_edges(frame):
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (None, "a b c d e f g h i j."), (None, "a b c d e f g h i j."), (4, "x " * 300_000), (5, "é日 # | <b>\nsame\nsame\n\nsame"), (6, "Sentence. " * 3)]
    rows.append((7, "\n".join(f"line number {k} has its own words in it." for k in range(20_000))))
    rows.append((8, "Good words make up this line of ten or more here.\n" + "Home | News | About | More | Search | Login | Help | Contact | Next | Share"))
    got = {(r["doc_id"], r["n_words"]): r for r in quality.clean_lines(frame(rows)).collect()}
    assert quality.clean_lines(frame(rows)).count() == len(rows) and quality.clean_lines(frame([])).count() == 0
    for (i, n), r in got.items():
        text = dict((i, t) for i, t in rows)[i] or ""
        words = re.findall(r"[^\x20\t-\r]+", text)
        assert n == len(words) and r["word_chars"] == sum(map(len, words)) and r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        if n < 10**5:
            assert r["n_repeat_words"] == plain_repeats(words)
        filled = [x for x in text.split("\n") if re.search(r"[^\x20\t-\r]", x)]
        assert r["n_dup_lines"] == len(filled) - len(set(filled))
        assert r["base_failed"] == (n < 10 or 100 * r["n_repeat_words"] > 20 * n) and not (r["base_failed"] and r["kept"])
    assert got[1, 0]["base_failed"] and got[None, 10]["kept"] and got[4, 300_000]["base_failed"]
    assert [r["kept"] for (i, _), r in got.items() if i == 8] == [False] and [r["n_navigation"] for (i, _), r in got.items() if i == 8] == [1]
