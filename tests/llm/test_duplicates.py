import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from lagoon.llm import neardup, simhash, suffixes
from lagoon.llm.queries import queries


def plain_print(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    s = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius):
    """prints: (id, fingerprint) pairs; the least id each reaches."""
    root = list(range(len(prints)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= radius:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return [least.get(top(k)) for k in range(len(prints))]


def test_op1_against_all_pairs(spark, small, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries()["op1_simhash"](spark, small).collect()}
    prints = [(i, plain_print(t)) for i, t in sorted(texts.items())]
    want = {i: (f"{f:016x}", c) for (i, f), c in zip(prints, plain_components(prints, 2), strict=True)}
    assert got == want


def test_op1_edges(frame, spark):
    rows = [(1, None), (2, ""), (2, ""), (3, " \n"), (None, "a b c d"), (None, None), (5, "A\tb c D"), (6, "zz"), (7, "Ä b"), (8, "ä b")]
    got = sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in simhash.components(simhash.fingerprints(frame(rows))).collect()), key=repr)
    prints = [(i, plain_print(t)) for i, t in rows]
    want = sorted(((i, simhash.signed(f), c) for (i, f), c in zip(prints, plain_components(prints, 2), strict=True)), key=repr)
    assert got == want
    assert simhash.components(simhash.fingerprints(frame([]))).count() == 0


def test_links_in_crowds(spark, monkeypatch):
    """Many fingerprints close together: buckets over the bound go through centres and lose no connection."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < 150:
        prints.add(rng.choice(sorted(prints)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    while len(prints) < 400:
        prints.add(rng.getrandbits(64))
    rows = [(k, simhash.signed(f)) for k, f in enumerate(sorted(prints))]
    for radius in (1, 2):
        want = dict(zip((k for k, _ in rows), plain_components([(k, f & (2**64 - 1)) for k, f in rows], radius), strict=True))
        for bound in (4, 64):
            monkeypatch.setattr(simhash, "BUCKET", bound)
            got = simhash.components(spark.createDataFrame(rows, "doc_id long, fp long"), radius).collect()
            assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_thresholds_guarantee_the_radius():
    rng = np.random.default_rng(1)
    for n in (1000, 10**6, 10**9, 10**11):
        for radius in (1, 2):
            p = rng.uniform(0.3, 0.7, 64)
            plan = simhash.allocate(n, n * np.outer(p, p) + np.diag(n * p * (1 - p)), radius)
            assert sum(t + 1 for _, t in plan) >= radius + 1 and len({b for part, _ in plan for b in part}) == sum(len(part) for part, _ in plan)


def jaccard_groups(rows, similarity=0.8):
    sets = [set(simhash.shingles((t or "").encode(), 5)) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            u = len(sets[a] | sets[b])
            if u == 0 or len(sets[a] & sets[b]) / u >= similarity - 1e-9:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    best = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            best[top(k)] = min(i, best.get(top(k), i))
    return best.values()


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_one_of_each_against_all_pairs(frame, monkeypatch):
    rng = random.Random(7)
    rows, k = [], 0
    for copies in (1, 2, 5, 40, 1, 3):
        words = [f"w{rng.randrange(3000)}" for _ in range(150)]
        for c in range(copies):
            rows.append((k, edited(rng, words, c % 4)))
            k += 1
    rows += [(k, rows[3][1]), (k + 1, ""), (k + 2, None), (k + 3, " \n ")]
    want = sorted(jaccard_groups(rows))
    for bucket, block in ((64, 1024), (4, 8)):  # small bounds: chains in crowded buckets, families in several blocks
        monkeypatch.setattr(neardup, "BUCKET", bucket)
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = neardup.one_of_each(frame(rows))
        assert got.columns == frame(rows).columns
        assert sorted(r["doc_id"] for r in got.collect()) == want


def test_isolated_pairs_are_all_found(frame):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for k in range(600):
        words = [word() for _ in range(rng.randrange(30, 200))]
        n, at = int(len(words) * rng.uniform(0.06, 0.2)), rng.randrange(len(words))
        # appended, cut out, replaced, single words replaced
        other = [words + [word() for _ in range(n)], words[:at] + words[at + n :], words[:at] + [word() for _ in range(n // 2)] + words[at + n // 2 :], edited(rng, words, 1 + len(words) // 60).split()][k % 4]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    want = [i for k in range(0, len(rows), 2) for i in jaccard_groups(rows[k : k + 2])]
    assert len(rows) // 2 < len(want) < len(rows)
    assert sorted(r["doc_id"] for r in neardup.one_of_each(frame(rows)).collect()) == sorted(want)


def test_near_duplicates_out_links_by_simhash(spark, frame):
    """Fingerprints within 2 bits link whatever the shingles' similarity: directly, and in chains with links of the other kind."""
    rng = random.Random(16)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for k in range(40):
        often, tail, other = line(7), line(30), line(30)
        rows += [(10 * k, " ".join([often] * 400) + f" {tail}"), (10 * k + 1, " ".join([often] * 400) + f" {line(k)}")]  # near in bits
        rows += [(10 * k + 2, f"{often} {often} {tail}")]  # near the first in shingles
        rows += [(10 * k + 3, other), (10 * k + 4, f"{other} {line(3)}"), (10 * k + 5, line(30))]
    prints = [plain_print(t) for _, t in rows]
    link = lambda x, y: bin(prints[x] ^ prints[y]).count("1") <= 2
    sets = [set(simhash.shingles(t.encode(), 5)) for _, t in rows]
    similar = lambda x, y: len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]) - 1e-9
    root, kinds = list(range(len(rows))), Counter()
    for _ in range(3):
        for x in range(len(rows)):
            for y in range(x):
                if link(x, y) or similar(x, y):
                    kinds[link(x, y), similar(x, y)] += 1
                    root[x] = root[y] = min(root[x], root[y])
    assert kinds[True, False] > 30 and kinds[False, True] > 30
    got = corpus_pipeline.near_duplicates_out(spark, frame(rows), "").collect()
    assert sorted(r["doc_id"] for r in got) == sorted({rows[r][0] for r in root})


def batched(rows, names, n):
    return [pa.RecordBatch.from_arrays([pa.array(c[k : k + n]) for c in rows], names) for k in range(0, len(rows[0]), n)]


def keys_of_sets(sets, similarity, n):
    """Keys by number of the set, through the functions of the tasks, in batches of n rows."""
    rows = [(h, k, tag) for k, own in enumerate(sets) for held, tag in neardup.members(own, similarity) for h in held.view(np.int64).tolist()]
    rows = sorted(rows + rows[::3])  # as copies from other tasks
    columns = [np.array(c, t) for c, t in zip(zip(*rows), (np.int64, np.int64, np.int32))]
    shared = [r for b in neardup._shared(iter(batched(columns, ["h", "s", "tag"], n))) for r in zip(*(b.column(c).to_pylist() for c in ("s", "tag", "df", "h")))]
    count = Counter((r[0], r[1], r[3]) for r in shared)
    assert set(count.values()) <= {1}
    shared.sort()
    columns = [np.array([r[c] for r in shared], t) for c, t in ((0, np.int64), (1, np.int32), (3, np.int64))]
    out = {}
    for b in neardup._rarest(iter(batched(columns, ["s", "tag", "h"], n))) if shared else ():
        for k, s in zip(b.column("key").to_pylist(), b.column("nid").to_pylist()):
            out.setdefault(s, set()).add(k)
    return out


@pytest.mark.parametrize("similarity,counted,n", [(0.8, 1000, 10_000), (0.8, 3, 7), (0.5, 2, 50), (1.0, 1000, 90)])
def test_similar_sets_share_a_key(monkeypatch, similarity, counted, n):
    monkeypatch.setattr(neardup, "COUNTED", counted)
    rng = np.random.default_rng(12)
    pool = rng.integers(0, 2**64, 40, dtype=np.uint64)  # common to many
    sets = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    for k in range(400):
        size = int(rng.choice([1, 2, 5, 20, 60, 64, 70, 80, 81, 90, 200]))
        a = rng.integers(0, 2**64, size, dtype=np.uint64)
        if k % 5 == 0:
            a |= neardup.HALF  # nothing in the half that is counted
        a = np.unique(np.concatenate([a, rng.choice(pool, int(rng.integers(0, 12)))]))
        cut = rng.permutation(a)[: len(a) - int(rng.integers(0, max(1, len(a) * (1 - similarity) + 1)))]
        sets += [a, np.unique(np.concatenate([cut, rng.integers(0, 2**64, int(rng.integers(0, len(a) // 8 + 1)), dtype=np.uint64)]))]
    keys = keys_of_sets(sets, similarity, n)
    similar = 0
    for x in range(len(sets)):
        for y in range(x):
            if min(len(sets[x]), len(sets[y])) >= similarity * max(len(sets[x]), len(sets[y])) and neardup.jaccard(sets[x], sets[y]) >= similarity:
                similar += 1
                assert keys.get(x, set()) & keys.get(y, set()), (len(sets[x]), len(sets[y]))
    assert similar > 50


def test_unrelated_texts_with_a_common_sentence_are_no_candidates(spark, frame):
    rng = random.Random(14)
    sentence = " ".join(f"common{k}" for k in range(30))
    rows = [(k, " ".join(f"w{rng.randrange(10**7)}" for _ in range(70)) + " " + sentence) for k in range(5000)]
    docs = frame(rows)
    keys = neardup.candidates(docs.selectExpr("text as t", "xxhash64(text) as s"))
    assert keys.count() == 0
    assert neardup.one_of_each(docs).count() == 5000


def test_crowded_keys_connect_all_their_rows(monkeypatch):
    rng = np.random.default_rng(13)
    for bucket in (64, 0):
        monkeypatch.setattr(neardup, "BUCKET", bucket)
        key = np.sort(rng.integers(0, 6, 1000))
        nid = np.concatenate([np.sort(rng.choice(400, (key == k).sum(), replace=False)) for k in range(6)]) + 1000 * key
        batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + 7]), pa.array(nid[i : i + 7])], ["key", "nid"]) for i in range(0, 1000, 7)]
        got = {tuple(x.values()) for b in neardup._chains(iter(batches)) for x in b.to_pylist()}
        assert got == {(int(nid[key == k][0]), int(x)) for k in range(6) for x in nid[key == k][1:]}


def test_one_of_each_edges(frame):
    assert neardup.one_of_each(frame([])).count() == 0
    rows = [(1, "a b"), (1, "a b"), (None, "a b"), (None, "q r s"), (None, "q r s")]
    assert sorted(((r["doc_id"], r["text"]) for r in neardup.one_of_each(frame(rows)).collect()), key=repr) == [(1, "a b"), (None, "q r s")]


def plain_repeats(rows):
    data = [((2**63 - 1) if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for s in range(len(b) - 49):
            first[b[s : s + 50]] = min(i, first.get(b[s : s + 50], i))
    out = []
    for (i, b), (name, _) in zip(data, rows, strict=True):
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        runs = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(b)))
        out.append((name, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def check_repeats(df, rows):
    assert sorted((tuple(r) for r in suffixes.remove_repeats(df).collect()), key=repr) == plain_repeats(rows)


def test_op5_against_all_strings(spark, small, texts):
    got = sorted((tuple(r) for r in queries()["op5_suffixes"](spark, small).collect()), key=repr)
    assert got == plain_repeats(sorted(texts.items()))


def test_op5_edges(frame, monkeypatch):
    rng = random.Random(5)
    words = ["ab", "cde", "äöü", "f", "ghij"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = text(60)
    rows = [(1, shared), (2, "x" + shared + "y"), (2, "x" + shared + "y"), (None, shared), (None, shared), (3, shared[:49]), (4, None), (5, "")]
    rows += [(6, "a" * 300), (7, "a" * 77), (8, "ab" * 100), (9, "ba" * 60), (10, "a" * 50), (11, "a" * 49)]
    rows += [(20 + k, text(40) + shared[k : k + 80] + text(30)) for k in range(12)]
    check_repeats(frame(rows), rows)
    monkeypatch.setattr(suffixes, "GROUP", 3)  # crowded anchors: strings by hash
    monkeypatch.setattr(suffixes, "CHUNK", 64)  # long texts: in overlapping pieces
    check_repeats(frame(rows), rows)
    assert suffixes.remove_repeats(frame([])).count() == 0


def test_op5_many_rows_without_an_id(spark, frame, monkeypatch):
    rng = random.Random(15)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(1, passage)] + [(None, f"{rng.random()} " * rng.randrange(0, 3) + (passage if k % 7 == 0 else "") + f" {k}") for k in range(20_000)]
    check_repeats(frame(rows), rows)
    monkeypatch.setattr(suffixes, "TAG", 12)  # 2,048 hashes for 300 texts: many meet
    few = rows[:300] + rows[1:40] + [(k % 3, t) for k, (_, t) in enumerate(rows[300:500])]
    tagged = suffixes.told_apart(frame(few).selectExpr("coalesce(doc_id, 9223372036854775807) as i", "text as t")).collect()
    assert len(tagged) == len(few) and len({(r["i"], r["tag"]) for r in tagged}) == len({(r["i"], r["t"]) for r in tagged})
    assert any(r["tag"] >= 1 << 11 for r in tagged)
    monkeypatch.setattr(suffixes, "TAG", 32)
    check_repeats(frame(few), few)


def test_op5_orders_are_induced_from_one_sort(monkeypatch):
    """Contexts of many anchors against every earlier string, with one full sort for all alignments."""
    rng, side, span = random.Random(17), suffixes.SIDE, suffixes.SPAN
    grams = [bytes(rng.choices(b"ab", k=suffixes.GRAM)) for _ in range(6)]
    gram, doc, left, contexts = [], [], [], []
    for _ in range(400):
        g = rng.randrange(6)
        before, after = (bytes(rng.choices(b"a\0", (30, 1), k=side))[: rng.choice((side, side, rng.randrange(side + 1)))] for _ in range(2))
        gram.append(g)
        doc.append(rng.randrange(150))
        left.append(len(before))
        contexts.append(before + grams[g] + after)
    string = lambda k, j: contexts[k][left[k] - side + j :][:span] if left[k] >= side - j else b""
    want = np.zeros(400, np.int64)
    for j in range(suffixes.GRAMS):
        least = {}
        for k in range(400):
            least[gram[k], string(k, j)] = min(doc[k], least.get((gram[k], string(k, j)), doc[k]))
        for k in range(400):
            want[k] |= (len(string(k, j)) == span and doc[k] > least[gram[k], string(k, j)]) << j
    sorts, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda *a, **k: sorts.append(1) or lexsort(*a, **k))
    got = suffixes.solve(np.array(gram), np.array(doc), np.array(left), contexts)
    assert (want != 0).sum() > 100 and got.tolist() == want.tolist()
    assert len(sorts) == 1


def test_progressions_hold_all_anchors():
    rng = np.random.default_rng(8)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        text, gram, c = rng.integers(0, 2, n), rng.integers(0, 2, n).astype(np.uint64), rng.integers(0, 2, n).astype(np.uint64)
        position = rng.permutation(n * 2)[:n]
        stay, run = suffixes.progressions(text, position, gram, c)
        found = sorted((text[k], gram[k], c[k], position[k] + (r >> 32) * m) for k, r in zip(stay, run.tolist(), strict=True) for m in range((r & 0xFFFFFFFF) + 1))
        assert found == sorted(zip(text, gram, c, position, strict=True))
    stay, run = suffixes.progressions(np.zeros(50, int), np.arange(50) * 7, np.zeros(50, np.uint64), np.zeros(50, np.uint64))
    assert len(stay) == 1 and run[0] == 7 << 32 | 49
