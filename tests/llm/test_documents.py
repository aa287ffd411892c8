import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from lagoon.llm import iblt, packing
from lagoon.llm.queries import queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def check_pieces(rows, docs, ids_of, window):
    """docs: (doc_id, text) with ids that tell rows apart. Every id in one piece, sequences gapless."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == {i for i, _ in docs}
    for i, t in docs:
        ids, at = np.array(ids_of(t), "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    sizes = []
    for k in sorted(by_sequence):
        at = 0
        for r in sorted(by_sequence[k], key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        sizes.append(at)
    full = [s for s in sizes if s == window]
    rest = sizes[len(full) :]
    assert sizes[: len(full)] == full and all(s & (s - 1) == 0 for s in rest) and len(set(rest)) == len(rest)
    return by_sequence


def test_op7_round_trip(spark, small, texts, ids_of):
    check_pieces(queries()["op7_packing"](spark, small).collect(), sorted(texts.items()), ids_of, 2048)


def test_proportions_in_every_window(frame, ids_of):
    rng = random.Random(1)
    rows = []
    for k in range(400):
        source = rng.choice(["big"] * 6 + ["mid"] * 3 + ["small"])
        rows.append((k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 120))), source))
    got = packing.pack(frame(rows), PATH, window=512, quantum=32).collect()
    by_sequence = check_pieces(got, [(r[0], r[1]) for r in rows], ids_of, 512)
    source = {r[0]: r[2] for r in rows}
    total = {s: sum(len(ids_of(r[1])) for r in rows if r[2] == s) for s in ("big", "mid", "small")}
    done = dict.fromkeys(total, 0)
    for k in sorted(by_sequence):
        for r in by_sequence[k]:
            done[source[r["doc_id"]]] += r["length"]
        here = sum(done.values())
        assert all(abs(done[s] - here * total[s] / sum(total.values())) <= 2 * 32 for s in total)
    shares = packing.pack(frame(rows), PATH, weights={"big": 1, "mid": 1, "small": 1}, window=512, quantum=32).collect()
    first = [r for r in check_pieces(shares, [(r[0], r[1]) for r in rows], ids_of, 512)[0]]
    assert all(abs(sum(r["length"] for r in first if source[r["doc_id"]] == s) - 512 / 3) <= 2 * 32 for s in total)


@pytest.mark.parametrize("weighted", [False, True])
def test_a_thousand_sources_in_every_window(frame, ids_of, monkeypatch, weighted):
    """Most sources are beyond those the driver schedules; each window still holds each at its share, to within a quantum or two."""
    monkeypatch.setattr(packing, "QUEUES", 10)
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(20, 60))), f"s{k % 1000}" if k % 1000 else None) for k in range(3000)]
    rows += [(5000 + k, "a b c " * 200, f"big{k % 10}") for k in range(40)]
    weights = {f"s{k}": 3 for k in range(500)} | {f"big{k}": 50.5 for k in range(10)} if weighted else None
    quantum, window = 8, 4096
    got = packing.pack(frame(rows), PATH, weights=weights, window=window, quantum=quantum).collect()
    by_sequence = check_pieces(got, [(r[0], r[1]) for r in rows], ids_of, window)
    source = {r[0]: r[2] for r in rows}
    total = Counter()
    for r in rows:
        total[r[2]] += len(ids_of(r[1]))
    share = {s: (weights.get(s, 1) if weighted else n) for s, n in total.items()}
    everything, done = sum(share.values()), Counter()
    for k in sorted(by_sequence):
        for r in by_sequence[k]:
            done[source[r["doc_id"]]] += r["length"]
        here = sum(done.values())
        if weighted and any(done[s] == total[s] for s in total):
            break  # a source has run out, the others share its part
        assert all(abs(done[s] - here * share[s] / everything) <= 3 * quantum for s in total)
    assert k >= 3


def test_schedule_is_the_round_robin():
    """Places by formula against quanta sorted by their times."""
    rng = random.Random(2)
    for _ in range(30):
        totals = {q: rng.randrange(1, 900) for q in range(rng.randrange(1, 7))}
        weights = {q: rng.randrange(1, 9) for q in totals} if rng.random() < 0.5 else None
        s = packing.Schedule(totals, weights, 16)
        order = sorted(((2 * j + 1) / (2 * s.weights[q]), q, j) for q in totals for j in range(s.quanta[q]))
        at = 0
        for _, q, j in sorted(order, key=lambda x: (round(x[0], 12), x[1])):
            assert s.starts(q, np.array([j]))[0] == at
            at += min(16, totals[q] - 16 * j)


def test_op7_edges(frame, ids_of, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 2)
    rows = [(1, None), (2, ""), (None, "a b c"), (4, "x " * 900, None), (5, "<|endoftext|> A.B, c... d. ", "s1"), (6, "y", "s2"), (7, "z " * 50, "s3")]
    got = packing.pack(frame(rows), PATH, window=64, quantum=8).collect()
    check_pieces(got, [(r[0], r[1]) for r in rows], ids_of, 64)
    twice = packing.pack(frame([(1, "a b"), (1, "a b")]), PATH).collect()
    assert sum(r["length"] for r in twice) == 6 and all(r["doc_tokens"] == 3 for r in twice)
    assert packing.pack(frame([]), PATH).count() == 0


def check_versions(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest()))
    want = []
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest(), str(iblt.Fingerprint(t.encode()))))
    found = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"]) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_op9_on_documents(spark, small, texts, monkeypatch):
    for size in (4 << 20, 20_000):  # one range of ids, and many
        monkeypatch.setattr(iblt, "RANGE_BYTES", size)
        check_versions(sorted(texts.items()), queries()["op9_iblt"](spark, small).collect())


def test_op9_edges(frame, monkeypatch):
    monkeypatch.setattr(iblt, "RANGE_BYTES", 40)
    rows = [(5, "One. Two. Three. Four."), (3, None), (4, ""), (9, "\U0001f600" * 9), (9, "same id. other text."), (9, "same id. other text."), (None, "no id."), (None, "none"), (-7, "first. first. first.")]
    check_versions(rows, iblt.fingerprint_versions(frame(rows)).collect())
    check_versions([(1, "alone. text.")], iblt.fingerprint_versions(frame([(1, "alone. text.")])).collect())
    assert iblt.fingerprint_versions(frame([])).count() == 0


def test_peeling_recovers_differences():
    rng = random.Random(3)
    for n, changed in ((0, 0), (1, 1), (40, 3), (300, 150), (2000, 2000)):
        a = [f"sentence {rng.randrange(50 if n == 300 else 10**9)} of it." for _ in range(n)]
        b = list(a)
        for k in rng.sample(range(n), changed):
            b[k] = f"other {k}."
        x, y = iblt.Fingerprint(" ".join(a).encode()), iblt.Fingerprint("\n".join(b).encode())
        mine, theirs = iblt.difference(x, y)
        assert set(mine.tolist()) == set(x.keys.tolist()) - set(y.keys.tolist()) and set(theirs.tolist()) == set(y.keys.tolist()) - set(x.keys.tolist())
        assert len(mine) == len(set(mine.tolist())) and iblt.likeness(x, y) == (1 - (len(mine) + len(theirs)) / (2 * n) if n else 1)
    assert str(iblt.Fingerprint(b"A b. C.")) == str(iblt.Fingerprint(b"A b. C."))


def test_pipeline_stages(spark, small, small_docs, ids_of):
    """Each stage on the table of the one before; the last packs all that is left."""
    docs = small_docs
    kept = []
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(function(spark, docs, small))
        assert docs.columns == small_docs.columns, name
        kept.append(docs.count())
    assert 200 > kept[0] > kept[1] > kept[2] == kept[3] > 120
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
    check_pieces(corpus_pipeline.run(spark, small).collect(), [(i, r["text"]) for i, r in rows.items()], ids_of, 2048)
