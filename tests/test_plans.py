"""Round loops, skew helpers and the leaderboard against plain Python."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lagoon.functions.scalars import minted_id
from lagoon.functions.tokens import token_hash
from lagoon.operators import accounts, activity, rooms
from lagoon.operators.accounts import assign_names, redeem_links
from lagoon.operators.limits import budget_violations, throttle_decisions
from lagoon.operators.purchases import classify_purchases
from lagoon.operators.rooms import ingest_room_dives
from lagoon.plans import leaderboard, ranges, settlement, skew
from lagoon.plans.leaderboard import visible_top
from lagoon.plans.holdings import grant_in_turn
from lagoon.plans.matching import grant_in_order
from lagoon.plans.ranges import range_position
from lagoon.plans.settlement import settle_trades
from lagoon.plans.skew import left_join_known, previous_value, running_position
from lagoon.session import cut_lineage
from lagoon.sources.files import conform

AS_OF = "2024-02-01"


# settlement ---------------------------------------------------------------


def serial(creatures, trades, accepts):
    owner = {c[0]: c[1] for c in creatures}
    species = {c[0]: c[2] for c in creatures}
    age = {c[0]: (c[3], c[0]) for c in creatures}
    status = {t[0]: t[5] for t in trades}
    book = {t[0]: t for t in trades}
    out = {}
    held = lambda u, s: [i for i in owner if owner[i] == u and species[i] == s]
    for seq, trade, user in sorted(accepts):
        if status.get(trade) != "pending":
            out[seq] = "no such pending trade"
            continue
        _, a, b, give, get, _, named = book[trade]
        if user != b:
            out[seq] = "not the recipient"
        elif len(held(a, give)) < 2:
            out[seq] = "no spare to give"
        elif len(held(b, get)) < 2:
            out[seq] = "no spare to get"
        elif named and (owner.get(named) != a or species[named] != give):
            out[seq] = "creature gone"
        else:
            giving = named or max(held(a, give), key=age.get)
            getting = max(held(b, get), key=age.get)
            owner[giving], owner[getting] = b, a
            status[trade] = out[seq] = "accepted"
    return owner, status, out


def case(seed, hot):
    rnd = random.Random(seed)
    users, kinds = [f"u{i}" for i in range(6)], ["x", "y", "z"]
    creatures = [(f"c{i:03}", rnd.choice(users), rnd.choice(kinds), f"2024-01-{rnd.randint(1, 9):02} 0{rnd.randint(0, 9)}:00:00") for i in range(60)]
    trades = []
    for i in range(24):
        a, b = rnd.sample(users, 2)
        if hot and rnd.random() < 0.6:
            a = "u0" if b != "u0" else a
        give = rnd.choice(kinds)
        mine = [c[0] for c in creatures if c[1] == a and c[2] == give]
        named = rnd.choice(mine) if mine and rnd.random() < 0.4 else None
        trades.append((f"t{i}", a, b, give, rnd.choice(kinds), rnd.choice(["pending"] * 5 + ["declined"]), named))
    accepts = [(s, f"t{rnd.randint(0, 25)}", None) for s in rnd.sample(range(1000), 32)]
    to = {t[0]: t[2] for t in trades}
    accepts = [(s, t, to.get(t, "u1") if rnd.random() < 0.9 else "u5") for s, t, _ in accepts]
    return creatures, trades, accepts


@pytest.mark.parametrize("seed,hot", [(1, False), (2, True), (3, True), (4, True)])
def test_settlement_equals_serial(spark, seed, hot):
    creatures, trades, accepts = case(seed, hot)
    c = spark.createDataFrame(creatures, "id string, user_id string, species_id string, caught_at string").withColumn("caught_at", F.col("caught_at").cast("timestamp"))
    t = spark.createDataFrame(trades, "id string, from_id string, to_id string, give_id string, get_id string, status string, give_creature_id string")
    t = t.withColumn("resolved_at", F.lit(None).cast("timestamp"))
    a = spark.createDataFrame(accepts, "seq bigint, trade_id string, user_id string")
    done = settle_trades(c, t, a, F.lit(AS_OF).cast("timestamp"))
    owner, status, out = serial(creatures, trades, accepts)
    assert {r.seq: r.outcome for r in done.outcomes.collect()} == out
    assert {r.id: r.user_id for r in done.creatures.collect()} == owner
    assert {r.id: r.status for r in done.trades.collect()} == status


def same_as_serial(spark, creatures, trades, accepts):
    c = spark.createDataFrame(creatures, "id string, user_id string, species_id string, caught_at string").withColumn("caught_at", F.col("caught_at").cast("timestamp"))
    t = spark.createDataFrame(trades, "id string, from_id string, to_id string, give_id string, get_id string, status string, give_creature_id string")
    t = t.withColumn("resolved_at", F.lit(None).cast("timestamp"))
    a = spark.createDataFrame(accepts, "seq bigint, trade_id string, user_id string")
    done = settle_trades(c, t, a, F.lit(AS_OF).cast("timestamp"))
    owner, status, out = serial(creatures, trades, accepts)
    assert {r.seq: r.outcome for r in done.outcomes.collect()} == out
    assert {r.id: r.user_id for r in done.creatures.collect()} == owner
    assert {r.id: r.status for r in done.trades.collect()} == status
    return out


@pytest.mark.parametrize("limits", [{"FEW": -1, "MANY": 0, "WHOLE": 0}, {"FEW": -1, "MANY": 10**9}, {"FEW": 10**9, "MANY": 0, "WHOLE": 1}])
def test_settlement_equals_serial_however_passes_run(spark, monkeypatch, limits):
    """All cells or stirred ones only, whole tables or rows apart, cells carried whole or ranked; missing species."""
    for name, value in limits.items():
        monkeypatch.setattr(settlement, name, value)
    creatures, trades, accepts = case(11, True)
    trades += [("n1", "u0", "u1", None, "x", "pending", None), ("n2", "u0", "u1", "x", None, "pending", None)]
    trades += [("n3", "u0", "u1", "x", "y", "pending", "nobody's"), ("n4", "u2", "u1", None, None, "pending", None)]
    accepts += [(2000 + i, f"n{i + 1}", "u1") for i in range(4)]
    same_as_serial(spark, creatures, trades, accepts)


def test_settlement_writes_few_rows_once_few_verdicts_are_open(spark, monkeypatch):
    """A chain of 12, each link of which needs the one before, beside 600 trades that are settled at once."""
    day = "2024-01-05 00:00:00"
    creatures = [(f"y{i:02}{k}", f"u{i:02}", "y", day) for i in range(13) for k in range(3)]
    creatures += [(f"x{i:02}", f"u{i:02}", "x", day) for i in range(13)] + [("x99", "u00", "x", day)]
    trades = [(f"t{i:02}", f"u{i:02}", f"u{i + 1:02}", "x", "y", "pending", None) for i in range(12)]
    for i in range(600):
        creatures += [(f"{s}{i}{k}", u + str(i), s, day) for u, s in (("a", "v"), ("b", "w")) for k in "12"]
        trades.append((f"s{i}", f"a{i}", f"b{i}", "v", "w", "pending", None))
    accepts = [(n, t[0], t[2]) for n, t in enumerate(trades)]
    written, cut = [], settlement.cut_lineage

    def counted(frame):
        out = cut(frame)
        if "outcome" not in out.columns or "changed" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(settlement, "cut_lineage", counted)
    out = same_as_serial(spark, creatures, trades, accepts)
    assert set(out.values()) == {"accepted"}
    assert len(written) > 12 and sum(n > 100 for n in written) < 10


def test_settlement_plays_cells_once_a_pass(spark, monkeypatch):
    """No table is written by a plan that runs the timelines twice, and outcomes are all there."""
    creatures, trades, accepts = case(12, True)
    played, cut = [], settlement.cut_lineage

    def counted(frame):
        played.append(frame._jdf.queryExecution().executedPlan().toString().count("MapInArrow"))
        return cut(frame)

    monkeypatch.setattr(settlement, "cut_lineage", counted)
    out = same_as_serial(spark, creatures, trades, accepts)
    assert len(out) == len(accepts) and max(played) == 1


# first come, first served ---------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_grants_equal_serial(spark, seed):
    rnd = random.Random(seed)
    rows = [(s, rnd.choice([None, *"abcdefgh"]), rnd.choice([None, *"rstuvwxyz"])) for s in rnd.sample(range(500), 60)]
    rows = [r for r in rows if r[1] or r[2]]
    got = {r.seq for r in grant_in_order(spark.createDataFrame(rows, "seq bigint, a string, b string"), "seq", "a", "b").collect()}
    taken_a, taken_b, want = set(), set(), set()
    for s, a, b in sorted(rows):
        if a not in taken_a and b not in taken_b:
            want.add(s)
            taken_a |= {a} - {None}
            taken_b |= {b} - {None}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_renames_in_turn_equal_serial(spark, seed):
    """Swaps, names given up, names wanted by most, one diver with most of the requests."""
    rnd = random.Random(seed)
    names = {f"u{i}": f"n{i}" for i in range(8)}
    rows = [(s, rnd.choice(["u0", "u0", *names, "new"]), f"n{rnd.choice([0, 0, *range(14)])}") for s in rnd.sample(range(900), 150)]
    if seed == 3:  # a chain: each takes the name the one before has just left
        rows = [(s, f"u{7 - s % 8}", f"n{(8 - s % 8) + 8 * (s // 8)}") for s in range(24)]
    got = {r.seq for r in grant_in_turn(spark.createDataFrame(rows, "seq bigint, user_id string, key string"), spark.createDataFrame(list(names.items()), "user_id string, key string")).collect()}
    want = set()
    for s, u, n in sorted(rows):
        if all(v == u for v, m in names.items() if m == n):
            names[u] = n
            want.add(s)
    assert got == want


def test_assigned_names_equal_serial(spark):
    rnd = random.Random(5)
    wishes = ["Jeff", "jeff", "Jeff 2", "Jeff 3", " Jeff  ", "", "a/b", "Jeff the very long name indeed", None]
    rows = [(s, rnd.choice(wishes)) for s in rnd.sample(range(300), 60)]
    taken = {"jeff 4", "diver 1007"}
    users = spark.createDataFrame([(t,) for t in taken], "name string")
    got = {r.seq: r.name for r in accounts.assign_names(spark.createDataFrame(rows, "seq bigint, preferred string"), users).collect()}
    seen, want = set(taken), {}
    for s, wish in sorted(rows):
        base = (wish or "").strip()[:20].strip()
        options = [base, *[f"{base[:16].strip()} {i}" for i in range(2, 10)]] if base else []
        options = [o for o in options if "/" not in o and 2 <= len(o) <= 20]
        options += [f"Diver {s + 1000 + i * 10**12}" for i in range(4)]
        want[s] = next(o for o in options if o.lower() not in seen)
        seen.add(want[s].lower())
    assert got == want


# ordered computations in slices -----------------------------------------------


def test_positions_and_totals_across_slices(spark):
    rnd = random.Random(9)
    rows = [(s, "hot" if rnd.random() < 0.7 else rnd.choice("ab"), rnd.randint(-3, 3), f"2024-01-{s % 9 + 1:02}") for s in range(200)]
    df = spark.createDataFrame(rows, "seq bigint, k string, v int, day string")
    total = skew.running_total(df, ["k"], "seq", "v", "t", size=16)
    before = skew.previous_value(df, ["k"], "seq", "v", "p", size=16)
    place = skew.running_position(df, ["k"], [F.desc("day"), F.asc("seq")], F.col("day"), descending=True)
    sums, last, want_t, want_p = {}, {}, {}, {}
    for s, k, v, _ in rows:
        sums[k] = sums.get(k, 0) + v
        want_t[s], want_p[s], last[k] = sums[k], last.get(k), v
    assert {r.seq: r.t for r in total.collect()} == want_t
    assert {r.seq: r.p for r in before.collect()} == want_p
    want = {}
    for k in "hot", "a", "b":
        mine = sorted([r for r in rows if r[1] == k], key=lambda r: (-int(r[3][-2:]), r[0]))
        want |= {r[0]: i + 1 for i, r in enumerate(mine)}
    assert {r.seq: r.pos for r in place.collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_room_replay_equals_serial(spark, seed):
    rnd = random.Random(seed)
    events = [(s, f"r{rnd.randint(0, 3)}", f"u{rnd.randint(0, 2)}", rnd.choice(["join", "leave"])) for s in range(60)]
    members = [("r0", "u0"), ("r0", "u1"), ("r1", "u2")]
    got = rooms.replay_room_events(
        spark.createDataFrame(events, "seq bigint, room_id string, user_id string, action string"),
        spark.createDataFrame(members, "room_id string, user_id string"),
        spark.createDataFrame([("r0",), ("r1",), ("r2",)], "id string"),
    )
    alive, inside, want = {"r0", "r1", "r2"}, set(members), {}
    for s, r, u, act in events:
        if r not in alive:
            want[s] = ("no such room", None)
            continue
        was = (r, u) in inside
        (inside.add if act == "join" else inside.discard)((r, u))
        heads = sum(1 for m in inside if m[0] == r)
        if act == "join":
            want[s] = ("already in" if was else "joined", heads)
        elif heads == 0:
            alive.discard(r)
            want[s] = ("left and removed", 0)
        else:
            want[s] = ("left" if was else "was not in", heads)
    assert {r.seq: (r.outcome, r.members_after) for r in got.collect()} == want


def test_budgets_equal_serial(spark):
    rnd = random.Random(3)
    paths = ["/api/health", "/api/friends", "/api/blocks", "/api/rooms"]
    rows = [
        (i, f"2024-01-01 00:{rnd.randint(0, 40):02}:{rnd.randint(0, 59):02}", rnd.choice(["d1", "d1", "d2", None]), rnd.choice(["GET", "POST"]), rnd.choice(paths))
        for i in range(400)
    ]
    log = spark.createDataFrame(rows, "request_id bigint, ts string, limit_key string, method string, path string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.request_id: r.decision for r in throttle_decisions(log, limit=40, strict_limit=8).collect()}
    calls, strict, tight, want = {}, {}, {}, {}
    for i, ts, key, method, path in sorted(rows, key=lambda r: (r[1], r[0])):
        w = (key, int(ts[14:16]) // 15)
        if path == "/api/health":
            want[i] = "admitted"
            continue
        calls[w] = calls.get(w, 0) + 1
        tight[w] = tight.get(w, 0) + (method == "POST" and path in ("/api/friends", "/api/blocks"))
        if calls[w] > 40:
            want[i] = "throttled"
        elif method == "POST" and path in ("/api/friends", "/api/blocks"):
            strict[w] = strict.get(w, 0) + 1
            want[i] = "admitted" if strict[w] <= 8 else "throttled strictly"
        else:
            want[i] = "admitted"
    assert got == want
    over = {(r.limit_key, r.window_start.minute // 15): (r.calls, r.strict_calls) for r in budget_violations(log, limit=40, strict_limit=8).collect()}
    assert over == {w: (n, tight[w]) for w, n in calls.items() if n > 40 or tight[w] > 8}


def test_nulls_are_keys_of_running_positions(spark):
    rows = [(None, 1, "a"), (None, 2, "b"), ("k", None, "c"), ("k", 3, "d"), ("k", 4, "e")]
    df = spark.createDataFrame(rows, "k string, at int, name string")
    got = running_position(df, ["k"], [F.asc_nulls_first("at"), F.asc("name")], F.col("at"))
    assert {r.name: r.pos for r in got.collect()} == {"a": 1, "b": 2, "c": 1, "d": 2, "e": 3}
    got = previous_value(df.withColumn("seq", F.ascii("name")), ["k"], "seq", "name", "before", size=1)
    assert {r.name: r.before for r in got.collect()} == {"a": None, "b": "a", "c": None, "d": "c", "e": "d"}


def test_poison_rows_end_no_job(spark):
    dives = spark.createDataFrame([(1, "r", "u", 1e12, 50.0), (2, "r", "u", 1e300, 50.0), (3, "r", "u", 10.0, 1e300), (4, "r", "u", 10.4, 20.5)], "seq long, room_id string, user_id string, mins double, depth double")
    members = spark.createDataFrame([("r", "u")], "room_id string, user_id string")
    got = {r.seq: (r.mins, r.depth, r.reason) for r in ingest_room_dives(dives.withColumn("ts", F.current_timestamp()), members).collect()}
    assert got == {1: (None, None, "minutes out of range"), 2: (None, None, "minutes out of range"), 3: (None, None, "depth out of range"), 4: (10, 21, None)}
    columns = "type string, product_id string, entitlement_ids array<string>, app_user_id string, original_app_user_id string, transaction_id string, original_transaction_id string, expiration_at_ms double"
    events = spark.createDataFrame([("RENEWAL", "x", ["pro"], "u", None, "t", None, ms) for ms in (1e300, 1e17, -1e300, 1.7e12)], columns)
    assert sorted(r.kind for r in classify_purchases(events).collect()) == ["ignore"] * 3 + ["pro"]
    schema = StructType.fromDDL("at timestamp, n int")
    bad = conform(spark.createDataFrame([("soon", "9999999999"), ("2024-01-01 00:00:00", "7")], "at string, n string"), schema).collect()
    assert [r.n for r in bad] == [None, 7] and bad[0]["at"] is None and bad[1]["at"] is not None


def test_caught_creatures(spark):
    raw = spark.createDataFrame([(1, "u", "30", "s1", "Fin"), (2, "u", "5", None, "Fin"), (3, "v", "x", "s2", "no/slash")], "seq long, user_id string, mins string, species_id string, nickname string")
    dives = activity.ingest_dives(raw.withColumn("ts", F.lit("2024-01-01").cast("timestamp")))
    got = {(r.user_id, r.species_id, r.nickname) for r in activity.caught_creatures(dives).collect()}
    assert got == {("u", "s1", "Fin"), ("v", "s2", None)}


def test_ids_of_different_keys_differ(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "a"), ("a", None), ("", "a"), ("a", ""), ("1:a", "b"), ("1:a1:b", None)]
    got = spark.createDataFrame(rows, "x string, y string").select(minted_id("d", F.col("x"), F.col("y")).alias("id")).collect()
    assert len({r.id for r in got}) == len(rows) and all(len(r.id) == 33 for r in got)


def test_links_are_voided_by_the_next_issue(spark):
    at = lambda h: F.lit(f"2024-01-01 {h:02}:00:00").cast("timestamp")
    links = spark.createDataFrame([("old", 8), ("new", 10)], "token string, hour int").select(
        token_hash(F.col("token")).alias("token_hash"), F.lit("u").alias("user_id"), F.lit("m@x").alias("email"),
        F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), "hour", F.lit(0), F.lit(0)).alias("created_at"), at(20).alias("expires_at"),
    )
    asks = spark.createDataFrame([(1, 7, "old"), (2, 9, "new"), (3, 11, "old"), (4, 12, "new")], "seq long, hour int, token string").withColumn(
        "ts", F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), "hour", F.lit(0), F.lit(0))
    )
    users = spark.createDataFrame([("u", "M@x")], "id string, email string")
    assert {r.seq: r.outcome for r in redeem_links(asks, links, users).collect()} == {1: "expired", 2: "expired", 3: "expired", 4: "confirmed"}


def test_every_request_gets_a_name(spark):
    taken = [f"Diver {1007 + i * 10**12}" for i in range(4)]
    users = spark.createDataFrame([(str(k), n) for k, n in enumerate(taken)], "id string, name string")
    got = assign_names(spark.createDataFrame([(7, None)], "seq long, preferred string"), users).collect()
    assert len(got) == 1 and got[0]["name"].startswith("Diver ") and got[0]["name"] not in taken and len(got[0]["name"]) <= 20


# leaderboard ------------------------------------------------------------------


@pytest.mark.parametrize("shared", [1, 12, 10_000])
def test_visible_top_is_exact_for_heavy_hiders(spark, shared, monkeypatch):
    monkeypatch.setattr(leaderboard, "BROADCAST_PLACES", shared)
    rnd = random.Random(4)
    users = [(f"u{i:03}", rnd.randint(0, 20)) for i in range(120)]
    order = sorted(users, key=lambda u: (-u[1], u[0]))
    hidden = [("heavy", u[0]) for u in order[:97]] + [("all", u[0]) for u in users]
    hidden += [(v, t[0]) for v in ("u001", "u002") for t in rnd.sample(users, 15)]
    viewers = ["heavy", "all", "u001", "u002", "u003"]
    got = visible_top(
        spark.createDataFrame([(v,) for v in viewers], "viewer_id string"),
        [F.desc("score"), F.asc("id")],
        spark.createDataFrame(users, "id string, score int"),
        spark.createDataFrame(hidden, "viewer_id string, target_id string"),
        k=10,
    )
    shown = {}
    for r in got.collect():
        shown.setdefault(r.viewer_id, {})[r["rank"]] = r.id
    for v in viewers:
        want = [u[0] for u in order if (v, u[0]) not in set(hidden)][:10]
        assert [shown.get(v, {}).get(i + 1) for i in range(len(want))] == want
        assert len(shown.get(v, {})) == len(want)


def test_visible_top_for_one_who_hides_a_million(spark):
    n = 1_000_000
    users = spark.range(n + 30).select(F.col("id").cast("string").alias("id"), (-F.col("id")).alias("score"))
    hidden = spark.range(n).select(F.lit("heavy").alias("viewer_id"), F.col("id").cast("string").alias("target_id"))
    viewers = spark.createDataFrame([("heavy",), ("other",)], "viewer_id string")
    got = visible_top(viewers, [F.desc("score"), F.asc("id")], users, hidden, k=25)
    assert sorted((r.viewer_id, r["rank"], int(r.id)) for r in got.collect()) == [
        *(("heavy", k, n + k - 1) for k in range(1, 26)), *(("other", k, k - 1) for k in range(1, 26))
    ]


def test_range_positions_of_one_key_and_one_instant(spark, monkeypatch):
    """A key that all rows share, at one instant: many partitions, right positions and totals."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise("hot").alias("k"), F.lit(AS_OF).alias("at"), ((F.col("id") * 7919) % 60_013).alias("v")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    written = []
    monkeypatch.setattr(ranges, "cut_lineage", lambda df: written.append(cut_lineage(df)) or written[-1])
    try:
        placed = range_position(rows, ["k"], [F.asc("at"), F.asc("v")], "pos", "n")
        parts = written[0].filter("k = 'hot'").select(F.input_file_name().alias("p")).distinct().count()
        got = placed.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert parts > 4
    for key, n in (("hot", 40_000), (None, 20_000)):
        own = sorted((r.pos, r.v) for r in got if r.k == key)
        assert [p for p, _ in own] == list(range(1, n + 1)) and [v for _, v in own] == sorted(v for _, v in own)
        assert {r.n for r in got if r.k == key} == {n}
    assert range_position(rows.limit(0), ["k"], [F.asc("v")]).count() == 0
    whole = {r.v: r.pos for r in range_position(rows, [], [F.desc("v")]).collect()}
    assert [whole[v] for v in sorted(whole, reverse=True)] == list(range(1, 60_001))


def test_null_keys_stay_out_of_the_shuffle(spark):
    left = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("k"))
    right = spark.range(0, 20_000, 4).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = left_join_known(left, right, ["k"])
        got = {r.id: (r.k, r.v) for r in joined.collect()}
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {i: (str(i) if i % 2 == 0 else None, 2 * i if i % 4 == 0 else None) for i in range(20_000)}
    # one half is joined, the other, with the ten thousand nulls, goes round the join
    top, joining, beside = plan.partition("Join LeftOuter")[0], plan.partition("Join LeftOuter")[2], plan.rpartition("Project")[2]
    assert "Union" in top and "% 2) = 0" in joining and "Join" not in beside and "% 2) = 0" in beside


def test_links_issued_anew_void_older_ones(spark):
    links = spark.createDataFrame([("a", "u1", "m"), ("b", "u2", "m"), ("c", "u3", "m")], "token_hash string, user_id string, email string")
    links = links.withColumns({"created_at": F.lit(AS_OF).cast("timestamp"), "expires_at": F.lit("2024-02-02").cast("timestamp")})
    users = spark.createDataFrame([("u1", "A@x"), ("u2", None), ("u3", "c@x")], "id string, email string")
    asks = spark.createDataFrame([(1, "u1", "t1"), (2, "u1", "t2"), (3, "u2", "t3"), (4, "nobody", "t4"), (5, None, "t5")], "seq bigint, user_id string, token string")
    asks = asks.withColumn("ts", F.lit("2024-02-01 12:00:00").cast("timestamp"))
    got = {(r.user_id, r.token_hash, r.email, str(r.expires_at)) for r in accounts.issue_links(links, asks, users).collect()}
    fresh = spark.range(1).select(token_hash(F.lit("t2"))).first()[0]
    assert got == {("u1", fresh, "a@x", "2024-02-02 12:00:00"), ("u2", "b", "m", "2024-02-02 00:00:00"), ("u3", "c", "m", "2024-02-02 00:00:00")}


def test_paged_participants_keep_everybody(spark):
    members = spark.createDataFrame([("hot", f"u{i}") for i in range(500)] + [("r", "u1")], "room_id string, user_id string")
    users = spark.createDataFrame([(f"u{i}",) for i in range(500)], "id string").selectExpr("id", "'U' initial", "'#fff' avatar_bg")
    pages = rooms.room_participants(members, users, page_size=50).collect()
    hot = [r for r in pages if r.room_id == "hot"]
    assert sum(len(r.participants) for r in hot) == 500 and len(hot) == 10
    assert max(len(r.participants) for r in hot) < 100
    assert [(r.page, len(r.participants)) for r in pages if r.room_id == "r"] == [(0, 1)]


def test_spells_merge_across_hours(spark):
    rows = [("u", f"2024-01-01 {t}") for t in ("10:57:00", "10:59:30", "11:01:00", "11:04:00", "11:09:00", "12:30:00")]
    df = spark.createDataFrame(rows, "user_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((str(r.started)[11:], str(r.ended)[11:], r.dives) for r in activity.activity_spells(df).collect())
    assert got == [("10:57:00", "11:14:00", 5), ("12:30:00", "12:35:00", 1)]
