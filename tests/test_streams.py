"""Several micro-batches, shuffled input, restarts and replays: streams equal their batch twins."""

import pytest
from pyspark.sql import functions as F

from lagoon import schemas
from lagoon.operators import activity, purchases
from lagoon.sources.domain import Domain
from lagoon.streaming import streams as st
from lagoon.streaming.folds import Fold, FoldTable


class Folder(Domain):
    """Events from a folder of many small files, in arrival order."""

    def raw(self, name):
        if name == "events":
            return st.parquet_stream(self.spark, self.events, schemas.INPUTS[name], per_trigger=1)
        return super().raw(name)


@pytest.fixture()
def live(spark, small, tmp_path):
    d = Folder(spark, small)
    d.events = str(tmp_path / "arrivals")
    d.batch = Domain(spark, small)
    d.out, d.offsets = str(tmp_path / "out"), str(tmp_path / "offsets")
    d.add = lambda i, n=4: d.batch.raw("events").filter(F.floor(F.col("event_id") * n / 1000) == i).coalesce(1).write.mode("append").parquet(d.events)
    return d


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_ledger_pays_once_over_batches_restarts_and_replays(spark, live):
    assert live.batch.raw("events").count() == 1000
    stream = lambda: purchases.classify_purchases(live.purchase_events)
    for i in range(2):
        live.add(i)
    st.keep_ledger(stream(), live.out, live.offsets)
    for i in range(2, 4):
        live.add(i)
    st.keep_ledger(stream(), live.out, live.offsets)
    want = rows(purchases.pearl_grants(purchases.classify_purchases(live.batch.purchase_events)))
    assert rows(st.read_ledger(spark, live.out)) == want
    # A fresh checkpoint replays everything under the same batch ids.
    st.keep_ledger(stream(), live.out, live.offsets + "-again")
    assert rows(st.read_ledger(spark, live.out)) == want


def test_pro_state_over_batches(spark, live):
    for i in range(4):
        live.add(i)
    st.keep_pro_state(purchases.classify_purchases(live.purchase_events), live.out, live.offsets)
    want = purchases.pro_state(purchases.classify_purchases(live.batch.purchase_events))
    assert rows(st.read_pro_state(spark, live.out)) == rows(want)


def folded(live, stream, part, fold, *order):
    for i in order:
        live.add(i, len(order))
    st.keep(stream(), lambda df, n: part(df), fold, live.out, live.offsets)
    return st.read(live.spark, live.out, fold)


def test_weekly_totals_on_disordered_input(live):
    got = folded(live, lambda: live.dives, st.weekly_totals, st.WEEKLY, 2, 0, 3, 1)
    assert rows(got) == rows(st.weekly_totals(live.batch.dives))


def test_budgets_on_disordered_input(live):
    log = lambda d: d.auth_log.select("ts", F.col("device_key").alias("limit_key"), "method", "path")
    got = folded(live, lambda: log(live), st.call_counts, st.CALLS, 3, 2, 1, 0)
    assert rows(got) == rows(st.call_counts(log(live.batch)))


def test_last_seen_over_batches(live):
    got = folded(live, lambda: live.dives, st.last_seen, st.SEEN, 0, 1, 2, 3)
    assert rows(got) == rows(activity.last_active(live.batch.dives))


def test_spells_over_ten_batches_out_of_order(live):
    got = folded(live, lambda: live.dives, activity.activity_spells, st.SPELLS, 3, 0, 9, 1, 7, 2, 8, 6, 4, 5)
    assert rows(got) == rows(activity.activity_spells(live.batch.dives))


SUMS = Fold("k string, n bigint", lambda df: df.groupBy("k").agg(F.sum("n").alias("n")))


def test_many_batches_leave_few_folders(spark, tmp_path):
    table = FoldTable(spark, str(tmp_path / "t"), SUMS, fan=3)
    batch = lambda n: spark.createDataFrame([(f"k{n % 4}", n), ("all", 1)], SUMS.ddl)
    total = lambda n: {("all", n), *((f"k{r}", sum(range(r, n, 4))) for r in range(min(4, n)))}
    assert table.read().count() == 0
    for n in range(30):
        table.write(batch(n), n)
        if n in (0, 8, 9, 17, 26, 29):
            assert set(map(tuple, table.read().collect())) == total(n + 1)
            assert len(table.covering(n)) <= 7 and len(table._parts()) <= 18
            table.write(batch(n), n)  # the batch is replayed, carries and all
            assert set(map(tuple, table.read().collect())) == total(n + 1)
    assert table.covering(29) == [(3, 26), (1, 29)]
    for n in range(30):  # all of it, from a fresh checkpoint
        table.write(batch(n), n)
    assert set(map(tuple, table.read().collect())) == total(30)


def test_parts_of_a_thousand_batches(spark, tmp_path, monkeypatch):
    table = FoldTable(spark, str(tmp_path), SUMS)
    there = {(level, last) for level in range(4) for last in range(10**level - 1, 1200, 10**level)}
    monkeypatch.setattr(table, "_parts", lambda: there)
    for n in (0, 9, 99, 998, 999, 1005, 1198):
        parts = table.covering(n)
        assert len(parts) <= 28 and sum(10**level for level, _ in parts) == n + 1
        assert [last for _, last in parts] == sorted(last for _, last in parts) and parts[-1][1] == n
    there -= {(0, 3), (0, 1005)}
    assert sum(10**level for level, _ in table.covering(1005)) == 1005


def test_json_webhooks(spark, tmp_path):
    lines = ['{"event":{"type":"RENEWAL","app_user_id":"u1","entitlement_ids":["pro"],"expiration_at_ms":1900000000000}}', "{oops"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    out = str(tmp_path / "out")
    st.run_batches(st.purchase_stream(spark, str(tmp_path / "in")), lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "o"))
    got = spark.read.parquet(out).orderBy("type").collect()
    assert [r.type for r in got] == [None, "RENEWAL"] and got[0]._corrupt_record == "{oops"
