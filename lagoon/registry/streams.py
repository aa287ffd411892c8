"""Streams run to their end over the given tables, cut into files that arrive one by one; the checks are those of the batch twins."""

from pyspark.sql import functions as F

from lagoon import schemas
from lagoon.operators import activity, purchases
from lagoon.registry import query
from lagoon.registry.purchases import EFFECTS
from lagoon.session import scratch_path
from lagoon.sources.domain import Domain
from lagoon.streaming import streams as st

#: Files that a table arrives in, each a micro-batch.
ARRIVALS = 5


class Arriving(Domain):
    """The fixture domain with one table as a stream of files: in the order of its key, or dealt out against it."""

    def __init__(self, spark, folder, table, key, in_order=False):
        super().__init__(spark, folder)
        self.table, self.key, self.in_order = table, key, in_order

    def raw(self, name):
        if name != self.table:
            return super().raw(name)
        rows, place = super().raw(name), scratch_path(self.spark, "arrivals")
        if self.in_order:
            edges = rows.approxQuantile(self.key, [k / ARRIVALS for k in range(1, ARRIVALS)], 0.01)
            turn = sum((F.col(self.key) >= e).cast("int") for e in edges) if edges else F.lit(0)
        else:
            turn = F.pmod(F.xxhash64(self.key), F.lit(ARRIVALS))
        staged = rows.withColumn("_turn", turn)
        for k in range(ARRIVALS):
            staged.filter(F.col("_turn") == k).drop("_turn").coalesce(1).write.mode("append").parquet(place)
        return st.parquet_stream(self.spark, place, schemas.INPUTS[name], per_trigger=1)


def events(d, in_order=False):
    return Arriving(d.spark, d.folder, "events", "event_id", in_order)


def line_items(d):
    return Arriving(d.spark, d.folder, "lineitem", "l_orderkey")


def places(d, label):
    return scratch_path(d.spark, label), scratch_path(d.spark, f"{label}-offsets")


def folded(d, stream, part, fold, label):
    out, offsets = places(d, label)
    st.keep(stream, lambda df, n: part(df), fold, out, offsets)
    return st.read(d.spark, out, fold)


@query("stream_ledger", f"WITH {EFFECTS} SELECT * FROM grants")
def stream_ledger(d):
    out, offsets = places(d, "ledger")
    st.keep_ledger(purchases.classify_purchases(events(d, in_order=True).purchase_events), out, offsets)
    return st.read_ledger(d.spark, out)


@query("stream_pro_state", f"WITH {EFFECTS} SELECT * FROM state")
def stream_pro_state(d):
    out, offsets = places(d, "pro")
    st.keep_pro_state(purchases.classify_purchases(events(d, in_order=True).purchase_events), out, offsets)
    return st.read_pro_state(d.spark, out)


@query(
    "stream_weekly_totals",
    """SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week_start, CAST(sum(mins) AS BIGINT) AS week_mins
       FROM dives GROUP BY 1, 2""",
)
def stream_weekly_totals(d):
    return folded(d, events(d).dives, st.weekly_totals, st.WEEKLY, "weekly")


@query(
    "stream_budget_violations",
    """SELECT * FROM (SELECT device_key AS limit_key, time_bucket(INTERVAL 15 MINUTE, ts) AS window_start,
           count(*) FILTER (path <> 'error') AS calls,
           count(*) FILTER (method = 'POST' AND path IN ('signup', 'view', 'purchase')) AS strict_calls
         FROM auth_log GROUP BY 1, 2) WHERE calls > 1 OR strict_calls > 0""",
)
def stream_budget_violations(d):
    log = events(d).auth_log.select("ts", F.col("device_key").alias("limit_key"), "method", "path")
    strict = [("POST", p) for p in ("signup", "view", "purchase")]
    counts = lambda rows: st.call_counts(rows, strict=strict, exempt=["error"])
    return folded(d, log, counts, st.CALLS, "calls").filter("calls > 1 or strict_calls > 0")


@query("stream_last_seen", "SELECT user_id, max(ts) AS last_seen FROM dives GROUP BY 1")
def stream_last_seen(d):
    return folded(d, events(d).dives, st.last_seen, st.SEEN, "seen")


@query(
    "stream_room_progress",
    """SELECT room_id, count(*) AS dives, CAST(sum(mins) AS BIGINT) AS total_mins, CAST(sum(depth) AS BIGINT) AS shared_depth
       FROM room_dives GROUP BY 1""",
)
def stream_room_progress(d):
    return folded(d, line_items(d).room_dives_by_room, st.running_progress, st.PROGRESS, "progress")


@query(
    "stream_gated_dives",
    """SELECT room_id, user_id, mins, depth, ts FROM room_dives r
       WHERE EXISTS (SELECT 1 FROM room_members m WHERE m.room_id = r.room_id AND m.user_id = r.user_id)""",
)
def stream_gated_dives(d):
    live = line_items(d).room_dives.drop("ln")
    return folded(d, st.gate_by_membership(live, d.room_members), lambda rows: rows.select("room_id", "user_id", "mins", "depth", "ts"), st.GATED, "gated")


@query(
    "stream_activity_spells",
    """SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 5 MINUTE AS ended, count(*) AS dives FROM (
         SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, seq) AS spell FROM (
           SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, seq) + INTERVAL 5 MINUTE
                          THEN 0 ELSE 1 END AS fresh FROM dives))
       GROUP BY user_id, spell""",
)
def stream_activity_spells(d):
    return folded(d, events(d).dives, activity.activity_spells, st.SPELLS, "spells")
