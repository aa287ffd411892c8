"""Trades."""

from pyspark.sql import functions as F

from lagoon.operators import trades as op
from lagoon.plans.settlement import settle_trades
from lagoon.registry import query
from lagoon.registry.views import AS_OF_SQL, N
from lagoon.sources.domain import AS_OF, instant, uid

SIDES = """
  sides AS (SELECT to_id AS user_id, 'incoming' AS side, from_id AS other, * FROM trades WHERE status = 'pending'
            UNION ALL SELECT from_id, 'outgoing', to_id, * FROM trades WHERE status = 'pending')"""


def _list_sql(where: str) -> str:
    return f"""WITH {SIDES}
  SELECT s.user_id, side, row_number() OVER (PARTITION BY s.user_id, side ORDER BY s.created_at DESC, s.id) AS pos,
         s.id, from_id, to_id, f.name AS from_name, f.initial AS from_initial, f.avatar_bg AS from_bg,
         t.name AS to_name, give_id, get_id, status, s.created_at
  FROM sides s JOIN accounts f ON f.id = from_id JOIN accounts t ON t.id = to_id {where}"""


@query("trade_lists", _list_sql(""))
def trade_lists(d):
    return op.trade_lists(d.trades, d.accounts)


@query(
    "trade_lists_hiding_blocked",
    _list_sql("WHERE NOT EXISTS (SELECT 1 FROM closure c WHERE c.viewer_id = s.user_id AND c.target_id = s.other)"),
)
def trade_lists_hiding_blocked(d):
    return op.trade_lists(d.trades, d.accounts, d.blocks, hide_blocked=True)


@query(
    "trades_with_both_spares",
    """SELECT t.id, t.from_id, t.to_id FROM trades t
       JOIN collections a ON a.user_id = from_id AND a.species_id = give_id AND a.n > 1
       JOIN collections b ON b.user_id = to_id AND b.species_id = get_id AND b.n > 1
       WHERE status = 'pending'""",
)
def trades_with_both_spares(d):
    return op.trades_with_both_spares(d.trades, d.user_creatures).select("id", "from_id", "to_id")


# Every order proposes a trade; block pairs, missing fields, self offers and foreign creatures occur.
PROPOSALS = f"""
  proposals AS (
    SELECT o_orderkey AS request_id, 'u' || o_custkey AS from_id,
           CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'u' || o_custkey
                WHEN 2 THEN 'u' || ((5 * o_custkey + 2) % {N}) ELSE 'u' || ((3 * o_custkey + 1) % {N}) END AS to_id,
           lower(o_orderpriority) AS give_id,
           CASE WHEN o_orderkey % 37 = 5 THEN NULL
                ELSE list_extract(['1-urgent', '2-high', '3-medium', '4-not specified', '5-low'],
                                  CAST(o_orderkey % 5 AS INTEGER) + 1) END AS get_id,
           CASE o_orderkey % 4 WHEN 0 THEN 'c' || o_orderkey WHEN 1 THEN 'c' || (o_orderkey + 1) WHEN 2 THEN '' END
             AS give_creature_id
    FROM orders)"""


def proposals(d):
    k, c, n = F.col("o_orderkey"), F.col("o_custkey"), d.n_customers
    species = F.array(*[F.lit(x) for x in ("1-urgent", "2-high", "3-medium", "4-not specified", "5-low")])
    creature = lambda x: F.concat(F.lit("c"), x.cast("string"))
    return d.raw("orders").select(
        k.alias("request_id"),
        uid("o_custkey").alias("from_id"),
        F.when(k % 9 == 0, "").when(k % 9 == 1, uid(c)).when(k % 9 == 2, uid((5 * c + 2) % n))
        .otherwise(uid((3 * c + 1) % n)).alias("to_id"),
        F.lower("o_orderpriority").alias("give_id"),
        F.when(k % 37 != 5, F.element_at(species, (k % 5 + 1).cast("int"))).alias("get_id"),
        F.when(k % 4 == 0, creature(k)).when(k % 4 == 1, creature(k + 1)).when(k % 4 == 2, "").alias("give_creature_id"),
    )


@query(
    "validate_trades",
    f"""WITH {PROPOSALS}
  SELECT request_id, p.from_id, p.to_id, p.give_id, p.get_id, nullif(give_creature_id, '') AS give_creature_id,
         CASE WHEN coalesce(p.to_id, '') = '' OR coalesce(p.give_id, '') = '' OR coalesce(p.get_id, '') = ''
                   THEN 'fields missing'
              WHEN p.to_id = p.from_id THEN 'self'
              WHEN EXISTS (SELECT 1 FROM closure c WHERE c.viewer_id = p.from_id AND c.target_id = p.to_id) THEN 'blocked'
              WHEN coalesce(a.n, 0) < 2 THEN 'no spare to give'
              WHEN coalesce(b.n, 0) < 2 THEN 'no spare to get'
              WHEN nullif(give_creature_id, '') IS NOT NULL AND NOT EXISTS (
                     SELECT 1 FROM user_creatures u WHERE u.id = give_creature_id AND u.user_id = p.from_id
                       AND u.species_id = p.give_id) THEN 'creature not yours' END AS reason
  FROM proposals p LEFT JOIN collections a ON a.user_id = p.from_id AND a.species_id = p.give_id
  LEFT JOIN collections b ON b.user_id = p.to_id AND b.species_id = p.get_id""",
)
def validate_trades(d):
    return op.validate_trades(proposals(d), d.user_creatures, d.blocks)


@query(
    "apply_declines",
    f"""SELECT id, CASE WHEN status = 'pending' AND seq % 3 <> 0 THEN 'declined' ELSE status END AS status,
               CASE WHEN status = 'pending' AND seq % 3 <> 0 THEN {AS_OF_SQL} ELSE resolved_at END AS resolved_at
        FROM trades""",
)
def apply_declines(d):
    # A stranger, the recipient or the proposer asks, by turns.
    turn = F.col("seq") % 3
    decisions = d.trades.select(
        F.col("id").alias("trade_id"),
        F.when(turn == 0, "nobody").when(turn == 1, F.col("to_id")).otherwise(F.col("from_id")).alias("user_id"),
    )
    return op.apply_declines(d.trades, decisions, instant(AS_OF)).select("id", "status", "resolved_at")


def acceptances(d, trades):
    """Every trade is accepted, one in seven by a stranger first."""
    twice = F.array(F.lit(0), F.lit(1))
    return trades.select("seq", "id", "to_id", F.explode(twice).alias("turn")).filter(
        (F.col("turn") == 1) | (F.col("seq") % 7 == 0)
    ).select(
        (F.col("seq") * 2 + F.col("turn")).alias("seq"),
        F.col("id").alias("trade_id"),
        F.when(F.col("turn") == 0, "nobody").otherwise(F.col("to_id")).alias("user_id"),
    )


# Round by round, all acceptances that come first in each of their cells, until none is open.
SERIAL = """
  asked AS MATERIALIZED (
    SELECT 2 * seq + turn AS seq, id AS trade_id, CASE WHEN turn = 0 THEN 'nobody' ELSE to_id END AS user_id
    FROM trades, (SELECT unnest([0, 1]) AS turn) WHERE turn = 1 OR seq % 7 = 0),
  queue AS MATERIALIZED (
    SELECT a.seq, a.trade_id, t.from_id, t.to_id, t.give_id, t.get_id, t.give_creature_id,
           list_distinct([from_id || '|' || give_id, from_id || '|' || get_id, to_id || '|' || give_id, to_id || '|' || get_id]) AS cells
    FROM asked a JOIN trades t ON t.id = a.trade_id WHERE t.status = 'pending' AND t.to_id = a.user_id),
  asking AS MATERIALIZED (
    SELECT from_id AS u, give_id AS s FROM queue UNION SELECT to_id, get_id FROM queue),
  play(k, kind, seq, u, s, born, id, outcome, giving, getting) USING KEY (k) AS (
    SELECT 'c' || id, 'c', CAST(NULL AS BIGINT), user_id, species_id, caught_at, id, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
    FROM user_creatures JOIN asking ON u = user_id AND s = species_id
    UNION ALL
    SELECT 'x' || seq, 'x', seq, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM queue
    UNION
    (WITH open AS MATERIALIZED (SELECT q.* FROM recurring.play p JOIN queue q ON q.seq = p.seq WHERE p.kind = 'x' AND p.outcome IS NULL AND EXISTS (SELECT 1 FROM play)),
      spread AS (SELECT seq, unnest(cells) AS cell FROM open),
      firsts AS (SELECT cell, min(seq) AS seq FROM spread GROUP BY cell),
      ready AS (SELECT o.* FROM open o JOIN (SELECT seq, count(*) AS n FROM firsts GROUP BY seq) f ON f.seq = o.seq AND f.n = len(o.cells)),
      stock AS (SELECT u, s, count(*) AS n, max(CAST({'born': born, 'id': id} AS STRUCT(born TIMESTAMP, id VARCHAR))) AS newest FROM recurring.play WHERE kind = 'c' GROUP BY u, s),
      judged AS MATERIALIZED (
        SELECT r.*, CASE WHEN coalesce(a.n, 0) < 2 THEN 'no spare to give' WHEN coalesce(b.n, 0) < 2 THEN 'no spare to get'
                         WHEN r.give_creature_id IS NOT NULL AND o.id IS NULL THEN 'creature gone' ELSE 'accepted' END AS outcome,
               coalesce(r.give_creature_id, a.newest.id) AS giving, b.newest.id AS getting
        FROM ready r LEFT JOIN stock a ON a.u = r.from_id AND a.s = r.give_id LEFT JOIN stock b ON b.u = r.to_id AND b.s = r.get_id
        LEFT JOIN (SELECT id, u, s FROM recurring.play WHERE kind = 'c') o ON o.id = r.give_creature_id AND o.u = r.from_id AND o.s = r.give_id),
      moves AS (SELECT giving AS id, to_id AS u FROM judged WHERE outcome = 'accepted' UNION ALL SELECT getting, from_id FROM judged WHERE outcome = 'accepted')
    SELECT 'x' || seq, 'x', seq, NULL, NULL, NULL, NULL, outcome, CASE WHEN outcome = 'accepted' THEN giving END, CASE WHEN outcome = 'accepted' THEN getting END FROM judged
    UNION ALL
    SELECT 'x' || o.seq, 'x', o.seq, NULL, NULL, NULL, NULL, 'no such pending trade', NULL, NULL
    FROM open o JOIN judged j ON j.trade_id = o.trade_id AND j.seq < o.seq AND j.outcome = 'accepted'
    UNION ALL
    SELECT p.k, 'c', NULL, m.u, p.s, p.born, p.id, NULL, NULL, NULL FROM recurring.play p JOIN moves m ON m.id = p.id WHERE p.kind = 'c'))"""


@query(
    "settle_trades",
    f"""WITH RECURSIVE {SERIAL},
  won AS (SELECT q.trade_id, p.seq FROM play p JOIN queue q ON q.seq = p.seq WHERE p.outcome = 'accepted')
  SELECT a.trade_id, a.seq,
         CASE WHEN p.seq IS NOT NULL THEN p.outcome WHEN t.status = 'pending' AND NOT coalesce(a.seq > w.seq, false) THEN 'not the recipient'
              ELSE 'no such pending trade' END AS outcome, p.giving, p.getting
  FROM asked a JOIN trades t ON t.id = a.trade_id LEFT JOIN won w ON w.trade_id = a.trade_id
  LEFT JOIN (SELECT seq, outcome, giving, getting FROM play WHERE kind = 'x') p ON p.seq = a.seq""",
)
def settle_trades_outcomes(d):
    trades = d.trades
    out = settle_trades(d.user_creatures, trades, acceptances(d, trades), instant(AS_OF))
    return out.outcomes


@query(
    "settled_creatures",
    f"""WITH RECURSIVE {SERIAL}
  SELECT c.id, coalesce(p.u, c.user_id) AS user_id, c.species_id, c.nickname, c.caught_at
  FROM user_creatures c LEFT JOIN (SELECT id, u FROM play WHERE kind = 'c') p ON p.id = c.id""",
)
def settled_creatures(d):
    trades = d.trades
    return settle_trades(d.user_creatures, trades, acceptances(d, trades), instant(AS_OF)).creatures


# Without shared cells every acceptance sees the original stock, which plain SQL can say.
LONE = """
  pending AS (SELECT * FROM trades WHERE status = 'pending'),
  cells AS (SELECT seq, unnest(list_distinct([from_id || '|' || give_id, from_id || '|' || get_id,
                                              to_id || '|' || give_id, to_id || '|' || get_id])) AS cell FROM pending),
  shared AS (SELECT cell FROM cells GROUP BY 1 HAVING count(*) > 1),
  lone AS (SELECT * FROM pending WHERE seq NOT IN (SELECT seq FROM cells WHERE cell IN (SELECT cell FROM shared))),
  newest AS (SELECT user_id, species_id, count(*) AS n, max(caught_at) AS latest FROM user_creatures GROUP BY 1, 2),
  pick AS (SELECT n.user_id, n.species_id, n.n, max(c.id) AS id FROM newest n JOIN user_creatures c
             ON c.user_id = n.user_id AND c.species_id = n.species_id AND c.caught_at = n.latest GROUP BY 1, 2, 3),
  judged AS (
    SELECT t.*, CASE WHEN coalesce(a.n, 0) < 2 THEN 'no spare to give' WHEN coalesce(b.n, 0) < 2 THEN 'no spare to get'
                     WHEN give_creature_id IS NOT NULL AND o.id IS NULL THEN 'creature gone'
                     ELSE 'accepted' END AS outcome,
           coalesce(t.give_creature_id, a.id) AS giving, b.id AS getting
    FROM lone t LEFT JOIN pick a ON a.user_id = from_id AND a.species_id = give_id
    LEFT JOIN pick b ON b.user_id = to_id AND b.species_id = get_id
    LEFT JOIN user_creatures o ON o.id = t.give_creature_id AND o.user_id = t.from_id AND o.species_id = t.give_id)"""


@query(
    "settle_lone_trades",
    f"""WITH {LONE},
  moves AS (SELECT giving AS id, to_id AS owner FROM judged WHERE outcome = 'accepted'
            UNION ALL SELECT getting, from_id FROM judged WHERE outcome = 'accepted')
  SELECT c.id, coalesce(m.owner, c.user_id) AS user_id, c.species_id, c.nickname, c.caught_at
  FROM user_creatures c LEFT JOIN moves m ON m.id = c.id""",
)
def settle_lone_trades(d):
    pending = d.trades.filter("status = 'pending'")
    who = [("from_id", "give_id"), ("from_id", "get_id"), ("to_id", "give_id"), ("to_id", "get_id")]
    cells = F.array_distinct(F.array(*[F.concat_ws("|", a, b) for a, b in who]))
    spread = pending.select("seq", F.explode(cells).alias("cell"))
    shared = spread.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    clash = spread.join(shared, "cell", "left_semi").select("seq").distinct()
    lone = pending.join(clash, "seq", "left_anti")
    accept = lone.select("seq", F.col("id").alias("trade_id"), F.col("to_id").alias("user_id"))
    return settle_trades(d.user_creatures, lone, accept, instant(AS_OF)).creatures
