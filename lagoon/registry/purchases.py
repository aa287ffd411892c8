"""Purchases, ledger, entitlements."""

from pyspark.sql import functions as F

from lagoon.operators import purchases as op
from lagoon.registry import query
from lagoon.registry.views import AS_OF_SQL
from lagoon.sources.domain import AS_OF, instant
from lagoon.sources.files import append_new

CATALOGUE_SQL = ", ".join(f"('{p}', '{k}', {n})" for p, k, n in op.CATALOGUE)

EFFECTS = f"""
  catalogue(product, sort, worth) AS (VALUES {CATALOGUE_SQL}),
  typed AS (SELECT e.*, upper(type) AS t, c.sort, c.worth,
                   coalesce(nullif(app_user_id, ''), nullif(original_app_user_id, '')) AS user_id,
                   nullif(coalesce(transaction_id, original_transaction_id), '') AS tx,
                   has_pro OR coalesce(sort IN ('lifetime', 'subscription'), false) AS grants,
                   coalesce(sort = 'lifetime', false) AS forever
            FROM purchase_events e LEFT JOIN catalogue c ON c.product = e.product_id),
  sorted AS (SELECT *, CASE
        WHEN t IN ('INITIAL_PURCHASE', 'RENEWAL') AND grants AND (forever OR coalesce(expiration_at_ms, 0) <> 0) THEN 'pro'
        WHEN t = 'NON_RENEWING_PURCHASE' AND forever THEN 'pro'
        WHEN t = 'NON_RENEWING_PURCHASE' AND sort = 'pearls' AND tx IS NOT NULL THEN 'pearls'
        WHEN t = 'EXPIRATION' THEN 'pro' ELSE 'ignore' END AS kind FROM typed),
  effects AS (SELECT seq, ts, user_id, kind,
        CASE WHEN kind = 'pro' THEN forever AND t <> 'EXPIRATION' END AS lifetime,
        CASE WHEN kind = 'pro' AND NOT forever AND t <> 'EXPIRATION' THEN make_timestamp(expiration_at_ms * 1000) END AS until,
        CASE WHEN kind = 'pearls' THEN tx END AS transaction_id,
        CASE WHEN kind = 'pearls' THEN product_id END AS product_id,
        CASE WHEN kind = 'pearls' THEN worth END AS pearls,
        CASE WHEN kind = 'ignore' THEN CASE
          WHEN t IN ('INITIAL_PURCHASE', 'RENEWAL') AND NOT grants THEN 'not entitling'
          WHEN t IN ('INITIAL_PURCHASE', 'RENEWAL') THEN 'no usable expiry'
          WHEN t = 'NON_RENEWING_PURCHASE' AND coalesce(sort, '') <> 'pearls' THEN 'not in catalogue'
          WHEN t = 'NON_RENEWING_PURCHASE' THEN 'transaction missing'
          WHEN t = 'CANCELLATION' THEN 'access unchanged'
          ELSE 'payment pending' END END AS reason
      FROM sorted),
  grants AS (SELECT transaction_id, user_id, product_id, pearls, ts AS created_at FROM (
        SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY seq) AS rn FROM effects
        WHERE kind = 'pearls' AND user_id IS NOT NULL) WHERE rn = 1),
  last_pro AS (SELECT user_id, until AS pro_until FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn FROM effects
        WHERE kind = 'pro' AND user_id IS NOT NULL) WHERE rn = 1),
  state AS (SELECT user_id, pro_until, pro_lifetime, seq FROM last_pro JOIN (
        SELECT user_id, bool_or(lifetime) AS pro_lifetime, max(seq) AS seq FROM effects
        WHERE kind = 'pro' GROUP BY 1) USING (user_id))"""


def effects(d):
    return op.classify_purchases(d.purchase_events)


@query(
    "parse_purchase_events",
    """SELECT seq, type, nullif(app_user_id, '#') AS app_user_id, product_id, expiration_at_ms,
              CASE WHEN seq % 50 = 0 THEN '{broken' END AS corrupt, n_entitlements
       FROM (SELECT seq, CASE WHEN seq % 50 <> 0 THEN type END AS type,
                    CASE WHEN seq % 50 <> 0 THEN app_user_id END AS app_user_id,
                    CASE WHEN seq % 50 <> 0 THEN product_id END AS product_id,
                    CASE WHEN seq % 50 <> 0 THEN CAST(expiration_at_ms AS VARCHAR) END AS expiration_at_ms,
                    CASE WHEN seq % 50 <> 0 AND has_pro THEN CAST(1 AS BIGINT) END AS n_entitlements
             FROM purchase_events)""",
)
def parse_purchase_events(d):
    fields = ["type", "app_user_id", "product_id", "entitlement_ids"]
    number = F.col("expiration_at_ms").cast("bigint").alias("expiration_at_ms")
    body = F.to_json(F.struct(F.struct(*fields, number).alias("event")))
    lines = d.purchase_events.select("seq", F.when(F.col("seq") % 50 == 0, "{broken").otherwise(body).alias("value"))
    size = F.when(F.col("entitlement_ids").isNotNull(), F.size("entitlement_ids")).cast("bigint")
    return op.parse_purchase_events(lines).select(
        "seq", "type", "app_user_id", "product_id", "expiration_at_ms",
        F.col("_corrupt_record").alias("corrupt"), size.alias("n_entitlements"),
    )


@query("classify_purchases", f"WITH {EFFECTS} SELECT * FROM effects")
def classify_purchases(d):
    return effects(d)


@query(
    "route_effects",
    f"""WITH {EFFECTS}
  SELECT seq, e.user_id, kind, CASE WHEN e.user_id IS NULL THEN 'no account id' WHEN kind = 'ignore' THEN 'ignored'
         WHEN u.id IS NULL THEN 'unknown account' ELSE 'applied' END AS routed
  FROM effects e LEFT JOIN (SELECT id FROM accounts WHERE CAST(substring(id, 2) AS BIGINT) % 2 = 1) u ON u.id = e.user_id""",
)
def route_effects(d):
    some = d.lapsed(d.accounts, F.substring("id", 2, 20).cast("bigint") % 2 == 0)
    return op.route_effects(effects(d), some).select("seq", "user_id", "kind", "routed")


@query("pearl_grants", f"WITH {EFFECTS} SELECT * FROM grants")
def pearl_grants(d):
    return op.pearl_grants(effects(d))


@query(
    "append_new",
    f"""WITH {EFFECTS},
  early AS (SELECT transaction_id FROM grants WHERE created_at < TIMESTAMP '2024-01-10 00:00:00'),
  late AS (SELECT * FROM effects WHERE kind = 'pearls' AND user_id IS NOT NULL
             AND ts >= TIMESTAMP '2024-01-09 12:00:00'
             AND transaction_id NOT IN (SELECT transaction_id FROM early))
  SELECT seq, transaction_id, user_id, pearls FROM (
    SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY seq) AS rn FROM late) WHERE rn = 1""",
)
def append_new_grants(d):
    """A later batch, overlapping the first, appended to the ledger of the first."""
    all_effects = effects(d)
    first = op.pearl_grants(all_effects).filter(F.col("created_at") < instant("2024-01-10 00:00:00"))
    batch = all_effects.filter(
        (F.col("kind") == "pearls") & F.col("user_id").isNotNull() & (F.col("ts") >= instant("2024-01-09 12:00:00"))
    ).select("seq", "transaction_id", "user_id", "pearls")
    return append_new(first, batch, ["transaction_id"], [F.asc("seq")])


@query(
    "purchased_pearls",
    f"""WITH {EFFECTS}
  SELECT a.id AS user_id, CAST(coalesce(sum(g.pearls), 0) AS BIGINT) AS purchased_pearls
  FROM accounts a LEFT JOIN grants g ON g.user_id = a.id GROUP BY 1""",
)
def purchased_pearls(d):
    return op.purchased_pearls(d.accounts, op.pearl_grants(effects(d)))


@query("pro_state", f"WITH {EFFECTS} SELECT * FROM state")
def pro_state(d):
    return op.pro_state(effects(d))


@query("merge_pro_state", f"WITH {EFFECTS} SELECT * FROM state")
def merge_pro_state(d):
    """The fold over three batches equals the fold over all."""
    all_effects = effects(d)
    cut = [instant("2024-01-10 00:00:00"), instant("2024-01-20 00:00:00")]
    ts = F.col("ts")
    parts = [all_effects.filter(c) for c in (ts < cut[0], (ts >= cut[0]) & (ts < cut[1]), ts >= cut[1])]
    state = op.pro_state(parts[0])
    for part in parts[1:]:
        state = op.merge_pro_state(state, op.pro_state(part))
    return state


@query(
    "entitlements",
    f"""WITH {EFFECTS}
  SELECT a.id AS user_id, coalesce(s.pro_lifetime, false) OR coalesce(s.pro_until > {AS_OF_SQL}, false) AS pro,
         coalesce(s.pro_lifetime, false) AS pro_lifetime, s.pro_until, coalesce(g.p, 0) AS purchased_pearls
  FROM accounts a LEFT JOIN state s ON s.user_id = a.id
  LEFT JOIN (SELECT user_id, CAST(sum(pearls) AS BIGINT) AS p FROM grants GROUP BY 1) g ON g.user_id = a.id""",
)
def entitlements(d):
    e = effects(d)
    return op.entitlements(d.accounts, e, op.pearl_grants(e), instant(AS_OF))
