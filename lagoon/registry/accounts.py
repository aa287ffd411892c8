"""Accounts, sessions, links, identities, erasure, documents."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.functions.tokens import identity_claims
from lagoon.operators import accounts as op
from lagoon.operators import activity, limits, purchases
from lagoon.registry import query
from lagoon.registry.purchases import EFFECTS
from lagoon.registry.views import AS_OF_SQL, N, avatar_sql, minted_sql
from lagoon.session import scratch_path
from lagoon.sources.domain import AS_OF, instant, uid
from lagoon.sources.files import write_json_documents


def number(c):
    return F.substring(c, 2, 20).cast("bigint")


@query(
    "safe_users",
    "SELECT id, name, initial, avatar_bg, avatar_url, email, email_verified_at, last_seen FROM users",
)
def safe_users(d):
    return op.safe_users(d.users)


@query("live_sessions", f"SELECT * FROM auth_sessions WHERE expires_at > {AS_OF_SQL}")
def live_sessions(d):
    return op.live_sessions(d.auth_sessions, instant(AS_OF))


@query("prune_expired_sessions", f"SELECT * FROM auth_sessions WHERE NOT expires_at < {AS_OF_SQL}")
def prune_expired_sessions(d):
    return op.prune_expired(d.auth_sessions, instant(AS_OF))


@query("prune_expired_links", f"SELECT * FROM email_verifications WHERE NOT expires_at < {AS_OF_SQL}")
def prune_expired_links(d):
    return op.prune_expired(d.email_verifications, instant(AS_OF))


@query(
    "legacy_accounts",
    "SELECT id, name FROM accounts WHERE password_hash IS NULL AND apple_sub IS NULL AND email IS NULL",
)
def legacy_accounts(d):
    return op.legacy_accounts(d.accounts).select("id", "name")


@query(
    "verification_targets",
    """SELECT id AS user_id, email, CASE WHEN email IS NULL THEN 'no email'
              WHEN email_verified_at IS NOT NULL THEN 'already verified' ELSE 'eligible' END AS outcome FROM accounts""",
)
def verification_targets(d):
    return op.verification_targets(d.accounts)


LOG = """
  log AS (SELECT event_id AS request_id, ts, event_id - 1 - event_id % 5 AS tok, event_id % 7 AS turn FROM events),
  asked AS (SELECT *, CASE WHEN turn <= 1 THEN NULL ELSE sha256('tok' || tok) END AS token_hash FROM log),
  resolved AS (
    SELECT request_id, ts, a.token_hash, s.user_id, CASE WHEN a.token_hash IS NULL THEN 'no token'
           WHEN s.user_id IS NOT NULL THEN 'ok' ELSE 'expired or unknown' END AS outcome
    FROM asked a LEFT JOIN auth_sessions s ON s.token_hash = a.token_hash AND a.ts < s.expires_at
      AND EXISTS (SELECT 1 FROM accounts u WHERE u.id = s.user_id AND CAST(substring(u.id, 2) AS BIGINT) % 10 <> 0))"""


def request_log(d):
    token = F.concat(F.lit("tok"), (F.col("event_id") - 1 - F.col("event_id") % 5).cast("string"))
    turn = F.col("event_id") % 7
    return d.raw("events").select(
        F.col("event_id").alias("request_id"),
        "ts",
        F.when(turn == 0, F.concat(F.lit("Basic "), token)).when(turn == 1, None)
        .when(turn == 2, F.concat(F.lit("  bearer   "), token, F.lit(" ")))
        .otherwise(F.concat(F.lit("Bearer "), token)).alias("header"),
    )


def resolved(d):
    return op.resolve_requests(request_log(d), d.auth_sessions, d.lapsed(d.accounts, number("id") % 10 == 0))


@query("resolve_requests", f"WITH {LOG} SELECT * FROM resolved")
def resolve_requests(d):
    return resolved(d)


@query(
    "touch_sessions",
    f"""WITH {LOG} SELECT s.token_hash, s.user_id, s.created_at, s.expires_at, greatest(s.last_used, coalesce(r.used, s.last_used)) AS last_used
        FROM auth_sessions s LEFT JOIN (SELECT token_hash, max(ts) AS used FROM resolved WHERE outcome = 'ok' GROUP BY 1) r
          ON r.token_hash = s.token_hash""",
)
def touch_sessions(d):
    return op.touch_sessions(d.auth_sessions, resolved(d))


@query("sign_out", "SELECT * FROM auth_sessions WHERE CAST(substring(user_id, 2) AS BIGINT) % 3 <> 0")
def sign_out(d):
    sessions = d.auth_sessions
    return op.sign_out(sessions, sessions.filter(number("user_id") % 3 == 0))


@query(
    "live_links",
    f"""SELECT token_hash, user_id, email, created_at, expires_at FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, token_hash DESC) AS rn
          FROM email_verifications) WHERE rn = 1 AND expires_at > {AS_OF_SQL}""",
)
def live_links(d):
    return op.live_links(d.email_verifications, instant(AS_OF))


REDEEMED = """
  asked AS (SELECT event_id AS seq, ts, sha256('ver' || (event_id - 1 - event_id % 40)) AS h, event_id % 11 = 0 AS blank FROM events),
  issued AS (SELECT *, lead(created_at) OVER (PARTITION BY user_id ORDER BY created_at, token_hash) AS voided FROM email_verifications),
  hits AS (SELECT a.seq, l.user_id, l.email, row_number() OVER (PARTITION BY a.h ORDER BY a.seq) AS rn
           FROM asked a JOIN issued l ON l.token_hash = a.h AND a.ts >= l.created_at AND a.ts < l.expires_at
             AND (l.voided IS NULL OR a.ts < l.voided) WHERE NOT blank),
  redeemed AS (SELECT a.seq, a.ts, h.user_id, CASE WHEN h.seq IS NULL THEN 'expired'
                      WHEN coalesce(lower(u.email) = lower(h.email), false) THEN 'confirmed' ELSE 'changed' END AS outcome
               FROM asked a LEFT JOIN hits h ON h.seq = a.seq AND h.rn = 1 LEFT JOIN accounts u ON u.id = h.user_id)"""


def redeemed(d):
    e = F.col("event_id")
    asked = d.raw("events").select(
        e.alias("seq"), "ts",
        F.when(e % 11 == 0, "").otherwise(F.concat(F.lit("ver"), (e - 1 - e % 40).cast("string"))).alias("token"),
    )
    return op.redeem_links(asked, d.email_verifications, d.accounts)


@query("redeem_links", f"WITH {REDEEMED} SELECT * FROM redeemed")
def redeem_links(d):
    return redeemed(d)


@query(
    "confirm_emails",
    f"""WITH {REDEEMED} SELECT u.id, u.email, coalesce(r.at, u.email_verified_at) AS email_verified_at FROM accounts u
        LEFT JOIN (SELECT user_id, max(ts) AS at FROM redeemed WHERE outcome = 'confirmed' GROUP BY 1) r ON r.user_id = u.id""",
)
def confirm_emails(d):
    return op.confirm_emails(d.accounts, redeemed(d)).select("id", "email", "email_verified_at")


# Identity claims: known, linkable, contested and conflicting ones.
CLAIMS = f"""
  claims AS (SELECT c_custkey AS seq,
      CASE c_custkey % 4 WHEN 0 THEN 'sub' || c_custkey WHEN 1 THEN 'new' || (c_custkey % 90) ELSE 'fresh' || c_custkey END AS sub,
      CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Customer#' || lpad(CAST((3 * c_custkey) % {N} AS VARCHAR), 9, '0') || '@example.org'
           WHEN 2 THEN 'customer#' || lpad(CAST(c_custkey - c_custkey % 50 AS VARCHAR), 9, '0') || '@example.org'
           ELSE ' Mail' || (c_custkey % 200) || '@example.org' END AS email,
      c_custkey % 3 <> 0 AS email_verified FROM customer)"""


def identity_log(d):
    k, n = F.col("c_custkey"), d.n_customers
    mail = lambda p, x: F.concat(F.lit(p), F.lpad(x.cast("string"), 9, "0"), F.lit("@example.org"))
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    return d.raw("customer").select(
        k.alias("seq"),
        F.when(k % 4 == 0, text("sub", k)).when(k % 4 == 1, text("new", k % 90)).otherwise(text("fresh", k)).alias("sub"),
        F.when(k % 7 == 0, None).when(k % 7 == 1, mail("Customer#", (3 * k) % n)).when(k % 7 == 2, mail("customer#", k - k % 50))
        .otherwise(F.concat(text(" Mail", k % 200), F.lit("@example.org"))).alias("email"),
        (k % 3 != 0).alias("email_verified"),
    )


IDENTITIES = f"""{CLAIMS},
  looked AS MATERIALIZED (SELECT row_number() OVER (ORDER BY seq) AS i, c.seq, c.sub, lower(trim(c.email)) AS mail,
                    s.id AS by_sub, m.id AS by_mail,
                    CASE WHEN s.id IS NOT NULL THEN 'known' WHEN m.id IS NULL THEN 'created'
                         WHEN c.email_verified AND m.apple_sub IS NULL THEN 'linked' ELSE 'conflict' END AS path
             FROM claims c LEFT JOIN accounts s ON s.apple_sub = c.sub LEFT JOIN accounts m ON lower(m.email) = lower(trim(c.email))),
  walk AS (
    SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS subs, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS mails,
           CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS sub, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS user_id
    UNION ALL
    SELECT i, CASE WHEN outcome IN ('created', 'linked') THEN list_append(subs, sub) ELSE subs END,
           CASE WHEN outcome = 'created' THEN list_append(ids, {minted_sql('u', "'subject'", 'sub')})
                WHEN outcome = 'linked' THEN list_append(ids, by_mail) ELSE ids END,
           CASE WHEN outcome IN ('created', 'linked') AND mail IS NOT NULL THEN list_append(mails, mail) ELSE mails END,
           seq, sub, outcome,
           CASE WHEN path = 'known' THEN by_sub WHEN outcome = 'linked' THEN by_mail
                WHEN outcome = 'created' THEN {minted_sql('u', "'subject'", 'sub')}
                WHEN outcome = 'known' THEN list_extract(ids, list_position(subs, sub)) END
    FROM (SELECT l.i, w.subs, w.ids, w.mails, l.seq, l.sub, l.mail, l.path, l.by_sub, l.by_mail,
                 CASE WHEN l.path = 'known' OR list_contains(w.subs, l.sub) THEN 'known'
                      WHEN l.path = 'conflict' OR coalesce(list_contains(w.mails, l.mail), false) THEN 'conflict'
                      ELSE l.path END AS outcome
          FROM walk w JOIN looked l ON l.i = w.i + 1))"""


@query(
    "resolve_identities",
    f"WITH RECURSIVE {IDENTITIES} SELECT seq, sub, outcome, user_id FROM walk WHERE i > 0",
)
def resolve_identities(d):
    return op.resolve_identities(identity_log(d), d.accounts)


# What the accounts are after all claims: names wanted by many, given in order.
SIGNED_IN = f"""{IDENTITIES},
  settled AS MATERIALIZED (SELECT seq, sub, outcome, user_id FROM walk WHERE i > 0),
  made AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY s.seq) AS n, s.seq, s.sub, s.user_id, lower(trim(c.email)) AS email, c.email_verified,
           list_append(list_prepend('Reef ' || (s.seq % 40), list_transform([2, 3, 4, 5, 6, 7, 8, 9], lambda k: 'Reef ' || (s.seq % 40) || ' ' || k)),
                       'Diver ' || (s.seq + 1000)) AS wishes
    FROM settled s JOIN claims c ON c.seq = s.seq WHERE s.outcome = 'created'),
  naming AS (
    SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS held, CAST(NULL AS VARCHAR) AS name
    UNION ALL
    SELECT n, list_append(held, lower(name)), name
    FROM (SELECT m.n, g.held, list_filter(m.wishes, lambda c: NOT list_contains(g.held, lower(c)))[1] AS name
          FROM naming g JOIN made m ON m.n = g.n + 1)),
  born AS (SELECT m.user_id AS id, g.name, m.sub, m.email, m.email_verified FROM made m JOIN naming g ON g.n = m.n)"""


def sign_ins(d):
    return op.sign_in(identity_log(d).withColumn("name", F.concat(F.lit(" Reef "), (F.col("seq") % 40).cast("string"))), d.accounts, instant(AS_OF))


@query(
    "signed_in_users",
    f"""WITH RECURSIVE {SIGNED_IN}
  SELECT a.id, a.name, a.initial, a.avatar_bg, a.email, coalesce(a.apple_sub, s.sub) AS apple_sub, a.email_verified_at
  FROM accounts a LEFT JOIN settled s ON s.outcome = 'linked' AND s.user_id = a.id
  UNION ALL
  SELECT id, name, upper(substring(name, 1, 1)), {avatar_sql('sub')}, email, sub, CASE WHEN email_verified THEN {AS_OF_SQL} END FROM born""",
)
def signed_in_users(d):
    return sign_ins(d).users.select("id", "name", "initial", "avatar_bg", "email", "apple_sub", "email_verified_at")


@query(
    "signed_in_stats",
    f"""WITH RECURSIVE {SIGNED_IN} SELECT id AS user_id, CAST(0 AS BIGINT) AS total_mins, CAST(0 AS BIGINT) AS dives, CAST(0 AS BIGINT) AS caught FROM born""",
)
def signed_in_stats(d):
    return sign_ins(d).stats


@query(
    "issue_links",
    """WITH asks AS (SELECT 'u' || user_id AS user_id, arg_max(event_id, event_id) AS seq, arg_max(ts, event_id) AS ts FROM events WHERE event_type = 'click' GROUP BY 1),
  fresh AS (SELECT sha256('again' || seq) AS token_hash, k.user_id, lower(a.email) AS email, k.ts AS created_at, k.ts + INTERVAL 24 HOUR AS expires_at
            FROM asks k JOIN accounts a ON a.id = k.user_id WHERE a.email IS NOT NULL)
  SELECT token_hash, user_id, email, created_at, expires_at FROM email_verifications WHERE user_id NOT IN (SELECT user_id FROM fresh)
  UNION ALL SELECT * FROM fresh""",
)
def issue_links(d):
    clicks = d.raw("events").filter("event_type = 'click'")
    asks = clicks.select(F.col("event_id").alias("seq"), "ts", uid("user_id").alias("user_id"), F.concat(F.lit("again"), F.col("event_id").cast("string")).alias("token"))
    return op.issue_links(d.email_verifications, asks, d.accounts)


# Sign-ups: malformed, taken and heavily contested names and addresses.
PEOPLE = "people AS (SELECT id, replace(name, '#', ' ') AS name, email, initial FROM accounts)"
SIGNUPS = """
  asks AS (SELECT p_partkey AS seq,
      CASE p_partkey % 8 WHEN 0 THEN 'CUSTOMER ' || lpad(CAST(3 * p_partkey AS VARCHAR), 9, '0') WHEN 1 THEN ' x '
           WHEN 2 THEN p_name || '!' WHEN 3 THEN 'a much longer name than fits' ELSE ' ' || p_name || ' ' || (p_partkey % 20) END AS name,
      CASE p_partkey % 9 WHEN 0 THEN '  ' WHEN 1 THEN 'no-at.example.org'
           WHEN 2 THEN 'Customer#' || lpad(CAST(2 * p_partkey AS VARCHAR), 9, '0') || '@EXAMPLE.org'
           ELSE ' Mail' || (p_partkey % 400) || '@Example.org ' END AS email FROM part),
  checked AS MATERIALIZED (SELECT row_number() OVER (ORDER BY a.seq) AS i, a.seq, trim(a.name) AS name, lower(trim(a.email)) AS email,
      CASE WHEN trim(a.email) = '' THEN 'email missing' WHEN a.email NOT LIKE '%@%' THEN 'email bad shape'
           WHEN length(trim(a.name)) < 2 THEN 'name too short' WHEN length(trim(a.name)) > 20 THEN 'name too long'
           WHEN a.name LIKE '%!' THEN 'name bad characters'
           WHEN EXISTS (SELECT 1 FROM people p WHERE lower(p.name) = lower(trim(a.name))) THEN 'name taken'
           WHEN EXISTS (SELECT 1 FROM people p WHERE p.email = lower(trim(a.email))) THEN 'email taken' END AS early
      FROM asks a),
  walk AS (
    SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS names, CAST([] AS VARCHAR[]) AS mails, CAST(NULL AS BIGINT) AS seq,
           CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS outcome
    UNION ALL
    SELECT i, CASE WHEN outcome = 'ok' THEN list_append(names, lower(name)) ELSE names END,
           CASE WHEN outcome = 'ok' THEN list_append(mails, email) ELSE mails END, seq, name, email, outcome
    FROM (SELECT c.i, w.names, w.mails, c.seq, c.name, c.email,
                 CASE WHEN c.early IS NOT NULL THEN c.early WHEN list_contains(w.names, lower(c.name)) THEN 'name taken'
                      WHEN list_contains(w.mails, c.email) THEN 'email taken' ELSE 'ok' END AS outcome
          FROM walk w JOIN checked c ON c.i = w.i + 1))"""


def people(d):
    return d.accounts.withColumn("name", F.replace("name", F.lit("#"), F.lit(" ")))


def signups(d):
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    pad = lambda x: F.lpad(text(x), 9, "0")
    return d.raw("part").select(
        k.alias("seq"),
        F.when(k % 8 == 0, F.concat(F.lit("CUSTOMER "), pad(3 * k))).when(k % 8 == 1, " x ")
        .when(k % 8 == 2, F.concat("p_name", F.lit("!"))).when(k % 8 == 3, "a much longer name than fits")
        .otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "), text(k % 20))).alias("name"),
        F.when(k % 9 == 0, "  ").when(k % 9 == 1, "no-at.example.org")
        .when(k % 9 == 2, F.concat(F.lit("Customer#"), pad(2 * k), F.lit("@EXAMPLE.org")))
        .otherwise(F.concat(F.lit(" Mail"), text(k % 400), F.lit("@Example.org "))).alias("email"),
    )


@query(
    "signup_outcomes",
    f"WITH RECURSIVE {PEOPLE}, {SIGNUPS} SELECT seq, name, email, outcome FROM walk WHERE i > 0",
)
def signup_outcomes(d):
    return op.signup_outcomes(signups(d), people(d))


@query(
    "created_users",
    f"""WITH RECURSIVE {PEOPLE}, {SIGNUPS} SELECT {minted_sql('u', 'email')} AS id, name,
          upper(substring(name, 1, 1)) AS initial, email, {AS_OF_SQL} AS created_at FROM walk WHERE outcome = 'ok'""",
)
def created_users(d):
    made = op.created_users(op.signup_outcomes(signups(d), people(d)), instant(AS_OF))
    return made.select("id", "name", "initial", "email", "created_at")


@query(
    "created_stats",
    f"""WITH RECURSIVE {PEOPLE}, {SIGNUPS} SELECT {minted_sql('u', 'email')} AS user_id, CAST(0 AS BIGINT) AS total_mins,
          CAST(0 AS BIGINT) AS dives, CAST(0 AS BIGINT) AS caught FROM walk WHERE outcome = 'ok'""",
)
def created_stats(d):
    return op.created_stats(op.created_users(op.signup_outcomes(signups(d), people(d)), instant(AS_OF)))


# Renames one by one: contested names, own names in other case, names of others, names given up.
RENAMES = """
  asks AS MATERIALIZED (
    SELECT c_custkey AS seq, 'u' || (c_custkey - c_custkey % 2) AS user_id,
      trim(CASE c_custkey % 5 WHEN 0 THEN 'CUSTOMER ' || lpad(CAST(c_custkey - c_custkey % 2 AS VARCHAR), 9, '0')
           WHEN 1 THEN 'customer ' || lpad(CAST(greatest(c_custkey - 5, 0) AS VARCHAR), 9, '0')
           WHEN 2 THEN 'bad/name' ELSE ' Kelp ' || (c_custkey % 60) END) AS name, row_number() OVER (ORDER BY c_custkey) AS i FROM customer),
  play(k, name, outcome, i) USING KEY (k) AS (
    SELECT id, name, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT) FROM people
    UNION ALL SELECT 'at', NULL, NULL, 0
    UNION
    (WITH one AS (
       SELECT a.*, CASE WHEN a.name = 'bad/name' THEN 'bad characters'
                        WHEN EXISTS (SELECT 1 FROM recurring.play h WHERE h.k <> a.user_id AND lower(h.name) = lower(a.name) AND h.outcome IS NULL) THEN 'name taken'
                        ELSE 'ok' END AS outcome
       FROM play p JOIN asks a ON p.k = 'at' AND a.i = p.i + 1)
     SELECT 'at', NULL, NULL, i FROM one UNION ALL SELECT 'x' || seq, NULL, outcome, seq FROM one
     UNION ALL SELECT user_id, name, NULL, NULL FROM one WHERE outcome = 'ok')),
  judged AS (SELECT a.seq, a.user_id, a.name, p.outcome FROM asks a JOIN play p ON p.k = 'x' || a.seq)"""


def diver_renames(d):
    k = F.col("c_custkey")
    pad = lambda x: F.lpad(x.cast("string"), 9, "0")
    return d.raw("customer").select(
        k.alias("seq"),
        uid(k - k % 2).alias("user_id"),
        F.when(k % 5 == 0, F.concat(F.lit("CUSTOMER "), pad(k - k % 2))).when(k % 5 == 1, F.concat(F.lit("customer "), pad(F.greatest(k - 5, F.lit(0)))))
        .when(k % 5 == 2, "bad/name").otherwise(F.concat(F.lit(" Kelp "), (k % 60).cast("string"))).alias("name"),
    )


@query("rename_diver_outcomes", f"WITH RECURSIVE {PEOPLE}, {RENAMES} SELECT * FROM judged")
def rename_diver_outcomes(d):
    return op.rename_diver_outcomes(diver_renames(d), people(d))


@query(
    "apply_diver_renames",
    f"""WITH RECURSIVE {PEOPLE}, {RENAMES}, last AS (SELECT user_id, arg_max(name, seq) AS name FROM judged WHERE outcome = 'ok' GROUP BY 1)
  SELECT p.id, coalesce(l.name, p.name) AS name, coalesce(upper(substring(l.name, 1, 1)), p.initial) AS initial, p.email
  FROM people p LEFT JOIN last l ON l.user_id = p.id""",
)
def apply_diver_renames(d):
    return op.apply_diver_renames(people(d), diver_renames(d)).select("id", "name", "initial", "email")


# Name wishes: few distinct names, so that suffixes and numbers are needed.
@query(
    "assign_names",
    """WITH RECURSIVE people AS (SELECT id, CASE WHEN id = 'u3' THEN 'red bolt' WHEN id = 'u4' THEN 'Hot Gear 2'
                                                 ELSE replace(name, '#', ' ') END AS name FROM accounts),
  asks AS (SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_partkey AS seq,
                  CASE p_partkey % 10 WHEN 0 THEN '' WHEN 1 THEN 'x/y' WHEN 2 THEN p_name || ' 2'
                       WHEN 3 THEN upper(p_name) || ' the great and good' ELSE p_name END AS wish FROM part),
  based AS (SELECT *, trim(substring(trim(wish), 1, 20)) AS base FROM asks),
  listed AS (SELECT i, seq, list_concat(
               CASE WHEN base = '' THEN CAST([] AS VARCHAR[]) ELSE list_filter(list_prepend(base, list_transform(
                 [2, 3, 4, 5, 6, 7, 8, 9], lambda n: trim(substring(base, 1, 16)) || ' ' || n)), lambda c: NOT contains(c, '/')) END,
               ['Diver ' || (seq + 1000)]) AS wishes FROM based),
  free AS MATERIALIZED (SELECT i, seq, list_filter(wishes, lambda c: NOT list_contains(taken, lower(c))) AS wishes
           FROM listed, (SELECT list(lower(name)) AS taken FROM people)),
  walk AS (
    SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS held, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS name
    UNION ALL
    SELECT i, list_append(held, lower(name)), seq, name
    FROM (SELECT f.i, w.held, f.seq, list_filter(f.wishes, lambda c: NOT list_contains(w.held, lower(c)))[1] AS name
          FROM walk w JOIN free f ON f.i = w.i + 1))
  SELECT seq, name FROM walk WHERE i > 0""",
)
def assign_names(d):
    k = F.col("p_partkey")
    asks = d.raw("part").select(
        k.alias("seq"),
        F.when(k % 10 == 0, "").when(k % 10 == 1, "x/y").when(k % 10 == 2, F.concat("p_name", F.lit(" 2")))
        .when(k % 10 == 3, F.concat(F.upper("p_name"), F.lit(" the great and good"))).otherwise(F.col("p_name")).alias("preferred"),
    )
    users = people(d).withColumn(
        "name", F.when(F.col("id") == "u3", "red bolt").when(F.col("id") == "u4", "Hot Gear 2").otherwise(F.col("name"))
    )
    return op.assign_names(asks, users)


def tables(d):
    """The domain as the audits and the erasure see it."""
    return {
        "users": d.accounts.select("id", "name", "email", "apple_sub"),
        "user_species": d.user_species,
        "user_creatures": d.user_creatures,
        "user_stats": activity.user_stats(d.accounts, d.dives),
        "rooms": d.rooms,
        "room_dives": d.room_dives.drop("ln"),
        "room_members": d.room_members,
        "trades": d.trades,
        "reports": d.raw_reports,
        "friendships": d.friendships,
        "blocks": d.blocks,
        "auth_sessions": d.auth_sessions,
        "email_verifications": d.email_verifications,
        "pearl_grants": purchases.pearl_grants(purchases.classify_purchases(d.purchase_events)),
    }


ERASED = f"""
  gone AS (SELECT id FROM accounts WHERE CAST(substring(id, 2) AS BIGINT) % 25 = 7),
  closed AS (SELECT id FROM rooms WHERE host_id IN (SELECT id FROM gone)),
  removed AS (
    SELECT 'users' AS "table", count(*) AS removed FROM gone
    UNION ALL SELECT 'user_species', count(*) FROM user_species WHERE user_id IN (SELECT id FROM gone)
    UNION ALL SELECT 'user_creatures', count(*) FROM user_creatures WHERE user_id IN (SELECT id FROM gone)
    UNION ALL SELECT 'user_stats', count(*) FROM stats WHERE user_id IN (SELECT id FROM gone)
    UNION ALL SELECT 'rooms', count(*) FROM closed
    UNION ALL SELECT 'room_dives', count(*) FROM room_dives WHERE user_id IN (SELECT id FROM gone) OR room_id IN (SELECT id FROM closed)
    UNION ALL SELECT 'room_members', count(*) FROM room_members WHERE user_id IN (SELECT id FROM gone) OR room_id IN (SELECT id FROM closed)
    UNION ALL SELECT 'trades', count(*) FROM trades WHERE from_id IN (SELECT id FROM gone) OR to_id IN (SELECT id FROM gone)
    UNION ALL SELECT 'reports', count(*) FROM reports WHERE reporter_id IN (SELECT id FROM gone) OR target_id IN (SELECT id FROM gone)
    UNION ALL SELECT 'friendships', count(*) FROM friendships WHERE user_id IN (SELECT id FROM gone) OR friend_id IN (SELECT id FROM gone)
    UNION ALL SELECT 'blocks', count(*) FROM blocks WHERE blocker_id IN (SELECT id FROM gone) OR blocked_id IN (SELECT id FROM gone)
    UNION ALL SELECT 'auth_sessions', count(*) FROM auth_sessions WHERE user_id IN (SELECT id FROM gone)
    UNION ALL SELECT 'email_verifications', count(*) FROM email_verifications WHERE user_id IN (SELECT id FROM gone)
    UNION ALL SELECT 'pearl_grants', count(*) FROM grants WHERE user_id IN (SELECT id FROM gone))"""


@query("erase_accounts", f"WITH {EFFECTS}, {ERASED} SELECT * FROM removed")
def erase_accounts(d):
    return op.removal_counts(op.mark_erased(tables(d), d.accounts.filter(number("id") % 25 == 7)))


# Per table: view, columns that show which rows are left, and the condition under which a row goes.
LEFT = {
    "users": ("accounts", ("id", "name"), "id IN (SELECT id FROM gone)"),
    "user_species": ("user_species", ("user_id", "species_id"), "user_id IN (SELECT id FROM gone)"),
    "user_creatures": ("user_creatures", ("id", "user_id"), "user_id IN (SELECT id FROM gone)"),
    "user_stats": ("stats", ("user_id", "total_mins"), "user_id IN (SELECT id FROM gone)"),
    "rooms": ("rooms", ("id", "host_id"), "host_id IN (SELECT id FROM gone)"),
    "room_dives": ("room_dives", ("room_id", "user_id"), "user_id IN (SELECT id FROM gone) OR room_id IN (SELECT id FROM closed)"),
    "room_members": ("room_members", ("room_id", "user_id"), "user_id IN (SELECT id FROM gone) OR room_id IN (SELECT id FROM closed)"),
    "trades": ("trades", ("id", "to_id"), "from_id IN (SELECT id FROM gone) OR to_id IN (SELECT id FROM gone)"),
    "reports": ("reports", ("reporter_id", "target_id"), "reporter_id IN (SELECT id FROM gone) OR target_id IN (SELECT id FROM gone)"),
    "friendships": ("friendships", ("user_id", "friend_id"), "user_id IN (SELECT id FROM gone) OR friend_id IN (SELECT id FROM gone)"),
    "blocks": ("blocks", ("blocker_id", "blocked_id"), "blocker_id IN (SELECT id FROM gone) OR blocked_id IN (SELECT id FROM gone)"),
    "auth_sessions": ("auth_sessions", ("token_hash", "user_id"), "user_id IN (SELECT id FROM gone)"),
    "email_verifications": ("email_verifications", ("token_hash", "user_id"), "user_id IN (SELECT id FROM gone)"),
    "pearl_grants": ("grants", ("transaction_id", "user_id"), "user_id IN (SELECT id FROM gone)"),
}


@query(
    "erase_accounts_rows_left",
    f"WITH {EFFECTS}, {ERASED} " + " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b FROM {view} WHERE NOT ({goes})"
        for t, (view, (a, b), goes) in LEFT.items()
    ),
)
def erase_accounts_rows_left(d):
    left = op.erase_accounts(tables(d), d.accounts.filter(number("id") % 25 == 7))
    rows = [left[t].select(F.lit(t).alias("table"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) for t, (_, (a, b), _) in LEFT.items()]
    return reduce(DataFrame.unionByName, rows)


@query(
    "erase_accounts_rooms_left",
    f"""WITH {EFFECTS}, {ERASED} SELECT room_id, user_id, joined_at FROM room_members
        WHERE user_id NOT IN (SELECT id FROM gone) AND room_id NOT IN (SELECT id FROM closed)""",
)
def erase_accounts_rooms_left(d):
    some = {"rooms": d.rooms, "room_members": d.room_members}
    return op.erase_accounts(some, d.accounts.filter(number("id") % 25 == 7))["room_members"]


DOCUMENTS = f"""WITH {EFFECTS},
  logged AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY caught_at, id) AS pos FROM user_creatures),
  paged AS (SELECT user_id, (pos - 1) // 4 AS page, count(*) AS n_creatures,
                   string_agg(id || ':' || species_id || ':' || coalesce(nickname, ''), ',' ORDER BY pos) AS creatures
            FROM logged GROUP BY 1, 2),
  held AS (SELECT user_id, string_agg(species_id || '=' || n, ',' ORDER BY species_id) AS collection FROM collections GROUP BY 1),
  docs AS (SELECT u.id, u.name, u.email, coalesce(p.page, 0) AS page, coalesce(p.n_creatures, 0) AS n_creatures,
                  coalesce(p.creatures, '') AS creatures, coalesce(h.collection, '') AS collection, s.total_mins, s.dives, s.caught,
                  coalesce(e.pro_lifetime, false) OR coalesce(e.pro_until > {AS_OF_SQL}, false) AS pro, e.pro_until
           FROM users u LEFT JOIN paged p ON p.user_id = u.id LEFT JOIN held h ON h.user_id = u.id
           JOIN stats s ON s.user_id = u.id LEFT JOIN state e ON e.user_id = u.id)
  SELECT id AS user_id, page, CASE WHEN page = 0 THEN name END AS name, CASE WHEN page = 0 THEN email END AS email,
         CASE WHEN page = 0 THEN collection END AS collection, n_creatures, creatures,
         CASE WHEN page = 0 THEN total_mins END AS total_mins, CASE WHEN page = 0 THEN dives END AS dives,
         CASE WHEN page = 0 THEN caught END AS caught, CASE WHEN page = 0 THEN pro END AS pro,
         CASE WHEN page = 0 THEN pro_until END AS pro_until
  FROM docs"""


@query("account_documents", DOCUMENTS)
def account_documents(d):
    return shown(documents(d, page_size=4))


@query("account_documents_written", DOCUMENTS)
def account_documents_written(d):
    """Written as JSON lines, the sink's form, and read back."""
    docs, place = documents(d, page_size=4), scratch_path(d.spark, "documents")
    write_json_documents(docs, place)
    return shown(d.spark.read.schema(docs.schema).json(place))


def shown(docs):
    each = F.transform("creatures", lambda c: F.concat_ws(":", c.id, c.species_id, F.coalesce(c.nickname, F.lit(""))))
    pairs = F.transform(F.map_entries("collection"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string")))
    return docs.select(
        "user_id", "page", "user.name", "user.email",
        F.when(F.col("page") == 0, F.array_join(F.sort_array(pairs), ",")).alias("collection"),
        F.size("creatures").cast("bigint").alias("n_creatures"),
        F.array_join(each, ",").alias("creatures"),
        "stats.total_mins", "stats.dives", "stats.caught", "entitlements.pro", "entitlements.pro_until",
    )


def documents(d, page_size=op.PAGE):
    effects = purchases.classify_purchases(d.purchase_events)
    paid = purchases.entitlements(d.accounts, effects, purchases.pearl_grants(effects), instant(AS_OF))
    return op.account_documents(d.users, d.user_creatures, activity.user_stats(d.accounts, d.dives), paid, page_size)


@query("account_documents_json")
def account_documents_json(d):
    return op.to_json_documents(documents(d))


# Tokens: one customer each, every failure in turn.
ISSUER, APP = "https://issuer.example.org", "org.example.app"


def identity_tokens(d):
    k = F.col("c_custkey")
    turn = k % 13
    seg = lambda text: F.regexp_replace(F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_"), "[=\\s]", "")
    q = lambda s: F.concat(F.lit('"'), s, F.lit('"'))
    head = F.concat(
        F.lit('{"alg":'), F.when(turn == 1, F.lit('"none"')).otherwise(F.lit('"RS256"')),
        F.when(turn == 2, F.lit("}")).otherwise(F.lit(',"kid":"k1"}')),
    )
    body = F.concat(
        F.lit('{"iss":'), F.when(turn == 3, F.lit('"https://other"')).otherwise(q(F.lit(ISSUER))),
        F.lit(',"aud":'), F.when(turn == 4, F.lit('"org.other"')).when(turn == 5, F.lit(f'["x","{APP}"]'))
        .when(turn == 6, F.lit('["x","y"]')).otherwise(q(F.lit(APP))),
        F.lit(',"exp":'), F.when(turn == 7, F.lit("1706616000")).when(turn == 8, F.lit("null")).otherwise(F.lit("1706616001")),
        F.when(turn == 9, F.lit(',"sub":17')).otherwise(F.concat(F.lit(',"sub":'), q(F.concat(F.lit("sub"), k.cast("string"))))),
        F.when(turn == 10, F.lit("")).otherwise(F.concat(F.lit(',"email":'), q(F.concat(F.lower("c_name"), F.lit("@example.org"))))),
        F.lit(',"email_verified":'), F.when(k % 4 == 0, F.lit("true")).when(k % 4 == 1, F.lit('"true"'))
        .when(k % 4 == 2, F.lit('"false"')).otherwise(F.lit("1")),
        F.lit("}"),
    )
    token = F.when(turn == 11, F.concat(seg(head), F.lit("."), seg(body))).when(turn == 12, F.concat(F.lit("??."), seg(body), F.lit(".s")))
    return d.raw("customer").select(
        k.alias("seq"), token.otherwise(F.concat(seg(head), F.lit("."), seg(body), F.lit(".s"))).alias("token")
    )


@query(
    "identity_claims",
    """WITH t AS (SELECT c_custkey AS seq, c_custkey % 13 AS turn, c_custkey % 4 AS v, c_name FROM customer),
  r AS (SELECT *, CASE turn WHEN 1 THEN 'wrong algorithm' WHEN 2 THEN 'no key id' WHEN 3 THEN 'wrong issuer'
              WHEN 4 THEN 'wrong audience' WHEN 6 THEN 'wrong audience' WHEN 7 THEN 'expired' WHEN 8 THEN 'expired'
              WHEN 9 THEN 'no subject' WHEN 11 THEN 'malformed' WHEN 12 THEN 'malformed' END AS reason FROM t)
  SELECT seq, reason IS NULL AS ok, reason, CASE WHEN reason IS NULL THEN 'sub' || seq END AS sub,
         CASE WHEN reason IS NULL AND turn <> 10 THEN lower(c_name) || '@example.org' END AS email,
         CASE WHEN reason IS NULL THEN v <= 1 END AS email_verified FROM r""",
)
def identity_claims_triage(d):
    claims = identity_claims(F.col("token"), ISSUER, APP, instant(AS_OF))
    return identity_tokens(d).select("seq", claims.alias("c")).select("seq", "c.*")


# Budgets small enough to bite on this log: four calls a day, two of them strict.
BUDGET = """
  framed AS (SELECT event_id AS request_id, ts, device_key AS limit_key, method, path, date_trunc('day', ts) AS w FROM auth_log),
  counted AS (SELECT *, row_number() OVER (PARTITION BY limit_key, w ORDER BY ts, request_id) AS nth FROM framed WHERE path <> 'error'),
  strictly AS (SELECT *, row_number() OVER (PARTITION BY limit_key, w ORDER BY ts, request_id) AS snth FROM counted
               WHERE nth <= 4 AND method = 'POST' AND path IN ('signup', 'view', 'purchase'))"""


def auth_log(d):
    return d.auth_log.select(F.col("event_id").alias("request_id"), "ts", F.col("device_key").alias("limit_key"), "method", "path")


STRICT = [("POST", p) for p in ("signup", "view", "purchase")]


@query(
    "throttle_decisions",
    f"""WITH {BUDGET}
  SELECT request_id, ts, limit_key, method, path, 'admitted' AS decision FROM framed WHERE path = 'error'
  UNION ALL SELECT request_id, ts, limit_key, method, path, 'throttled' FROM counted WHERE nth > 4
  UNION ALL SELECT request_id, ts, limit_key, method, path, 'admitted' FROM counted WHERE nth <= 4 AND (path = 'click' OR method = 'GET')
  UNION ALL SELECT request_id, ts, limit_key, method, path, CASE WHEN snth <= 2 THEN 'admitted' ELSE 'throttled strictly' END FROM strictly""",
)
def throttle_decisions(d):
    return limits.throttle_decisions(
        auth_log(d), "1 day", 4, 2, strict=STRICT, exempt=["error"]
    )


@query(
    "budget_violations",
    """SELECT * FROM (SELECT device_key AS limit_key, date_trunc('day', ts) AS window_start,
           count(*) FILTER (path <> 'error') AS calls,
           count(*) FILTER (method = 'POST' AND path IN ('signup', 'view', 'purchase')) AS strict_calls
         FROM auth_log GROUP BY 1, 2) WHERE calls > 2 OR strict_calls > 1""",
)
def budget_violations(d):
    return limits.budget_violations(auth_log(d), "1 day", 2, 1, STRICT, ["error"])
