"""Text rules, moderation and scalar functions over whole columns."""

from pyspark.sql import functions as F

from lagoon.functions import moderation as mod
from lagoon.functions import scalars as sc
from lagoon.functions import text as tx
from lagoon.operators import accounts
from lagoon.registry import query
from lagoon.registry.views import avatar_sql, minted_sql, sql_list, trim_sql
from lagoon.sources.domain import instant

# Names from every text column, plus names with a term worked into them by rule.
TERMS = [*mod.ANYWHERE, *mod.EXACT, *mod.SAFE]



NAMES_SQL = f"""
  terms AS (SELECT unnest({sql_list(TERMS)}) AS t, generate_subscripts({sql_list(TERMS)}, 1) AS i),
  formed AS (SELECT p_partkey, p_name, t, p_partkey % 8 AS form FROM part JOIN terms ON i = p_partkey % {len(TERMS)} + 1),
  names AS (
    SELECT DISTINCT name FROM (
      SELECT c_name AS name FROM customer UNION ALL SELECT p_name FROM part
      UNION ALL SELECT CASE form WHEN 0 THEN t WHEN 1 THEN 'Deep ' || upper(t) || ' Sea' WHEN 2 THEN 'x' || t || 'x'
                  WHEN 3 THEN array_to_string(string_split(t, ''), '.') WHEN 4 THEN translate(t, 'oieast', '013457')
                  WHEN 5 THEN substring(t, 1, 1) || repeat(substring(t, 2, 1), 4) || substring(t, 3) WHEN 6 THEN p_name || '_' || t
                  ELSE t || ' ' || t END FROM formed
      UNION ALL SELECT unnest(regexp_split_to_array(text, '\\s+')) FROM documents))"""


def names(d):
    k = F.col("p_partkey")
    t = F.element_at(F.array(*[F.lit(x) for x in TERMS]), (k % len(TERMS) + 1).cast("int"))
    form = k % 8
    p = d.raw("part").select(k, "p_name", t.alias("t"))
    t = F.col("t")
    formed = p.select(
        F.when(form == 0, t).when(form == 1, F.concat(F.lit("Deep "), F.upper(t), F.lit(" Sea")))
        .when(form == 2, F.concat(F.lit("x"), t, F.lit("x"))).when(form == 3, F.array_join(F.split(t, ""), "."))
        .when(form == 4, F.translate(t, "oieast", "013457"))
        .when(form == 5, F.concat(F.substring(t, 1, 1), F.repeat(F.substring(t, 2, 1), F.lit(4)), F.substring(t, 3, 99)))
        .when(form == 6, F.concat("p_name", F.lit("_"), t)).otherwise(F.concat(t, F.lit(" "), t)).alias("name")
    )
    words = d.raw("documents").select(F.explode(F.split("text", r"[\t\n\f\r ]+")).alias("name"))
    return (
        d.raw("customer").select(F.col("c_name").alias("name"))
        .unionByName(d.raw("part").select(F.col("p_name").alias("name")))
        .unionByName(formed)
        .unionByName(words)
        .distinct()
    )


def _squeeze_sql(expr):
    for ch in "abcdefghijklmnopqrstuvwxyz":
        expr = f"regexp_replace({expr}, '{ch}{{3,}}', '{ch}', 'g')"
    return expr


FOLD = f"translate(lower(name), '{mod.FOLD_FROM}', '{mod.FOLD_TO}')"
VERDICT = f"""
  cut AS (SELECT name, {FOLD} AS folded,
                 list_filter(regexp_split_to_array({FOLD}, '[ ._-]+'), lambda w: w <> '') AS words,
                 list_filter(regexp_split_to_array(lower(name), '[ ._-]+'), lambda w: w <> '') AS raw_words FROM names),
  kept AS (SELECT *, array_to_string(list_filter(words, lambda w: NOT list_contains({sql_list(mod.SAFE)}, w)), '') AS joined FROM cut),
  squeezed AS (SELECT *, {_squeeze_sql('joined')} AS tight FROM kept),
  judged AS (SELECT name, len(list_filter({sql_list(mod.ANYWHERE)}, lambda t: contains(joined, t) OR contains(tight, t))) > 0
                       OR list_has_any({sql_list(mod.EXACT)}, list_append(words, array_to_string(words, '')))
                       OR list_has_any({sql_list(mod.EXACT)}, list_append(raw_words, array_to_string(raw_words, ''))) AS blocked
             FROM squeezed)"""


@query("moderate_names", f"WITH {NAMES_SQL}, {VERDICT} SELECT name, blocked FROM judged")
def moderate_names(d):
    return names(d).select("name", mod.is_blocked_name(F.col("name")).alias("blocked"))


@query(
    "fold_text",
    f"""WITH {NAMES_SQL} SELECT name, {FOLD} AS folded, regexp_replace({FOLD}, '[ ._-]+', '', 'g') AS collapsed,
        {_squeeze_sql("regexp_replace(" + FOLD + ", '[^a-z]', '', 'g')")} AS squeezed FROM names""",
)
def fold_text(d):
    letters = F.regexp_replace(mod.fold_leet(F.col("name")), "[^a-z]", "")
    return names(d).select(
        "name", mod.fold_leet(F.col("name")).alias("folded"), mod.collapse(F.col("name")).alias("collapsed"),
        mod.squeeze_runs(letters).alias("squeezed"),
    )


def _problem_sql(low, high):
    return f"""CASE WHEN length(name) < {low} THEN 'too short' WHEN length(name) > {high} THEN 'too long'
        WHEN NOT regexp_full_match(name, '[\\p{{L}}\\p{{N}} ._-]+') THEN 'bad characters' WHEN blocked THEN 'blocked' END"""


@query(
    "name_problems",
    f"""WITH {NAMES_SQL}, {VERDICT} SELECT name, {_problem_sql(2, 20)} AS name_problem,
        {_problem_sql(1, 16)} AS nickname_problem FROM judged""",
)
def name_problems(d):
    return names(d).select(
        "name", tx.name_problem(F.col("name")).alias("name_problem"), tx.nickname_problem(F.col("name")).alias("nickname_problem")
    )


@query(
    "email_problems",
    """WITH mails AS (SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN ' ' || upper(c_name) || '@Example.ORG  ' WHEN 1 THEN c_name
              WHEN 2 THEN c_name || '@host' WHEN 3 THEN '@example.org' WHEN 4 THEN '  ' WHEN 5 THEN 'a b@example.org'
              WHEN 6 THEN repeat('a', 250) || '@example.org' WHEN 7 THEN 'a@b..org' ELSE c_name || '@sub.example.co.uk' END AS m FROM customer),
  n AS (SELECT id, lower(trim(m)) AS email FROM mails)
  SELECT id, email, CASE WHEN email = '' THEN 'missing' WHEN length(email) > 254 THEN 'too long'
         WHEN NOT regexp_full_match(email, '[^\\s@]+@[^\\s@.]+(\\.[^\\s@.]+)+') THEN 'bad shape' END AS problem FROM n""",
)
def email_problems(d):
    k, c = F.col("c_custkey"), F.col("c_name")
    turn = k % 9
    raw = (
        F.when(turn == 0, F.concat(F.lit(" "), F.upper(c), F.lit("@Example.ORG  "))).when(turn == 1, c)
        .when(turn == 2, F.concat(c, F.lit("@host"))).when(turn == 3, "@example.org").when(turn == 4, "  ")
        .when(turn == 5, "a b@example.org").when(turn == 6, F.concat(F.repeat(F.lit("a"), F.lit(250)), F.lit("@example.org")))
        .when(turn == 7, "a@b..org").otherwise(F.concat(c, F.lit("@sub.example.co.uk")))
    )
    return d.raw("customer").select(k.alias("id"), tx.normalise_email(raw).alias("email")).withColumn(
        "problem", tx.email_problem(F.col("email"))
    )


@query(
    "card_scalars",
    f"""SELECT seq, upper(substring(species_id, 1, 1)) AS initial, {avatar_sql('user_id')} AS avatar_bg,
              (mins // 60) || 'h ' || (mins % 60) || 'm' AS time, mins // 60 AS hours,
              CASE mins % 5 WHEN 1 THEN '#FFD700' WHEN 3 THEN '#c98b4a' ELSE '#8fa8b5' END AS medal,
              CASE WHEN idle < 300000 THEN 'Active now' WHEN idle // 60000 < 60 THEN 'Last seen ' || (idle // 60000) || 'm ago'
                   WHEN idle // 3600000 < 24 THEN 'Last seen ' || (idle // 3600000) || 'h ago'
                   ELSE 'Last seen ' || (idle // 86400000) || 'd ago' END AS status,
              sha256(user_id) AS token_hash, ts + INTERVAL 365 DAY AS session_expires, ts + INTERVAL 24 HOUR AS link_expires,
              {minted_sql('d', 'user_id', 'seq')} AS minted
       FROM (SELECT *, date_diff('microsecond', ts, TIMESTAMP '2024-01-31 00:00:00') // 1000 AS idle FROM dives)""",
)
def card_scalars(d):
    mins, ts, as_of = F.col("mins").cast("bigint"), F.col("ts"), instant("2024-01-31 00:00:00")
    return d.dives.select(
        "seq",
        sc.initial_of(F.col("species_id")).alias("initial"),
        sc.avatar_colour(F.col("user_id")).alias("avatar_bg"),
        sc.hours_minutes(mins).alias("time"),
        sc.whole_hours(mins).alias("hours"),
        sc.medal_colour(mins % 5).alias("medal"),
        sc.presence(ts, as_of).alias("status"),
        F.sha2("user_id", 256).alias("token_hash"),
        sc.session_expiry(ts).alias("session_expires"),
        sc.link_expiry(ts).alias("link_expires"),
        sc.minted_id("d", F.col("user_id"), F.col("seq")).alias("minted"),
    )


@query(
    "numbers_and_flags",
    """SELECT event_id, CASE WHEN event_id % 10 < 5 THEN least(120.0, greatest(0.0, value - 50)) WHEN event_id % 10 = 5 THEN 120.0 ELSE 0.0 END AS mins,
              CAST(floor(value + 0.5) AS INTEGER) AS rounded, event_id % 4 = 0 AS verified
       FROM events""",
)
def numbers_and_flags(d):
    e = F.col("event_id")
    text = F.when(e % 10 < 5, (F.col("value") - 50).cast("string")).when(e % 10 == 5, "Infinity").when(e % 10 == 6, "NaN").when(
        e % 10 == 7, "12d").when(e % 10 == 8, "")
    flag = F.when(e % 4 == 0, "true").when(e % 4 == 1, "True").when(e % 4 == 2, "1")
    return d.raw("events").select(
        "event_id", sc.clamp_minutes(text).alias("mins"), sc.round_half_up(F.col("value")).alias("rounded"),
        sc.verified_flag(flag).alias("verified"),
    )


@query("capped_text", "SELECT doc_id, substring(text, 1, 500) AS text FROM documents")
def capped_text(d):
    return d.raw("documents").select("doc_id", sc.cap_text(F.col("text"), 500).alias("text"))


@query(
    "shaped_rooms",
    """SELECT id, name, kind, depth, schedule, start_min AS startMin, start_at AS startAt, host_id AS hostId FROM rooms""",
)
def shaped_rooms(d):
    return sc.api_names(d.rooms.select("id", "name", "kind", "depth", "schedule", "start_min", "start_at", "host_id"))


@query("shaped_creatures", "SELECT id, species_id AS speciesId, nickname, caught_at AS caughtAt FROM user_creatures")
def shaped_creatures(d):
    return sc.api_names(d.user_creatures.select("id", "species_id", "nickname", "caught_at"))


@query(
    "name_checks",
    f"""WITH {NAMES_SQL.replace("names AS (", "untrimmed AS (", 1)},
  names AS (SELECT DISTINCT {trim_sql('name')} AS name FROM untrimmed), {VERDICT},
  reasoned AS (SELECT name, {_problem_sql(2, 20)} AS problem FROM judged)
  SELECT r.name, problem IS NULL AND o.id IS NULL AS available, coalesce(problem, CASE WHEN o.id IS NOT NULL THEN 'name taken' END) AS reason
  FROM reasoned r LEFT JOIN (SELECT id, replace(c.name, '#', ' ') AS name FROM accounts c) o ON lower(o.name) = lower(r.name) AND o.id <> 'u7'
  UNION ALL SELECT 'Customer 000000007', true, NULL""",
)
def name_checks(d):
    """Each name asked for by a diver who may keep their own, u7, with blanks around it."""
    people = d.accounts.withColumn("name", F.replace("name", F.lit("#"), F.lit(" ")))
    wanted = names(d).select(tx.trim_all(F.col("name")).alias("name")).distinct()
    wanted = wanted.unionByName(people.filter("id = 'u7'").select(F.lit("Customer 000000007").alias("name")))
    asked = wanted.select(F.xxhash64("name").alias("request_id"), F.concat(F.lit("  "), "name", F.lit("\t")).alias("name"), F.lit("u7").alias("self_id"))
    return accounts.name_checks(asked, people).drop("request_id")
