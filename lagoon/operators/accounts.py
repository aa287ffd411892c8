"""Accounts: sign-in records, links, identities, names, erasure, documents."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.functions.moderation import DEFAULT_LEXICON
from lagoon.functions.scalars import avatar_colour, cap_text, initial_of, minted_id
from lagoon.functions.text import email_problem, name_problem, normalise_email, trim_all
from lagoon.functions.tokens import bearer_token, token_hash
from lagoon.operators.collection import collections, creature_log
from lagoon.operators.social import name_availability
from lagoon.plans.holdings import grant_in_turn
from lagoon.plans.matching import assign_preferences, grant_in_order
from lagoon.plans.skew import first_per_key, left_join_known
from lagoon.session import cut_lineage

SAFE_COLUMNS = ["id", "name", "initial", "avatar_bg", "avatar_url", "email", "email_verified_at", "last_seen"]
PAGE = 1_000


def safe_users(users: DataFrame) -> DataFrame:
    """What a client may see; credentials are never selected."""
    return users.select(*SAFE_COLUMNS)


def live_sessions(sessions: DataFrame, as_of: Column) -> DataFrame:
    return sessions.filter(F.col("expires_at") > as_of)


def prune_expired(df: DataFrame, as_of: Column) -> DataFrame:
    """Keeps what expires exactly now: dead on use, but not yet pruned."""
    return df.filter(~(F.col("expires_at") < as_of))


def legacy_accounts(users: DataFrame) -> DataFrame:
    """Accounts nobody can sign in to."""
    return users.filter("password_hash is null and apple_sub is null and email is null")


def verification_targets(users: DataFrame) -> DataFrame:
    outcome = F.when(F.coalesce("email", F.lit("")) == "", "no email").when(
        F.col("email_verified_at").isNotNull(), "already verified"
    )
    return users.select(F.col("id").alias("user_id"), "email", outcome.otherwise("eligible").alias("outcome"))


def resolve_requests(log: DataFrame, sessions: DataFrame, users: DataFrame) -> DataFrame:
    """log(request_id, ts, header): the account behind each request, or why there is none."""
    asked = log.withColumn("_token", bearer_token(F.col("header"))).withColumn("token_hash", token_hash(F.col("_token")))
    known = sessions.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi").select(
        "token_hash", "user_id", "expires_at"
    )
    live = F.col("ts") < F.col("expires_at")
    outcome = F.when(F.col("_token").isNull(), "no token").when(live, "ok").otherwise("expired or unknown")
    return left_join_known(asked, known, ["token_hash"]).select(
        "request_id", "ts", "token_hash", F.when(live, F.col("user_id")).alias("user_id"), outcome.alias("outcome")
    )


def touch_sessions(sessions: DataFrame, resolved: DataFrame) -> DataFrame:
    """Sessions with `last_used` moved to their latest accepted request."""
    used = resolved.filter("outcome = 'ok'").groupBy("token_hash").agg(F.max("ts").alias("_used"))
    return (
        sessions.join(used, "token_hash", "left")
        .withColumn("last_used", F.greatest("last_used", F.coalesce("_used", "last_used")))
        .select(*sessions.columns)
    )


def sign_out(sessions: DataFrame, hashes: DataFrame) -> DataFrame:
    return sessions.join(hashes.select("token_hash"), "token_hash", "left_anti")


def live_links(links: DataFrame, as_of: Column) -> DataFrame:
    """One link per account: a newer one voids the older, then expiry applies."""
    latest = first_per_key(links, ["user_id"], [F.desc("created_at"), F.desc("token_hash")])
    return latest.filter(F.col("expires_at") > as_of)


def redeem_links(redemptions: DataFrame, links: DataFrame, users: DataFrame) -> DataFrame:
    """redemptions(seq, ts, token): confirmed, expired or changed.

    A link is good from its issue to its expiry or the account's next issue,
    which voids it. The first redemption in time uses a link up, also when the address has
    changed since; every other one finds it expired.
    """
    presented = redemptions.withColumn("token_hash", token_hash(F.nullif(F.col("token"), F.lit(""))))
    voided = F.lead("created_at").over(Window.partitionBy("user_id").orderBy("created_at", "token_hash"))
    issued = links.select("token_hash", "user_id", F.col("email").alias("_mailed"), "created_at", F.least("expires_at", voided).alias("_until"))
    hits = presented.join(issued, "token_hash").filter((F.col("ts") >= F.col("created_at")) & (F.col("ts") < F.col("_until")))
    first = first_per_key(hits, ["token_hash"], [F.asc("seq")])
    now = users.select(F.col("id").alias("user_id"), F.col("email").alias("_email"))
    same = F.coalesce(F.lower("_email") == F.lower("_mailed"), F.lit(False))
    judged = first.join(now, "user_id", "left").select(
        "seq", "user_id", F.when(same, "confirmed").otherwise("changed").alias("_outcome")
    )
    return redemptions.join(judged, "seq", "left").select(
        "seq", "ts", "user_id", F.coalesce("_outcome", F.lit("expired")).alias("outcome")
    )


# Fixed value: how long a verification link is good.
LINK_HOURS = 24


def issue_links(links: DataFrame, requests: DataFrame, users: DataFrame) -> DataFrame:
    """links after requests(seq, ts, user_id, token): an account's older links go, its last request's is new.

    Requests for unknown accounts, or for accounts without an address, change nothing.
    """
    mailed = users.filter("email is not null").select(F.col("id").alias("user_id"), F.lower("email").alias("email"))
    last = first_per_key(requests.filter("user_id is not null"), ["user_id"], [F.desc("seq")]).join(mailed, "user_id")
    fresh = last.select(
        token_hash(F.col("token")).alias("token_hash"), "user_id", "email", F.col("ts").alias("created_at"),
        (F.col("ts") + F.make_interval(hours=F.lit(LINK_HOURS))).alias("expires_at"),
    )
    return links.join(last.select("user_id"), "user_id", "left_anti").select(*fresh.columns).unionByName(fresh)


def name_checks(requests: DataFrame, users: DataFrame, lexicon=DEFAULT_LEXICON) -> DataFrame:
    """requests(request_id, name, self_id): available or not, and why: a problem of the trimmed name, or taken by another."""
    asked = requests.withColumn("name", trim_all(F.coalesce("name", F.lit(""))))
    free = name_availability(asked, users)
    reason = F.coalesce(name_problem(F.col("name"), lexicon), F.when(~F.col("available"), "name taken"))
    return free.select("request_id", "name", reason.isNull().alias("available"), reason.alias("reason"))


def confirm_emails(users: DataFrame, redeemed: DataFrame) -> DataFrame:
    done = redeemed.filter("outcome = 'confirmed'").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("_at"))
    return (
        users.join(done, "id", "left")
        .withColumn("email_verified_at", F.coalesce("_at", "email_verified_at"))
        .select(*users.columns)
    )


def resolve_identities(claims: DataFrame, users: DataFrame) -> DataFrame:
    """claims(seq, sub, email, email_verified): known, linked, created or conflict, in arrival order.

    A verified address links to its account when that has no subject yet. An
    address that cannot be linked must be free. A subject settled earlier in the
    batch is known afterwards. Every known, linked or created claim names its
    account; a created one's id is minted from the subject.
    """
    subs = users.filter("apple_sub is not null").select(F.col("apple_sub").alias("sub"), F.col("id").alias("_by_sub"))
    mails = users.filter("email is not null").select(
        F.lower("email").alias("_mail"), F.col("id").alias("_by_mail"), F.col("apple_sub").alias("_mail_sub")
    )
    looked = (
        claims.withColumn("_mail", normalise_email(F.col("email")))
        .join(subs, "sub", "left")
        .join(mails, "_mail", "left")
    )
    verified = F.coalesce("email_verified", F.lit(False))
    path = (
        F.when(F.col("_by_sub").isNotNull(), "known")
        .when(F.col("_by_mail").isNull(), "created")
        .when(verified & F.col("_mail_sub").isNull(), "linked")
        .otherwise("conflict")
    )
    looked = looked.withColumn("_path", path)
    account = F.when(F.col("_path") == "created", minted_id("u", F.lit("subject"), F.col("sub"))).otherwise(F.col("_by_mail"))
    able = looked.filter(F.col("_path").isin("created", "linked")).select("seq", "sub", "_mail", account.alias("_account"))
    won = grant_in_order(able.select("seq", "sub", "_mail"), "seq", "sub", "_mail").withColumn("_won", F.lit(True))
    settled = able.join(won, "seq").select("sub", F.col("seq").alias("_settled"), "_account")
    outcome = (
        F.when(F.col("_path") == "known", "known")
        .when(F.col("_won"), F.col("_path"))
        .when(F.col("seq") > F.col("_settled"), "known")
        .otherwise("conflict")
    )
    return (
        looked.join(won, "seq", "left")
        .join(settled, "sub", "left")
        .withColumn("outcome", outcome)
        .select(
            "seq", "sub", "outcome",
            F.when(F.col("_path") == "known", F.col("_by_sub"))
            .when(F.col("outcome") != "conflict", F.col("_account"))
            .alias("user_id"),
        )
    )


@dataclass(frozen=True)
class SignedIn:
    outcomes: DataFrame
    users: DataFrame
    stats: DataFrame


def sign_in(claims: DataFrame, users: DataFrame, as_of: Column, lexicon=DEFAULT_LEXICON) -> SignedIn:
    """The accounts after claims(seq, sub, email, email_verified, name), and the stats rows of new ones.

    A linked account gets the subject. A created one gets a free name near the
    wanted one, earlier claims first, the address, and the time of its verification if
    the claim vouches for it.
    """
    outcomes = cut_lineage(resolve_identities(claims, users))
    linked = outcomes.filter("outcome = 'linked'").select(F.col("user_id").alias("id"), F.col("sub").alias("_sub"))
    made = outcomes.filter("outcome = 'created'").select("seq", "sub", F.col("user_id").alias("id"))
    made = made.join(claims.select("seq", "email", "email_verified", F.col("name").alias("preferred")), "seq")
    names = assign_names(made.select("seq", "preferred"), users, lexicon)
    created = made.join(names, "seq").select(
        "id", "name", initial_of(F.col("name")).alias("initial"), avatar_colour(F.col("sub")).alias("avatar_bg"),
        normalise_email(F.col("email")).alias("email"), F.col("sub").alias("apple_sub"),
        F.when(F.col("email_verified"), as_of).alias("email_verified_at"),
    )
    kept = users.join(linked, "id", "left").withColumn("apple_sub", F.coalesce("apple_sub", "_sub")).select(*users.columns)
    return SignedIn(outcomes, kept.unionByName(created, allowMissingColumns=True), created_stats(created))


def signup_outcomes(raw: DataFrame, users: DataFrame, lexicon=DEFAULT_LEXICON) -> DataFrame:
    """raw(seq, email, name): ok or the first failing rule, as if handled one by one."""
    asked = raw.select(
        "seq",
        normalise_email(F.coalesce("email", F.lit(""))).alias("email"),
        trim_all(F.coalesce("name", F.lit(""))).alias("name"),
    ).withColumn("_name", F.lower("name"))
    shape = F.coalesce(
        F.concat(F.lit("email "), email_problem(F.col("email"))),
        F.concat(F.lit("name "), name_problem(F.col("name"), lexicon)),
    )
    names = users.select(F.lower("name").alias("_name"), F.lit(True).alias("_name_taken"))
    mails = users.filter("email is not null").select(F.lower("email").alias("email"), F.lit(True).alias("_mail_taken"))
    checked = (
        asked.withColumn("_shape", shape)
        .join(names, "_name", "left")
        .join(mails, "email", "left")
        .withColumn(
            "_early",
            F.coalesce("_shape", F.when(F.col("_name_taken"), "name taken"), F.when(F.col("_mail_taken"), "email taken")),
        )
    )
    fine = checked.filter("_early is null").select("seq", "_name", "email")
    won = grant_in_order(fine, "seq", "_name", "email").withColumn("_won", F.lit(True))
    winners = fine.join(won, "seq").select("_name", F.col("seq").alias("_by"))
    outcome = F.coalesce(
        F.col("_early"),
        F.when(F.col("_won"), "ok"),
        F.when(F.col("_by") < F.col("seq"), "name taken"),
        F.lit("email taken"),
    )
    return (
        checked.join(won, "seq", "left")
        .join(winners, "_name", "left")
        .select("seq", "email", "name", outcome.alias("outcome"))
    )


def created_stats(created: DataFrame) -> DataFrame:
    """The stats row each new account begins with."""
    none = F.lit(0).cast("bigint")
    return created.select(F.col("id").alias("user_id"), none.alias("total_mins"), none.alias("dives"), none.alias("caught"))


def created_users(outcomes: DataFrame, as_of: Column) -> DataFrame:
    """Account rows for accepted sign-ups."""
    return outcomes.filter("outcome = 'ok'").select(
        minted_id("u", F.col("email")).alias("id"),
        "name",
        initial_of(F.col("name")).alias("initial"),
        avatar_colour(F.col("email")).alias("avatar_bg"),
        "email",
        as_of.alias("created_at"),
        as_of.alias("last_seen"),
    )


def rename_diver_outcomes(requests: DataFrame, users: DataFrame, lexicon=DEFAULT_LEXICON) -> DataFrame:
    """requests(seq, user_id, name): ok, a name problem, or name taken, as if handled one by one.

    A granted rename frees the diver's former name for whoever asks next. A diver
    may ask for the name they hold, in another case.
    """
    asked = requests.select("seq", "user_id", trim_all(F.coalesce("name", F.lit(""))).alias("name"))
    checked = asked.withColumns({"_key": F.lower("name"), "_early": name_problem(F.col("name"), lexicon)})
    fine = checked.filter("_early is null").select("seq", "user_id", F.col("_key").alias("key"))
    granted = grant_in_turn(fine, users.select(F.col("id").alias("user_id"), F.lower("name").alias("key")))
    outcome = F.coalesce("_early", F.when(F.col("_ok"), "ok").otherwise("name taken"))
    return checked.join(granted.withColumn("_ok", F.lit(True)), "seq", "left").select(
        "seq", "user_id", "name", outcome.alias("outcome")
    )


def apply_diver_renames(users: DataFrame, requests: DataFrame, lexicon=DEFAULT_LEXICON) -> DataFrame:
    """Users after the batch: the last accepted rename of each wins."""
    ok = rename_diver_outcomes(requests, users, lexicon).filter("outcome = 'ok'")
    last = first_per_key(ok, ["user_id"], [F.desc("seq")]).select(F.col("user_id").alias("id"), F.col("name").alias("_new"))
    return (
        users.join(last, "id", "left")
        .withColumn("initial", F.coalesce(initial_of(F.col("_new")), F.col("initial")))
        .withColumn("name", F.coalesce("_new", "name"))
        .select(*users.columns)
    )


# How a wanted name is varied.
STEM_LENGTH, FIRST_SUFFIX, LAST_SUFFIX, WANTED_LENGTH = 16, 2, 9, 20
FALLBACK_STEM, FALLBACK_BASE, FALLBACK_TRIES, FALLBACK_STRIDE = "Diver ", 1000, 3, 10**12


def assign_names(requests: DataFrame, users: DataFrame, lexicon=DEFAULT_LEXICON) -> DataFrame:
    """requests(seq, preferred): a unique name each, earlier requests first.

    The wanted name, else its stem with a suffix 2 to 9, else a number. Numbers
    come from `seq` (unique, below 10^12), so fallbacks never meet one another.
    """
    base = trim_all(cap_text(trim_all(F.coalesce("preferred", F.lit(""))), WANTED_LENGTH))
    stem = trim_all(cap_text(F.col("_base"), STEM_LENGTH))
    numbered = F.transform(
        F.sequence(F.lit(FIRST_SUFFIX), F.lit(LAST_SUFFIX)),
        lambda i: F.concat(stem, F.lit(" "), i.cast("string")),
    )
    taken = users.select(F.lower("name").alias("_key"))
    wanted = (
        requests.select("seq", base.alias("_base"))
        .filter("_base <> ''")
        .select("seq", F.posexplode(F.concat(F.array("_base"), numbered)).alias("_i", "name"))
        .filter(name_problem(F.col("name"), lexicon).isNull())
        .withColumn("_key", F.lower("name"))
        .join(taken, "_key", "left_anti")
    )
    # A request has nine wishes at most.
    wishes = (
        wanted.groupBy("seq")
        .agg(F.sort_array(F.collect_list(F.struct("_i", "name", "_key"))).alias("_w"))
        .select("seq", F.col("_w.name").alias("names"), F.col("_w._key").alias("keys"))
    )
    named = assign_preferences(wishes, "seq", "names", "keys")

    unnamed = requests.select("seq").join(named, "seq", "left_anti")
    tries = F.transform(
        F.sequence(F.lit(0), F.lit(FALLBACK_TRIES)),
        lambda i: F.concat(
            F.lit(FALLBACK_STEM), (F.col("seq") + FALLBACK_BASE + i.cast("bigint") * FALLBACK_STRIDE).cast("string")
        ),
    )
    occupied = taken.unionByName(named.select(F.lower("name").alias("_key")))
    free = (
        unnamed.select("seq", F.posexplode(tries).alias("_i", "name"))
        .withColumn("_key", F.lower("name"))
        .join(occupied, "_key", "left_anti")
    )
    fallback = free.groupBy("seq").agg(F.min_by("name", "_i").alias("_free"))
    # All numbers taken: 56 bits of a hash, which nobody is asked about.
    last = F.concat(F.lit(FALLBACK_STEM), F.substring(F.sha2(F.col("seq").cast("string"), 256), 1, 14))
    return named.unionByName(unnamed.join(fallback, "seq", "left").select("seq", F.coalesce("_free", last).alias("name")))


# How every table hangs off an account (and off a hosted room).
OWNED_BY = {
    "users": ["id"],
    "user_species": ["user_id"],
    "user_creatures": ["user_id"],
    "user_stats": ["user_id"],
    "rooms": ["host_id"],
    "room_dives": ["user_id"],
    "room_members": ["user_id"],
    "trades": ["from_id", "to_id"],
    "reports": ["reporter_id", "target_id"],
    "friendships": ["user_id", "friend_id"],
    "blocks": ["blocker_id", "blocked_id"],
    "auth_sessions": ["user_id"],
    "email_verifications": ["user_id"],
    "pearl_grants": ["user_id"],
}
ROOM_CHILDREN = ("room_dives", "room_members")


def mark_erased(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table with `erased`: whether a row goes with the given accounts(id).

    A hosted room goes for everybody, with its members and dives.
    """
    gone = ids.select("id").distinct()
    owners = {name: [(c, gone, "id") for c in OWNED_BY[name]] for name in tables}
    if "rooms" in tables:
        closed = tables["rooms"].join(gone.withColumnRenamed("id", "host_id"), "host_id", "left_semi").select("id").distinct()
        for name in ROOM_CHILDREN:
            if name in tables:
                owners[name].append(("room_id", closed, "id"))
    out = {}
    for name, df in tables.items():
        marked, flags = df, []
        for i, (column, lost, key) in enumerate(owners[name]):
            marked = marked.join(lost.select(F.col(key).alias(column), F.lit(True).alias(f"_gone{i}")), column, "left")
            flags.append(F.col(f"_gone{i}"))
        out[name] = marked.select(*df.columns, F.coalesce(*flags, F.lit(False)).alias("erased"))
    return out


def erase_accounts(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the given accounts(id) and all that depends on them."""
    return {name: df.filter("not erased").drop("erased") for name, df in mark_erased(tables, ids).items()}


def removal_counts(marked: dict[str, DataFrame]) -> DataFrame:
    """(table, removed) of tables from `mark_erased`: one aggregate, each table read once."""
    rows = [df.select(F.lit(name).alias("table"), "erased") for name, df in marked.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("table").agg(F.count_if("erased").alias("removed"))


def account_documents(
    users: DataFrame, creatures: DataFrame, stats: DataFrame, entitlements: DataFrame, page_size: int = PAGE
) -> DataFrame:
    """Per account: profile, collection, creatures, stats, entitlements.

    A document comes in pages of `page_size` creatures, oldest first, so that an
    account with any number of them never becomes one huge row. Page 0 carries
    the rest; its collection is as long as the species catalogue at most.
    """
    held = (
        collections(creatures)
        .groupBy("user_id")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("species_id", "n")))).alias("collection"))
    )
    entry = F.struct("pos", "id", "species_id", "nickname", "caught_at")
    pages = (
        creature_log(creatures)
        .withColumn("page", F.floor((F.col("pos") - 1) / F.lit(page_size)).cast("bigint"))
        .groupBy("user_id", "page")
        .agg(F.sort_array(F.collect_list(entry)).alias("creatures"))
    )
    profile = F.struct(*SAFE_COLUMNS).alias("user")
    totals = F.struct("total_mins", "dives", "caught").alias("stats")
    paid = F.struct("pro", "pro_lifetime", "pro_until", "purchased_pearls").alias("entitlements")
    head = (
        users.select(F.col("id").alias("user_id"), profile)
        .join(stats.select("user_id", totals), "user_id", "left")
        .join(entitlements.select("user_id", paid), "user_id", "left")
        .join(held, "user_id", "left")
    )
    first = F.coalesce("page", F.lit(0)) == 0
    none = F.array().cast(
        "array<struct<pos:bigint,id:string,species_id:string,nickname:string,caught_at:timestamp>>"
    )
    on_first = lambda c: F.when(first, F.col(c)).alias(c)
    return head.join(pages, "user_id", "left").select(
        "user_id",
        F.coalesce("page", F.lit(0)).cast("bigint").alias("page"),
        on_first("user"),
        F.when(first, F.coalesce("collection", F.create_map().cast("map<string,bigint>"))).alias("collection"),
        F.coalesce("creatures", none).alias("creatures"),
        on_first("stats"),
        on_first("entitlements"),
    )


def to_json_documents(documents: DataFrame) -> DataFrame:
    """Sink form: one JSON text per (account, page)."""
    body = F.struct(*[c for c in documents.columns if c not in ("user_id", "page")])
    return documents.select("user_id", "page", F.to_json(body).alias("document"))
