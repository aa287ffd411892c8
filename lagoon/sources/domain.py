"""Domain tables derived from the parquet inputs.

Every table is a lazy DataFrame over a declared-schema parquet scan; nothing is
read until a query needs it, and only the columns it needs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagoon import schemas
from lagoon.functions.scalars import avatar_colour

AS_OF = "2024-01-30 12:00:00"
NEVER_SEEN = "2023-12-25 00:00:00"


def instant(value) -> Column:
    """A timestamp column from a literal; columns pass through."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def uid(c) -> Column:
    return F.concat(F.lit("u"), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))


class Domain:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(schemas.INPUTS[name]).parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def n_customers(self) -> int:
        """Row count from parquet footers; a scalar the derivations take modulo."""
        return self.raw("customer").count()

    # accounts -------------------------------------------------------------

    @property
    def accounts(self) -> DataFrame:
        """Users without activity: enough for names, credentials and cards."""
        c, k = self.raw("customer"), F.col("c_custkey")
        return c.select(
            uid("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.upper(F.substring("c_name", 1, 1)).alias("initial"),
            avatar_colour(F.col("c_name")).alias("avatar_bg"),
            F.when(k % 7 != 0, F.concat(F.lower("c_name"), F.lit("@example.org"))).alias("email"),
            F.when(k % 13 != 0, F.lit("x")).alias("password_hash"),
            F.when(k % 5 == 0, F.concat(F.lit("sub"), k.cast("string"))).alias("apple_sub"),
            F.when(k % 3 == 0, F.lit("2024-01-02 00:00:00").cast("timestamp")).alias("email_verified_at"),
            F.lit(None).cast("string").alias("avatar_url"),
        )

    @property
    def last_seen(self) -> DataFrame:
        return self.raw("events").groupBy(uid("user_id").alias("id")).agg(F.max("ts").alias("last_seen"))

    @property
    def users(self) -> DataFrame:
        return self.accounts.join(self.last_seen, "id", "left").withColumn(
            "last_seen", F.coalesce("last_seen", instant(NEVER_SEEN))
        )

    @property
    def auth_sessions(self) -> DataFrame:
        e = self.raw("events").filter("event_type = 'signup'")
        return e.select(
            F.sha2(F.concat(F.lit("tok"), F.col("event_id").cast("string")), 256).alias("token_hash"),
            uid("user_id").alias("user_id"),
            F.col("ts").alias("created_at"),
            F.col("ts").alias("last_used"),
            (F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"),
        )

    @property
    def email_verifications(self) -> DataFrame:
        e = self.raw("events").filter("event_type = 'view'")
        name = F.concat(F.lit("customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
        old = F.when(F.col("event_id") % 9 == 0, F.lit("old.")).otherwise(F.lit(""))
        return e.select(
            F.sha2(F.concat(F.lit("ver"), F.col("event_id").cast("string")), 256).alias("token_hash"),
            uid("user_id").alias("user_id"),
            F.concat(old, name, F.lit("@example.org")).alias("email"),
            F.col("ts").alias("created_at"),
            (F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"),
        )

    @property
    def raw_reports(self) -> DataFrame:
        c, t, n = F.col("conv_id"), F.col("turn"), self.n_customers
        return self.raw("conversations").select(
            (c * 1000 + t).alias("seq"),
            uid(c % n).alias("reporter_id"),
            uid((3 * c + t) % n).alias("target_id"),
            F.col("text").alias("reason"),
        )

    # activity -------------------------------------------------------------

    @property
    def raw_dives(self) -> DataFrame:
        """Dive submissions as they arrive: minutes are untrusted text."""
        k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
        return self.raw("events").select(
            F.col("event_id").alias("seq"),
            uid("user_id").alias("user_id"),
            "ts",
            F.when(k == 0, F.lit("oops")).otherwise(F.floor("value").cast("string")).alias("mins"),
            F.when(F.col("event_type").isin("signup", "view", "purchase"), F.col("event_type")).alias("species_id"),
            F.when(k % 4 == 0, F.concat(F.lit(" Fin "), k.cast("string"), F.lit(" ")))
            .when(k % 4 == 1, F.lit("no/slash"))
            .when(k % 4 == 2, F.lit("   "))
            .alias("nickname"),
        )

    @property
    def dives(self) -> DataFrame:
        mins = F.least(F.lit(120), F.greatest(F.lit(0), F.floor("value").cast("int")))
        return self.raw("events").select(
            F.col("event_id").alias("seq"),
            uid("user_id").alias("user_id"),
            "ts",
            mins.alias("mins"),
            F.when(F.col("event_type").isin("signup", "view", "purchase"), F.col("event_type")).alias("species_id"),
        )

    @property
    def user_creatures(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.raw("orders").select(
            F.concat(F.lit("c"), k.cast("string")).alias("id"),
            uid("o_custkey").alias("user_id"),
            F.lower("o_orderpriority").alias("species_id"),
            F.when(k % 3 == 0, F.concat(F.lit("Nick "), (k % 97).cast("string"))).alias("nickname"),
            F.col("o_orderdate").alias("caught_at"),
        )

    @property
    def user_species(self) -> DataFrame:
        """Retired per-species counts; some are zero and some users were migrated."""
        return self.raw("part").select(
            F.concat(F.lit("u"), (F.col("p_partkey") % (2 * self.n_customers)).cast("string")).alias("user_id"),
            F.col("p_name").alias("species_id"),
            (F.col("p_partkey") % 4).cast("int").alias("count"),
        )

    # rooms ----------------------------------------------------------------

    @property
    def rooms(self) -> DataFrame:
        k = F.col("s_suppkey")
        expedition, once = k % 2 == 0, k % 3 == 0
        return self.raw("supplier").select(
            F.concat(F.lit("r"), k.cast("string")).alias("id"),
            F.col("s_name").alias("name"),
            F.when(expedition, F.lit("expedition")).otherwise(F.lit("room")).alias("kind"),
            F.when(expedition, 10 + 4 * F.col("s_nationkey")).cast("int").alias("depth"),
            F.when(once, F.lit("once")).otherwise(F.lit("daily")).alias("schedule"),
            F.when(~once, (37 * k) % 1440).cast("int").alias("start_min"),
            F.when(once, F.lit("2024-02-01 09:00:00").cast("timestamp")).alias("start_at"),
            uid("s_suppkey").alias("host_id"),
            (instant("2024-01-01 00:00:00") + F.make_interval(days=k % 28)).alias("created_at"),
        )

    @property
    def _room_lines(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .join(self.raw("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.concat(F.lit("r"), F.col("l_suppkey").cast("string")).alias("room_id"),
                uid("o_custkey").alias("user_id"),
                F.col("l_quantity").cast("int").alias("mins"),
                (10 + 2 * F.col("l_quantity").cast("int")).alias("depth"),
                F.col("l_shipdate").alias("ts"),
                F.col("l_linenumber").alias("ln"),
            )
        )

    @property
    def room_dives(self) -> DataFrame:
        return self._room_lines

    @property
    def room_dives_by_room(self) -> DataFrame:
        """The same log without the user, which spares the join to orders."""
        return self.raw("lineitem").select(
            F.concat(F.lit("r"), F.col("l_suppkey").cast("string")).alias("room_id"),
            F.col("l_quantity").cast("int").alias("mins"),
            (10 + 2 * F.col("l_quantity").cast("int")).alias("depth"),
            F.col("l_shipdate").alias("ts"),
        )

    @property
    def room_members(self) -> DataFrame:
        return (
            self._room_lines.filter("ln <= 2")
            .groupBy("room_id", "user_id")
            .agg(F.min("ts").alias("joined_at"))
        )

    # social ---------------------------------------------------------------

    def _pairs(self, scale: int, shift: int, keep: Column) -> DataFrame:
        k = F.col("c_custkey")
        other = (scale * k + shift) % self.n_customers
        return (
            self.raw("customer")
            .filter(keep & (k != other))
            .select(uid("c_custkey").alias("a"), uid(other).alias("b"), k.alias("k"))
        )

    @property
    def friendships(self) -> DataFrame:
        p = self._pairs(7, 1, F.lit(True))
        both = F.array(F.struct(F.col("a").alias("user_id"), F.col("b").alias("friend_id")),
                       F.struct(F.col("b").alias("user_id"), F.col("a").alias("friend_id")))
        return p.select(F.inline(both)).distinct().withColumn("since", instant("2024-01-01 00:00:00"))

    def lapsed(self, table: DataFrame, which: Column) -> DataFrame:
        """The whole table, some of its ids no longer what others refer to."""
        return table.withColumn("id", F.when(which, F.concat(F.lit("lapsed-"), F.col("id"))).otherwise(F.col("id")))

    @property
    def blocks(self) -> DataFrame:
        k = F.col("c_custkey")
        return (
            self._pairs(5, 2, k % 11 == 0)
            .unionByName(self._pairs(7, 1, k % 17 == 0))
            .groupBy(F.col("a").alias("blocker_id"), F.col("b").alias("blocked_id"))
            .agg(F.min(instant("2024-01-01 00:00:00") + F.make_interval(days=F.col("k") % 29)).alias("created_at"))
        )

    # trades ---------------------------------------------------------------

    @property
    def trades(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        priority = F.array(*[F.lit(p) for p in PRIORITIES])
        status = (
            F.when(F.col("o_orderstatus") == "O", "pending")
            .when(F.col("o_orderstatus") == "F", "accepted")
            .otherwise("declined")
        )
        to = (3 * c + 1) % self.n_customers
        return (
            self.raw("orders")
            .filter(c != to)
            .select(
                F.concat(F.lit("t"), k.cast("string")).alias("id"),
                uid("o_custkey").alias("from_id"),
                uid(to).alias("to_id"),
                F.lower("o_orderpriority").alias("give_id"),
                F.element_at(priority, (k % 5 + 1).cast("int")).alias("get_id"),
                status.alias("status"),
                F.col("o_orderdate").alias("created_at"),
                F.when(status != "pending", F.col("o_orderdate")).alias("resolved_at"),
                F.when(k % 4 == 0, F.concat(F.lit("c"), k.cast("string"))).alias("give_creature_id"),
                k.alias("seq"),
            )
        )

    # purchases ------------------------------------------------------------

    @property
    def purchase_events(self) -> DataFrame:
        k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
        t, e = F.col("event_type"), F.col("event_id")
        products = F.array(*[F.lit(p) for p in PRODUCTS])
        return self.raw("events").select(
            e.alias("seq"),
            "ts",
            F.when(k % 10 == 0, F.lit("")).otherwise(uid("user_id")).alias("app_user_id"),
            F.when(k % 20 != 0, uid("user_id")).alias("original_app_user_id"),
            F.when(t == "signup", "INITIAL_PURCHASE")
            .when(t == "view", "renewal")
            .when(t == "purchase", "NON_RENEWING_PURCHASE")
            .when(t == "click", "CANCELLATION")
            .when(k % 2 == 0, "EXPIRATION")
            .otherwise("BILLING_ISSUE")
            .alias("type"),
            F.element_at(products, (k % 8 + 1).cast("int")).alias("product_id"),
            F.when(k % 3 == 0, F.array(F.lit("pro"))).alias("entitlement_ids"),
            F.when(k % 25 != 0, F.concat(F.lit("tx"), (e - e % 30).cast("string"))).alias("transaction_id"),
            F.lit(None).cast("string").alias("original_transaction_id"),
            F.when(k % 15 != 0, (F.lit(1704067200000) + k.cast("bigint") * 86400000).cast("string")).alias("expiration_at_ms"),
            F.lit(None).cast("string").alias("purchased_at_ms"),
        )

    @property
    def auth_log(self) -> DataFrame:
        return self.raw("events").select(
            "event_id", "ts", uid("user_id").alias("device_key"), F.col("event_type").alias("path"),
            F.when(F.col("event_id") % 3 == 0, "GET").otherwise("POST").alias("method"),
        )


PRIORITIES = ["1-urgent", "2-high", "3-medium", "4-not specified", "5-low"]
PRODUCTS = [
    "pearls_handful", "pearls_pouch", "pearls_chest", "pearls_haul",
    "pearls_trove", "pro_lifetime", "pro_monthly", "other",
]


def load_domain(spark: SparkSession, folder: str) -> Domain:
    return Domain(spark, folder)
