"""Purchase events: parsing, classification, ledger, entitlements."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagoon import schemas
from lagoon.functions.scalars import parse_number
from lagoon.plans.skew import first_per_key, left_join_known
from lagoon.sources.files import append_new

ENTITLEMENT = "pro"
LAST_MILLIS = 253_402_300_800_000.0  # the year 10000
# Event types by what they do to a subscription.
GRANTING = ["INITIAL_PURCHASE", "RENEWAL", "PRODUCT_CHANGE", "UNCANCELLATION"]
IGNORED = ["CANCELLATION", "BILLING_ISSUE", "TRANSFER"]
# Fixed values: (product, kind, pearls).
CATALOGUE = [
    ("pearls_handful", "pearls", 500),
    ("pearls_pouch", "pearls", 1300),
    ("pearls_chest", "pearls", 3300),
    ("pearls_haul", "pearls", 8000),
    ("pearls_trove", "pearls", 20000),
    ("pro_lifetime", "lifetime", 0),
    ("pro_monthly", "subscription", 0),
    ("pro_yearly", "subscription", 0),
]
MAX_PRODUCTS = 10_000


class Catalogue:
    """What each product is. Configuration of checked size, compiled into expressions."""

    def __init__(self, rows: Iterable[tuple[str, str, int]] = CATALOGUE):
        self.rows = list(rows)
        if len(self.rows) > MAX_PRODUCTS:
            raise ValueError(f"a catalogue may hold {MAX_PRODUCTS} products at most")

    @classmethod
    def from_table(cls, df: DataFrame) -> "Catalogue":
        return cls([tuple(r) for r in df.select("product_id", "kind", "pearls").limit(MAX_PRODUCTS + 1).collect()])

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "product_id string, kind string, pearls int")

    def of_kind(self, *kinds: str) -> list[str]:
        return [p for p, k, _ in self.rows if k in kinds]

    def pearls(self, product: Column) -> Column:
        pairs = [(p, n) for p, k, n in self.rows if k == "pearls"]
        table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
        return F.try_element_at(table, F.coalesce(product, F.lit("")))


def parse_purchase_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Webhook bodies `{"event": {…}}` to event columns; anything missing is null.

    A body that is not JSON keeps its text in `_corrupt_record`.
    """
    envelope = T.StructType(
        [T.StructField("event", schemas.PURCHASE_EVENT), T.StructField("_corrupt_record", T.StringType())]
    )
    parsed = F.from_json(
        F.col(column), envelope, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    )
    others = [c for c in lines.columns if c != column]
    return lines.withColumn("_p", parsed).select(*others, "_p.event.*", "_p._corrupt_record")


def account_of(app_user_id: Column, original_app_user_id: Column) -> Column:
    """An empty id falls through to the original one; empty again means none."""
    return F.coalesce(F.nullif(app_user_id, F.lit("")), F.nullif(original_app_user_id, F.lit("")))


def transaction_of(transaction_id: Column, original_transaction_id: Column) -> Column:
    """Only a missing id falls through to the original one; an empty result means none."""
    return F.nullif(F.coalesce(transaction_id, original_transaction_id), F.lit(""))


def classify_purchases(events: DataFrame, catalogue: Catalogue | None = None) -> DataFrame:
    """Each event with its account and its effect.

    kind is `pro` (lifetime, until), `pearls` (transaction_id, pearls) or
    `ignore` (reason). Expiration is the only event that ends access.
    """
    cat = catalogue or Catalogue()
    kind_of, product = F.upper(F.coalesce("type", F.lit(""))), F.col("product_id")
    in_list = lambda values: F.coalesce(product.isin(values), F.lit(False))
    lifetime = in_list(cat.of_kind("lifetime"))
    entitled = F.coalesce(F.array_contains("entitlement_ids", ENTITLEMENT), F.lit(False))
    grants = entitled | in_list(cat.of_kind("lifetime", "subscription"))
    pearls = cat.pearls(product)
    transaction = transaction_of(F.col("transaction_id"), F.col("original_transaction_id"))
    millis = F.nullif(parse_number(F.col("expiration_at_ms").cast("string")), F.lit(0.0))
    millis = F.when(F.abs(millis) < LAST_MILLIS, millis)  # beyond the year 9999 it is no expiry
    granting, single = kind_of.isin(GRANTING), kind_of == "NON_RENEWING_PURCHASE"

    kind = (
        F.when(granting & grants & (lifetime | millis.isNotNull()), "pro")
        .when(single & lifetime, "pro")
        .when(single & pearls.isNotNull() & transaction.isNotNull(), "pearls")
        .when(kind_of == "EXPIRATION", "pro")
        .otherwise("ignore")
    )
    reason = (
        F.when(granting & ~grants, "not entitling")
        .when(granting, "no usable expiry")
        .when(single & pearls.isNull(), "not in catalogue")
        .when(single, "transaction missing")
        .when(kind_of == "CANCELLATION", "access unchanged")
        .when(kind_of == "BILLING_ISSUE", "payment pending")
        .when(kind_of == "TRANSFER", "manual case")
        .otherwise(F.lit("other type"))
    )
    pro, paid = F.col("kind") == "pro", F.col("kind") == "pearls"
    others = [c for c in ("seq", "ts") if c in events.columns]
    return events.select(
        *others,
        account_of(F.col("app_user_id"), F.col("original_app_user_id")).alias("user_id"),
        kind.alias("kind"),
        lifetime.alias("_lifetime"),
        F.timestamp_millis(millis.cast("bigint")).alias("_until"),
        kind_of.alias("_type"),
        transaction.alias("_transaction"),
        product.alias("_product"),
        pearls.alias("_pearls"),
        reason.alias("_reason"),
    ).select(
        *others,
        "user_id",
        "kind",
        F.when(pro, F.col("_lifetime") & (F.col("_type") != "EXPIRATION")).alias("lifetime"),
        F.when(pro & ~F.col("_lifetime") & (F.col("_type") != "EXPIRATION"), F.col("_until")).alias("until"),
        F.when(paid, F.col("_transaction")).alias("transaction_id"),
        F.when(paid, F.col("_product")).alias("product_id"),
        F.when(paid, F.col("_pearls")).alias("pearls"),
        F.when(F.col("kind") == "ignore", F.col("_reason")).alias("reason"),
    )


def route_effects(effects: DataFrame, users: DataFrame) -> DataFrame:
    """Effects with `routed`: applied, no account id, unknown account or ignored."""
    known = users.select(F.col("id").alias("user_id"), F.lit(True).alias("_known"))
    routed = (
        F.when(F.col("user_id").isNull(), "no account id")
        .when(F.col("kind") == "ignore", "ignored")
        .when(F.col("_known").isNull(), "unknown account")
        .otherwise("applied")
    )
    return left_join_known(effects, known, ["user_id"]).withColumn("routed", routed).drop("_known")


def applicable(effects: DataFrame, users: DataFrame) -> DataFrame:
    ids = users.select(F.col("id").alias("user_id"))
    return effects.filter("kind <> 'ignore'").join(ids, "user_id", "left_semi")


def pearl_grants(effects: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows: the first grant of each transaction not in the ledger yet."""
    grants = effects.filter("kind = 'pearls' and user_id is not null").select(
        "seq", "transaction_id", "user_id", "product_id", "pearls", F.col("ts").alias("created_at")
    )
    if ledger is None:
        return first_per_key(grants, ["transaction_id"], [F.asc("seq")]).drop("seq")
    return append_new(ledger, grants, ["transaction_id"], [F.asc("seq")]).drop("seq")


def purchased_pearls(users: DataFrame, ledger: DataFrame) -> DataFrame:
    totals = ledger.groupBy(F.col("user_id").alias("id")).agg(F.sum(F.col("pearls").cast("bigint")).alias("_p"))
    return users.select("id").join(totals, "id", "left").select(
        F.col("id").alias("user_id"), F.coalesce("_p", F.lit(0)).cast("bigint").alias("purchased_pearls")
    )


def pro_state(effects: DataFrame) -> DataFrame:
    """Per account, in arrival order: the last expiry wins even when it is null; lifetime sticks.

    The expiry sits inside a struct, which keeps a latest null.
    """
    return (
        effects.filter("kind = 'pro' and user_id is not null")
        .groupBy("user_id")
        .agg(
            F.max_by(F.struct("until"), "seq").alias("_last"),
            F.bool_or("lifetime").alias("pro_lifetime"),
            F.max("seq").alias("seq"),
        )
        .select("user_id", F.col("_last.until").alias("pro_until"), "pro_lifetime", "seq")
    )


def merge_pro_state(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The fold continued: a later batch overwrites the expiry and keeps lifetime."""
    both = stored.select("user_id", "pro_until", "pro_lifetime", "seq").unionByName(fresh)
    return (
        both.groupBy("user_id")
        .agg(
            F.max_by(F.struct("pro_until"), "seq").alias("_last"),
            F.bool_or("pro_lifetime").alias("pro_lifetime"),
            F.max("seq").alias("seq"),
        )
        .select("user_id", F.col("_last.pro_until").alias("pro_until"), "pro_lifetime", "seq")
    )


def entitlements(users: DataFrame, effects: DataFrame, ledger: DataFrame, as_of: Column) -> DataFrame:
    """Every account's paid state at `as_of`."""
    state = pro_state(effects).drop("seq")
    live = F.coalesce(F.col("pro_until") > as_of, F.lit(False))
    return (
        purchased_pearls(users, ledger)
        .join(state, "user_id", "left")
        .withColumn("pro_lifetime", F.coalesce("pro_lifetime", F.lit(False)))
        .select("user_id", (F.col("pro_lifetime") | live).alias("pro"), "pro_lifetime", "pro_until", "purchased_pearls")
    )
