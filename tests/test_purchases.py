import pytest
from pyspark.sql import functions as F

from lagoon import schemas
from lagoon.operators import purchases as op

UNTIL = 1_900_000_000_000
CASES = [
    (dict(type="INITIAL_PURCHASE", product_id="pro_monthly", expiration_at_ms=UNTIL), ("pro", False, True)),
    (dict(type="RENEWAL", entitlement_ids=["pro"], expiration_at_ms=UNTIL), ("pro", False, True)),
    (dict(type="renewal", entitlement_ids=["pro"], expiration_at_ms=UNTIL), ("pro", False, True)),
    (dict(type="RENEWAL", entitlement_ids=["other"], expiration_at_ms=UNTIL), ("ignore", None, False)),
    (dict(type="INITIAL_PURCHASE", product_id="pro_lifetime"), ("pro", True, False)),
    (dict(type="NON_RENEWING_PURCHASE", product_id="pro_lifetime"), ("pro", True, False)),
    (dict(type="CANCELLATION", entitlement_ids=["pro"]), ("ignore", None, False)),
    (dict(type="BILLING_ISSUE", entitlement_ids=["pro"]), ("ignore", None, False)),
    (dict(type="TRANSFER", entitlement_ids=["pro"]), ("ignore", None, False)),
    (dict(type="EXPIRATION", product_id="pro_lifetime"), ("pro", False, False)),
    (dict(type="RENEWAL", entitlement_ids=["pro"]), ("ignore", None, False)),
    (dict(type="RENEWAL", entitlement_ids=["pro"], expiration_at_ms=0), ("ignore", None, False)),
    (dict(type="RENEWAL", entitlement_ids=["pro"], expiration_at_ms="NaN"), ("ignore", None, False)),
    (dict(type="NON_RENEWING_PURCHASE", product_id="pearls_chest", transaction_id="t"), ("pearls", None, False)),
    (dict(type="NON_RENEWING_PURCHASE", product_id="pearls_chest", original_transaction_id="t"), ("pearls", None, False)),
    (dict(type="NON_RENEWING_PURCHASE", product_id="pearls_chest", transaction_id="", original_transaction_id="t"), ("ignore", None, False)),
    (dict(type="NON_RENEWING_PURCHASE", product_id="pearls_chest"), ("ignore", None, False)),
    (dict(type="NON_RENEWING_PURCHASE", product_id="mystery", transaction_id="t"), ("ignore", None, False)),
    (dict(), ("ignore", None, False)),
]


def frame(spark, events):
    names = [f.name for f in schemas.PURCHASE_EVENT.fields]
    rows = [(i, *[None if e.get(n) is None else (e[n] if isinstance(e[n], list) else str(e[n])) for n in names]) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, "seq bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.PURCHASE_EVENT.fields))


def test_truth_table(spark):
    got = op.classify_purchases(frame(spark, [c[0] for c in CASES])).orderBy("seq").collect()
    assert [(r.kind, r.lifetime, r.until is not None) for r in got] == [c[1] for c in CASES]
    assert got[13].pearls == 3300 and got[14].transaction_id == "t" and got[-1].reason == "other type"


def test_account_and_transaction_fall_through(spark):
    row = spark.range(1).select(
        op.account_of(F.lit(""), F.lit("o")).alias("a"), op.account_of(F.lit(None).cast("string"), F.lit("")).alias("b"),
        op.transaction_of(F.lit(""), F.lit("o")).alias("c"), op.transaction_of(F.lit(None).cast("string"), F.lit("o")).alias("d"),
    ).first()
    assert tuple(row) == ("o", None, None, "o")


def test_last_null_expiry_wins_and_lifetime_sticks(spark):
    rows = [(1, "u", "pro", False, "2030-01-01"), (2, "u", "pro", True, None), (3, "u", "pro", False, "2031-01-01"), (4, "u", "pro", False, None),
            (5, "v", "pro", False, None), (6, "v", "pro", False, "2032-01-01")]
    e = spark.createDataFrame(rows, "seq bigint, user_id string, kind string, lifetime boolean, until string").withColumn("until", F.col("until").cast("timestamp"))
    got = {r.user_id: (r.pro_until is None, r.pro_lifetime) for r in op.pro_state(e).collect()}
    assert got == {"u": (True, True), "v": (False, False)}


def test_ledger_append_is_idempotent(spark):
    rows = [(1, "t1", "u", 500), (2, "t1", "v", 500), (3, "t2", "u", 1300)]
    e = spark.createDataFrame(rows, "seq bigint, transaction_id string, user_id string, pearls int").selectExpr(
        "*", "'pearls' as kind", "'p' as product_id", "timestamp'2024-01-01' as ts")
    once = op.pearl_grants(e)
    assert sorted((r.transaction_id, r.user_id) for r in once.collect()) == [("t1", "u"), ("t2", "u")]
    assert op.pearl_grants(e, once).count() == 0


@pytest.mark.parametrize("body", ['{"event":{"type":"X"}}', "{}", "nonsense", ""])
def test_parser_tolerates_anything(spark, body):
    row = op.parse_purchase_events(spark.createDataFrame([(1, body)], "seq int, value string")).first()
    assert row.product_id is None and row.type == ("X" if "X" in body else None)
