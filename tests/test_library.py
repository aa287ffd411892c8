"""Plan shapes, erasure, files, entry contract."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lagoon import schemas
from lagoon.operators import accounts, audit, social
from lagoon.registry import entries, run
from lagoon.registry.accounts import number, tables
from lagoon.sources import files
from lagoon.sources.domain import load_domain

LOOPS = {"settle_trades", "settle_lone_trades", "assign_names"}


@pytest.mark.parametrize("name", [n for n in entries() if n not in LOOPS and not n.startswith("stream")])
def test_no_nested_loops_or_python_rows(name, spark, small):
    plan = run(name, spark, small)._jdf.queryExecution().executedPlan().toString()
    for bad in ("NestedLoop", "CartesianProduct", "EvalPython", "InPandas"):
        assert bad not in plan


def test_week_filter_reaches_the_scan(spark, small):
    from lagoon.operators.activity import this_week
    from lagoon.sources.domain import AS_OF, instant

    plan = this_week(load_domain(spark, small).dives, instant(AS_OF))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-29" in plan and "ReadSchema: struct<ts:timestamp,user_id:bigint,value:double>" in plan


def test_closure_is_symmetric(spark, small):
    pairs = {tuple(r) for r in social.symmetric_closure(load_domain(spark, small).blocks).collect()}
    assert pairs and {(b, a) for a, b in pairs} == pairs


def test_erasure_leaves_no_orphans(spark, small):
    d = load_domain(spark, small)
    before = tables(d)
    after = accounts.erase_accounts(before, d.accounts.filter(number("id") % 25 == 7))
    assert after["rooms"].count() < d.rooms.count()
    orphans = lambda t: {(r.child, r.column): r.orphans for r in audit.audit_foreign_keys(t).collect() if r.orphans}
    # The retired counts name users that never had an account; nothing else may dangle.
    assert set(orphans(before)) == {("user_species", "user_id")}
    assert orphans(after) == orphans(before)


def test_tables_round_trip_with_added_columns(spark, tmp_path):
    old = spark.createDataFrame([("t1", "a", "b", "x", "y")], "id string, from_id string, to_id string, give_id string, get_id string")
    files.write_table(old, str(tmp_path), "trades")
    back = files.read_table(spark, str(tmp_path), "trades")
    assert [f.name for f in back.schema.fields] == [f.name for f in schemas.TRADES.fields]
    assert back.first().status == "pending" and back.first().give_creature_id is None


def test_json_files_keep_bad_lines(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"type":"A"}\n{broken\n')
    got = files.read_json_events(spark, str(tmp_path / "e.json"), schemas.PURCHASE_EVENT).collect()
    assert sorted((r.type or "", r._corrupt_record or "") for r in got) == [("", "{broken"), ("A", "")]


def test_documents_are_written_as_json(spark, small, tmp_path):
    docs = run("account_documents_json", spark, small)
    files.write_json_documents(docs, str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).count() == docs.count() > 0


def test_entry_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_schemas_cover_every_owned_table():
    assert set(schemas.TABLES) == set(accounts.OWNED_BY) == set(audit.UNIQUE)
    assert all(c in {f.name for f in schemas.TABLES[t].fields} for t, cs in accounts.OWNED_BY.items() for c in cs)


def test_page_of_creatures_is_bounded(spark, small):
    from lagoon.registry.accounts import documents

    d = load_domain(spark, small)
    docs = documents(d, page_size=3)
    assert docs.agg(F.max(F.size("creatures"))).first()[0] == 3
    assert docs.agg(F.sum(F.size("creatures"))).first()[0] == d.user_creatures.count()
