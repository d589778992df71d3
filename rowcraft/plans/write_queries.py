"""Registered queries of writes, cursors and stores, with their DuckDB SQL.

Edits follow from the data of all orders, so batches grow with the table: orders
of status F are raised, of these the urgent ones were read out of date.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowcraft.functions.scratch import scratch_path
from rowcraft.operators import audit, dml
from rowcraft.operators.cursor import Cursor
from rowcraft.operators.entity import EntityMap, Field
from rowcraft.operators.store import Store
from rowcraft.operators.tracked import Tracked, TrackedList, batch_of
from rowcraft.plans.catalogue import MAPS, OPEN_ORDERS, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, run: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = run, sql


ORDERS = EntityMap("orders", (Field("o_orderkey", "bigint", key=True), Field("o_orderstatus", "string"), Field("o_totalprice", "double"), Field("o_orderpriority", "string")))
#: The same with a row version, and with a key that inserts make.
VERSIONED = replace(ORDERS, fields=(*ORDERS.fields, Field("version", "bigint", row_version=True)))
NUMBERED = EntityMap(
    "customer",
    (Field("c_custkey", "bigint", key=True, identity=True), Field("c_name", "string"), Field("c_nationkey", "int"), Field("c_acctbal", "double"), Field("c_mktsegment", "string", nullable=False, default="NONE")),
)
#: Names are cut to eight characters; notes that are null become empty.
SHORT = EntityMap("supplier", (Field("s_suppkey", "bigint", key=True), Field("s_name", "string", length=8, trim_to_fit=True), Field("s_note", "string")))

_COLUMNS = "o_orderkey, o_orderstatus, o_totalprice, o_orderpriority"
_RAISED, _STALE = "o_orderstatus = 'F'", "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"
_GOOD = "o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*_COLUMNS.split(", "))


def _raised(df: DataFrame) -> DataFrame:
    return df.withColumn("o_totalprice", F.when(F.expr(_RAISED), F.col("o_totalprice") + 100).otherwise(F.col("o_totalprice")))


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _orders(spark, sf_dir)
    read = base.withColumn("o_totalprice", F.when(F.expr(_STALE), F.lit(-1.0)).otherwise(F.col("o_totalprice")))
    return dml.changes(_raised(base), read, ORDERS)


def _saved_state(criteria: str = "changed", affect: str = "changed") -> Query:
    return lambda s, d: dml.save(_orders(s, d), ORDERS, _edits(s, d), criteria, affect)[0]


def _state_sql(where: str) -> str:
    return f"SELECT o_orderkey, o_orderstatus, CASE WHEN {where} THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders"


# mass changes

_add(
    "dml_update_rows",
    lambda s, d: dml.update_rows(_orders(s, d), ORDERS, {"o_orderstatus": "X", "o_totalprice": lambda o: o.o_totalprice * 2}, lambda o: o.o_totalprice > 300000),
    "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 300000 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders",
)
_add("dml_count_hits", lambda s, d: s.createDataFrame([(dml.count_hits(_orders(s, d), ORDERS, lambda o: o.o_totalprice > 300000),)], "n bigint"), "SELECT count(*) AS n FROM orders WHERE o_totalprice > 300000")
_add(
    "dml_delete",
    lambda s, d: dml.delete(table(s, d, "open_orders"), OPEN_ORDERS, lambda o: o.status == "F"),
    "SELECT * FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders) WHERE status IS DISTINCT FROM 'F'",
)
_add("dml_delete_items", lambda s, d: dml.delete_items(_orders(s, d), ORDERS, _orders(s, d).filter("o_orderstatus = 'O'")), f"SELECT {_COLUMNS} FROM orders WHERE o_orderstatus <> 'O'")

# inserts

_add(
    "dml_insert",
    lambda s, d: dml.insert(_orders(s, d), ORDERS, _orders(s, d).withColumn("o_orderkey", F.col("o_orderkey") + 90000000)),
    f"SELECT {_COLUMNS} FROM orders UNION ALL SELECT o_orderkey + 90000000, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
)


def _new_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"))
    return dml.insert(table(spark, sf_dir, "customer"), NUMBERED, rows)


_add(
    "dml_insert_identity",
    lambda s, d: _new_customers(s, d).select("c_custkey"),
    "SELECT c_custkey FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER () FROM supplier",
)
_add(
    "dml_insert_defaults",
    lambda s, d: _new_customers(s, d).select("c_name", "c_acctbal", "c_mktsegment"),
    "SELECT c_name, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT s_name, s_acctbal, 'NONE' FROM supplier",
)
_add(
    "dml_insert_version",
    lambda s, d: dml.insert(_orders(s, d).withColumn("version", F.lit(7).cast("bigint")), VERSIONED, _orders(s, d).withColumn("o_orderkey", -F.col("o_orderkey") - 1)).select("o_orderkey", "version"),
    "SELECT o_orderkey, 7::BIGINT AS version FROM orders UNION ALL SELECT -o_orderkey - 1, 1::BIGINT FROM orders",
)


def _short_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_acctbal") > 0, F.lit("paid")).alias("s_note"))
    return dml.insert(rows.limit(0), SHORT, rows, null_text="")


_add("dml_trim_to_fit", _short_suppliers, "SELECT s_suppkey, substring(s_name, 1, 8) AS s_name, CASE WHEN s_acctbal > 0 THEN 'paid' ELSE '' END AS s_note FROM supplier")

# bulk updates

_add(
    "dml_bulk_update",
    lambda s, d: dml.bulk_update(_orders(s, d), ORDERS, _orders(s, d).filter("o_orderpriority = '2-HIGH'").withColumn("o_totalprice", F.lit(1.5)), ["o_totalprice"]),
    "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderpriority = '2-HIGH' THEN 1.5 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders",
)


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order of status F twice; the second change comes last."""
    rows = _orders(spark, sf_dir).filter(_RAISED)
    first, second = rows.withColumns({"o_totalprice": F.lit(0.0), "at": F.lit(1)}), rows.withColumns({"o_totalprice": F.col("o_totalprice") + 100, "at": F.lit(2)})
    return second.unionByName(first)


_add("dml_bulk_update_repeated", lambda s, d: dml.bulk_update(_orders(s, d), ORDERS, _repeated(s, d), ["o_totalprice"], order_by="at"), _state_sql(_RAISED))


def _table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of a table: changed twice, deleted, added and changed, added and deleted again."""
    base = _orders(spark, sf_dir)
    twice = _repeated(spark, sf_dir).withColumn("_state", F.lit(dml.MODIFIED))
    gone = base.filter("o_orderstatus = 'P'").withColumns({"_state": F.lit(dml.DELETED), "at": F.lit(1)})
    new = base.filter("o_orderstatus = 'O'").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    added, then = new.withColumns({"_state": F.lit(dml.ADDED), "at": F.lit(1)}), F.when(F.col("o_orderpriority") == "5-LOW", dml.DELETED).otherwise(dml.MODIFIED)
    changed = new.withColumns({"_state": then, "at": F.lit(2), "o_totalprice": F.lit(3.0)})
    return twice.unionByName(gone).unionByName(added).unionByName(changed)


_add(
    "dml_save_table",
    lambda s, d: dml.save_table(_orders(s, d), ORDERS, _table_rows(s, d), "at"),
    f"SELECT * FROM ({_state_sql(_RAISED)}) WHERE o_orderstatus <> 'P' UNION ALL SELECT -o_orderkey - 1, o_orderstatus, 3.0, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW'",
)

# saves with outcomes

_add(
    "dml_save_outcomes",
    lambda s, d: dml.outcomes(_orders(s, d), ORDERS, _edits(s, d)).select("_new.o_orderkey", "outcome"),
    f"SELECT o_orderkey, CASE WHEN {_STALE} THEN 'Conflict' WHEN {_RAISED} THEN 'Success' ELSE 'Skipped' END AS outcome FROM orders",
)
_add(
    "dml_save_fail",
    lambda s, d: dml.outcomes(_orders(s, d), ORDERS, _edits(s, d), select_back=False).select("_new.o_orderkey", "outcome"),
    f"SELECT o_orderkey, CASE WHEN {_STALE} THEN 'Fail' WHEN {_RAISED} THEN 'Success' ELSE 'Skipped' END AS outcome FROM orders",
)
_add("dml_save_state", _saved_state(), _state_sql(_GOOD))
_add("dml_save_key", _saved_state("key"), _state_sql(_RAISED))
_add("dml_save_affect_all", _saved_state("changed", "all"), _state_sql(_GOOD))


def _all_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prices are raised; others changed the status of urgent orders meanwhile."""
    base = _orders(spark, sf_dir)
    read = base.withColumn("o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("?")).otherwise(F.col("o_orderstatus")))
    return dml.outcomes(base, ORDERS, dml.changes(read.withColumn("o_totalprice", F.col("o_totalprice") + 1), read, ORDERS), "all")


_add("dml_save_all_fields", lambda s, d: _all_fields(s, d).select("_new.o_orderkey", "outcome"), "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Conflict' ELSE 'Success' END AS outcome FROM orders")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders were read at an older version."""
    base = _orders(spark, sf_dir).withColumn("version", F.lit(7).cast("bigint"))
    read = base.withColumn("version", F.when(F.col("o_orderpriority") == "1-URGENT", 6).otherwise(7).cast("bigint"))
    return dml.save(base, VERSIONED, dml.changes(_raised(read), read, VERSIONED), "version")[0]


_add("dml_save_version", _versions, f"SELECT *, CASE WHEN {_GOOD} THEN 8 ELSE 7 END::BIGINT AS version FROM ({_state_sql(_GOOD)}) t".replace(f"CASE WHEN {_GOOD} THEN 8", "CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' THEN 8"))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By priority: deleted, changed, changed but stale, added over a taken key, added."""
    base = _orders(spark, sf_dir)
    p = F.substring("o_orderpriority", 1, 1)
    row = lambda key, price: F.struct(key.alias("o_orderkey"), "o_orderstatus", price.alias("o_totalprice"), "o_orderpriority")
    new = F.when(p == "5", row(-F.col("o_orderkey") - 1, F.col("o_totalprice"))).otherwise(row(F.col("o_orderkey"), F.col("o_totalprice") + 100))
    read = F.when(p == "3", row(F.col("o_orderkey"), F.lit(-1.0))).when(p.isin("1", "2"), row(F.col("o_orderkey"), F.col("o_totalprice")))
    return base.select(F.when(p == "1", dml.DELETED).when(p.isin("4", "5"), dml.ADDED).otherwise(dml.MODIFIED).alias("_state"), new.alias("_new"), read.alias("_orig"))


_MIXED_OUTCOME = "CASE substring(o_orderpriority, 1, 1) WHEN '3' THEN 'Conflict' WHEN '4' THEN 'Fail' ELSE 'Success' END"
_add(
    "dml_save_mixed",
    lambda s, d: dml.save(_orders(s, d), ORDERS, _mixed(s, d))[1].select("_new.o_orderkey", "_state", "outcome"),
    f"SELECT CASE WHEN o_orderpriority LIKE '5%' THEN -o_orderkey - 1 ELSE o_orderkey END AS o_orderkey, CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'Deleted' WHEN '4' THEN 'Added' WHEN '5' THEN 'Added' ELSE 'Modified' END AS _state, {_MIXED_OUTCOME} AS outcome FROM orders",
)
_add("dml_outcome_counts", lambda s, d: dml.outcome_counts(dml.outcomes(_orders(s, d), ORDERS, _mixed(s, d))), f"SELECT {_MIXED_OUTCOME} AS outcome, count(*) AS n FROM orders GROUP BY 1")
_add(
    "dml_save_mixed_state",
    lambda s, d: dml.save(_orders(s, d), ORDERS, _mixed(s, d))[0],
    "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderpriority LIKE '2%' THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority NOT LIKE '1%' "
    "UNION ALL SELECT -o_orderkey - 1, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority LIKE '5%'",
)


def _read_back(what: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        state, judged = dml.save(_orders(spark, sf_dir), ORDERS, _edits(spark, sf_dir))
        return dml.read_back(state, ORDERS, judged, what)

    return run


_add("dml_read_back", _read_back("unchanged"), f"SELECT o_orderkey, o_orderstatus, NULL::DOUBLE AS o_totalprice, o_orderpriority FROM orders WHERE {_GOOD}")
_add("dml_read_back_all", _read_back("all"), f"SELECT o_orderkey, o_orderstatus, o_totalprice + 100 AS o_totalprice, o_orderpriority FROM orders WHERE {_GOOD}")
_add("dml_read_back_made", _read_back("made"), f"SELECT o_orderkey FROM orders WHERE {_GOOD}")
_add("dml_before_save", lambda s, d: dml.save(_orders(s, d), ORDERS, _edits(s, d), before_save=lambda b: b.filter("_new.o_orderpriority = '2-HIGH'"))[0], _state_sql(f"{_RAISED} AND o_orderpriority = '2-HIGH'"))
_add(
    "audit_changes",
    lambda s, d: audit.audit(_edits(s, d), ORDERS).select("key", "state", "property", F.col("old").cast("double").alias("old"), F.col("new").cast("double").alias("new")),
    f"SELECT o_orderkey::VARCHAR AS key, 'Modified' AS state, 'o_totalprice' AS property, CASE WHEN {_STALE} THEN -1.0 ELSE o_totalprice END AS old, o_totalprice + 100 AS new FROM orders WHERE {_RAISED}",
)
_add(
    "audit_xml",
    lambda s, d: audit.audit_xml(_edits(s, d), ORDERS).select("key", F.regexp_extract("changes", "<property>(.*)</property>", 1).alias("property"), F.regexp_extract("changes", "<new>(.*)</new>", 1).cast("double").alias("new")),
    f"SELECT o_orderkey::VARCHAR AS key, 'o_totalprice' AS property, o_totalprice + 100 AS new FROM orders WHERE {_RAISED}",
)
_add(
    "conflicts",
    lambda s, d: audit.conflicts(_orders(s, d), ORDERS, _edits(s, d)).select("key", "property", F.col("current").cast("double").alias("current"), F.col("attempted").cast("double").alias("attempted")),
    f"SELECT o_orderkey::VARCHAR AS key, 'o_totalprice' AS property, o_totalprice AS current, o_totalprice + 100 AS attempted FROM orders WHERE {_STALE}",
)

# tracked rows, cursors, stores


def _tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations edited one by one: one region renamed, another deleted, one more added."""
    base, of = table(spark, sf_dir, "nation"), MAPS["nation"]
    rows = TrackedList(Tracked(of, r) for r in base.collect())
    for row in list(rows):
        if row.n_regionkey == 1:
            row.n_name = row.n_name.lower()
        elif row.n_regionkey == 2:
            rows.remove(row)
    rows.append(Tracked(of, {"n_nationkey": 99, "n_name": "NEW", "n_regionkey": 0}).attach_new())
    return dml.save(base, of, batch_of(spark, of, rows.to_save()))[0]


_add("dml_tracked_rows", _tracked, "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 99, 'NEW', 0")


def _cursor_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk over the nations that edits, adds and deletes."""
    base = table(spark, sf_dir, "nation")
    cursor = Cursor(spark)
    cursor.open(base.orderBy("n_nationkey"))
    while cursor.find_next("n_regionkey = 3"):
        cursor["n_name"] = f"{cursor['n_name']}!"
        if not cursor.move_next():
            break
    cursor.move_first()
    cursor.delete()
    cursor.add_row({"n_nationkey": 77, "n_name": "ADDED", "n_regionkey": 4})
    cursor["n_name"] = "ADDED THEN CHANGED"
    cursor.init_update("nation", "n_nationkey")
    return cursor.update_batch(base)


_add(
    "cursor_update_batch",
    _cursor_edits,
    "SELECT n_nationkey, CASE WHEN n_regionkey = 3 THEN n_name || '!' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey <> (SELECT min(n_nationkey) FROM nation) UNION ALL SELECT 77, 'ADDED THEN CHANGED', 4",
)


def _cursor_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a cursor stands after each move, and what it reads there."""
    cursor, seen = Cursor(spark), []
    rows = cursor.open(table(spark, sf_dir, "region").orderBy("r_regionkey"))

    def note(step: str, valid: bool) -> None:
        seen.append((step, valid, cursor.position, rows, cursor.bof, cursor.eof, cursor["r_name"] if valid else None))

    note("open", True)
    for step, move in (("next", cursor.move_next), ("last", cursor.move_last), ("beyond", cursor.move_next), ("previous", cursor.move_previous), ("first", cursor.move_first), ("before", cursor.move_previous), ("by 3", lambda: cursor.move(3))):
        note(step, move())
    cursor.move_first()
    note("find", cursor.find_next("r_regionkey = 2"))
    note("requery", bool(cursor.requery()))
    return spark.createDataFrame(seen, "step string, valid boolean, position int, records int, bof boolean, eof boolean, name string")


_add(
    "cursor_moves",
    _cursor_moves,
    "WITH n AS (SELECT count(*)::INT AS n FROM region), r AS (SELECT r_name, (row_number() OVER (ORDER BY r_regionkey) - 1)::INT AS p FROM region), "
    "m(step, valid, position) AS (SELECT * FROM (VALUES ('open', true, 0), ('next', true, 1), ('first', true, 0), ('before', false, -1), ('by 3', true, 2), ('find', true, 2), ('requery', true, 0)) "
    "UNION ALL SELECT 'last', true, n - 1 FROM n UNION ALL SELECT 'beyond', false, n FROM n UNION ALL SELECT 'previous', true, n - 1 FROM n) "
    "SELECT step, valid, position, n AS records, position < 0 AS bof, position >= n AS eof, r_name AS name FROM m CROSS JOIN n LEFT JOIN r ON p = position",
)


def _transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables changed in one transaction, and one that fails changes neither."""
    store = Store(spark, scratch_path(spark, "store"))
    for name in ("orders", "nation"):
        store.replace(name, table(spark, sf_dir, name))
    with store.transaction("clerk") as t:
        t.write("orders", dml.delete(t.read("orders"), MAPS["orders"], lambda o: o.o_orderstatus == "F"))
        t.write("nation", dml.delete(t.read("nation"), MAPS["nation"], lambda n: n.n_regionkey == 1))
    try:
        with store.transaction() as t:
            t.write("nation", t.read("nation").limit(0))
            raise LookupError("the caller gives up")
    except LookupError:
        pass
    left = store.read("orders").select(F.lit("orders").alias("t"), F.col("o_orderkey").alias("k")).unionByName(store.read("nation").select(F.lit("nation").alias("t"), F.col("n_nationkey").cast("bigint").alias("k")))
    said = store.history().filter("context = 'clerk'").groupBy().count()
    return left.crossJoin(F.broadcast(said.select(F.col("count").alias("tables"))))


_add("store_transaction", _transaction, "SELECT 'orders' AS t, o_orderkey AS k, 2::BIGINT AS tables FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'nation', n_nationkey::BIGINT, 2 FROM nation WHERE n_regionkey <> 1")


def _view_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads a view of customers and nations, writes the customer table."""
    of = EntityMap("customer_view", (Field("c_custkey", "bigint", key=True), Field("c_acctbal", "double"), Field("n_name", "string", access="r")), save_to="customer")
    customers = table(spark, sf_dir, "customer")
    view = customers.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    read = of.project(view)
    new = read.withColumn("c_acctbal", F.when(F.col("n_name") == F.lit("FRANCE"), F.col("c_acctbal") + 5).when(F.col("c_acctbal") < 0, F.lit(0.0)).otherwise(F.col("c_acctbal")))
    return dml.bulk_update(customers, of, new, ["c_acctbal"])


_add(
    "view_write_model",
    _view_write,
    "SELECT c_custkey, c_name, c_nationkey, CASE WHEN n_name = 'FRANCE' THEN c_acctbal + 5 WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
