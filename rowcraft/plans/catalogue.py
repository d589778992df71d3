"""Registered queries of table access, each with the same query in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowcraft.functions import convert
from rowcraft.functions.predicate import Entity, Term, join_where
from rowcraft.operators import filters, lists, params, relations
from rowcraft.operators.adapter import Adapter, select_runtime, sorted_by
from rowcraft.operators.entity import EntityMap, Field

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, run: Query, sql: str | None = None) -> None:
    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql


def queries() -> dict[str, Query]:
    from rowcraft.plans import source_queries, write_queries

    return _QUERIES | write_queries.QUERIES | source_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    from rowcraft.plans import source_queries, write_queries

    return _SQL | write_queries.SQL | source_queries.SQL


# maps


def _map(table: str, key: str | None, fields: dict[str, str]) -> EntityMap:
    return EntityMap(table, tuple(Field(n, t, key=n == key) for n, t in fields.items()))


MAPS = {
    "region": _map("region", "r_regionkey", {"r_regionkey": "int", "r_name": "string"}),
    "nation": _map("nation", "n_nationkey", {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}),
    "customer": _map("customer", "c_custkey", {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}),
    "supplier": _map("supplier", "s_suppkey", {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"}),
    "part": _map("part", "p_partkey", {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"}),
    "orders": _map("orders", "o_orderkey", {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}),
    "lineitem": _map("lineitem", None, {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}),
    "events": _map("events", "event_id", {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}),
    "documents": _map("documents", "doc_id", {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}),
    "labels": _map("labels", "doc_id", {"doc_id": "bigint", "quality": "int", "toxic": "int"}),
}

#: Documents with their labels; most have none, so these are nullable.
LABELLED = _map("labelled", "doc_id", {"doc_id": "bigint", "quality": "int", "toxic": "int"})
#: Orders whose status is null where it is P.
OPEN_ORDERS = _map("open_orders", "o_orderkey", {"o_orderkey": "bigint", "status": "string"})

_LABELLED_SQL = "(SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
_OPEN_SQL = "(SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "labelled":
        docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
        return docs.select("doc_id").join(labels, "doc_id", "left")
    if name == "open_orders":
        return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of(name: str) -> EntityMap:
    return {"labelled": LABELLED, "open_orders": OPEN_ORDERS}.get(name) or MAPS[name]


def _from(name: str) -> str:
    return {"labelled": _LABELLED_SQL, "open_orders": _OPEN_SQL}.get(name, name)


def adapter(spark: SparkSession, sf_dir: str, name: str, order_by=None) -> Adapter:
    return Adapter(spark, _of(name), table(spark, sf_dir, name), order_by)


def _filter(name: str, table: str, columns: str, predicate: Callable[[Entity], object], sql: str) -> None:
    """A predicate over one table, with a few columns returned."""
    chosen = columns.split(", ")
    _add(name, lambda s, d: adapter(s, d, table).fill(predicate).select(*chosen), f"SELECT {columns} FROM {_from(table)} t WHERE {sql}")


def _term(name: str, table: str, columns: str, term: Callable[[Entity], Term], sql: str, predicate: Callable[[Entity], object] | None = None, where: str = "true") -> None:
    """An expression as the column ``x``, and a predicate that may use it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        asked = adapter(spark, sf_dir, table)
        rows = asked.matching(predicate) if predicate else asked.table
        return rows.select(*columns.split(", "), term(Entity(_of(table))).column.alias("x"))

    _add(name, run, f"SELECT {columns}, {sql} AS x FROM {_from(table)} t WHERE {where}")


# the flagship

_add(
    "page_orders_1996",
    lambda s, d: adapter(s, d, "orders", "o_orderdate desc, o_orderkey").fill_range(10, 10, lambda o: (o.o_totalprice > 100000) & (o.o_orderdate.year == 1996)),
    "SELECT * FROM orders WHERE o_totalprice > 100000 AND year(o_orderdate) = 1996 ORDER BY o_orderdate DESC, o_orderkey LIMIT 10 OFFSET 10",
)

# scans and projections

_add("scan_all", lambda s, d: adapter(s, d, "nation").fill_all(), "SELECT * FROM nation")
_add("scan_runtime_schema", lambda s, d: select_runtime(table(s, d, "part"), ["p_partkey", "p_name"], filters.gt("p_size", 25)), "SELECT p_partkey, p_name FROM part WHERE p_size > 25")
_add("scan_renamed", lambda s, d: Adapter(s, _RENAMED, table(s, d, "nation")).fill(lambda n: n.Region == 2), 'SELECT n_nationkey AS "Id", n_name AS "Name", n_regionkey AS "Region", NULL::INT AS "Population" FROM nation WHERE n_regionkey = 2')
_add("scan_computed", lambda s, d: Adapter(s, _COMPUTED, table(s, d, "part")).fill(lambda p: p.Double > 60), "SELECT p_partkey, p_size * 2 AS \"Double\" FROM part WHERE p_size * 2 > 60")
_add("scan_procedure", lambda s, d: _PROCEDURES.call(s, "parts of brand", d, "Brand#1"), "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part WHERE starts_with(p_brand, 'Brand#1')")

_RENAMED = EntityMap("nation", (Field("Id", "int", "n_nationkey", key=True), Field("Name", "string", "n_name"), Field("Region", "int", "n_regionkey"), Field("Population", "int")))
_COMPUTED = EntityMap("part", (Field("p_partkey", "bigint", key=True), Field("Double", "int", expression="p_size * 2")))


def _procedures():
    from rowcraft.sources.registry import Registry

    made = Registry()

    @made.procedure("parts of brand")
    def parts(spark: SparkSession, sf_dir: str, brand: str) -> DataFrame:
        return adapter(spark, sf_dir, "part").fill(lambda p: p.p_brand.starts_with(brand))

    return made


_PROCEDURES = _procedures()

# predicates

for _name, _test, _sign in (
    ("eq", lambda o: o.o_orderstatus == "F", "o_orderstatus = 'F'"),
    ("neq", lambda o: o.o_orderstatus != "F", "o_orderstatus <> 'F'"),
    ("lt", lambda o: o.o_totalprice < 20000, "o_totalprice < 20000"),
    ("lte", lambda o: o.o_totalprice <= 20000, "o_totalprice <= 20000"),
    ("gt", lambda o: o.o_totalprice > 400000, "o_totalprice > 400000"),
    ("gte", lambda o: o.o_totalprice >= 400000, "o_totalprice >= 400000"),
):
    _filter(f"filter_{_name}", "orders", "o_orderkey, o_orderstatus, o_totalprice", _test, _sign)

_NOTHING = None
_filter("null_is", "labelled", "doc_id", lambda d: d.quality == _NOTHING, "quality IS NULL")
_filter("null_is_not", "labelled", "doc_id, quality", lambda d: d.quality.has_value(), "quality IS NOT NULL")
_filter("bool_and", "lineitem", "l_orderkey, l_linenumber, l_quantity", lambda x: (x.l_quantity > 45) & (x.l_returnflag == "R") & (x.l_discount < 0.05), "l_quantity > 45 AND l_returnflag = 'R' AND l_discount < 0.05")
_filter("bool_or", "lineitem", "l_orderkey, l_linenumber, l_quantity", lambda x: (x.l_quantity < 2) | (x.l_tax > 0.07) & (x.l_linestatus == "F"), "l_quantity < 2 OR (l_tax > 0.07 AND l_linestatus = 'F')")
_filter("bool_not", "open_orders", "o_orderkey, status", lambda o: ~(o.status == "F"), "NOT (status = 'F')")
_filter("arith_add", "part", "p_partkey", lambda p: p.p_size + p.p_partkey > 150, "p_size + p_partkey > 150")
_filter("arith_sub", "part", "p_partkey", lambda p: 100 - p.p_size < 60, "100 - p_size < 60")
_filter("arith_mul", "lineitem", "l_orderkey, l_linenumber", lambda x: x.l_quantity * 2 >= 90, "l_quantity * 2 >= 90")
_filter("arith_div", "part", "p_partkey, p_size", lambda p: p.p_size / 7 == 3, "p_size // 7 = 3")
_filter("arith_mod", "part", "p_partkey, p_size", lambda p: p.p_size % 5 == 2, "p_size % 5 = 2")
_filter("arith_neg", "customer", "c_custkey, c_acctbal", lambda c: -c.c_acctbal > 500, "-c_acctbal > 500")
_filter("bit_and", "part", "p_partkey, p_size", lambda p: (p.p_size & 4) == 4, "p_size & 4 = 4")
_filter("bit_or", "part", "p_partkey, p_size", lambda p: (p.p_size | 8) == 15, "p_size | 8 = 15")
_filter("coalesce_pred", "labelled", "doc_id, toxic", lambda d: d.toxic.coalesce(-1) == -1, "coalesce(toxic, -1) = -1")
_filter("ternary_pred", "labelled", "doc_id, quality, toxic", lambda d: (d.quality == 1).then(d.toxic.coalesce(0), 5) == 5, "CASE WHEN quality = 1 THEN coalesce(toxic, 0) ELSE 5 END = 5")
_filter("bool_column", "labels", "doc_id", lambda d: d.toxic, "toxic = 1")
_filter("bool_coalesce", "labelled", "doc_id", lambda d: (d.toxic == 1).coalesce(True), "coalesce(toxic = 1, true)")
_filter("const_true", "region", "r_regionkey", lambda r: True, "1 = 1")
_filter("const_false", "region", "r_regionkey", lambda r: False, "1 = 0")
_add(
    "theta_two_maps",
    lambda s, d: join_where(
        table(s, d, "supplier"), MAPS["supplier"], table(s, d, "customer"), MAPS["customer"], lambda a, b: (a.s_nationkey == b.c_nationkey) & (a.s_acctbal > b.c_acctbal) & (a.s_acctbal < 1000)
    ).select("s_suppkey", "c_custkey"),
    "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal AND s_acctbal < 1000",
)

# text

_term("str_upper", "part", "p_partkey", lambda p: p.p_name.upper(), "upper(p_name)", lambda p: p.p_name.upper().contains("RED"), "upper(p_name) LIKE '%RED%'")
_term("str_lower", "customer", "c_custkey", lambda c: c.c_mktsegment.lower(), "lower(c_mktsegment)")
_term("str_trim", "part", "p_partkey", lambda p: p.p_name.substring(0, 4).trim(), "trim(substring(p_name, 1, 4))")
_term("str_replace", "part", "p_partkey", lambda p: p.p_name.replace("e", "**"), "replace(p_name, 'e', '**')")
_term("str_substring", "part", "p_partkey", lambda p: p.p_name.substring(3), "substring(p_name, 4)")
_term("str_substring_len", "part", "p_partkey", lambda p: p.p_name.substring(p.p_size % 3, 2), "substring(p_name, p_size % 3 + 1, 2)")
_term("str_indexof", "part", "p_partkey", lambda p: p.p_name.index_of("e"), "(instr(p_name, 'e') - 1)::INT", lambda p: p.p_name.index_of("d") > 0, "instr(p_name, 'd') - 1 > 0")
_term("str_length", "part", "p_partkey", lambda p: p.p_name.length, "length(p_name)::INT", lambda p: p.p_name.length > 9, "length(p_name) > 9")
_term("str_concat", "open_orders", "o_orderkey", lambda o: o.status.concat("/", o.status), "status || '/' || status")
_filter("str_null_or_empty", "open_orders", "o_orderkey", lambda o: o.status.is_null_or_empty(), "status IS NULL OR status = ''")
_filter("str_not_null_or_empty", "open_orders", "o_orderkey", lambda o: ~o.status.is_null_or_empty(), "NOT (status IS NULL OR status = '')")
_filter("str_equals", "customer", "c_custkey", lambda c: c.c_mktsegment.equals("BUILDING"), "c_mktsegment = 'BUILDING'")
_filter("str_equals_ci", "customer", "c_custkey", lambda c: c.c_mktsegment.equals("building", ignore_case=True), "upper(c_mktsegment) = upper('building')")
_filter("str_startswith", "part", "p_partkey, p_name", lambda p: p.p_name.starts_with("red"), "starts_with(p_name, 'red')")
_filter("str_endswith", "part", "p_partkey, p_name", lambda p: p.p_name.ends_with("t"), "suffix(p_name, 't')")
_filter("str_contains", "documents", "doc_id", lambda d: d.text.contains("%"), "contains(text, '%')")
_filter("str_startswith_ci", "part", "p_partkey, p_name", lambda p: p.p_name.starts_with("RED", ignore_case=True), "starts_with(upper(p_name), 'RED')")
_filter("str_endswith_ci", "part", "p_partkey, p_name", lambda p: p.p_name.ends_with("ET", ignore_case=True), "suffix(upper(p_name), 'ET')")
_filter("str_contains_ci", "part", "p_partkey, p_name", lambda p: p.p_name.contains("LU", ignore_case=True), "contains(upper(p_name), 'LU')")
_filter("str_like_column", "part", "p_partkey, p_name", lambda p: p.p_name.contains(p.p_name.substring(2, 3)), "p_name LIKE '%' || substring(p_name, 3, 3) || '%'")
_filter("like_raw", "customer", "c_custkey, c_name", lambda c: c.c_name.like("Customer#0000000__"), "c_name LIKE 'Customer#0000000__'")
_filter("ilike_raw", "customer", "c_custkey, c_name", lambda c: c.c_name.ilike("customer#0000000_1"), "c_name ILIKE 'customer#0000000_1'")
_filter("regex", "part", "p_partkey, p_name", lambda p: p.p_name.matches("^[a-f]"), "regexp_matches(p_name, '^[a-f]')")
_filter("regex_ci", "part", "p_partkey, p_name", lambda p: p.p_name.matches("^[A-F]", ignore_case=True), "regexp_matches(p_name, '^[a-f]')")

# dates and numbers

for _part in ("year", "month", "day", "hour", "minute", "second"):
    _term(f"date_{_part}", "events", "event_id", lambda e, p=_part: getattr(e.ts, p), f"{_part}(ts)::INT", lambda e, p=_part: getattr(e.ts, p) > 5, f"{_part}(ts) > 5")
_term("date_date", "events", "event_id", lambda e: e.ts.date, "ts::DATE", lambda e: e.value > 50, "value > 50")
_term("math_abs", "customer", "c_custkey", lambda c: abs(c.c_acctbal), "abs(c_acctbal)")
_term("math_floor", "customer", "c_custkey", lambda c: c.c_acctbal.floor(), "floor(c_acctbal)::BIGINT")
_term("math_ceil", "customer", "c_custkey", lambda c: c.c_acctbal.ceiling(), "ceil(c_acctbal)::BIGINT")
_term("math_round", "customer", "c_custkey", lambda c: c.c_acctbal.round(), "round(c_acctbal)")
_term("math_round2", "customer", "c_custkey", lambda c: Term(c.c_acctbal.round(1).column.cast("double"), "number"), "round(c_acctbal::DECIMAL(38,7), 1)::DOUBLE")

# membership

_filter("in_small", "orders", "o_orderkey, o_orderpriority", lambda o: o.o_orderpriority.in_(["1-URGENT", "2-HIGH"]), "o_orderpriority IN ('1-URGENT', '2-HIGH')")
_filter("in_single", "orders", "o_orderkey, o_orderstatus", lambda o: o.o_orderstatus.in_(["O"]), "o_orderstatus = 'O'")
_filter("in_large", "orders", "o_orderkey", lambda o: o.o_orderkey.in_(range(0, 600, 3)), "o_orderkey % 3 = 0 AND o_orderkey BETWEEN 0 AND 599")
_filter("in_empty", "orders", "o_orderkey", lambda o: o.o_orderkey.in_([]), "false")
_filter("not_in_empty", "open_orders", "o_orderkey, status", lambda o: ~o.status.in_([None]), "true")
_filter("in_nulls", "open_orders", "o_orderkey, status", lambda o: o.status.in_([None, "F", "O"]), "status IN ('F', 'O')")
_filter("not_in_list", "open_orders", "o_orderkey, status", lambda o: ~o.status.in_(["F", "X"]), "status NOT IN ('F', 'X')")
_add("in_array_param", lambda s, d: params.query(s, "SELECT o_orderkey FROM {o} WHERE array_contains($0, o_orderstatus)", [["F", "P"]], {"o": table(s, d, "orders")}), "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")


def _subquery(name: str, predicate: Callable[[Entity, SparkSession, str], Term], sql: str) -> None:
    _add(name, lambda s, d: adapter(s, d, "orders").fill(lambda o: predicate(o, s, d)).select("o_orderkey"), f"SELECT o_orderkey FROM orders WHERE {sql}")


_subquery(
    "in_subquery",
    lambda o, s, d: o.o_custkey.in_query(MAPS["customer"], table(s, d, "customer"), lambda c: c.c_mktsegment == "BUILDING", select=lambda c: c.c_custkey),
    "o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
_CUSTOMER = EntityMap("customer", (Field("o_custkey", "bigint", "c_custkey"), Field("segment", "string", "c_mktsegment")))
_subquery(
    "in_subquery_inferred",
    lambda o, s, d: o.o_custkey.in_query(_CUSTOMER, table(s, d, "customer"), lambda c: c.segment == "MACHINERY"),
    "o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')",
)
_subquery(
    "not_in_subquery",
    lambda o, s, d: ~o.o_custkey.in_query(MAPS["customer"], table(s, d, "customer"), lambda c: c.c_acctbal > 0, select=lambda c: c.c_custkey),
    "o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
_subquery("not_in_subquery_null", lambda o, s, d: ~o.o_orderstatus.in_(table(s, d, "open_orders").filter("status is null or status = 'O'").select("status")), "o_orderstatus NOT IN (SELECT nullif(o_orderstatus, 'P') FROM orders WHERE o_orderstatus IN ('P', 'O'))")
_subquery(
    "in_subquery_or",
    lambda o, s, d: (o.o_totalprice > 450000) | o.o_custkey.in_query(MAPS["customer"], table(s, d, "customer"), lambda c: c.c_nationkey == 3, select=lambda c: c.c_custkey),
    "o_totalprice > 450000 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)",
)

# filter objects


def _sf(name: str, table: str, columns: str, test: filters.Filter, sql: str) -> None:
    _add(f"sf_{name}", lambda s, d: adapter(s, d, table).fill(test).select(*columns.split(", ")), f"SELECT {columns} FROM {_from(table)} t WHERE {sql}")


for _name, _sign in (("eq", "="), ("neq", "<>"), ("gt", ">"), ("gte", ">="), ("ngt", "<="), ("lt", "<"), ("lte", "<="), ("nlt", ">=")):
    _sf(_name, "part", "p_partkey, p_size", getattr(filters, _name)("p_size", 20), f"p_size {_sign} 20")
_sf("null", "open_orders", "o_orderkey", filters.is_null("status"), "status IS NULL")
_sf("notnull", "open_orders", "o_orderkey", filters.not_null("status"), "status IS NOT NULL")
_sf("like", "part", "p_partkey", filters.like("p_name", "r%t"), "p_name LIKE 'r%t'")
_sf("notlike", "part", "p_partkey", filters.not_like("p_name", "r%t"), "p_name NOT LIKE 'r%t'")
_sf("ilike", "part", "p_partkey", filters.ilike("p_name", "RED%"), "p_name ILIKE 'RED%'")
_sf("notilike", "part", "p_partkey", filters.not_ilike("p_name", "RED%"), "p_name NOT ILIKE 'RED%'")
_sf("match", "part", "p_partkey", filters.match("p_name", "[xyz]"), "regexp_matches(p_name, '[xyz]')")
_sf("notmatch", "part", "p_partkey", filters.not_match("p_name", "[xyz]"), "NOT regexp_matches(p_name, '[xyz]')")
_sf("imatch", "part", "p_partkey", filters.imatch("p_name", "^RED"), "regexp_matches(p_name, '^red')")
_sf("notimatch", "part", "p_partkey", filters.not_imatch("p_name", "^RED"), "NOT regexp_matches(p_name, '^red')")
_sf("eq_null", "open_orders", "o_orderkey", filters.eq("status", None), "status = NULL")
_add(
    "sf_combined",
    lambda s, d: adapter(s, d, "orders").fill(filters.eq("o_orderstatus", "O"), filters.gt("o_totalprice", 300000), filters.not_like("o_orderpriority", "1%")).select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 300000 AND o_orderpriority NOT LIKE '1%'",
)
_add(
    "string_filter_text",
    lambda s, d: adapter(s, d, "orders").fill("o_totalprice between 100000 and 110000").select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 110000",
)
_add(
    "string_filter_params",
    lambda s, d: adapter(s, d, "orders").fill("(o_totalprice > $0 or o_totalprice < $1 and o_totalprice <> $0) and o_orderstatus <> $10", args=[400000.0, 9000.0, *[None] * 8, "P"]).select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE (o_totalprice > 400000 OR o_totalprice < 9000) AND o_orderstatus <> 'P'",
)

# counts, order, pages

_add("count_lambda", lambda s, d: adapter(s, d, "orders").count_of(lambda o: o.o_orderstatus == "F"), "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F'")
_add("count_filters", lambda s, d: adapter(s, d, "orders").count_of(filters.lt("o_totalprice", 50000)), "SELECT count(*) AS count FROM orders WHERE o_totalprice < 50000")
_add("count_text", lambda s, d: adapter(s, d, "orders").count_of(""), "SELECT count(*) AS count FROM orders")
_add("exists_true", lambda s, d: adapter(s, d, "orders").exists_of(lambda o: o.o_totalprice > 1000), 'SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1000) AS "exists"')
_add("exists_false", lambda s, d: adapter(s, d, "orders").exists_of(lambda o: o.o_totalprice < 0), 'SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS "exists"')
_add("order_by_multi", lambda s, d: sorted_by(table(s, d, "nation"), "n_regionkey", "-n_name"), "SELECT * FROM nation ORDER BY n_regionkey, n_name DESC")
_add("page_offset_limit", lambda s, d: adapter(s, d, "customer", "c_acctbal desc, c_custkey").fill_range(20, 15), "SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15 OFFSET 20")
_add("get_one", lambda s, d: adapter(s, d, "orders", "o_totalprice desc, o_orderkey").first_of(lambda o: o.o_orderstatus == "P"), "SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")

# raw SQL and shapers

_add(
    "scalar_raw",
    lambda s, d: params.query(s, "SELECT max(o_orderkey) AS m FROM {o} WHERE o_orderstatus = $0", ["F"], {"o": table(s, d, "orders")}),
    "SELECT max(o_orderkey) AS m FROM orders WHERE o_orderstatus = 'F'",
)
_add(
    "raw_group_by",
    lambda s, d: params.query(
        s, "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM {x} GROUP BY l_returnflag, l_linestatus", (), {"x": table(s, d, "lineitem")}
    ),
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
_add("list_array", lambda s, d: lists.first_column(table(s, d, "nation"), "bigint"), "SELECT n_nationkey::BIGINT AS value FROM nation")
_add("list_strings", lambda s, d: lists.strings(table(s, d, "open_orders").select("status"), True), "SELECT '' AS value UNION ALL SELECT o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
_add("list_delimited", lambda s, d: lists.delimited(table(s, d, "nation").select("n_name"), "; ", "'"), "SELECT string_agg('''' || n_name || '''', '; ' ORDER BY n_name) AS value FROM nation")
_add("list_pairs", lambda s, d: lists.pairs(table(s, d, "nation")), "SELECT n_nationkey AS id, n_name AS label FROM nation")
_add("list_dictionary", lambda s, d: lists.dictionary(table(s, d, "region")).select(F.explode("value").alias("key", "value")), "SELECT r_regionkey AS key, r_name AS value FROM region")
_add(
    "list_xml",
    lambda s, d: lists.xml(table(s, d, "region"), "region").select(F.regexp_replace("value", r"\s*\n\s*", "").alias("value")),
    "SELECT '<region><r_regionkey>' || r_regionkey || '</r_regionkey><r_name>' || r_name || '</r_name></region>' AS value FROM region",
)
_add("list_entries", lambda s, d: lists.entries(table(s, d, "orders").select("o_orderkey", "o_orderstatus")), "SELECT o_orderkey AS key, o_orderstatus AS value FROM orders")

# relations


def _rel_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = adapter(spark, sf_dir, "orders").fill(lambda o: o.o_totalprice > 200000)
    rows = relations.children(table(spark, sf_dir, "customer"), ["c_custkey"], orders, ["o_custkey"], "orders")
    keys = F.transform("orders", lambda o: o["o_orderkey"])
    return rows.select("c_custkey", F.size("orders").cast("bigint").alias("n"), F.array_min(keys).alias("first"), F.array_max(keys).alias("last"))


_add(
    "rel_collection",
    _rel_collection,
    'SELECT c_custkey, count(o_orderkey) AS n, min(o_orderkey) AS "first", max(o_orderkey) AS "last" FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 GROUP BY c_custkey',
)
_add(
    "rel_reference",
    lambda s, d: relations.reference(table(s, d, "customer"), ["c_nationkey"], table(s, d, "nation").filter("n_regionkey < 3"), ["n_nationkey"], "nation", "n_nationkey").select("c_custkey", "nation.n_name"),
    "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3",
)
_add(
    "rel_attached",
    lambda s, d: relations.attached(table(s, d, "customer").filter("c_mktsegment = 'BUILDING'"), ["c_custkey"], table(s, d, "orders"), ["o_custkey"]).select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
_add(
    "view_read_model",
    lambda s, d: table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).filter("o_totalprice > 300000").select("o_orderkey", "c_name", "n_name"),
    "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000",
)

# conversions


def _conv(name: str, columns: str, make: Callable[[], dict], sql: str) -> None:
    _add(name, lambda s, d: table(s, d, "events").select("event_id", *[c.alias(n) for n, c in make().items()]), f"SELECT event_id, {sql} FROM events")


_conv("conv_date", "d", lambda: {"d": convert.to_date(F.col("ts")), "midnight": convert.date_to_timestamp(F.col("ts").cast("date"))}, "ts::DATE AS d, ts::DATE::TIMESTAMP AS midnight")
_conv("conv_time", "t", lambda: {"t": convert.to_time(F.col("ts"))}, "strftime(ts, '%H:%M:%S.%f') AS t")
_conv("conv_text", "t", lambda: {"t": convert.to_text(F.col("ts"), "timestamp_ntz")}, "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS t")
_conv("conv_time_of_day", "s", lambda: {"s": (F.extract(F.lit("HOUR"), convert.time_of_day(F.col("ts"))) * 60 + F.extract(F.lit("MINUTE"), convert.time_of_day(F.col("ts")))).cast("bigint")}, "hour(ts) * 60 + minute(ts) AS s")
_conv("conv_whole", "w", lambda: {"w": convert.to_whole(F.col("value"), "bigint")}, "round_even(value, 0)::BIGINT AS w")
_conv("conv_enum", "e", lambda: {"e": convert.to_enum((F.col("event_id") % 3).cast("string"), {"Zero": 0, "One": 1, "Two": 2})}, "['Zero', 'One', 'Two'][(event_id % 3 + 1)] AS e")
