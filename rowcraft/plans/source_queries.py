"""Registered queries of text files, named sources, readers and generated maps.

Text queries write a whole table as text to the shared folder and read it back
by the rules that are tested; their SQL says what must come back.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowcraft.functions.predicate import Term
from rowcraft.functions.scratch import scratch_path
from rowcraft.operators import filters, lists, params
from rowcraft.operators.adapter import Adapter, read_rows, read_values
from rowcraft.operators.entity import EntityMap
from rowcraft.plans.catalogue import MAPS, adapter, table
from rowcraft.sources import registry, scaffold, textio
from rowcraft.sources.textio import TextField, TextRecord

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, run: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = run, sql


# text files


def _written(lines: DataFrame, label: str) -> str:
    path = scratch_path(lines.sparkSession, label)
    textio.write_lines(lines, path)
    return path


def _lines(spark: SparkSession, sf_dir: str, name: str, text: str) -> str:
    """A table as lines made by a SQL expression."""
    return _written(table(spark, sf_dir, name).select(F.expr(text).alias("value")), "lines")


PART = TextRecord((TextField("p_partkey", "bigint"), TextField("p_name"), TextField("p_brand"), TextField("p_type"), TextField("p_size", "int"), TextField("p_retailprice", "double")))
FIXED_PART = TextRecord((TextField("p_partkey", "bigint", offset=0), TextField("p_name", offset=12, length=24), TextField("p_size", "int", length=6), TextField("p_retailprice", "double", offset=50, length=14)))


def _quoted_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with delimiters and qualifiers in them."""
    return table(spark, sf_dir, "part").withColumn("p_name", F.concat(F.col("p_name"), F.lit(', "'), F.col("p_type"), F.lit('"')))


_add("text_delimited_roundtrip", lambda s, d: textio.read_delimited(s, _written(textio.delimited_lines(_quoted_parts(s, d), PART), "csv"), PART), "SELECT p_partkey, p_name || ', \"' || p_type || '\"' AS p_name, p_brand, p_type, p_size, p_retailprice FROM part")
_add("text_strict_roundtrip", lambda s, d: textio.read_strict(s, _written(textio.delimited_lines(table(s, d, "part"), PART, qualify_all=True), "csv"), PART), "SELECT * FROM part")
_add("text_fixed_roundtrip", lambda s, d: textio.read_fixed(s, _written(textio.fixed_lines(table(s, d, "part"), FIXED_PART), "fixed"), FIXED_PART), "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
_add(
    "text_strict_quotes",
    lambda s, d: textio.read_strict(s, _lines(s, d, "customer", """concat(c_custkey, ',junk"', c_mktsegment, ', ""x"" y",""')"""), TextRecord((TextField("k", "bigint"), TextField("s"), TextField("e")))),
    "SELECT c_custkey AS k, c_mktsegment || ', \"x\" y' AS s, NULL::VARCHAR AS e FROM customer",
)
_add(
    "text_line_filter",
    lambda s, d: textio.read_strict(s, _lines(s, d, "orders", "concat(if(o_orderstatus = 'P', '#', ''), o_orderkey, ';', o_orderstatus)"), TextRecord((TextField("k", "bigint"), TextField("s")), delimiter=";"), lambda _, line: not line.startswith("#")),
    "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'P'",
)
_add(
    "text_stops_at_blank",
    lambda s, d: textio.read_strict(s, _written(table(s, d, "nation").coalesce(1).orderBy("n_nationkey").select(F.expr("if(n_nationkey = 10, '', concat(n_nationkey, ',', n_name))").alias("value")), "lines"), TextRecord((TextField("k", "int"), TextField("n"))), stop_at_blank=True),
    "SELECT n_nationkey AS k, n_name AS n FROM nation WHERE n_nationkey < 10",
)
_add(
    "text_numbers",
    lambda s, d: textio.read_delimited(s, _lines(s, d, "customer", "concat(c_custkey, '|$', format_number(abs(c_acctbal), 2), if(c_acctbal < 0, '-', ''), '|', if(c_acctbal < 0, '(7)', '+7'))"), TextRecord((TextField("k", "bigint"), TextField("a", "decimal(12,2)"), TextField("b", "int")), delimiter="|")).withColumn("a", F.col("a").cast("double")),
    "SELECT c_custkey AS k, round(c_acctbal, 2) AS a, CASE WHEN c_acctbal < 0 THEN -7 ELSE 7 END AS b FROM customer",
)
_add(
    "text_header_names",
    lambda s, d: textio.read_dynamic(s, _written(s.range(1).select(F.lit("Order Key,ship-status").alias("value")).unionByName(table(s, d, "orders").select(F.concat_ws(",", "o_orderkey", "o_orderstatus").alias("value"))).coalesce(1), "csv"), lower=True),
    "SELECT o_orderkey::VARCHAR AS order_key, o_orderstatus AS ship_status FROM orders",
)
_add(
    "text_positions",
    lambda s, d: textio.read_delimited(s, _lines(s, d, "part", "concat_ws(',', p_brand, p_size, p_partkey, p_type)"), TextRecord((TextField("key", "int", position=2), TextField("type"), TextField("brand", position=0)))),
    "SELECT p_partkey::INT AS key, p_type AS type, p_brand AS brand FROM part",
)
_add(
    "text_values",
    lambda s, d: textio.read_delimited(s, _lines(s, d, "part", "concat(p_partkey, ',  ', p_name, '  ,', if(p_size > 25, cast(p_size as string), ''))"), TextRecord((TextField("k", "bigint"), TextField("n", length=5), TextField("z", "int", default=-1)))),
    "SELECT p_partkey AS k, substring(p_name, 1, 5) AS n, CASE WHEN p_size > 25 THEN p_size ELSE -1 END AS z FROM part",
)
_add(
    "text_booleans",
    lambda s, d: textio.read_delimited(s, _lines(s, d, "orders", "concat(o_orderkey, ',', if(o_orderstatus = 'F', 'Yes', 'no'), ',', o_orderstatus)"), TextRecord((TextField("k", "bigint"), TextField("a", "boolean"), TextField("b", "boolean", true_values="O|P")))),
    "SELECT o_orderkey AS k, o_orderstatus = 'F' AS a, o_orderstatus IN ('O', 'P') AS b FROM orders",
)
_add(
    "text_short_lines_skipped",
    lambda s, d: textio.read_fixed(s, _lines(s, d, "part", "concat(lpad(p_partkey, 8, '0'), if(p_size > 25, lpad(p_size, 3, '0'), ''))"), TextRecord((TextField("k", "bigint", offset=0), TextField("z", "int", offset=8, length=3)), short_lines="skip")),
    "SELECT p_partkey AS k, p_size AS z FROM part WHERE p_size > 25",
)
_add(
    "text_short_lines_accepted",
    lambda s, d: textio.read_fixed(s, _lines(s, d, "part", "concat(lpad(p_partkey, 8, '0'), if(p_size > 25, lpad(p_size, 3, '0'), ''))"), TextRecord((TextField("k", "bigint", offset=0), TextField("z", "int", offset=8, length=3)))),
    "SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN p_size END AS z FROM part",
)
_add("text_fill_predicate", lambda s, d: textio.read_delimited(s, _written(textio.delimited_lines(table(s, d, "part"), PART), "csv"), PART).filter("p_size > 40").select("p_partkey", "p_size"), "SELECT p_partkey, p_size FROM part WHERE p_size > 40")


def _bad_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading a value of the wrong kind says."""
    record = TextRecord((TextField("Size", "int"),))
    try:
        textio.read_delimited(spark, _lines(spark, sf_dir, "part", "if(p_partkey = 5, 'large', cast(p_size as string))"), record).agg(F.sum("Size")).collect()
        said = "nothing"
    except Exception as error:
        said = "Size can't be read as int: large" if "Size can't be read as int: large" in str(error) else str(error)
    return spark.createDataFrame([(said,)], "said string")


_add("text_bad_value", _bad_values, "SELECT 'Size can''t be read as int: large' AS said")
_FORMATS = TextRecord((TextField("o_orderkey", "bigint"), TextField("o_orderstatus"), TextField("open", "boolean", format="Yes|No"), TextField("o_orderdate", "timestamp_ntz", format="dd.MM.yyyy"), TextField("n", "bigint", position=5)), delimiter=";")
_add(
    "text_output_formats",
    lambda s, d: textio.delimited_lines(table(s, d, "orders").withColumns({"open": F.col("o_orderstatus") == "O", "n": F.lit(None).cast("bigint")}), _FORMATS),
    "SELECT o_orderkey || ';\"' || o_orderstatus || '\";' || CASE WHEN o_orderstatus = 'O' THEN 'Yes' ELSE 'No' END || ';' || strftime(o_orderdate, '%d.%m.%Y') || ';;' AS value FROM orders",
)
_add(
    "text_fixed_lines",
    lambda s, d: textio.fixed_lines(table(s, d, "part"), TextRecord((TextField("p_name", offset=0, length=6), TextField("p_brand", offset=8, length=10), TextField("p_type")))),
    "SELECT rpad(substring(p_name, 1, 6), 6, ' ') || '  ' || rpad(substring(p_brand, 1, 10), 10, ' ') || p_type AS value FROM part",
)

# scans of other kinds

_add("scan_command", lambda s, d: adapter(s, d, "orders").fill_with(params.query(s, "SELECT * FROM {o} WHERE o_totalprice > $0", [300000.0], {"o": table(s, d, "orders")})), "SELECT * FROM orders WHERE o_totalprice > 300000")
_add("scan_reader", lambda s, d: s.createDataFrame(list(adapter(s, d, "nation", "n_nationkey").open_reader(lambda n: n.n_regionkey != 1, make=lambda r: (r.n_nationkey, r.n_name.lower()))), "k int, n string"), "SELECT n_nationkey AS k, lower(n_name) AS n FROM nation WHERE n_regionkey <> 1")
_add("scan_rows", lambda s, d: adapter(s, d, "nation").fill_rows(read_rows(table(s, d, "nation"))), "SELECT * FROM nation")
_add("scan_value_arrays", lambda s, d: s.createDataFrame([(len(v), v[0]) for v in read_values(table(s, d, "region"))], "width int, k int"), "SELECT 2 AS width, r_regionkey AS k FROM region")
_add("scan_list", lambda s, d: s.createDataFrame(list(adapter(s, d, "nation", "n_name").get_array(filters.gte("n_regionkey", 2))), "n_nationkey int, n_name string, n_regionkey int"), "SELECT * FROM nation WHERE n_regionkey >= 2")
_add("scan_other_table", lambda s, d: Adapter(s, MAPS["orders"], "nowhere").on_table(table(s, d, "orders").filter("o_orderstatus = 'P'")).fill_all(), "SELECT * FROM orders WHERE o_orderstatus = 'P'")
_add("scan_no_lock", lambda s, d: Adapter(s, MAPS["region"], table(s, d, "region"), no_lock=True).fill_all(), "SELECT * FROM region")


def _data_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "nation").createOrReplaceTempView("rowcraft_nation")
    found = lists.data_set(spark, ["SELECT n_name AS name FROM rowcraft_nation WHERE n_regionkey = $0", "SELECT upper(n_name) AS name FROM rowcraft_nation WHERE n_regionkey <> $0"], [1])
    return found["Table1"].withColumn("t", F.lit("Table1")).unionByName(found["Table2"].withColumn("t", F.lit("Table2")))


_add("scan_data_set", _data_set, "SELECT CASE WHEN n_regionkey = 1 THEN n_name ELSE upper(n_name) END AS name, CASE WHEN n_regionkey = 1 THEN 'Table1' ELSE 'Table2' END AS t FROM nation")


def _named_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source by name; part of its path comes from the environment."""
    os.environ["ROWCRAFT_TABLES"] = f"at:{sf_dir}"
    known = registry.Registry()
    known.register("Parts", registry.Source("parquet", "%ROWCRAFT_TABLES[3]%/part.parquet"))
    return known.open(spark, "parts").select("p_partkey", "p_brand")


_add("scan_named_source", _named_source, "SELECT p_partkey, p_brand FROM part")


def _script(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("rowcraft_orders")
    return registry.run_script(spark, "CREATE OR REPLACE TEMP VIEW rowcraft_large AS SELECT * FROM rowcraft_orders WHERE o_totalprice > 200000\nGO\n\ngo\nSELECT o_orderstatus, count(*) AS n FROM rowcraft_large GROUP BY o_orderstatus\n")[-1]


_add("script_statements", _script, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_orderstatus")
_add("order_by_expression", lambda s, d: adapter(s, d, "open_orders", "coalesce(status, 'A') desc, o_orderkey").fill_range(0, 50), "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders ORDER BY coalesce(nullif(o_orderstatus, 'P'), 'A') DESC, o_orderkey LIMIT 50")
_add("list_filtered", lambda s, d: lists.pairs(lists.filtered(params.query(s, "SELECT o_orderkey, o_orderstatus FROM {o}", (), {"o": table(s, d, "orders")}), filters.neq("o_orderstatus", "F"))), "SELECT o_orderkey AS id, o_orderstatus AS label FROM orders WHERE o_orderstatus <> 'F'")
_add("list_xml_document", lambda s, d: s.createDataFrame([("".join(lists.xml_document(table(s, d, "region").orderBy("r_regionkey"), "all", "region").split()),)], "value string"), "SELECT '<all>' || string_agg('<region><r_regionkey>' || r_regionkey || '</r_regionkey><r_name>' || replace(r_name, ' ', '') || '</r_name></region>', '' ORDER BY r_regionkey) || '</all>' AS value FROM region")
_add("in_split_lists", lambda s, d: adapter(s, d, "orders").fill(lambda o: _any_of(o.o_orderkey, lists.split(range(0, 900, 3), 100))).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey < 900")
_add("in_list_legacy", lambda s, d: adapter(s, d, "orders").fill(lambda o: o.o_orderkey.in_list([1, 2, None, 3])).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderkey IN (1, 2, 3)")
_add("nullable_value", lambda s, d: adapter(s, d, "labelled").fill(lambda x: x.quality.value == 1).select("doc_id"), "SELECT doc_id FROM labels WHERE quality = 1")
_add("arith_mod_reversed", lambda s, d: adapter(s, d, "part").fill(lambda p: 100 % (p.p_size + 1) == 1).select("p_partkey"), "SELECT p_partkey FROM part WHERE 100 % (p_size + 1) = 1")


def _any_of(term: Term, parts) -> Term:
    found = None
    for values in parts:
        test = term.in_(values)
        found = test if found is None else found | test
    return found


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is an error: pages without an order, a correlated subquery, truth of a predicate."""
    orders, customers = adapter(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    tries = {
        "page without order": lambda: orders.fill_range(0, 5),
        "correlated subquery": lambda: orders.fill(lambda o: o.o_custkey.in_query(MAPS["customer"], customers, lambda c: c.c_acctbal > o.o_totalprice, select=lambda c: c.c_custkey)),
        "truth of a predicate": lambda: orders.fill(lambda o: o.o_custkey == 1 and o.o_orderkey == 2),
        "unmapped property": lambda: orders.fill(lambda o: o.nothing == 1),
        "null filter": lambda: orders.count_of(None),
    }
    out = []
    for name, run in tries.items():
        try:
            run()
            out.append((name, "accepted"))
        except Exception as error:
            out.append((name, type(error).__name__))
    return spark.createDataFrame(out, "what string, error string")


_add("refused", _refused, "SELECT * FROM (VALUES ('page without order', 'ValueError'), ('correlated subquery', 'UnsupportedExpression'), ('truth of a predicate', 'UnsupportedExpression'), ('unmapped property', 'UnsupportedExpression'), ('null filter', 'ValueError')) t(what, error)")

# generated maps

DECLARED = {
    "customer": scaffold.Declared(key=("c_custkey",), identity="c_custkey", foreign=(scaffold.ForeignKey(("c_nationkey",), "nation", ("n_nationkey",)),)),
    "nation": scaffold.Declared(key=("n_nationkey",), foreign=(scaffold.ForeignKey(("n_regionkey",), "region", ()),)),
    "region": scaffold.Declared(key=("r_regionkey",), unique=(("r_name",),)),
    "orders": scaffold.Declared(key=("o_orderkey",), foreign=(scaffold.ForeignKey(("o_custkey",), "customer", ()), scaffold.ForeignKey(("o_clerk",), "clerk", ()))),
}
_TABLES = ("customer", "lineitem", "nation", "orders", "region")


def _found(spark: SparkSession, sf_dir: str) -> list[scaffold.Table]:
    return scaffold.from_directory(spark, sf_dir, _TABLES, DECLARED)


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(t.name, f.name, f.column, f.type, f.key, f.identity, m.read_only) for t in _found(spark, sf_dir) for m in [scaffold.entity_map(t)] for f in m.fields]
    return spark.createDataFrame(rows, "t string, property string, col string, type string, is_key boolean, made boolean, read_only boolean")


_KINDS = "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE 'string' END"
_PASCAL = "upper(column_name[1]) || column_name[2:position('_' IN column_name) - 1] || upper(column_name[position('_' IN column_name) + 1]) || column_name[position('_' IN column_name) + 2:]"
_add(
    "scaffold_columns",
    _columns,
    " UNION ALL ".join(
        f"SELECT '{t}' AS t, {_PASCAL} AS property, column_name AS col, {_KINDS} AS type, column_name = '{(DECLARED[t].key[0] if t in DECLARED else '')}' AS is_key, "
        f"column_name = 'c_custkey' AS made, {str(t not in DECLARED).lower()} AS read_only FROM (DESCRIBE {t})"
        for t in _TABLES
    ),
)


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, warnings = scaffold.relations(_found(spark, sf_dir))
    rows = [(r.owner, r.name, ",".join(r.columns), r.other, ",".join(r.other_columns), r.many) for r in found] + [("warning", w, None, None, None, None) for w in warnings]
    return spark.createDataFrame(rows, "owner string, name string, cols string, other string, other_cols string, many boolean")


_add(
    "scaffold_relations",
    _relations,
    "SELECT * FROM (VALUES ('customer', 'Nation', 'c_nationkey', 'nation', 'n_nationkey', false), ('nation', 'Customers', 'n_nationkey', 'customer', 'c_nationkey', true), "
    "('nation', 'Region', 'n_regionkey', 'region', 'r_regionkey', false), ('region', 'Nations', 'r_regionkey', 'nation', 'n_regionkey', true), "
    "('orders', 'Customer', 'o_custkey', 'customer', 'c_custkey', false), ('customer', 'Orders', 'c_custkey', 'orders', 'o_custkey', true), "
    "('warning', 'orders: clerk is not there', NULL, NULL, NULL, NULL)) t(owner, name, cols, other, other_cols, many)",
)


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every relation that was inferred, joined by it and counted."""
    out = None
    for r in scaffold.relations(_found(spark, sf_dir))[0]:
        one, two = table(spark, sf_dir, r.owner), table(spark, sf_dir, r.other)
        n = one.join(two, [one[a] == two[b] for a, b in zip(r.columns, r.other_columns, strict=True)]).agg(F.count(F.lit(1)).alias("n")).select(F.lit(r.owner).alias("owner"), F.lit(r.other).alias("other"), "n")
        out = n if out is None else out.unionByName(n)
    return out


_add(
    "scaffold_relation_rows",
    _related,
    " UNION ALL ".join(
        f"SELECT '{a}' AS owner, '{b}' AS other, count(*) AS n FROM {one} JOIN {two} ON {on}"
        for one, two, on in (("customer", "nation", "c_nationkey = n_nationkey"), ("nation", "region", "n_regionkey = r_regionkey"), ("orders", "customer", "o_custkey = c_custkey"))
        for a, b in ((one, two), (two, one))
    ),
)
_add(
    "scaffold_types",
    lambda s, d: s.createDataFrame([(n, *scaffold.native_type(n, p, z)) for n, p, z in (("numeric", 9, 0), ("decimal", 18, 0), ("numeric", 12, 3), ("tinyint(1)", None, None), ("Timestamp With Time Zone", None, None), ("text[]", None, None), ("varchar(20)", None, None), ("hstore", None, None))], "native string, type string, warning string"),
    "SELECT * FROM (VALUES ('numeric', 'int', NULL), ('decimal', 'bigint', NULL), ('numeric', 'decimal(12,3)', NULL), ('tinyint(1)', 'boolean', 'tinyint(1) is taken for a Boolean'), ('Timestamp With Time Zone', 'timestamp', NULL), "
    "('text[]', 'array<string>', NULL), ('varchar(20)', 'string', NULL), ('hstore', 'string', 'hstore is not known and read as text')) t(native, type, warning)",
)
_NAMES = {"order_details": "order_detail", "Categories": "Category", "people": "person", "statuses": "status", "species": "species", "humans": "human", "boxes": "box"}
_add(
    "scaffold_names",
    lambda s, d: s.createDataFrame([(m, scaffold.singular(m), scaffold.plural(scaffold.singular(m)), scaffold.pascal(m), scaffold.safe(f"2 {m}")) for m in (*_NAMES, "class")], "name string, one string, many string, pascal string, safe string"),
    f"SELECT name, one, CASE name WHEN 'class' THEN 'classes' ELSE name END AS many, CASE name WHEN 'order_details' THEN 'OrderDetails' ELSE upper(name[1]) || name[2:] END AS pascal, '_2_' || name AS safe FROM (VALUES {', '.join(f'({m!r}, {o!r})' for m, o in (*_NAMES.items(), ('class', 'class')))}) t(name, one)",
)


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and views of the catalog, some ignored by pattern."""
    for name in ("nation", "region"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"rc_{name}")
        table(spark, sf_dir, name).createOrReplaceTempView(f"tmp_{name}")
    found = [t for t in scaffold.from_catalog(spark, ignored=["TMP_*", "rowcraft*"]) if t.name.startswith(("rc_", "tmp_"))]
    return spark.createDataFrame([(t.name, t.view, t.read_only, len(t.schema)) for t in found], "name string, is_view boolean, read_only boolean, width int")


_add("scaffold_catalog", _catalog, "SELECT * FROM (VALUES ('rc_nation', true, true, 3), ('rc_region', true, true, 2)) t(name, is_view, read_only, width)")


def _emitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of the maps that the generated source makes when it is run, read through them."""
    made: dict[str, object] = {}
    exec(scaffold.emit(_found(spark, sf_dir)), made)
    nation = made["NATION"]
    assert isinstance(nation, EntityMap)
    return Adapter(spark, nation, table(spark, sf_dir, "nation")).fill(lambda n: n.NRegionkey == 2)


_add("scaffold_emitted_map", _emitted, 'SELECT n_nationkey AS "NNationkey", n_name AS "NName", n_regionkey AS "NRegionkey" FROM nation WHERE n_regionkey = 2')


def _options(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = scaffold.options(["--out", "c.py"], {"ROWCRAFT_OUT": "b.py", "ROWCRAFT_NAMING": "preserve"}, {"out": "a.py", "naming": "pascal", "tables": "x,y"})
    return spark.createDataFrame([(chosen.out, chosen.naming, chosen.tables)], "out string, naming string, tables string")


_add("scaffold_options", _options, "SELECT 'c.py' AS \"out\", 'preserve' AS naming, 'x,y' AS tables")


def _overwriting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What writing a generated file does to one that is there."""
    import tempfile

    with tempfile.TemporaryDirectory() as own:  # source files are the driver's
        at, text = f"{own}/maps.py", scaffold.emit(_found(spark, sf_dir))
        said = [scaffold.write(at, text, dry_run=True), scaffold.write(at, text), scaffold.write(at, text), scaffold.write(at, text + "#")]
        with open(f"{own}/mine.py", "w") as mine:
            mine.write("mine")
        said += [scaffold.write(f"{own}/mine.py", text), scaffold.write(f"{own}/mine.py", text, force=True)]
    return spark.createDataFrame(list(enumerate(said)), "step bigint, said string")


_add("scaffold_overwriting", _overwriting, "SELECT * FROM (VALUES (0, 'would write'), (1, 'written'), (2, 'unchanged'), (3, 'written'), (4, 'kept'), (5, 'written')) t(step, said)".replace("(0,", "(0::BIGINT,"))
