"""Text files, named sources, conversions, shapers, relations, generated maps, streams."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from rowcraft.functions import convert
from rowcraft.operators import lists, relations
from rowcraft.operators.entity import EntityMap, Field
from rowcraft.operators.store import Store
from rowcraft.sources import registry, scaffold, textio
from rowcraft.sources.textio import TextField, TextRecord
from rowcraft.streaming import feed
from tests.zoo import tables

PEOPLE = TextRecord((TextField("Name"), TextField("Age", "int"), TextField("Notes")))


@pytest.fixture
def file(tmp_path):
    def write(text):
        path = tmp_path / "f.txt"
        path.write_text(text)
        return str(path)

    return write


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_delimited(spark, file, tmp_path):
    path = file('Ann,41,"likes cats, dogs"\n"B ""the"" Bob",,x\n\nCy,"1,234",\n')
    assert rows(textio.read_delimited(spark, path, PEOPLE)) == [("Ann", 41, "likes cats, dogs"), ('B "the" Bob', None, "x"), ("Cy", 1234, None)]
    df = textio.read_delimited(spark, path, PEOPLE)
    textio.write_lines(textio.delimited_lines(df.coalesce(1), PEOPLE), str(tmp_path / "out"))
    assert rows(textio.read_delimited(spark, str(tmp_path / "out"), PEOPLE)) == rows(df)
    with pytest.raises(Exception, match="Age can't be read as int: old"):
        textio.read_delimited(spark, file("Ann,old,x\n"), PEOPLE).collect()


def test_strict_quotes(spark, file):
    assert textio.split_line('a,"b ""c"" d",junk"e",""', ",", '"') == ["a", 'b "c" d', "e", ""]
    path = file('h1,h2,h3\nAnn,1,"x"\n# skip,2,y\n\nlost,3,z\n')
    record = TextRecord(PEOPLE.fields, header=True)
    assert rows(textio.read_strict(spark, path, record, lambda k, line: not line.startswith("#"), stop_at_blank=True)) == [("Ann", 1, "x")]
    assert rows(textio.read_strict(spark, path, PEOPLE, lambda k, line: k > 2)) == [("lost", 3, "z")]


def test_values(spark, file):
    record = TextRecord((TextField("a", "decimal(10,2)"), TextField("b", "boolean"), TextField("c", "boolean", true_values="on|ok"), TextField("d", "date", format="dd.MM.yyyy"), TextField("e", length=3), TextField("f", "int", default=7)), delimiter=";")
    got = rows(textio.read_delimited(spark, file("$1,200.50-;Yes;ok;05.02.2024; abcdef ;\n(3.00);no;x;;;9\n"), record))
    assert [str(got[0][0]), *got[0][1:]] == ["-1200.50", True, True, date(2024, 2, 5), "abc", 7]
    assert [str(got[1][0]), *got[1][1:]] == ["-3.00", False, False, None, None, 9]


def test_dynamic_header(spark, file):
    df = textio.read_dynamic(spark, file("First Name,e-mail\nAnn,a@b\n"), lower=True)
    assert df.columns == ["first_name", "e_mail"] and rows(df) == [("Ann", "a@b")]


def test_fixed_width(spark, file, tmp_path):
    record = TextRecord((TextField("id", "int", offset=0), TextField("name", offset=4, length=6), TextField("ok", "boolean", length=1, format="Y|N")))
    path = file("0001Ann   Y\n0002BobbieN\n03\n")
    assert rows(textio.read_fixed(spark, path, record))[:2] == [(1, "Ann", True), (2, "Bobbie", False)]
    skipping = TextRecord(record.fields, short_lines="skip")
    df = textio.read_fixed(spark, path, skipping)
    assert df.count() == 2
    with pytest.raises(Exception, match="shorter than"):
        textio.read_fixed(spark, path, TextRecord(record.fields, short_lines="raise")).collect()
    textio.write_lines(textio.fixed_lines(df.coalesce(1), record), str(tmp_path / "out"))
    assert rows(textio.read_fixed(spark, str(tmp_path / "out"), record)) == rows(df)
    with pytest.raises(ValueError):
        TextRecord((TextField("a", position=1), TextField("b", position=1))).positions()


def test_registry(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("ROWCRAFT_T", f"xx{tmp_path}")
    assert registry.substitute("%ROWCRAFT_T[2]%/t") == f"{tmp_path}/t" and registry.substitute("%A[1,2]% %B%", {"A": "wxyz"}) == "xy %B%"
    spark.range(3).write.parquet(f"{tmp_path}/t")
    known = registry.Registry()
    known.register("Main", registry.Source("parquet", "%ROWCRAFT_T[2]%/t"))
    assert known.open(spark, "main").count() == 3

    @known.procedure("first n")
    def first(session, n):
        return session.range(n)

    assert known.call(spark, "First N", 2).count() == 2
    with pytest.raises(LookupError):
        known.open(spark, "other")
    assert registry.jdbc("jdbc:x", "t", "id", (0, 100)).options["numPartitions"] == "8"
    out = registry.run_script(spark, "CREATE OR REPLACE TEMP VIEW gone AS SELECT 1 AS a\nGO\n\nSELECT * FROM gone\ngo\n")
    assert len(out) == 2 and out[1].first().a == 1


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_conversions(spark):
    lit = F.lit
    assert one(spark, convert.to_guid(lit(" {ABCDEF01-1111-2222-3333-444444444444} "))) == "abcdef01-1111-2222-3333-444444444444"
    assert one(spark, convert.text_to_interval(lit("-1.02:03:04.5"))) == -timedelta(days=1, hours=2, minutes=3, seconds=4.5)
    assert one(spark, convert.time_to_interval(lit("10:20"))) == timedelta(hours=10, minutes=20)
    assert one(spark, convert.time_of_day(F.expr("timestamp_ntz'2024-01-02 03:04:05'"))) == timedelta(hours=3, minutes=4, seconds=5)
    assert one(spark, convert.time_to_timestamp(lit("03:04:05"))).year == 1
    assert one(spark, convert.to_time(F.expr("timestamp_ntz'2024-01-02 03:04:05'"))) == "03:04:05.000000"
    assert one(spark, convert.to_text(F.expr("date'2024-01-02'"), "date")) == "2024-01-02"
    assert [one(spark, convert.to_whole(lit(x))) for x in (5.5, 6.5, -0.5)] == [6, 6, 0]
    kinds = {"Forest": 0, "Desert": 2}
    assert one(spark, convert.to_enum(lit("desert"), kinds)) == "Desert" and one(spark, convert.to_enum(lit(0), kinds)) == "Forest"
    assert one(spark, convert.to_enum(lit(None).cast("string"), kinds)) is None
    for wrong in (convert.to_enum(lit("9"), kinds, "Kind"), convert.to_guid(lit("x"), "Kind"), convert.to_type(lit("abc"), "int", "Kind")):
        with pytest.raises(Exception, match="Kind can't be read"):
            one(spark, wrong)


def test_shapers(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, ""), (4, "a")], "id int, s string")
    assert lists.get_array(df, "string") == ["1", "2", "3", "4"]
    assert lists.get_string_array(df.select("s")) == ["b", "", "", "a"] and lists.get_string_array(df.select("s"), True) == ["", "b", "a"]
    assert lists.get_delimited_string(df.select("id"), ", ") == "1, 2, 3, 4" and lists.get_delimited_string(df.select("s").filter("s > ''"), ";", "'") == "'a';'b'"
    assert lists.get_data_list(df)[0] == (1, "b") and lists.get_dictionary(df) == {1: "b", 2: None, 3: "", 4: "a"}
    with pytest.raises(Exception, match="repeated"):
        lists.get_dictionary(df.unionByName(df))
    assert lists.scalar(df) == 1 and lists.scalar(df.filter("false")) is None
    document = lists.xml_document(df.select(F.lit(b"ab").alias("bin"), "id").limit(1), "zoo", "item")
    assert document.startswith("<zoo><item>") and "<bin>YWI=</bin>" in document
    df.createOrReplaceTempView("shaped")
    assert {k: v.count() for k, v in lists.data_set(spark, ["SELECT * FROM shaped", "SELECT 1"]).items()} == {"Table1": 4, "Table2": 1}


def test_relations(spark):
    zoo = tables(spark)
    got = relations.children(zoo["Exhibit"].select("ExhibitId"), ["ExhibitId"], zoo["Animal"], ["ExhibitId"], "animals").collect()
    assert {r.ExhibitId: sorted(a.Name for a in r.animals) for r in got} == {1: ["Mei Mei", "Percy Y"], 2: ["Ziggy X"]}
    empty = relations.children(zoo["Species"].select("SpeciesId"), ["SpeciesId"], zoo["Animal"].filter("false"), ["SpeciesId"])
    assert all(r.children == [] for r in empty.collect())
    twice = zoo["Exhibit"].unionByName(zoo["Exhibit"].withColumn("Name", F.lit("Zzz")))
    parents = {r.Name: r.parent and r.parent.Name for r in relations.reference(zoo["Animal"], ["ExhibitId"], twice, ["ExhibitId"], order_by="Name").collect()}
    assert parents == {"Mei Mei": "Zzz", "Bao Bao": None, "Ziggy X": "Zzz", "Percy Y": "Zzz"}
    assert relations.attached(zoo["Exhibit"].filter("ExhibitId = 1"), ["ExhibitId"], zoo["Animal"], ["ExhibitId"]).count() == 2


def test_scaffold(spark, tmp_path):
    zoo = tables(spark)
    for name in ("Species", "Animal"):
        zoo[name].write.parquet(f"{tmp_path}/{name}.parquet")
    declared = {
        "Species": scaffold.Declared(key=("SpeciesId",), identity="SpeciesId"),
        "Animal": scaffold.Declared(key=("AnimalId",), foreign=(scaffold.ForeignKey(("SpeciesId",), "Species", ()), scaffold.ForeignKey(("ZookeeperId",), "Keeper", ("Id",)))),
    }
    found = scaffold.from_directory(spark, str(tmp_path), ["Species", "Animal"], declared)
    text = scaffold.emit(found)
    module = {}
    exec(text, module)
    assert module["ANIMAL"]["AnimalId"].key and [(r.name, r.owner, r.many) for r in module["RELATIONS"]] == [("Species", "Animal", False), ("Animals", "Species", True)]
    assert "Keeper is not there" in text and scaffold.Table("v", zoo["Species"].schema, view=True).read_only
    out = str(tmp_path / "entities.py")
    assert [scaffold.write(out, text, dry_run=True), scaffold.write(out, text), scaffold.write(out, text), scaffold.write(out, text + "#\n")] == ["would write", "written", "unchanged", "written"]
    (tmp_path / "own.py").write_text("mine")
    assert scaffold.write(str(tmp_path / "own.py"), text) == "kept"
    chosen = scaffold.options(["--path", "a"], {"ROWCRAFT_PATH": "b", "ROWCRAFT_OUT": "c"}, {"out": "d", "naming": "preserve"})
    assert (chosen.path, chosen.out, chosen.naming) == ("a", "c", "preserve")
    zoo["Species"].createOrReplaceTempView("species_view")
    assert any(t.name == "species_view" and t.view for t in scaffold.from_catalog(spark)) and not any(t.name == "species_view" for t in scaffold.from_catalog(spark, ignored=["SPECIES*"]))


@pytest.mark.parametrize(("many", "one"), [("categories", "category"), ("boxes", "box"), ("people", "person"), ("species", "species"), ("statuses", "status"), ("animals", "animal"), ("dishes", "dish")])
def test_names(many, one):
    assert scaffold.singular(many) == one


def test_native_types():
    assert scaffold.plural("category") == "categories" and scaffold.pascal("order_line-no") == "OrderLineNo" and scaffold.safe("class") == "class_"
    assert scaffold.native_type("NUMERIC", 9, 0) == ("int", None) and scaffold.native_type("numeric", 18, 0)[0] == "bigint" and scaffold.native_type("numeric", 30, 0)[0] == "decimal(30,0)"
    assert scaffold.native_type("text[]")[0] == "array<string>" and scaffold.native_type("tinyint(1)")[1] and scaffold.native_type("geometry") == ("string", "geometry is not known and read as text")


def test_stream(spark, tmp_path):
    of = EntityMap("t", (Field("id", "int", key=True), Field("v", "string")))
    store = Store(spark, f"file://{tmp_path}/store")
    store.replace("t", spark.createDataFrame([(1, "old"), (2, "stays")], of.struct()))
    spark.createDataFrame([(1, "new"), (3, "added"), (4, None)], of.struct()).write.parquet(f"{tmp_path}/in")
    stream = feed.mapped(spark.readStream.schema(of.struct()).parquet(f"{tmp_path}/in"), of, lambda r: r.v != None)  # noqa: E711
    run = feed.upsert_into(stream, of, store, f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert run.awaitTermination(60)
    assert sorted(rows(store.read("t"))) == [(1, "new"), (2, "stays"), (3, "added")]


def test_inflection():
    for one, many in (("human", "humans"), ("specimen", "specimens"), ("status", "statuses"), ("SalesPerson", "SalesPeople"), ("order_child", "order_children"), ("house", "houses"), ("Category", "Categories"), ("woman", "women"), ("species", "species"), ("bus", "buses")):
        assert scaffold.plural(one) == many and scaffold.singular(many) == one and not scaffold.uncertain(many)
    assert scaffold.plural("criterion", {"criteria": "criterion"}) == "criteria" and scaffold.singular("SearchCriteria", {"criteria": "criterion"}) == "SearchCriterion"
    assert scaffold.uncertain("analysis")


def test_large_lists(spark):
    df = spark.range(1000).select(F.col("id"), F.concat(F.lit("v"), "id").alias("v"))
    pieces = lists.delimited_pieces(df, ",", pieces=5).orderBy("piece").collect()
    assert len(pieces) == 5 and ",".join(r.value for r in pieces) == lists.get_delimited_string(df)
    assert {tuple(r) for r in lists.entries(df).collect()} == {(k, f"v{k}") for k in range(1000)}
    with pytest.raises(Exception, match="repeated"):
        lists.entries(df.unionByName(df)).collect()
