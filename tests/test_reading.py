"""Reading: maps, predicates, filters, pages, counts, nulls."""

import pytest
from pyspark.sql import functions as F

from rowcraft.functions.predicate import Entity, UnsupportedExpression, where
from rowcraft.operators import filters, params
from rowcraft.operators.adapter import Adapter, read_rows, read_values
from rowcraft.operators.entity import EntityMap, Field, MappingError
from tests.zoo import ANIMAL, EXHIBIT, SPECIES, tables


@pytest.fixture(scope="module")
def zoo(spark):
    return tables(spark)


@pytest.fixture(scope="module")
def animals(spark, zoo):
    return Adapter(spark, ANIMAL, zoo["Animal"], "AnimalId")


def ids(df):
    return [r.AnimalId for r in df.collect()]


CASES = [
    (lambda a: a.SpeciesId == 1, [1, 2]),
    (lambda a: a.ExhibitId == None, [2]),  # noqa: E711
    (lambda a: a.ExhibitId != None, [1, 3, 4]),  # noqa: E711
    (lambda a: (a.SpeciesId == 1) & (a.Weight > 5), [1]),
    (lambda a: ~(a.Weight > 50), [2, 3]),
    (lambda a: a.ExhibitId != 1, [3]),
    (lambda a: a.SpeciesId.in_([]), []),
    (lambda a: ~a.ExhibitId.in_([]), [1, 2, 3, 4]),
    (lambda a: ~a.ExhibitId.in_([2]), [1, 4]),
    (lambda a: a.ExhibitId.in_([None, 1]), [1, 4]),
    (lambda a: a.AnimalId.in_(range(1, 101)), [1, 2, 3, 4]),
    (lambda a: a.Name.contains("%"), []),
    (lambda a: a.Notes.contains("%"), [4]),
    (lambda a: a.DateOfBirth.year > 1900, [1, 3, 4]),
    (lambda a: a.ExhibitId.coalesce(-1) == -1, [2]),
    (lambda a: a.Name.length > 6, [1, 2, 3, 4]),
    (lambda a: a.Name.index_of("ao") > 0, [2]),
    (lambda a: a.Name.index_of("zzz") == -1, [1, 2, 3, 4]),
    (lambda a: ~a.Name.starts_with("Mei"), [2, 3, 4]),
    (lambda a: a.Name.starts_with("MEI", ignore_case=True), [1]),
    (lambda a: a.Notes.is_null_or_empty(), [2, 3]),
    (lambda a: ~a.Notes.is_null_or_empty(), [1, 4]),
    (lambda a: a.Name.like("%X"), [3]),
    (lambda a: a.Name.ilike("mei%"), [1]),
    (lambda a: a.Name.matches("^[MB]"), [1, 2]),
    (lambda a: (a.ExhibitId == 1).then("a", "b") == "b", [2, 3]),
    (lambda a: a.AnimalId / 2 == 1, [2, 3]),
    (lambda a: a.AnimalId % 2 == 1, [1, 3]),
    (lambda a: (a.AnimalId & 1) == 0, [2, 4]),
    (lambda a: (a.AnimalId | 1) == 3, [2, 3]),
    (lambda a: 10 - a.AnimalId > 7, [1, 2]),
    (lambda a: -a.AnimalId < -3, [4]),
    (lambda a: a.Weight.round(1) == 4.3, [2]),
    (lambda a: a.DateOfBirth.date == "2018-05-01", [3]),
    (lambda a: True, [1, 2, 3, 4]),
    (lambda a: False, []),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_predicates(animals, case):
    predicate, expected = CASES[case]
    assert ids(animals.fill(predicate)) == expected


def test_subqueries(animals, zoo):
    open_ = lambda a: a.ExhibitId.in_query(EXHIBIT, zoo["Exhibit"], lambda e: e.IsOpen)
    assert ids(animals.fill(open_)) == [1, 3, 4]
    assert ids(animals.fill(lambda a: ~open_(a))) == []
    closed = lambda a: a.ExhibitId.in_query(EXHIBIT, zoo["Exhibit"], lambda e: e.Capacity > 3, select=lambda e: e.ExhibitId)
    assert ids(animals.fill(lambda a: ~closed(a))) == [3]
    assert ids(animals.fill(lambda a: (a.AnimalId == 2) | closed(a))) == [1, 2, 4]
    with_null = zoo["Animal"].select("ExhibitId")
    assert ids(animals.fill(lambda a: ~a.AnimalId.in_(with_null))) == []
    with pytest.raises(UnsupportedExpression):
        animals.fill(lambda a: a.ExhibitId.in_query(EXHIBIT, zoo["Exhibit"], lambda e: a.Weight > e.Capacity))
    with pytest.raises(UnsupportedExpression):
        animals.fill(lambda a: a.ExhibitId.in_query(EXHIBIT, zoo["Exhibit"], lambda e: e.IsOpen, select=lambda e: e.Capacity + 1))
    with pytest.raises(MappingError):
        animals.fill(lambda a: a.Weight.in_query(EXHIBIT, zoo["Exhibit"], lambda e: e.IsOpen))


def test_what_has_no_translation_raises(animals):
    a = Entity(ANIMAL)
    for wrong in (lambda: bool(a.Name == "x"), lambda: a.Nothing, lambda: a.Name.contains(5), lambda: a.Name == (lambda: 1), lambda: a.Name.contains("x", ignore_case="y"), lambda: list(a.Name)):
        with pytest.raises(UnsupportedExpression):
            wrong()
    with pytest.raises(UnsupportedExpression):
        animals.fill(lambda x: x.Name)
    with pytest.raises(ValueError):
        a.AnimalId.in_list([])


def test_predicates_reach_the_scan(spark, zoo, tmp_path):
    zoo["Animal"].write.parquet(str(tmp_path / "a"))
    df = Adapter(spark, EntityMap("a", ANIMAL.fields[:2]), spark.read.parquet(str(tmp_path / "a"))).fill(lambda a: a.Name.starts_with("Mei") & (a.AnimalId > 0))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(Name,Mei)" in plan and "Weight" not in plan.split("ReadSchema")[1]


def test_filter_objects(animals, zoo):
    assert ids(animals.fill(filters.eq("SpeciesId", 1), filters.gt("Weight", 5))) == [1]
    assert ids(animals.fill(filters.eq("ExhibitId", None))) == []
    assert ids(animals.fill(filters.is_null("ExhibitId"))) == [2]
    assert ids(animals.fill(filters.not_like("Name", "M%"), filters.imatch("Name", "^b|^z"))) == [2, 3]
    with pytest.raises(ValueError):
        filters.apply(zoo["Animal"])


def test_text_filters(animals):
    assert ids(animals.fill("SpeciesId = $0 and Name <> $1", args=[1, "x"])) == [1, 2]
    assert ids(animals.fill("")) == [1, 2, 3, 4]
    assert params.bind("a = $1 or b = $10 or c = $1", list(range(11))) == ("a = :p1 or b = :p10 or c = :p1", {"p1": 1, "p10": 10})
    with pytest.raises(ValueError):
        params.bind("a = $3", [1])
    assert params.bind("a = $0", [params.Parameter("7", "int")])[1]["p0"] is not None


def test_pages_counts_and_first_rows(spark, animals, zoo):
    assert ids(animals.fill_range(1, 2)) == [2, 3]
    with pytest.raises(ValueError):
        Adapter(spark, ANIMAL, zoo["Animal"]).fill_range(0, 1)
    assert animals.get_count(lambda a: a.SpeciesId == 1) == 2 and animals.get_count("") == 4 and animals.get_count(filters.lt("Weight", 50)) == 2
    with pytest.raises(ValueError):
        animals.get_count(None)
    assert animals.exists(lambda a: a.Name == "Mei Mei") and not animals.exists("Weight > 1000")
    assert animals.get_one(lambda a: a.SpeciesId == 1).Name == "Mei Mei" and animals.get_one(lambda a: a.AnimalId == 99) is None
    assert Adapter(spark, ANIMAL, zoo["Animal"], "Weight desc").get_one().AnimalId == 1
    assert [r.AnimalId for r in animals.open_reader(lambda a: a.SpeciesId == 1)] == [1, 2]
    assert list(animals.open_reader(make=lambda r: r.Name))[0] == "Mei Mei"
    assert len(animals.get_array()) == 4 and next(iter(read_values(zoo["Species"].orderBy("SpeciesId"))))[0] == 1
    assert next(read_rows(zoo["Species"].orderBy("SpeciesId"))).Name == "Giant Panda"
    seen = []
    animals.before_read.append(seen.append)
    animals.fill_all()
    animals.before_read.clear()
    assert len(seen) == 1


def test_maps(spark, zoo):
    m = EntityMap.implicit("Species", zoo["Species"].schema, ("SpeciesId",))
    assert [f.name for f in m.keys] == ["SpeciesId"] and m["speciesid"].key
    with pytest.raises(MappingError):
        EntityMap("t", (Field("a", "int"), Field("A", "int")))
    with pytest.raises(MappingError):
        EntityMap("t", (Field("a", "int", "x"), Field("b", "int", "X")))
    with pytest.raises(MappingError):
        EntityMap.implicit("Species", zoo["Species"].schema, ("Nope",))
    versions = EntityMap("t", (Field("a", "int"), Field("b", "int", since=2)))
    assert len(versions.at_version(1).fields) == 1 and versions.at_version(0) is versions
    hidden = EntityMap("Species", (Field("Id", "int", "SpeciesId"), Field("Secret", "string", "Name", access="w"), Field("Extra", "int", default=7), Field("Twice", "int", expression="SpeciesId * 2")))
    assert Adapter(spark, hidden, zoo["Species"]).fill(lambda s: s.Twice == 4).collect() == [(2, 7, 4)]
    odd = spark.createDataFrame([(1, 2, "x")], "Id int, Order int, `my note` string")
    order_log = EntityMap("Order Log", (Field("Id", "int"), Field("Order", "int"), Field("Note", "string", "my note")))
    assert where(odd, order_log, lambda o: (o.Order == 2) & (o.Note == "x")).count() == 1
    assert Adapter(spark, SPECIES, zoo["Species"]).on_table(zoo["Species"].filter("false")).get_count() == 0
    assert Adapter(spark, SPECIES).fill_rows([(9, "Yak", None, False)]).first().Name == "Yak"
    assert Adapter(spark, order_log, odd.select("Id", F.lit(1).alias("unmapped"))).fill_all().columns == ["Id", "Order", "Note"]


def test_order_by_text_with_commas_in_it(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", "y"), (3, "a, b", "x")], "Id int, V string, W string")
    of = EntityMap("t", (Field("Id", "int", key=True), Field("V", "string"), Field("W", "string")))
    ids = lambda text: [r.Id for r in Adapter(spark, of, df, text).get_list()]
    assert ids("coalesce(W, 'z') desc, Id") == [1, 2, 3] and ids("replace(V, ', b', ''), Id desc") == [3, 2, 1]
    assert ids("W nulls last") == [3, 2, 1] and ids("W desc nulls first") == [1, 2, 3] and ids("W asc") == [1, 3, 2]
    assert [r.Id for r in Adapter(spark, of, df, "Id").get_list(lambda t: 5 % t.Id == 1)] == [2]
