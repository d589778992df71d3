"""Writing: inserts, updates with outcomes, deletes, transactions, cursor."""

import re
from dataclasses import replace
from decimal import Decimal
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from rowcraft.functions.scratch import scratch_dir
from rowcraft.operators import audit, dml
from rowcraft.operators.cursor import Cursor
from rowcraft.operators.entity import EntityMap, Field, MappingError
from rowcraft.operators.store import Store
from rowcraft.operators.tracked import Tracked, TrackedList, batch_of
from rowcraft.plans import write_queries
from tests.zoo import ANIMAL, EXHIBIT, FEEDING, SPECIES, tables


@pytest.fixture(scope="module")
def zoo(spark):
    return tables(spark)


def test_insert_numbers_rows(spark, zoo):
    new = spark.createDataFrame([("Yak", "Mammal", False), ("Kiwi", None, True)], "Name string, Classification string, IsEndangered boolean").repartition(2)
    got = dml.insert(zoo["Species"], SPECIES, new)
    assert got.schema.names == zoo["Species"].schema.names
    assert sorted(r.SpeciesId for r in got.collect()) == [1, 2, 3, 4, 5]
    fresh = dml.insert(zoo["Exhibit"], EXHIBIT, spark.createDataFrame([("Pond", 3, None)], "Name string, Capacity int, IsOpen boolean"))
    assert fresh.filter("ExhibitId = 3").first().RowVersion == 1
    assert dml.insert(zoo["Animal"], ANIMAL, spark.createDataFrame([("Noteless", None)], "Name string, Notes string"), null_text="").filter("AnimalId = 5").first().Notes == ""


def test_length_rule(spark, zoo):
    long = spark.createDataFrame([("A name much too long", 1, True)], "Name string, Capacity int, IsOpen boolean")
    with pytest.raises(Exception, match="longer than 12"):
        dml.insert(zoo["Exhibit"], EXHIBIT, long).collect()
    trimmed = EntityMap("Exhibit", tuple(replace(f, trim_to_fit=True) if f.name == "Name" else f for f in EXHIBIT.fields))
    assert dml.insert(zoo["Exhibit"], trimmed, long).filter("ExhibitId = 3").first().Name == "A name much "


def edit(df, **values):
    return df.withColumns({k: F.lit(v).cast(df.schema[k].dataType) for k, v in values.items()})


def outcome(base, of, batch, *args, **options):
    return [r.outcome for r in dml.outcomes(base, of, batch, *args, **options).collect()]


def test_update_outcomes(zoo):
    base = zoo["Animal"]
    one = base.filter("AnimalId = 1")
    changed = edit(one, Name="Mei")
    assert outcome(base, ANIMAL, dml.changes(changed, one, ANIMAL)) == ["Success"]
    assert outcome(base, ANIMAL, dml.changes(one, one, ANIMAL)) == ["Skipped"]
    stale = edit(one, Name="Old Name")
    assert outcome(base, ANIMAL, dml.changes(changed, stale, ANIMAL)) == ["Conflict"]
    assert outcome(base, ANIMAL, dml.changes(changed, stale, ANIMAL), select_back=False) == ["Fail"]
    assert outcome(base, ANIMAL, dml.changes(changed, stale, ANIMAL), "key") == ["Success"]
    assert outcome(base, ANIMAL, dml.changes(changed, stale, ANIMAL), select_back=False, ignore_count=True) == ["Success"]
    # Another field was changed by someone else: only "all" minds.
    other = edit(one, SpeciesId=3)
    assert outcome(base, ANIMAL, dml.changes(edit(other, Name="Mei"), other, ANIMAL)) == ["Success"]
    assert outcome(base, ANIMAL, dml.changes(edit(other, Name="Mei"), other, ANIMAL), "all") == ["Conflict"]
    # Notes can't be compared: only null against not null counts.
    notes = edit(one, Notes="read something else")
    assert outcome(base, ANIMAL, dml.changes(edit(notes, Notes="new"), notes, ANIMAL)) == ["Success"]
    gone = edit(one, AnimalId=77)
    assert outcome(base, ANIMAL, dml.changes(edit(gone, Name="x"), gone, ANIMAL)) == ["Fail"]


def test_row_versions(zoo):
    base = zoo["Exhibit"]
    one = base.filter("ExhibitId = 1")
    batch = dml.changes(edit(one, Capacity=9), one, EXHIBIT)
    state, judged = dml.save(base, EXHIBIT, batch, "version")
    assert [r.outcome for r in judged.collect()] == ["Success"]
    assert {(r.ExhibitId, r.Capacity, r.RowVersion) for r in state.collect()} == {(1, 9, 2), (2, 2, 1)}
    assert outcome(state, EXHIBIT, batch, "version") == ["Conflict"]
    with pytest.raises(MappingError):
        outcome(zoo["Animal"], ANIMAL, dml.changes(zoo["Animal"], zoo["Animal"], ANIMAL), "version")


def test_hooks_and_read_back(zoo):
    base = zoo["Exhibit"]
    one = base.filter("ExhibitId = 1")
    batch = dml.changes(edit(one, Capacity=9), one, EXHIBIT)
    state, judged = dml.save(base, EXHIBIT, batch, before_save=lambda b: None)
    assert state is base and [r.outcome for r in judged.collect()] == ["Skipped"]
    state, judged = dml.save(base, EXHIBIT, batch, before_save=lambda b: b)
    assert [tuple(r) for r in dml.read_back(state, EXHIBIT, judged).collect()] == [(1, "Bamboo", 9, True, 2)]
    assert [tuple(r) for r in dml.read_back(state, EXHIBIT, judged, "made").collect()] == [(1, 2)]
    assert [tuple(r) for r in dml.read_back(state, EXHIBIT, judged, "unchanged").collect()] == [(1, "Bamboo", None, True, 2)]


def test_collection_save(spark, zoo):
    a = [Tracked(ANIMAL, r) for r in zoo["Animal"].orderBy("AnimalId").collect()]
    a[0].Weight = Decimal("96.00")
    a[1].delete()
    a.append(Tracked(ANIMAL, {"Name": "New One", "SpeciesId": 1}).attach_new())
    state, judged = dml.save(zoo["Animal"], ANIMAL, batch_of(spark, ANIMAL, a))
    assert sorted(r.outcome for r in judged.collect()) == ["Skipped", "Skipped", "Success", "Success", "Success"]
    assert sorted((r.AnimalId, r.Weight) for r in state.collect() if r.AnimalId != 4 and r.AnimalId < 5) == [(1, Decimal("96.00")), (3, Decimal("40.00"))]
    assert state.filter("Name = 'New One'").first().AnimalId == 5
    with pytest.raises(Exception, match="detached"):
        dml.outcomes(zoo["Animal"], ANIMAL, batch_of(spark, ANIMAL, [Tracked(ANIMAL)])).collect()


def test_added_rows_whose_key_is_taken(spark, zoo):
    f = zoo["FeedingSchedule"]
    new = edit(f.filter("DayOfWeek = 1"), FoodType="new").unionByName(edit(f.filter("DayOfWeek = 2"), DayOfWeek=8))
    state, judged = dml.save(f, FEEDING, dml.changes(new, None, FEEDING, dml.ADDED))
    assert {(r["_new"].DayOfWeek, r.outcome) for r in judged.collect()} == {(1, "Fail"), (8, "Success")}
    assert state.count() == 8 and state.filter("FoodType = 'new'").count() == 0
    assert {tuple(r) for r in dml.outcome_counts(judged).collect()} == {("Fail", 2), ("Success", 2)}
    twice = dml.changes(edit(f.filter("DayOfWeek = 2"), DayOfWeek=8).unionByName(edit(f.filter("DayOfWeek = 3"), DayOfWeek=8)), None, FEEDING, dml.ADDED)
    state, judged = dml.save(f, FEEDING, twice)
    assert {r.outcome for r in judged.collect()} == {"Fail"} and state.count() == 6


def test_repeated_keys(spark, zoo):
    f = zoo["FeedingSchedule"]
    one = f.filter("DayOfWeek = 1 and TimeSlot = 'am'")
    twice = edit(one, FoodType="x").withColumn("at", F.lit(1)).unionByName(edit(one, FoodType="y").withColumn("at", F.lit(2)))
    got = dml.bulk_update(f, FEEDING, twice, ["FoodType"], order_by="at")
    assert got.count() == 6 and [r.FoodType for r in got.filter("DayOfWeek = 1 and TimeSlot = 'am'").collect()] == ["y"]
    with pytest.raises(Exception, match="repeated"):
        dml.bulk_update(f, FEEDING, twice, ["FoodType"]).collect()
    states = lambda *s: f.sparkSession.createDataFrame([(1, 9, "am", f"food{k}", None, None, state, k) for k, state in enumerate(s)], "AnimalId int, DayOfWeek int, TimeSlot string, FoodType string, Quantity decimal(6,2), x int, _state string, at int").drop("x")
    foods = lambda rows: sorted(r.FoodType for r in dml.save_table(f, FEEDING, rows, "at").filter("DayOfWeek = 9").collect())
    assert foods(states("Added", "Modified", "Modified")) == ["food2"] and foods(states("Added", "Deleted")) == [] and foods(states("Modified")) == []
    both = states("Deleted", "Added").withColumn("DayOfWeek", F.lit(1))
    assert [r.FoodType for r in dml.save_table(f, FEEDING, both, "at").filter("DayOfWeek = 1 and TimeSlot = 'am'").collect()] == ["food1"]


def test_numbers_of_many_partitions(spark, zoo):
    new = spark.range(5000).repartition(7).select(F.concat(F.lit("n"), "id").alias("Name"), F.lit(True).alias("IsEndangered"))
    ids = [r.SpeciesId for r in dml.insert(zoo["Species"], SPECIES, new).collect()]
    assert sorted(ids) == list(range(1, 5004))


def test_deleted_items_are_kept(zoo):
    rows = TrackedList(Tracked(SPECIES, r) for r in zoo["Species"].collect())
    gone, new = rows[1], Tracked(SPECIES, {"Name": "x"}).attach_new()
    rows.append(new)
    rows.remove(gone)
    rows.remove(new)
    assert len(rows) == 2 and rows.deleted == [gone] and [r.state for r in rows.to_save()] == ["Deleted", "Unchanged", "Unchanged"]


def test_state_machine():
    t = Tracked(SPECIES, {"SpeciesId": 1, "Name": "a"})
    assert t.state == dml.UNCHANGED
    t.Name = "b"
    t.Name = "c"
    assert t.state == dml.MODIFIED and t.original == {"Name": "a"}
    t.reject_changes()
    assert t.Name == "a" and t.state == dml.UNCHANGED and Tracked(SPECIES).state == dml.DETACHED
    with pytest.raises(AttributeError):
        t.Nope = 1


def test_mass_changes(zoo):
    base = zoo["Animal"]
    got = dml.update_rows(base, ANIMAL, {"Weight": 1, "Notes": lambda a: a.Name.concat("!")}, lambda a: a.Weight < 50)
    assert {(r.AnimalId, r.Notes) for r in got.collect()} == {(1, "calm"), (2, "Bao Bao!"), (3, "Ziggy X!"), (4, "100% bird")}
    assert dml.count_hits(base, ANIMAL, lambda a: a.Weight < 50) == 2
    assert {r.AnimalId for r in dml.delete(base, ANIMAL, lambda a: a.Weight < 50).collect()} == {1, 4}
    with pytest.raises(MappingError):
        dml.update_rows(base, ANIMAL, {"AnimalId": 5}, lambda a: a.Weight < 50)
    f = zoo["FeedingSchedule"]
    assert dml.delete_items(f, FEEDING, f.filter("DayOfWeek = 1 and TimeSlot = 'am'")).count() == 5
    bulk = dml.bulk_update(f, FEEDING, edit(f.filter("DayOfWeek = 2"), FoodType="fish"))
    assert bulk.filter("FoodType = 'fish'").count() == 2 and bulk.count() == 6


def test_save_table_and_composite_keys(zoo):
    f = zoo["FeedingSchedule"]
    rows = edit(f.filter("DayOfWeek = 3"), FoodType="hay").withColumn("_state", F.when(F.col("TimeSlot") == "am", "Modified").otherwise("Deleted"))
    new = edit(f.filter("DayOfWeek = 1"), DayOfWeek=7).withColumn("_state", F.lit("Added"))
    got = dml.save_table(f, FEEDING, rows.unionByName(new))
    assert got.count() == 7 and got.filter("FoodType = 'hay'").count() == 1


def sorts(df):
    """(sorts, whether it scans) of the tasks on each side of an exchange or union."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    nodes, found = [(re.search(r"[A-Za-z*]", x).start(), re.sub(r"^[ :+-]*(\*\(\d+\) )?", "", x)) for x in lines if re.search(r"[A-Za-z]", x)], []

    def walk(k):
        below, at = [], k + 1
        while at < len(nodes) and nodes[at][0] > nodes[k][0]:
            got, at = walk(at)
            below.append(got)
        name = nodes[k][1]
        if name.startswith(("Exchange", "ReusedExchange")):
            found.extend(below)
            return (0, False), at
        many = (max if name.startswith("Union") else sum)([0, *(x[0] for x in below)])
        return (many + name.startswith("Sort "), "Scan" in name or any(x[1] for x in below)), at

    return [*found, walk(0)[0]]


def test_tasks_of_a_mass_save_sort_little(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("dml_save_table", "dml_bulk_update", "dml_bulk_update_repeated"):
            tasks = sorts(write_queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
            assert max(n for n, _ in tasks) == 2, name  # the table's rows and the edits
            assert not any(n for n, scans in tasks if scans), name
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_save_table_meets_a_key_once(spark):
    of = EntityMap("t", (Field("k", "bigint", key=True), Field("v", "string"), Field("n", "bigint", row_version=True)))
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (2, "c", 1), (3, "d", 1), (None, "e", 1)], "k bigint, v string, n bigint")
    rows = spark.createDataFrame([(1, "A", 0, "Modified"), (2, "B", 0, "Deleted"), (3, "D", 0, "Added"), (4, "F", 0, "Modified"), (None, "E", 0, "Deleted"), (5, "G", 0, "Added")], "k int, v string, n int, _state string")
    same = {(2, "b", 1), (2, "c", 1), (3, "d", 1), (None, "e", 1)}  # twice there, taken, no key
    got = [tuple(r) for r in dml.save_table(base, of, rows).collect()]
    assert set(got) == same | {(1, "A", 2), (5, "G", 1)} and len(got) == 6
    nameless = spark.createDataFrame([(None, "H", 0, "Added")], "k int, v string, n int, _state string")
    assert sorted(r.v for r in dml.save_table(base, of, nameless).filter("k is null").collect()) == ["H", "e"]
    with pytest.raises(Exception, match="detached"):
        dml.save_table(base, of, rows.withColumn("_state", F.lit(dml.DETACHED))).collect()


def test_save_table_numbers_part_of_a_key(spark):
    of = EntityMap("t", (Field("id", "bigint", key=True, identity=True), Field("place", "string", key=True), Field("v", "string")))
    base = spark.createDataFrame([(7, "x", "old")], "id bigint, place string, v string")
    rows = spark.createDataFrame([(-1, "x", "a", "Added"), (-2, "x", "b", "Added"), (7, "x", "new", "Modified")], "id bigint, place string, v string, _state string")
    assert sorted((r.id, r.v) for r in dml.save_table(base, of, rows).collect())[0] == (7, "new")
    assert sorted(r.id for r in dml.save_table(base, of, rows).collect()) == [7, 8, 9]


def test_audit_and_conflicts(zoo):
    base = zoo["Animal"]
    one = base.filter("AnimalId = 1")
    read = edit(one, Name="Seen")
    batch = dml.changes(edit(read, Name="Mine", SpeciesId=2), read, ANIMAL)
    assert {tuple(r) for r in audit.audit(batch, ANIMAL).collect()} == {("1", "Modified", "Name", "Seen", "Mine"), ("1", "Modified", "SpeciesId", "1", "2")}
    assert [tuple(r) for r in audit.conflicts(base, ANIMAL, batch).collect()] == [("1", "Name", "Seen", "Mei Mei", "Mine")]
    assert "<property>Name</property>" in audit.audit_xml(batch, ANIMAL).first().changes


def test_transactions(spark, zoo, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    with pytest.raises(LookupError):
        store.read("Species")
    store.replace("Species", zoo["Species"])
    with store.transaction(b"\x01\xff") as t:
        t.write("Species", dml.delete(t.read("Species"), SPECIES, lambda s: s.IsEndangered))
        assert t.read("Species").count() == 1 and store.read("Species").count() == 3
        assert t.log().first().context == "01ff"
    assert store.read("Species").count() == 1
    with pytest.raises(RuntimeError), store.transaction() as t:
        t.write("Species", zoo["Species"])
        raise RuntimeError("no")
    assert store.read("Species").count() == 1
    assert [tuple(r)[::3] for r in store.history().orderBy("number").collect()] == [(1, None), (2, "01ff")]


def test_commit_is_for_all_tables_or_none(spark, zoo, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}")
    store.replace("Species", zoo["Species"])
    before = store.version("Species")
    with pytest.raises(RuntimeError, match="another"), store.transaction() as t:
        t.write("Species", zoo["Species"].limit(1))
        t.write("Exhibit", zoo["Exhibit"])
        monkeypatch.setattr(store, "_current", lambda: (0, {"tables": {}}))
    monkeypatch.undo()
    assert store.version("Species") == before and store.version("Exhibit") is None and store.read("Species").count() == 3
    for k in range(4):
        store.replace("Exhibit", zoo["Exhibit"].limit(k))
    assert store.vacuum() == 2 and store.read("Exhibit").count() == 2 and store.read("Species").count() == 3
    assert sum(p.is_dir() for p in (tmp_path / "Exhibit").iterdir()) == 2


def test_cursor(spark):
    critters = spark.createDataFrame([(1, "Ziggy", 10), (2, "Bongo", 20), (3, "Pip", 30)], "Id int, Name string, Score int")
    critters.createOrReplaceTempView("Critters")
    c = Cursor(spark)
    assert c.record_count == -1
    assert c.open("SELECT * FROM Critters WHERE Score >= $0 ORDER BY Id", 10) == 3
    assert c["Name"] == "Ziggy" and c[0] == 1 and c.fields == ["Id", "Name", "Score"]
    assert c.move_next() and c["name"] == "Bongo" and c.move_last() and not c.move_next() and c.eof
    assert c.move_first() and not c.move_previous() and c.bof
    c.move_first()
    assert c.find_next("Score > 15") and c.position == 1 and c.find_next("Score > 15") and c.position == 1
    assert not c.find_next("Score > 99") and c.position == 1
    c["Score"] = 25
    c.add_row({"Id": 4, "Name": "Dot"})
    c.move_first()
    c.delete()
    with pytest.raises(RuntimeError):
        c.update_batch(critters)
    c.init_update("Critters", "Id")
    got = c.update_batch(critters)
    assert sorted(tuple(r) for r in got.collect()) == [(2, "Bongo", 25), (3, "Pip", 30), (4, "Dot", None)]
    assert c.record_count == 3 and c.requery() == 3


def test_a_cluster_needs_a_shared_folder():
    session = lambda master, conf: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(RuntimeError, match="share"):
            scratch_dir(session(master, {}))
        assert scratch_dir(session(master, {"spark.checkpoint.dir": "hdfs:/x"})) == "hdfs:/x"
    assert scratch_dir(session("local[*]", {})) == scratch_dir(session("local", {}))
