"""A small zoo: five tables with nulls, composite keys and dates."""

from datetime import datetime
from decimal import Decimal

from rowcraft.operators.entity import EntityMap, Field

K1, K2 = "11111111-1111-1111-1111-111111111111", "22222222-2222-2222-2222-222222222222"

SPECIES = EntityMap("Species", (Field("SpeciesId", "int", key=True, identity=True, nullable=False), Field("Name", "string", nullable=False, length=100), Field("Classification", "string"), Field("IsEndangered", "boolean", nullable=False)))
EXHIBIT = EntityMap("Exhibit", (Field("ExhibitId", "int", key=True, identity=True), Field("Name", "string", length=12), Field("Capacity", "int"), Field("IsOpen", "boolean"), Field("RowVersion", "bigint", row_version=True)))
ANIMAL = EntityMap(
    "Animal",
    (
        Field("AnimalId", "int", key=True, identity=True), Field("Name", "string", nullable=False), Field("SpeciesId", "int"), Field("ExhibitId", "int"), Field("ZookeeperId", "string"),
        Field("DateOfBirth", "timestamp_ntz"), Field("Weight", "decimal(8,2)"), Field("Notes", "string", compared=False),
    ),
)
FEEDING = EntityMap("FeedingSchedule", (Field("AnimalId", "int", key=True), Field("DayOfWeek", "int", key=True), Field("TimeSlot", "string", key=True), Field("FoodType", "string"), Field("Quantity", "decimal(6,2)")))


def tables(spark):
    def frame(of, rows):
        return spark.createDataFrame(rows, of.struct())

    born = lambda y: datetime(y, 5, 1, 8, 30)
    return {
        "Species": frame(SPECIES, [(1, "Giant Panda", "Mammal", True), (2, "Snow Leopard", "Mammal", True), (3, "Emu", "Bird", False)]),
        "Exhibit": frame(EXHIBIT, [(1, "Bamboo", 4, True, 1), (2, "Heights", 2, True, 1)]),
        "Animal": frame(
            ANIMAL,
            [
                (1, "Mei Mei", 1, 1, K1, born(2015), Decimal("95.50"), "calm"), (2, "Bao Bao", 1, None, K1, None, Decimal("4.25"), None),
                (3, "Ziggy X", 2, 2, K2, born(2018), Decimal("40.00"), None), (4, "Percy Y", 3, 1, K2, born(2020), None, "100% bird"),
            ],
        ),
        "FeedingSchedule": frame(FEEDING, [(1, d, s, "bamboo", Decimal("5.00")) for d in (1, 2, 3) for s in ("am", "pm")]),
    }
