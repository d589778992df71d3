"""Writes as functions from a table to its next state.

A change never touches stored data: it returns the whole next state as a lazy
DataFrame, which the caller writes where it likes (``store.replace`` writes a
Parquet directory). So every change can be tested, explained and combined.

Saves use optimistic concurrency. A batch has the new values, and for each row
its state and the original values the caller read. A row is matched by keys and
by its criteria; the outcome of each is a column, not an exception.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowcraft.functions.predicate import Entity, Term, condition
from rowcraft.functions.scratch import materialise
from rowcraft.operators.entity import EntityMap, Field, MappingError, quoted

ADDED, MODIFIED, DELETED, UNCHANGED, DETACHED = "Added", "Modified", "Deleted", "Unchanged", "Detached"
SUCCESS, SKIPPED, CONFLICT, FAIL = "Success", "Skipped", "Conflict", "Fail"
CRITERIA = ("key", "version", "changed", "all")


def _value(v: Any) -> Column:
    return v.column if isinstance(v, Term) else v if isinstance(v, Column) else F.lit(v)


def _hit(of: EntityMap, predicate: Callable[[Entity], Any] | Column | str) -> Column:
    """A condition that is false where it is unknown."""
    asked = F.expr(predicate) if isinstance(predicate, str) else predicate if isinstance(predicate, Column) else condition(predicate(Entity(of)))
    return F.coalesce(asked, F.lit(False))


def update_rows(df: DataFrame, of: EntityMap, values: Mapping[str, Any], predicate) -> DataFrame:
    """Mass update: sets fields where the predicate holds, all at once."""
    hit, made = _hit(of, predicate), {}
    for name, value in values.items():
        f = of[name]
        if not f.writable or f.identity:
            raise MappingError(f"{f.name} is read-only")
        new = value(Entity(of)) if callable(value) and not isinstance(value, Column) else value
        made[f.source] = F.when(hit, fitted(f, _value(new).cast(f.data_type))).otherwise(F.col(quoted(f.source)))
    for f in of.fields:
        if f.row_version:
            made[f.source] = F.when(hit, F.col(quoted(f.source)) + 1).otherwise(F.col(quoted(f.source)))
    return df.withColumns(made)


def count_hits(df: DataFrame, of: EntityMap, predicate) -> int:
    """How many rows a mass update or delete affects."""
    return df.filter(_hit(of, predicate)).count()


def delete(df: DataFrame, of: EntityMap, predicate) -> DataFrame:
    """The rows for which the predicate does not hold, unknown included."""
    return df.filter(~_hit(of, predicate))


def delete_items(df: DataFrame, of: EntityMap, items: DataFrame) -> DataFrame:
    """Without the rows whose keys, partition keys included, are in ``items``."""
    keys = [f.source for f in of.all_keys]
    gone = items.select(*[F.col(quoted(k)).alias(f"_g{n}") for n, k in enumerate(keys)])
    return df.join(gone, [F.col(quoted(k)) == F.col(f"_g{n}") for n, k in enumerate(keys)], "left_anti")


def fitted(f: Field, value: Column) -> Column:
    """A text cut to its field's length, or an error where it is too long."""
    if f.kind != "text" or not f.length:
        return value
    long = F.length(value) > f.length
    too_long = F.raise_error(F.concat(F.lit(f"{f.name} is longer than {f.length}: "), value))
    return F.when(long, F.substring(value, 1, f.length) if f.trim_to_fit else too_long.cast("string")).otherwise(value)


def _new_rows(base: DataFrame, of: EntityMap, rows: DataFrame, null_text: str | None) -> DataFrame:
    """Rows in the shape of the table, with identities and versions made."""
    given, out, identity = {c.lower(): c for c in rows.columns}, [], None
    for name in base.columns:
        f = next((x for x in of.fields if x.source.lower() == name.lower()), None)
        own = given.get(name.lower()) or (given.get(f.name.lower()) if f else None)
        value = F.col(quoted(own)) if own else F.lit(None)
        if f is None:
            out.append(value.cast(base.schema[name].dataType).alias(name))
            continue
        value = value.cast(f.data_type)
        if f.identity:
            identity, value = name, F.lit(None).cast(base.schema[name].dataType)
        elif f.row_version:
            value = F.lit(1).cast("long")
        elif "w" not in f.access:
            value = F.lit(f.default).cast(f.data_type)
        else:
            if f.kind == "text" and null_text is not None:
                value = F.coalesce(value, F.lit(null_text))
            if not f.nullable:
                value = F.coalesce(value, F.lit(f.default).cast(f.data_type))
            value = fitted(f, value)
        out.append(value.cast(base.schema[name].dataType).alias(name))
    made = rows.select(*out)
    if identity:
        made = _numbered(base, made, identity)
    return made


def _numbered(base: DataFrame, rows: DataFrame, identity: str) -> DataFrame:
    """Gives the rows the numbers that follow the table's greatest.

    The rows are written to the shared folder first, marked with their partition
    and place. Numbers come from the written marks, so a rerun of a lost task
    can't give another, and no task orders the whole batch.
    """
    start = base.agg(F.coalesce(F.max(quoted(identity)), F.lit(0)).alias("_start"))
    marked = rows.withColumn("_m", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_m", 33))
    marked = materialise(marked, "new-rows")
    local = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    counts = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_part", before.alias("_before")))  # one row a partition
    numbered = marked.join(offsets, "_part").crossJoin(F.broadcast(start))
    number = (F.col("_start") + F.col("_before") + local).cast(base.schema[identity].dataType)
    return numbered.withColumn(identity, number).select(*[F.col(quoted(c)) for c in rows.columns])


def insert(base: DataFrame, of: EntityMap, rows: DataFrame, null_text: str | None = None) -> DataFrame:
    """The table with new rows; identity and version columns are made here."""
    return base.unionByName(_new_rows(base, of, rows, null_text))


bulk_insert = insert


def _last_by_key(rows: DataFrame, keys: list[Column], values: list[str], order_by: str | None, first: str | None = None) -> DataFrame:
    """(_k0 ..., _row, _first): one row for each key, with the columns ``values``.

    ``order_by`` is a column that says which of the rows of a key comes last;
    ``_first`` is the column ``first`` of the first of them. Without it a
    repeated key is an error.

    Texts are aggregated by sorting, so rows are dealt out before that: no task
    sorts all that it scans. They are dealt by their order too, so rows of a key
    that is repeated often are reduced in many tasks before they meet.
    """
    names = [f"_k{n}" for n in range(len(keys))]
    row, at = F.struct(*[F.col(quoted(c)) for c in values]), [F.col(quoted(order_by)).alias("_at")] if order_by else []
    keyed = rows.select(*[k.alias(n) for n, k in zip(names, keys, strict=True)], row.alias("_row"), *at)
    grouped = keyed.repartition(*names, *["_at" for _ in at]).groupBy(*names)
    start = F.col(f"_row.{quoted(first)}") if first else F.lit(None)
    if order_by:
        return grouped.agg(F.max_by("_row", "_at").alias("_row"), F.min_by(start, "_at").alias("_first"))
    said = F.concat(F.lit("a key is repeated and nothing orders its rows: "), F.concat_ws(",", *[F.col(n).cast("string") for n in names]))
    one = grouped.agg(F.any_value("_row").alias("_row"), F.count(F.lit(1)).alias("_n"))
    return one.withColumn("_row", F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(said))).drop("_n").withColumn("_first", start)


def bulk_update(base: DataFrame, of: EntityMap, rows: DataFrame, fields: list[str] | None = None, order_by: str | None = None) -> DataFrame:
    """Overwrites fields of the rows that ``rows`` names by key; others stay.

    Where a key is repeated, the last row by the column ``order_by`` counts;
    without it that is an error.
    """
    changed = [of[n] for n in fields] if fields else [f for f in of.fields if f.writable and not f.key and not f.partition and _have(rows, f)]
    keys = of.all_keys
    last = _last_by_key(rows, [F.col(quoted(_have(rows, f))) for f in keys], [_have(rows, f) for f in changed or keys], order_by)
    new = last.select(*[f"_k{n}" for n in range(len(keys))], *[F.col(f"_row.{quoted(_have(rows, f))}").alias(f"_v{n}") for n, f in enumerate(changed)], F.lit(True).alias("_hit"))
    joined = base.join(new, [F.col(quoted(f.source)) == F.col(f"_k{n}") for n, f in enumerate(keys)], "left")
    hit = F.col("_hit").isNotNull()
    made = {f.source: F.when(hit, fitted(f, F.col(f"_v{n}").cast(base.schema[f.source].dataType))).otherwise(F.col(quoted(f.source))) for n, f in enumerate(changed)}
    made |= {f.source: F.when(hit, F.col(quoted(f.source)) + 1).otherwise(F.col(quoted(f.source))) for f in of.fields if f.row_version}
    return joined.withColumns(made).select(*[F.col(quoted(c)) for c in base.columns])


def _have(rows: DataFrame, f: Field) -> str | None:
    names = {c.lower(): c for c in rows.columns}
    return names.get(f.source.lower()) or names.get(f.name.lower())


def _changed(f: Field) -> Column:
    return ~F.col(f"_new.{quoted(f.source)}").eqNullSafe(F.col(f"_orig.{quoted(f.source)}"))


def _criteria(of: EntityMap, criteria: str, base: str) -> Column:
    """Whether a stored row is still what the caller read.

    Only what takes part in the criteria counts: the version, the changed
    fields, or all of them. A field that can't be compared must only be null
    where it was null.
    """
    if criteria not in CRITERIA:
        raise ValueError(f"criteria are one of {', '.join(CRITERIA)}")
    version = next((f for f in of.fields if f.row_version), None)
    if criteria == "key":
        return F.lit(True)
    if criteria == "version":
        if version is None:
            raise MappingError(f"{of.table} has no row version")
        return F.col(f"{base}.{quoted(version.source)}").eqNullSafe(F.col(f"_orig.{quoted(version.source)}"))
    same = F.lit(True)
    for f in of.fields:
        if f.expression or f.row_version or "w" not in f.access:
            continue
        now, read = F.col(f"{base}.{quoted(f.source)}"), F.col(f"_orig.{quoted(f.source)}")
        equal = now.eqNullSafe(read) if f.comparable else now.isNull() == read.isNull()
        same = same & (F.when(_changed(f), equal).otherwise(True) if criteria == "changed" else equal)
    return same


def changes(new: DataFrame, original: DataFrame | None, of: EntityMap, state: str | None = None) -> DataFrame:
    """A batch for ``save``: (_state, _new, _orig).

    Rows pair with their originals by key; a row without one is added, one
    that equals it is unchanged. ``state`` sets the state of all rows instead.
    """
    stored = [f for f in of.fields if not f.expression]
    row = lambda df: F.struct(*[F.col(quoted(_have(df, f))).cast(f.data_type).alias(f.source) for f in stored])
    right = new.select(row(new).alias("_new"))
    if original is None:
        joined = right.withColumn("_orig", F.col("_new") if state in (DELETED, MODIFIED) else F.lit(None).cast(right.schema["_new"].dataType))
    else:
        on = [F.col(f"_new.{quoted(f.source)}").eqNullSafe(F.col(f"_orig.{quoted(f.source)}")) for f in of.all_keys]
        joined = right.join(original.select(row(original).alias("_orig")), on, "left")
    told = F.when(F.col("_orig").isNull(), ADDED).when(F.col("_new").eqNullSafe(F.col("_orig")), UNCHANGED).otherwise(MODIFIED)
    return joined.select((F.lit(state) if state else told).alias("_state"), "_new", "_orig")


def _savable(state: Column) -> Column:
    return F.when(state == DETACHED, F.raise_error("a detached row can't be saved").cast("string")).otherwise(state)


def _names(of: EntityMap) -> list[str]:
    return [f"_k{n}" for n in range(len(of.all_keys))]


def _keyed(of: EntityMap, batch: DataFrame) -> DataFrame:
    """The batch with the key each row is matched by: its original's, or its own if it is added.

    ``_rows`` counts the rows of a key. Keys that the insert makes are null.
    """
    for_state = lambda f: F.when(F.col("_state") == ADDED, F.lit(None) if f.identity else F.col(f"_new.{quoted(f.source)}")).otherwise(F.col(f"_orig.{quoted(f.source)}"))
    keyed = batch.withColumn("_state", _savable(F.col("_state"))).withColumns({f"_k{n}": for_state(f) for n, f in enumerate(of.all_keys)})
    acts = F.count(F.when(F.col("_state").isin(ADDED, MODIFIED, DELETED), 1))
    return keyed.withColumn("_rows", acts.over(Window.partitionBy(*[f"_k{n}" for n in range(len(of.all_keys))])))


def _judged(base: DataFrame, of: EntityMap, batch: DataFrame, criteria: str, select_back: bool, ignore_count: bool) -> DataFrame:
    """The keyed batch with its outcomes. The batch side of every join may be
    small enough to be sent to the table, which is scanned once here."""
    keys = of.all_keys
    if not keys:
        raise MappingError(f"{of.table} has no key")
    names = [f"_k{n}" for n in range(len(keys))]
    keyed = _keyed(of, batch)
    stored = base.select(F.struct(*[F.col(quoted(c)) for c in base.columns]).alias("_base"))
    asked = keyed.filter(F.col("_state").isin(ADDED, MODIFIED, DELETED))
    met = stored.join(asked, [F.col(f"_base.{quoted(f.source)}") == F.col(n) for n, f in zip(names, keys, strict=True)])
    same = F.when(F.col("_state") == DELETED, F.lit(True)).otherwise(_criteria(of, criteria, "_base"))
    hits = met.groupBy(*names).agg(F.count(F.lit(1)).alias("_keys"), F.count(F.when(same, 1)).alias("_hits"))
    joined = keyed.join(hits, names, "left")
    found, hit = F.coalesce("_keys", F.lit(0)), F.coalesce("_hits", F.lit(0))
    made_here = F.lit(all(f.identity for f in keys))
    outcome = (
        F.when((F.col("_state") == ADDED) & made_here, SUCCESS)
        .when(~F.col("_state").isin(ADDED, MODIFIED, DELETED), SKIPPED)
        .when(F.col("_rows") > 1, FAIL)
        .when(F.col("_state") == ADDED, F.when(found == 0, SUCCESS).otherwise(FAIL))
        .when(F.lit(ignore_count) | (hit == 1), SUCCESS)
        .when(F.lit(select_back) & (F.col("_state") == MODIFIED) & (found > 0) & (hit == 0), CONFLICT)
        .otherwise(FAIL)
    )
    return joined.withColumn("outcome", outcome).drop("_keys", "_hits", "_rows")


def outcomes(base: DataFrame, of: EntityMap, batch: DataFrame, criteria: str = "changed", select_back: bool = True, ignore_count: bool = False) -> DataFrame:
    """The batch with the ``outcome`` of each row.

    Success: exactly one stored row was hit, or an added row's key is free.
    Conflict: the key is there but not as it was read, and the caller reads
    back. Fail: anything else that was not as expected; so every row of a key
    that several rows of the batch would write. Skipped: nothing to do. A
    detached row is an error.
    """
    return _judged(base, of, batch, criteria, select_back, ignore_count).drop(*[f"_k{n}" for n in range(len(of.all_keys))])


def outcome_counts(judged: DataFrame) -> DataFrame:
    """(outcome, n): how many rows of a batch went which way."""
    return judged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def _written(base: DataFrame, of: EntityMap, edits: DataFrame, affect: str, alone: bool = False) -> DataFrame:
    """The stored rows after edits (_k0 ..., _state, _new, _orig), one for a key at most: deleted, changed or as they were.

    ``alone`` leaves rows as they were that share their key with other stored
    rows. They are counted where the join has them in order, without a sort.
    """
    keys, hit, made = [F.col(quoted(f.source)) for f in of.all_keys], F.col("_state").isNotNull(), {}
    stored = base
    if alone:
        stored = base.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        hit = hit & (F.col("_same") == 1)
    met = stored.join(edits, [k == F.col(n) for k, n in zip(keys, _names(of), strict=True)], "left")
    met = met.filter(~(hit & (F.col("_state") == DELETED)))
    for f in of.fields:
        if f.expression or f.source not in base.columns:
            continue
        own = F.col(quoted(f.source))
        if f.row_version:
            made[f.source] = F.when(hit, own + 1).otherwise(own)
        elif f.writable and not f.identity:
            take = hit & _changed(f) if affect == "changed" else hit
            made[f.source] = F.when(take, fitted(f, F.col(f"_new.{quoted(f.source)}")).cast(base.schema[f.source].dataType)).otherwise(own)
    return met.withColumns(made).select(*[F.col(quoted(c)) for c in base.columns])


def save(
    base: DataFrame,
    of: EntityMap,
    batch: DataFrame,
    criteria: str = "changed",
    affect: str = "changed",
    select_back: bool = True,
    null_text: str | None = None,
    before_save: Callable[[DataFrame], DataFrame | None] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(next state of the table, outcomes). Deletes come first.

    ``affect`` writes the changed fields only, or all. A changed key is matched
    by its original. Rows that conflict or fail leave the table as it was.
    ``before_save`` sees the batch and may return another, or None to cancel.
    """
    if before_save is not None:
        allowed = before_save(batch)
        if allowed is None:
            return base, batch.withColumn("outcome", F.lit(SKIPPED))
        batch = allowed
    judged, keys = _judged(base, of, batch, criteria, select_back, False), of.all_keys
    names = [f"_k{n}" for n in range(len(keys))]
    edits = judged.filter((F.col("outcome") == SUCCESS) & F.col("_state").isin(MODIFIED, DELETED)).select(*names, "_state", "_new", "_orig")
    kept = _written(base, of, edits, affect)
    added = judged.filter((F.col("outcome") == SUCCESS) & (F.col("_state") == ADDED)).select("_new.*")
    return kept.unionByName(_new_rows(base, of, added, null_text)), judged.drop(*names)


def read_back(state: DataFrame, of: EntityMap, judged: DataFrame, what: str = "all") -> DataFrame:
    """Saved rows as they are stored now, by their keys.

    ``what`` is "all" fields, "made" ones (identity and version) or those that
    the batch left "unchanged" (null where it changed them); keys are always
    there. Rows whose key was made by the insert are found by the new state only.
    """
    saved = judged.filter((F.col("outcome") == SUCCESS) & (F.col("_state") != DELETED)).select("_new", "_orig").distinct()
    met = state.join(saved, [F.col(quoted(f.source)) == F.col(f"_new.{quoted(f.source)}") for f in of.all_keys])
    out = []
    for f in of.readable:
        if f.expression or f.source not in state.columns:
            continue
        value = F.col(quoted(f.source))
        if f.key or f.partition or what == "all" or (f.identity or f.row_version):
            out.append(value.alias(f.name))
        elif what == "unchanged":
            out.append(F.when(~_changed(f), value).alias(f.name))
    return met.select(*out)


def save_table(base: DataFrame, of: EntityMap, rows: DataFrame, order_by: str | None = None) -> DataFrame:
    """Next state from rows with a ``_state``, by key alone.

    Where a key is repeated, the last row by the column ``order_by`` wins: what
    was added and then changed is added as it was last, what was added and then
    deleted was never there. Without the column a repeated key is an error.
    """
    if not of.all_keys:
        raise MappingError(f"{of.table} has no key")
    stored, names = [f for f in of.fields if not f.expression], _names(of)
    own = dict(zip([f.source for f in of.all_keys], names, strict=True))
    at = [F.col(quoted(order_by)).alias("_at")] if order_by else []
    typed = rows.select("_state", *[F.col(quoted(f.source)).cast(f.data_type).alias(f.source) for f in stored], *at)
    made_here = F.lit(all(f.identity for f in of.all_keys)) & (F.col("_state") == ADDED)
    keyed = typed.filter(~made_here)
    values = ["_state", *[f.source for f in stored if f.source not in own]]
    began, ended = F.col("_first"), F.col("_row._state")
    state = F.when((began == ADDED) & (ended == DELETED), UNCHANGED).when((began == ADDED) & (ended == MODIFIED), ADDED).when((began == DELETED) & (ended == ADDED), MODIFIED).otherwise(ended)
    new = F.struct(*[F.col(own.get(f.source) or f"_row.{quoted(f.source)}").alias(f.source) for f in stored])

    def net(part: DataFrame) -> DataFrame:
        last = _last_by_key(part, [F.col(quoted(k)) for k in own], values, "_at" if order_by else None, "_state")
        return last.select(*names, _savable(state).alias("_state"), new.alias("_new"))

    def key_of(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(quoted(k)).alias(n) for k, n in own.items()])

    # Rows with a null key meet no stored row. They go apart, so that edits and
    # additions filter the others alike and are dealt out once.
    whole = reduce(and_, [F.col(quoted(k)).isNotNull() for k in own])
    met, unmet = net(keyed.filter(whole)), net(keyed.filter(~whole))
    kept = _written(base, of, met.filter(F.col("_state").isin(MODIFIED, DELETED)), "all", alone=True)
    added = met.filter(F.col("_state") == ADDED)
    if not any(f.identity for f in of.all_keys):
        added = added.join(key_of(base), names, "left_anti")
    added = added.unionByName(unmet.filter(F.col("_state") == ADDED)).select("_new.*")
    added = added.unionByName(typed.filter(made_here).select(*[F.col(quoted(f.source)) for f in stored]))
    return kept.unionByName(_new_rows(base, of, added, None))
