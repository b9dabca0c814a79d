"""Registries as tables: upserts, versions, status, history and deletion.

Files do not change in place, so each operator returns the new state of a
table, or the rows to append to it. With a table format that supports MERGE
the same conditions go into its clauses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomkb.storage import materialize


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    ranked = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rn = 1").drop("__rn")


def append_new(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """Rows of ``incoming`` to append: keys not in ``target`` yet, each key once."""
    fresh = incoming.join(target.select(*keys).distinct(), list(keys), "left_anti").select(*incoming.columns)
    return first_of(fresh, keys, order) if order else fresh.dropDuplicates(list(keys))


def merge(target: DataFrame, incoming: DataFrame, keys: Sequence[str], update: Sequence[str] = (), fill: Sequence[str] = ()) -> DataFrame:
    """New state of ``target``: unknown keys are inserted whole.

    Of known keys only the columns in ``update`` take the new value, those in
    ``fill`` only where they were null, and all others keep the old one.
    """
    old, new = target.alias("o"), incoming.alias("n")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"o.{k}") == F.col(f"n.{k}"))
    known, given = F.col(f"o.{keys[0]}").isNotNull(), F.col(f"n.{keys[0]}").isNotNull()

    def value(c: str) -> Column:
        before, after = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keys:
            return F.coalesce(before, after)
        if c in update:
            return F.when(given, after).otherwise(before)
        if c in fill:
            return F.when(known, F.coalesce(before, after)).otherwise(after)
        return F.when(known, before).otherwise(after)

    return old.join(new, same, "full").select(*[value(c).alias(c) for c in target.columns])


def merge_attrs(old: Column, new: Column) -> Column:
    """Union of two maps; the new value wins."""
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, new)


def optimistic_update(target: DataFrame, changes: DataFrame, key: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new state, events, conflicts) of changes that name the version they saw.

    ``changes`` has key, version and the new values (null: unchanged). A change
    of another version than the row's is a conflict and changes nothing. Each
    changed field is an event with its old and new value.
    """
    t, c = target.alias("t"), changes.alias("c")
    both = t.join(c, F.col(f"t.{key}") == F.col(f"c.{key}"))
    conflicts = both.where("t.version <> c.version").select(F.col(f"t.{key}").alias(key), F.col("t.version").alias("version"))
    differs = {f: F.col(f"c.{f}").isNotNull() & ~same_value(F.col(f"t.{f}"), F.col(f"c.{f}"), target.schema[f].dataType.simpleString()) for f in fields}
    fits = F.col("c.version").isNotNull() & (F.col("t.version") == F.col("c.version"))
    any_change = F.lit(False)
    for d in differs.values():
        any_change = any_change | d
    applied = F.coalesce(fits & any_change, F.lit(False))

    def value(name: str) -> Column:
        if name == "version":
            return F.col("t.version") + applied.cast("int")
        if name in fields:
            return F.when(F.coalesce(fits & differs[name], F.lit(False)), F.col(f"c.{name}")).otherwise(F.col(f"t.{name}"))
        return F.col(f"t.{name}")

    state = t.join(c, F.col(f"t.{key}") == F.col(f"c.{key}"), "left").select(*[value(n).alias(n) for n in target.columns])
    changed = F.array_compact(
        F.array(
            *[
                F.when(differs[f], F.struct(F.lit(f).alias("field"), F.col(f"t.{f}").cast("string").alias("old_value"), F.col(f"c.{f}").cast("string").alias("new_value")))
                for f in fields
            ]
        )
    )
    events = both.where("t.version = c.version").select(F.col(f"t.{key}").alias(key), F.explode(changed).alias("e")).select(key, "e.*")
    return state, events, conflicts


def same_value(a: Column, b: Column, kind: str = "string") -> Column:
    """Equality for diffs: numbers within a millionth."""
    if kind in ("double", "float"):
        return F.coalesce(F.abs(a - b) < 1e-6, a.isNull() & b.isNull())
    return a.eqNullSafe(b)


def versions(rows: DataFrame, document: str, version: str) -> DataFrame:
    """``rows`` with status: the latest version of a document is current, the others superseded."""
    later = F.lead(version).over(Window.partitionBy(document).orderBy(version))
    return rows.withColumn("superseded_by", later).withColumn("status", F.when(F.col("superseded_by").isNull(), "current").otherwise("superseded"))


def forget(rows: DataFrame, document: str, version: str, gone: Column) -> DataFrame:
    """Versions left after those in ``gone`` are deleted; the latest one left is current again."""
    return versions(rows.where(~gone), document, version)


def cascade_delete(parent: DataFrame, children: dict[str, DataFrame], key: str, gone: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parent and child tables without the keys in ``gone``."""
    keys = gone.select(key).distinct()
    return parent.join(keys, key, "left_anti"), {name: t.join(keys, key, "left_anti") for name, t in children.items()}


def latest_status(events: DataFrame, key: str, order: Sequence[str], status: str) -> DataFrame:
    """(key, status) after all status events: one partial aggregation, no sort."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias(status))


def numbered(rows: DataFrame, person: str, order: Sequence[str], taken: DataFrame | None = None) -> DataFrame:
    """Consecutive numbers per person, after those in ``taken`` (person, num)."""
    n = F.row_number().over(Window.partitionBy(person).orderBy(*order))
    if taken is None:
        return rows.withColumn("num", n)
    top = taken.groupBy(person).agg(F.max("num").alias("__top"))
    return rows.join(top, person, "left").withColumn("num", n + F.coalesce("__top", F.lit(0))).drop("__top")


def consecutive(rows: DataFrame, order: Sequence[str], name: str, start: Column | int = 0) -> DataFrame:
    """``rows`` with consecutive numbers after ``start`` in ``order``, without a window over all rows.

    Ranges of the order are numbered each by itself, after the counts of the
    ranges before. Ties are numbered in the order of the other columns, as far
    as these have an order.
    """
    ordered = {f.name for f in rows.schema if "map<" not in (kind := f.dataType.simpleString()) and "variant" not in kind}
    by = [*order, *[c for c in rows.columns if c in ordered and c not in order]]
    parts = rows.repartitionByRange(*by).withColumn("__part", F.spark_partition_id())
    parts = materialize(parts, "ranges")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*by))
    # one row for each range
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    first = start if isinstance(start, Column) else F.lit(start)
    numbered = parts.withColumn("__i", inside).join(counts, "__part")
    return numbered.withColumn(name, (first + F.col("__before") + F.col("__i")).cast("long")).drop("__part", "__i", "__before")


def unite(a: Column, b: Column) -> Column:
    """Sorted union of two arrays, each element once; nulls count as empty."""
    empty = F.array()
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty))))


def clean_fields(rows: DataFrame, choices: dict[str, Sequence[str]], texts: Sequence[str] = (), arrays: Sequence[str] = ()) -> DataFrame:
    """Trimmed texts (empty: null), arrays without repeats, and ``error`` naming the first field with a value that is no choice."""
    out = rows.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in texts} | {c: F.array_distinct(c) for c in arrays})
    bad = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*v), F.lit(c)) for c, v in choices.items()]
    return out.withColumn("error", F.coalesce(*bad, F.lit(None).cast("string")))


def running_budget(rows: DataFrame, group: str, order: Sequence[Column], text_col: str, budget: int, least: int = 0) -> DataFrame:
    """``rows`` with ``shown``: their texts cut so that each group stays within ``budget`` characters.

    Characters are spent in ``order``; a row gets what is left, ``least`` at any rate.
    """
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(budget) - F.coalesce(F.sum(F.length(text_col)).over(w), F.lit(0)), F.lit(least)).cast("int")
    return rows.withColumn("__left", left).withColumn("shown", F.substring(F.col(text_col), F.lit(1), F.col("__left"))).drop("__left")
