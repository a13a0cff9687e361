"""Declared rules on tables, compiled to one scan for each table and one anti join for each target.

Rules of a row (type, enum, length, pattern, required, required-if) become one array of their broken ones, made in a
single projection; fields may be nested, with ``[]`` for the items of a list: ``rates[].category``. Rules
that need other rows are grouped: all references to one target are exploded together and joined once (Spark may deal the join out over the tables; the
target's keys are then exchanged once and used again), unique keys are counted once for each key. Every rule gives rows (table, row, rule, detail); nothing is collected.

Coercions bring open shapes into declared ones before rules see them: a mapping or a single string where
a list is declared becomes a list of one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


@dataclass(frozen=True)
class Rule:
    """A rule on a field: ``broken`` says of a value whether it breaks the rule (null: it doesn't)."""

    name: str
    path: str
    broken: Callable[[Column], Column]
    when: str | None = None  # SQL condition on the row
    nulls: bool = False  # whether null values are looked at


def required(path: str, when: str | None = None) -> Rule:
    """The value is there and, as text or list, not empty."""
    empty = lambda v: v.isNull() | (F.trim(v.cast("string")) == "")
    return Rule("required" if when is None else "required_if", path, empty, when, nulls=True)


def one_of(path: str, values: tuple, when: str | None = None) -> Rule:
    return Rule("enum", path, lambda v: ~v.isin(*values), when)


def length(path: str, least: int = 0, most: int | None = None, when: str | None = None) -> Rule:
    def broken(v: Column) -> Column:
        n = F.length(v.cast("string"))
        return (n < least) if most is None else (n < least) | (n > most)

    return Rule("length", path, broken, when)


def items(path: str, least: int = 0, most: int | None = None, when: str | None = None) -> Rule:
    return Rule("items", path, lambda v: (F.size(v) < least) if most is None else (F.size(v) < least) | (F.size(v) > most), when)


def pattern(path: str, regex: str, when: str | None = None) -> Rule:
    return Rule("pattern", path, lambda v: ~v.cast("string").rlike(regex), when)


def number(path: str, least: float | None = None, most: float | None = None, when: str | None = None) -> Rule:
    def broken(v: Column) -> Column:
        x = v.try_cast("double")
        bad = x.isNull()
        bad = bad if least is None else bad | (x < least)
        return bad if most is None else bad | (x > most)

    return Rule("number", path, broken, when)


@dataclass(frozen=True)
class Resolve:
    """Every non-null value of the field is a key of the target frame."""

    path: str
    target: str
    key: str
    when: str | None = None


@dataclass(frozen=True)
class Unique:
    """No two rows share the non-null values of the columns."""

    columns: tuple[str, ...]


@dataclass
class Table:
    name: str
    frame: DataFrame
    key: str
    rules: list = field(default_factory=list)


def values_at(frame: DataFrame, path: str) -> Column:
    """The values at a path as an array (one item without ``[]``); items of null lists are none."""
    head, *rest = path.split("[]")
    value = F.col(head.strip("."))
    if not rest:
        return F.array(value)
    out = F.coalesce(value, F.array().cast(kind_at(frame.schema, head.strip("."))))
    for step in rest:
        names = [n for n in step.split(".") if n]
        if names:
            out = field_of(out, names)
        if step is not rest[-1]:
            out = F.flatten(F.filter(out, lambda x: x.isNotNull()))
    return out


def field_of(items_: Column, names: list[str]) -> Column:
    def get(x: Column) -> Column:
        return reduce(lambda v, n: v[n], names, x)

    return F.transform(items_, get)


def kind_at(schema: StructType, path: str):
    kind = schema
    for name in path.split("."):
        kind = (kind.elementType if isinstance(kind, ArrayType) else kind)[name].dataType
    return kind


def row_rules(table: Table) -> DataFrame | None:
    """(table, row, rule, detail) of the rules that a row alone decides: one scan, all rules in one array."""
    rules = [r for r in table.rules if isinstance(r, Rule)]
    if not rules:
        return None
    found = []
    for r in rules:
        hit = F.exists(values_at(table.frame, r.path), looked_at(r))
        if r.when:
            hit = F.coalesce(F.expr(r.when), F.lit(False)) & hit
        found.append(F.when(hit, F.struct(F.lit(r.name).alias("rule"), F.lit(r.path).alias("detail"))))
    each = table.frame.select(F.col(table.key).cast("string").alias("row"), F.explode(F.array_compact(F.array(*found))).alias("r"))
    return each.select(F.lit(table.name).alias("table"), "row", "r.rule", "r.detail")


def looked_at(rule: Rule) -> Callable[[Column], Column]:
    def bad(v: Column) -> Column:
        hit = F.coalesce(rule.broken(v), F.lit(False))
        return hit if rule.nulls else v.isNotNull() & hit

    return bad


def references(tables: list[Table], target: Table, key: str) -> DataFrame | None:
    """(table, row, rule, detail) of values that are no key of the target: the references of all tables in one anti join."""
    asked = []
    for t in tables:
        for r in t.rules:
            if isinstance(r, Resolve) and (r.target, r.key) == (target.name, key):
                rows = t.frame if r.when is None else t.frame.filter(r.when)
                value = F.explode(values_at(t.frame, r.path))
                asked.append(rows.select(F.lit(t.name).alias("table"), F.col(t.key).cast("string").alias("row"), value.alias("__v"), F.lit(r.path).alias("__p")))
    if not asked:
        return None
    every = reduce(DataFrame.unionByName, [a.withColumn("__v", F.col("__v").cast("string")) for a in asked]).filter("__v is not null")
    known = target.frame.select(F.col(key).cast("string").alias("__v")).filter("__v is not null").distinct()
    missing = every.join(known, "__v", "left_anti")
    return missing.select("table", "row", F.lit("resolve").alias("rule"), F.concat("__p", F.lit("="), "__v").alias("detail")).distinct()


def repeated(table: Table, rule: Unique) -> DataFrame:
    """One row for each row that shares its key with another; counts are joined back, not lists gathered."""
    keys = list(rule.columns)
    rows = table.frame.select(F.col(table.key).cast("string").alias("row"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)]).dropna(subset=[f"__k{i}" for i in range(len(keys))])
    names = [f"__k{i}" for i in range(len(keys))]
    twice = rows.groupBy(*names).agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(twice, names).select(F.lit(table.name).alias("table"), "row", F.lit("unique").alias("rule"), F.lit(",".join(keys)).alias("detail"))


def violations(tables: list[Table]) -> DataFrame:
    """All broken rules of all tables."""
    by_name = {t.name: t for t in tables}
    parts = [p for t in tables if (p := row_rules(t)) is not None]
    for target, key in sorted({(r.target, r.key) for t in tables for r in t.rules if isinstance(r, Resolve)}):
        parts.append(references(tables, by_name[target], key))
    parts += [repeated(t, r) for t in tables for r in t.rules if isinstance(r, Unique)]
    return reduce(DataFrame.unionByName, parts)


def as_list(value: Column, kind: str) -> Column:
    """A VARIANT where a list is declared: a list as it is, a mapping or a single value as a list of one, null as none."""
    is_list = F.schema_of_variant(value).startswith("ARRAY")
    many = F.try_variant_get(value, "$", f"array<{kind}>")
    one = F.array(F.try_variant_get(value, "$", kind))
    return F.when(value.isNull() | F.is_variant_null(value), F.array().cast(f"array<{kind}>")).when(is_list, many).otherwise(one)
