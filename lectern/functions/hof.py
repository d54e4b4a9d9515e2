"""Small building blocks over array columns: binding, segmenting, packing, counting."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

STRINGS = "array<string>"


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_array(values: Sequence[str]) -> str:
    return f"cast(array({', '.join(map(sql_string, values))}) as {STRINGS})"


def lits(values: Sequence[str]) -> Column:
    """Literal array of strings (empty allowed), one expression whatever its length."""
    return F.expr(sql_array(values))


def lit_map(table) -> Column:
    """Literal map of strings."""
    return F.expr("map(" + ", ".join(sql_string(x) for kv in table.items() for x in kv) + ")")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    Catalyst may inline a projected expression into every lambda that mentions it;
    binding it as a lambda variable keeps one evaluation.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def any_contains(text: Column, phrases: Sequence[str]) -> Column:
    """True when any phrase is a substring."""
    return F.exists(lits(phrases), lambda p: text.contains(p))


def any_startswith(text: Column, phrases: Sequence[str]) -> Column:
    return F.exists(lits(phrases), lambda p: text.startswith(p))


def one_of(value: Column, values: Sequence[str]) -> Column:
    """Membership in a short literal list."""
    return F.array_contains(lits(values), value)


def indices(arr: Column) -> Column:
    """1..size, empty for an empty array."""
    return F.when(F.size(arr) > 0, F.sequence(F.lit(1), F.size(arr))).otherwise(
        F.array().cast("array<int>"))


def slices_from(arr: Column, starts: Column) -> Column:
    """Cut ``arr`` at the 1-based ``starts``; elements before the first start are left out."""
    return F.transform(
        starts,
        lambda s, j: F.slice(
            arr, s,
            F.coalesce(F.try_element_at(starts, j + 2), F.size(arr) + 1) - s))


def pack(arr: Column, size_of: Callable[[Column], Column], limit, join_cost: int = 0,
         min_close: int = 0) -> Column:
    """Greedy packing of an ordered string array into groups.

    A group is closed when it is not empty, adding the next element (plus ``join_cost``)
    would pass ``limit`` and the group already holds ``min_close``.
    """
    empty = F.array().cast(STRINGS)
    zero = F.struct(
        F.array().cast("array<array<string>>").alias("done"), empty.alias("cur"), F.lit(0).alias("n"))

    def step(acc, x):
        size = size_of(x).cast("int")
        projected = acc["n"] + size + F.when(F.size(acc["cur"]) > 0, F.lit(join_cost)).otherwise(F.lit(0))
        close = (F.size(acc["cur"]) > 0) & (projected > limit) & (acc["n"] >= min_close)
        return F.when(close, F.struct(
            F.concat(acc["done"], F.array(acc["cur"])).alias("done"),
            F.array(x).alias("cur"), size.alias("n"))
        ).otherwise(F.struct(
            acc["done"].alias("done"), F.concat(acc["cur"], F.array(x)).alias("cur"),
            projected.alias("n")))

    return F.aggregate(arr, zero, step, lambda a: F.when(
        F.size(a["cur"]) > 0, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))


def term_frequencies(tokens: Column) -> Column:
    """array<struct<term, tf>> of a token array, sorted by term, without a shuffle."""
    def runs(s):
        starts = F.filter(indices(s), lambda i: (i == 1) | (
            F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        return let(starts, lambda st: F.transform(st, lambda p, j: F.struct(
            F.element_at(s, p).alias("term"),
            (F.coalesce(F.try_element_at(st, j + 2), F.size(s) + 1) - p).alias("tf"))))
    return let(F.sort_array(tokens), runs)


def replace_matches(text: Column, pattern: str, fn: Callable[[Column], Column]) -> Column:
    """Replace every regex match by ``fn(match)``, left to right, like a callback substitution."""
    return let(text, lambda t: F.array_join(F.transform(
        F.arrays_zip(F.split(t, pattern, -1).alias("gap"),
                     F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("hit")),
        lambda z: F.concat(z["gap"], F.coalesce(fn(z["hit"]), F.lit("")))), ""))
