"""Folds over the arrays of one row whose cost follows their length, not its square.

A fold that appends to an array copies it at each step.  Here an array is cut into chunks,
each is folded on its own into a small array, and the small arrays are joined at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textwarden.operators.normalize import let

CHUNK = 128
#: Code points of a piece that a short text is cut from.
PIECE = 1024


def chunks_of(items: Column) -> Column:
    """An array as an array of arrays of CHUNK items."""

    def sliced(xs: Column) -> Column:
        n = F.size(xs)
        begins = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
        return F.transform(begins, lambda b: F.slice(xs, b, F.lit(CHUNK)))

    return let(items, sliced)


def running(values: Column, greatest: bool = False) -> Column:
    """Running sums of an array of int, or running maxima."""
    join = (lambda a, x: F.greatest(a, x)) if greatest else (lambda a, x: a + x)
    zero = F.lit(-(2**31) + 1 if greatest else 0)

    def folded(xs: Column) -> Column:
        step = lambda acc, x: let(join(acc["at"], x), lambda v: F.struct(v.alias("at"), F.concat(acc["out"], F.array(v)).alias("out")))
        return F.aggregate(xs, F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def joined(parts: Column) -> Column:
        bases = F.transform(parts, lambda p: F.element_at(p, -1))
        before = lambda upto, k: F.when(k == 0, zero).otherwise(F.get(upto, k - 1))
        return let(folded(bases), lambda upto: F.flatten(F.transform(parts, lambda p, k: let(before(upto, k), lambda b: F.transform(p, lambda x: join(b, x))))))

    return let(F.transform(chunks_of(values), folded), joined)


def counts_upto(values: Column, points: Column) -> Column:
    """For each of ``points`` how many of ``values`` aren't above it; both arrays of int, in any order."""
    one = lambda at, kind, k: F.struct(at.alias("at"), kind.alias("kind"), k.alias("k"))
    events = F.concat(F.transform(values, lambda v: one(v, F.lit(0), F.lit(-1))), F.transform(points, lambda p, k: one(p, F.lit(1), k)))

    def counted(ordered: Column) -> Column:
        upto = running(F.transform(ordered, lambda e: 1 - e["kind"]))
        placed = F.zip_with(ordered, upto, lambda e, n: F.struct(e["k"].alias("k"), n.alias("n")))
        return F.transform(F.array_sort(F.filter(placed, lambda x: x["k"] >= 0)), lambda x: x["n"])

    nothing = F.transform(points, lambda p: F.lit(0))
    return F.when((F.size(values) == 0) | (F.size(points) == 0), nothing).otherwise(let(F.array_sort(events), counted))


def swept(items: Column, live: Column, out: str, step) -> Column:
    """Folds ordered ``items``: ``step(live, item)`` gives a struct of the new ``live`` array and the array ``out`` of what is settled.

    What is still live at the end comes last.  ``live`` is an empty array of the same
    type, ``out`` that type's name.
    """
    none, nested = F.array().cast(out), F.array().cast(f"array<{out}>")

    def inner(acc: Column, x: Column) -> Column:
        return let(step(acc["live"], x), lambda r: F.struct(r["live"].alias("live"), F.concat(acc["out"], r["out"]).alias("out")))

    def outer(acc: Column, chunk: Column) -> Column:
        part = F.aggregate(chunk, F.struct(acc["live"].alias("live"), none.alias("out")), inner)
        return let(part, lambda r: F.struct(r["live"].alias("live"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))

    start = F.struct(live.cast(out).alias("live"), nested.alias("outs"))
    return F.aggregate(chunks_of(items), start, outer, lambda acc: F.concat(F.flatten(acc["outs"]), acc["live"]))


def touched(spans: Column, scopes: Column) -> Column:
    """Of scopes (start, end, confidence) the greatest confidence that a span touches; null if none is.

    A sweep over span starts and scope ends: a scope is touched if of the spans that begin
    up to its end one reaches its start.
    """
    at = lambda pos, kind, reach, c: F.struct(pos.alias("at"), kind.alias("kind"), reach.alias("reach"), c.alias("c"))
    none = F.lit(None).cast("double")
    events = F.concat(
        F.transform(spans, lambda s: at(s["start"], F.lit(0), s["end"], none)),
        F.transform(scopes, lambda s: at(s["end"], F.lit(1), s["start"], s["confidence"])),
    )

    def surest(ordered: Column) -> Column:
        least = F.lit(-(2**31) + 1)
        far = running(F.transform(ordered, lambda e: F.when(e["kind"] == 0, e["reach"]).otherwise(least)), greatest=True)
        return F.array_max(F.zip_with(ordered, far, lambda e, m: F.when((e["kind"] == 1) & (m >= e["reach"]), e["c"])))

    return F.when((F.size(spans) > 0) & (F.size(scopes) > 0), let(F.array_sort(events), surest))


def pieces_of(text: Column) -> Column:
    """A text as an array of pieces, to cut short texts from without walking the whole one."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(text: Column, pieces: Column, start: Column, n: Column) -> Column:
    """n code points of a text from ``start`` (0 is the first)."""
    k = F.floor(start / PIECE).cast("int")
    near = F.concat(F.get(pieces, k), F.coalesce(F.get(pieces, k + 1), F.lit("")))
    return F.when(n <= PIECE, F.substring(near, start % PIECE + 1, n)).otherwise(F.substring(text, start + 1, n))


def distinct_of(items: Column) -> Column:
    """Sorted items without repetitions, by comparing neighbours."""
    return let(F.array_sort(items), lambda s: F.filter(s, lambda x, k: (k == 0) | (x != F.get(s, k - 1))))
