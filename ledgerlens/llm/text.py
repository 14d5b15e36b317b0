"""Small text expressions that several operators share; all built in, none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Separators of words, as a Java pattern.
SPACES = r"[\x20\x09-\x0D]+"

#: Type of the arrays that :func:`spans` gives.
SPANS = "array<struct<s:bigint,e:bigint,m:string,c:string>>"

#: Characters before a match that come with it.
CONTEXT = 32


def whole(text: str | Column) -> Column:
    """The text, with null read as empty."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Runs of characters other than the six ASCII separators."""
    return F.array_remove(F.split(text, SPACES, -1), "")


def no_spans() -> Column:
    return F.expr(f"cast(array() AS {SPANS})")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is looked at."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(xs: Column, join, neutral: Column) -> Column:
    """``xs`` with each element joined with all before it, by an associative ``join``.

    Steps of doubled length: after the one of length ``k`` each element covers the ``2 * k`` up to itself. An array of n
    elements takes log n passes, and none appends to an array.
    """
    steps = lambda n: F.filter(F.array(*[F.lit(1 << j) for j in range(31)]), lambda k: k < n)
    return F.aggregate(steps(F.size(xs)), xs, lambda acc, k: F.zip_with(F.concat(F.array_repeat(neutral, k), F.slice(acc, F.lit(1), F.size(acc) - k)), acc, join))


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of ``(s, e, m, c)``, offsets in code points, end exclusive.

    ``c`` is the end of what lies between the match and the one before.

    What lies between the matches gives the offsets: a match ends after all pieces and matches up to it. The time for a
    text grows with its length and with n log n of its matches.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(
        F.split(text, pattern, -1),
        matches,
        lambda gap, m: F.struct(F.length(gap).cast("bigint").alias("g"), F.length(m).cast("bigint").alias("n"), m.alias("m"), F.right(gap, F.lit(CONTEXT)).alias("c")),
    )
    ends = lambda xs: running(F.transform(xs, lambda x: x.g + x.n), lambda a, b: a + b, F.lit(0).cast("bigint"))
    placed = lambda xs: F.zip_with(xs, ends(xs), lambda x, e: F.struct((e - x.n).alias("s"), e.alias("e"), x.m.alias("m"), x.c.alias("c")))
    found = let(F.filter(pieces, lambda x: x.m.isNotNull()), placed)
    return F.when(text.rlike(pattern), found).otherwise(no_spans())


def apart(xs: Column, taken: Column) -> Column:
    """Those of the spans ``xs`` that share no character with a span of ``taken``, in order; both ``(s, e, ...)`` and not empty.

    Both lists are merged by start. Before a span, the farthest end of a taken one tells whether one reaches into it; after
    it, the nearest start of a taken one tells whether it reaches into one.
    """
    none, far = F.lit(-1).cast("bigint"), F.lit(1 << 62).cast("bigint")

    def free(both: Column) -> Column:
        ends = running(F.transform(both, lambda y: F.when(y.x.isNull(), y.e).otherwise(none)), lambda a, b: F.greatest(a, b), none)
        starts = F.reverse(running(F.reverse(F.transform(both, lambda y: F.when(y.x.isNull(), y.s).otherwise(far))), lambda a, b: F.least(a, b), far))
        seen = F.zip_with(F.zip_with(both, ends, lambda y, e: F.struct(y.x.alias("x"), y.s.alias("s"), y.e.alias("e"), e.alias("before"))), starts, lambda y, s: F.struct(y.x.alias("x"), (~y.x.isNull() & (y.before <= y.s) & (s >= y.e)).alias("ok")))
        return F.transform(F.filter(seen, lambda y: y.ok), lambda y: y.x)

    def merged(ours: Column) -> Column:
        mine = F.transform(ours, lambda x: F.struct(x.s.alias("s"), F.lit(1).alias("t"), x.e.alias("e"), x.alias("x")))
        theirs = F.transform(taken, lambda b: F.struct(b.s.alias("s"), F.lit(0).alias("t"), b.e.alias("e"), F.when(F.lit(False), F.get(ours, F.lit(0))).alias("x")))
        return F.when(F.size(ours) > 0, let(F.array_sort(F.concat(theirs, mine)), free)).otherwise(ours)

    return let(xs, merged)


def labelled(found: Column, kind: str) -> Column:
    """Spans as text: array of ``kind:start:end``."""
    return F.transform(found, lambda x: F.concat(F.lit(kind + ":"), x.s.cast("string"), F.lit(":"), x.e.cast("string")))
