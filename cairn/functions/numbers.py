"""Column helpers for numbers, dates and arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PADDING, UNSEEN, FIRST_ID = 0, 1, 2
DAY, WEEK = 86_400, 604_800


# Ratios

def laplace_ratio(pos: Column, neg: Column, a: float = 1.0) -> Column:
    return (pos + a) / (pos + neg + 2 * a)


def prior_ratio(pos: Column, total: Column, prior: float = 0.8, weight: float = 10.0) -> Column:
    return (pos + prior * weight) / (total + weight)


def share(part: Column, whole: Column) -> Column:
    """part / whole; null where whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def zscore(c: Column, by: list[Column]) -> Column:
    """Standardised within groups; for whole tables see with_zscore()."""
    w = Window.partitionBy(*by)
    return (c - F.avg(c).over(w)) / F.greatest(F.stddev_pop(c).over(w), F.lit(1e-9))


def with_zscore(df: DataFrame, column: str, out: str) -> DataFrame:
    """Standardised over the whole table: two scalars are broadcast, no row moves."""
    stats = df.agg(F.avg(column).alias("__mean"), F.greatest(F.stddev_pop(column), F.lit(1e-9)).alias("__sd"))
    return df.join(F.broadcast(stats)).withColumn(out, (F.col(column) - F.col("__mean")) / F.col("__sd")).drop("__mean", "__sd")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


# Times; timestamps without a zone are taken as UTC

def seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def monday(ts: Column) -> Column:
    """The first day of the ISO week."""
    return F.date_trunc("week", ts).cast("date")


def iso_week(day: Column) -> Column:
    """Weeks since 1969-12-29, a Monday."""
    return F.floor((F.unix_date(day) + 3) / 7).cast("int")


def week_start(week: Column) -> Column:
    return F.date_from_unix_date(7 * week - 3)


def thursday_week(ts: Column) -> Column:
    """Weeks of 604800 s since the epoch, which began on a Thursday: not ISO weeks."""
    return F.floor(seconds(ts) / WEEK).cast("int")


def is_monday(day: Column) -> Column:
    return F.weekday(day) == 0


def days_between(later: Column, earlier: Column) -> Column:
    """With fractions."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(8.64e10)


def release_date(c: Column, long_months: bool = True) -> Column:
    """`Jan 2, 2020` and `2 Jan, 2020`, and with full month names; null for anything else."""
    forms = ["MMM d, yyyy", "d MMM, yyyy"] + (["MMMM d, yyyy", "d MMMM, yyyy"] if long_months else [])
    return F.coalesce(*[F.try_to_date(c, f) for f in forms])


# Arrays

def clean_array(c: Column) -> Column:
    """Trimmed, without blanks and repeats, in order; null is empty."""
    trimmed = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.btrim(x, F.lit(" \t\r\n")))
    return F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != "")))


def zip_weights(names: Column, weights: Column) -> Column:
    """Structs of name and weight (0 where missing); nameless ones go."""
    pairs = F.zip_with(names, weights, lambda n, w: F.struct(F.nullif(F.btrim(n), F.lit("")).alias("name"), F.coalesce(w.cast("long"), F.lit(0).cast("long")).alias("weight")))
    return F.filter(pairs, lambda p: p["name"].isNotNull())


def sorted_distinct(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(c, lambda x: x.isNotNull())))


def encode(c: Column, ids: Column) -> Column:
    """Elements by a map of ids; unknown ones become UNSEEN."""
    return F.transform(c, lambda x: F.coalesce(F.element_at(ids, x), F.lit(UNSEEN).cast("long")))


def decode(c: Column, names: Column) -> Column:
    """Ids to names; unknown ones go."""
    return F.filter(F.transform(c, lambda x: F.element_at(names, x)), lambda x: x.isNotNull())


def normalised(c: Column) -> Column:
    """Weights that sum to 1: negative, NaN and null count as 0, equal shares if all do."""
    w = F.transform(c, lambda x: F.when(x > 0, F.nanvl(x.cast("double"), F.lit(0.0))).otherwise(0.0))
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    return F.transform(w, lambda x: F.when(total > 0, x / total).otherwise(1.0 / F.size(w)))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, also where f uses it for each element of an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def unit(c: Column) -> Column:
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return let(c, lambda v: let(size(v), lambda n: F.transform(v, lambda x: F.try_divide(x.cast("double"), n))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def jaccard(a: Column, b: Column) -> Column:
    """Null when both are empty."""
    return share(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def bitmask(c: Column) -> Column:
    return F.aggregate(F.array_distinct(c), F.lit(0).cast("long"), lambda m, d: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), d.cast("int"))))


def has_bit(mask: Column, bit: int) -> Column:
    """False for the unknown mask, -1."""
    return (mask >= 0) & (F.shiftright(mask, bit).bitwiseAND(F.lit(1).cast("long")) == 1)


def padded(c: Column, n: int, pad: int = PADDING) -> Column:
    """The first n elements, filled up to n."""
    head = F.slice(c, 1, n)
    return F.concat(head, F.array_repeat(F.lit(pad).cast("long"), n - F.size(head)))


def first_or(c: Column, default: str) -> Column:
    return F.coalesce(F.get(c, F.lit(0)), F.lit(default))


# Samples: arithmetic that any engine repeats

MODULUS, MULTIPLIER = 1_000_003, 2_654_435_761


def draw(c: Column, seed: int = 0) -> Column:
    """A number from 0 to MODULUS - 1 that depends on an id and a seed only."""
    return F.pmod(F.pmod(c.cast("long"), F.lit(MODULUS)) * MULTIPLIER + 97 * seed + 12_345, F.lit(MODULUS)).cast("long")


def sampled(c: Column, fraction: float, seed: int = 0) -> Column:
    return draw(c, seed) < int(fraction * MODULUS)
