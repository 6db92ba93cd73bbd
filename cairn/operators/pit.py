"""Point-in-time operators: as-of joins strictly before, histories, events before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(events: DataFrame, features: DataFrame, key: str, event_ts: str, feature_ts: str, values: list[str], slice_seconds: int | None = None) -> DataFrame:
    """events with the values of the feature row of their key as of strictly before their own time; null if there is none. (key, feature_ts) must be unique in features.

    One timeline of events and features, on which the last feature row is carried forward
    with its values, so nothing is joined back; at equal times the event comes first and
    doesn't see that feature. With slice_seconds the timeline of a key is cut into slices
    of time that are windows of their own, and what each begins with is carried from slice
    to slice over one row a slice: a key with a third of all rows is spread over its slices.
    """
    cols = events.columns
    f = features.filter(F.col(key).isNotNull() & F.col(feature_ts).isNotNull()).select(F.col(key).alias("__k"), F.col(feature_ts).alias("__t"), F.lit(1).alias("__o"), F.struct(*values).alias("__f"))
    e = events.select(F.col(key).alias("__k"), F.col(event_ts).alias("__t"), F.lit(0).alias("__o"), F.struct(*cols).alias("__e"))
    line = e.unionByName(f, allowMissingColumns=True)
    upto = lambda *by: Window.partitionBy(*by).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, 0)
    if slice_seconds is None:
        best = F.last("__f", ignorenulls=True).over(upto("__k"))
    else:
        cut = F.floor(F.unix_seconds(F.col("__t").cast("timestamp")) / slice_seconds)
        line = line.withColumn("__s", cut)
        # A row a slice: the last feature of its own, if any, then the last of all slices before.
        slices = line.groupBy("__k", "__s").agg(F.max_by("__f", F.when(F.col("__o") == 1, F.col("__t"))).alias("__last"))
        before = Window.partitionBy("__k").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
        carried = slices.select("__k", "__s", F.last("__last", ignorenulls=True).over(before).alias("__f")).filter("__f IS NOT NULL")
        # It stands before everything else of its slice.
        line = line.unionByName(carried.withColumns({"__o": F.lit(-1), "__t": F.lit(None).cast(line.schema["__t"].dataType)}), allowMissingColumns=True)
        w = Window.partitionBy("__k", "__s").orderBy(F.col("__t").asc_nulls_first(), "__o").rowsBetween(Window.unboundedPreceding, 0)
        best = F.last("__f", ignorenulls=True).over(w)
    found = line.withColumn("__best", F.when(F.col("__k").isNotNull() & F.col("__t").isNotNull(), best)).filter("__o = 0")
    return found.select(*[F.col("__e")[c].alias(c) for c in cols], *[F.col("__best")[c].alias(c) for c in values])


def asof_time(events: DataFrame, features: DataFrame, key: str, event_ts: str, feature_ts: str, out: str = "feature_ts", slice_seconds: int | None = None) -> DataFrame:
    """events with the latest feature time of their key strictly before their own; null if there is none."""
    return asof_join(events, features.select(key, feature_ts, F.col(feature_ts).alias(out)), key, event_ts, feature_ts, [out], slice_seconds)


def asof_candidates(features: DataFrame, events: DataFrame, key: str, event_ts: str, feature_ts: str) -> DataFrame:
    """The features that an as-of join of these events can reach: those since a key's first event, and the latest before it."""
    bounds = events.groupBy(key).agg(F.min(event_ts).alias("__first"))
    joined = features.join(bounds, key)
    since = joined.filter(F.col(feature_ts) >= F.col("__first")).select(features.columns)
    last = joined.filter(F.col(feature_ts) < F.col("__first")).groupBy(key).agg(F.max_by(F.struct(*features.columns), F.col(feature_ts)).alias("__r"))
    return since.unionByName(last.select("__r.*"))


def previous_value(events: DataFrame, by: str, ts: str, value: Column, out: str) -> DataFrame:
    """events with the last non-null value of the same key strictly before; rows of one time don't see each other."""
    w = Window.partitionBy(by).orderBy(F.unix_seconds(F.col(ts).cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    return events.withColumn(out, F.max(F.when(value.isNotNull(), F.struct(F.col(ts), value.alias("v")))).over(w)["v"])


def history(rows: DataFrame, events: DataFrame, by: str, ts: str, item: str, n: int, out: str = "history", tie: str | None = None) -> DataFrame:
    """rows with the last n items of `events` of the same key strictly before, newest first, padded with 0.

    Only n items are carried: each row of the timeline reads the n events before its
    time through their rank, never a key's whole past.
    """
    order = [F.col(ts), *([F.col(tie)] if tie else [])]
    ranked = events.select(F.col(by).alias("__k"), F.col(ts).alias("__et"), F.col(item).cast("long").alias("__i"), F.row_number().over(Window.partitionBy(by).orderBy(*order)).alias("__n"))
    counts = ranked.groupBy("__k", "__et").agg(F.max("__n").alias("__upto"))
    cols = rows.columns
    r = rows.withColumn("__row", F.struct(*cols))
    line = r.select(F.col(by).alias("__k"), F.col(ts).alias("__t"), F.lit(0).alias("__o"), F.lit(None).cast("int").alias("__upto"), "__row")
    line = line.unionByName(counts.select("__k", F.col("__et").alias("__t"), F.lit(1).alias("__o"), "__upto", F.lit(None).cast(r.schema["__row"].dataType).alias("__row")))
    seen = F.coalesce(F.max("__upto").over(Window.partitionBy("__k").orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    placed = line.withColumn("__seen", seen).filter("__o = 0").select("__k", "__seen", "__row")
    # The n items before each rank, once a key and rank.
    back = Window.partitionBy("__k").orderBy("__n").rowsBetween(-(n - 1), 0)
    lists = ranked.select(F.col("__k"), F.col("__n").alias("__seen"), F.reverse(F.collect_list("__i").over(back)).alias("__h"))
    found = placed.join(lists, ["__k", "__seen"], "left")
    h = F.coalesce("__h", F.array().cast("array<bigint>"))
    return found.select("__row.*", F.concat(h, F.array_repeat(F.lit(0).cast("long"), n - F.size(h))).alias(out))


def _line_of_firsts(rows: DataFrame, events: DataFrame, by: str, ts: str, item: str, target: str | None, after: bool) -> tuple[DataFrame, Window]:
    """A timeline of rows (__o = 0) and of each item's first event of a key (its last if after), and the window up to a row; rows come first at equal times."""
    row = F.struct(*rows.columns)
    end = F.max(ts) if after else F.min(ts)
    e = events.select(by, ts, item).dropna().groupBy(F.col(by).alias("__k"), F.col(item).alias("__i")).agg(end.alias("__t"))
    r = rows.filter(F.col(by).isNotNull() & F.col(ts).isNotNull()).select(F.col(by).alias("__k"), F.col(ts).alias("__t"), F.lit(0).alias("__o"), F.lit(None).cast(e.schema["__i"].dataType).alias("__i"), row.alias("__row"), *([F.col(target).alias("__x")] if target else []))
    line = r.unionByName(e.select("__k", "__t", F.lit(1).alias("__o"), "__i"), allowMissingColumns=True)
    return line, Window.partitionBy("__k").orderBy(F.col("__t").desc() if after else F.col("__t"), "__o").rowsBetween(Window.unboundedPreceding, 0)


def events_before(rows: DataFrame, events: DataFrame, by: str, ts: str, item: str, row_id: str, target: str | None = None, after: bool = False, out: str = "items") -> DataFrame:
    """(row_id, sorted distinct items of the key's events strictly before the row, or strictly after), the row's target left out.

    A running list over the first (last) events of a key's items, not a join of its rows
    with its events; only the lists that are returned grow with a key's past.
    """
    line, upto = _line_of_firsts(rows, events, by, ts, item, target, after)
    items = F.collect_list("__i").over(upto)
    seen = line.withColumn("__items", items).filter("__o = 0")
    kept = F.filter("__items", lambda x: x != F.col("__x")) if target else F.col("__items")
    lists = seen.select(F.col("__row")[row_id].alias(row_id), F.sort_array(kept).alias(out))
    untimed = rows.filter(F.col(by).isNull() | F.col(ts).isNull())
    return lists.unionByName(untimed.select(row_id, F.array().cast(lists.schema[out].dataType).alias(out)))


def totals_before(rows: DataFrame, events: DataFrame, by: str, ts: str, item: str, row_id: str, target: str | None = None, after: bool = False) -> DataFrame:
    """(row_id, n, total): number and sum of the items of events_before, by running sums instead of lists."""
    line, upto = _line_of_firsts(rows, events, by, ts, item, target, after)
    seen = line.withColumns({"__n": F.count("__i").over(upto), "__s": F.coalesce(F.sum("__i").over(upto), F.lit(0).cast("long"))}).filter("__o = 0")
    n, s = F.col("__n"), F.col("__s")
    if target:
        # The target's own first event counts where it lies before the row; a null target leaves everything out.
        firsts = events.select(by, ts, item).dropna().groupBy(F.col(by).alias("__ek"), F.col(item).alias("__ei")).agg((F.max(ts) if after else F.min(ts)).alias("__et"))
        seen = seen.join(firsts, (F.col("__k") == F.col("__ek")) & (F.col("__x") == F.col("__ei")), "left")
        own = F.coalesce(F.col("__et") > F.col("__t") if after else F.col("__et") < F.col("__t"), F.lit(False))
        n = F.when(F.col("__x").isNull(), 0).otherwise(n - own.cast("long"))
        s = F.when(F.col("__x").isNull(), 0).otherwise(s - F.when(own, F.col("__x")).otherwise(0))
    totals = seen.select(F.col("__row")[row_id].alias(row_id), n.cast("long").alias("n"), s.cast("long").alias("total"))
    untimed = rows.filter(F.col(by).isNull() | F.col(ts).isNull())
    return totals.unionByName(untimed.select(row_id, F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total")))
