"""Ranking metrics, correlations, concentration and promotion gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.ordering import running_sum


def single_target(df: DataFrame, position: str, ks: list[int], by: list[str] | None = None) -> DataFrame:
    """recall@k, NDCG@k and MRR@k with one relevant item: position counts from 0 and is null or negative where the target is absent."""
    p = F.when(F.col(position) >= 0, F.col(position))
    out = []
    for k in ks:
        hit = F.coalesce(p < k, F.lit(False))
        out += [F.round(F.avg(hit.cast("double")), 6).alias(f"recall_{k}"), F.round(F.avg(F.when(hit, 1 / F.log2(p + 2)).otherwise(0.0)), 6).alias(f"ndcg_{k}"), F.round(F.avg(F.when(hit, 1 / (p + 1)).otherwise(0.0)), 6).alias(f"mrr_{k}")]
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *out)


def list_metrics(df: DataFrame, group: str, rank: str, relevant: str, n_relevant: str, k: int) -> DataFrame:
    """Means over groups of precision@k (by k), recall@k (by the lesser of k and the relevant items) and average precision@k.

    One row per listed item with its rank from 1; groups whose n_relevant is 0 don't count.
    """
    top = df.filter((F.col(rank) <= k) & (F.col(n_relevant) > 0))
    hits = F.sum(F.col(relevant).cast("int")).over(Window.partitionBy(group).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    per = top.withColumn("__h", hits).groupBy(group).agg(F.sum(F.col(relevant).cast("int")).alias("__n"), F.max(n_relevant).alias("__r"), F.sum(F.when(F.col(relevant), F.col("__h") / F.col(rank)).otherwise(0.0)).alias("__ap"))
    cap = F.least(F.lit(k), F.col("__r"))
    return per.agg(F.count(F.lit(1)).alias("groups"), F.round(F.avg(F.col("__n") / k), 6).alias("precision"), F.round(F.avg(F.col("__n") / cap), 6).alias("recall"), F.round(F.avg(F.col("__ap") / cap), 6).alias("map"))


def group_auc(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """(groups, auc): the mean of the groups' AUC, ties half; groups without both labels and null scores don't count. Pairs aren't made: a group's scores are counted and ranked."""
    per = df.filter(F.col(score).isNotNull()).groupBy(group, score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    auc = per.withColumn("w", F.col("p") * (below + F.col("n") / 2)).groupBy(group).agg((F.sum("w") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"))
    return auc.agg(F.count("auc").alias("groups"), F.round(F.avg("auc"), 6).alias("auc"))


def activity_buckets(rows: DataFrame, user: str, rank: str, activity: str, percentiles: list[int], k: int) -> DataFrame:
    """bucket, least, most, n, users, recall_k, user_hits (share of users with a hit), user_recall (their mean), by the activity of users: `new` without any, then between percentiles of the others (the value at the lower index). Empty buckets are left out.

    Edges come from counts of the different activities, not from sorted users.
    """
    per = rows.filter(F.col(activity) > 0).groupBy(F.col(activity).alias("a")).agg(F.countDistinct(user).alias("c"))
    run = running_sum(per, [F.col("a")], ["c"])
    total = per.agg(F.sum("c").alias("t"))
    at = lambda q: F.floor(F.lit(q / 100) * (F.col("t") - 1))
    edges = run.join(F.broadcast(total)).agg(*[F.max(F.when(F.col("c_before") <= at(q), F.col("a"))).alias(f"e{q}") for q in percentiles])
    bounds = [0, *percentiles, 100]
    name = F.when(F.col(activity) == 0, "new")
    for a, b in zip(bounds, bounds[1:], strict=False):
        name = name.when(F.col(activity) <= F.col(f"e{b}"), f"p{a}-{b}") if b < 100 else name.otherwise(f"p{a}-{b}")
    b = rows.join(F.broadcast(edges)).withColumns({"bucket": name, "hit": (F.col(rank) < k).cast("double")})
    each = b.groupBy("bucket", user).agg(F.avg("hit").alias("h")).groupBy("bucket").agg(F.count(F.lit(1)).alias("users"), F.round(F.avg((F.col("h") > 0).cast("double")), 6).alias("user_hits"), F.round(F.avg("h"), 6).alias("user_recall"))
    return b.groupBy("bucket").agg(F.min(activity).alias("least"), F.max(activity).alias("most"), F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias(f"recall_{k}")).join(each, "bucket")


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(auc): of all rows at once, by counts of each score and running sums over ranges of scores."""
    per = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))
    r = running_sum(per, [F.col("s")], ["n"])
    return r.agg(F.round(F.try_divide(F.sum(F.col("p") * (F.col("n_before") + F.col("n") / 2)), F.sum("p").cast("double") * F.sum("n")), 6).alias("auc"))


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    per = df.groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("c"))
    r = running_sum(per, [F.col("__v")], ["c"]).select("__v", (F.col("c_before") + (F.col("c") + 1) / 2).alias(out))
    return df.join(r, df[column] == r["__v"]).drop("__v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.select(a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return average_ranks(average_ranks(both, a, "ra"), b, "rb").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("ra", "rb"), 6).alias("spearman"))


def gini(df: DataFrame, value: str) -> DataFrame:
    """(gini) of non-negative values; null if they sum to 0."""
    per = df.groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    r = running_sum(per, [F.col("v")], ["c"])
    n, total = F.sum("c"), F.sum(F.col("v") * F.col("c"))
    # The ranks of c equal values sum to c * (before + (c + 1) / 2).
    return r.agg(F.round(F.try_divide(2 * F.sum(F.col("v") * F.col("c") * (F.col("c_before") + (F.col("c") + 1) / 2)) - (n + 1) * total, n * total), 6).alias("gini"))


def concentration(lists: DataFrame, user: str, item: str, top: int = 10) -> DataFrame:
    """How much lists agree: users, distinct items, the reach of the commonest item, and the share of the `top` commonest among all places."""
    counts = lists.groupBy(item).agg(F.countDistinct(user).alias("reach"), F.count(F.lit(1)).alias("n"))
    users = lists.agg(F.countDistinct(user).alias("users"), F.count(F.lit(1)).alias("places"))
    best = counts.orderBy(F.col("n").desc(), F.col(item)).limit(top).agg(F.sum("n").alias("head"), F.max("reach").alias("reach"))
    return counts.agg(F.count(F.lit(1)).alias("distinct_items")).join(F.broadcast(users)).join(F.broadcast(best)).select("users", "distinct_items", F.round(F.col("reach") / F.col("users"), 6).alias("top_reach"), F.round(F.col("head") / F.col("places"), 6).alias("head_share"))


def entropy(df: DataFrame, by: str, label: str) -> DataFrame:
    """Per key: n, the commonest label and its share, the entropy of labels in bits and 2 to its power."""
    c = df.groupBy(by, label).agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c").over(Window.partitionBy(by))
    p = c.withColumn("p", F.col("c") / total)
    e = p.groupBy(by).agg(F.sum("c").alias("n"), F.min_by(label, F.struct(-F.col("c"), F.col(label))).alias("top"), F.round(F.max("p"), 6).alias("top_share"), (-F.sum(F.col("p") * F.log2("p"))).alias("e"))
    return e.select(by, "n", "top", "top_share", F.round("e", 6).alias("entropy"), F.round(F.pow(F.lit(2.0), F.col("e")), 6).alias("effective"))


def share_of(n: Column, d: Column) -> Column:
    return F.try_divide(n.cast("double"), d.cast("double"))
