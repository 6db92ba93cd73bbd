"""Queries that train or evaluate models: rows without an SQL oracle, but for the tree evaluator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import models
from cairn.plans import models as M
from cairn.plans.registry import query
from cairn.sources.tables import read


@query("tree_scores", "V21 V22 V20", """
SELECT p_partkey, CASE WHEN p_size <= 20 THEN CASE WHEN p_retailprice <= 1200 THEN 1.0 ELSE 2.0 END ELSE 3.0 END + CASE WHEN p_retailprice <= 1500 THEN 0.25 ELSE 0.5 END AS score FROM part""")
def tree_scores(spark: SparkSession, d: str) -> DataFrame:
    t = models.Trees(feature=[0, 1, -1, -1, -1, 1, -1, -1], threshold=[20, 1200, 0, 0, 0, 1500, 0, 0], left=[1, 2, 0, 0, 0, 6, 0, 0], right=[4, 3, 0, 0, 0, 7, 0, 0], value=[0, 0, 1, 2, 3, 0, 0.25, 0.5], roots=[0, 5], default_left=[True] * 8)
    p = read(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return t.score(p, ["p_size", "p_retailprice"]).select("p_partkey", "score")


@query("tag_clusters", "V32")
def tag_clusters(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), (F.col("p_retailprice") / 100).alias("p"))
    return models.mapped(models.clusters(p, ["s", "p"], 5), ["s", "p"]).select("p_partkey", "cluster", "x", "y")


@query("implicit_item_vectors", "")
def implicit_item_vectors(spark: SparkSession, d: str) -> DataFrame:
    return models.item_vectors(M.ledger(spark, d).filter("is_positive"), "user_id", "game_id", 8)


@query("ranker_importances", "V20 V34")
def ranker_importances(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select((F.col("o_orderstatus") == "F").cast("double").alias("label"), F.col("o_totalprice"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double").alias("t"))
    _, share = models.ranker(o, ["o_totalprice", "t"], "label", trees=5, depth=3)
    auc = models.cross_validated_auc(o, ["o_totalprice", "t"], "label", folds=5)
    return spark.createDataFrame([(k, float(v), float(auc)) for k, v in share.items()], "feature string, importance double, auc double")


@query("text_embeddings", "V30")
def text_embeddings(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return models.text_vectors(p, "text", 4, 256).select("p_partkey", "vector")
