"""Exact deduplication: groups by a 128-bit content hash, checked byte by byte.

Copies are texts that are equal after lower-casing A-Z (null counts as empty). The
bytes are compared inside a hash group by grouping on the text itself under its hash:
map tasks collapse copies first, so a group of any size reaches a reducer as one row
a task, and texts of one hash that differ stay different classes.

Defined results: null and empty texts form one group; a table without rows gives
none; repeated rows (the same id twice) are members like any other and come back as
often as they came; extra columns are ignored here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Lower case for A-Z only. In a text of ASCII alone that is lower(), which is much the faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", with_sha256: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept [, text_sha256].

    keep: which id of a group stays, "min" (the stable default) or "max". A null id
    sorts last and stays only where a group has no other. Rows that repeat the kept id
    with the same text are all marked kept; the caller's ids are meant to be unique.
    """
    pick = F.min if keep == "min" else F.max
    sides = [F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm")]
    keyed = docs.select(*sides).withColumn("hash", F.unhex(F.md5("norm")))
    classes = keyed.groupBy("hash", "norm").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    sha = [F.sha2("norm", 256).alias("text_sha256")] if with_sha256 else []
    # The text leaves here. Two texts of one hash are told apart by a second hash of 256 bits.
    second = F.unhex(F.sha2("norm", 256)).alias("second")
    members = keyed.select("doc_id", "hash", second)
    out = members.join(classes.select("hash", second, "keep_id", "group_size", *sha), ["hash", "second"])
    return out.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), *[F.col("text_sha256")] * with_sha256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row of docs for each different text: that with the preferred id, a null id only where there is no other. All columns stay, whatever their names.

    One aggregation by hash and text, in which the row of the preferred id is carried:
    rows are shuffled once, after each map task kept one a text, so a group of copies of
    any size reaches its reducer as one row a task. Of rows that repeat both id and text
    one stays; a repeated id with another text is judged by its own text.
    """
    text, norm, id_ = F.col(f"`{text_col}`"), normalised(F.col(f"`{text_col}`")), F.col(f"`{id_col}`")
    # A text that is its own normal form travels once.
    same = text.eqNullSafe(norm)
    carried = [F.when(~same, text) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    row = F.struct(same.alias("same"), *[c.alias(f"c{k}") for k, c in enumerate(carried)])
    if keep == "min":
        best = F.min_by("row", "rank")
        rank = F.struct(id_.isNull(), id_, F.xxhash64(text))
    else:
        best = F.max_by("row", "rank")
        rank = F.struct(id_.isNotNull(), id_, F.xxhash64(text))
    kept = docs.select(F.unhex(F.md5(norm)).alias("hash"), norm.alias("norm"), row.alias("row"), rank.alias("rank")).groupBy("hash", "norm").agg(best.alias("row"))
    back = lambda k, c: F.when(F.col("row.same"), F.col("norm")).otherwise(F.col(f"row.c{k}")) if c == text_col else F.col(f"row.c{k}")
    return kept.select(*[back(k, c).alias(c) for k, c in enumerate(docs.columns)])
