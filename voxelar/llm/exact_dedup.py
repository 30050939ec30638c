"""Exact deduplication with a heavy-hitter split.

Frequent digests come from Spark's ``freqItems``, a Misra-Gries style counter with
1 / share slots. Its candidates are counted exactly; those that reach the share are
broadcast (at most 1 / share rows), so their copies are settled on the map side. All
other digests are rare by that guarantee and take an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelar.plans.cut import materialize

from ._common import NULL_ID, ascii_lower, fresh, hot_share, id_of, text_of


def digest(text_col: str = "text") -> Column:
    """SHA-256 (hex) of the text with A-Z lowered; null counts as empty."""
    # Never null: without the coalesce a join on it filters nulls first and digests every text twice.
    return F.coalesce(F.sha2(ascii_lower(text_of(text_col)).cast("binary"), 256), F.lit(""))


def heavy_hitters(rows: DataFrame, key: str, share: float) -> DataFrame:
    """Verified frequent keys: candidates of the counter that make up ``share`` of the rows or more.

    Returns at most 1 / share rows (key, keep, group_size).
    """
    total = rows.count()
    found = rows.stat.freqItems([key], share).select(F.explode(f"{key}_freqItems").alias(key))
    hot = rows.join(F.broadcast(found), key)
    return _settle(hot, key).where(F.col("group_size") >= F.lit(max(2.0, share * total)))


def _settle(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays; a null id is smaller than any
    other. Of rows that repeat both id and text one stays. Null and empty texts form
    one group. Ids are compared as they are stored. An empty table gives an empty result;
    other columns are ignored. A digest is frequent from ``share`` of all rows, by default
    a quarter of what a shuffle partition holds, so that no rarer one burdens a task.
    """
    share = share or hot_share(docs.sparkSession)
    rows = materialize(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            digest(text_col).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    hot = materialize(heavy_hitters(rows, "digest", share), "winners")
    settled = rows.join(F.broadcast(hot), "digest")
    rare = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    rest = rare.join(_settle(rare, "digest"), "digest")
    return settled.unionByName(rest).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("keep.row") == F.col("row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None) -> DataFrame:
    """``docs`` with one row for each distinct normalised text, columns unchanged.

    Of equal texts the row with the largest id stays, a null id being smaller than any
    other; null and empty texts are equal; of rows that repeat id and text one stays. Ids
    are whole numbers, or text or numbers that Spark casts to them. An empty table stays empty.
    """
    key, one = fresh(docs, "_digest"), fresh(docs, "_id")
    kept = exact_dedup(docs, id_col, text_col, share).where("kept")
    kept = kept.select(F.col("text_sha256").alias(key), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias(one))
    # Join and removal of repeated rows go by the same keys, so the texts are shuffled once.
    marked = docs.withColumns({key: digest(text_col), one: id_of(id_col)})
    return marked.join(kept, [key, one], "left_semi").dropDuplicates([key, one]).drop(key, one)
