"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelar.plans.cut import materialize

#: White space between words, and the words themselves (fixed by the data contracts).
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id wherever rows must be ordered or joined by id: nulls sort first.
NULL_ID = -(2**63)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(name: str) -> Column:
    """The text column with nulls as empty strings."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def id_of(name: str) -> Column:
    """The id as a long, a null as the least one. Ids must be whole numbers or cast to them; others are Spark's cast error."""
    return F.coalesce(F.col(f"`{name}`").cast("long"), F.lit(NULL_ID))


def id_back(name: str) -> Column:
    """Undo ``id_of``."""
    return F.when(F.col(name) != NULL_ID, F.col(name))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def uniform(seed: str, *keys: Column) -> Column:
    """A repeatable number in [0, 1) from the first 52 bits of an MD5 digest."""
    text = F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key is hot from this part of all rows; more partitions make less rows hot, down to the least part.
HOT_SHARE, LEAST_SHARE = 1e-3, 1e-5


def hot_share(spark: SparkSession) -> float:
    """A quarter of a shuffle partition's even share, within the bounds; at most 1 / LEAST_SHARE keys can reach it."""
    return max(LEAST_SHARE, min(HOT_SHARE, 0.25 / int(spark.conf.get("spark.sql.shuffle.partitions"))))


def join_hot(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key``, unique in ``right``, where few keys may hold many rows of ``left``.

    Rows of ``right`` for the hot keys, at most 1 / share of them, are broadcast; all other keys shuffle.
    """
    least = max(2.0, hot_share(left.sparkSession) * left.count())
    often = left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key)
    hot = materialize(right.join(F.broadcast(often), key), "hot")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right, key)
    return left.join(F.broadcast(hot), key).unionByName(rest)


def vocabulary(name: str) -> str:
    """Path of a public rank file; ``VOXELAR_TOKENIZERS`` may name another folder."""
    if folder := os.environ.get("VOXELAR_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
