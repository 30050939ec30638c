"""Hard-negative mining with exact integer scores from a residue-number system.

Spark deals anchors and rows into blocks and brings every anchor block together with every
row block. A task holds one pair of blocks: it multiplies their component matrices modulo
several small primes in float32, where every partial sum stays below 2^24 and so is exact,
and rebuilds the signed scores by Chinese remaindering. It keeps the best few rows of each
anchor; windows over all blocks then pick the final ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxelar.plans.cut import materialize

#: Anchors of a block, components and rows of a row block, and anchors multiplied at once in a task.
ANCHORS, CELLS, ROWS, CHUNK = 4096, 1 << 20, 1 << 14, 128
#: Scores stay below this, so that a hundredfold score fits a long.
SCORE_LIMIT = 2.0**52
#: Whole numbers below this are exact in float32.
EXACT = 1 << 24
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: Small primes, largest first; the residues of 64 components multiply exactly at once.
PRIMES = [p for p in range(1023, 2, -1) if all(p % k for k in range(2, int(p**0.5) + 1))]


def moduli(a: np.ndarray, b: np.ndarray) -> list[int]:
    """As many primes as the largest possible score of two matrices asks for, by Cauchy and Schwarz.

    Raises ValueError where scores might reach ``SCORE_LIMIT``.
    """
    longest = [np.sqrt(np.square(m.astype(np.float64)).sum(axis=1).max(initial=0.0)) for m in (a, b)]
    bound = longest[0] * longest[1] * (1 + 1e-9) + 1
    if not bound < SCORE_LIMIT:
        raise ValueError(f"scores may reach {bound:.3g}; the limit is {SCORE_LIMIT:.3g}")
    used, span = [PRIMES[0]], PRIMES[0]
    while span <= 2 * bound:
        used.append(PRIMES[len(used)])
        span *= used[-1]
    return used


def residues(m: np.ndarray, p: int) -> np.ndarray:
    """Residues around zero, as float32."""
    half = p // 2
    return ((m + half) % p - half).astype(np.float32)


def times(left: np.ndarray, right: np.ndarray, p: int) -> np.ndarray:
    """``left @ right.T`` modulo ``p``: float32 products of as many components as stay exact."""
    step = (EXACT - 1) // (p // 2) ** 2
    total = np.zeros((len(left), len(right)), np.int32)
    for at in range(0, left.shape[1], step):
        total += (left[:, at : at + step] @ right[:, at : at + step].T).astype(np.int32)
        total %= p
    return total


def combine(parts: list[np.ndarray], used: list[int]) -> np.ndarray:
    """The signed numbers with the given residues, a mixed-radix digit for each prime."""
    value, span = parts[0].astype(np.int64), used[0]
    for part, p in zip(parts[1:], used[1:], strict=True):
        value += span * ((part - value % p) * pow(span, -1, p) % p)
        span *= p
    return np.where(value > span // 2, value - span, value)


def scores(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of ``a @ b.T`` for int64 matrices, a few at once, each with the number of the first."""
    used = moduli(a, b)
    right = [residues(b, p) for p in used]
    for at in range(0, len(a), CHUNK):
        left = a[at : at + CHUNK]
        yield at, combine([times(residues(left, p), r, p) for p, r in zip(used, right, strict=True)], used)


def components(table: pa.Table, scale: int) -> np.ndarray:
    """The vectors of a block, scaled and floored, as an int64 matrix."""
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) and not np.abs(flat).max() * scale < SCORE_LIMIT:
        raise ValueError(f"a component times {scale} reaches {SCORE_LIMIT:.3g}")
    return np.floor(scale * flat).astype(np.int64).reshape(table.num_rows, len(flat) // max(1, table.num_rows))


def best(score: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores where ``among`` holds; ties in the order of places."""
    at = np.flatnonzero(among)
    if len(at) > k:
        at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
    return at[np.argsort(-score[at], kind="stable")[:k]]


def usable(df: DataFrame, id_col: str, vector_col: str, label: Column, is_anchor: Column) -> DataFrame:
    """``id, label, vector, size, is_anchor`` of the rows that take part."""
    names = {"id": F.col(f"`{id_col}`").cast("long"), "label": label.cast("long"), "vector": F.col(f"`{vector_col}`"), "is_anchor": is_anchor}
    rows = df.select(*[c.alias(name) for name, c in names.items()])
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & whole).withColumn("size", F.size("vector"))


def _each(count: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))


def in_blocks(anchors: DataFrame, rows: DataFrame, f: Callable, schema: str) -> DataFrame:
    """``f(anchor block, row block)`` for every pair of blocks of vectors of equal size.

    A row block has about ``CELLS`` components or ``ROWS`` rows and an anchor block ``ANCHORS`` vectors, so
    a task's memory does not grow with the tables; there are several pairs a partition.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    tall = max(1, -(-anchors.count() // ANCHORS))
    wide = max(-(-cells // CELLS), -(-count // ROWS), -(-3 * tasks // tall))
    keys = ["size", "tall", "wide"]
    left = anchors.withColumn("tall", F.pmod("anchor", F.lit(tall))).withColumn("wide", _each(wide))
    right = rows.withColumn("wide", F.pmod("row", F.lit(wide))).withColumn("tall", _each(tall))
    pairs = [x.repartition(min(tall * wide, tasks), *keys).groupBy(*keys) for x in (left, right)]
    return pairs[0].cogroup(pairs[1]).applyInArrow(f, schema)


_POSITIVE = "anchor long, positive_id long, positive_score long"
_NEGATIVE = "anchor long, anchor_id long, positive int, positive_id long, positive_score long, negative_id long, negative_score long"


def _positives(count: int, scale: int) -> Callable:
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids, labels = (rows.column(c).to_numpy() for c in ("id", "label"))
        names, own, kind = (anchors.column(c).to_numpy() for c in ("anchor", "id", "label"))
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] * 3]
        if anchors.num_rows and rows.num_rows:
            for at, part in scores(components(anchors, scale), components(rows, scale)):
                for i, score in enumerate(part, at):
                    found = best(score, (labels == kind[i]) & (ids != own[i]), count)
                    out.append([np.full(len(found), names[i]), ids[found], score[found]])
        return pa.table([np.concatenate(x) for x in zip(*out, strict=True)], ["anchor", "positive_id", "positive_score"])

    return run


def _negatives(count: int, scale: int, low: int, high: int) -> Callable:
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids, labels = (rows.column(c).to_numpy() for c in ("id", "label"))
        names, own, kind = (anchors.column(c).to_numpy() for c in ("anchor", "id", "label"))
        wanted = anchors.column("positives").to_pylist()
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] * 7]
        if anchors.num_rows and rows.num_rows:
            for at, part in scores(components(anchors, scale), components(rows, scale)):
                for i, score in enumerate(part, at):
                    other = labels != kind[i]
                    for n, p in enumerate(wanted[i]):
                        least, most = low * p["positive_score"], high * p["positive_score"]
                        found = best(score, other & (100 * score >= least) & (100 * score <= most), count)
                        same = [np.full(len(found), x) for x in (names[i], own[i], n, p["positive_id"], p["positive_score"])]
                        out.append([*same, ids[found], score[found]])
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        columns[2] = columns[2].astype(np.int32)
        return pa.table(columns, [x.split()[0] for x in _NEGATIVE.split(", ")])

    return run


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    label: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, all exact.

    A score is the inner product of vectors whose components are multiplied by ``scale`` and
    floored. An anchor's positives are its best ``positives`` rows of equal label and another
    id; for each, the best ``negatives`` rows of another label are returned that score
    between ``low`` and ``high`` percent of the positive. Ties go by smaller id.

    Rows with a null id, label or vector, or any null or non-finite component, take no part;
    vectors are compared with those of equal size only, empty ones score zero. Anchors that
    repeat wholly count once; other rows count as often as they are there, also under one
    id. Anchors without positives, and positives without rows between the bounds (all
    negative ones), return nothing, and so does an empty table. Other columns are ignored.
    A score that might reach ``SCORE_LIMIT`` is an error.
    """
    rows = usable(df, id_col, vector_col, label, is_anchor).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "vectors")
    anchors = rows.where("is_anchor").select("id", "label", "vector", "size").distinct()
    anchors = materialize(anchors.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    rows = rows.select("id", "label", "vector", "size", "row")

    found = in_blocks(anchors, rows, _positives(positives, scale), _POSITIVE)
    best_first = W.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("n", F.row_number().over(best_first)).where(F.col("n") <= positives)
    lists = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("n", "positive_id", "positive_score"))).alias("positives"))
    wanted = materialize(anchors.join(lists, "anchor"), "positives")

    found = in_blocks(wanted, rows, _negatives(negatives, scale, low, high), _NEGATIVE)
    best_first = W.partitionBy("anchor", "positive").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
