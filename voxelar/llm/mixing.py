"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed into cells of source, language and topic. Rounds scale the
cells so that each marginal in turn meets its targets, where no cell may give more
tokens than it has: cells at that cap are held there, so what they cannot give goes to
the others of the same marginal. A probability is then the fitted tokens
over those of the cell, never above one, and the expected sample has the marginals that
were fitted. The work after the first aggregation depends on the number of cells.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxelar.plans.cut import broadcast_if_small, materialize

from ._common import SPACE, fresh, text_of, uniform

DIMENSIONS = ("source", "lang", "topic")
#: Rounds between two looks at the marginals, and how often they are looked at.
ROUNDS = 8
BLOCKS = 8
#: Rounds end when every marginal is met to this part of the kept tokens.
TOLERANCE = 1e-5
#: Targets are shares raised to this power and rescaled: below one favours rare values.
POWER = 0.7
#: Expected share of all tokens that is kept.
KEEP = 0.8
#: A block of rounds that leaves more than this part of the distance shows that goals contradict each other.
STALLED = 0.9
#: Cells that one task scales; more are dealt over the cluster.
CELL_ROWS = 20_000
#: The largest part of a value's tokens that a target may ask for. Without room below one, cells of
#: two dimensions that both want everything leave nothing to balance with.
CEILING = 0.9
SEED = "mix"
DIGITS = 6


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, SPACE), "")).cast("long")


def topic_of(tokens: Column) -> Column:
    """A coarse topic, for tables that have none: the register a text's length suggests."""
    return F.when(tokens < 100, "note").when(tokens < 1000, "article").otherwise("longform")


def tempered_targets(cells: DataFrame, dimension: str, power: float = POWER) -> DataFrame:
    """``(dimension, target)``: the shares of its values, flattened by ``power``; they sum to one."""
    totals = cells.groupBy(dimension).agg(F.sum("tokens").alias("tokens"))
    raw = F.pow(F.col("tokens").cast("double"), F.lit(power))
    scale = totals.agg(F.sum(raw).alias("all"))
    return totals.crossJoin(F.broadcast(scale)).select(
        dimension, F.coalesce(F.try_divide(raw, F.col("all")), F.lit(0.0)).alias("target")
    )


def filled(rows: DataFrame, wanted: str, order: str) -> DataFrame:
    """``rows(pull, cap)``, one per value of a dimension, with ``pull`` scaled until least(pull, cap) sums to ``wanted``.

    With rows in falling order of cap over pull, each prefix left uncapped gives a scale; the right
    one is the greatest of them. Rows that cannot give so much are capped throughout.
    """
    whole = W.partitionBy(F.lit(0))
    upto = whole.orderBy(F.try_divide("cap", "pull").desc_nulls_first(), order).rowsBetween(W.unboundedPreceding, W.currentRow)
    capped = F.sum("cap").over(whole) - F.sum("cap").over(upto)
    rows = rows.withColumn("_scale", F.try_divide(F.col(wanted) - capped, F.sum("pull").over(upto)))
    return rows.withColumn("pull", F.col("pull") * F.greatest(F.lit(0.0), F.max("_scale").over(whole))).drop("_scale")


def scaled(goal: str, by: str) -> Column:
    """The new ``pull`` after one step towards ``goal`` in every value of ``by``.

    Cells at their cap stay there and the others share the rest; where that leaves nothing to
    share, all are scaled, capped ones too.
    """
    each, full = W.partitionBy(by), F.col("pull") >= F.col("cap")
    left = F.col(goal) - F.sum(F.when(full, F.col("cap")).otherwise(0.0)).over(each)
    free = F.sum(F.when(full, 0.0).otherwise(F.col("pull"))).over(each)
    step = F.when((free > 0) & (left > 0), left / free).otherwise(F.try_divide(goal, F.sum("pull").over(each)))
    return F.col("pull") * F.coalesce(step, F.lit(0.0))


def attainable(cells: DataFrame, target: DataFrame, dimension: str, keep: float = KEEP, ceiling: float = CEILING) -> DataFrame:
    """``(dimension, target, has, goal)``: tokens each value is to give, ``keep`` of all tokens in total.

    In proportion to the targets, but no more than ``ceiling`` of what a value has; what it
    lacks is spread over the others. A value without a target gives nothing.
    """
    has = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("has"))
    everything = has.agg((keep * F.sum("has")).alias("all"))
    most = max(ceiling, (1 + keep) / 2) if keep >= ceiling else ceiling
    asked = has.join(broadcast_if_small(target), dimension, "left").select(dimension, "has", F.coalesce("target", F.lit(0.0)).alias("target"))
    asked = asked.crossJoin(F.broadcast(everything)).withColumns({"pull": F.col("target"), "cap": most * F.col("has")})
    return filled(asked, "all", dimension).select(dimension, "target", "has", F.least("pull", "cap").alias("goal"))


def rake(cells: DataFrame, goals: dict[str, DataFrame], rounds: int = ROUNDS, blocks: int = BLOCKS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with ``kept``, at most ``tokens``, whose marginals meet ``goal`` of ``goals``.

    Stops at the tolerance, when a block of rounds brings nothing, or after ``blocks`` of them;
    ``marginals`` shows what was reached. Goals that no choice of tokens can meet together leave a
    rest there.
    """
    fitted = cells.withColumns({"cap": F.col("tokens").cast("double"), "pull": F.col("tokens").cast("double")})
    for dimension, goal in goals.items():
        fitted = fitted.join(broadcast_if_small(goal.select(dimension, F.col("goal").alias(f"to_{dimension}"))), dimension)
    small = cells.limit(CELL_ROWS + 1).count() <= CELL_ROWS
    before = None
    for _ in range(blocks):
        if small:
            fitted = fitted.coalesce(1)  # scaled in one task, without an exchange a step
        for _ in range(rounds):
            for dimension in goals:
                fitted = fitted.withColumn("pull", scaled(f"to_{dimension}", dimension))
        fitted = materialize(fitted, "raked")
        kept = F.least("pull", "cap")
        sums = [fitted.groupBy(d).agg(F.sum(kept).alias("kept"), F.first(f"to_{d}").alias("goal")) for d in goals]
        off = functools.reduce(DataFrame.unionByName, [x.select("kept", "goal") for x in sums])
        worst = off.agg(F.try_divide(F.max(F.abs(F.col("kept") - F.col("goal"))), F.sum("goal") / len(goals)).alias("worst")).first()[0]
        if worst is None or worst <= tolerance or before is not None and worst > STALLED * before:
            break
        before = worst
    return fitted.select(*cells.columns, F.least("pull", "cap").alias("kept"))


def marginals(cells: DataFrame, goals: dict[str, DataFrame]) -> DataFrame:
    """``(dimension, value, target, goal, reached, available)`` as shares, from ``cells`` with ``tokens`` and ``kept``.

    ``goal`` differs from ``target`` where a value has too few tokens for it, and ``reached`` from
    ``goal`` where goals cannot be met together.
    """
    total = cells.agg(F.sum("kept").alias("all_kept"), F.sum("tokens").alias("all_tokens"))
    parts = []
    for d, goal in goals.items():
        sums = cells.groupBy(d).agg(F.sum("kept").alias("kept"), F.sum("tokens").alias("tokens")).join(goal, d)
        sums = sums.withColumn("all_goal", F.sum("goal").over(W.partitionBy(F.lit(0))))
        shares = [F.try_divide(a, b) for a, b in (("goal", "all_goal"), ("kept", "all_kept"), ("tokens", "all_tokens"))]
        named = zip(shares, ("goal", "reached", "available"), strict=True)
        parts.append(sums.crossJoin(F.broadcast(total)).select(F.lit(d).alias("dimension"), F.col(d).alias("value"), "target", *[c.alias(n) for c, n in named]))
    return functools.reduce(DataFrame.unionByName, parts)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None) -> DataFrame:
    """``(id, source, lang, topic, tokens)`` per row; nulls in a dimension count as empty strings."""
    counted = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")],
        (F.coalesce(F.col(f"`{topic_col}`").cast("string"), F.lit("")) if topic_col else F.lit(None).cast("string")).alias("topic"),
        n_words(text_of(text_col)).alias("tokens"),
    )
    return counted if topic_col else counted.withColumn("topic", topic_of(F.col("tokens")))


def fitted_cells(counts: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Cells with ``tokens`` and ``kept``, and the goals of every dimension."""
    cells = materialize(counts.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    targets = targets or {d: tempered_targets(cells, d) for d in DIMENSIONS}
    goals = {d: materialize(attainable(cells, t, d, keep), "goals") for d, t in targets.items()}
    return rake(cells, goals), goals


def probabilities(counts: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP) -> DataFrame:
    """Per cell its ``weight`` in the expected sample and the ``probability`` to keep its documents."""
    fitted, _ = fitted_cells(counts, targets, keep)
    everything = fitted.agg(F.sum("kept").alias("all_kept"))
    return fitted.crossJoin(F.broadcast(everything)).select(
        *DIMENSIONS,
        F.round(F.coalesce(F.try_divide("kept", "all_kept"), F.lit(0.0)), DIGITS).alias("weight"),
        F.round(F.when(F.col("tokens") > 0, F.col("kept") / F.col("tokens")).otherwise(1.0), DIGITS).alias("probability"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    topic_col: str | None = None,
    targets: dict[str, DataFrame] | None = None,
    keep: float = KEEP,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: ``doc_id, source, lang, topic, tokens, weight, probability, selected``.

    ``selected`` compares a repeatable number drawn from the id with the probability,
    so repeated rows and rows with equal ids share it; a null id draws as the empty
    string. A null source or language is the empty string, a null text has no words.
    Documents without words are in no one's way and always selected. ``targets`` has
    ``(dimension, target)`` per dimension. An empty table gives an empty result.
    """
    counts = materialize(token_counts(docs, id_col, text_col, topic_col), "counts")
    cells = broadcast_if_small(materialize(probabilities(counts, targets, keep), "probabilities"))
    drawn = uniform(seed, F.coalesce(F.col("id").cast("string"), F.lit("")))
    return counts.join(cells, list(DIMENSIONS)).select(
        F.col("id").alias("doc_id"), *DIMENSIONS, "tokens", "weight", "probability", (drawn < F.col("probability")).alias("selected")
    )


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, seed: str = SEED) -> DataFrame:
    """``docs`` with the rows that ``mix`` selects, columns unchanged.

    Nulls, repeated rows and texts without words are as there. An empty table stays empty.
    """
    counts = materialize(token_counts(docs, id_col, text_col), "counts")
    cells = materialize(probabilities(counts, keep=keep), "probabilities")
    names = {d: fresh(docs, f"_{d}") for d in (*DIMENSIONS, "probability", "tokens")}
    cells = cells.select(*[F.col(d).alias(names[d]) for d in (*DIMENSIONS, "probability")])
    marked = docs.withColumns(
        {names[c]: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("source", "lang")}
        | {names["tokens"]: n_words(text_of(text_col))}
    )
    marked = marked.withColumn(names["topic"], topic_of(F.col(names["tokens"])))
    drawn = uniform(seed, F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    joined = marked.join(broadcast_if_small(cells), [names[d] for d in DIMENSIONS])
    return joined.where(drawn < F.col(names["probability"])).drop(*names.values())
