"""Python functions on whole groups without a call per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Sorted batches cut anew so that none ends inside a group; a batch's last group waits for the next."""
    keys, held = list(keys), None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        last = rows[keys].ne(rows[keys].shift()).any(axis=1).to_numpy().nonzero()[0][-1]
        held = rows.iloc[last:]
        if last:
            yield rows.iloc[:last]
    if held is not None and len(held):
        yield held


def map_whole_groups(df: DataFrame, by: Sequence[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """Apply ``f`` to batches of ``df`` that never cut a group of ``by`` in two.

    Rows are shuffled and sorted by group; a batch's last group waits for the next
    batch. Memory is that of a batch and a group, and small groups share one call.
    """
    keys = list(by)

    def run(batches):
        for rows in whole_groups(batches, keys):
            yield f(rows)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
