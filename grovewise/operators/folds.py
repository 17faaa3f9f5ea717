"""Folds of the user over any number of rows: a partial state for each partition, merged in two levels.

A fold has no order: `merge` must be associative and commutative, and `init()` must change nothing when merged. Each partition is
folded where it lies, so only states are shuffled, one a partition; a task that is lost is folded again from its own rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Tasks that merge the partitions' states; one more merges theirs.
MERGERS = 64


class Fold(NamedTuple):
    """state: the columns of a state, as DDL; a state is a tuple of their values.

    init() is the state of no rows, update(state, rows) takes in a RecordBatch, merge(a, b) joins two states.
    finish: result columns by name, as SQL expressions over the state's columns."""

    state: str
    init: Callable[[], tuple]
    update: Callable[[tuple, pa.RecordBatch], tuple]
    merge: Callable[[tuple, tuple], tuple]
    finish: dict[str, str]


def fold(rows: DataFrame, by: Fold) -> DataFrame:
    """One row with the columns of `finish`. Of no rows, or no partitions, it is what finish makes of init()."""
    # plain names, so that workers need no class of this package
    state, init, update, merge, finish = by
    kind = StructType.fromDDL(state)
    names, like = kind.names, to_arrow_schema(kind)

    def one(s: tuple, like: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(s, like.types)], schema=like)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = init()
        for b in batches:
            s = update(s, b)
        yield one(s, like)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = init()
        for b in batches:
            for row in b.select(names).to_pylist():
                s = merge(s, tuple(row[c] for c in names))
        yield one(s, like)

    parts = rows.mapInArrow(partial, kind).withColumn("_part", F.spark_partition_id())
    level = parts.repartition(MERGERS, "_part").drop("_part").mapInArrow(merged, kind)
    last = level.repartition(1).mapInArrow(merged, kind)
    return last.select(*(F.expr(e).alias(n) for n, e in finish.items()))
