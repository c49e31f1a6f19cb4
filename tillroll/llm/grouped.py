"""Groups of rows streamed through tasks, one group in memory at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tillroll.llm.common import released


def map_groups(rows: DataFrame, fn: Callable[[str, list[pa.RecordBatch]], Iterator[pa.RecordBatch]],
               schema: str, order: tuple[str, ...]) -> DataFrame:
    """``fn(key, batches)`` for the rows of each value of the string column ``key``, sorted by ``order``.

    The caller bounds the size of a group.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = batch.column("key").to_pylist()
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    if keys[start] != key and held:
                        yield from fn(key, held)
                        held = []
                    key = keys[start]
                    held.append(batch.slice(start, i - start))
                    start = i
        if held:
            yield from fn(key, held)
    return rows.repartition("key").sortWithinPartitions("key", *order).mapInArrow(lambda batches: released(run(batches)), schema)
