"""Statistics of a whole corpus for the items of each document, without a row for each occurrence.

A first pass deals documents to blocks, numbers the distinct items of a block and writes, beside the rows of its documents, one row of the block with its
items and how often each occurs. These are counted over all blocks by Spark, so that an item of a third of all
occurrences is one row a block; what is known of an item then goes back to each block that holds it, and meets the block's documents again there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envatlas.llm.shared import column_named


class Numbered(dict):
    """Numbers items in the order in which they first come."""

    def __missing__(self, item: object) -> int:
        self[item] = n = len(self)
        return n


def chunks(batches: Iterator[pa.RecordBatch], where: int, most: int) -> Iterator[tuple[pa.RecordBatch, list[bytes], int]]:
    """(rows, their texts, number of the block): runs of rows of at most `most` bytes, or a single longer text. Null texts are empty.

    Numbers tell the blocks of one job's tasks apart; what reads them must be a saved table, so that no task is run again for it.
    """
    part = TaskContext.get().partitionId()
    n = 0
    for batch in batches:
        texts = [t or b"" for t in batch.column(where).to_pylist()]
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= most):
                size += len(texts[j])
                j += 1
            yield batch.slice(i, j - i), texts[i:j], part << 32 | n
            n += 1
            i = j


def packed(numbers: np.ndarray, kinds: int) -> bytes:
    """Numbers below `kinds`: their low halves, then, where there are more than 2**16 kinds, the rest of each, nearly all of them zeros as frequent items come early."""
    low = numbers.astype(np.uint16).tobytes()
    return low if kinds <= 1 << 16 else low + (numbers >> 16).astype(np.uint8 if kinds <= 1 << 24 else np.uint16).tobytes()


def unpacked(held: bytes, kinds: int) -> np.ndarray:
    if kinds <= 1 << 16:
        return np.frombuffer(held, dtype=np.uint16)
    n = len(held) // (3 if kinds <= 1 << 24 else 4)
    high = np.frombuffer(held, dtype=np.uint8 if kinds <= 1 << 24 else np.uint16, offset=2 * n)
    return np.frombuffer(held, dtype=np.uint16, count=n) | high.astype(np.int64) << 16


def items(saved: DataFrame, block: str, key: str, number: str) -> DataFrame:
    """(block, i, key, n...): the items of each block's own row, from its arrays `key` and `number`."""
    rows = saved.where(F.col(key).isNotNull()).select(F.col(block).alias("block"), F.posexplode(F.arrays_zip(F.col(key).alias("key"), F.col(number).alias("n"))).alias("i", "x"))
    return rows.select("block", "i", "x.key", "x.n")


def met(saved: DataFrame, block: str, back: DataFrame, finish: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    """`finish(rows of a block, what is known of its items)` for each block."""
    name = column_named(saved, "block") if block != "block" else block
    return saved.withColumnRenamed(block, name).groupBy(name).cogroup(back.groupBy("block")).applyInArrow(finish, schema)
