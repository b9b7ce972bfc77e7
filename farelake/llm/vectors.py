"""Rows with vectors: which take part, numbered rows, blocks of rows that queries meet, and arrays from Arrow.

A vector takes part unless it is null or has a null or non-finite component. Vectors of different lengths are
compared as if the shorter ended in zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from farelake.llm.tables import stored

#: Bytes of a block's components as doubles (bounds a task's memory), and the fewest rows worth a block.
BLOCK_BYTES, LEAST_ROWS = 1 << 25, 1024


def finite(vector: str | Column) -> Column:
    """Not null, and every component is a finite number."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def numbered(rows: DataFrame, what: str) -> DataFrame:
    """The rows, written once, with ``row``: a number of their own, so that equal rows stay apart."""
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), what)


def block_count(rows: DataFrame, vector: str = "vec") -> int:
    """Into how many blocks the rows are dealt: by bytes, but for small tables enough to keep all cores busy."""
    n, longest = rows.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    most = max(1, BLOCK_BYTES // (8 * max(1, longest or 1)))
    return max(1, -(-n // most), min(n // LEAST_ROWS, 2 * rows.sparkSession.sparkContext.defaultParallelism))


def arrays(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix of doubles, short rows filled up with zeros."""
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(n), int(n.max(initial=0))))
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out


def single(table: pa.Table) -> dict[str, pa.Array]:
    """Each column of a table as one array."""
    return {c: pa.concat_arrays(table.column(c).chunks) for c in table.column_names}


def arrow_type(simple: str) -> pa.DataType:
    """The Arrow type of a Spark type's name."""
    return to_arrow_type(T._parse_datatype_string(simple))


def widened(matrix: np.ndarray, width: int) -> np.ndarray:
    """The matrix with just ``width`` columns: zeros added, or cut (where the other side has zeros)."""
    have = matrix.shape[1]
    return matrix[:, :width] if have >= width else np.pad(matrix, ((0, 0), (0, width - have)))


def met(rows: DataFrame, queries: DataFrame, n_blocks: int, open_block: Callable, ask: Callable, schema: str, block: Column | None = None, blocks: Column | None = None) -> DataFrame:
    """Every block of ``rows`` is opened once, in one task, and asked all queries dealt to it, a batch at a time.

    ``rows`` are dealt by ``block`` (by default evenly over all), ``queries`` go to their ``blocks`` (by default to
    each). ``open_block`` makes something of a block's columns; ``ask(opened, batch)`` gives record batches of ``schema``.
    A task holds one block and one batch of queries.
    """
    block = F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int") if block is None else block
    blocks = F.sequence(F.lit(0), F.lit(n_blocks - 1)) if blocks is None else blocks
    of_rows = rows.select(block.alias("_block"), F.lit(False).alias("_asks"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(queries.select(F.struct(*queries.columns).alias("q")).schema["q"].dataType).alias("_query"))
    of_queries = queries.select(F.explode(blocks).alias("_block"), F.lit(True).alias("_asks"), F.lit(None).cast(of_rows.schema["_row"].dataType).alias("_row"), F.struct(*queries.columns).alias("_query"))
    # by ranges, as hashes would put several blocks into one task and none into others
    dealt = of_rows.unionByName(of_queries).repartitionByRange(n_blocks, "_block").sortWithinPartitions("_block", "_asks")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, opened = None, [], None
        for batch in batches:
            of, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            change = np.flatnonzero((of[1:] != of[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *change], [*change, len(of)]):
                if of[a] != now:
                    now, parts, opened = of[a], [], None
                if not asks[a]:
                    parts.append(pa.RecordBatch.from_struct_array(batch.column(2).slice(a, b - a)))
                elif parts:
                    opened = open_block(single(pa.Table.from_batches(parts))) if opened is None else opened
                    yield from ask(opened, pa.RecordBatch.from_struct_array(batch.column(3).slice(a, b - a)))

    return dealt.mapInArrow(work, schema)
