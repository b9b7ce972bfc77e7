"""One-hot encoding as tables (E10): a dictionary of categories fitted on training rows, and sparse slots of any rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farelake.session import written_table


def dictionary(train: DataFrame, columns: list[str]) -> DataFrame:
    """(col, value, slot): every value of every column, numbered from 0 by column and value; null has no slot.

    Distinct values are found first, so only the vocabulary is ever numbered."""
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns))))
    values = train.select(pairs.alias("p")).select("p.*").filter("value IS NOT NULL").distinct()
    # slots of a column start after those of the columns before it
    own = values.withColumn("_slot", F.row_number().over(Window.partitionBy("ord").orderBy("value")) - 1)
    sizes = own.groupBy("ord").agg(F.count(F.lit(1)).alias("_n"))  # a row a column
    starts = sizes.select("ord", (F.sum("_n").over(Window.orderBy("ord")) - F.col("_n")).alias("_start"))
    return written_table(own.join(starts, "ord").select("col", "value", (F.col("_start") + F.col("_slot")).cast("int").alias("slot")), "dictionary")


def one_hot(rows: DataFrame, slots: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with ``slots``, the slots set by their values in the order of ``columns``; null and unseen values set none."""

    def coded(df: DataFrame, c: str) -> DataFrame:
        of = slots.filter(F.col("col") == c).select(F.col("value").alias(f"_v_{c}"), F.col("slot").alias(f"_s_{c}"))
        return df.join(of, F.col(c).cast("string") == F.col(f"_v_{c}"), "left")

    out = reduce(coded, columns, rows)
    return out.select(*rows.columns, F.array_compact(F.array(*(F.col(f"_s_{c}") for c in columns))).alias("slots"))
