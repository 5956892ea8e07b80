"""Row numbers over whole tables and large groups, without a task that holds one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.storage import materialize


def numbered(df: DataFrame, order: Sequence[str], name: str, keys: Sequence[str] = ()) -> DataFrame:
    """df with name: row number from 0 within keys, by order, nulls first.

    Ranges of (keys, order) are numbered each on its own and shifted by the rows that earlier ranges have of the key: prefix sums
    over one row a range and key. The ranges are written to the shared folder, so that both uses see the same ones.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    here = Window.partitionBy("_part", *keys).orderBy(*order)
    counts = dealt.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", *keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    joined = dealt.withColumn(name, F.row_number().over(here).cast("long") - 1)
    both = joined.alias("l").join(before.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in ("_part", *keys)])
    return both.select(*[F.col(f"l.{c}") for c in df.columns], (F.col(f"l.{name}") + F.col("r._before")).alias(name))
