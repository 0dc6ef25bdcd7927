"""Running totals over a whole sorted table, without a task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colprism.session import stable


def running_total(df: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each row in ``order``.

    The sort cuts the rows into ranges of about equal size; each range sums
    its own rows, and the sums of earlier ranges, one number per partition,
    are added on.
    """
    ordered = stable(df.withColumn("_value", value).orderBy(*order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ordered.groupBy("_part").agg(F.sum("_value").alias("_sum"))
              .select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start")))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (ordered.join(F.broadcast(starts), "_part")
            .withColumn(out, F.col("_start") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
            .drop("_part", "_start", "_value"))
