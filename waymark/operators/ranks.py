"""Places in a total order, without a task that sees every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import cut

#: monotonically_increasing_id() has the partition above these bits and the row's place in it below.
PLACE_BITS = 33


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with each row's number in the order, from 1, as column `name`.

    Rows are dealt out by ranges of the order, sorted in their partition and written once; a
    partition's rows count on from the sizes of those before it. Rows that the order cannot tell
    apart get different numbers, in any order, and lie in one partition: give an order that is
    nearly unique. An empty df stays empty.
    """
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", PLACE_BITS)
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))  # a row for each partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__ahead"))
    place = F.col("__at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    found = dealt.withColumn("__part", part).join(F.broadcast(ahead), "__part")
    return found.select(*df.columns, (F.col("__ahead") + place + 1).alias(name))
