"""Running numbers over a whole table without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_BUCKETS = 1_000


def order_buckets(rows: DataFrame, key: Column, per_bucket: int = 100_000) -> Column:
    """The number of a row's range of `key`: ascending, each of about `per_bucket` rows; null keys are in the first.

    The bounds come from a sample of some tens of keys a bucket. Rows of one key are never parted. The key may be a struct of
    columns, whose parts are compared one after the other.
    """
    n = rows.count()
    buckets = min(MOST_BUCKETS, n // per_bucket + 1)
    if buckets == 1:
        return F.lit(0)
    sample = rows.select(key.alias("k")).where("k IS NOT NULL").sample(min(1.0, 32 * buckets / n), 11)
    kind = sample.schema["k"].dataType
    found = [r[0] for r in sample.limit(64 * buckets).collect()]
    if kind.typeName() != "struct":
        keys = sorted(found)
        bounds = [F.lit(b) for b in sorted({keys[i * len(keys) // buckets] for i in range(1, buckets)})] if keys else []
    else:
        rank = lambda r: tuple((x is not None, x) for x in r)  # noqa: E731  nulls first, as Spark orders them
        keys = sorted(map(tuple, found), key=rank)
        chosen = sorted({keys[i * len(keys) // buckets] for i in range(1, buckets)}, key=rank) if keys else []
        bounds = [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, kind.fields, strict=True))) for b in chosen]
    return F.coalesce(F.size(F.filter(F.array(*bounds), lambda b: b <= key)), F.lit(0)) if bounds else F.lit(0)


def running_total(rows: DataFrame, key: str, value: str, name: str = "before", per_bucket: int = 100_000) -> DataFrame:
    """rows with a column: the sum of `value` over all rows of lesser `key`, which is unique. One task sees a bucket's rows, or one row a bucket."""
    dealt = rows.withColumn("r_bucket", order_buckets(rows, F.col(key), per_bucket))
    up_to = W.rowsBetween(W.unboundedPreceding, -1)
    sums = dealt.groupBy("r_bucket").agg(F.sum(value).alias("r_sum"))
    sums = sums.select(F.col("r_bucket").alias("r_of"), F.coalesce(F.sum("r_sum").over(up_to.orderBy("r_bucket")), F.lit(0)).alias("r_base"))
    inside = dealt.withColumn(name, F.coalesce(F.sum(value).over(up_to.partitionBy("r_bucket").orderBy(key)), F.lit(0)))
    # there are MOST_BUCKETS sums at most
    return inside.join(F.broadcast(sums), F.col("r_bucket") == F.col("r_of")).withColumn(name, F.col(name) + F.col("r_base")).drop("r_bucket", "r_of", "r_base")
