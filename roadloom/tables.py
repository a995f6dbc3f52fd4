"""Tables that cut a plan's lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder, so that lost executors cost nothing and plans stay short.

    The folder is the one that the cluster names in spark.checkpoint.dir. A session without one keeps it in its warehouse,
    which all executors share too, or, where driver and executors are one process, in a temporary folder.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        master = spark.sparkContext.master
        one = master == "local" or master.startswith("local[")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="roadloom-") if one else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """df with `name`: its rows' places from 0 in this order (rows alike in it in any order).

    A range sort, places within each partition, and the sums of the partitions before: the counts of partitions, one
    number each, are all that the driver sees, and no task reads all rows.
    """
    from pyspark.sql import functions as F

    own = "_at"
    while own in df.columns:
        own += "_"
    at = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(own, F.monotonically_increasing_id()))
    part = F.shiftright(own, 33).cast("int")
    counts = {r.part: r["count"] for r in at.groupBy(part.alias("part")).count().collect()}
    starts, total = [], 0
    for i in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(i, 0)
    before = F.expr(f"cast(split('{','.join(map(str, starts or [0]))}', ',') as array<bigint>)")
    return at.withColumn(name, F.get(before, part) + F.col(own).bitwiseAND((1 << 33) - 1)).drop(own)
