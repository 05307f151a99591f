"""Windows and sessions over the stream of events.

The stream reads the table's files; a run takes all that is there and ends, and its result is read
from the table it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_dir

#: How late an event may come; windows and sessions older than that leave the state.
LATE = "1 hour"


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def windows(df: DataFrame, late: str = LATE, width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows; rows later than the watermark are left out."""
    g = df.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def user_sessions(df: DataFrame, late: str = LATE, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n): sessions parted by gaps."""
    g = df.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    return g.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run(out: DataFrame, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Run a streaming frame over what its source holds and return the rows it gave.

    In update mode each batch adds the rows that changed, and the last version of each key counts; in
    append mode rows come once, when the watermark has passed them.  No batch rewrites what is written."""
    spark = out.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("append").parquet(f"{path}/rows")

    out.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/log").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{x.name}` {x.dataType.simpleString()}' for x in out.schema)}, _batch bigint").parquet(f"{path}/rows")
    if keys:
        rows = rows.withColumn("_last", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_batch")))).where("_last = 1").drop("_last")
    return rows.drop("_batch")


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows, open ones as far as they go; closed ones leave the state with the watermark."""
    return run(windows(stream(spark, sf_dir)), "update", ("start", "event_type")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows that the watermark has passed."""
    return run(windows(stream(spark, sf_dir))).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions that the watermark has passed."""
    return run(user_sessions(stream(spark, sf_dir)))
