"""Running streams with state to the end of what is there, and reading what they put out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SHARED = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone")


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with a state store that keeps maps and timers; the caller's settings stay."""
    own = spark.newSession()
    for name in _SHARED:
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return own


def table_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of a Parquet table's files, with the schema that they have now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, since a path of a single file is none for streams


def run_available(stream: DataFrame, folder: str, mode: str = "update") -> None:
    """Goes on from the checkpoint in ``folder`` over all that is there, then stops.

    Each batch is written to a folder named by its number, so that one that runs twice, as after
    the loss of the driver, leaves its rows once.
    """

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def put_out(spark: SparkSession, folder: str) -> DataFrame:
    """All rows that ``run_available`` has put out so far, with the number of their ``batch``."""
    return spark.read.parquet(f"{folder}/out")
