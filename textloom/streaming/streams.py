"""Streaming twins: the same operators on unbounded input.

Row-wise operators are stateless and are reused as they are. Counters keep their state in
the state store; event-time windows are bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import tokenize as T
from textloom.operators.cleaning import native_clean


def documents_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Documents from parquet files as they arrive in a folder; a single file is read as a
    folder of which only that file counts."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        return r.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())
    return r.parquet(folder)


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, text)`` of text files as they arrive."""
    return spark.readStream.option("wholetext", True).text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def clean_stream(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The native cleaning steps; stateless, append mode."""
    return native_clean(docs, text_col)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Running ``(word, n)``; update or complete mode."""
    words = docs.select(F.explode(T.only_words(F.col(text_col))).alias("word"))
    return words.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))


def arrivals(docs: DataFrame, time_col: str = "loaded_at", late: str = "7 days", window: str = "1 day", by: str = "source") -> DataFrame:
    """Documents and characters per window and source; rows later than ``late`` are dropped by
    the watermark, so the state stays bounded."""
    return docs.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("w"), by).agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars")).select(F.col("w.start").alias("start"), by, "n_docs", "n_chars")


def run_once(df: DataFrame, mode: str, folder: str) -> DataFrame:
    """Process what is there and stop. Every batch is written as a table in ``folder``: in complete
    mode a new one in place of the last, else one beside the others."""
    path, checkpoint = f"{folder}/table", f"{folder}/checkpoint"

    def write(batch: DataFrame, n: int) -> None:
        # a batch that is repeated after a failure replaces what it had written
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={n}")

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).option("recursiveFileLookup", True).parquet(path)


def foreach_write(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A stream written to parquet."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).start()
