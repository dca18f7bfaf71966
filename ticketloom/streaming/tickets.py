"""The ticket pipeline on a stream of exported rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ticketloom.operators.tickets import clean_tickets
from ticketloom.sources.sinks import append_new


def ticket_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def cleaned_stream(rows: DataFrame, watermark: str = "30 days") -> DataFrame:
    """Cleaned tickets, each export of an issue once: repeats within the watermark of exported_at are dropped."""
    return clean_tickets(rows.withWatermark("exported_at", watermark).dropDuplicatesWithinWatermark(["issue_id", "status", "exported_at"]))


def daily_counts(rows: DataFrame, watermark: str = "30 days") -> DataFrame:
    """Exports a day and language, closed when the watermark has passed."""
    day = F.window("exported_at", "1 day")
    return rows.withWatermark("exported_at", watermark).groupBy(day.alias("day"), "ticket_language").agg(F.count("*").alias("n")).select("day.start", "ticket_language", "n")


def append_to_collection(rows: DataFrame, path: str, checkpoint: str, id_col: str = "issue_id") -> StreamingQuery:
    """Adds new ids to a collection micro-batch by micro-batch; a batch that is run again adds nothing twice."""

    def write(batch: DataFrame, _: int) -> None:
        append_new(batch.dropDuplicates([id_col]), path, id_col)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
