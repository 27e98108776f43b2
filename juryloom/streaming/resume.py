"""Scoring of a growing folder of dialogues as a file stream, one resumable batch after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.scoring import Run
from ..sources.corpus import DIALOGUE, dedupe, with_split


def score_stream(spark: SparkSession, run: Run, source: str, max_files: int = 64) -> StreamingQuery:
    """Read new Parquet files of dialogues and score those that are not done yet; ends when all files are read.

    A batch that is run again after a failure is an attempt of its own, in which done dialogues are left out, so each
    dialogue counts once. The stream's checkpoint is kept beside the run.
    """

    def batch(rows: DataFrame, number: int) -> None:
        run.run_once(with_split(dedupe(rows)), number)

    files = spark.readStream.schema(DIALOGUE).option("maxFilesPerTrigger", max_files).parquet(source)
    return files.writeStream.foreachBatch(batch).option("checkpointLocation", f"{run.folder}/stream").trigger(availableNow=True).start()
