"""SNK4 and resume for inputs that keep arriving: micro-batches of new files through a stage, appended once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators.dedup import first_wins, unseen
from ..sources.jsonl import exists
from ..sources.scratch import table


def dedup_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, text: str, order: tuple[str, ...], stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Reads new JSON files of `source`, applies the stage, and appends rows whose uid (of `text`) is new, first wins by `order`.

    Uids are kept beside the output, in folders by their first two digits; a batch reads those of its own uids' folders only.  File
    progress is in the checkpoint.  A batch that is run again writes to the same folders, so nothing is doubled.
    """
    keys = f"{target}.keys"

    def append(batch: DataFrame, batch_id: int) -> None:
        rows = table(stage(batch).withColumn("uid", T.uid16(F.col(text))).withColumn("_head", F.substring("uid", 1, 2)), "batch")
        heads = [r[0] for r in rows.select("_head").distinct().collect()]  # 256 at most
        if exists(spark, keys):
            seen = spark.read.schema("uid string, batch long, head string").parquet(keys).where((F.col("batch") != batch_id) & F.col("head").isin(heads))
            rows = unseen(rows, seen)
        new = table(first_wins(rows, "uid", *order), "new")
        new.drop("_head").write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        fresh = new.select("uid", F.col("_head").alias("head"))
        fresh.repartition("head").write.mode("overwrite").partitionBy("head").parquet(f"{keys}/batch={batch_id}")

    return spark.readStream.schema(schema).json(source).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
