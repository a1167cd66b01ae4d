"""The job log as a stream: dense sequence numbers and latest states per job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT_SCHEMA = "job_id long, event_id long, ts timestamp_ntz, event_type string, status string, attrs map<string,string>"
_ORDER = ["ts", "event_id"]


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Events as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def emitted(events: DataFrame) -> DataFrame:
    """Events as the log keeps them: attributes without nulls, and none without a sink (a null job)."""
    kept = F.map_filter("attrs", lambda k, v: v.isNotNull())
    return events.where(F.col("job_id").isNotNull()).withColumn("attrs", F.coalesce(kept, F.create_map().cast("map<string,string>")))


def sequenced(events: DataFrame) -> DataFrame:
    """job_id, seq, event_id, status: seq goes on per job from one micro-batch to the next.

    Inside a micro-batch events are numbered by (ts, event_id); a late event gets the next free number, since numbers
    already handed out never change. State is one counter per job.
    """

    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(_ORDER)
        state.update((start + len(rows),))
        yield pd.DataFrame({"job_id": key[0], "seq": range(start, start + len(rows)), "event_id": rows["event_id"].to_numpy(), "status": rows["status"].to_numpy()})

    return events.groupBy("job_id").applyInPandasWithState(number, "job_id long, seq long, event_id long, status string", "next long", "append", GroupStateTimeout.NoTimeout)


def latest(events: DataFrame) -> DataFrame:
    """job_id and its state by the last event, as an update stream."""
    state = F.when(F.col("status") == "error", "error").when(F.col("status") == "end", "done").otherwise("running")
    return events.groupBy("job_id").agg(F.max_by(state, F.struct(*_ORDER)).alias("status"), F.count("*").alias("n_events"))
