"""Streams: monthly means with a watermark, dry runs carried over batches, and a ledger of files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_means(stream: DataFrame, time: str, keys: list[str], value: str, width: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """(start, keys, mean, n, var): mergeable statistics per window; rows later than ``lateness`` are left out."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    return rows.groupBy(F.window(time, width), *keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.var_pop(value).alias("var")).select(F.col("window.start").alias("start"), *keys, "mean", "n", "var")


def dry_runs(stream: DataFrame, key: str, day: str, dry: str) -> DataFrame:
    """(key, day, run): the number of dry days up to each row's day, carried over batches.

    State per key: the last day (days since 1970) and its run. Days of a key must come in order over batches; a
    day that is absent breaks the run, an earlier day than the last is left out.
    """
    rows = stream.select(F.col(key).cast("string").alias("key"), F.unix_date(F.col(day).cast("date")).cast("int").alias("day"), F.col(dry).cast("boolean").alias("dry"))

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, run = state.get if state.exists else (None, 0)
        batch = pd.concat(list(parts)).sort_values("day").drop_duplicates("day")
        if last is not None:
            batch = batch[batch["day"] > last]
        if len(batch):
            day, is_dry = batch["day"].to_numpy(), batch["dry"].fillna(False).to_numpy(bool)
            follows = np.diff(day, prepend=day[0] - 1 if last is None else last) == 1
            # a run starts anew after a wet or an absent day; carried: the run that the first days go on with
            new = ~follows | ~np.concatenate(([True], is_dry[:-1]))
            at = np.arange(len(day))
            start = np.maximum.accumulate(np.where(new, at, -1))
            length = np.where(is_dry, at - np.maximum(start, 0) + 1 + np.where(start < 0, run, 0), 0)
            last, run = int(day[-1]), int(length[-1])
            state.update((last, run))
            yield pd.DataFrame({"key": k[0], "day": day, "run": length})

    return rows.groupBy("key").applyInPandasWithState(step, "key string, day int, run int", "last int, run int", "append", GroupStateTimeout.NoTimeout)


def ledger(spark: SparkSession, source: str, schema, store: str, checkpoint: str, transform=lambda df: df):
    """Process each new file of a folder once; a restart goes on where the checkpoint stands."""
    stream = spark.readStream.schema(schema).parquet(source)
    return transform(stream).writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
