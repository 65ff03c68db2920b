"""Incremental reading and stateful operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from time import monotonic, sleep

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.operators.suggest import normalise
from tidewell.session import checkpoint

#: The folder name, and column, of a drained stream's batch numbers.
BATCH = "tidewell_batch"


def records_since(records: DataFrame, watermark: DataFrame | None, time: str = "mtime", base: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What is new after a watermark table (column `seen`), and the watermark after it."""
    rows = records if base is None else records.where(F.col("base") == base)
    if watermark is not None:
        rows = rows.join(F.broadcast(watermark.agg(F.max("seen").alias("_seen"))), F.col(time) > F.coalesce("_seen", F.lit(-(2**62)))).drop("_seen")
    if limit is not None:
        rows = rows.orderBy(time).limit(limit)
    return rows, rows.agg(F.max(time).alias("seen"))


def read_table_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A growing folder of Parquet files as a stream; progress is kept in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drop_repeats(stream: DataFrame, keys: list[str], time: str | None = None, within: str | None = None) -> DataFrame:
    """The first row of each key.  With an event time and a span, state older than it is let go."""
    if time and within:
        return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


SUGGESTION = "normalized string, query string, hits bigint, count bigint, deleted boolean"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    query, hits, count = state.get if state.exists else (None, 0, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for q, h in zip(rows["query"], rows["hits"], strict=True):
        query, hits, count = (q, h, 0) if h == 0 else (q, h, count + 1)
    if hits == 0:
        state.remove() if state.exists else None
    else:
        state.update((query, int(hits), int(count)))
    yield pd.DataFrame([(key[0], query, int(hits), int(count), hits == 0)], columns=["normalized", "query", "hits", "count", "deleted"])


def suggestion_stream(log: DataFrame) -> DataFrame:
    """Suggestion counters kept as state: one row for each query that a batch touches, with its new values.

    log: query, hits, ts, event_id; no hits delete the query.
    """
    keyed = log.withColumn("normalized", normalise("query"))
    return keyed.groupBy("normalized").applyInPandasWithState(_fold, SUGGESTION, "query string, hits bigint, count bigint", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, place: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over all that is there and gives what it wrote to a shared folder, a batch to each subfolder.

    update: the last row of each key; complete: the rows of the last batch.  A batch that runs again overwrites its own.
    """
    spark, rows_at = stream.sparkSession, f"{place}/rows"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{rows_at}/{BATCH}=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows_at}/{BATCH}={number}")

    started = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).start()
    started.awaitTermination()
    rows = spark.read.parquet(rows_at)
    if mode == "complete":
        last = rows.agg(F.max(BATCH)).first()[0]
        rows = rows.where(F.col(BATCH) == F.lit(last))
    elif mode == "update":
        names = stream.columns
        rows = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(F.struct(*names), BATCH).alias("_row")).select("_row.*")
        return rows
    return rows.drop(BATCH)


class RecordReader:
    """Reads a table's records in the order of (time, key), in steps, and remembers how far it came.

    The mark of what was read is one row of Parquet in the shared folder `progress`; without it, or with
    from_scratch, reading begins with the first record.  `records` gives the table as it is at a step.
    """

    def __init__(self, records: Callable[[], DataFrame], progress: str, base: str | None = None, time: str = "mtime", key: str = "id", from_scratch: bool = False):
        self.records, self.progress, self.base, self.time, self.key = records, progress, base, time, key
        self.step = 0
        self.mark: tuple | None = None if from_scratch else self._stored()

    def _stored(self) -> tuple | None:
        spark = self.records().sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.progress)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return None
        row = spark.read.parquet(self.progress).orderBy(F.desc("step")).first()
        if row is None:
            return None
        self.step = row["step"]
        return row["time"], row["key"]

    def next(self, most: int | None = None) -> DataFrame:
        """The records after the mark, at most so many; the mark moves when they are committed."""
        rows = self.records()
        if self.base is not None:
            rows = rows.where(F.col("base") == self.base)
        if self.mark is not None:
            at, last = map(F.lit, self.mark)
            rows = rows.where((F.col(self.time) > at) | ((F.col(self.time) == at) & (F.col(self.key) > last)))
        return rows if most is None else rows.orderBy(self.time, self.key).limit(most)

    def commit(self, rows: DataFrame) -> bool:
        """Remembers the last of the rows; False if there are none."""
        last = rows.agg(F.max(F.struct(F.col(self.time).alias("time"), F.col(self.key).alias("key"))).alias("x")).select("x.*").first()
        if last["time"] is None:
            return False
        self.step += 1
        self.mark = (last["time"], last["key"])
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        marked = rows.sparkSession.createDataFrame([(self.step, *self.mark)], f"step bigint, time {kinds[self.time]}, key {kinds[self.key]}")
        marked.coalesce(1).write.mode("append").parquet(self.progress)
        return True

    def run(self, handle: Callable[[DataFrame], None], most: int | None = None, seconds: float | None = None, follow: bool = False, pause: float = 1.0, total: int | None = None) -> int:
        """Steps of at most `most` records through handle, until none are left; the number of records handled.

        follow: waits for more instead.  No step begins after so many seconds, and none goes beyond `total` records.
        """
        until, done = (None if seconds is None else monotonic() + seconds), 0
        while (until is None or monotonic() < until) and (total is None or done < total):
            room = [n for n in (most, None if total is None else total - done) if n is not None]
            rows = checkpoint(self.next(min(room) if room else None))
            count = rows.count()
            if count:
                handle(rows)
                self.commit(rows)
                done += count
            elif follow:
                sleep(pause)
            else:
                break
        return done


def changed_bases(records: DataFrame, seen: dict[str, int], time: str = "mtime") -> list[str]:
    """Bases with changes after the times seen: one row per base is looked at."""
    latest = records.groupBy("base").agg(F.max(time).alias("t")).collect()
    return sorted(r["base"] for r in latest if r["t"] is not None and r["t"] > seen.get(r["base"], -1))


def windowed_counts(stream: DataFrame, time: str, span: str, late: str, *keys: str) -> DataFrame:
    """Counts per window and key, with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, span), *keys).agg(F.count(F.lit(1)).alias("count"))
