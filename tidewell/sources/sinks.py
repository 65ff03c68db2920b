"""Writing records: tables by base, dumps, XML, and index documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_records(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A Parquet table partitioned by base; a large base is spread over files by id."""
    records.repartition("base", F.pmod(F.xxhash64("id"), F.lit(16))).write.mode(mode).partitionBy("base").parquet(path)


def write_batches(stream: DataFrame, path: str, checkpoint: str, merge) -> object:
    """A stream of records merged into a table, batch by batch: merge(stored or None, batch) gives the new rows.

    Each batch writes a new version folder by its number, so a batch that runs again overwrites its own.
    """
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = spark.read.parquet(f"{path}/v{number - 1}") if number else None
        merge(stored, batch).write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(run).start()


def dump(records: DataFrame, path: str, base: str | None = None, pattern: str | None = None, most: int | None = None) -> None:
    """Records whose base and id match, at most so many, as JSON lines."""
    if base:
        records = records.where(F.col("base").rlike(base))
    if pattern:
        records = records.where(F.col("id").cast("string").rlike(pattern))
    if most is not None:
        records = records.orderBy("id").limit(most)
    records.write.mode("overwrite").json(path)


def as_xml(record: Column | str, tag: str = "record") -> Column:
    """A struct column as XML."""
    return F.to_xml(record, {"rowTag": tag})


#: What a record table has.
RECORD_COLUMNS = ("id", "base", "deleted", "indexable", "content")


def validated(records: DataFrame, columns: tuple[str, ...] = RECORD_COLUMNS) -> DataFrame:
    """A storage's records, if it can be read and has the columns of one; an error tells what is missing.  Reads one row."""
    if missing := [c for c in columns if c not in records.columns]:
        raise ValueError(f"the storage lacks {missing}")
    records.limit(1).collect()
    return records


def discard_all(df: DataFrame) -> None:
    """Runs the plan and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


def clear_then_write(records: DataFrame, stored: DataFrame, base: str, path: str) -> None:
    """Clears a base if the new rows have any, and writes stored and new rows together."""
    from tidewell.operators.records import clear_base, upsert

    cleared = clear_base(stored, base) if not records.where(F.col("base") == base).isEmpty() else stored
    write_records(upsert(cleared, records, "mtime"), path)


def write_index(postings: DataFrame, path: str) -> None:
    """Postings by field, sorted by term, so that a query reads its fields' folders and few row groups."""
    postings.repartitionByRange("field", "term").sortWithinPartitions("term", "doc").write.mode("overwrite").partitionBy("field").parquet(path)


def send_documents(rows: DataFrame, send: Callable[[list[dict]], None], batch: int = 1000) -> DataFrame:
    """(part, sent): rows sent to a remote index by the executors, in batches through a function.

    A part whose sending fails is sent again from its beginning, so the remote side must take a document twice.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for i, part in enumerate(parts):
            listed = part.to_dict("records")
            for at in range(0, len(listed), batch):
                send(listed[at : at + batch])
            yield pd.DataFrame({"part": [i], "sent": [len(listed)]})

    return rows.mapInPandas(run, "part bigint, sent bigint")


def delete_from_index(postings: DataFrame, deleted: DataFrame) -> DataFrame:
    return postings.join(deleted.select("doc").distinct(), "doc", "left_anti")


def update_index(postings: DataFrame, changed: DataFrame) -> DataFrame:
    """Postings with changed documents' old entries replaced."""
    return delete_from_index(postings, changed.select("doc")).unionByName(changed)
