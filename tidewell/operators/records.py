"""The record store as operations on DataFrames.

A record table has id, base, deleted, indexable, content, ctime, mtime (and any other columns).  Each
writing operation returns the table after it; the caller writes that to a new version of the path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scalar import salted_time

PRIVATE = r"^__.+__$"
HOLDINGS = "__holdings__"


def modified_since(records: DataFrame, after: int | str | Column, base: str | None = None, time: str = "mtime", key: str = "id", base_column: str = "base", columns: list[str] | None = None) -> DataFrame:
    """Records changed strictly after a time, oldest first; only the wanted columns are read."""
    rows = records.where(F.col(time) > (after if isinstance(after, Column) else F.lit(after)))
    if base is not None:
        rows = rows.where(F.col(base_column) == base)
    return rows.orderBy(time, key).select(*(columns or rows.columns))


def page_after(records: DataFrame, cursor: tuple | None, size: int, time: str = "mtime", key: str = "id") -> DataFrame:
    """The next page by keyset: what follows (time, key) of the last row seen."""
    if cursor is not None:
        at, last = F.lit(cursor[0]), F.lit(cursor[1])
        records = records.where((F.col(time) > at) | ((F.col(time) == at) & (F.col(key) > last)))
    return records.orderBy(time, key).limit(size)


def check_private(ids: list[str], allow_private: bool) -> None:
    import re

    hidden = [i for i in ids if re.match(PRIVATE, str(i))]
    if hidden and not allow_private:
        raise PermissionError(f"private ids need allow_private: {hidden}")


def get(records: DataFrame, wanted, key: str = "id", allow_private: bool = False) -> DataFrame:
    check_private([wanted], allow_private)
    return records.where(F.col(key) == F.lit(wanted)).limit(1)


def get_tree(records: DataFrame, edges: DataFrame, wanted, key: str = "id", depth: int = -1, allow_private: bool = False) -> DataFrame:
    """A record with all its descendants, and with all its ancestors, with their depth (ancestors have negative ones).

    What a lookup without options gives.  A record reached by several ways has its least depth.
    """
    from tidewell.operators import graph

    check_private([wanted], allow_private)
    root = records.where(F.col(key) == F.lit(wanted)).limit(1).select(F.col(key).alias("id"))
    below = graph.expand(root, edges, depth).select("node", "depth")
    above = graph.ascend(root, edges, depth).where("depth > 0").select("node", -F.col("depth"))
    found = below.union(above).groupBy("node").agg(F.min_by("depth", F.abs("depth")).alias("depth"))
    return records.join(found, F.col(key) == F.col("node")).drop("node")


def multi_get(records: DataFrame, ids: list, key: str = "id", allow_private: bool = False) -> DataFrame:
    """The records of a request's ids with their place in it (pos); ids that don't exist are left out.

    The ids come from one request, so they are few: they are sent to the table.
    """
    check_private(ids, allow_private)
    kind = records.schema[key].dataType.simpleString()
    asked = records.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"pos int, _id {kind}")
    return records.join(F.broadcast(asked), F.col(key) == F.col("_id")).drop("_id")


def visible(records: DataFrame, deleted: bool | None = None, indexable: bool | None = None, strict: bool = False) -> DataFrame:
    """Rows by their flags; None lets both through.

    Unless strict, a deleted filter switches the indexable filter off, as clients expect.
    """
    if deleted is not None:
        records = records.where(F.col("deleted") == deleted)
        if not strict:
            return records
    return records if indexable is None else records.where(F.col("indexable") == indexable)


def base_statistics(records: DataFrame) -> DataFrame:
    """Per base: the four flag counters, and deleted, indexable, live (not deleted and indexable) and total."""
    def counted(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    gone, fit = F.col("deleted"), F.col("indexable")
    return records.groupBy("base").agg(
        counted(gone & fit).alias("deleted_indexable"),
        counted(gone & ~fit).alias("deleted_hidden"),
        counted(~gone & fit).alias("live"),
        counted(~gone & ~fit).alias("present_hidden"),
        counted(gone).alias("deleted"),
        counted(fit).alias("indexable"),
        F.count(F.lit(1)).alias("total"),
    )


def holdings(records: DataFrame) -> DataFrame:
    """The statistics as one virtual record."""
    rows = base_statistics(records).select(F.struct("base", "live", "deleted", "indexable", "total").alias("s"))
    listed = rows.agg(F.to_json(F.array_sort(F.collect_list("s"))).alias("content"))
    return listed.select(F.lit(HOLDINGS).alias("id"), F.lit("__private__").alias("base"), "content")


def last_modified(records: DataFrame, base: str | None = None, time: str = "mtime", base_column: str = "base") -> DataFrame:
    """The latest change, 0 (or null for a time type) without rows."""
    rows = records if base is None else records.where(F.col(base_column) == base)
    latest = F.max(time)
    if dict(records.dtypes)[time] in ("int", "bigint"):
        latest = F.coalesce(latest, F.lit(0).cast("bigint"))
    return rows.agg(latest.alias("last_modified"))


def upsert(stored: DataFrame, incoming: DataFrame, order: str, key: str = "id", try_update: bool = False, time: str | None = None) -> DataFrame:
    """stored (of unique ids) with incoming on top: of several incoming rows with one id the last by `order` wins.

    Stored rows whose id doesn't come in are only filtered.  try_update: an incoming row that equals the stored one, nulls
    included, but for `order` and `time`, leaves it untouched.
    """
    names = stored.columns
    last = incoming.groupBy(F.col(key).alias("_id")).agg(F.max_by(F.struct(*names), F.struct(order)).alias("_row"))
    if try_update:
        old = stored.where(F.col(key).isNotNull()).select(F.col(key).alias("_id"), F.struct(*names).alias("_old"))
        last = last.join(old, "_id", "left")
        same = reduce(Column.__and__, [F.col("_row")[c].eqNullSafe(F.col("_old")[c]) for c in names if c not in (time, order)])
        last = last.withColumn("_row", F.when(F.col("_old").isNotNull() & same, F.col("_old")).otherwise(F.col("_row")))
    changed = last.select("_row.*")
    return stored.join(changed.select(F.col(key).alias("_id")), F.col(key) == F.col("_id"), "left_anti").unionByName(changed)


def stamp(rows: DataFrame, now_ms: int, order: str, time: str = "mtime", range_size: int = 1 << 20) -> DataFrame:
    """Unique, ordered stamps for a batch: the milliseconds above a counter, which runs on into later ones.

    Rows are numbered within hash-free ranges of their order and the ranges' counts are added, so that no
    task ranks the whole batch.
    """
    bucket = F.floor(F.col(order) / range_size)
    counts = rows.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    ranked = rows.withColumn("_b", bucket).withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(order)))
    return ranked.join(before, "_b").withColumn(time, salted_time(F.lit(now_ms), 0) + F.col("_before") + F.col("_r") - 1).drop("_b", "_r", "_before")


def clear_base(records: DataFrame, base: str, now: Column | None = None) -> DataFrame:
    """All live rows of a base marked deleted, with a new time where the table has one."""
    hit = (F.col("base") == base) & ~F.col("deleted")
    changed = {"deleted": F.col("deleted") | hit}
    if now is not None:
        changed["mtime"] = F.when(hit, now).otherwise(F.col("mtime"))
    return records.withColumns(changed)


def dump_difference(stored: DataFrame, dump: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """key and action (insert, update, delete, keep) that turn the stored rows into a full dump."""
    digest = F.sha2(F.col(content).cast("binary"), 256)
    a = stored.select(F.col(key).alias("_a"), digest.alias("_ha"))
    b = dump.select(F.col(key).alias("_b"), digest.alias("_hb"))
    action = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").when(~F.col("_ha").eqNullSafe(F.col("_hb")), "update").otherwise("keep")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), action.alias("action"))


def sync_dump(records: DataFrame, dump: DataFrame, base: str, max_deletes: int | None = None, min_records: int = 1, before: Column | None = None, key: str = "id", hide: bool = False) -> DataFrame:
    """Marks live rows of a base that a successful full dump didn't bring as deleted.

    Nothing is deleted when the dump has too few rows or when max_deletes or more would go.  before: only
    rows up to this time.  hide: deleted rows aren't indexable either.
    """
    received = dump.agg(F.count(F.lit(1)).alias("_received"))
    live = (F.col("base") == base) & ~F.col("deleted")
    if before is not None:
        live &= F.col("mtime") <= before
    seen = dump.select(F.col(key).alias("_seen")).distinct()
    marked = records.join(seen, F.col(key) == F.col("_seen"), "left").withColumn("_gone", live & F.col("_seen").isNull())
    totals = marked.agg(F.count(F.when(F.col("_gone"), 1)).alias("_deletes")).crossJoin(received)
    allowed = F.col("_received") >= max(1, min_records)
    if max_deletes is not None:
        allowed &= F.col("_deletes") < max_deletes
    judged = marked.crossJoin(F.broadcast(totals)).withColumn("_gone", F.col("_gone") & allowed)
    changed = {"deleted": F.col("deleted") | F.col("_gone")}
    if hide:
        changed["indexable"] = F.col("indexable") & ~F.col("_gone")
    return judged.withColumns(changed).select(records.columns)


def aggregate(storages: list[DataFrame], time: str = "mtime", key: str = "id") -> DataFrame:
    """Several storages as one, oldest first."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), storages).orderBy(time, key)


def route(records: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds `storage`: the first rule that holds, null if none does."""
    chosen = reduce(lambda rest, rule: F.when(rule[1], F.lit(rule[0])).otherwise(rest), reversed(rules), F.lit(None).cast("string"))
    return records.withColumn("storage", chosen)


class SearchStorage:
    """Records of an index by id: reads only, in lookups of at most `batch` ids."""

    def __init__(self, searcher, batch: int = 50):
        self.searcher, self.batch = searcher, batch

    def get(self, wanted) -> DataFrame:
        return self.multi_get([wanted])

    def multi_get(self, ids: list) -> DataFrame:
        """The known ones of the ids, whose number the caller fixes."""
        check_private(ids, False)
        parts = [self.searcher.by_ids(ids[i : i + self.batch]) for i in range(0, len(ids), self.batch)]
        return reduce(DataFrame.unionByName, parts or [self.searcher.docs.limit(0)])

    def _unsupported(self, *_args, **_kwargs):
        raise NotImplementedError("an index gives records by id only")

    flush = clear = modified_since = statistics = _unsupported


def run_batch(records: DataFrame, job, base: str | None = None, after: int | None = None, before: int | None = None, schema=None) -> DataFrame:
    """A job over a part of the storage: a function of a DataFrame, or of pandas batches if a schema is given.

    Bounds are strict on both sides.
    """
    rows = records if base is None else records.where(F.col("base") == base)
    if after is not None:
        rows = rows.where(F.col("mtime") > after)
    if before is not None:
        rows = rows.where(F.col("mtime") < before)
    return job(rows) if schema is None else rows.mapInPandas(job, schema)


# Jobs for run_batch.
def job_delete(rows: DataFrame) -> DataFrame:
    return rows.withColumn("deleted", F.lit(True))


def job_touch(now: int):
    return lambda rows: rows.withColumn("mtime", F.lit(now).cast("bigint"))


def job_prefix(prefix: str):
    return lambda rows: rows.withColumn("id", F.concat(F.lit(prefix), F.col("id")))


def job_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("records"))


def job_ids(rows: DataFrame) -> DataFrame:
    return rows.select("id")
