"""Browsing: windows in the sorted terms of a field, pages of ranked rows, and grouped results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELTA, LENGTH = -5, 20


def index_lookup(counts: DataFrame, term: str, delta: int = DELTA, length: int = LENGTH, min_count: int = 0, case_sensitive: bool = False, locale: str | None = None) -> DataFrame:
    """(position, term, count): a window of sorted terms around where term is or would be.

    The window starts delta terms from there (not before the first term) and has length terms.  Only its two
    halves are sorted, each as a top-k.
    """
    folded = F.col("term") if case_sensitive else F.lower("term")
    wanted = F.lit(term if case_sensitive else term.lower())
    key, at = (F.collate(folded, locale), F.collate(wanted, locale)) if locale else (folded, wanted)
    valid = counts.where(F.col("count") >= min_count)
    keyed = valid.withColumn("_key", key)
    origin = keyed.where(F.col("_key") < at).agg(F.count(F.lit(1)).alias("_origin"))
    before = keyed.where(F.col("_key") < at).orderBy(F.desc("_key"), F.desc("term")).limit(max(0, -delta))
    behind = before.withColumn("_at", -F.row_number().over(Window.orderBy(F.desc("_key"), F.desc("term"))))
    # If fewer terms precede than asked for, more of those that follow fill the window.
    after = keyed.where(F.col("_key") >= at).orderBy("_key", "term").limit(length + max(0, delta))
    ahead = after.withColumn("_at", F.row_number().over(Window.orderBy("_key", "term")) - 1)
    whole = behind.unionByName(ahead).crossJoin(F.broadcast(origin)).withColumn("position", F.col("_origin") + F.col("_at"))
    start = F.greatest(F.col("_origin") + delta, F.lit(0))
    return whole.where((F.col("position") >= start) & (F.col("position") < start + length)).select("position", "term", "count").orderBy("position")


def merge_lookups(parts: list[DataFrame], term: str, delta: int = DELTA, length: int = LENGTH, case_sensitive: bool = False) -> DataFrame:
    """Term counts of several sources summed, and the window cut from the whole."""
    summed = reduce(DataFrame.unionByName, [p.select("term", "count") for p in parts]).groupBy("term").agg(F.sum("count").alias("count"))
    return index_lookup(summed, term, delta, length, case_sensitive=case_sensitive)


def page(rows: DataFrame, order: list[Column], start: int, size: int | None) -> DataFrame:
    """size None: all rows from the start on."""
    rest = rows.orderBy(*order).offset(start) if start else rows.orderBy(*order)
    return rest if size is None else rest.limit(size)


def pages(rows: DataFrame, order: list[Column], start: int, size: int, most: int) -> list[DataFrame]:
    """A large page as pages of at most `most` rows."""
    return [page(rows, order, start + i, min(most, size - i)) for i in range(0, size, most)]


def sort_order(field: str, reverse: bool = False, missing_last: bool = True, locale: str | None = None, score: str = "score", key: str = "doc_id") -> list[Column]:
    """Order by a field, missing values last unless told otherwise, then by score and key."""
    value = F.collate(field, locale) if locale else F.col(field)
    if reverse:
        first = value.desc_nulls_last() if missing_last else value.desc_nulls_first()
    else:
        first = value.asc_nulls_last() if missing_last else value.asc_nulls_first()
    return [first, *([F.desc(score)] if score else []), F.asc(key)]


def score_window(rows: DataFrame, lower: float, upper: float, size: int, score: str = "score", key: str = "doc_id") -> DataFrame:
    """The best rows with lower <= score < upper."""
    return rows.where((F.col(score) >= lower) & (F.col(score) < upper)).orderBy(F.desc(score), key).limit(size)


def group_results(hits: DataFrame, group: str, group_limit: int = 1, rows: int | None = 10, score: str = "score", key: str = "doc_id") -> DataFrame:
    """(group, num_found, group_rank, rank, key, score): the best groups with the best documents of each.

    Groups are ordered by their best document.  Counts and best scores are aggregated before anything is
    ranked; then only the chosen groups' documents are.  rows None: all groups.
    """
    # The best is the least by the negated score, so that keys of any type order upwards.
    worth = F.coalesce(-F.col(score).cast("double"), F.lit(float("inf")))
    best = hits.groupBy(group).agg(F.count(F.lit(1)).alias("num_found"), F.min(F.struct(worth.alias("s"), F.col(key).alias("k"))).alias("_best"))
    chosen = best if rows is None else best.orderBy("_best", group).limit(rows)
    chosen = chosen.withColumn("group_rank", F.row_number().over(Window.orderBy("_best", group))).drop("_best")
    ranked = hits.join(chosen if rows is None else F.broadcast(chosen), group).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key)))
    return ranked.where(F.col("rank") <= group_limit).select(group, "num_found", "group_rank", "rank", key, score)


def best_of_each(hits: DataFrame, group: str, limit: int = 1, score: str = "score", key: str = "doc_id") -> DataFrame:
    """The best documents of every group; of a single one a minimum by group, with a partial step, else ranked."""
    order = [F.desc(score), F.col(key)]
    if limit == 1:
        worth = F.struct(F.coalesce(-F.col(score).cast("double"), F.lit(float("inf"))), F.col(key))
        return hits.groupBy(group).agg(F.min_by(F.struct(key, score), worth).alias("_best")).select(group, "_best.*")
    ranked = hits.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("_rank") <= limit).select(group, key, score)


def merge_groups(parts: list[DataFrame], group: str, group_limit: int = 1, rows: int | None = 10, score: str = "score", key: str = "doc_id") -> DataFrame:
    """Grouped results of several sources: counts of the same group summed, documents ranked anew."""
    whole = reduce(DataFrame.unionByName, [p.select(group, "num_found", key, score).withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    found = whole.select(group, "_part", "num_found").distinct().groupBy(group).agg(F.sum("num_found").alias("num_found"))
    merged = group_results(whole.drop("num_found", "_part"), group, group_limit, rows, score, key).drop("num_found")
    return merged.join(found, group).select(group, "num_found", "group_rank", "rank", key, score)


def merge_documents(parts: list[DataFrame]) -> DataFrame:
    """Response headers of several sources: hits summed, the largest limit and the longest time."""
    return reduce(DataFrame.unionByName, parts).agg(F.sum("hit_count").alias("hit_count"), F.max("max_records").alias("max_records"), F.max("search_time").alias("search_time"))
