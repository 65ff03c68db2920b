"""Results of several sources as one list: merge modes, enforced sources, score adjustment, response merging.

Each source gives ranked rows; a page from 0 to start + rows of each is enough, so merging sorts few rows.
"""

from __future__ import annotations

from functools import reduce
from hashlib import md5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gather(sources: dict[str, DataFrame], start: int = 0, rows: int | None = 20, score: str = "score", key: str = "id") -> DataFrame:
    """The first start + rows rows of each source, with its name; from them any page of the whole can be cut.  rows None: all, in no order."""
    if rows is not None:
        sources = {name: df.orderBy(F.desc(score), key).limit(start + rows) for name, df in sources.items()}
    return reduce(DataFrame.unionByName, [df.withColumn("source", F.lit(name)) for name, df in sources.items()])


def _place(order: list[str]) -> Column:
    known = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    return F.when(known > 0, known).otherwise(len(order) + 1)


def merge_order(mode: str, order: list[str] | None = None, score: str = "score", key: str = "id", sort: list[Column] | None = None) -> tuple[list[Column], Column | None]:
    """Sort keys of a mode, and the row number that interleaving needs.

    standard: the sources' own sort; score: by score; concatenate: source after source (unknown ones
    last); interleave: one row of each source in turn.
    """
    tail = [F.col("source"), F.col(key)]
    if mode == "standard":
        return [*(sort or [F.desc(score)]), *tail], None
    if mode == "score":
        return [F.desc(score), *tail], None
    if mode == "concatenate":
        return [_place(order or []), F.desc(score), *tail], None
    if mode == "interleave":
        return [F.col("_turn"), _place(order or []), *tail], F.row_number().over(Window.partitionBy("source").orderBy(F.desc(score), key))
    raise ValueError(f"unknown merge mode {mode}")


def merge(rows: DataFrame, mode: str = "score", order: list[str] | None = None, start: int = 0, size: int | None = None, score: str = "score", key: str = "id", sort: list[Column] | None = None) -> DataFrame:
    """Gathered rows with their 0-based position, and the page cut from them.

    Without a size all rows are kept; where the position isn't used then (nor a start), nothing is sorted.
    """
    keys, turn = merge_order(mode, order, score, key, sort)
    if turn is not None:
        rows = rows.withColumn("_turn", turn)
    if size is not None:
        rows = rows.orderBy(*keys).limit(start + size)
    placed = rows.withColumn("position", F.row_number().over(Window.orderBy(*keys)) - 1)
    return (placed.where(F.col("position") >= start) if start else placed).drop("_turn")


def enforce(merged: DataFrame, rules: dict[str, int], query: str, top: int = 20, only_if_none: bool = False, key: str = "id") -> DataFrame:
    """Puts rows of sources into the top rows if too few are there: "at least n of this source".

    The places are drawn from an MD5 of query and row, so the same query gives the same list.  only_if_none:
    a rule holds only for a source of which there is no row in the top.  The merged page is bounded by its
    size; all is rank arithmetic on it.
    """
    rows = merged.withColumn("_target", F.col("position").cast("double"))
    seed = F.lit(md5(query.encode()).hexdigest())
    inside = F.count(F.when(F.col("position") < top, 1)).over(Window.partitionBy("source"))
    rows = rows.withColumn("_inside", inside)
    outside = F.row_number().over(Window.partitionBy("source", F.col("position") >= top).orderBy("position"))
    rows = rows.withColumn("_n", outside)
    wanted = reduce(lambda rest, rule: F.when(F.col("source") == rule[0], F.lit(rule[1])).otherwise(rest), rules.items(), F.lit(0))
    missing = F.when((F.col("_inside") == 0) | F.lit(not only_if_none), wanted - F.col("_inside")).otherwise(0)
    moved = (F.col("position") >= top) & (F.col("_n") <= missing)
    room = F.lit(max(1, top - sum(rules.values())))
    digest = F.md5(F.concat(seed, F.lit(":"), F.col(key).cast("string")).cast("binary"))
    drawn = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), room).cast("double")
    ranked = rows.withColumn("_target", F.when(moved, drawn + 0.5).otherwise(F.col("_target")))
    return ranked.withColumn("position", F.row_number().over(Window.orderBy("_target", "position")) - 1).drop("_target", "_inside", "_n")


def adjust_scores(rows: DataFrame, factor: float = 1.0, add: float = 0.0, simple_factor: float | None = None, simple: bool = False, score: str = "score") -> DataFrame:
    """score * factor + add, with a factor of its own for simple queries."""
    used = simple_factor if simple and simple_factor is not None else factor
    return rows.withColumn(score, F.col(score) * used + add)


def merge_facets(parts: list[DataFrame], sort: str = "count", limit: int = 100) -> DataFrame:
    """(field, term, count) of several back-ends summed, the first `limit` of each field (-1: all)."""
    summed = reduce(DataFrame.unionByName, parts).groupBy("field", "term").agg(F.sum("count").alias("count"))
    order = [F.desc("count"), F.asc("term")] if sort == "count" else [F.asc("term")]
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(*order)))
    return ranked if limit < 0 else ranked.where(F.col("rank") <= limit)


def merge_suggestions(parts: list[DataFrame], limit: int = 10) -> DataFrame:
    """Hits summed, query counts the largest, the most frequent first."""
    whole = reduce(DataFrame.unionByName, [p.select("query", "hits", "count") for p in parts])
    return whole.groupBy("query").agg(F.sum("hits").alias("hits"), F.max("count").alias("count")).orderBy(F.desc("count"), "query").limit(limit)


def merge_proposals(parts: list[DataFrame], limit: int | None = None) -> DataFrame:
    """Spelling proposals (term, score) of several sources, each kept with its score, the best first."""
    whole = reduce(DataFrame.unionByName, [p.select("term", "score") for p in parts]).orderBy(F.desc("score"), "term")
    return whole if limit is None else whole.limit(limit)


def merge_highlights(parts: list[DataFrame]) -> DataFrame:
    """(id, field, fragments): the fragments of all sources, each once and in order."""
    whole = reduce(DataFrame.unionByName, parts)
    listed = whole.select("id", "field", F.explode("fragments").alias("f")).distinct()
    return listed.groupBy("id", "field").agg(F.array_sort(F.collect_list("f")).alias("fragments"))


def route_requests(sources: dict[str, DataFrame], wanted: list[str] | None) -> dict[str, DataFrame]:
    """The sources a request names (all of them by default); an unknown name is an error."""
    if wanted is None:
        return sources
    if unknown := [w for w in wanted if w not in sources]:
        raise KeyError(f"unknown sources: {unknown}")
    return {w: sources[w] for w in wanted}
