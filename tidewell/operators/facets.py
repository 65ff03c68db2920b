"""Facets: flat, grouped over fields, ranges, hierarchies, and merging results of several sources.

Input is long form: one row per (doc, term), optionally (doc, field, term).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import checkpoint

WANTED_TAGS, MAX_TAGS, MIN_COUNT, DEFAULT_TAGS = 15, 5000, 1, 20
DELIMITER, LEVELS = "/", 5

# Reliability of counts as two bits: the truth may be less, the truth may be more.
PRECISE, LESS, MORE, IMPRECISE = 0, 1, 2, 3


def doc_terms(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(doc, field, term) of scalar or array fields."""
    kinds = dict(docs.dtypes)

    def values(name: str) -> Column:
        listed = F.col(name).cast("array<string>") if kinds[name].startswith("array") else F.array(F.col(name).cast("string"))
        return F.transform(listed, lambda t: F.struct(F.lit(name).alias("field"), t.alias("term")))

    exploded = docs.select(F.col(key).alias("doc"), F.explode(F.concat(*map(values, fields))).alias("x"))
    return exploded.select("doc", "x.field", "x.term").where(F.col("term").isNotNull())


def term_counts(terms: DataFrame, distinct_docs: bool = True) -> DataFrame:
    """(term, count).  distinct_docs: a document with a term in two fields counts once, else per field."""
    rows = terms.select("doc", "term").distinct() if distinct_docs else terms
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("count"))


def after_query(terms: DataFrame, hits: DataFrame, key: str = "doc") -> DataFrame:
    """The terms of a query's hits."""
    return terms.join(hits.select(F.col(key).alias("doc")), "doc", "left_semi")


def top_by_count(counts: DataFrame, limit: int = DEFAULT_TAGS, min_count: int = MIN_COUNT) -> DataFrame:
    """The most frequent terms with their rank; among equals the lesser term comes first."""
    best = counts.where(F.col("count") >= min_count).orderBy(F.desc("count"), "term").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "term")))


def by_term_order(counts: DataFrame, limit: int = DEFAULT_TAGS, offset: int = 0, prefix: str = "", min_count: int = MIN_COUNT, reverse: bool = False, locale: str | None = None) -> DataFrame:
    """Terms in order from the first that isn't before prefix, moved by offset (negative: before it).

    The order is ranged over counted terms, not documents.  Only the window is numbered: what follows is a
    top-k, and so is what precedes, backwards.
    """
    key = F.collate("term", locale) if locale else F.col("term")
    start = F.collate(F.lit(prefix), locale) if locale else F.lit(prefix)
    valid = counts.where(F.col("count") >= min_count)
    forward, backward = ([F.desc(key), F.desc("term")], [F.asc(key), F.asc("term")]) if reverse else ([F.asc(key), F.asc("term")], [F.desc(key), F.desc("term")])
    before = (key > start if prefix else F.lit(False)) if reverse else key < start
    parts = []
    if offset + limit > 0:
        ahead = valid.where(~before).orderBy(*forward).limit(offset + limit)
        parts.append(ahead.withColumn("position", F.row_number().over(Window.orderBy(*forward)) - 1))
    if offset < 0:
        behind = valid.where(before).orderBy(*backward).limit(-offset)
        parts.append(behind.withColumn("position", -F.row_number().over(Window.orderBy(*backward))))
    whole = reduce(DataFrame.unionByName, parts)
    # When too few terms precede, the window starts at the first term and keeps its length.
    first = F.greatest(F.lit(offset), F.coalesce(F.min("position").over(Window.partitionBy()), F.lit(0)))
    return whole.withColumn("_first", first).where((F.col("position") >= F.col("_first")) & (F.col("position") < F.col("_first") + limit)).drop("_first")


def totals(counts: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """total_references, valid_tags and potential_tags."""
    valid = F.col("count") >= min_count
    return counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_references"),
        F.count(F.when(valid, 1)).alias("valid_tags"),
        F.count(F.lit(1)).alias("potential_tags"),
    )


def merge(parts: list[DataFrame], limit: int = 100, how: str = "sum") -> DataFrame:
    """Counts of the same terms from several sources, summed; reliabilities unite bit by bit."""
    return summed(parts, how).orderBy(F.desc("count"), "term").limit(limit)


def summed(parts: list[DataFrame], how: str = "sum") -> DataFrame:
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    folded = {"sum": F.sum, "min": F.min, "max": F.max}[how]("count").alias("count")
    aggregates = [folded]
    if "reliability" in whole.columns:
        aggregates.append(F.bit_or(F.coalesce("reliability", F.lit(PRECISE))).alias("reliability"))
    return whole.groupBy("term").agg(*aggregates).where(F.col("term") != "")


def parse_map(text: str) -> list[tuple[str, str]]:
    """Pairs of an n:m rename map: `a;b - c;d` maps a and b to both c and d; maps are separated by commas."""
    pairs = []
    for rule in filter(None, map(str.strip, text.split(","))):
        left, _, right = rule.partition(" - ")
        pairs += [(a.strip(), b.strip()) for a in left.split(";") for b in right.split(";")]
    return pairs


def map_tags(counts: DataFrame, mapping: list[tuple[str, str]], how: str = "sum", reliability: int | None = None) -> DataFrame:
    """Terms renamed n:m (others stay) and equal names merged by sum, min or max.  The map is configuration."""
    names = counts.sparkSession.createDataFrame(mapping, "term string, mapped string")
    renamed = counts.join(F.broadcast(names), "term", "left").select(F.coalesce("mapped", "term").alias("term"), "count")
    out = renamed.groupBy("term").agg({"sum": F.sum, "min": F.min, "max": F.max}[how]("count").alias("count"))
    return out if reliability is None else out.withColumn("reliability", F.lit(reliability))


def number_ranges(rows: DataFrame, value: str, start: float, end: float, gap: float) -> DataFrame:
    """(bucket_start, count) for [start, end) in steps of gap, empty buckets included."""
    steps = int(-(-(end - start) // gap))
    frame = rows.sparkSession.range(steps).select((F.lit(start) + F.col("id") * gap).alias("bucket_start"), F.col("id").alias("_b"))
    inside = rows.where((F.col(value) >= start) & (F.col(value) < end)).groupBy(F.floor((F.col(value) - start) / gap).alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    return frame.join(inside, "_b", "left").select("bucket_start", F.coalesce("n", F.lit(0)).alias("count")).orderBy("bucket_start")


def date_ranges(rows: DataFrame, value: str, start: str, end: str, unit: str = "month") -> DataFrame:
    """(bucket_start, count) for each unit of time in [start, end), empty ones included."""
    spark = rows.sparkSession
    frame = spark.range(1).select(F.explode(F.sequence(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end)), F.expr(f"INTERVAL 1 {unit}"))).alias("bucket_start")).where(F.col("bucket_start") < F.to_timestamp(F.lit(end)))
    inside = rows.where((F.col(value) >= F.lit(start).cast("timestamp")) & (F.col(value) < F.lit(end).cast("timestamp")))
    counted = inside.groupBy(F.date_trunc(unit, F.col(value)).alias("bucket_start")).agg(F.count(F.lit(1)).alias("n"))
    return frame.join(counted, "bucket_start", "left").select("bucket_start", F.coalesce("n", F.lit(0)).alias("count")).orderBy("bucket_start")


def merge_ranges(parts: list[DataFrame]) -> DataFrame:
    """Buckets of the same key summed; keys sort as text if one has a T, as doubles if one has a point, else as integers."""
    whole = reduce(DataFrame.unionByName, parts).withColumn("key", F.col("key").cast("string"))
    summed = whole.groupBy("key").agg(F.sum("count").alias("count"))
    over = Window.partitionBy()
    texts = F.max(F.col("key").contains("T").cast("int")).over(over)
    kind = summed.withColumn("_text", texts)
    return kind.orderBy(F.when(F.col("_text") == 0, F.col("key").try_cast("double")), "key").drop("_text")


@dataclass
class Level:
    """Limits of one level of a hierarchy; max_tags are those of a parent (-1: all)."""

    max_tags: int = MAX_TAGS
    min_count: int = 0
    min_total: int = 1
    order: str = "count"  # or "base": by name


@dataclass
class Hierarchy:
    delimiter: str = DELIMITER
    levels: int = LEVELS
    default: Level = field(default_factory=Level)
    special: dict[int, Level] = field(default_factory=dict)

    def level(self, number: int) -> Level:
        return self.special.get(number, self.default)


def hierarchical(paths: DataFrame, request: Hierarchy = Hierarchy()) -> DataFrame:
    """(level, path, parent, own, total, rank) for documents' paths, given as (doc, path).

    A tag's own count is of documents with exactly that path; its total adds the totals of its valid
    children.  A tag is valid if own and total reach the level's minima; an invalid one hides what is below
    and adds nothing above.  Levels are summed from the deepest up, over tags and not over documents.
    """
    parts = F.split("path", "\\Q" + request.delimiter + "\\E")
    cut = paths.select("doc", F.slice(parts, 1, request.levels).alias("p")).distinct()
    own = cut.groupBy(F.array_join("p", request.delimiter).alias("path"), F.size("p").alias("depth")).agg(F.count(F.lit(1)).alias("own"))
    # Inner paths exist even if no document has exactly them.
    split = F.split("path", "\\Q" + request.delimiter + "\\E")
    prefixes = own.select(F.explode(F.transform(F.sequence(F.lit(1), F.col("depth")), lambda n: F.struct(F.array_join(F.slice(split, F.lit(1), n), request.delimiter).alias("path"), n.alias("depth"), F.when(n == F.col("depth"), F.col("own")).otherwise(0).alias("own")))).alias("x"))
    tags = prefixes.select("x.*").groupBy("path", "depth").agg(F.sum("own").alias("own"))
    parent = F.when(F.col("depth") > 1, F.array_join(F.slice(split, F.lit(1), F.col("depth") - 1), request.delimiter)).otherwise("")
    # The distinct tags are few against the documents; written once, each level is a small job of its own.
    tags = checkpoint(tags.withColumn("parent", parent))
    deepest = tags.agg(F.max("depth")).first()[0] or 1
    levels: dict[int, DataFrame] = {}
    below = None
    for depth in range(deepest, 0, -1):
        limits = request.level(depth)
        here = tags.where(F.col("depth") == depth)
        if below is not None:
            here = here.join(below, F.col("path") == F.col("_up"), "left").withColumn("total", F.col("own") + F.coalesce("_sum", F.lit(0))).drop("_up", "_sum")
        else:
            here = here.withColumn("total", F.col("own"))
        here = here.where((F.col("own") >= limits.min_count) & (F.col("total") >= limits.min_total))
        here = levels[depth] = checkpoint(here) if depth < deepest else here
        below = here.groupBy(F.col("parent").alias("_up")).agg(F.sum("total").alias("_sum"))
    ranked = []
    for depth in range(1, deepest + 1):
        limits = request.level(depth)
        order = [F.desc("total"), F.col("path")] if limits.order == "count" else [F.col("path")]
        level = levels[depth].withColumn("rank", F.row_number().over(Window.partitionBy("parent").orderBy(*order)))
        if limits.max_tags >= 0:
            level = level.where(F.col("rank") <= limits.max_tags)
        if ranked:
            level = level.join(ranked[-1].select(F.col("path").alias("_kept")), F.col("parent") == F.col("_kept"), "left_semi")
        ranked.append(level)
    return reduce(DataFrame.unionByName, ranked).select(F.col("depth").alias("level"), "path", "parent", "own", "total", "rank")


@dataclass
class FacetRequest:
    name: str
    limit: int = WANTED_TAGS
    sort: str = "POPULARITY"


def parse_request(text: str) -> list[FacetRequest]:
    """`Title (ALPHA), Author (5 POPULARITY_ASC)` as requests."""
    requests = []
    for part in filter(None, map(str.strip, text.split(","))):
        m = re.fullmatch(r"([^()]+?)\s*(?:\(\s*(\d+)?\s*([A-Z_]+)?\s*\))?", part)
        if not m or (m[3] or "POPULARITY") not in ("POPULARITY", "POPULARITY_ASC", "ALPHA", "ALPHA_DESC"):
            raise ValueError(f"not a facet request: {part}")
        requests.append(FacetRequest(m[1], min(int(m[2] or WANTED_TAGS), MAX_TAGS), m[3] or "POPULARITY"))
    return requests


def answer(counts: DataFrame, request: FacetRequest) -> DataFrame:
    orders = {"POPULARITY": [F.desc("count"), F.asc("term")], "POPULARITY_ASC": [F.asc("count"), F.asc("term")], "ALPHA": [F.asc("term")], "ALPHA_DESC": [F.desc("term")]}
    return counts.where(F.col("count") >= MIN_COUNT).orderBy(*orders[request.sort]).limit(request.limit)


def value_filters(query: str) -> list[tuple[str, str]]:
    """(field, value) of a conjunction `f:v AND g:"w x"`, for filtering by facet values; [] if it is anything else."""
    pairs = []
    for part in re.split(r"\s+AND\s+", query.strip()):
        m = re.fullmatch(r'\(*\s*([\w.]+):(?:"([^"]*)"|([^\s()"]+))\s*\)*', part)
        if not m:
            return []
        pairs.append((m[1], m[2] if m[2] is not None else m[3]))
    return pairs
