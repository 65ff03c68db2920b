"""Query suggestions, spelling proposals and highlighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import keyword
from tidewell.functions.text import standard as split_words

DEFAULT = 10


def normalise(query: Column | str) -> Column:
    """One keyword: underscores are blanks."""
    return keyword(query)[0]


def suggest(store: DataFrame, prefix: str, limit: int = DEFAULT, least: int = 1) -> DataFrame:
    """The most frequent stored queries that begin with the prefix; none for one shorter than `least`."""
    if len(prefix) < least:
        return store.limit(0)
    start = store.sparkSession.range(1).select(normalise(F.lit(prefix)).alias("p")).first()["p"]
    return store.where(F.col("normalized").startswith(start)).orderBy(F.desc("count"), "query").limit(limit)


def fold(updates: DataFrame, order: list[str]) -> DataFrame:
    """The store after a log of updates (query, hits, optional given), oldest first.

    No hits delete the query; else its count is one more, or what the update gives; hits are the last ones.
    What counts is the part of the log after a query's last deletion, and in it what follows the last given
    count.  Both are found by aggregates, so no query's log is gathered.
    """
    place = F.struct(*order)
    rows = updates.withColumns({"normalized": normalise("query"), "_at": place})
    if "given" not in rows.columns:
        rows = rows.withColumn("given", F.lit(None).cast("bigint"))
    marks = rows.groupBy("normalized").agg(F.max(F.when(F.col("hits") == 0, F.col("_at"))).alias("_deleted"))
    live = rows.join(marks, "normalized").where(F.col("_deleted").isNull() | (F.col("_at") > F.col("_deleted")))
    givens = live.groupBy("normalized").agg(F.max(F.when(F.col("given").isNotNull(), F.struct("_at", "given"))).alias("_given"))
    counted = live.join(givens, "normalized")
    after = F.col("_given").isNull() | (F.col("_at") > F.col("_given._at"))
    return counted.groupBy("normalized").agg(
        F.max_by("query", "_at").alias("query"),
        F.max_by("hits", "_at").alias("hits"),
        (F.count(F.when(after, 1)) + F.coalesce(F.max("_given.given"), F.lit(0))).alias("count"),
    )


def update(store: DataFrame, updates: DataFrame, order: list[str]) -> DataFrame:
    """A store with a batch of updates: stored rows come first, as given counts."""
    first = store.select("query", "hits", F.col("count").alias("given"), F.lit(0).alias("_new"), *[F.lit(None).cast(updates.schema[o].dataType).alias(o) for o in order])
    given = updates if "given" in updates.columns else updates.withColumn("given", F.lit(None).cast("bigint"))
    return fold(first.unionByName(given.select("query", "hits", "given", F.lit(1).alias("_new"), *order)), ["_new", *order])


def delete(store: DataFrame, queries: list[str]) -> DataFrame:
    gone = store.sparkSession.createDataFrame([(q,) for q in queries], "query string").select(normalise("query").alias("normalized"))
    return store.join(F.broadcast(gone), "normalized", "left_anti")


def recent(log: DataFrame, now: Column, seconds: int, time: str = "ts", limit: int = DEFAULT) -> DataFrame:
    """Queries of the last seconds, the most frequent first."""
    fresh = log.where(F.col(time) >= now - F.make_dt_interval(secs=F.lit(seconds)))
    return fresh.groupBy("query").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "query").limit(limit)


def export_text(store: DataFrame, path: str) -> None:
    store.select("query", "hits", "count").write.mode("overwrite").option("sep", "\t").csv(path)


def import_text(spark, path: str) -> DataFrame:
    rows = spark.read.option("sep", "\t").schema("query string, hits bigint, count bigint").csv(path)
    return rows.withColumn("normalized", normalise("query"))


def did_you_mean(terms: DataFrame, word: str, limit: int = 5, most: int = 2) -> DataFrame:
    """(term, distance, df) of known terms near a word, the nearest and then most frequent first."""
    far = F.levenshtein(F.col("term"), F.lit(word), most)
    # Terms of other lengths are farther: they aren't measured.
    alike = F.abs(F.char_length("term") - len(word)) <= most
    near = terms.where(alike).withColumn("distance", far).where((F.col("distance") >= 0) & (F.col("term") != word))
    return near.select("term", "distance", "df").orderBy("distance", F.desc("df"), "term").limit(limit)


def proposed_query(terms: DataFrame, text: str, most: int = 2) -> DataFrame:
    """(query, distance): a query of known words, each unknown word of text replaced by its best proposal; all in one pass.

    The words of one query are few and are sent to the terms.  A word without a proposal stays.
    """
    spark = terms.sparkSession
    words = spark.range(1).select(F.posexplode(split_words(F.lit(text))).alias("at", "word"))
    alike = (F.abs(F.char_length("term") - F.char_length("word")) <= most) & (F.levenshtein("term", "word") <= most)
    near = terms.join(F.broadcast(words), alike).withColumn("distance", F.levenshtein("term", "word"))
    best = near.groupBy("at").agg(F.min_by(F.struct("term", "distance"), F.struct("distance", -F.col("df"), "term")).alias("best"))
    chosen = words.join(best, "at", "left").select("at", F.coalesce("best.term", "word").alias("word"), F.coalesce("best.distance", F.lit(0)).alias("distance"))
    listed = chosen.agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("x"), F.sum("distance").alias("distance"))
    return listed.select(F.array_join(F.transform("x", lambda w: w["word"]), " ").alias("query"), "distance")


def highlight(text: Column, words: list[str], before: str = "<em>", after: str = "</em>") -> Column:
    """Whole words marked, whatever their case."""
    import re

    pattern = r"(?i)(?<![\p{L}\p{N}])(" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + r")(?![\p{L}\p{N}])"
    return F.regexp_replace(text, pattern, f"{before}$1{after}")


def fragments(text: Column, words: list[str], around: int = 40, most: int = 3) -> Column:
    """Stretches of text around the words."""
    import re

    pattern = rf"(?is).{{0,{around}}}(?<![\p{{L}}\p{{N}}])(?:{'|'.join(map(re.escape, words))})(?![\p{{L}}\p{{N}}]).{{0,{around}}}"
    return F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), 1, most)


class SuggestStore:
    """Suggestions in a DataFrame, updated in batches."""

    def __init__(self, store: DataFrame):
        self.store, self.pending = store, []

    def add(self, query: str, hits: int, count: int | None = None) -> None:
        self.pending.append((query, hits, count, len(self.pending)))

    def commit(self) -> None:
        if self.pending:
            batch = self.store.sparkSession.createDataFrame(self.pending, "query string, hits bigint, given bigint, seq bigint")
            self.store, self.pending = update(self.store, batch, ["seq"]), []

    def suggest(self, prefix: str, limit: int = DEFAULT, least: int = 1) -> DataFrame:
        self.commit()
        return suggest(self.store, prefix, limit, least)

    def delete(self, query: str) -> None:
        self.commit()
        self.store = delete(self.store, [query])

    def clear(self) -> None:
        self.store, self.pending = self.store.limit(0), []


def top_per_prefix(store: DataFrame, length: int, limit: int) -> DataFrame:
    """The best queries under each beginning of a length, for precomputed suggestions."""
    start = F.substring("normalized", 1, length)
    ranked = store.withColumn("prefix", start).withColumn("rank", F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("count"), "query")))
    return ranked.where(F.col("rank") <= limit)
