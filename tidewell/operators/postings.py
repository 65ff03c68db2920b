"""Postings, term statistics, TF-IDF scores, similar documents, and boosts from other indexes' statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import standard


def placed(docs: DataFrame, key: str, tokens: dict[str, Column]) -> DataFrame:
    """(field, term, doc, tf, positions) of fields whose tokens are given as columns."""
    parts = [docs.select(F.lit(name).alias("field"), F.col(key).alias("doc"), F.posexplode(c).alias("pos", "term")) for name, c in tokens.items()]
    whole = reduce(DataFrame.unionByName, parts)
    return whole.groupBy("field", "term", "doc").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def extract(docs: DataFrame, fields: list[str], analyzer=standard, min_df: int = 1, max_length: int = 10_000) -> DataFrame:
    """(term, tf, df) straight from documents, one row each: over several fields df is the sum of the fields' counts.

    Each row brings its tokens, and each different token once more as a document: one aggregation by term, whose
    partial step leaves little more than the vocabulary, instead of one by term and document.
    """

    def brought(name: str) -> Column:
        tokens = analyzer(F.col(name))
        return F.concat(F.transform(tokens, lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"))), F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"))))

    rows = reduce(DataFrame.unionByName, [docs.select(F.explode(brought(n)).alias("x")).select("x.*") for n in fields])
    counted = rows.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum(1 - F.col("tf")).alias("df"))
    fit = (F.col("term") != "") & (F.char_length("term") <= max_length) & ~F.col("term").contains(" ")
    return counted.where(fit & (F.col("df") >= min_df))


def postings(docs: DataFrame, key: str, fields: list[str], analyzer=standard, positions: bool = False) -> DataFrame:
    """(field, term, doc, tf) and, if asked for, the sorted positions of the term."""
    parts = []
    for name in fields:
        placed = docs.select(F.lit(name).alias("field"), F.col(key).alias("doc"), F.posexplode(analyzer(F.col(name))).alias("pos", "term"))
        parts.append(placed)
    whole = reduce(DataFrame.unionByName, parts)
    extra = [F.array_sort(F.collect_list("pos")).alias("positions")] if positions else []
    return whole.groupBy("field", "term", "doc").agg(F.count(F.lit(1)).alias("tf"), *extra)


def statistics(posts: DataFrame, fields: list[str] | None = None, min_df: int = 1, max_length: int = 10_000, spaces: bool = False) -> DataFrame:
    """(term, tf, df): over several fields df is the sum of the fields' counts, not of distinct documents."""
    rows = posts if fields is None else posts.where(F.col("field").rlike("^(?:" + "|".join(fields) + ")$"))
    fit = (F.col("term") != "") & (F.char_length("term") <= max_length)
    if not spaces:
        fit &= ~F.col("term").contains(" ")
    return rows.where(fit).groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)


def merge_statistics(dumps: dict[str, DataFrame], min_df: int = 1, per_source: bool = True) -> DataFrame:
    """Several sources' statistics: summed, and with a pair of columns for each source if asked for."""
    rows = reduce(DataFrame.unionByName, [d.select("term", "tf", "df", F.lit(name).alias("source")) for name, d in dumps.items()])
    sums = [F.sum("tf").alias("tf"), F.sum("df").alias("df")]
    if per_source:
        sums += [F.sum(F.when(F.col("source") == name, F.col(c)).otherwise(0)).alias(f"{c}_{name}") for name in dumps for c in ("tf", "df")]
    return rows.groupBy("term").agg(*sums).where(F.col("df") >= min_df)


def unique_terms(posts: DataFrame, fields: list[str] | None = None) -> DataFrame:
    return (posts if fields is None else posts.where(F.col("field").isin(fields))).select("term").distinct()


def write_statistics(stats: DataFrame, path: str) -> None:
    """Sorted by term, so that a lookup reads few row groups."""
    stats.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def idf(df: Column, total: Column) -> Column:
    return 1 + F.log(total / (df + 1))


def tf_idf(posts: DataFrame, terms: list[str], total: int | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """(doc, score) of documents with any of the terms: the sum of sqrt(tf) * idf^2 / sqrt(document length).

    Only the query's terms are kept before anything is grouped by document, except for the lengths (doc, length), which
    are one number per document; given as a table, postings of other terms aren't read.
    """
    lengths = posts.groupBy("doc").agg(F.sum("tf").alias("length")) if lengths is None else lengths
    count = F.lit(total) if total is not None else F.col("_n")
    hits = posts.where(F.col("term").isin(terms))
    dfs = hits.groupBy("term").agg(F.count_distinct("doc").alias("df"))
    joined = hits.join(F.broadcast(dfs), "term").join(lengths, "doc")
    if total is None:
        joined = joined.crossJoin(F.broadcast(lengths.agg(F.count(F.lit(1)).alias("_n"))))
    part = F.sqrt("tf") * F.pow(idf(F.col("df"), count), 2) / F.sqrt("length")
    return joined.groupBy("doc").agg(F.sum(part).alias("score"))


def more_like(posts: DataFrame, doc, limit: int = 10, max_terms: int = 25, min_tf: int = 1, min_df: int = 2, min_length: int = 0, stop_words: tuple[str, ...] = (), total: int | None = None) -> DataFrame:
    """(doc, score) of the documents most like one: its best terms by tf * idf are looked up; it isn't in the result.

    posts need hold only the document's own terms if the number of documents is given.
    """
    total = posts.select("doc").distinct().count() if total is None else total
    own = posts.where((F.col("doc") == F.lit(doc)) & (F.col("tf") >= min_tf) & (F.char_length("term") >= min_length) & ~F.col("term").isin(list(stop_words) or [""]))
    wanted = posts.join(F.broadcast(own.select("term").distinct()), "term", "left_semi")
    dfs = wanted.groupBy("term").agg(F.count_distinct("doc").alias("df")).where(F.col("df") >= min_df)
    weighted = own.groupBy("term").agg(F.sum("tf").alias("tf")).join(dfs, "term")
    best = weighted.withColumn("w", F.col("tf") * idf(F.col("df"), F.lit(total))).orderBy(F.desc("w"), "term").limit(max_terms)
    scored = posts.join(F.broadcast(best.select("term", "w", "df")), "term").where(F.col("doc") != F.lit(doc))
    part = F.sqrt(F.col("tf")) * F.pow(idf(F.col("df"), F.lit(total)), 2)
    return scored.groupBy("doc").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "doc").limit(limit)


def term_boosts(targets: dict[str, tuple[DataFrame, int]], target: str, weights: dict[str, float] | None = None, fallback_df: int = 1, delta: float = 0.0) -> DataFrame:
    """(term, boost) that make a target's scores comparable: the pooled idf squared over the target's own.

    targets: statistics and number of documents of each.  Boosts within delta of 1 are 1.
    """
    weights = weights or {}
    pooled_n = float(sum(n * weights.get(name, 1.0) for name, (_, n) in targets.items()))
    rows = reduce(DataFrame.unionByName, [d.select("term", (F.col("df") * weights.get(name, 1.0)).alias("df"), F.lit(name).alias("source")) for name, (d, _) in targets.items()])
    pooled = rows.groupBy("term").agg(F.sum("df").alias("pooled"), F.max(F.when(F.col("source") == target, F.col("df") / weights.get(target, 1.0))).alias("own"))
    own = F.coalesce("own", F.lit(float(fallback_df)))
    ratio = F.pow(idf(F.col("pooled"), F.lit(pooled_n)), 2) / F.pow(idf(own, F.lit(float(targets[target][1]))), 2)
    return pooled.select("term", F.when(F.abs(ratio - 1) <= delta, F.lit(1.0)).otherwise(ratio).alias("boost"))


def ranked(scores: DataFrame, limit: int, key: str = "doc") -> DataFrame:
    best = scores.orderBy(F.desc("score"), key).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))
