"""Line dedup by distinct-site spread: lines that appear on many sites are boilerplate.

Lines are hashed (two independent 64-bit hashes of the trimmed line).  Rows are first reduced to distinct
(line, site) pairs before they are shuffled, and then a HyperLogLog sketch of the sites is aggregated for
each line; sketches merge, so they can be kept per crawl and united later (`merge_sketches`).  A line
whose estimate is clearly above the threshold is boilerplate, one clearly below is not; in the band
between, sites are counted exactly.  Boilerplate lines are then removed from every document: up to SENT_LINES of
them are sent to all tasks as sorted hashes, and documents are cleaned where they lie, without a shuffle; more are joined
with the documents' lines, of which hot ones are split.

A line on MIN_SITES sites goes whatever its length.  A site that holds a large share of all rows counts once.

Edge cases: lines that are blank after trimming are never boilerplate and stay; a null site counts for no
site; null text stays null with no lines; very long texts are cleaned whole; a document may end up empty and stays as a row; equal texts
are treated equally, so repeated rows are kept; an empty table gives an empty result; result columns
replace columns of the same name.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, documents, join_hot, map_text

MIN_SITES = 5
#: Boilerplate lines that are sent to all tasks (16 bytes each); beyond, a join finds them.
SENT_LINES = 500_000
#: log2 of the sketch's registers (relative standard error 1.6 %) and the half-width of the exact band (over 6 errors).
LOG_K, BAND = 12, 0.1
_BLANKS = " \t\r"
#: Spark's seed of xxhash64, and what it makes of the number 1.
_SEED = 42
_SEED_B = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), _SEED)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS))


def _line_key(line: Column) -> Column:
    """Two hashes; cleaned() makes the same ones."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _lines(text: str) -> Column:
    return F.split(F.col(f"`{text}`").cast("string"), "\n", -1)


def site_pairs(docs: DataFrame, text: str, site: str) -> DataFrame:
    """Distinct (line, site): the aggregation's partial step runs before the shuffle."""
    lines = docs.select(F.col(f"`{site}`").cast("string").alias("site"), F.explode(F.transform(_lines(text), _trimmed)).alias("line"))
    keyed = lines.where((F.col("line") != "") & F.col("site").isNotNull()).select(_line_key(F.col("line")).alias("key"), "site")
    return keyed.select("key.a", "key.b", "site").distinct()


def sketches(pairs: DataFrame, log_k: int = LOG_K) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.hll_sketch_agg("site", log_k).alias("sketch"))


def merge_sketches(*parts: DataFrame) -> DataFrame:
    """Sketches of the same lines from several crawls, united."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("a", "b").agg(F.hll_union_agg("sketch").alias("sketch"))


def boilerplate_lines(docs: DataFrame, text: str, site: str, min_sites: int = MIN_SITES, band: float = BAND, log_k: int = LOG_K) -> DataFrame:
    """Keys (a, b) of lines on at least min_sites sites."""
    pairs = site_pairs(docs, text, site)
    estimated = sketches(pairs, log_k).select("a", "b", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - band))
    sure = F.col("sites") > min_sites * (1 + band)
    near = estimated.where(~sure).select("a", "b")
    exact = pairs.join(near, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites)
    return estimated.where(sure).select("a", "b").union(exact.select("a", "b"))


def cleaned(docs: DataFrame, text: str, spread: DataFrame) -> DataFrame:
    """docs without the lines of spread (a, b), of which there are at most SENT_LINES."""
    keys = spread.toArrow()
    a, b = (keys.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
    order = np.argsort(a, kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((a[order], b[order]))

    def make():
        a, b = shared.value

        def is_spread(line: bytes, at: int) -> bool:
            second = xxhash.xxh64_intdigest(line, _SEED_B)
            while at < len(a) and a[at] == a[at - 1]:  # equal first hashes of different lines
                if int(b[at - 1]) == second:
                    return True
                at += 1
            return int(b[at - 1]) == second

        def fn(texts: list) -> list:
            lines = [None if t is None else t.split("\n") for t in texts]
            keys = [[x.strip(_BLANKS).encode() for x in found or ()] for found in lines]
            first = np.fromiter((xxhash.xxh64_intdigest(k, _SEED) for own in keys for k in own), dtype=np.uint64)
            place = np.searchsorted(a, first)
            known = np.zeros(len(first), dtype=bool)
            known[place < len(a)] = a[place[place < len(a)]] == first[place < len(a)]
            out: list[list] = [[], [], []]
            begin = 0
            for t, found, own in zip(texts, lines, keys, strict=True):
                gone = {int(i) for i in np.flatnonzero(known[begin : begin + len(own)]) if own[i] and is_spread(own[i], int(place[begin + i]) + 1)}
                begin += len(own)
                out[0].append("\n".join(x for i, x in enumerate(found) if i not in gone) if gone else t)
                out[1].append(len(own))
                out[2].append(len(gone))
            return out

        return fn

    return map_text(docs, text, f"`{text}` string, n_lines bigint, n_removed bigint", make)


def joined(docs: DataFrame, text: str, spread: DataFrame) -> DataFrame:
    """The same for any number of lines, by joins."""
    body = F.col(f"`{text}`").cast("string")
    # Which lines go depends on the text alone, so a key of the text serves; copies share one entry.
    text_key = [F.xxhash64(body).alias("__ta"), F.xxhash64(F.lit(2), body).alias("__tb")]
    placed = docs.select(*text_key, F.posexplode(F.transform(_lines(text), _trimmed)).alias("__at", "__line")).where(F.col("__line") != "")
    lines = placed.select("__ta", "__tb", "__at", _line_key(F.col("__line")).alias("k")).select("__ta", "__tb", "__at", "k.a", "k.b")
    gone = checkpoint(join_hot(lines, spread, ["a", "b"]).groupBy("__ta", "__tb").agg(F.collect_set("__at").alias("__gone")))
    marked = join_hot(docs.select("*", *text_key), gone, ["__ta", "__tb"], "left")
    kept = F.filter(_lines(text), lambda line, i: ~F.array_contains(F.col("__gone"), i))
    added = {
        "n_lines": F.when(body.isNull(), F.lit(0)).otherwise(F.size(_lines(text))).cast("bigint"),
        "n_removed": F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("bigint"),
        text: F.when(F.col("__gone").isNull(), body).otherwise(F.array_join(kept, "\n")),
    }
    return marked.withColumns(added).drop("__ta", "__tb", "__gone")


def remove_boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with the text cleaned, plus n_lines and n_removed."""
    docs = docs.drop("n_lines", "n_removed")
    spread = checkpoint(boilerplate_lines(docs, text, site, min_sites))
    return cleaned(docs, text, spread) if spread.count() <= SENT_LINES else joined(docs, text, spread)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    found = remove_boilerplate(docs)
    return found.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("bigint").alias("n_chars_kept"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


ORACLE_OP10 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
l AS MATERIALIZED (SELECT r, source, i, lines[i] AS raw, trim(lines[i], ' ' || chr(9) || chr(13)) AS line
      FROM (SELECT r, source, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
b AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
k AS (SELECT r, count(*) FILTER (WHERE b.line IS NOT NULL) AS gone,
             coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE b.line IS NULL), '') AS kept
      FROM l LEFT JOIN b ON l.line = b.line GROUP BY r)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(gone, 0)::BIGINT AS n_removed,
       length(kept)::BIGINT AS n_chars_kept, md5(kept) AS kept_md5
FROM d LEFT JOIN k USING (r)"""
