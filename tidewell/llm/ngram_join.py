"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence matrix.

A document's set is its distinct shingles of NGRAM words, as 64-bit hashes.  Documents of equal sets form a
class; only classes are compared.  Two classes link when 100 * |A & B| >= PERCENT * |A | B|.  Shingle length and
percent are parameters; the bounds below are for 85.

Size-derived bounds.  At most d(n) = floor(0.15 n) of a set's n elements are missing in a partner.  In hash
order the first L common elements of a linked pair lie in the first d(n) + L of each side, so each class
brings only that many columns (`columns`), and a partner shares at least need(n) = L(ceil(0.85 n)) of them.

1. The columns are dealt into blocks by hash.  In a block, the incidence is sorted by column: a column's
   overlap count is its number of classes.  Columns of a single class can't contribute and are dropped.
2. For each class the counts are accumulated over the blocks.  Classes below need(n) are discarded: they
   have no partner.  Of the others, only the rarest columns, as many as the prefix bound
   |columns| - need(n) + 1 leaves, can hold a partner's first meeting.
3. Classes that meet in such a column are candidates.  The most typical class of a column (with the highest
   mean log count over its columns) leads it, and the classes under one leader form a block of rows.  Near
   copies share most columns and so one leader: a block stands for many columns.
4. In a block the full rows are multiplied: overlap counts of all pairs, with common columns as a dense
   product and rare ones pair by pair, are held against the size bound.  Links come out as the edges of a
   spanning forest, not as pairs.  A large block is cut into chunks, each with the leader in it, so this step's
   work is linear in the classes.
5. What its block's leader and chunks have tied together needs no more products.  Only the classes that stay
   outside of their block's largest component (strays) are multiplied with the chunks they weren't in, and of
   these only with chunks whose sizes the size bound allows.

So copies of one text, and large groups of near copies, make rows in proportion to their members.  A column
that unlike documents share in great number costs strays times members of the pairs of chunks left.

Edge cases: null and empty texts, and texts of white space only, have an empty set and link with nothing; fewer words than a shingle has
are one shingle; repeated rows are members of the same class; null ids count for no component's
smallest id; very long texts have large sets and so smaller chunks; other columns of the input, whatever their
names, don't matter; an empty table gives an empty result.  Hashes are 64-bit: of 10**9 distinct shingles, a given
pair of sets is affected by a collision with a probability below 10**-7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, HOT_KEYS, HOT_ROWS, SPACED, checkpoint, documents, join_hot, map_arrow, map_groups, mix64, ngram_hashes, shuffle_partitions, slices, word_hashes

NGRAM, PERCENT = 4, 85
#: Most classes of a chunk and bytes of their sets (about).
CHUNK, CHUNK_BYTES = 700, 4 << 20
#: Most bytes that a group given to a worker has (about).
GROUP_BYTES = 8 << 20


def shingle_sets(texts: list, n: int = NGRAM) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(texts, SPACED)
    grams = ngram_hashes(words, n)
    ends = np.cumsum(counts)
    out = []
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        if count >= n:
            out.append(np.unique(grams[end - count : end - n + 1]))
        elif count:
            out.append(mix64(ngram_hashes(words[end - count : end], count) + np.uint64(count)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def class_of(members: np.ndarray) -> int:
    """A signed 64-bit id of a set; depends on its elements only."""
    with np.errstate(over="ignore"):
        total = mix64(members + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) + np.uint64(len(members))
    return int(mix64(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def missing(n: int, percent: int = PERCENT) -> int:
    return (100 - percent) * n // 100


def _common(n: int, percent: int) -> int:
    return min(n - missing(n, percent), 18 * n // 100 + 4)


def columns(n: int, percent: int = PERCENT) -> int:
    return min(n, missing(n, percent) + _common(n, percent))


def need(n: int, percent: int = PERCENT) -> int:
    return _common(n - missing(n, percent), percent)


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_key, _t and _th (a hash of the text): nothing else of the input is read."""
    body = F.col(f"`{text}`").cast("string")
    return docs.select(F.col(f"`{key}`").alias("_key"), body.alias("_t"), F.xxhash64(body).alias("_th"))


def members_of(source: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """_key, _th, n (shingles) and c (class) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingle_sets(part.column(1).to_pylist(), ngram)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64())], names=["_key", "_th", "n", "c"])

    return map_arrow(source, run, f"_key {source.schema[0].dataType.simpleString()}, _th bigint, n bigint, c bigint")


def _missing(n: Column, percent: int) -> Column:
    return F.floor((100 - percent) * n / 100).cast("int")


def _shared(n: Column, percent: int) -> Column:
    return F.least(n - _missing(n, percent), F.floor(18 * n / 100).cast("int") + 4)


def groups_for(spark: SparkSession, size: int | None) -> int:
    """How many groups of at most about GROUP_BYTES make up so many bytes; one a shuffle partition at least."""
    return max(shuffle_partitions(spark), math.ceil((size or 0) / GROUP_BYTES))


def shared_columns(source: DataFrame, classes: DataFrame, percent: int, ngram: int) -> DataFrame:
    """(c, h, df) for the columns h of class c that other classes have too; df: how many classes do."""
    # A column takes 16 bytes; classes that lie in several slices are sent by each, so some more than this.
    count = groups_for(source.sparkSession, classes.agg(F.sum(F.col("p") * F.lit(16) * F.least("rows", F.lit(64)))).first()[0])

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                sets = {class_of(s): s for s in shingle_sets(part.column(0).to_pylist(), ngram) if len(s)}
                if not sets:
                    continue
                firsts = [s[: columns(len(s), percent)] for s in sets.values()]
                h = np.concatenate(firsts)
                c = np.repeat(np.array(list(sets), dtype=np.int64), [len(f) for f in firsts])
                block = (mix64(h) % np.uint64(count)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                cuts = np.flatnonzero(np.diff(block[order])) + 1
                hs, cs = np.split(h[order], cuts), np.split(c[order], cuts)
                blocks = block[order][np.concatenate(([0], cuts))]
                yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array([x.tobytes() for x in hs], pa.binary()), pa.array([x.tobytes() for x in cs], pa.binary())], names=["block", "h", "c"])

    def count_columns(rows: pa.Table) -> pa.Table:
        def flat(name: str, kind) -> np.ndarray:
            return np.concatenate([np.frombuffer(x.as_buffer(), dtype=kind) for x in rows.column(name)])

        h, c = flat("h", np.uint64), flat("c", np.int64)
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
        h, c = h[fresh], c[fresh]
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        df = np.diff(np.concatenate((starts, [len(h)])))
        many = np.repeat(df > 1, df)
        return pa.table({"c": c[many], "h": h[many].view(np.int64), "df": np.repeat(df, df)[many]})

    blocks = map_arrow(source.select("_t"), incidence, "block bigint, h binary, c binary")
    return map_groups(blocks, "block", count_columns, "c bigint, h bigint, df bigint")


def candidates(source: DataFrame, classes: DataFrame, percent: int, ngram: int) -> DataFrame:
    """(h, c, n, w): the classes that may have partners, under each column in which they may meet one, their sizes and
    how typical they are (w)."""
    n = F.col("n").cast("int")
    bound = classes.withColumn("need", _shared(n - _missing(n, percent), percent))
    gathered = shared_columns(source, classes, percent, ngram).groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("x"))
    able = gathered.join(bound, "c").where(F.size("x") >= F.col("need"))
    # The columns that no other class has come first in order of rarity.
    # No length is negative: that rows explode is checked before the filter above.
    meet = F.slice("x", F.lit(1), F.greatest(F.size("x") - F.col("need") + 1, F.lit(0)))
    typical = F.aggregate("x", F.lit(0.0), lambda total, e: total + F.log(e["df"].cast("double"))) / F.col("p")
    # In a step of its own, before the columns are exploded: else it is computed for each of them.
    return able.select("c", "n", typical.alias("w"), meet["h"].alias("meet")).select("c", "n", "w", F.explode("meet").alias("h"))


def class_sets(source: DataFrame, members: DataFrame, wanted: DataFrame, ngram: int) -> DataFrame:
    """(c, s): the full sets, as bytes, of the wanted classes, from one document of each."""
    one = members.join(wanted, "c", "left_semi").groupBy("c").agg(F.min(F.struct("_th", "_key")).alias("x")).select(F.col("x._th").alias("h1"), F.col("x._key").alias("k1"))
    if wanted.count() <= BROADCAST_ROWS:
        one = F.broadcast(one)
    chosen = source.join(one, (F.col("_th") == F.col("h1")) & F.col("_key").eqNullSafe(F.col("k1")), "left_semi").select("_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                sets = shingle_sets(part.column(0).to_pylist(), ngram)
                yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["c", "s"])

    return map_arrow(chosen, run, "c bigint, s binary").dropDuplicates(["c"])


def overlaps(sets: list[np.ndarray], dense: int = 16, width: int = 2048) -> np.ndarray:
    """Common elements of each two sets."""
    rows = len(sets)
    owner = np.repeat(np.arange(rows), [len(s) for s in sets])
    members = np.concatenate(sets)
    order = np.argsort(members, kind="stable")
    members, owner = members[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], members[1:] != members[:-1])))
    counts = np.diff(np.concatenate((starts, [len(members)])))
    total = np.zeros((rows, rows), dtype=np.float32)
    common = np.flatnonzero(counts >= dense)
    for i in range(0, len(common), width):
        some = common[i : i + width]
        incidence = np.zeros((rows, len(some)), dtype=np.float32)
        at = np.concatenate([np.arange(starts[c], starts[c] + counts[c]) for c in some])
        incidence[owner[at], np.repeat(np.arange(len(some)), counts[some])] = 1
        total += incidence @ incidence.T
    flat = np.zeros(rows * rows, dtype=np.int64)
    for size in range(2, dense):
        columns_ = starts[counts == size]
        a, b = np.triu_indices(size, 1)
        step = (1 << 18) // len(a)
        for i in range(0, len(columns_), step):
            group = owner[columns_[i : i + step, None] + np.arange(size)]
            flat += np.bincount((group[:, a] * rows + group[:, b]).ravel(), minlength=rows * rows)
    rare = flat.reshape(rows, rows)
    return total.astype(np.int64) + rare + rare.T


def forest(sets: list[np.ndarray], side: np.ndarray | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Edges that span the links of the sets; with `side`, of links between the two sides only."""
    sizes = np.array([len(s) for s in sets])
    common = overlaps(sets)
    link = np.triu(100 * common >= percent * (sizes[:, None] + sizes[None, :] - common), 1)
    if side is not None:
        link &= side[:, None] != side[None, :]
    root = list(range(len(sets)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for a, b in zip(*(x.tolist() for x in np.nonzero(link)), strict=True):
        ra, rb = top(a), top(b)
        if ra != rb:
            root[rb] = ra
            edges.append((a, b))
    return edges


def blocks_of(met: DataFrame) -> DataFrame:
    """(lead, c, n, chunks): each block's classes, and how many chunks it is cut into.

    Classes are dealt by column once, and a window of at most HOT_ROWS rows finds each column's leader; the few hot
    columns' leaders are aggregated and broadcast, and their classes stay where they are.
    """
    best, column = F.max(F.struct("w", "c")), Window.partitionBy("h")
    counts = met.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT_ROWS)
    hot = F.broadcast(checkpoint(counts.orderBy(F.desc("k"), "h").limit(HOT_KEYS).select("h")))
    few, many = met.join(hot, "h", "left_anti"), met.join(hot, "h", "left_semi")
    led = few.withColumns({"x": best.over(column), "k": F.count(F.lit(1)).over(column)}).where("k > 1").select(F.col("x.c").alias("lead"), "c", "n")
    hot_led = many.join(F.broadcast(many.groupBy("h").agg(best.alias("x"))), "h").select(F.col("x.c").alias("lead"), "c", "n")
    blocks = checkpoint(led.unionByName(hot_led).distinct())
    many = F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("n") * 8 / CHUNK_BYTES))
    cut = blocks.groupBy("lead").agg(many.alias("chunks"), F.count(F.lit(1)).alias("k")).where("chunks > 1")
    return join_hot(blocks, checkpoint(cut), ["lead"], "left", size="k").withColumn("chunks", F.coalesce("chunks", F.lit(1)))


def chunk_rows(blocks: DataFrame) -> DataFrame:
    """(lead, chunk, side, c, n): each chunk's classes, and its block's leader with them."""
    own = F.array(F.pmod(F.xxhash64("c"), F.col("chunks")))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)
    chunk = F.explode(F.when(F.col("c") == F.col("lead"), every).otherwise(own))
    return blocks.select("lead", chunk.alias("chunk"), F.lit(0).alias("side"), "c", "n")


def stray_rows(blocks: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(lead, chunk, side, c, n): the classes outside of their block's largest component (side 0) with the classes of the
    block (side 1), for each two chunks that the size bound lets link.

    A band of sizes is so wide that classes more than one band apart can't link.
    """
    width = math.log(100 / percent) * (1 + 1e-6)
    banded = blocks.withColumn("band", F.floor(F.log("n") / width))
    rooted = checkpoint(join_hot(banded, labels, ["c"], "left").select("lead", "c", "n", "band", F.coalesce("root", "c").alias("root")))
    most = rooted.groupBy("lead", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("lead").agg(F.max_by("root", F.struct("k", "root")).alias("main"))
    marked = join_hot(rooted, checkpoint(most), ["lead"]).withColumn("stray", F.col("root") != F.col("main"))

    def cells(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        many = F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("n") * 8 / CHUNK_BYTES))
        counts = checkpoint(rows.groupBy("lead", "band").agg(many.alias("parts")))
        placed = join_hot(rows, counts, ["lead", "band"]).withColumn("cell", F.pmod(F.xxhash64("c"), F.col("parts"))).select("lead", "band", "cell", "c", "n")
        return placed, counts.select("lead", "band", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("cell"))

    strays, stray_cells = cells(marked.where("stray"))
    others, other_cells = cells(marked)
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("near")
    pairs = stray_cells.select("lead", F.col("band").alias("b"), F.col("cell").alias("s"), near).withColumnRenamed("near", "band")
    pairs = checkpoint(pairs.join(other_cells, ["lead", "band"]))
    name = F.xxhash64("b", "s", "band", "cell").alias("chunk")
    left = strays.withColumnsRenamed({"band": "b", "cell": "s"}).join(pairs, ["lead", "b", "s"]).select("lead", name, F.lit(0).alias("side"), "c", "n")
    right = others.join(pairs, ["lead", "band", "cell"]).select("lead", name, F.lit(1).alias("side"), "c", "n")
    return left.unionByName(right)


def linked_classes(rows: DataFrame, sets: DataFrame, percent: int, across: bool = False) -> DataFrame:
    """Edges (a, b) that span all links within the chunks, or between the two sides of each."""
    count = groups_for(rows.sparkSession, rows.agg(F.sum(F.col("n") * 8)).first()[0])
    work = rows.join(sets, "c").withColumn("task", F.pmod(F.xxhash64("lead", "chunk"), F.lit(count)))

    def multiply(table_: pa.Table) -> pa.Table:
        key = [table_.column(x).to_numpy() for x in ("lead", "chunk")]
        c, side = table_.column("c").to_numpy(), table_.column("side").to_numpy()
        raw = [x.as_buffer() for x in table_.column("s")]
        order = np.lexsort((c, *key))
        cuts = np.flatnonzero(np.any([np.diff(k[order]) != 0 for k in key], axis=0)) + 1
        a: list[int] = []
        b: list[int] = []
        for block in np.split(order, cuts):
            if len(block) > 1:
                for x, y in forest([np.frombuffer(raw[r], np.uint64) for r in block], side[block] if across else None, percent):
                    a.append(int(c[block[x]])), b.append(int(c[block[y]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return map_groups(work.select("task", "lead", "chunk", "side", "c", "s"), "task", multiply, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(c, root): the least id that each node of the edges reaches.

    Each round takes the least label of the neighbours and then the label of the label, until no label
    changes; rounds are logarithmic in the longest path.  Every round is checkpointed.
    """
    both = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.col("c")).alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("c", "b"), "b").groupBy(F.col("a").alias("c")).agg(F.min("root").alias("least"))
        moved = labels.join(near, "c", "left").select("c", "root", F.least("root", "least").alias("low"))
        jump = labels.select(F.col("c").alias("low"), F.col("root").alias("far"))
        new = checkpoint(moved.join(jump, "low", "left").select("c", F.least("low", "far").alias("new"), "root"))
        if new.where(F.col("new") != F.col("root")).isEmpty():
            return labels
        labels = new.select("c", F.col("new").alias("root"))


def class_components(source: DataFrame, members: DataFrame, percent: int = PERCENT, ngram: int = NGRAM) -> DataFrame:
    """(c, root) for the classes that link with another."""
    n = F.col("n").cast("int")
    classes = members.where("n > 0").groupBy("c", "n").agg(F.count(F.lit(1)).alias("rows"))
    classes = classes.withColumn("p", F.least(n, _missing(n, percent) + _shared(n, percent)))
    blocks = blocks_of(checkpoint(candidates(source, classes, percent, ngram)))
    # The sets aren't written: they are dealt by class, as the join with the rows needs them.
    sets = class_sets(source, members, checkpoint(blocks.select("c").distinct()), ngram)
    edges = checkpoint(linked_classes(chunk_rows(blocks), sets, percent))
    labels = components(edges)
    large = blocks.where("chunks > 1")
    if large.isEmpty():
        return labels
    rows = checkpoint(stray_rows(large, labels, percent))
    if rows.isEmpty():
        return labels
    sets = class_sets(source, members, checkpoint(rows.select("c").distinct()), ngram)
    return components(edges.union(checkpoint(linked_classes(rows, sets, percent, across=True)).where("a <> b")))


def rooted_members(docs: DataFrame, key: str, text: str, percent: int, ngram: int) -> DataFrame:
    """_key, _th, n, c of each row with the root of its component."""
    source = keyed(docs, key, text)
    members = checkpoint(members_of(source, ngram))
    labels = class_components(source, members, percent, ngram)
    return join_hot(members, labels, ["c"], "left").select("_key", "_th", "n", "c", F.coalesce("root", "c").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, ngram: int = NGRAM) -> DataFrame:
    """key, n_shingles, component_id (the least key of the component) and class_id of each row."""
    rooted = checkpoint(rooted_members(docs, key, text, percent, ngram))
    # A row alone in its component is its least.
    least = rooted.where("n > 0").groupBy("root").agg(F.min("_key").alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1")
    joined = join_hot(rooted, checkpoint(least), ["root"], "left", size="k")
    return joined.select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("_key")).otherwise(F.coalesce("least", "_key")).alias("component_id"), F.col("c").alias("class_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, ngram: int = NGRAM) -> DataFrame:
    """One row of each component: of the least key (a null one only if it has no other), and of that the text of least hash.

    Rows are told apart by key and text, so another text under the key of a removed row stays.  Rows with an
    empty set are in no component and all stay.
    """
    rows = rooted_members(docs, key, text, percent, ngram).where("n > 0").groupBy("root", F.col("_key").alias("_k"), "_th").agg(F.count(F.lit(1)).alias("times"))
    rows = checkpoint(rows)
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("_k").isNull().alias("none"), "_k", "_th")).alias("first"), F.sum("times").alias("k"))
    # A component of a single row has nothing to remove.
    first = checkpoint(least.where("k > 1").select("root", F.col("first._k").alias("_k1"), F.col("first._th").alias("_h1"), "k"))
    stays = F.col("_k").eqNullSafe(F.col("_k1")) & (F.col("_th") == F.col("_h1"))
    told = checkpoint(join_hot(rows, first, ["root"], size="k").withColumn("_stays", stays).where(~F.col("_stays") | (F.col("times") > 1)).select(F.col("_k").alias("__key"), F.col("_th").alias("__told"), F.col("_stays").alias("__stays")))
    if told.count() <= BROADCAST_ROWS:
        told = F.broadcast(told)
    names = [f"`{c}`" for c in docs.columns]
    marked = docs.withColumn("__hash", F.xxhash64(F.col(f"`{text}`").cast("string"))).join(told, F.col(f"`{key}`").eqNullSafe(F.col("__key")) & (F.col("__hash") == F.col("__told")), "left")
    kept = marked.where(F.col("__stays").isNull()).select(*names)
    if told.where("__stays").isEmpty():
        return kept
    return kept.union(marked.where("__stays").dropDuplicates(["__key", "__hash"]).select(*names))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
ORACLE_OP6 = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + {NGRAM - 1}], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {NGRAM - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= {PERCENT} * (p.n + q.n - k)),
b AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = w.doc_id"""
