"""Benchmark decontamination by a prefix-filtered set join.

Each item is cut into windows of 13 consecutive words (an item of fewer is one window).  A window's
tokens are its shingles of `SHINGLE` words.  All tokens are ordered by rarity, counted over the whole
corpus; since a window must occur whole, the necessary prefix of that order is its rarest token.  A
document word starts a candidate where a prefix token occurs: the token's offset in the window fixes
where the window would begin (positional bound), the window must fit into the document (length bound),
and then all its words are compared (exact containment).  Words and windows are compared as 64-bit hashes of
single words, so a window is taken for another only if 13 of them collide.

The benchmark is taken in blocks of at most `block_windows` windows; a long item may lie in several.  A
block's index is flat arrays (under 100 bytes a window) and is sent to all tasks.  With one block, its hits are the
result, and no row is shuffled.  With more, each block is a pass of its own over the documents, after which
its index is let go; its hits, which only texts with benchmark passages have, are written and united by
text, then joined to the documents' ids.

Edge cases: null and empty texts have no words (n_words 0, not contaminated); items that are null or
have no words have no window; repeated items each count, those of one id as one; a word in several windows, or in
equal ones of several items, counts as hit once; repeated rows each get a result; very long texts are searched
whole; an empty benchmark or an empty corpus gives no hits; result columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, checkpoint, documents, join_hot, map_arrow, map_text, ngram_hashes, slices, span_hashes, table, word_hashes

WINDOW, SHINGLE, BLOCK_WINDOWS = 13, 3, 200_000
#: Candidates that are compared at a time.
STEP = 1 << 16


class Index:
    """Windows of a block of items, by their tokens.

    items: (item, word hashes, first, last) with the numbers of the item's first and last window of this block.
    """

    def __init__(self, items: list[tuple[object, np.ndarray, int, int]]):
        parts, starts, sizes, owner, at = [], [], [], [], 0
        for number, (_, words, first, last) in enumerate(items):
            size = min(WINDOW, len(words))
            parts.append(words[first : last + size])
            starts.append(at + np.arange(last - first + 1))
            sizes.append(np.full(last - first + 1, size))
            owner.append(np.full(last - first + 1, number))
            at += len(parts[-1])
        none = np.zeros(0, np.int64)
        self.names = [str(item) for item, *_ in items]
        self.words = np.concatenate([*parts, np.zeros(0, np.uint64)])
        starts, sizes, owner = (np.concatenate([*x, none]) for x in (starts, sizes, owner))
        hashes = span_hashes(self.words, starts, starts + sizes)
        # Equal windows are one, which several items may have.
        self.hashes, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        self.starts, self.sizes = starts[first], sizes[first]
        order = np.argsort(which, kind="stable")
        self.owner, self.owned = owner[order], np.searchsorted(which[order], np.arange(len(first) + 1))
        # A window of fewer words than a shingle has a token of its own length.
        self.token_sizes = sorted({min(SHINGLE, s) for s in set(self.sizes.tolist())})
        found = [self._window_tokens(size) for size in self.token_sizes]
        self.tokens = np.unique(np.concatenate([t for _, _, t in found] or [np.zeros(0, np.uint64)]))

    def _window_tokens(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, offset, token) of all tokens of one length."""
        grams = ngram_hashes(self.words, size)
        wanted = np.flatnonzero(np.minimum(self.sizes, SHINGLE) == size)
        counts = self.sizes[wanted] - size + 1
        window = np.repeat(wanted, counts)
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return window, offset, grams[self.starts[window] + offset]

    def order(self, frequency: np.ndarray) -> None:
        """Fix each window's prefix token, the rarest (the smallest token among equals), and keep only these."""
        if not len(self.hashes):
            return
        kept = [], [], []
        for size in self.token_sizes:
            window, offset, token = self._window_tokens(size)
            by = np.lexsort((token, frequency[np.searchsorted(self.tokens, token)], window))
            first = by[np.unique(window[by], return_index=True)[1]]
            kept[0].append(token[first]), kept[1].append(offset[first]), kept[2].append(self.sizes[window[first]])
        token, offset, size = map(np.concatenate, kept)
        # What a document's token leads to: the places where a window may begin, and its length.
        leads = np.unique(np.stack([np.searchsorted(self.tokens, token), offset, size]), axis=1)
        used, where = np.unique(leads[0], return_inverse=True)
        self.tokens, self.offset, self.size = self.tokens[used], leads[1], leads[2]
        self.led = np.searchsorted(where, np.arange(len(used) + 1))

    def found(self, words: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a token begins that doesn't cross its document's end, and the token's number."""
        at, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in self.token_sizes if len(self.tokens) else ():
            grams = ngram_hashes(words, size)
            place = np.minimum(np.searchsorted(self.tokens, grams), len(self.tokens) - 1)
            pos = np.flatnonzero(self.tokens[place] == grams)
            pos = pos[pos + size <= ends[owner[pos]]]
            at.append(pos), which.append(place[pos])
        return np.concatenate(at), np.concatenate(which)

    def occurrences(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word in it, window) of all windows that occur, for documents' words end to end."""
        ends = np.cumsum(counts)
        owner = np.repeat(np.arange(len(counts)), counts)
        at, which = self.found(words, ends, owner)
        out = [], [], []
        for i in range(0, len(at), STEP):
            here, token = at[i : i + STEP], which[i : i + STEP]
            many = self.led[token + 1] - self.led[token]
            lead = np.repeat(self.led[token], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            place = np.repeat(here, many)
            begin, size = place - self.offset[lead], self.size[lead]
            doc = owner[place]
            fits = (begin >= ends[doc] - counts[doc]) & (begin + size <= ends[doc])
            begin, size, doc = begin[fits], size[fits], doc[fits]
            if not len(begin):
                continue
            low, high = int(begin.min()), int((begin + size).max())
            hashes = span_hashes(words[low:high], begin - low, begin + size - low)
            window = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            same = (self.hashes[window] == hashes) & (self.sizes[window] == size)
            for k in range(WINDOW):
                live = same & (k < size)
                same[live] = words[begin[live] + k] == self.words[self.starts[window[live]] + k]
            out[0].append(doc[same]), out[1].append((begin - ends[doc] + counts[doc])[same]), out[2].append(window[same])
        return tuple(np.concatenate([*x, np.zeros(0, np.int64)]) for x in out)


def token_frequencies(docs: DataFrame, text: str, index: Index) -> np.ndarray:
    """How many documents have each token; one count per token of a block reaches the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        counts = np.zeros(len(index.tokens), dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                words, n = word_hashes(part.column(0).to_pylist(), ALNUM)
                owner = np.repeat(np.arange(len(n)), n)
                at, which = index.found(words, np.cumsum(n), owner)
                counts += np.bincount(np.unique(owner[at] * (len(counts) + 1) + which) % (len(counts) + 1), minlength=len(counts))
        token = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(counts[token])], names=["token", "n"])

    counted = map_arrow(docs.select(F.col(f"`{text}`").cast("string")), run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    out = np.zeros(len(index.tokens), dtype=np.int64)
    out[counted.column("token").to_numpy()] = counted.column("n").to_numpy()
    return out


def blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[object, np.ndarray, int, int]]]:
    """Items (see Index) whose windows are at most so many; items come to the driver one after another."""
    block, room = [], most
    for row in benchmark.select(F.col(f"`{item}`").alias("i"), F.col(f"`{text}`").alias("t")).where("t IS NOT NULL").orderBy("i", "t").toLocalIterator():
        words, _ = word_hashes([row["t"]], ALNUM)
        first, count = 0, max(1, len(words) - WINDOW + 1) if len(words) else 0
        while first < count:
            some = min(room, count - first)
            block.append((row["i"], words, first, first + some - 1))
            first, room = first + some, room - some
            if not room:
                yield block
                block, room = [], most
    yield block


def hits(docs: DataFrame, text: str, index: Index, keep: list[str]) -> DataFrame:
    """The kept columns with n_words, _spans (disjoint runs of hit words) and _items (sorted)."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def make():
        index = shared.value

        def fn(texts: list) -> list:
            words, counts = word_hashes(texts, ALNUM)
            doc, begin, window = index.occurrences(words, counts)
            spans: list[list] = [[] for _ in texts]
            items: list[set] = [set() for _ in texts]
            for d, b, w in sorted(zip(doc.tolist(), begin.tolist(), window.tolist(), strict=True)):
                end = b + int(index.sizes[w])
                if spans[d] and b <= spans[d][-1]["stop"]:
                    spans[d][-1]["stop"] = max(end, spans[d][-1]["stop"])
                else:
                    spans[d].append({"begin": b, "stop": end})
                items[d].update(index.names[i] for i in index.owner[index.owned[w] : index.owned[w + 1]])
            return [counts, spans, [sorted(x) for x in items]]

        return fn

    return map_text(docs, text, "n_words bigint, _spans array<struct<begin: bigint, stop: bigint>>, _items array<string>", make, keep)


def _covered(spans: Column) -> Column:
    """Words in the union of spans."""
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("reach"))

    def step(x: Column, span: Column) -> Column:
        more = F.greatest(F.lit(0).cast("bigint"), span["stop"] - F.greatest(span["begin"], x["reach"]))
        return F.struct((x["total"] + more).alias("total"), F.greatest(x["reach"], span["stop"]).alias("reach"))

    return F.aggregate(F.array_sort(spans), start, step, lambda x: x["total"])


def united(docs: DataFrame, parts: list[DataFrame], text: str, carried: list[str]) -> DataFrame:
    """Hits of all blocks together, found again by the text's hashes: they depend on the text alone."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    listed = checkpoint(whole.groupBy("_ta", "_tb").agg(F.flatten(F.collect_list("_spans")).alias("_spans"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items")))
    bare = map_text(docs, text, "n_words bigint", lambda: lambda texts: [word_hashes(texts, ALNUM)[1]], [*carried, "_ta", "_tb"])
    joined = join_hot(bare, listed, ["_ta", "_tb"], "left").drop("_ta", "_tb")
    return joined.withColumns({"_spans": F.coalesce("_spans", F.array().cast(listed.schema["_spans"].dataType)), "_items": F.array_sort(F.coalesce("_items", F.array().cast("array<string>")))})


def mark_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256 and contaminated to the kept columns."""
    carried = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "_spans", "_items", "_ta", "_tb")]
    body = F.col(f"`{text}`").cast("string")
    parts, found, keyed = [], None, docs.drop("_ta", "_tb").withColumns({"_ta": F.xxhash64(body), "_tb": F.xxhash64(F.lit(2), body)})
    for block in blocks(benchmark, item, item_text, block_windows):
        if found is not None:
            if not block:
                break
            parts.append(checkpoint(_texts_with_hits(found)))
        index = Index(block)
        index.order(token_frequencies(docs, text, index))
        found = hits(keyed, text, index, [*carried, "_ta", "_tb"])
    found = united(keyed, [*parts, _texts_with_hits(found)], text, carried) if parts else found.drop("_ta", "_tb")
    hit = _covered(F.col("_spans"))
    digest = {"n_hit": hit, "n_items": F.size("_items").cast("bigint"), "items_sha256": F.sha2(F.array_join("_items", ","), 256)}
    marked = found.withColumns(digest).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return marked.drop("_spans", "_items")


def _texts_with_hits(found: DataFrame) -> DataFrame:
    """One row for each text that a block's windows occur in."""
    return found.where(F.size("_items") > 0).select("_ta", "_tb", "_spans", "_items").dropDuplicates(["_ta", "_tb"])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


_TOKENS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_OP4 = f"""
WITH dw AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TOKENS.format("coalesce(text, '')")} AS w FROM documents),
iw AS (SELECT item_id, {_TOKENS.format("coalesce(text, '')")} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS win, least(len(w), 13) AS n
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
        FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
occ AS MATERIALIZED (SELECT r, i, p.n, item_id FROM pos p JOIN win USING (win, n)),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM occ) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""
