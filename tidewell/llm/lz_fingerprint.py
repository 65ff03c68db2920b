"""Document fingerprints from a Lempel-Ziv (LZ78) parse.

A text is parsed into dictionary phrases: each phrase is the shortest piece not yet in the dictionary.
The set of phrases is hashed, and the `SIZE` least hashes are the signature, so the share of common
hashes among the least of the union estimates the Jaccard likeness of two dictionaries, which behaves
like a compression distance.

Neighbours: the query also fingerprints each text with its second half replaced by the head of the next
document in doc_id order.  Rows are dealt into ranges of doc_id whose bounds are quantiles; the first row
of each range also goes to the range before it, so each range is complete and texts are shuffled once.

Edge cases: null texts count as empty; an empty text has the empty fingerprint, two of which have
likeness 1; rows of equal doc_id follow in the order of their texts; the next document of a sole row is
itself; null ids come first; very long texts are parsed whole, one at a time; other columns of the input, whatever
their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, shuffle_partitions, slices, span_hashes, table

SIZE = 128


def parse(text: str, phrases: dict | None = None, open_phrase: str = "") -> tuple[dict, str]:
    """Phrases in order (a dict's keys), and the last one if it is in the dictionary already."""
    phrases = {"": None} if phrases is None else phrases
    for c in text:
        open_phrase += c
        if open_phrase not in phrases:
            phrases[open_phrase] = None
            open_phrase = ""
    return phrases, open_phrase


def signature(text: str, phrases: dict, size: int = SIZE) -> np.ndarray:
    """The least 32-bit phrase hashes.  The phrases, end to end, are the text's beginning."""
    symbols = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter(map(len, phrases), dtype=np.int64, count=len(phrases)))[1:]
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    return np.unique((span_hashes(symbols, starts, ends) >> np.uint64(32)).astype(np.uint32))[:size]


def fingerprint(text: str) -> np.ndarray:
    return signature(text, parse(text)[0])


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    if len(a) == 0 and len(b) == 0:
        return 1.0
    union = np.union1d(a, b)[:size]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


def spelled(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def both_signatures(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Of the text, of the edited text, and that text.  They are parsed together up to the cut."""
    half = len(text) // 2
    head = text[: len(text) - half]
    phrases, rest = parse(head)
    edited = head + following[:half]
    other = signature(edited, parse(following[:half], dict(phrases), rest)[0])
    return signature(text, parse(text[len(head) :], phrases, rest)[0]), other, edited


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """One fingerprint per document: key, n_chars, fingerprint."""
    source = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).to_pylist()
                sigs = [spelled(signature(t, parse(t)[0], size)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(sigs, pa.string())], names=[key, "n_chars", "fingerprint"])

    return map_arrow(source, run, f"`{key}` {kind}, n_chars bigint, fingerprint string")


def _range_of(key: str, edges: list[int]) -> Column:
    """How many of the sorted edges lie below the key (0 for null), looked up in two steps."""
    step = max(1, math.isqrt(len(edges)))
    literal = F.array(*map(F.lit, edges)) if edges else F.array().cast("array<bigint>")
    coarse = F.array(*map(F.lit, edges[step - 1 :: step])) if edges else literal
    passed = F.size(F.filter(coarse, lambda b: b < F.col(key))) * step
    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(passed + F.size(F.filter(F.slice(literal, passed + 1, step), lambda b: b < F.col(key))))


def compare_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row."""
    source = docs.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    count = shuffle_partitions(docs.sparkSession)
    shares = [i / count for i in range(1, count)]
    bounds = source.select(F.percentile_approx("k", F.array(*map(F.lit, shares)), F.lit(10_000))).first()[0] if shares else None
    ranged = source.withColumn("p", _range_of("k", sorted(set(bounds or []))))
    # One row per range reaches the driver: its least key.
    least = F.coalesce(F.col("k"), F.lit(-(2**63)))
    filled = sorted((r["p"], r["k0"]) for r in ranged.groupBy("p").agg(F.min(least).alias("k0")).collect()) or [(0, 0)]
    # The first row of each range also ends the range before it, and the very first ends the last.
    lead = {p: filled[i - 1][0] for i, (p, _) in enumerate(filled)}
    starts = F.create_map(*[F.lit(x) for pair in filled for x in pair])
    before = F.create_map(*[F.lit(x) for pair in lead.items() for x in pair])
    halo = ranged.where(least == starts[F.col("p")]).groupBy("p").agg(F.min(F.struct("k", "t")).alias("x")).select("x.k", "x.t", before[F.col("p")].alias("p"), F.lit(True).alias("halo"))
    dealt = ranged.withColumn("halo", F.lit(False)).unionByName(halo).repartitionById(filled[-1][0] + 1, F.col("p"))
    rows = dealt.sortWithinPartitions("halo", F.col("k").asc_nulls_first(), "t").select("k", "t", "halo")
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last = waiting = None
        for batch in batches:
            for part in slices(batch, 1):
                for k, t, ends in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if last is not None:
                        mine, edit, edited = both_signatures(last[1], t)
                        if waiting is not None:
                            yield _row(waiting, mine)
                        waiting = last[0], len(last[1]), sha256(edited.encode()).hexdigest(), mine, edit
                    last = k, t
                    if ends:
                        yield _row(waiting, fingerprint(t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = compared(batches)
        while some := list(islice(rows, 256)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=names)

    result = map_arrow(rows, run, f"`{key}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return result.withColumn(key, F.col(key).cast(docs.schema[key].dataType))


def _row(waiting: tuple, following: np.ndarray) -> tuple:
    k, n, digest, mine, edit = waiting
    return k, n, digest, spelled(mine), spelled(edit), likeness(mine, edit), likeness(mine, following)


def op3_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(table(spark, sf_dir, "documents"))
