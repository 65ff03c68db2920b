"""Shared plumbing: reading tables, mapping text columns in bounded Arrow slices, checkpoints."""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.session import spread

#: Text bytes that one step of a mapped function sees at a time.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch; a batch of texts is held by the executor and by its worker.
BATCH_ROWS = 512
#: Rows of two 64-bit values that may be broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 500_000
#: Rows of one key from which a join splits it, and the most keys that it splits.
HOT_ROWS, HOT_KEYS = 20_000, 10_000

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents for operators that read whole texts: a small table of few files is dealt to all cores."""
    return spread(table(spark, sf_dir, "documents"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a local master may do with one of this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "tidewell-checkpoints"))


def checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Hand freed memory of a worker back to the system: workers serve many tasks, of other operators too."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_arrow(source: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow in small batches."""
    small_batches(source.sparkSession)

    @wraps(run)
    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return source.mapInArrow(lean, schema)


def map_groups(rows: DataFrame, key: str, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """applyInArrow; the caller sees to groups of a bounded size."""
    small_batches(rows.sparkSession)

    @wraps(run)
    def lean(table_: pa.Table) -> pa.Table:
        made = run(table_)
        give_back()
        return made

    return rows.groupBy(key).applyInArrow(lean, schema)


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def join_hot(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner", size: str | None = None) -> DataFrame:
    """rows joined with a table of distinct keys, where some keys may have a large share of the rows.

    A written table of few rows is broadcast.  Else the rows of keys with over HOT_ROWS rows are dealt to several
    tasks, each of which gets a copy of the key's row of `small`.  size: a column of `small` that has the number of
    rows of its key; it is left out, and rows aren't counted.
    """
    counts = None
    if size is not None:
        counts, small = small.select(*on, F.col(size).alias("_n")), small.drop(size)
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), on, how)
    if counts is None:
        counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.where(F.col("_n") > HOT_ROWS)
    hot = checkpoint(counts.orderBy(F.desc("_n"), *on).limit(HOT_KEYS).select(*on, F.ceil(F.col("_n") / HOT_ROWS).alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_part", F.pmod(F.xxhash64(*rows.columns), parts)).drop("_parts")
    copies = small.join(F.broadcast(hot), on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("_parts")
    return dealt.join(copies, [*on, "_part"], how).drop("_part")


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about `limit` text bytes, one row at least."""
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_text(
    df: DataFrame,
    text: str,
    added: str,
    make: Callable[[], Callable[[list], list]],
    keep: list[str] | None = None,
    also: list[str] = (),
) -> DataFrame:
    """Append columns computed from whole texts.

    added: DDL of the new columns; a kept column of the same name gives way to the new one.
    make() runs once per task and returns fn(texts, *also) -> one list or array per new column.
    keep: input columns to carry along (all of them by default).
    """
    new = T._parse_datatype_string(added)
    names = set(new.fieldNames())
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    needed = list(dict.fromkeys([*keep, text, *also]))
    source = df.select(*[f"`{c}`" for c in needed])
    schema = T.StructType([source.schema[c] for c in keep] + new.fields)
    at, kept, other = needed.index(text), [needed.index(c) for c in keep], [needed.index(c) for c in also]
    types = [_arrow_type(f.dataType) for f in new.fields]
    out_names = keep + new.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for piece in slices(batch, at):
                got = fn(piece.column(at).to_pylist(), *[piece.column(i).to_pylist() for i in other])
                arrays = [a if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(got, types, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(i) for i in kept] + arrays, names=out_names)

    return map_arrow(source, run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def hash_share(order: Column, wanted: int, total: Column) -> Column:
    """Whether a row's hash lies in the least part that holds about three times the wanted rows.

    A sample of the least hashes is then picked from these few, instead of from the best of each task.
    """
    return F.pmod(order, F.lit(1 << 31)) < F.lit(float(1 << 31)) * 3 * wanted / total


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator, on unsigned 64-bit arrays."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            values = np.full(size, base, dtype=np.uint64)
            values[0] = 1
            _powers[key] = np.multiply.accumulate(values)
    return _powers["up"][:n], _powers["down"][:n]


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of symbols[start:end] for many spans at once, equal where the contents are equal.

    A prefix sum of mixed symbols times powers of an odd base gives each span's polynomial, which
    is moved back to exponent 0 and mixed together with its length.
    """
    n = len(symbols)
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _power_table(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    if symbols.dtype == np.uint8:
        coded = mix64(np.arange(256, dtype=np.uint64) + U64(1))[symbols]
    else:
        coded = mix64(symbols.astype(np.uint64) + U64(1))
    np.cumsum(coded * up[:n], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: Bytes with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_mask(is_word: Callable[[int], bool]) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)])


#: Words of the n-gram join: everything but white space [\x20\x09-\x0D].
SPACED = byte_mask(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words of decontamination: digits, ASCII letters and all non-ASCII characters.
ALNUM = byte_mask(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)


def word_spans(texts: list, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, the words' starts and ends there, and how many each text has."""
    coded = [(t or "").encode() for t in texts]
    raw = np.frombuffer(b"\n".join(coded), dtype=np.uint8)
    begins = np.cumsum([0, *(len(c) + 1 for c in coded)])[: len(texts)]
    word = is_word[raw]
    word[begins[1:] - 1] = False
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    counts = np.bincount(np.searchsorted(begins, starts, side="right") - 1, minlength=len(texts))
    return LOWER[raw], starts, ends, counts


def word_hashes(texts: list, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of many texts in order, and how many words each text has."""
    raw, starts, ends, counts = word_spans(texts, is_word)
    return span_hashes(raw, starts, ends), counts


def id_crc(column) -> Column:
    """crc32 of an id as text; of the empty string for null."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hashes of each n consecutive word hashes."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    last = len(words) - n + 1
    total = words[:last] * U64(_BASE)
    for i in range(1, n):
        total = (mix64(total) + words[i : last + i]) * U64(_BASE)
    return mix64(total)
