"""Packing by power-of-two decomposition.

A document of n ids is cut into floor(n / limit) pieces of `limit` ids and then into one piece for each
bit of the rest, longest first, so every piece has a power-of-two length.  Pieces of equal length share
a bucket; each piece is a sequence of its own in its bucket, so no sequence crosses documents and none
is padded.  Sequence numbers hold the bucket in the low bits, above them the piece's number in the
task; they are unique in a result and the same when a lost task runs again.

Edge cases: a null or empty text has only the closing id; repeated rows are packed each; very long
texts give many pieces; an empty table gives an empty result; an extra column that has the name of a
result column gives way to it.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, slices

LIMIT, END_ID = 2048, 1
#: Bits of a sequence number that hold the bucket.
BUCKET_BITS = 6


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies spell each byte as a printable letter: itself, or else the next one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts by a byte-level BPE vocabulary file.

    Where ids are the merges' order, tiktoken gives the ids of the `tokenizers` library several times faster.
    That library itself encodes texts that hold a special token, or a stretch without a word
    boundary of over LONG bytes, for which tiktoken's time grows with the square.
    """

    LONG = 1000

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, self.special = whole["model"], [t["content"] for t in whole.get("added_tokens", [])]
        letters = _byte_of_letter()
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        if sorted(ranks.values()) != list(range(len(ranks))) or any(model["vocab"]["".join(m)] != 256 + i for i, m in enumerate(pairs)):
            raise ValueError("the vocabulary's ids must follow its merges")
        self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def tokenizer(self):
        """Loaded when a text needs it: most workers never do, and it takes memory for good."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        stretch = np.diff(np.flatnonzero(raw == 0x20), prepend=-1, append=len(raw)).max()
        if stretch > self.LONG or " " * self.LONG in text or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()


@cache
def encoder_of(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)


def piece_lengths(n: int, limit: int = LIMIT) -> list[int]:
    """Powers of two that sum to n, longest first, none above limit (a power of two itself)."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << b for b in range(limit.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, path: str | None = None, ids: bool = True) -> DataFrame:
    """One row per piece: key, start, length, bucket, ids_crc32, doc_tokens, sequence_id, offset and,
    if `ids`, the token ids themselves."""
    if limit & limit - 1 or limit < 1:
        raise ValueError("limit must be a power of two")
    path = path or tokenizer_path()
    source = docs.select(F.col(key), F.col(text).cast("string"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            for part in slices(batch, 1):
                rows, start, length, crc, total, body = [], [], [], [], [], []
                for i, raw in enumerate(encoder.encode(t or "") for t in part.column(1).to_pylist()):
                    raw += END_ID.to_bytes(4, "little")
                    at = 0
                    for n in piece_lengths(len(raw) // 4, limit):
                        piece = raw[4 * at : 4 * (at + n)]
                        rows.append(i), start.append(at), length.append(n), crc.append(zlib.crc32(piece)), total.append(len(raw) // 4)
                        if ids:
                            body.append(np.frombuffer(piece, dtype="<i4"))
                        at += n
                out = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64())]
                names = [key, "start", "length", "ids_crc32", "doc_tokens"]
                if ids:
                    out.append(pa.array(body, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * ids
    pieces = map_arrow(source, run, schema)
    bucket = F.log2("length").cast("int")
    number = F.shiftleft(F.monotonically_increasing_id(), BUCKET_BITS)
    return pieces.withColumns({"bucket": bucket, "sequence_id": number + bucket, "offset": F.lit(0).cast("bigint")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Token ids as one Parquet folder per piece length, ready for batches without padding."""
    pieces.write.partitionBy("bucket").parquet(path)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), ids=False)
