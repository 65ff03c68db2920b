"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and word beginnings of `STEM` bytes, each hashed into 2**BITS buckets.  Buckets that tell
toxic from other documents in the training sample (chi-square test) become features; a document has a
feature or hasn't.  The machine adds a linear weight for each feature and, for each pair of them, the
product of two learned factor vectors, so a pair such as insult and group mention counts for more than
both weights.  It is trained by full-batch Adam on the logistic loss.

Training uses at most `TOXIC_ROWS` toxic and `OTHER_ROWS` other labelled documents, those with the least
hash of the id; both bounds are parameters.  Of a document labelled more than once, one toxic label
makes it toxic; of several rows under one id, the text of the least hash is learned.  Buckets are counted in the
executors: what reaches the driver are at most `MOST_FEATURES` features and, for each sampled document, which of these it has.

Edge cases: null and empty texts get the score of a document without features; rows with a null id, text or
label aren't learned from; very long texts are read whole; without labels of both kinds every score is the share of toxic labels (0 without
labels); repeated rows each get their score; an empty table gives an empty result; result columns replace
columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, checkpoint, documents, hash_share, id_crc, map_text, span_hashes, table, word_spans

BITS, STEM, FACTORS = 20, 6, 6
TOXIC_ROWS, OTHER_ROWS, MOST_FEATURES = 3000, 7000, 4096
#: Least chi-square statistic and least documents of a feature.
CHI_SQUARE, SUPPORT = 25.0, 3
STEPS, THRESHOLD = 450, 0.7


def terms(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, bucket) pairs of all texts, sorted."""
    raw, starts, ends, counts = word_spans([(t or "").lower() for t in texts], ALNUM)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), counts)
    words = span_hashes(raw, starts, ends)
    stems = span_hashes(raw, starts, np.minimum(ends, starts + STEM)) ^ np.uint64(0x5BD1E995 << 32)
    bucket = np.concatenate([words, stems]) >> np.uint64(64 - BITS)
    pairs = np.unique((np.concatenate([owner, owner]) << BITS) | bucket.astype(np.int64))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass
class Machine:
    #: Feature number of each bucket, or -1.
    feature: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, owner: np.ndarray, features: np.ndarray, rows: int) -> np.ndarray:
        total = self.bias + np.bincount(owner, self.linear[features], minlength=rows)
        for k in range(self.factors.shape[1]):
            v = self.factors[features, k]
            total += 0.5 * (np.bincount(owner, v, minlength=rows) ** 2 - np.bincount(owner, v * v, minlength=rows))
        return total

    def scores(self, texts: list) -> np.ndarray:
        owner, bucket = terms(texts)
        features = self.feature[bucket]
        has = features >= 0
        return 1 / (1 + np.exp(-np.clip(self.margins(owner[has], features[has], len(texts)), -30, 30)))


def select_features(sample: DataFrame) -> list[int]:
    """The buckets that tell toxic documents best, by the chi-square statistic of having one and being toxic."""
    rows, positive = sample.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not rows or not 0 < positive < rows:
        return []
    having, both = F.col("having"), F.col("both")
    counts = sample.select("y", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("having"), F.sum("y").alias("both"))
    expected = having * positive / rows
    chi = F.pow(both - expected, 2) * rows / (having * (1 - having / rows) * positive * (1 - positive / rows))
    told = counts.where((having >= SUPPORT) & (having < rows)).withColumn("chi", chi).where(F.col("chi") >= CHI_SQUARE)
    return [r["bucket"] for r in told.orderBy(F.desc("chi"), "bucket").limit(MOST_FEATURES).collect()]


def train(samples: list[tuple[int, list[int]]], buckets: list[int], seed: int = 11) -> Machine:
    """A machine from (label, buckets) of documents, of which only the given buckets count."""
    labels = np.array([y for y, _ in samples], dtype=float)
    if len(labels) == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        odds = np.log((share + 1e-9) / (1 - share + 1e-9))
        return Machine(np.full(1 << BITS, -1, np.int32), float(odds), np.zeros(1), np.zeros((1, FACTORS)))
    owner = np.repeat(np.arange(len(samples)), [len(b) for _, b in samples])
    bucket = np.concatenate([np.asarray(b, dtype=np.int64) for _, b in samples])
    feature = np.full(1 << BITS, -1, dtype=np.int32)
    feature[np.asarray(buckets, dtype=np.int64)] = np.arange(len(buckets))
    features = feature[bucket]
    owner, features = owner[features >= 0], features[features >= 0]
    count = max(1, int(feature.max()) + 1)
    share = labels.mean()
    parameters = [np.array([np.log(share / (1 - share))]), np.zeros(count), np.random.default_rng(seed).normal(0, 0.02, (count, FACTORS))]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for step in range(1, STEPS + 1):
        bias, linear, factors = parameters
        margin = Machine(feature, float(bias[0]), linear, factors).margins(owner, features, len(labels))
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels) / len(labels)
        at = error[owner]
        grads = [np.array([error.sum()]), np.bincount(features, at, minlength=count) + 1e-7 * linear, np.empty_like(factors)]
        for k in range(FACTORS):
            v = factors[features, k]
            sums = np.bincount(owner, v, minlength=len(labels))
            grads[2][:, k] = np.bincount(features, at * (sums[owner] - v), minlength=count) + 1e-3 * factors[:, k]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            parameters[i] = parameters[i] - 0.1 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return Machine(feature, float(parameters[0][0]), parameters[1], parameters[2])


def training_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS) -> DataFrame:
    """(id, y, buckets) of at most toxic_rows and other_rows documents, written; their ids are few enough to broadcast."""
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (id_crc(key) % 3 != 1))
    known = usable.groupBy(F.col(key).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    hashed = F.pmod(F.xxhash64("id"), F.lit(1 << 31))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).where("y IN (0, 1)").collect()}

    def least(y: int, rows: int) -> DataFrame:
        few = known.where((F.col("y") == y) & hash_share(hashed, rows, F.lit(max(1, counts.get(y, 0)))))
        return few.orderBy(hashed, "id").limit(rows)

    chosen = checkpoint(least(1, toxic_rows).unionByName(least(0, other_rows)))
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL")
    single = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def make():
        def fn(texts: list) -> list:
            owner, bucket = terms(texts)
            return [np.split(bucket.astype(np.int32), np.searchsorted(owner, np.arange(1, len(texts))))]

        return fn

    return checkpoint(map_text(single, "text", "buckets array<int>", make, keep=["id", "y"]))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS) -> Machine:
    """A machine of the labelled documents that aren't held out."""
    sample = training_sample(docs, labels, key, text, label, toxic_rows, other_rows)
    buckets = select_features(sample)
    wanted = F.array(*map(F.lit, buckets)) if buckets else F.array().cast("array<int>")
    rows = sample.select("id", "y", F.array_intersect("buckets", wanted).alias("buckets")).toArrow()
    ids, y = rows.column("id").to_pylist(), rows.column("y").to_pylist()
    has = [b.values.to_numpy() for b in rows.column("buckets")]
    return train([(y[i], has[i]) for i in sorted(range(len(ids)), key=lambda i: ids[i])], buckets)


def score(docs: DataFrame, machine: Machine, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score and predicted to the kept columns."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        def fn(texts: list) -> list:
            got = shared.value.scores(texts)
            return [got, (got >= threshold).astype(np.int32)]

        return fn

    return map_text(docs, text, "score double, predicted int", make, keep)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "labels")
    machine = learn(docs, labels)
    return score(docs, machine, keep=["doc_id"]).select("doc_id", (id_crc("doc_id") % 3 == 1).alias("held_out"), "score", "predicted")
