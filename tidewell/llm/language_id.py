"""Language identification by a convolutional network over bytes.

Filters of several widths run over the bytes of fixed-length windows; each filter keeps its maximum over
the window, and a softmax layer turns the maxima into language probabilities.  The network is trained in
numpy on labelled windows.  A whole text is covered by windows without gaps; its log-probabilities are
the windows' means, weighted by how many bytes of the window the text fills.

A filter of width w over one-hot bytes is a sum of w table rows, so the forward pass looks up tables of
bytes and of byte pairs instead of multiplying.

Training uses at most `PER_LANGUAGE` rows of each language, those with the least hash of id and length, and of
each a stretch of `STRETCH` characters.  Where languages are so many that this makes over `MOST_ROWS` rows, each has an
equal share of these, one row at least.  The bounds are parameters.

Edge cases: null texts and texts without a letter are `und` with score 0; rows with null language or
text aren't learned from; without rows to learn from everything is `und`; ties go to the first language
in sorted order; very long texts are covered whole; repeated rows each get their result; an empty table gives an empty result; result
columns replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, documents, hash_share, id_crc, join_hot, map_text

WINDOW, FILTERS, WIDTHS = 128, 8, (2, 3, 4)
PER_LANGUAGE, STRETCH, STEPS, BATCH = 1200, 420, 500, 192
#: Most rows that are learned from.
MOST_ROWS = 120_000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    languages: list[str]
    #: For each width, tables (width, 256, FILTERS).
    kernels: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def __post_init__(self):
        self.pairs = [[(k[i][:, None, :] + k[i + 1][None, :, :]).reshape(65536, -1) for i in range(0, len(k) - 1, 2)] for k in self.kernels]

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maxima (windows, filters of all widths), and each filter's responses, from uint8 (n, WINDOW)."""
        two = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        maxima, responses = [], []
        for kernel, pairs in zip(self.kernels, self.pairs, strict=True):
            width = len(kernel)
            room = windows.shape[1] - width + 1
            total = None
            for i, pair in enumerate(pairs):
                part = pair[two[:, 2 * i : 2 * i + room]]
                total = part if total is None else np.add(total, part, out=total)
            if width % 2:
                total += kernel[-1][windows[:, width - 1 : width - 1 + room]]
            maxima.append(total.max(axis=1))
            responses.append(total)
        return np.concatenate(maxima, axis=1) + self.bias, responses

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        hidden = np.maximum(self.pooled(windows)[0], 0)
        logits = hidden @ self.dense + self.offset
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def windows_of(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts, the last of each filled up with 0; how many each text has (one at least)."""
    counts = np.array([max(1, -(-len(t) // size)) for t in texts], dtype=np.int64)
    joined = b"".join(t.ljust(int(n) * size, b"\0") for t, n in zip(texts, counts, strict=True))
    return np.frombuffer(joined, dtype=np.uint8).reshape(-1, size), counts


def train(samples: list[tuple[str, str]], steps: int = STEPS, seed: int = 7) -> Network | None:
    """A network from (language, text) pairs; the same one for the same pairs in any order."""
    samples = sorted(samples)
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return None
    random = np.random.default_rng(seed)
    parts, labels = [], []
    for lang, text in samples:
        got, n = windows_of([text.encode()])
        parts.append(got)
        labels += [languages.index(lang)] * int(n[0])
    data, labels = np.concatenate(parts), np.array(labels)
    members = [np.flatnonzero(labels == i) for i in range(len(languages))]
    kernels = [random.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    wide = FILTERS * len(WIDTHS)
    net = [*kernels, np.zeros(wide, np.float32), random.normal(0, 0.3, (wide, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)]
    first, second = [np.zeros_like(x) for x in net], [np.zeros_like(x) for x in net]
    for step in range(1, steps + 1):
        which = random.integers(0, len(languages), BATCH)
        rows = np.array([members[i][random.integers(len(members[i]))] for i in which])
        x = data[rows].copy()
        for i in np.flatnonzero(random.random(BATCH) < 0.3):  # short texts occur too
            x[i, random.integers(4, WINDOW) :] = 0
        model = Network(languages, net[: len(WIDTHS)], *net[len(WIDTHS) :])
        pooled, responses = model.pooled(x)
        hidden = np.maximum(pooled, 0)
        logits = hidden @ model.dense + model.offset
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(BATCH), which] -= 1
        p /= BATCH
        back = (p @ model.dense.T) * (pooled > 0)
        grads: list[np.ndarray] = []
        for k, (width, response) in enumerate(zip(WIDTHS, responses, strict=True)):
            at = response.argmax(axis=1)  # only the window's maximum gets a gradient
            grad = np.zeros((width, 256, FILTERS), np.float32)
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            filters = np.broadcast_to(np.arange(FILTERS), at.shape)
            for j in range(width):
                np.add.at(grad[j], (np.take_along_axis(x, at + j, axis=1), filters), own)
            grads.append(grad)
        grads += [back.sum(axis=0), hidden.T @ p + 1e-4 * model.dense, p.sum(axis=0)]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            rate = 0.02 * (1 - 0.9 * step / steps)
            net[i] = (net[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(languages, net[: len(WIDTHS)], *net[len(WIDTHS) :])


def training_sample(docs: DataFrame, key: str, text: str, lang: str, per_language: int = PER_LANGUAGE, stretch: int = STRETCH, most: int = MOST_ROWS) -> list[tuple[str, str]]:
    """(language, stretch of text) pairs chosen by hash: at most per_language of each language, and about `most` in all."""
    body = F.col(f"`{text}`").cast("string")
    order = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.char_length(body)), F.lit(1 << 31))
    usable = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), body.alias("body"), order.alias("o"), (id_crc(f"`{key}`") % 4 == 2).alias("held"))
    usable = usable.where(F.col("lang").isNotNull() & F.col("body").isNotNull() & ~F.col("held"))
    counts = checkpoint(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("total")))
    languages = counts.count()
    if not languages:
        return []
    each = max(1, min(per_language, most // languages))
    few = join_hot(usable.select("lang", "body", "o"), counts, ["lang"]).where(hash_share(F.col("o"), each, F.col("total")))
    begin = F.pmod("o", F.greatest(F.char_length("body") - stretch + 1, F.lit(1))).cast("int") + 1
    rows = few.select("lang", F.substr(F.col("body"), begin, F.lit(stretch)).alias("part"), "o").where(F.col("part").rlike(r"\p{L}"))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("o", "part")))
    return [(r["lang"], r["part"]) for r in ranked.where(F.col("n") <= each).select("lang", "part").collect()]


def predict(docs: DataFrame, network: Network | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score to the kept columns."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def make():
        network = shared.value

        def fn(texts: list) -> list:
            named, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            rows = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
            if network is None or not rows:
                return [named, scores]
            coded = [texts[i].encode() for i in rows]
            windows, counts = windows_of(coded)
            logs = np.concatenate([network.log_probabilities(windows[i : i + 1024]) for i in range(0, len(windows), 1024)]).astype(np.float64)
            ends = np.cumsum(counts)
            weight = np.full(len(windows), float(WINDOW))
            weight[ends - 1] = [len(c) - (n - 1) * WINDOW for c, n in zip(coded, counts, strict=True)]
            mean = np.add.reduceat(logs * weight[:, None], ends - counts) / np.array([[len(c)] for c in coded])
            share = np.exp(mean - mean.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            for i, best, row in zip(rows, share.argmax(axis=1), share, strict=True):
                named[i], scores[i] = network.languages[best], float(row[best])
            return [named, scores]

        return fn

    return map_text(docs, text, "lang_pred string, score double", make, keep)


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """A network of the labelled rows that aren't held out; None if there are none."""
    return train(training_sample(docs, key, text, lang))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Train on the labelled rows that aren't held out, and predict all rows."""
    return predict(docs, learn(docs, key, text, lang), text, keep)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(documents(spark, sf_dir), keep=["doc_id"])
    return found.select("doc_id", (id_crc("doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score")
