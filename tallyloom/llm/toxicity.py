"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are its distinct n-grams of 3 to 5 characters (code points; A-Z lower-cased,
ASCII white space as one kind, and a space before and behind the text), hashed. Each is scaled by the log of the ratio of its rates in toxic and other texts, and a
logistic regression with a quadratic penalty weighs them. It is fitted in one task on a bounded
number of labelled rows of either class; scoring reads every whole text where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.words import mix64

ORDERS, BITS = (3, 4, 5), 18
#: Labelled rows of each class that the fit takes, those of least hash of doc_id: toxic, others.
SAMPLE = (2000, 3000)
#: A feature is fitted if so many texts have it and its ratio is so many standard errors from none.
LEAST_TEXTS, LEAST_Z = 10, 2.0
PENALTY, STEPS, RATE = 1e-3, 120, 0.03
#: Texts whose features are made together, in characters, and features that the fit lays out at once.
TOGETHER, ENTRIES = 300_000, 500_000

_FOLD = np.arange(128, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)
_FOLD[9:14] = 32


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= TOGETHER):
            size += len(texts[end])
            end += 1
        yield start, end
        start = end


def features(texts: list[str], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature for each distinct feature of each text, sorted; only those that keep marks, if given."""
    found = []
    for start, end in _chunks(texts):
        code = np.frombuffer("".join(f" {t} " for t in texts[start:end]).encode("utf-32-le"), dtype=np.uint32)
        chars = np.where(code < 128, _FOLD[np.minimum(code, 127)], code)
        sizes = np.fromiter((len(t) + 2 for t in texts[start:end]), dtype=np.int64, count=end - start)
        ends = np.cumsum(sizes)
        of = np.repeat(np.arange(start, end), sizes)
        here, h = [], np.zeros(len(chars), dtype=np.uint64)
        for k in range(max(ORDERS)):
            n = k + 1
            if len(chars) < n:
                break
            h = h[: len(chars) - k] * np.uint64(0x9E3779B97F4A7C15) + chars[k:]
            if n not in ORDERS:
                continue
            feature = ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).view(np.int64)
            good = np.ones(len(feature), dtype=bool) if keep is None else keep[feature]
            across = (ends[:-1, None] - np.arange(1, n)).ravel()  # begins in one text and ends in another
            good[across[(across >= 0) & (across < len(good))]] = False
            at = np.flatnonzero(good)
            here.append(of[at] << BITS | feature[at])
        if here:
            found.append(np.unique(np.concatenate(here)))
    both = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32 by feature
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        of, feature = features(texts, self.weights != 0)
        z = np.bincount(of, self.weights[feature], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(features_: list[np.ndarray], toxic: np.ndarray) -> Model:
    """From the distinct features of each text and its label. Counting goes text by text; only entries of used features are laid out at once."""
    size, n = 1 << BITS, np.array([(~toxic).sum(), toxic.sum()])
    if not n.all():
        # one class only, or no label at all: no text says anything, and the bias says that class
        return Model(np.zeros(size, dtype=np.float32), 5.0 if n[1] else -5.0)
    in_toxic, in_all = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for f, label in zip(features_, toxic, strict=True):
        in_all[f] += 1
        if label:
            in_toxic[f] += 1
    ratio = np.log((in_toxic + 1) / (n[1] + 2)) - np.log((in_all - in_toxic + 1) / (n[0] + 2))
    error = np.sqrt(1 / (in_toxic + 1) + 1 / (in_all - in_toxic + 1))
    used = np.flatnonzero((in_all >= LEAST_TEXTS) & (np.abs(ratio) >= LEAST_Z * error))
    place = np.full(size, -1, dtype=np.int32)
    place[used] = np.arange(len(used))
    kept = [c[c >= 0] for c in (place[f] for f in features_)]
    bounds = np.cumsum([0, *map(len, kept)])
    cols, scale = np.concatenate(kept), ratio[used]
    del kept
    # texts in blocks of about so many features, so that only one block is laid out at a time
    blocks = np.unique(np.append(np.searchsorted(bounds, np.arange(0, bounds[-1], ENTRIES)), len(toxic)))
    share = np.where(toxic, 0.5 / n[1], 0.5 / n[0])  # either class counts as much
    w, m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, STEPS + 1):
        scaled, slope = scale * w[:-1], np.append(PENALTY * w[:-1], 0.0)
        for lo, hi in zip(blocks[:-1], blocks[1:], strict=True):
            c = cols[bounds[lo] : bounds[hi]]
            row = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
            z = np.bincount(row, scaled[c], minlength=hi - lo) + w[-1]
            off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[lo:hi]) * share[lo:hi]
            slope[:-1] += scale * np.bincount(c, off[row], minlength=len(used))
            slope[-1] += off.sum()
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(size, dtype=np.float32)
    weights[used] = w[:-1] * scale
    return Model(weights, float(w[-1]))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Model:
    """A model from the labelled rows that are not held out.

    Of each class, the fit takes at most as many ids as ``sample`` says, so the driver only ever
    holds those ids and the weights. An id labelled both ways counts as toxic; null labels, and ids
    without a document, do not count. Without rows of both classes the model knows no features.
    """
    spark = docs.sparkSession
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [(r.doc_id, label) for label, most in ((1, sample[0]), (0, sample[1])) for r in known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").take(most)]
    chosen = spark.createDataFrame(picked, "doc_id long, __toxic int")  # at most sum(sample) rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "__toxic")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x or "" for x in b.column(0).to_pylist()]
            of, feature = features(raw)
            bounds = np.searchsorted(of, np.arange(len(raw) + 1))
            packed = [feature[bounds[i] : bounds[i + 1]].astype(np.int32).tobytes() for i in range(len(raw))]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(packed, pa.binary())], names=["toxic", "features"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, each = [], []
        for b in batches:
            toxic += b.column(0).to_pylist()
            each += [np.frombuffer(x, dtype=np.int32) for x in b.column(1).to_pylist()]
        model = fit(each, np.array(toxic, dtype=bool))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.bias])], names=["weights", "bias"])

    made = texts.mapInArrow(counted, "toxic int, features binary").repartition(1).mapInArrow(fitted, "weights binary, bias double").collect()
    return Model(np.frombuffer(bytes(made[0].weights), dtype=np.float32), made[0].bias) if made else fit([], np.zeros(0, dtype=bool))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, and score and predicted for every row; columns of these names are replaced.

    A null text counts as empty and gets the bias's score, as does a text without a weighed feature.
    Rows are scored one by one: repeated rows give repeated results, an empty table an empty one.
    The model, of a fixed size, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        return pd.Series(Model(*shared.value).score([t or "" for t in texts]))

    out = docs.withColumn("score", scored(F.col("text")))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
