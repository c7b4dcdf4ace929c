"""Importance resampling towards a target distribution, with segment deduplication.

Newlines separate words, so they cut a text into lines. The features of each distinct line are hashed
once and count as often as the line occurs, both in the totals of the corpus and in the weight of a
document; only n-grams across line ends are made text by text and added. A document's weight is the
mean gain of its features' buckets, and the draw takes the highest sums of weight and seeded Gumbel
noise, which is sampling without replacement in proportion to the weights' exponentials.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.llm.scratch import Scratch

BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 10, 20, "2024"
#: Words whose buckets a task remembers; beyond, it starts anew, which changes no result.
REMEMBERED = 200_000
#: Rows of the sorted scores in one part.
PART_ROWS = 1_000_000
#: A-Z lower-cased, and all other ASCII but 0-9 and a-z as spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class Features:
    """Buckets of the runs of 1 to n consecutive words."""

    def __init__(self, n: int, buckets: int):
        self.n, self.buckets, self.known = n, buckets, {}

    def _single(self, some: list[bytes]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, buckets = self.known, self.buckets
        for w in set(some).difference(known):
            known[w] = crc32(w) % buckets
        return [known[w] for w in some]

    def of_line(self, some: list[bytes]) -> list[int]:
        out = self._single(some)
        for k in range(2, self.n + 1):
            out += [crc32(b" ".join(some[i : i + k])) % self.buckets for i in range(len(some) - k + 1)]
        return out

    def across(self, text: str) -> list[int]:
        """Buckets of the runs that begin in one line of the text and end in another."""
        lines = [w for line in text.split("\n") if (w := words(line))]
        flat, first = [w for line in lines for w in line], np.cumsum([len(x) for x in lines])[:-1].tolist()
        out = []
        for k in range(2, self.n + 1):
            starts = {i for p in first for i in range(max(p - k + 1, 0), min(p, len(flat) - k + 1))}
            out += [crc32(b" ".join(flat[i : i + k])) % self.buckets for i in sorted(starts)]
        return out


def _packed(lists: list[list[int]]) -> pa.Array:
    return pa.array([np.array(x, dtype=np.int32).tobytes() for x in lists], pa.binary())


def _line_id(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _lines(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """line_id, times, words and features (packed buckets) for each distinct line."""
    distinct = docs.select(F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''").groupBy("line").agg(F.count("*").alias("times"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features(n, buckets)
        for b in batches:
            split = [words(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(map(len, split)), pa.int64()), _packed(list(map(made.of_line, split)))], names=["line_id", "times", "words", "features"])

    return distinct.select(_line_id(F.col("line")).alias("line_id"), "times", "line").mapInArrow(run, "line_id binary, times long, words long, features binary")


def _across(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """doc_id, of, and the packed buckets of the n-grams across line ends of each text that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features(n, buckets)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _packed([made.across(t) for t in b.column(2).to_pylist()])], names=["doc_id", "of", "features"])

    return docs.filter("text like '%\n%'").select("doc_id", "of", "text").mapInArrow(run, "doc_id long, of binary, features binary")


def _totals(rows: DataFrame, buckets: int) -> DataFrame:
    """bucket and total, from rows of features and times: added up in each task before they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            packed = b.column(0).to_pylist()
            times = np.repeat(b.column(1).to_numpy(), [len(x) // 4 for x in packed])
            np.add.at(total, np.frombuffer(b"".join(packed), dtype=np.int32), times)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "total"])

    return rows.select("features", F.col("times").cast("long")).mapInArrow(run, "bucket long, total long").groupBy("bucket").agg(F.sum("total").alias("total"))


def _counted(docs: DataFrame, n: int, buckets: int, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame | None, np.ndarray]:
    """The distinct lines, the n-grams across lines (none for n = 1), and the features in each bucket."""
    lines = scratch.save(_lines(docs, n, buckets), f"{name}-lines")
    across = scratch.save(_across(docs, n, buckets), f"{name}-across") if n > 1 else None
    counted = lines.select("features", "times")
    if across is not None:
        counted = counted.union(across.select("features", F.lit(1).cast("long")))
    total = np.zeros(buckets, dtype=np.int64)
    for r in _totals(counted, buckets).collect():  # at most one row a bucket
        total[r.bucket] = r.total
    return lines, across, total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket floor(1000 ln of how much likelier it is in the target than in the corpus), with one added to each."""
    buckets, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(map(float, corpus), map(float, target), strict=True)], dtype=np.int64)


def _valued(rows: DataFrame, keys: list[str], gain: np.ndarray) -> DataFrame:
    """keys, n (features) and gain (their sum), from rows of keys and features."""
    kept = StructType([rows.schema[k] for k in keys])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = b.column(len(keys)).to_pylist()
            sizes = np.array([len(x) // 4 for x in packed], dtype=np.int64)
            total = np.concatenate(([0], np.cumsum(gain[np.frombuffer(b"".join(packed), dtype=np.int32)])))
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), pa.array(sizes), pa.array(total[ends] - total[ends - sizes])], names=[*keys, "n", "gain"])

    return rows.select(*keys, "features").mapInArrow(run, StructType(kept.fields).add("n", "long").add("gain", "long"))


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """floor(1000 x Gumbel noise), from the first 32 bits of sha256 of seed:doc_id (a null id: nothing behind the colon)."""

    @F.pandas_udf("long")
    def of(h):
        import pandas as pd

        return pd.Series([math.floor(-1000 * math.log(-math.log((x + 0.5) / 4294967296))) for x in h.tolist()], dtype="int64")

    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return of(F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long"))


def numbered(df: DataFrame, order: list[Column], scratch: Scratch, name: str = "numbered") -> DataFrame:
    """df with rank, from 1, in this order: parts of the range are sorted apart and each is told how many rows stand before it."""
    session = df.sparkSession
    partitions = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PART_ROWS))
    parts = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the part's number, then 33 bits of the place in it
    parts = scratch.save(parts.withColumn("__at", at), name).withColumns({"__part": F.shiftright("__at", 33), "__at": F.col("__at") % F.lit(2**33)})
    sizes = sorted((r["__part"], r["n"]) for r in parts.groupBy("__part").agg(F.count("*").alias("n")).collect())  # one row a part
    before = dict(zip([p for p, _ in sizes], np.cumsum([0, *(n for _, n in sizes)]).tolist(), strict=False))
    starts = session.createDataFrame(list(before.items()), "__of long, __before long")
    return parts.join(starts, F.col("__part") == F.col("__of")).withColumn("rank", F.col("__before") + F.col("__at") + 1).drop("__at", "__part", "__of", "__before")


def weigh(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, n_words, weight, score and rank for every row of docs.

    Words are runs of code points other than ASCII that is no letter or digit, A-Z lower-cased;
    features are all runs of 1 to n of them. weight is the floored mean of the gains of a text's
    features. Of the N rows with at least ``least_words`` words, the floor(percent x N / 100) highest
    scores are drawn and get a rank from 1, ties to the smaller doc_id (null first); the others have
    a null rank. A null text, or one without words, has no features and weight 0. Rows of equal
    doc_id are judged each by its own text and share their noise; rows equal in both are drawn each
    for itself. Empty tables give an empty result; an empty target gives gains against nothing.
    Columns besides doc_id and text of docs and text of target are not read.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("of", _line_id(F.col("text")))
    lines, across, corpus = _counted(docs, n, buckets, scratch, "corpus")
    aim = _counted(target.select(F.lit(None).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(b"").alias("of")), n, buckets, scratch, "target")[2]
    gain = gains(corpus, aim)

    of_line = _valued(lines, ["line_id", "words"], gain)
    of_line = of_line.filter("n > 0").select(F.col("line_id").alias("id"), "words", "n", "gain")
    each = docs.select("doc_id", "of", F.explode(F.transform(F.filter(F.split("text", "\n"), lambda x: x != ""), _line_id)).alias("line_id"))
    zero = F.lit(0).cast("long")
    parts = each.join(of_line, F.col("line_id") == F.col("id")).select("doc_id", "of", zero.alias("rows"), "words", "n", "gain")
    # one entry a row tells how many rows are equal and keeps texts without words
    parts = parts.unionByName(docs.select("doc_id", "of", F.lit(1).cast("long").alias("rows"), zero.alias("words"), zero.alias("n"), zero.alias("gain")))
    if across is not None:
        parts = parts.unionByName(_valued(across, ["doc_id", "of"], gain).withColumns({"rows": zero, "words": zero}))
    summed = parts.groupBy("doc_id", "of").agg(*(F.sum(c).alias(c) for c in ("rows", "words", "n", "gain")))
    once = summed.select("doc_id", "rows", *(F.expr(f"{c} div rows").alias(c) for c in ("words", "n", "gain")))
    weight = F.when(F.col("n") > 0, F.expr("(gain - pmod(gain, n)) div n")).otherwise(F.lit(0)).cast("long")
    rows = once.select("doc_id", F.col("n").alias("n_features"), F.col("words").alias("n_words"), weight.alias("weight"), "rows").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("copy", "rows")
    rows = scratch.save(rows, "scored")

    fit = rows.filter(F.col("n_words") >= least_words)
    ranked = numbered(fit, [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("weight"), F.asc("n_features")], scratch)
    drawn = percent * fit.count() // 100
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "n_words", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, **how: int | str) -> DataFrame:
    """The drawn documents with all their columns; of rows of one doc_id, all if any of them is drawn. For the rest see weigh."""
    drawn = weigh(docs, target, **how).filter("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(drawn, docs["doc_id"].cast("long").eqNullSafe(F.col("__drawn")), "left_semi")
