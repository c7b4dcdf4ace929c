"""Document fingerprints: improbable features in chained Bloom filters.

Every window of 16 bytes has an entropy. Windows of improbable entropy, far from what most windows
of text have, rank first; those of very low entropy, such as padding, rank nowhere. A window that
comes first in a quarter of the neighbourhoods around it becomes a feature. A neighbourhood has a
sixteenth of a text's windows, at least 1 and at most 64: so short texts have as many features as an
edit of a part of them needs, and long ones do not fill too many filters. The width follows the
length without steps, so a text and its edit of nearly its length choose nearly alike.
Features go into a chain of Bloom filters, each of a fixed size and a fixed number of features. Two
chains are compared filter by filter: the bits that both have, less those that chance gives, over
the most that the fuller one has.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.words import mix64

WINDOW, NEIGHBOURS, SHARE, FIRST_IN = 16, 64, 16, 4
FILTER_BYTES, HASHES, PER_FILTER = 256, 5, 160
#: Entropy levels, of a possible log2(WINDOW) bits; below LEAST_LEVEL a window is no feature.
LEVELS, LEAST_LEVEL = 1000, 250
#: The level that windows of prose have most often: ranks rise towards it.
COMMON_LEVEL = 830
TEXT_BYTES = 400_000

#: What the sum of c log2 c gains as a byte's count rises from c to c + 1, in 2 ** -32.
_c = np.arange(WINDOW + 1, dtype=np.float64)
_cost = _c * np.log2(np.maximum(_c, 1))
_GAIN = np.round(np.diff(_cost) * 2**32).astype(np.int64)
_FULL = float(WINDOW * np.log2(WINDOW)) * 2**32


def levels(buf: np.ndarray) -> np.ndarray:
    """The entropy level of each window of WINDOW bytes."""
    n = len(buf)
    earlier = np.zeros(n, dtype=np.uint8)  # equal bytes among the WINDOW - 1 before
    later = np.zeros(n, dtype=np.uint8)  # and after
    for d in range(1, WINDOW):
        same = (buf[d:] == buf[:-d]).view(np.uint8)
        earlier[d:] += same
        later[:-d] += same
    # the first window adds its bytes one by one; each next one drops a byte and takes one
    first = int(sum(_GAIN[:k].sum() for k in np.bincount(buf[:WINDOW]) if k))
    step = _GAIN[earlier[WINDOW:]] - _GAIN[later[: n - WINDOW]]
    total = np.concatenate(([0], np.cumsum(step))) + first
    return ((1 - total / _FULL) * (LEVELS - 1) + 0.5).astype(np.int64)


def _rarity() -> np.ndarray:
    """Rank by level, smaller is rarer, by one rule: the distance from the common level."""
    level = np.arange(LEVELS)
    rank = LEVELS - np.abs(level - COMMON_LEVEL)
    rank[level < LEAST_LEVEL] = 2 * LEVELS
    return rank


_RANK = _rarity()


def neighbourhood(windows: int) -> int:
    """How many windows that follow each other one is chosen from, in a text of so many."""
    return min(max(windows // SHARE, 1), NEIGHBOURS)


def features(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each feature, in the order of the texts.

    The texts lie in buf from starts on, with at least NEIGHBOURS zero bytes before and behind each.
    A text shorter than a window counts with zeros behind it; an empty one has no feature.
    """
    windows = np.where(sizes > 0, np.maximum(sizes - WINDOW + 1, 1), 0)
    if not windows.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    n = len(buf) - WINDOW + 1
    rank = _RANK[levels(buf)]
    text = np.repeat(np.arange(len(starts)), windows)
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(windows)[:-1])), windows) + np.arange(len(text))
    # one number orders windows by rank and then place; those that are none never come first
    key = np.full(n, 4 * LEVELS << 40, dtype=np.int64)
    key[at] = np.where(rank[at] < 2 * LEVELS, rank[at], 4 * LEVELS) << 40 | at
    width_of = np.array([neighbourhood(w) for w in windows.tolist()])
    times, least = np.zeros(n, dtype=np.int64), key
    for k in range(NEIGHBOURS.bit_length()):  # least: of 2 ** k windows that follow each other
        mine = np.flatnonzero((windows > 0) & (width_of >> k == 1))
        if len(mine):
            # every neighbourhood that reaches into a text: the least of two halves that overlap
            width = width_of[mine]
            many = windows[mine] + width - 1
            first = np.repeat(starts[mine] - width + 1 - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            picks = np.minimum(least[first], least[first + np.repeat(width - (1 << k), many)])
            times += np.bincount(picks[picks < 4 * LEVELS << 40] & ((1 << 40) - 1), minlength=n)
        if len(least) <= 1 << k:
            break
        least = np.minimum(least[: -(1 << k)], least[1 << k :])
    chosen = at[times[at] >= np.maximum(width_of[text] // FIRST_IN, 1)]
    found = np.sort(chosen)
    of = np.searchsorted(starts, found, side="right") - 1
    # texts that this leaves without a feature give their first-ranked window
    without = np.setdiff1d(np.flatnonzero(windows), of)
    extra = np.array([s + int(np.argmin(rank[s : s + w])) for s, w in zip(starts[without].tolist(), windows[without].tolist(), strict=True)], dtype=np.int64)
    found = np.union1d(found, extra)
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, WINDOW)[found]).view(np.uint64)
    h = np.full(len(found), np.uint64(WINDOW), dtype=np.uint64)
    for k in range(words.shape[1]):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[:, k])
    return np.searchsorted(starts, found, side="right") - 1, h


def chain(hashes: np.ndarray) -> np.ndarray:
    """Bloom filters, PER_FILTER distinct features each in the order given: rows of FILTER_BYTES bytes."""
    first = np.sort(np.unique(hashes, return_index=True)[1])
    hashes = hashes[first]
    if not len(hashes):
        return np.zeros((0, FILTER_BYTES), dtype=np.uint8)
    bits = np.zeros(((len(hashes) + PER_FILTER - 1) // PER_FILTER, FILTER_BYTES * 8), dtype=np.uint8)
    row = np.arange(len(hashes)) // PER_FILTER
    for k in range(HASHES):
        bits[row, (hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BYTES * 8 - 1)] = 1
    return np.packbits(bits, axis=1)


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """The chain of each text.

    Texts are taken together with pads between them, whose windows count nowhere, so that a chain
    does not depend on a text's neighbours.
    """
    out, start, pad = [], 0, bytes(NEIGHBOURS)
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= TEXT_BYTES):
            size += len(texts[end]) + NEIGHBOURS
            end += 1
        buf = np.frombuffer(pad + pad.join(texts[start:end]) + pad, dtype=np.uint8)
        sizes = np.fromiter(map(len, texts[start:end]), dtype=np.int64, count=end - start)
        of, h = features(buf, np.cumsum(sizes + NEIGHBOURS) - sizes, sizes)
        bounds = np.searchsorted(of, np.arange(end - start + 1))
        out += [chain(h[bounds[i] : bounds[i + 1]]) for i in range(end - start)]
        start = end
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the shorter chain its best overlap with one of the other's, averaged.

    Two empty chains are alike, an empty one is unlike any other.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    x, y = np.unpackbits(a, axis=1).astype(np.float32), np.unpackbits(b, axis=1).astype(np.float32)
    both, nx, ny = x @ y.T, x.sum(axis=1)[:, None], y.sum(axis=1)[None, :]
    chance = nx * ny / (FILTER_BYTES * 8)
    most = np.maximum(nx, ny)  # not the smaller: the few bits of a tiny text lie in most full filters by chance
    best = np.clip((both - chance) / np.maximum(most - chance, 1e-6), 0, 1).max(axis=1)
    weight = nx[:, 0]
    return float((best * weight).sum() / weight.sum())


def to_string(chain_: np.ndarray) -> str:
    return base64.b64encode(chain_.tobytes()).decode()


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (base64 of the chain) for every row; null texts count as empty, whose fingerprint is empty."""

    @F.pandas_udf("string")
    def made(texts):
        import pandas as pd

        return pd.Series([to_string(c) for c in fingerprints([(t or "").encode() for t in texts])], dtype=object)

    return docs.select("doc_id", made(F.col("text")).alias("fingerprint"))


def _runs(docs: DataFrame) -> DataFrame:
    """part, lead, doc_id and text: all rows, in order of doc_id within each of several parts of a partition.

    The row with lead = true is a copy of the one that comes just before the part (before the first
    part, of the last row of all). Only the bounds of the parts, a few numbers for each shuffle
    partition, pass through the driver. Rows of equal doc_id stay together, ordered by a hash of the
    text; null ids come first.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = 8 * partitions
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    at = keyed.select(F.percentile_approx("key", [i / most for i in range(1, most)], max(10_000, 20 * most)).alias("at")).first().at
    bounds = np.array(sorted(set(at or [])), dtype=np.int64)

    @F.pandas_udf("int")
    def part(key):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="left").astype(np.int32))

    last = {r.part: r.last for r in keyed.select("key").groupBy(part("key").alias("part")).agg(F.max("key").alias("last")).collect()}
    parts = sorted(last)
    follows = {p: parts[(i + 1) % len(parts)] for i, p in enumerate(parts)}

    @F.pandas_udf("array<int>")
    def leads(key):
        """The part that the row leads, if it is the last of its own."""
        import pandas as pd

        own = np.searchsorted(bounds, key.to_numpy(), side="left").tolist()
        return pd.Series([[follows[p]] if last[p] == k else [] for p, k in zip(own, key.tolist(), strict=True)], dtype=object)

    homes = F.concat(F.array(F.struct(part("key").alias("part"), F.lit(False).alias("lead"))), F.transform(leads("key"), lambda p: F.struct(p.alias("part"), F.lit(True).alias("lead"))))
    dealt = keyed.withColumn("home", F.explode(homes)).select("home.part", "home.lead", "doc_id", "text", "key")
    return dealt.repartition(partitions, "part").sortWithinPartitions("part", F.desc("lead"), "key", F.xxhash64("text")).select("part", "lead", "doc_id", "text")


def compare_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every row.

    The next document is the one with the next smaller doc_id, after the last the first; of rows of
    equal doc_id, the one with the next smaller hash of the text; a single row is its own next. The
    edited text has the last third of the code points, rounded down, replaced by as many from the
    start of the next text, or all of it. Null texts count as empty. An empty table gives an empty
    result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, chain_before = "", None  # every part begins with its lead
        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
            at = 0
            while at < len(rows):
                ids, texts, edited, size = [], [], [], 0
                while at < len(rows) and size < TEXT_BYTES:
                    _, lead, doc_id, text = rows[at]
                    text = text or ""
                    at += 1
                    size += 2 * len(text)
                    cut = len(text) // 3
                    ids.append(None if lead else (doc_id, len(text)))
                    texts.append(text.encode())
                    edited.append(b"" if lead else (text[: len(text) - cut] + before[:cut]).encode())
                    before = text
                chains, edits = fingerprints(texts), fingerprints(edited)
                out = []
                for i, own in enumerate(ids):
                    if own is not None:
                        out.append((*own, hashlib.sha256(edited[i]).hexdigest(), to_string(chains[i]), to_string(edits[i]), likeness(chains[i], edits[i]), likeness(chains[i], chain_before)))
                    chain_before = chains[i]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)

    return _runs(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
