"""Substring dedup by hashing of lines and the sentences in them.

A unit is a line, cut at sentence ends, and a sentence of many words cut again after words that their
own hash picks, so that a passage inside a longer line is cut alike wherever it stands. Units are
normalised (A-Z lower-cased, white space ignored) and hashed. Besides, of every few windows of GRAM
words that follow each other the one of least hash is a unit as well (winnowing): it depends on no
words around them, so a passage that stands anywhere in two documents has the same of these units in
both, and they cover it but for at most NEXT - 1 words at either end. Equal units are grouped over all
documents, the earliest by doc_id and place stays and the others are marked. Runs of words in marked
units, if they are enough, are removed; their offsets in the original text stay with the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.words import mix64, prefix_hashes, word_spans

#: Words of a unit that is hashed, of a sentence that is not cut again, and of a run that goes.
UNIT_WORDS, SENTENCE_WORDS, RUN_WORDS = 4, 16, 25
#: One word in so many ends a unit of a long sentence.
CUT = 8
#: Words of a window, and windows of which the one of least hash is a unit. A passage of n words keeps at least
#: n - 2 (NEXT - 1) words in marked units without a gap, as NEXT <= GRAM; with NEXT < GRAM no window lies in two texts.
GRAM, NEXT = 8, 6
TEXT_BYTES = 4_000_000


def _grams(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first words of the chosen windows of GRAM words, and the windows' hashes."""
    n = len(words) - GRAM + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at = np.arange(n)
    h = mix64(prefix_hashes(words, at, at + GRAM) ^ np.uint64(0x6A09E667F3BCC909))  # never the hash of a line of the same words
    of = np.searchsorted(bounds, at, side="right")
    whole = at + GRAM <= bounds[of]
    most = np.uint64(2**64 - 1)
    # windows over the edge of a text are never the least, and the places before and behind the texts are such
    wide = np.concatenate((np.full(NEXT - 1, most), np.where(whole, np.minimum(h, most - np.uint64(1)), most), np.full(NEXT - 1, most)))
    least = np.lib.stride_tricks.sliding_window_view(wide, NEXT).argmin(axis=1) + np.arange(len(wide) - NEXT + 1) - (NEXT - 1)
    chosen = np.unique(np.clip(least, 0, n - 1))
    chosen = chosen[whole[chosen]]
    return chosen, h[chosen]


class Units:
    """Units of several texts: which text, number in it, first word in all texts, number of words and hash.

    A text's lines and sentences come first, in its order, then its chosen windows, which overlap these
    and each other. starts and ends: of all words, in bytes of all texts, each with one byte behind it.
    """

    def __init__(self, texts: list[bytes]):
        raw, words, self.starts, self.ends, bounds = word_spans(texts)
        starts, ends, n = self.starts, self.ends, len(words)
        last = raw[ends - 1]
        cut = (last == 46) | (last == 33) | (last == 63)  # . ! ?
        breaks = np.concatenate(([0], np.cumsum(raw == 10)))
        cut[: n - 1] |= breaks[starts[1:]] > breaks[ends[:-1]] if n else False
        edge = bounds[1:][bounds[1:] > bounds[:-1]] - 1
        cut[edge] = True
        stops = np.flatnonzero(cut)
        sizes = np.diff(np.concatenate(([-1], stops)))
        cut |= (np.repeat(sizes, sizes) > SENTENCE_WORDS) & (words % np.uint64(CUT) == 0)
        stops = np.flatnonzero(cut)
        first = np.concatenate(([0], stops[:-1] + 1)) if len(stops) else stops
        gram, gram_hash = _grams(words, bounds)
        size = np.concatenate((stops - first + 1, np.full(len(gram), GRAM)))
        all_hash = np.concatenate((prefix_hashes(words, first, stops + 1), gram_hash))
        first = np.concatenate((first, gram))
        text = np.searchsorted(bounds[1:], first, side="right")
        order = np.argsort(text, kind="stable")
        self.text, self.first, self.words, self.hash = text[order], first[order], size[order], all_hash[order]
        self.no = np.arange(len(first)) - np.searchsorted(self.text, self.text)


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= TEXT_BYTES):
            size += len(texts[end])
            end += 1
        yield start, end
        start = end


def _later(h: np.ndarray, ids: np.ndarray, no: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the units by hash and place, and which of them, in that order, are not the earliest place of their hash."""
    order = np.lexsort((no, ids, h))
    h, ids, no = h[order], ids[order], no[order]
    new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, dtype=bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    return order, (ids != ids[first]) | (no != no[first])


_FIELDS = ["part", "marked", "hashes", "ids", "places"]


def _packed(part: int, marked: bool, h: np.ndarray, ids: np.ndarray, no: np.ndarray) -> tuple:
    return part, marked, h.tobytes(), ids.tobytes(), no.astype(np.int32).tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_FIELDS)


def marked_units(docs: DataFrame) -> DataFrame:
    """doc_id and marks: number and hash, one after another, of the document's units that stand earlier elsewhere."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = 4 * partitions

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units by part of the hashes. What an earlier unit of the same texts already marks is settled
        here, so that a very common unit goes out once for each group of texts."""
        for b in batches:
            texts, all_ids = b.column(1).cast(pa.binary()).to_pylist(), b.column(0).to_numpy()
            for start, end in _groups(texts):
                u = Units(texts[start:end])
                long = u.words >= UNIT_WORDS
                h, ids, no = u.hash[long], all_ids[start + u.text[long]], u.no[long]
                order, later = _later(h, ids, no)
                h, ids, no = h[order], ids[order], no[order]
                rows = []
                for marked in (False, True):
                    mine = later == marked
                    mh, mi, mn = h[mine], ids[mine], no[mine]
                    part = ((mh >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
                    by = np.argsort(part, kind="stable")
                    mh, mi, mn = mh[by], mi[by], mn[by]
                    bounds = np.searchsorted(part[by], np.arange(parts + 1))
                    rows += [_packed(p, marked, *(x[bounds[p] : bounds[p + 1]] for x in (mh, mi, mn))) for p in np.flatnonzero(np.diff(bounds)).tolist()]
                if rows:
                    yield _batch(rows)

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out(h: np.ndarray, ids: np.ndarray, no: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(no.astype(np.int64) << 32 | (h & np.uint64(0xFFFFFFFF)).astype(np.int64))], names=["doc_id", "mark"])

        def units(rows: list[tuple]) -> tuple[np.ndarray, ...]:
            return tuple(np.frombuffer(b"".join(x), dtype=t) for x, t in zip(zip(*rows, strict=True), (np.uint64, np.int64, np.int32), strict=True))

        def finish() -> Iterator[pa.RecordBatch]:
            if held:
                h, ids, no = units(held)
                order, later = _later(h, ids, no)
                at = order[later]
                yield out(h[at], ids[at], no[at])
                held.clear()

        for b in batches:
            for part, marked, *row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if part != now:
                    yield from finish()
                    now = part
                if marked:
                    yield out(*units([tuple(row)]))
                else:
                    held.append(tuple(row))
        yield from finish()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    packed = rows.mapInArrow(dealt, "part int, marked boolean, hashes binary, ids binary, places binary")
    marks = packed.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(settled, "doc_id long, mark long")
    return marks.groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))


def cut_runs(text: str, marks: list[int], run_words: int) -> tuple[str, list[dict[str, int]]]:
    """What stays of a text and the spans that go, in code points."""
    raw = text.encode()
    u = Units([raw])
    marked = {m >> 32: m & 0xFFFFFFFF for m in marks}
    hit = np.array([marked.get(i) == h for i, h in enumerate((u.hash & np.uint64(0xFFFFFFFF)).tolist())], dtype=bool)

    def within(units: np.ndarray) -> np.ndarray:
        edges = np.zeros(len(u.starts) + 1, dtype=np.int64)
        np.add.at(edges, u.first[units], 1)
        np.add.at(edges, u.first[units] + u.words[units], -1)
        return np.cumsum(edges[:-1]) > 0

    covered = within(hit)
    # units too short to be hashed do not break a run, but never end it
    run = np.diff(np.concatenate(([0], covered | within(u.words < UNIT_WORDS), [0])).astype(np.int8))
    spans = []
    for i, j in zip(np.flatnonzero(run == 1).tolist(), np.flatnonzero(run == -1).tolist(), strict=True):
        inner = np.flatnonzero(covered[i:j])
        if len(inner) and inner[-1] - inner[0] + 1 >= run_words:
            spans.append((int(u.starts[i + inner[0]]), int(u.ends[i + inner[-1]])))
    if not spans:
        return text, []
    kept, at, out = [], 0, []
    for s, e in spans:
        kept.append(raw[at:s])
        out.append({"start": len(raw[:s].decode()), "end": len(raw[:e].decode())})
        at = e
    kept.append(raw[at:])
    return b"".join(kept).decode(), out


def dedup_substrings(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, text without the repeated passages, and removed (start and end in code points of the original) for every row.

    A unit is marked if an equal one stands in a smaller doc_id, or earlier in the same text; runs of
    at least ``run_words`` words in marked units are removed. So any passage of ``run_words`` +
    2 (NEXT - 1) words that stands earlier is, but for at most NEXT - 1 words at either end. Nothing is removed from null texts or
    rows without an id, and nothing is marked because of them. Rows of equal doc_id count as one
    document: they never mark each other's unit of the same number. An empty table gives an empty
    result; columns besides doc_id and text are not read.
    """
    marks = marked_units(docs).withColumnRenamed("doc_id", "of")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            made = [cut_runs(t, m, run_words) if m else (t, []) for t, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            texts, spans = zip(*made, strict=True) if made else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(spans, kind)], names=["doc_id", "text", "removed"])

    joined = rows.join(marks, F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(run, "doc_id long, text string, removed array<struct<start:int,end:int>>")
