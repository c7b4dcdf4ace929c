"""Removal of byte strings that stand more than once, by column-wise suffix sorting of many documents.

A string of ``length`` bytes that stands twice has the same least hash of its short substrings in both
places. So texts fall into pieces: runs of strings with one such key. Spark counts the keys; pieces
whose key stands once hold nothing repeated. Equal pieces of the others are one piece with a number,
and pieces meet by key, in groups of a bounded size.

There the collection is sorted column by column. Forty bytes are a symbol, named by a hash, and a piece
enters as forty documents, one for each place its first symbol can begin. Each round puts one more
symbol in front of every document. The transform is kept symbol by symbol, each with the ascending places
before which it stands: how many stand before a document's place is where its longer suffix goes.
One pass rewrites the places and another the common prefixes of neighbours. In the end strings with
a neighbour that shares ``length`` bytes, and those of pieces that stand several times, are repeated.
Neighbours are compared byte by byte; where two symbols had one name, all is sorted again by symbols
of eight bytes, whose names are their ranks.

The files of the published form are Spark's here: tables in the shared folder and sorted exchanges,
read once from front to back; a task holds one group's columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.scratch import Scratch
from tallyloom.llm.words import mix64

LENGTH, KEY_BYTES = 200, 64
#: Bytes of a symbol: those named by a hash, and those named by their rank.
WIDE, NARROW = 40, 8
#: Strings of one piece; of one key's pieces, how many may meet in a task; bytes of pieces sorted together.
PIECE, HOT, TOGETHER = 256, 4096, 400_000
#: Bytes of texts whose keys are found together; longer texts come in overlapping slices of this size.
SLICE = 400_000
_LOW = np.int64(0xFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_OF_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_NO_ID = -(2**63)


class Powers:
    """Powers of the hash's base and of its inverse, as far as they were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, np.uint64(b))))) for b in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def hashes(buf: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each string of ``length`` bytes."""
    up, down = _POWERS.upto(len(buf))
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_OF_BYTE[buf] * up)))
    return mix64((total[length:] - total[:-length]) * down[: len(total) - length])


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` hashes that follow each other."""
    have = 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (width - have)], h[width - have :]) if have < width else h


def pieces(buf: np.ndarray, ends: np.ndarray, length: int = LENGTH, key_bytes: int = KEY_BYTES) -> tuple[np.ndarray, ...]:
    """key, first string, number of strings and number (2 if a string may stand twice in it) of each piece of texts that end there."""
    n = len(buf) - length + 1
    empty = np.zeros(0, dtype=np.int64)
    if n < 1:
        return empty.astype(np.uint64), empty, empty, empty
    h, width = hashes(buf, key_bytes), length - key_bytes + 1
    key = least_of(h, width)
    whole = np.ones(n, dtype=bool)
    for e in ends[:-1].tolist():  # strings over the end of a text are none
        whole[max(e - length + 1, 0) : e] = False
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])))
    run = np.flatnonzero(new)
    inside = np.arange(n) - np.repeat(run, np.diff(np.concatenate((run, [n]))))
    new |= inside % PIECE == 0
    enters = (h[width - 1 :] == key) & ~new  # the least hash stands again within the piece
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate((first, [n])))
    twice = np.add.reduceat(enters, first) > 0
    kept = whole[first]
    return key[first][kept], first[kept], count[kept], 1 + twice[kept].astype(np.int64)


class Minima:
    """Least value of any range of an array of bytes, from the least of each 1, 2, 4, ... that follow each other."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > (step := 1 << len(self.levels) - 1):
            self.levels.append(np.minimum(self.levels[-1][:-step], self.levels[-1][step:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least from each lo to its hi, both counted."""
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        order = np.argsort(level.astype(np.uint8), kind="stable")
        bounds = np.searchsorted(level[order], np.arange(len(self.levels) + 1))
        out = np.empty(len(lo), dtype=np.uint8)
        for k, least in enumerate(self.levels):
            mine = order[bounds[k] : bounds[k + 1]]
            if len(mine):
                out[mine] = np.minimum(least[lo[mine]], least[hi[mine] + 1 - (1 << k)])
        return out


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, ordered as numbers as they are as bytes."""
    words = np.concatenate((buf, np.zeros(NARROW - 1, dtype=np.uint8))).astype(np.uint64)
    for step in (1, 2, 4):
        words = words[:-step] << np.uint64(8 * step) | words[step:]
    return words


def _columns(names: np.ndarray, sizes: np.ndarray, begins: np.ndarray, symbol: int, deep: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the suffixes of at least ``deep`` symbols in sorted order (-1: those of fewer), and how many symbols each shares with the one before, at most ``deep``.

    names: of the symbol that begins at each place of the joined pieces, which have these sizes and
    begin there.
    """
    # documents, those of most symbols first: where they begin and how many symbols there are
    offset = np.tile(np.arange(symbol), len(sizes))
    many = (np.repeat(sizes, symbol) - offset) // symbol
    front = np.repeat(begins, symbol) + offset
    order = np.argsort(-many, kind="stable")
    order = order[many[order] > 0]
    many, front = many[order], front[order]

    m = len(many)
    transform = np.zeros(0, dtype=np.int64)  # symbol << 32 | place before which it stands, ascending
    prefix = np.zeros(m, dtype=np.uint8)  # common prefix with the suffix before, in symbols; the empty suffixes come first
    place = np.arange(m)
    for turn in range(1, int(many[0]) + 1):
        live = int(np.searchsorted(-many, -turn, side="right"))
        fresh = names[front[:live] + symbol * (many[:live] - turn)] << 32 | place[:live]
        by = np.argsort(fresh)
        fresh = fresh[by]
        before = np.searchsorted(transform, fresh)  # smaller symbols, and the same one at smaller places
        at, n = before + np.arange(live), len(transform)
        # every suffix moves by the new ones that now stand before it
        moved = np.repeat(np.arange(live + 1), np.diff(np.concatenate(([0], before, [n]))))
        kept = moved + np.arange(n)
        merged = np.empty(n + live, dtype=np.int64)
        merged[at], merged[kept] = fresh, transform
        # common prefixes of the new suffixes and of those behind them
        touched = np.zeros(n + live + 1, dtype=bool)
        touched[at] = touched[at + 1] = True
        pair = np.flatnonzero(touched[1:-1]) + 1
        one, two = merged[pair - 1], merged[pair]
        same = np.flatnonzero(one >> 32 == two >> 32)
        longer = np.zeros(len(pair), dtype=np.uint8)
        longer[same] = np.minimum(Minima(prefix).of((one[same] & _LOW) + 1, two[same] & _LOW) + 1, deep)
        grown = np.zeros(m + n + live, dtype=np.uint8)
        grown[m + kept] = prefix[m:]
        grown[m + pair] = longer
        if at[0] == 0:
            grown[m] = 0
        moved = np.concatenate((np.zeros(m, dtype=np.int64), moved))
        merged += moved[merged & _LOW]
        place[live:] += moved[place[live:]]
        place[by] = m + at
        transform, prefix = merged, grown

    where = np.full(len(prefix), -1, dtype=np.int64)
    for step in range(int(many[0]) - deep + 1):  # a document's suffixes from the longest on
        live = int(np.searchsorted(-many, -(step + deep), side="right"))
        at = place[:live]
        where[at] = front[:live] + symbol * step
        place = transform[at - m] & _LOW
    return where, prefix


def repeated(some: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece which of its strings of ``length`` bytes stand anywhere else in the pieces."""
    assert length % NARROW == 0
    sizes = np.fromiter(map(len, some), dtype=np.int64, count=len(some))
    if not len(some) or sizes.max() < length:
        return [np.zeros(max(n - length + 1, 0), dtype=bool) for n in sizes.tolist()]
    begins = np.cumsum(sizes) - sizes
    buf = np.frombuffer(b"".join(some), dtype=np.uint8)
    words = _words(buf)
    found = np.zeros(len(buf), dtype=bool)
    for symbol in (WIDE, NARROW) if length % WIDE == 0 else (NARROW,):
        symbols = words if symbol == NARROW else hashes(buf, symbol)
        names = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        where, prefix = _columns(names, sizes, begins, symbol, length // symbol)
        alike = np.flatnonzero(prefix >= length // symbol)
        one, two = where[alike - 1], where[alike]
        if symbol == NARROW or all((words[one + k] == words[two + k]).all() for k in range(0, length, NARROW)):
            break
    found[one] = found[two] = True
    return [found[b : b + max(n - length + 1, 0)] for b, n in zip(begins.tolist(), sizes.tolist(), strict=True)]


def text_id(text: Column) -> Column:
    return F.unhex(F.md5(text))


_PIECE = "key long, digest long, size int, n long, doc_id long, of binary, at long"
_NAMES = ["key", "digest", "size", "n", "doc_id", "of", "at"]


def _slices(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Row, offset and bytes of texts, or overlapping slices of long ones, in groups of a bounded size."""
    group, size = [], 0
    for row, raw in enumerate(texts):
        for at in range(0, max(len(raw) - length + 1, 0), SLICE):
            part = raw[at : at + SLICE + length - 1]
            if group and size + len(part) > SLICE + length:
                yield group
                group, size = [], 0
            group.append((row, at, part))
            size += len(part)
    if group:
        yield group


def _cut(docs: DataFrame, length: int, key_bytes: int) -> DataFrame:
    """The pieces of all texts: key, digest, size (strings), n, and where they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.encode() for x in b.column(2).to_pylist()]
            for group in _slices(texts, length):
                raw = b"".join(x for _, _, x in group)
                ends = np.cumsum([len(x) for _, _, x in group])
                key, first, count, n = pieces(np.frombuffer(raw, dtype=np.uint8), ends, length, key_bytes)
                if not len(key):
                    continue
                which = np.searchsorted(ends, first, side="right")
                row = np.array([r for r, _, _ in group])[which]
                offset = np.array([at - e + len(x) for (_, at, x), e in zip(group, ends.tolist(), strict=True)])[which]
                digest = np.array([xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(first.tolist(), (first + count + length - 1).tolist(), strict=True)], dtype=np.uint64)
                place = pa.array(row)
                columns = [pa.array(key.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(count.astype(np.int32)), pa.array(n), b.column(0).take(place), b.column(1).take(place), pa.array(first + offset)]
                yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return docs.select("doc_id", "of", "text").mapInArrow(run, _PIECE)


def _strings(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """Each string of the pieces at these places as a piece of its own, under the hash of the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, of, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = text.encode()
                for s in spans:
                    part = raw[s["at"] : s["at"] + s["size"] + length - 1]
                    key = (hashes(np.frombuffer(part, dtype=np.uint8), length) ^ np.uint64(0x6A09E667F3BCC909)).view(np.int64)
                    digest = np.array([xxhash.xxh3_64_intdigest(part[i : i + length]) for i in range(s["size"])], dtype=np.uint64)
                    n = len(key)
                    columns = [pa.array(key), pa.array(digest.view(np.int64)), pa.array([1] * n, pa.int32()), pa.array([1] * n, pa.int64()), pa.array([doc_id] * n, pa.int64()), pa.array([of] * n, pa.binary()), pa.array(np.arange(n) + s["at"])]
                    yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return _with_text(docs, places, ["at", "size"]).mapInArrow(run, _PIECE)


def _with_text(docs: DataFrame, places: DataFrame, fields: list[str]) -> DataFrame:
    """doc_id, of, text and places: the fields of all places of a text."""
    by_text = places.groupBy(F.col("doc_id").alias("__id"), F.col("of").alias("__of")).agg(F.collect_set(F.struct(*fields)).alias("places"))
    return docs.join(by_text, (docs["doc_id"] == F.col("__id")) & (docs["of"] == F.col("__of"))).select("doc_id", "of", "text", "places")


def _candidates(found: DataFrame) -> DataFrame:
    """The pieces whose key stands more than once."""
    several = found.groupBy("key").agg(F.sum("n").alias("times")).filter("times > 1").select("key")
    return found.join(several, "key", "left_semi")


def _distinct(candidates: DataFrame) -> DataFrame:
    """key, digest, several (does it stand more than once?) and the first place of each different piece."""
    place = F.struct("doc_id", "of", "at")
    made = candidates.groupBy("key", "digest").agg(F.min(place).alias("first"), F.count("*").alias("times"), F.min("size").alias("size"))
    return made.select("key", "digest", (F.col("times") > 1).alias("several"), "size", "first.doc_id", "first.of", "first.at")


def _sorted_groups(docs: DataFrame, distinct: DataFrame, length: int, partitions: int) -> DataFrame:
    """key, digest and spans (first string and number, int32 one after another) of the repeated strings of each different piece."""

    def content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = text.encode()
                rows = [(p["key"], p["digest"], p["several"], raw[p["at"] : p["at"] + p["size"] + length - 1]) for p in places]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["key", "digest", "several", "raw"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def settle() -> pa.RecordBatch:
            out = []
            for (key, digest, several, _), hit in zip(held, repeated([x[3] for x in held], length), strict=True):
                if several:
                    hit = np.ones(len(hit), dtype=bool)
                edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).view(np.int8))).astype(np.int32)
                if len(edge):
                    edge[1::2] -= edge[0::2]
                    out.append((key, digest, edge.tobytes()))
            held.clear()
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["key", "digest", "spans"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and row[:2] == held[-1][:2]:  # of equal rows of the table
                    continue
                if size >= TOGETHER and row[0] != held[-1][0]:
                    yield settle()
                    size = 0
                held.append(row)
                size += len(row[3])
        if held:
            yield settle()

    made = _with_text(docs, distinct, ["key", "digest", "several", "at", "size"]).select("text", "places").mapInArrow(content, "key long, digest long, several boolean, raw binary")
    return made.repartition(partitions, "key").sortWithinPartitions("key", "digest").mapInArrow(sort, "key long, digest long, spans binary")


def repeated_strings(docs: DataFrame, length: int = LENGTH, key_bytes: int = KEY_BYTES, hot: int = HOT) -> DataFrame:
    """of (md5 of the text) and runs: at and spans (binary) of the repeated strings of each different text that has any. docs: doc_id, of, text, without nulls."""
    session = docs.sparkSession
    scratch = Scratch(session, "suffixes")
    partitions = int(session.conf.get("spark.sql.shuffle.partitions"))
    found = scratch.save(_candidates(_cut(docs, length, key_bytes)), "pieces")
    distinct = scratch.save(_distinct(found), "distinct")
    crowded = scratch.save(distinct.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("key"), "crowded")
    if not crowded.isEmpty():
        # more different pieces of one key than a task should hold: they meet string by string
        strings = scratch.save(_candidates(_strings(docs, found.join(crowded, "key", "left_semi"), length)), "strings")
        found = found.join(crowded, "key", "left_anti").union(strings)
        distinct = distinct.join(crowded, "key", "left_anti").union(_distinct(strings))
    spans = scratch.save(_sorted_groups(docs, distinct, length, partitions), "spans")
    hits = found.select("key", "digest", "of", "at").join(spans, ["key", "digest"])
    return hits.groupBy("of").agg(F.collect_set(F.struct("at", "spans")).alias("runs"))


def _removed(runs: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes under repeated strings, as start and end."""
    if not runs:
        return []
    runs = sorted((r["at"], r["spans"]) for r in runs)
    pairs = np.frombuffer(b"".join(s for _, s in runs), dtype=np.int32).reshape(-1, 2)
    first = pairs[:, 0] + np.repeat([at for at, _ in runs], [len(s) // 8 for _, s in runs])
    spans = np.stack((first, first + pairs[:, 1] + (length - 1)), axis=1)
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    last = np.append(np.flatnonzero(new)[1:], len(spans)) - 1
    return list(zip(spans[new, 0].tolist(), reach[last].tolist(), strict=True))


def dedup_suffixes(docs: DataFrame, length: int = LENGTH, key_bytes: int = KEY_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, raw (the text's UTF-8 bytes), kept (what stays of them) and removed (start and end in bytes of raw) for every row.

    A byte goes if a string of ``length`` bytes over it starts anywhere else in the table as well, in
    the same text included; strings are judged on the input, and never cross texts. ``length`` is a
    multiple of eight. Null texts count as empty; texts of fewer bytes lose nothing. Rows of equal
    doc_id are texts of their own, equal rows copies of each other, and a null doc_id is an id like
    others. An empty table gives an empty result; columns besides doc_id and text are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("of", text_id(F.col("text")))
    known = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)))
    runs = repeated_strings(known.filter(F.octet_length("text") >= length), length, key_bytes, hot).withColumnRenamed("of", "__of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            raws, kepts, removed = [], [], []
            for text, runs_ in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw, spans = text.encode(), _removed(runs_, length)
                edges = [0, *(x for s in spans for x in s), len(raw)]
                raws.append(raw)
                kepts.append(b"".join(raw[s:e] for s, e in zip(edges[0::2], edges[1::2], strict=True)))
                removed.append([{"start": s, "end": e} for s, e in spans])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raws, pa.binary()), pa.array(kepts, pa.binary()), pa.array(removed, kind)], names=["doc_id", "raw", "kept", "removed"])

    joined = rows.join(runs, F.col("of") == F.col("__of"), "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(run, "doc_id long, raw binary, kept binary, removed array<struct<start:bigint,end:bigint>>")


def digests(deduped: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of what dedup_suffixes gives."""
    n = lambda c: F.octet_length(c).cast("long")
    return deduped.select("doc_id", n("raw").alias("n_bytes"), (n("raw") - n("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


