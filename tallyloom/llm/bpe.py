"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of a pre-token are a linked list. Every neighbouring pair that some merge joins waits in
the bucket of that merge's rank. A bitmap of two levels over the ranks marks the buckets that hold
something, so find-first-set on one word a level gives the next rank. Buckets hold list positions;
an entry that a later merge has made stale is skipped when its bucket is taken out.

The pre-tokens of many texts lie in one list, without links from one to the next, and share the
queue: what waits under the least rank is merged at once, in all of them. Of pairs that overlap the
left one comes first, and where a merge opens a pair of lower rank, only the leftmost of its
pre-token is merged before the queue is asked again. A bucket is sorted when it is taken out, so n
bytes take O(n log n) steps, however long a pre-token is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The bitmap has two levels, of words of 256 bits: below for the ranks, above for the words below.
SHIFT, MASK = 8, 255
#: Encoded pre-tokens that a task remembers in each of two generations.
REMEMBERED = 100_000
#: Characters beyond which a pre-token is not remembered.
LONG = 64
#: Texts whose pre-tokens are encoded together, in characters.
TOGETHER = 1_000_000


class BytePairs:
    """A vocabulary of byte strings by rank and the split of texts into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.ranks = ranks
        self.strings = {r: b for b, r in ranks.items()}
        self.split = regex.compile(pattern)
        self.none = max(ranks.values()) + 1  # the id beyond either end of a pre-token, which no merge joins
        joins = {ranks[l] * self.none + ranks[r]: i for b, i in ranks.items() for k in range(1, len(b)) if (l := b[:k]) in ranks and (r := b[k:]) in ranks}
        self.pairs = np.array(sorted(joins), dtype=np.int64)
        self.joined = np.array([*map(joins.__getitem__, self.pairs.tolist()), -1], dtype=np.int32)
        self.bytes = np.array([ranks[bytes([x])] for x in range(256)], dtype=np.int32)
        self.decimal = {r: b"%d " % r for r in self.strings}
        self.remembered, self.known, self.old = remembered, {}, {}

    @classmethod
    def load(cls, path: str, pattern: str) -> BytePairs:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge that joins each left with each right id, or -1."""
        key = left.astype(np.int64) * self.none + right
        at = np.searchsorted(self.pairs, key)
        found = self.joined[at]
        found[self.pairs[np.minimum(at, len(self.pairs) - 1)] != key] = -1
        found[(left == self.none) | (right == self.none)] = -1
        return found

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token (none is empty). Merging takes the smallest rank first and then the leftmost pair."""
        if not pieces:
            return []
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ends, n = np.cumsum(size), int(size.sum())
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
        # place n stands for what is beyond either end
        ids = np.append(self.bytes[np.frombuffer(b"".join(pieces), dtype=np.uint8)], self.none)
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends - 1], before[ends - size] = n, n
        waiting = self.rank(ids, ids[np.minimum(after, n)])  # the rank under which a place now waits
        waiting[n] = -1
        start = np.flatnonzero(waiting >= 0)
        start = start[np.argsort(waiting[start], kind="stable")]
        ranks, cuts = np.unique(waiting[start], return_index=True)
        buckets = dict(zip(ranks.tolist(), np.split(start, cuts[1:]), strict=True)) if len(ranks) else {}
        later: dict[int, list[int]] = {}
        below, above = [0] * ((self.none >> SHIFT) + 1), 0
        for r in buckets:
            below[r >> SHIFT] |= 1 << (r & MASK)
            above |= 1 << (r >> SHIFT)
        while above:
            at = (above & -above).bit_length() - 1
            word = below[at]
            rank = at << SHIFT | (word & -word).bit_length() - 1
            below[at] = word = word & word - 1
            if not word:
                above &= above - 1
            i = buckets.pop(rank, None)
            if (more := later.pop(rank, None)) is not None:
                i = np.array(sorted(set(more)), dtype=np.int64) if i is None else np.union1d(i, more)
            i = i[waiting[i] == rank]
            if len(i) > 1 and ((own := piece[i])[1:] == own[:-1]).any():
                i, rest = self._at_once(i, own, rank, ids, after, before)
                if len(rest):
                    buckets[rank] = rest
                    below[at] |= 1 << (rank & MASK)
                    above |= 1 << at
            if not len(i):
                continue
            j = after[i]
            k = after[j]
            ids[i], ids[j], waiting[j] = rank, -1, -1
            after[i], before[k] = k, i
            left = np.concatenate((before[i], i))
            fresh = self.rank(ids[left], ids[np.concatenate((i, k))])
            waiting[left] = fresh
            good = fresh >= 0
            for r, x in zip(fresh[good].tolist(), left[good].tolist(), strict=True):
                if r in later:
                    later[r].append(x)
                else:
                    later[r] = [x]
                    below[r >> SHIFT] |= 1 << (r & MASK)
                    above |= 1 << (r >> SHIFT)
        live = np.flatnonzero(ids[:n] >= 0)
        flat, bounds = ids[live].tolist(), np.searchsorted(live, ends).tolist()
        return [flat[a:b] for a, b in zip([0, *bounds[:-1]], bounds, strict=True)]

    def _at_once(self, i: np.ndarray, own: np.ndarray, rank: int, ids: np.ndarray, after: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which places of a bucket, in order and of pre-tokens own, can be merged at once, and which wait for the next turn.

        In a row of overlapping pairs every other one can, from the left. Where that would open a pair
        of lower rank, the pre-token's other pairs wait.
        """
        at = np.arange(len(i))
        apart = np.concatenate(([True], after[i[:-1]] != i[1:]))
        row = np.maximum.accumulate(np.where(apart, at, 0))
        pick = (at - row) % 2 == 0
        go, mine = i[pick], own[pick]
        same = np.full(len(go), rank)
        opened = np.stack((self.rank(ids[before[go]], same), self.rank(same, ids[after[after[go]]]), self.rank(same, same)))
        low = ((opened >= 0) & (opened < rank)).any(axis=0)
        if not low.any():
            return go, i[:0]
        slow = np.unique(mine[low])
        first = np.concatenate(([True], own[1:] != own[:-1]))
        waits = np.isin(own, slow) & ~first
        return i[pick & ~waits], i[waits]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        """Ids of distinct pre-tokens. One that the vocabulary has as a whole is that id."""
        raw = [p.encode() for p in pieces]
        out = [[r] if (r := self.ranks.get(b)) is not None else None for b in raw]
        apart = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(apart, self.encode_pieces([raw[k] for k in apart]), strict=True):
            out[k] = x
        return out

    def _split(self, texts: list[str]) -> Iterator[list[list[str]]]:
        """The pre-tokens of each text, for texts of a bounded length together."""
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= TOGETHER):
                size += len(texts[end])
                end += 1
            yield list(map(self.split.findall, texts[start:end]))
            start = end

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        for split in self._split(texts):
            distinct = list(set().union(*split))
            ids = dict(zip(distinct, self._ids(distinct), strict=True))
            for pieces in split:
                yield [x for p in pieces for x in ids[p]]

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text the number of ids, sha256 of the decimal ids, sha256 of the bytes decoded from the ids."""
        for split in self._split(texts):
            wanted = set().union(*split).difference(self.known)
            found = [p for p in wanted if p in self.old]
            self.known.update(zip(found, map(self.old.__getitem__, found), strict=True))
            fresh = list(wanted.difference(found))
            for p, ids in zip(fresh, self._ids(fresh), strict=True):
                self.known[p] = b"".join(map(self.decimal.__getitem__, ids)), self.decode(ids)
            for pieces in split:
                of_ids, of_bytes, n = hashlib.sha256(), hashlib.sha256(), 0
                for at in range(0, len(pieces), 4096):
                    ids, raw = zip(*map(self.known.__getitem__, pieces[at : at + 4096]), strict=True)
                    joined = b"".join(ids)
                    n += joined.count(b" ")
                    of_ids.update(joined if at + 4096 < len(pieces) else joined[:-1])
                    of_bytes.update(b"".join(raw))
                yield n, of_ids.hexdigest(), of_bytes.hexdigest()
            for p in fresh:
                if len(p) > LONG:
                    del self.known[p]
            if len(self.known) > self.remembered:
                self.known, self.old = {}, self.known

    def forget(self) -> None:
        """What is remembered goes, so that an idle worker holds no more than the vocabulary."""
        self.known, self.old = {}, {}


_LOADED: dict[tuple[str, str], BytePairs] = {}


def loaded(path: str, pattern: str) -> BytePairs:
    """One vocabulary a worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = BytePairs.load(path, pattern)
    return _LOADED[path, pattern]


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) for every row; a null or empty text has no ids.

    Each match of the pattern is encoded apart, without special tokens. Rows are encoded one by
    one: repeated rows give repeated results, an empty table an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = loaded(path, pattern)
        for b in batches:
            ids = list(pairs.encode(_texts(b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes (binary) of ids; null ids count as none. An id that the vocabulary lacks is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = loaded(path, pattern)
        for b in batches:
            raw = [pairs.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every row; a null text counts as empty.

    The ids of a whole text are made and decoded again piece by piece and go into the two digests
    as they come, so that a very long text takes no more memory than its pieces. A task remembers
    pieces it has encoded, up to a fixed number, which changes no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = loaded(path, pattern)
        for b in batches:
            made = list(pairs.digests(_texts(b.column(1))))
            n, ids, raw = zip(*made, strict=True) if made else ((), (), ())
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        pairs.forget()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
