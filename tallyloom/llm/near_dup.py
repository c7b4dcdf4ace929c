"""MinHash near-dedup with tensored banding.

Two small collections of m sub-keys, each of ``width`` minhashes, are made for a set, and the m x m
pairs of one sub-key from either collection are its table keys. So 2 m width minhashes give m * m
keys of 2 width minhashes each; keys made one by one would take m * m * 2 width. Sets that share a
key are candidates, and the full sets confirm each link.

Equal sets are one node from the start, and no bucket is joined with itself as a whole. First every
member of a bucket meets only the bucket's pivot, the member of least priority. What lies within half
of a pivot is one cluster, and of a cluster that the links leave in several parts, the parts are
compared in blocks that give out links between parts only. Two members of a bucket in different
clusters can only be similar if both are far from the pivot and about equally far (the triangle
inequality of Jaccard distances). Of these a pair meets only if it also shares one of the rarest
shingles of either: sets of that similarity agree in so many shingles that they cannot do without,
while texts of one template, which fill a bucket, share what is frequent. So no bucket is joined with
itself there either, and what meets grows with the members.

What is measured in one place leaves it as a spanning forest: one edge for each member that a link
newly joins, however many pivots it is similar to. So edges grow with the members of a group.

With m = 14 and width = 3, a pair of similarity 0.8 shares no key with a probability of 0.00009, one
of 0.9 with less than 0.0000001.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.components import components
from tallyloom.llm.scratch import Scratch
from tallyloom.llm.words import mix64, shingle_set, word_hashes

SUB_KEYS, WIDTH = 14, 3
#: Nodes of one side of a block, and shingles of a block that are counted at once.
BLOCK_NODES, BLOCK_SHINGLES = 400, 8192
#: Members of one pivot that are measured together.
HOME_NODES = 2000
#: Texts hashed together, in bytes, and nodes whose keys are dealt out together.
TEXT_BYTES, KEY_NODES = 2_000_000, 1000
#: Keys of one part of the key space, which a task holds at once (14 bytes each).
PART_KEYS = 2_000_000
#: Cells in which shingles are counted for their order, by their hash, in blocks that add up apart.
CELLS, CELL_BLOCK = 1 << 18, 4096
#: What a row of _measured says: a link of the forest of similar sets, one of the forest of near sets, a distance.
SIMILAR, NEAR, APART = 0, 1, 2
_NO_ID = -(2**63)


def _sets(batch: pa.RecordBatch, at: int, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and shingle set for each row of a batch, a bounded number of bytes at a time."""
    texts = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= TEXT_BYTES):
            size += len(texts[end])
            end += 1
        words, bounds = word_hashes(texts[start:end])
        for i in range(end - start):
            yield start + i, shingle_set(words[bounds[i] : bounds[i + 1]], n)
        start = end


def node_of(s: np.ndarray) -> int | None:
    """A 64-bit hash of a whole set; equal sets are one node of the graph."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())))) if len(s) else None


def min_hashes(s: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least = (factors[:, None] * s[None, :2048]).min(axis=1)
    for k in range(2048, len(s), 2048):
        np.minimum(least, (factors[:, None] * s[None, k : k + 2048]).min(axis=1), out=least)
    return least >> np.uint64(32)


def _factors(m: int, width: int) -> np.ndarray:
    return mix64(np.arange(2 * m * width, dtype=np.uint64) + np.uint64(0x51ED27)) | np.uint64(1)


def signatures(docs: DataFrame, n: int, m: int, width: int) -> DataFrame:
    """doc_id, text_hash, node, n_shingles and sub_keys (2 m hashes, binary); an empty set has neither node nor sub-keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(m, width)
        for b in batches:
            nodes, sizes, subs = [], [], []
            for _, s in _sets(b, 2, n):
                nodes.append(node_of(s))
                sizes.append(len(s))
                if not len(s):
                    subs.append(None)
                    continue
                h = min_hashes(s, factors).reshape(2 * m, width)
                key = np.arange(2 * m, dtype=np.uint64)
                for w in range(width):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + h[:, w])
                subs.append(key.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(subs, pa.binary())], names=["doc_id", "text_hash", "node", "n_shingles", "sub_keys"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, node long, n_shingles long, sub_keys binary")


def _dealt(nodes: DataFrame, m: int, parts: int) -> DataFrame:
    """The keys of all nodes, packed for each part of the key space: part, keys, nodes and sizes (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, KEY_NODES):
                c = b.slice(at, KEY_NODES)
                sub = np.frombuffer(b"".join(c.column(2).to_pylist()), dtype=np.uint64).reshape(-1, 2, m)
                keys = mix64(sub[:, 0, :, None] * np.uint64(0xC2B2AE3D27D4EB4F) + sub[:, 1, None, :]).reshape(-1)
                ids = np.repeat(c.column(0).to_numpy(), m * m)
                size = np.repeat((64 * np.log2(c.column(1).to_numpy())).astype(np.int16), m * m)
                part = (keys >> np.uint64(32)) % np.uint64(parts)
                order = np.argsort(part.astype(np.uint16) if parts < 65536 else part, kind="stable")
                keys, ids, size = keys[order].astype(np.uint32), ids[order], size[order]
                bounds = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
                full = np.flatnonzero(np.diff(bounds))
                packed = [[x[bounds[p] : bounds[p + 1]].tobytes() for p in full] for x in (keys, ids, size)]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], names=["part", "keys", "nodes", "sizes"])

    return nodes.select("node", "n_shingles", "sub_keys").mapInArrow(run, "part int, keys binary, nodes binary, sizes binary")


def _reach(percent: int) -> float:
    """How far apart sizes of similar sets can be, in 64ths of a power of two."""
    return 64 * float(np.log2(100 / percent)) + 1.5


def _buckets(dealt: DataFrame) -> DataFrame:
    """Members of all buckets that hold several nodes: bucket, node, size and pivot.

    A member much larger or smaller than its pivot has one too: the distance between them is what
    tells which members of the bucket may be similar to it.
    """

    def members(part: int, rows: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch | None:
        keys, ids, size = (np.frombuffer(b"".join(x), dtype=t) for x, t in zip(zip(*rows, strict=True), (np.uint32, np.int64, np.int16), strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        run = np.cumsum(new) - 1
        several = np.bincount(run)[run] > 1
        if not several.any():
            return None
        keys, ids, size, run = keys[several], ids[order][several], size[order][several], run[several]
        columns = [pa.array(keys.astype(np.int64) | (part << 32)), pa.array(ids), pa.array(size.astype(np.int32))]
        starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        counts = np.diff(np.concatenate((starts, [len(run)])))
        rank = np.lexsort((mix64(ids.view(np.uint64)), run))[starts]  # the first of each run by priority
        pivot = np.repeat(rank, counts)
        columns.append(pa.array(ids[pivot]))
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "node", "size", "pivot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = -1, []
        for b in batches:
            for part, *row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if part != now and rows:
                    if (out := members(now, rows)) is not None:
                        yield out
                    rows = []
                now = part
                rows.append(tuple(row))
        if rows and (out := members(now, rows)) is not None:
            yield out

    return dealt.mapInArrow(run, "bucket long, node long, size int, pivot long")


class _Forest:
    """Which nodes of one place are joined already."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def joins(self, a: int, b: int) -> bool:
        """Join two nodes; were they apart?"""
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


def _measured(stars: DataFrame, sets: DataFrame, percent: int, apart: float, partitions: int, home_nodes: int) -> DataFrame:
    """kind, a, b and d, from rows of a pivot a, a member b and n, the number of buckets that they share.

    SIMILAR and NEAR rows are spanning forests, for each place, of the pairs that are similar and of
    those with a distance of at most a half. APART rows are the pairs with a distance d of at least
    ``apart``.

    A member's set goes once to its home, the pivot that it shares most buckets with, and meets all
    its pivots there; most members of a group have one home. A home with very many members is dealt
    out in parts of about ``home_nodes``, each with a copy of the pivots of its members.
    """
    member = stars.groupBy("b").agg(F.collect_list("a").alias("pivots"), F.max_by("a", F.struct("n", "a")).alias("home"))
    parts = member.groupBy("home").agg(F.ceil(F.count("*") / F.lit(float(home_nodes))).cast("int").alias("parts"))
    member = member.join(parts, "home").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    pivot = member.select("home", "part", F.explode("pivots").alias("a")).distinct()
    none = F.array().cast("array<long>")
    first = pivot.join(sets, F.col("a") == F.col("node")).select("home", "part", F.lit(False).alias("member"), "node", none.alias("pivots"), "shingles")
    then = member.join(sets, F.col("b") == F.col("node")).select("home", "part", F.lit(True).alias("member"), "node", "pivots", "shingles")
    dealt = first.union(then).repartition(partitions, "home", "part").sortWithinPartitions("home", "part", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, similar, near = None, {}, _Forest(), _Forest()
        for batch in batches:
            out = []
            for home, part, is_member, node, pivots, shingles in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (home, part) != now:
                    now, known, similar, near = (home, part), {}, _Forest(), _Forest()
                s = np.frombuffer(shingles, dtype=np.uint64)
                if not is_member:
                    known[node] = s
                    continue
                for a in pivots:
                    both = np.concatenate((known[a], s))
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    union = len(both) - common
                    d = 1 - common / union
                    if 100 * common >= percent * union and similar.joins(a, node):
                        out.append((SIMILAR, a, node, d))
                    if 2 * common >= union and near.joins(a, node):
                        out.append((NEAR, a, node, d))
                    if d >= apart:
                        out.append((APART, a, node, d))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["kind", "a", "b", "d"])

    return dealt.mapInArrow(run, "kind int, a long, b long, d double")


def _counts(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set with each other set, as a matrix."""
    values, place = np.unique(np.concatenate([*sets, *others]), return_inverse=True)
    row = np.repeat(np.arange(len(sets) + len(others)), [len(x) for x in (*sets, *others)])
    left = row < len(sets)
    shared = (np.bincount(place[left], minlength=len(values)) > 0) & (np.bincount(place[~left], minlength=len(values)) > 0)
    number = np.cumsum(shared) - 1
    keep = shared[place]
    row, place, left = row[keep], number[place[keep]], left[keep]
    out = np.zeros((len(sets), len(others)), dtype=np.float32)
    order = np.argsort(place, kind="stable")
    row, place, left = row[order], place[order], left[order]
    for at in range(0, int(shared.sum()), BLOCK_SHINGLES):
        lo, hi = np.searchsorted(place, (at, at + BLOCK_SHINGLES))
        r, p, side = row[lo:hi], place[lo:hi] - at, left[lo:hi]
        x, y = (np.zeros((n, BLOCK_SHINGLES), dtype=np.float32) for n in out.shape)
        x[r[side], p[side]] = 1
        y[r[~side] - len(sets), p[~side]] = 1
        out += x @ y.T
    return out


def _across(clusters: DataFrame, sets: DataFrame, percent: int, partitions: int, block_nodes: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between labels of one cluster, from rows of cluster, label and node.

    The nodes of clusters in several parts are few as a rule. They are written first, so that Spark
    knows their size and only deals out the sets where they are many.

    The cluster's most frequent label need not be compared with itself. The nodes of the others and
    its own are cut into blocks, and every pair of blocks with a node of the others is one group of
    at most about 2 x ``block_nodes`` nodes.
    """
    sizes = clusters.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    blocks = lambda n: F.ceil(n / F.lit(float(block_nodes))).cast("int")
    of = (
        sizes.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n"))
        .filter(F.col("n") > F.col("main.n"))
        .select(F.col("cluster").alias("of"), F.col("main.label").alias("main"), blocks(F.col("main.n")).alias("many"), blocks(F.col("n") - F.col("main.n")).alias("few"))
    )
    placed = (
        clusters.join(of, F.col("cluster") == F.col("of"))
        .withColumn("is_main", F.col("label") == F.col("main"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("many")).otherwise(F.col("few"))).cast("int"))
        .select("node", "label", "cluster", "is_main", "many", "few", "block")
    )
    placed = scratch.save(placed, "parted")
    place = lambda kind, x, y, left: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), left.alias("left"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = F.col("block")
    of_main = F.transform(upto("few"), lambda i: place(1, i, own, F.lit(False)))
    among_few = F.transform(upto("few"), lambda i: place(0, F.least(i, own), F.greatest(i, own), own <= i))
    to_main = F.transform(upto("many"), lambda i: place(1, own, i, F.lit(True)))
    groups = placed.join(sets, "node").withColumn("at", F.explode(F.when(F.col("is_main"), of_main).otherwise(F.concat(among_few, to_main))))
    dealt = groups.select("cluster", "at.kind", "at.x", "at.y", "at.left", "label", "shingles").repartition(partitions, "cluster", "kind", "x", "y").sortWithinPartitions("cluster", "kind", "x", "y")

    def linked(group: list[tuple[bool, int, bytes]]) -> pa.RecordBatch:
        sides = [[(label, np.frombuffer(s, dtype=np.uint64)) for side, label, s in group if side == left] for left in (True, False)]
        one, other = sides[0], sides[1] or sides[0]
        common = _counts([s for _, s in one], [s for _, s in other]).astype(np.int64) if one else np.zeros((0, len(other)), dtype=np.int64)
        total = np.array([len(s) for _, s in one], dtype=np.int64)[:, None] + np.array([len(s) for _, s in other], dtype=np.int64)[None, :]
        la, lb = np.array([x for x, _ in one], dtype=np.int64), np.array([x for x, _ in other], dtype=np.int64)
        i, j = np.nonzero((100 * common >= percent * (total - common)) & (la[:, None] != lb[None, :]))
        found = np.unique(np.stack((np.minimum(la[i], lb[j]), np.maximum(la[i], lb[j])), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []
        for b in batches:
            for *key, left, label, shingles in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if key != now:
                    if group:
                        yield linked(group)
                    now, group = key, []
                group.append((left, label, shingles))
        if group:
            yield linked(group)

    return dealt.mapInArrow(run, "a long, b long")


def _cell_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall into each of CELLS cells. A fixed size, however many sets."""
    spark = sets.sparkSession

    def packed(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = total.reshape(-1, CELL_BLOCK)
        full = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([rows[k].tobytes() for k in full], pa.binary())], names=["block", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        for b in batches:
            shingles = np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=np.uint64)
            total += np.bincount((shingles & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        yield from packed(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[block * CELL_BLOCK : (block + 1) * CELL_BLOCK] += np.frombuffer(counts, dtype=np.int64)
        yield from packed(total)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = "block int, counts binary"
    counted = sets.select("shingles").mapInArrow(count, kind).repartition(parts, "block").mapInArrow(add, kind)
    total = np.zeros(CELLS, dtype=np.int64)
    for r in counted.collect():  # one row a block
        total[r.block * CELL_BLOCK : (r.block + 1) * CELL_BLOCK] = np.frombuffer(bytes(r.counts), dtype=np.int64)
    return total


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """node, cluster and shingle for the first n - ceil(n percent / 100) + 1 shingles of each set of n, in one order of all shingles that puts rare cells first.

    Of two sets of at least this similarity both have a shingle among these in common.
    """
    shared = sets.sparkSession.sparkContext.broadcast(_cell_counts(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for b in batches:
            for node, cluster, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = np.frombuffer(raw, dtype=np.uint64)
                first = len(s) - -(-len(s) * percent // 100) + 1
                order = np.lexsort((s, counts[(s & np.uint64(CELLS - 1)).astype(np.int64)]))[:first]
                same = [pa.array(np.full(len(order), x, dtype=np.int64)) for x in (node, cluster)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(s[order].view(np.int64))], names=["node", "cluster", "shingle"])

    return sets.select("node", "cluster", "shingles").mapInArrow(run, "node long, cluster long, shingle long")


def _far_pairs(far: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """a, b and n (places where they met) for members of a bucket in different clusters that may be similar.

    far: bucket, node, size, cluster and d (distance to the bucket's pivot).
    """
    reach = 1 - percent / 100 + 1e-9
    several = far.groupBy("bucket").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).filter("lo <> hi").select("bucket")
    far = scratch.save(far.join(several, "bucket", "left_semi"), "apart")
    mine = scratch.save(sets.join(far.select("node", "cluster").distinct(), "node").dropDuplicates(["node"]), "far-sets")
    rarest = scratch.save(_rarest(mine, percent), "rarest")
    # what only one cluster has leads nowhere
    shared = rarest.groupBy("shingle").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).filter("lo <> hi").select("shingle")
    met = far.join(rarest.join(shared, "shingle", "left_semi").select("node", "shingle"), "node")
    met = scratch.save(met.select("bucket", "shingle", "node", "size", "cluster", "d"), "met")
    left, right = met.toDF("bucket", "shingle", "a", "sa", "ca", "da"), met.toDF("bucket", "shingle", "b", "sb", "cb", "db")
    close = (F.col("ca") != F.col("cb")) & (F.abs(F.col("sa") - F.col("sb")) <= _reach(percent)) & (F.abs(F.col("da") - F.col("db")) <= reach)
    # few as a rule: written first, so that Spark knows their size
    return scratch.save(left.join(right, ["bucket", "shingle"]).filter((F.col("a") < F.col("b")) & close).groupBy("a", "b").agg(F.count("*").alias("n")), "pairs")


def near_groups(docs: DataFrame, n: int = 5, percent: int = 80, m: int = SUB_KEYS, width: int = WIDTH, block_nodes: int = BLOCK_NODES, home_nodes: int = HOME_NODES) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), n_shingles, group_id and component_id for every row of documents.

    group_id is the same for rows that links connect, and null for a row without words; it tells
    components apart where ids are null or repeated. For the rest see near_duplicates.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = scratch.save(signatures(docs, n, m, width), "signed")
    filled = signed.filter("node is not null")
    nodes = scratch.save(filled.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("sub_keys").alias("sub_keys")), "nodes")

    parts = max(4 * partitions, -(-nodes.count() * m * m // PART_KEYS))
    dealt = _dealt(nodes, m, parts).repartition(partitions, "part").sortWithinPartitions("part")
    buckets = scratch.save(_buckets(dealt), "buckets")
    members = scratch.save(buckets.select("node").distinct(), "members")
    wanted = nodes.join(members, "node", "left_semi").select(F.coalesce("first_id", F.lit(_NO_ID)).alias("wanted_id")).distinct()
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("wanted_id"), "text").join(wanted, "wanted_id")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(node_of(s), s.tobytes()) for _, s in _sets(b, 0, n) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made], pa.binary())], names=["node", "shingles"])

    # rows of one id with other texts may add nodes here that nothing asks for
    sets = scratch.save(texts.select("text").mapInArrow(with_sets, "node long, shingles binary"), "sets")

    # two similar members of a bucket in different clusters: one is further than 0.5 from the pivot, the other within reach of that
    reach = 1 - percent / 100 + 1e-9
    stars = buckets.filter("pivot <> node").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n"))
    measured = scratch.save(_measured(stars, sets, percent, 0.5 - reach, partitions, home_nodes), "measured")
    edges = lambda kind: measured.filter(F.col("kind") == kind).select("a", "b")
    linked = components(edges(SIMILAR), scratch, "linked")
    near = components(edges(NEAR), scratch, "near")
    placed = members.join(linked, "node", "left").join(near.withColumnRenamed("label", "cluster"), "node", "left")
    placed = scratch.save(placed.select("node", F.coalesce("label", "node").alias("label"), F.coalesce("cluster", "node").alias("cluster")), "placed")
    across = _across(placed, sets, percent, partitions, block_nodes, scratch)

    apart = measured.filter(F.col("kind") == APART).select(F.col("a").alias("pivot"), F.col("b").alias("node"), "d")
    far = scratch.save(buckets.join(apart, ["pivot", "node"]).join(placed, "node").select("bucket", "node", "size", "label", "cluster", "d"), "far")
    pairs = _far_pairs(far, sets, percent, scratch)
    of = lambda end: placed.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))
    rest = _measured(pairs, sets, percent, 2.0, partitions, home_nodes).filter(F.col("kind") == SIMILAR).join(of("a"), "a").join(of("b"), "b").select("la", "lb")
    joined = components(across.union(rest).toDF("a", "b"), scratch, "joined").toDF("label", "least")

    grouped = placed.select("node", "label").join(joined, "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    grouped = scratch.save(grouped.join(nodes.select("node", "first_id"), "node"), "grouped")
    least = grouped.groupBy("label").agg(F.min("first_id").alias("least_id"))
    final = nodes.select("node", "first_id").join(grouped.join(least, "label").select("node", "label", "least_id"), "node", "left")
    final = final.select("node", F.coalesce("label", "node").alias("group_id"), F.when(F.col("label").isNull(), F.col("first_id")).otherwise(F.col("least_id")).alias("component_id"))
    with_words = filled.select("doc_id", "text_hash", "n_shingles", "node").join(final, "node").select("doc_id", "text_hash", "n_shingles", "group_id", "component_id")
    without = signed.filter("node is null").select("doc_id", "text_hash", "n_shingles", F.lit(None).cast("long").alias("group_id"), F.col("doc_id").alias("component_id"))
    return with_words.union(without)


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, m: int = SUB_KEYS, width: int = WIDTH, block_nodes: int = BLOCK_NODES, home_nodes: int = HOME_NODES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of documents.

    A-Z are lower-cased and words are runs of anything but ASCII white space; a row's set has the
    distinct n-word shingles of its whole text, or of fewer words the whole sequence. Rows are
    linked if 100 x intersection >= percent x union. component_id is the least doc_id that links
    reach, and kept says that it is the row's own. A null text or one without words has the empty
    set and no link, so its component is itself. Rows of equal doc_id are judged each by its own
    text; a null doc_id is never a component's least unless all are null. An empty table gives an
    empty result; columns besides doc_id and text are not read.
    """
    found = near_groups(docs, n, percent, m, width, block_nodes, home_nodes)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near copies, with all columns of docs.

    That is the row of least doc_id (null last), and among rows of that id the one of least text
    hash. Rows equal in id and text are one, and any of them stays. A null text, or one without
    words, is near nothing: it stays, once for each id. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "near-kept")
    groups = near_groups(docs, n, percent)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    # a row without words is a group of its own: its id and its text
    own = F.when(F.col("group_id").isNull(), F.struct("doc_id", "text_hash"))
    chosen = groups.groupBy("group_id", own.alias("own")).agg(F.min(first).alias("least"))
    rows = groups.groupBy("doc_id", "text_hash").count().filter("count > 1").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    kept = scratch.save(chosen.select(F.col("least.doc_id").alias("id"), F.col("least.text_hash").alias("hash")).distinct(), "kept")
    repeated = scratch.save(rows, "repeated")

    def of(some: DataFrame, how: str) -> DataFrame:
        return docs.join(some, docs["doc_id"].eqNullSafe(some["id"]) & (F.xxhash64(docs["text"]) == some["hash"]), how)

    several = of(kept.join(repeated, kept["id"].eqNullSafe(repeated["id"]) & (kept["hash"] == repeated["hash"]), "left_semi"), "left_semi")
    alone = kept.join(repeated, kept["id"].eqNullSafe(repeated["id"]) & (kept["hash"] == repeated["hash"]), "left_anti")
    return of(alone, "left_semi").union(several.dropDuplicates(["doc_id", "text"]))
