"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, by a count-vector R-tree.

A document's set holds the 64-bit hashes of its shingles; equal sets are one point. Shingles are hashed into groups, and the counts of a set's
shingles by group are the point's coordinates. Two sets share at most the sum over groups of the lesser count, and a set shares at most the sum
of the lesser of its counts and a tree node's largest counts with anything below that node; the join walks all queries down an R-tree at once,
keeps what can still reach 4/9 of both sizes (which is what 0.8 means) and verifies the pairs that survive on whole sets.

One tree for all points would be neither distributed nor selective: with this many dimensions every box overlaps every other. So the tree's root is a
set of exact cells. Two sets within 0.8 differ in (|A| + |B|) / 9 shingles at most; dealt into one group more than that, they agree wholly in
one group (pigeonhole). A cell is one group's content, of small sets that leave groups empty also an empty group; sets of one size band and the next are dealt alike, so a link's two ends always meet in
a cell. Cells are found by packs of documents: a pack sends each bucket of cells the cells that it has, once each with its least and greatest
point, and is told which of them are crowded. A cell of a third of all points is thus one entry a pack.

Within crowded cells, all points first meet their cell's leader (those of one leader in blocks), so that a group of copies links as a star.
Where cells still hold several components, points outside a cell's main component then meet the one partner that the bound puts nearest; and what is left after that is joined in full, component against component, in blocks of bounded size. Pairs of one component need no test, so no link between components is lost.

Documents without words have an empty set and link with nothing. Rows may repeat; a null doc_id counts as the largest id. Different shingles
of the same 64-bit hash are as likely as 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

WORDS, GROUPS, PACK, STRETCH = 5, 128, 16 << 20, 1 << 20
#: Cells' keys a bucket, points of a block of a crowded cell, rows of a joining task, and children of a tree node.
KEYS, BLOCK, ROWS, FANOUT = 1_500_000, 4096, 20_000, 8
#: Bands of more groups list no empty ones: that d shingles that differ fall one into each of d groups has the chance d!/d**d, 2**-65 at 48. Sets that
#: fill somewhat fewer groups than d have a larger one, which is small but not bounded here.
SMALL = 48
#: A count of this or more: it bounds nothing.
FULL = (1 << 16) - 1
_U = np.uint64
_ODD = np.random.default_rng(5).integers(0, 1 << 63, 8, dtype=np.uint64) * _U(2) + _U(1)
_BYTES = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2**64."""
    return tuple(np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n, b, np.uint64)])) for b in (_U(_BASE), _U(pow(_BASE, -1, 1 << 64))))


class Shingler:
    def __init__(self):
        self.up, self.down = _powers(STRETCH)

    def sets(self, texts: list[str | None]):
        """The sorted shingle hashes of each text, a stretch of texts at a time."""
        held, size = [], 0
        for t in texts:
            b = (t or "").encode("utf-8", "surrogatepass").lower()
            if held and size + len(b) > STRETCH:
                yield from self._stretch(held)
                held, size = [], 0
            held.append(b)
            size += len(b) + 1
        if held:
            yield from self._stretch(held)

    def _stretch(self, texts: list[bytes]):
        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        if len(data) > len(self.up):
            self.up, self.down = _powers(len(data))
        edge = np.diff(np.concatenate([[1], _SPACE[data], [1]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.concatenate([[_U(0)], np.cumsum(_BYTES[data] * self.up[: len(data)], dtype=np.uint64)])
        words = _mix((sums[end] - sums[start]) * self.down[start])
        whole = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
        for i in range(WORDS):
            whole += words[i : i + len(whole)] * _ODD[i]
        whole = _mix(whole)
        first = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            if hi - lo >= WORDS:
                yield np.unique(whole[lo : hi - WORDS + 1])
            elif hi > lo:
                yield _mix(np.array([hi - lo], np.uint64) + (words[lo:hi] * _ODD[: hi - lo]).sum(dtype=np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def _point(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0


def _points(batches):
    shingler = Shingler()
    for batch in batches:
        h, n, counts = [], [], []
        for s in shingler.sets(batch.column("text").to_pylist()):
            h.append(_point(s))
            n.append(len(s))
            counts.append(np.minimum(np.bincount((s >> _U(57)).astype(np.int64), minlength=GROUPS), FULL).astype(np.uint16).tobytes())
        cols = [batch.column("doc_id"), pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(counts, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "n", "counts"])


def bands(most: int) -> tuple[np.ndarray, np.ndarray]:
    """First sizes of the bands, each 1.25 times as wide as it starts, and the number of groups that a band's sets are dealt into."""
    first, groups = [1], []
    while first[-1] <= most:
        top = first[-1] * 5 // 4
        groups.append((top + top * 5 // 4) // 9 + 1)
        first.append(top + 1)
    return np.array(first), np.array([*groups, 0])


def cells(s: np.ndarray, first: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Keys of a set's cells: the content of each of its groups, as its own band and as the band below deals them.

    A link's sets differ in a quarter of either at most. A set that has shingles in more groups agrees in one of these; one that has not also lists
    its empty groups, since those may be all that agree.
    """
    out, band = [], int(np.searchsorted(first, len(s), "right")) - 1
    for b in range(max(0, band - 1), band + 1):
        group = ((s >> _U(32)) * _U(groups[b])) >> _U(32)
        at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        out.append(_mix(np.add.reduceat(_mix(s), at) + group[at] * _ODD[6] + np.array([b], np.uint64) * _ODD[7]))
        if groups[b] <= SMALL and 4 * len(at) <= len(s):
            empty = np.setdiff1d(np.arange(groups[b], dtype=np.uint64), group[at])
            out.append(_mix(empty * _ODD[6] + np.array([b], np.uint64) * _ODD[7]))
    return np.concatenate(out)


def _shrunk(a: np.ndarray) -> bytes:
    """Integers as compressed bytes, all lowest bytes first."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def _grown(b: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


LISTS = "bucket int, pack long, points binary, keys binary, entries binary, docs binary, low binary, high binary"


def _list(bits: int, most: int):
    """For each pack and bucket: points, distinct keys (differences), entries a key, every entry's point, and least and greatest point a key."""
    first, groups = bands(most)

    def rows(pack: int, sets: dict[int, np.ndarray]):
        points = np.array(sorted(sets), np.uint64)
        keys = [cells(sets[int(p)], first, groups) for p in points]
        docs = np.repeat(np.arange(len(points), dtype=np.uint32), [len(k) for k in keys])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")  # docs ascend within a key
        keys, docs = keys[order], docs[order]
        bucket = (keys >> _U(64 - bits)) if bits else np.zeros(len(keys), np.uint64)
        short = (keys >> _U(32 - bits)).astype(np.uint32)
        out = []
        ends = np.searchsorted(bucket, np.arange((1 << bits) + 1, dtype=np.uint64))
        for b, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            if lo < hi:
                own, who = short[lo:hi], docs[lo:hi]
                at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                n = np.diff(np.append(at, len(own)))
                used, who = np.unique(who, return_inverse=True)
                who = who.astype(np.uint32)
                cols = (np.diff(own[at], prepend=_zero), n.astype(np.uint32), who, np.minimum.reduceat(who, at), np.maximum.reduceat(who, at))
                out.append((b, pack, points[used].tobytes(), *map(_shrunk, cols)))
        types = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["bucket", "pack", "points", "keys", "entries", "docs", "low", "high"])

    def lists(batches):
        shingler, seq, size, held, task = Shingler(), 0, 0, {}, TaskContext.get().partitionId()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for t, s in zip(texts, shingler.sets(texts)):
                if len(s):
                    held[_point(s)] = s
                    size += len(t)
                if size >= PACK:
                    yield rows((task << 24) + seq, held)
                    seq, size, held = seq + 1, 0, {}
        if held:
            yield rows((task << 24) + seq, held)

    return lists


_zero = np.uint32(0)


def _crowded(table: pa.Table) -> pa.Table:
    """For every pack of a bucket the places of its keys that hold different points, and the least of these, their leader."""
    packs, keys, low, high = [], [], [], []
    for r in table.to_pylist():
        points = np.frombuffer(r["points"], np.uint64)
        packs.append(r["pack"])
        keys.append(np.cumsum(_grown(r["keys"], np.uint32), dtype=np.uint32))
        low.append(points[_grown(r["low"], np.uint32)])
        high.append(points[_grown(r["high"], np.uint32)])
    every, least, most = np.concatenate(keys), np.concatenate(low), np.concatenate(high)
    order = np.argsort(every, kind="stable")
    at = np.flatnonzero(np.append(True, np.diff(every[order]) != 0))
    least, most, distinct = np.minimum.reduceat(least[order], at), np.maximum.reduceat(most[order], at), every[order][at]
    several = np.flatnonzero(least != most)
    distinct, least = distinct[several], least[several]
    out = []
    for pack, own in zip(packs, keys):
        if len(distinct):
            to = np.minimum(np.searchsorted(distinct, own), len(distinct) - 1)
            hit = np.flatnonzero(distinct[to] == own)
            if len(hit):
                out.append((table["bucket"][0].as_py(), pack, hit.astype(np.uint32).tobytes(), least[to[hit]].tobytes()))
    cols = list(zip(*out)) or [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int64(), pa.binary(), pa.binary()])], names=["bucket", "pack", "at", "leader"])


def _members(batches):
    """(cell, h, leader) of every entry of a crowded cell."""
    for batch in batches:
        for r in batch.to_pylist():
            points, at = np.frombuffer(r["points"], np.uint64), np.frombuffer(r["at"], np.uint32)
            keys, n = np.cumsum(_grown(r["keys"], np.uint32), dtype=np.uint32), _grown(r["entries"], np.uint32).astype(np.int64)
            docs, begin = _grown(r["docs"], np.uint32), (np.cumsum(n) - n)[at]
            n = n[at]
            entry = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cell = (np.int64(r["bucket"]) << np.int64(32)) | keys[at].astype(np.int64)
            cols = [np.repeat(cell, n), points[docs[entry]].view(np.int64), np.repeat(np.frombuffer(r["leader"], np.int64), n)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["cell", "h", "leader"])


class RTree:
    """Points in the order of cell, size and counts; a node has the range of cells, the least size and the largest counts below it."""

    def __init__(self, cell: np.ndarray, n: np.ndarray, counts: np.ndarray):
        by = np.lexsort((*counts[:, :4].T, n, cell))
        self.order, self.levels = by, [(cell[by], cell[by], n[by], counts[by])]
        while len(self.levels[-1][0]) > 1:
            lo, hi, size, most = self.levels[-1]
            at = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.minimum.reduceat(size, at), np.maximum.reduceat(most, at)))

    def join(self, cell: np.ndarray, n: np.ndarray, counts: np.ndarray, room: int = 1 << 15):
        """(query, point) of one cell that can share 4/9 of both sizes, by the sum of the lesser counts."""
        for lo in range(0, len(cell), 4096):
            todo = [(len(self.levels) - 1, np.arange(lo, min(lo + 4096, len(cell))), np.zeros(min(4096, len(cell) - lo), np.int64))]
            while todo:
                level, q, node = todo.pop()
                first, last, size, most = self.levels[level]
                keep = (first[node] <= cell[q]) & (cell[q] <= last[node])
                q, node = q[keep], node[keep]
                bound = np.minimum(counts[q], most[node]).sum(axis=1, dtype=np.int64)
                keep = 9 * bound >= 4 * (n[q] + size[node])
                q, node = q[keep], node[keep]
                if not level:
                    yield q, self.order[node]
                    continue
                q, node = np.repeat(q, FANOUT), (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                q, node = q[node < len(self.levels[level - 1][0])], node[node < len(self.levels[level - 1][0])]
                todo += [(level - 1, q[i : i + room], node[i : i + room]) for i in range(0, len(q), room)]


def _side(t: pa.Table) -> tuple[np.ndarray, ...]:
    counts = np.frombuffer(b"".join(t["counts"].to_pylist()), np.uint16).astype(np.int32).reshape(-1, GROUPS)
    counts[counts == FULL] = 1 << 30
    return (*(t[c].to_numpy() for c in ("cell", "h", "comp", "n")), counts)


def _joined(parts: int, nearest: bool):
    """The pairs of a task, once each: for every greater point a and part of its partners, their list. nearest: for every query the one partner
    that the bound puts nearest, with that likeness."""

    def joined(queries: pa.Table, indexed: pa.Table) -> pa.Table:
        out, near = [np.zeros((2, 0), np.int64)], [np.zeros(0)]
        if queries.num_rows and indexed.num_rows:
            (qc, qh, qk, qn, qv), (xc, xh, xk, xn, xv) = _side(queries), _side(indexed)
            for q, x in RTree(xc, xn, xv).join(qc, qn, qv):
                keep = qk[q] != xk[x]
                q, x = q[keep], x[keep]
                a, b = qh[q], xh[x]
                if nearest:
                    shared = np.minimum(np.minimum(qv[q], xv[x]).sum(axis=1, dtype=np.int64), np.minimum(qn[q], xn[x]))
                    near.append(shared / (qn[q] + xn[x] - shared))
                    out.append(np.stack([a, b]))
                else:
                    out.append(np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1))
        a, b = np.concatenate(out, axis=1)
        near = np.concatenate(near)
        if nearest:
            by = np.lexsort((b, -near, a))
            at = by[np.flatnonzero(np.append(True, a[by][1:] != a[by][:-1]))] if len(a) else by
            return pa.table([pa.array(a[at]), pa.array(np.zeros(len(at), np.int32)), pa.array([[x] for x in b[at].tolist()], pa.list_(pa.int64())), pa.array(near[at])], names=["a", "part", "bs", "near"])
        a, b = np.unique(np.stack([a, b]), axis=1)
        part = (_mix(b.view(np.uint64)) % _U(parts)).astype(np.int32)
        by = np.lexsort((part, a))
        a, b, part = a[by], b[by], part[by]
        at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (part[1:] != part[:-1]))) if len(a) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(a)).astype(np.int32)), pa.array(b))
        return pa.table([pa.array(a[at]), pa.array(part[at]), lists, pa.array(np.ones(len(at)))], names=["a", "part", "bs", "near"])

    return joined


def tree_join(queries: DataFrame, indexed: DataFrame, points: DataFrame, nearest: bool = False) -> DataFrame:
    """Distinct (a, b) of queries and indexed (cell, h, comp) that share a cell, not a component, and pass the bound. Large cells go in blocks.

    Two points often share many cells; their pair comes once from each task, within a list of partners, and lists of one point meet in parts of
    about a block. nearest: only the pair of each query and the partner that the bound puts nearest.
    """

    def split(df, name):
        return df.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias(name))

    sizes = C.cut(split(queries, "nq").join(split(indexed, "nx"), "cell"))
    blocks, parts = sizes.agg(F.sum(F.col("nq") * F.col("nx")), F.max(F.greatest("nq", "nx"))).first()
    tasks = max(1, -(-(blocks or 0) * 2 // ROWS), -(-queries.count() // ROWS))
    sides = []
    for df, own, other in ((queries, "nq", "nx"), (indexed, "nx", "nq")):
        df = df.join(sizes, "cell").join(points.select("h", "n", "counts"), "h")
        df = df.withColumn(own, F.pmod(F.xxhash64("h"), F.col(own))).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other).cast("int") - 1)))
        block = F.xxhash64("cell", F.col("nq").cast("long"), F.col("nx").cast("long"))
        sides.append(df.select(F.pmod(block, F.lit(tasks)).alias("task"), block.alias("cell"), *(F.col(c).alias(c) for c in ("h", "comp", "n", "counts"))))
    found = sides[0].groupBy("task").cogroup(sides[1].groupBy("task")).applyInArrow(_joined(int(parts or 1), nearest), "a long, part int, bs array<long>, near double")
    if nearest:
        return found.groupBy("a").agg(F.max_by(F.col("bs")[0], F.struct("near", F.col("bs")[0])).alias("b"))
    return found.groupBy("a", "part").agg(F.array_distinct(F.flatten(F.collect_list("bs"))).alias("bs")).select("a", F.explode("bs").alias("b"))


def _verify(batches):
    """The pairs that hold: 100 times what both share is 80 times what either has, or more."""
    shingler, unzip, cache = Shingler(), zstandard.ZstdDecompressor(), {}

    def get(h: int, body: bytes) -> np.ndarray:
        if h not in cache:
            if len(cache) >= 64:
                cache.clear()
            cache[h] = next(shingler.sets([unzip.decompressobj().decompress(body).decode("utf-8", "surrogatepass")]))
        return cache[h]

    for batch in batches:
        out: list[list[int]] = [[], []]
        for r in batch.to_pylist():
            x, y = get(r["a"], r["a_body"]), get(r["b"], r["b_body"])
            both = np.sort(np.concatenate([x, y]))
            shared = int((both[1:] == both[:-1]).sum())
            if 100 * shared >= 80 * (len(x) + len(y) - shared):
                out[0].append(r["a"])
                out[1].append(r["b"])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b"])


def _bodies(batches):
    """Each text by its own point, as ids may repeat with other texts."""
    shingler, zip_ = Shingler(), zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        h = np.array([_point(s) for s in shingler.sets(texts)], np.uint64).view(np.int64)
        bodies = [zip_.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(bodies, pa.binary())], ["h", "body"])


def _held(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(bodies.select(F.col("h").alias(side), F.col("body").alias(f"{side}_body")), side)
    return C.cut(pairs.mapInArrow(_verify, "a long, b long"))


def _named(df: DataFrame, roots: DataFrame, column: str, out: str) -> DataFrame:
    """df with the component of a column of points."""
    own = roots.select(F.col("node").alias(column), F.col("root").alias("__root"))
    return df.join(own, column, "left").withColumn(out, F.coalesce("__root", column)).drop("__root")


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (cell, h) of cells that hold more than one component, with comp."""
    own = _named(members.select("cell", "h"), roots, "h", "comp")
    several = own.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("cell")
    return C.cut(own.join(several, "cell"))


def links(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Edges (a, b) of points h whose components are those of all links; found: (doc_id, h, n, counts) of docs (doc_id, text), text not null."""
    points = C.cut(found.filter("n > 0").groupBy("h").agg(F.min("n").alias("n"), F.min("counts").alias("counts")))
    total, most = points.agg(F.sum("n"), F.max("n")).first()
    bits = max(0, (int(total or 0) // 2 // KEYS).bit_length())
    lists = C.cut(docs.select("text").mapInArrow(_list(bits, int(most or 1)), LISTS))
    crowded = C.cut(lists.select("bucket", "pack", "points", "keys", "low", "high").groupBy("bucket").applyInArrow(_crowded, "bucket int, pack long, at binary, leader binary"))
    entries = lists.drop("low", "high").join(crowded, ["bucket", "pack"])
    members = C.cut(entries.mapInArrow(_members, "cell long, h long, leader long"))
    bodies = docs.select("text").mapInArrow(_bodies, "h long, body binary").join(members.select("h").distinct(), "h")  # texts travel compressed
    bodies = C.cut(bodies.groupBy("h").agg(F.first("body").alias("body")))
    C.free(lists)
    # a point meets the leader that it shares the most cells with
    met = C.cut(members.filter("h <> leader").groupBy("h", "leader").count())
    pairs = C.cut(met.groupBy("h").agg(F.max_by("leader", F.struct("count", "leader")).alias("cell")))
    led = pairs.select("cell").distinct().select("cell", F.col("cell").alias("h"), F.col("cell").alias("comp"))
    edges = _held(tree_join(pairs.select("cell", "h", F.col("h").alias("comp")), led, points), bodies)
    # a cell holds several components if a point's differs from its leader's
    roots = components(edges)
    odd = _named(_named(met, roots, "h", "own"), roots, "leader", "its").filter("own <> its").select("h", "leader")
    mixed = members.join(odd, ["h", "leader"], "left_semi").select("cell").distinct()
    rest = C.cut(_named(members.join(mixed, "cell", "left_semi").select("cell", "h").distinct(), roots, "h", "comp"))
    for nearest in (True, False):
        sizes = rest.groupBy("cell", "comp").count().groupBy("cell").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
        queries = rest.join(sizes, "cell").filter("comp <> main").select("cell", "h", "comp")
        edges = edges.unionByName(_held(C.cut(tree_join(queries, rest.select("cell", "h", "comp"), points, nearest)), bodies))
        if nearest:
            rest = _mixed(rest, components(edges))
    C.free(members, met, rest)
    return edges


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    last = (1 << 63) - 1
    docs = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(last)).alias("doc_id"), C.text_of(docs).alias("text"))
    found = C.cut(docs.mapInArrow(_points, "doc_id long, h long, n long, counts binary"))
    roots = components(links(docs, found))
    own = found.select("doc_id", "h", "n").join(roots, found["h"] == roots["node"], "left").withColumn("root", F.coalesce("root", "h"))
    firsts = own.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    own = own.withColumn("root", F.when(F.col("n") > 0, F.col("root"))).join(firsts, "root", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return own.select(*(F.when(c != last, c).alias(name) if name != "n_shingles" else c.alias(name) for name, c in (("doc_id", F.col("doc_id")), ("n_shingles", F.col("n")), ("component_id", component))))


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_components(C.table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))
), r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT e.a, r.root FROM r JOIN e ON e.b = r.doc_id WHERE r.root < e.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(min(r.root), d.doc_id)::BIGINT AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
