"""Language-model scoring by context-tree weighting (CTW) over bytes, beside a word unigram base score.

A text becomes its words (ASCII lower case), one blank between two, and a newline that ends it; no word holds either byte, so the bytes stand for
the words one to one. Each byte is eight binary decisions. A decision's node is (the last d bytes, the bits of this byte so far) for every depth
d from 0 to ``DEPTH``; its zeros and ones in the training texts give a Krichevsky-Trofimov (KT) estimate, and CTW mixes the depths: the
probability of a node's training data is half its KT probability plus half the product of its children's, so the posterior weight of stopping
at a node is w = KT / 2P, and a prediction is w KT + (1 - w) times the prediction one byte deeper. A node never seen in training has no say: its
parent's KT estimate stands. The tree is fixed after training, so the log10 probability of a text is a sum over its bytes, the newline included;
``bits_per_byte`` is its code length.

KT and CTW probabilities depend on counts only, so training is counting: texts are packed into blocks of about ``PACK`` bytes, each block lists
its distinct (context, byte) strings with their training counts, and the lists meet by a hash of the three nearest context bytes. There the
tree below depth 3 is computed; what is above it has 2**24 nodes at most, is computed by nearest byte and broadcast. The same buckets answer
each block with the log probability of every string that it listed, in the block's order. Words are counted and looked up the same way. Nothing
but the bounded tree top and two totals reaches the driver, and everything counted grows with the input.

Null text counts as empty: one token, the end. Repeated rows count as often as they stand.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

DEPTH, NEAR, PACK, BLOCK, BUCKETS = 6, 3, 16 << 20, 2 << 20, 2048
LISTS = "kind int, bucket int, pack long, items binary, counts binary"
ANSWERS = "pack long, kind int, bucket int, found binary"
_KT = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1 << 16) + 0.5))])  # log of 1/2 * 3/2 * ... (n factors)
_FACT = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, (1 << 16) + 1)))])  # log n!


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(zeros: np.ndarray, ones: np.ndarray, halves=_KT, fact=_FACT) -> np.ndarray:
    """Log of the KT probability of so many zeros and ones, in any order."""

    def rising(n):
        return np.where(n < len(halves), halves[np.minimum(n, len(halves) - 1)], _log_gamma(np.maximum(n, 9) + 0.5) - 0.5 * math.log(math.pi))

    both = zeros + ones
    return rising(zeros) + rising(ones) - np.where(both < len(fact), fact[np.minimum(both, len(fact) - 1)], _log_gamma(np.maximum(both, 9) + 1.0))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def strings(streams: list[bytes]) -> np.ndarray:
    """For every byte of the streams in turn: context bytes, nearest first, then the byte, as one integer. Before a stream all is newline."""
    pad = b"\n" * DEPTH
    buf = np.frombuffer(pad.join([b"", *streams]), np.uint8).astype(np.uint64)
    key = buf[DEPTH:].copy()
    for d in range(1, DEPTH + 1):
        key |= buf[DEPTH - d : len(buf) - d] << np.uint64(8 * (DEPTH + 1 - d))
    own, at = np.ones(len(key), bool), 0
    for s in streams[:-1]:
        at += len(s)
        own[at : at + DEPTH] = False
        at += DEPTH
    return key[own]


def _blocks(sizes: list[int]):
    """Ranges of streams that have about BLOCK bytes, so that a pack's strings are never all in memory."""
    lo = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= BLOCK or i + 1 == len(sizes):
            yield lo, i + 1
            lo, held = i + 1, 0


def _distinct(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(counts, starts)


def _own(streams: list[bytes], sizes: list[int]) -> np.ndarray:
    """Distinct strings of a pack, ascending. They are sorted here, as numpy's unique hashes instead, which takes several times as long on so many."""
    return _sorted_set(np.concatenate([_sorted_set(strings(streams[lo:hi])) for lo, hi in _blocks(sizes)]))


def _sorted_set(keys: np.ndarray) -> np.ndarray:
    keys.sort()
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    near = keys >> np.uint64(8 * (DEPTH + 1 - NEAR))
    return (((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _pack(batches):
    """Rows of about PACK bytes: pack, doc_ids, held_out, bytes of each stream, all streams compressed."""
    task, seq, size, held = TaskContext.get().partitionId(), 0, 0, ([], [], [])
    zip_ = zstandard.ZstdCompressor(level=3)

    def row():
        ids, outs, streams = held
        cols = [[(task << 24) + seq], [ids], [outs], [[len(s) for s in streams]], [zip_.compress(b"".join(streams))]]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["pack", "ids", "held_out", "sizes", "data"])

    for batch in batches:
        for i, out, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))):
            stream = b" ".join(words_of(text)) + b"\n"
            for x, v in zip(held, (i, out, stream)):
                x.append(v)
            size += len(stream)
            if size >= PACK:
                yield row()
                seq, size, held = seq + 1, 0, ([], [], [])
    if held[0]:
        yield row()


def _streams(pack: dict) -> list[bytes]:
    data, out, at = zstandard.ZstdDecompressor().decompress(pack["data"], max_output_size=sum(pack["sizes"])), [], 0
    for n in pack["sizes"]:
        out.append(data[at : at + n])
        at += n
    return out


def _shrunk(a: np.ndarray) -> bytes:
    """Ascending integers as compressed differences."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.diff(a, prepend=a.dtype.type(0)).view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def _grown(b: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel(), dtype=kind)


def _by_bucket(words, n: int) -> list[list[bytes]]:
    """Distinct words, the end token last, dealt to n buckets in a fixed order."""
    out: list[list[bytes]] = [[] for _ in range(n)]
    for w in sorted(words):
        out[xxhash.xxh3_64_intdigest(w) % n].append(w)
    return out


def _list(n: int):
    """A pack's distinct strings (kind 0) and tokens (kind 1) with their training counts, by bucket."""

    def lists(batches):
        for batch in batches:
            for pack in batch.to_pylist():
                streams, zip_ = _streams(pack), zstandard.ZstdCompressor(level=1)
                learns = [not x for x in pack["held_out"]]
                parts = []
                for lo, hi in _blocks(pack["sizes"]):
                    keys = strings(streams[lo:hi]) << np.uint64(1)
                    keys |= np.repeat(np.array(learns[lo:hi], np.uint64), pack["sizes"][lo:hi])
                    keys.sort()
                    starts = np.flatnonzero(np.append(True, keys[1:] >> np.uint64(1) != keys[:-1] >> np.uint64(1)))
                    parts.append((keys[starts] >> np.uint64(1), np.add.reduceat((keys & np.uint64(1)).astype(np.int32), starts)))
                keys, counts = _distinct(*map(np.concatenate, zip(*parts)))
                bucket = _bucket_of(keys, n)
                order = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange(n + 1))
                seen, known = Counter(), set()
                for s, learn in zip(streams, learns):
                    tokens = [*s.split(), b"\n"]
                    seen.update(tokens) if learn else known.update(tokens)
                rows = []
                for b in range(n):
                    at = order[ends[b] : ends[b + 1]]
                    if len(at):
                        rows.append((0, b, pack["pack"], _shrunk(keys[at]), zip_.compress(counts[at].astype(np.uint32).tobytes())))
                for b, tokens in enumerate(_by_bucket(known.union(seen), n)):
                    if tokens:
                        counted = np.array([seen[t] for t in tokens], np.int64)
                        rows.append((1, b, pack["pack"], zip_.compress(b" ".join(tokens)), zip_.compress(counted.tobytes())))
                names = ["kind", "bucket", "pack", "items", "counts"]
                types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return lists


def _count_words(table: pa.Table) -> pa.Table:
    """A bucket's answers to each pack; the row of pack -1 has the bucket's occurrences and distinct tokens in training."""
    lists = [(r["pack"], zstandard.decompress(r["items"]).split(b" "), np.frombuffer(zstandard.decompress(r["counts"]), np.int64)) for r in table.to_pylist()]
    total: dict[bytes, int] = {}
    for _, tokens, counts in lists:
        for t, c in zip(tokens, counts.tolist()):
            total[t] = total.get(t, 0) + c
    zip_, bucket = zstandard.ZstdCompressor(level=1), table["bucket"][0].as_py()
    rows = [(pack, 1, bucket, zip_.compress(np.array([total[t] for t in tokens], np.int64).tobytes())) for pack, tokens, _ in lists]
    rows.append((-1, 1, bucket, np.array([sum(total.values()), sum(c > 0 for c in total.values())], np.int64).tobytes()))
    return _answers(rows)


def _answers(rows: list[tuple]) -> pa.Table:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["pack", "kind", "bucket", "found"])


def _merged(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
    """[(pack, its strings)], all distinct strings, their training counts."""
    lists = [(r["pack"], _grown(r["items"], np.uint64), np.frombuffer(zstandard.decompress(r["counts"]), np.uint32)) for r in table.to_pylist()]
    every, counts = np.concatenate([x[1] for x in lists]), np.concatenate([x[2] for x in lists]).astype(np.int64)
    return [x[:2] for x in lists], *_distinct(every, counts)


def _tree(keys: np.ndarray, counts: np.ndarray) -> tuple[list, list]:
    """Below depth NEAR: for each bit, [depth -> (ids, zeros, ones, log P, w)]; and for each depth, the place of every key's (context, byte)."""
    at = {DEPTH: (keys, counts, np.arange(len(keys)))}
    for d in range(DEPTH - 1, NEAR - 1, -1):
        up, n, place = at[d + 1]
        up, back = np.unique(((up >> np.uint64(16)) << np.uint64(8)) | (up & np.uint64(255)), return_inverse=True)
        at[d] = (up, np.bincount(back, n, len(up)).astype(np.int64), back[place])
    bits = []
    for j in range(8):
        below, levels = None, {}
        for d in range(DEPTH, NEAR - 1, -1):
            key, n, _ = at[d]
            node = key >> np.uint64(8 - j)
            starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            one = np.add.reduceat(n * ((key >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64), starts)
            both, ids = np.add.reduceat(n, starts), node[starts]
            kt = log_kt(both - one, one)
            if below is None:
                p, w = kt, np.ones(len(kt))
            else:
                parent = ((below[0] >> np.uint64(8 + j)) << np.uint64(j)) | (below[0] & np.uint64((1 << j) - 1))
                deeper = np.bincount(np.searchsorted(ids, parent), below[1], len(ids))
                p = np.logaddexp(kt, deeper) - math.log(2)
                w = np.exp(kt - math.log(2) - p)
            below = (ids, p)
            levels[d] = (ids, both - one, one, p, w, np.cumsum(np.append(False, node[1:] != node[:-1])))
        bits.append(levels)
    return bits, [at.get(d, (None, None, None))[2] for d in range(DEPTH + 1)]


def _roots(table: pa.Table) -> pa.Table:
    """Depth NEAR nodes of a bucket, by nearest context byte: ids (context, then 1 and the bits so far in one byte), zeros, ones, log P."""
    _, keys, counts = _merged(table)
    bits, _ = _tree(keys, counts)
    cols = [[], [], [], []]
    for j, levels in enumerate(bits):
        ids, zeros, ones, p = levels[NEAR][:4]
        heap = ((ids >> np.uint64(j)) << np.uint64(8)) | np.uint64(1 << j) | (ids & np.uint64((1 << j) - 1))
        for c, v in zip(cols, (heap, zeros, ones, p)):
            c.append(v)
    ids, zeros, ones, p = (np.concatenate(c) for c in cols)
    near = (ids >> np.uint64(8 * NEAR)).astype(np.int64)
    rows = [(int(b), *(v[near == b].tobytes() for v in (ids, zeros, ones, p))) for b in np.unique(near)]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 4])], names=["near", "ids", "zeros", "ones", "p"])


def _lift(ids, zeros, ones, p):
    """One depth up: (ids, zeros, ones, log P, w) of the parents of nodes."""
    up, back = np.unique(((ids >> np.uint64(16)) << np.uint64(8)) | (ids & np.uint64(255)), return_inverse=True)
    zeros, ones = (np.bincount(back, x, len(up)).astype(np.int64) for x in (zeros, ones))
    kt = log_kt(zeros, ones)
    whole = np.logaddexp(kt, np.bincount(back, p, len(up))) - math.log(2)
    return up, zeros, ones, whole, np.exp(kt - math.log(2) - whole)


def _lift_near(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    kinds = (np.uint64, np.int64, np.int64, float)
    nodes = tuple(np.concatenate([np.frombuffer(r[c], k) for r in rows]) for c, k in zip(("ids", "zeros", "ones", "p"), kinds))
    out = []
    for depth in range(NEAR - 1, 0, -1):
        *nodes, w = _lift(*nodes)
        out.append((depth, *(v.tobytes() for v in (*nodes, w))))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), *[pa.binary()] * 5])], names=["depth", "ids", "zeros", "ones", "p", "w"])


def _top(rows) -> dict[int, tuple]:
    """Depth -> (ids, zeros, ones, w) above depth NEAR."""
    out, nodes = {}, None
    for depth in range(NEAR - 1, 0, -1):
        mine = [r for r in rows if r["depth"] == depth]
        cols = [np.concatenate([np.frombuffer(bytes(r[c]), k) for r in mine]) for c, k in zip(("ids", "zeros", "ones", "p", "w"), (np.uint64, np.int64, np.int64, float, float))]
        order = np.argsort(cols[0])
        nodes = [c[order] for c in cols]
        out[depth] = (*nodes[:3], nodes[4])
    *nodes, w = _lift(*nodes[:4])
    out[0] = (*nodes[:3], w)
    return out


def _answer(top):
    """A bucket's log10 probabilities, to each pack for the strings that it listed."""

    def answer(table: pa.Table) -> pa.Table:
        lists, keys, counts = _merged(table)
        bits, places = _tree(keys, counts)
        log_p = np.zeros(len(keys))
        byte = keys & np.uint64(255)
        for j, levels in enumerate(bits):
            bit = (byte >> np.uint64(7 - j)) & np.uint64(1) == 1
            q, seen = np.full(len(keys), 0.5), np.zeros(len(keys), bool)
            for d in range(DEPTH, -1, -1):
                if d >= NEAR:
                    _, zeros, ones, _, w, segment = levels[d]
                    at = segment[places[d]]
                    known = True
                else:
                    ids, zeros, ones, w = top.value[d]
                    node = ((keys >> np.uint64(8 * (DEPTH + 1 - d))) << np.uint64(8)) | np.uint64(1 << j) | (byte >> np.uint64(8 - j))
                    at = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
                    known = ids[at] == node
                n0, n1 = zeros[at], ones[at]
                known = known & (n0 + n1 > 0)
                kt = (np.where(bit, n1, n0) + 0.5) / (n0 + n1 + 1)
                q = np.where(known, np.where(seen, w[at] * kt + (1 - w[at]) * q, kt), q)
                seen = seen | known
            log_p += np.log10(q)
        bucket = table["bucket"][0].as_py()
        return _answers([(pack, 0, bucket, log_p[np.searchsorted(keys, own)].astype(np.float32).tobytes()) for pack, own in lists])

    return answer


class _Index:
    """Places of 64-bit keys in a sorted array, by hash tables of which each holds what the one before could not."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables, rest = keys, [], np.arange(len(keys))
        while len(rest):
            bits = max(4, int(len(rest) * 6).bit_length())
            odd = np.uint64(0x9E3779B97F4A7C15 + 2 * 0x51ED27 * len(self.tables))
            slots = np.zeros(1 << bits, np.int32)
            h = (keys[rest] * odd) >> np.uint64(64 - bits)
            slots[h] = rest
            self.tables.append((odd, np.uint64(64 - bits), slots))
            rest = rest[slots[h] != rest]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, todo = None, None
        for odd, shift, slots in self.tables:
            wanted = keys if todo is None else keys[todo]
            got = slots[(wanted * odd) >> shift]
            if out is None:
                out = got
            else:
                out[todo] = got
            missed = np.flatnonzero(self.keys[got] != wanted)
            todo = missed if todo is None else todo[missed]
            if not len(todo):
                break
        return out


def _score(n: int, occurrences: int, distinct: int):
    def score(packs: pa.Table, answers: pa.Table) -> pa.Table:
        found = {(a["kind"], a["bucket"]): a["found"] for a in answers.to_pylist()}
        pack = packs.to_pylist()[0]
        streams = _streams(pack)
        own = _own(streams, pack["sizes"])
        bucket = _bucket_of(own, n)
        log_p = np.zeros(len(own), np.float32)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(n + 1))
        for b in range(n):
            if ends[b] < ends[b + 1]:
                log_p[order[ends[b] : ends[b + 1]]] = np.frombuffer(found[0, b], np.float32)
        at, score = _Index(own), np.zeros(len(streams))
        for lo, hi in _blocks(pack["sizes"]):
            starts = np.cumsum([0, *pack["sizes"][lo : hi - 1]])
            score[lo:hi] = np.add.reduceat(log_p[at(strings(streams[lo:hi]))].astype(float), starts)
        place: dict[bytes, int] = {}
        for b, tokens in enumerate(_by_bucket({t for s in streams for t in s.split()} | {b"\n"}, n)):
            if tokens:
                place.update(zip(tokens, np.frombuffer(zstandard.decompress(found[1, b]), np.int64).tolist()))
        tokens, known, base = [], [], []
        for s in streams:
            c = np.array([*map(place.__getitem__, s.split()), place[b"\n"]], np.int64)
            tokens.append(len(c))
            known.append(int((c > 0).sum()))
            base.append(float(np.log10((c + 0.5) / (occurrences + 0.5 * (distinct + 1))).sum()))
        bits = -score / math.log10(2) / np.array(pack["sizes"])
        cols = [pa.array(pack["ids"], pa.int64()), pa.array(pack["held_out"]), *(pa.array(x, pa.int64()) for x in (tokens, known, [occurrences] * len(streams))), pa.array(base), pa.array(score), pa.array(bits)]
        return pa.table(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    return score


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score_documents(docs: DataFrame) -> DataFrame:
    """Learn from the rows of docs (doc_id, held_out, text) that are not held out, and score every row."""
    spark = docs.sparkSession
    packs = C.cut(docs.select("doc_id", "held_out", "text").mapInArrow(_pack, "pack long, ids array<long>, held_out array<boolean>, sizes array<long>, data binary"))
    size = packs.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    n = int(min(BUCKETS, max(8, -(-size // PACK))))
    lists = C.cut(packs.mapInArrow(_list(n), LISTS))
    strings_, tokens = lists.filter("kind = 0"), lists.filter("kind = 1")
    counted = C.cut(tokens.groupBy("bucket").applyInArrow(_count_words, ANSWERS))
    totals = counted.filter("pack < 0").collect()  # a row a bucket
    occurrences, distinct = (sum(int(np.frombuffer(bytes(r["found"]), np.int64)[i]) for r in totals) for i in (0, 1))
    roots = strings_.groupBy("bucket").applyInArrow(_roots, "near int, ids binary, zeros binary, ones binary, p binary")
    lifted = roots.groupBy("near").applyInArrow(_lift_near, "depth int, ids binary, zeros binary, ones binary, p binary, w binary").collect()  # 2**24 nodes at most
    if not lifted:
        return spark.createDataFrame([], SCORED)
    top = spark.sparkContext.broadcast(_top(lifted))
    answers = strings_.groupBy("bucket").applyInArrow(_answer(top), ANSWERS).unionByName(counted.filter("pack >= 0"))
    return packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(_score(n, occurrences, distinct), SCORED)


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return score_documents(docs.select(docs["doc_id"].cast("long").alias("doc_id"), (C.crc_bucket("doc_id", 5) == 1).alias("held_out"), C.text_of(docs).alias("text")))
