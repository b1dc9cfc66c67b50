"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces, with byte fallback.

Encoding puts one blank before the text, writes blanks as the marker U+2581 and takes the sequence of pieces with the highest sum of log scores
that spells it; a character that no piece can begin is written as its UTF-8 bytes, a piece each, at the least score of a piece less ``PENALTY``. Decoding turns pieces into
bytes, markers into blanks, and drops the blank put in front. A literal U+2581 in a text is always written as bytes, so decoding returns
every text exactly. Other columns pass through; columns named like the results are replaced. An empty table gives an empty one.

Pieces with a marker anywhere but in front would let a piece reach across a blank; the vocabulary is checked to have none (runs of markers
alone aside). The best sequence of a text is then the best sequences of its segments one after another, a segment being a run of blanks with the
run of other characters behind it, or a line break, if no piece holds one. A task encodes each distinct segment once, many at a time: one
numpy step moves all of them through the trie by a byte. Texts of any length are encoded whole; long segments take the same steps.

Vocabulary files give pieces and scores. A file of merge ranks (scores 0, -1, -2, ...) has no probabilities; by Zipf's law ``zipf_scores`` gives
rank k the log probability -log(k + 2), up to a constant. A vocabulary whose pieces reach across a blank is refused (ValueError). Ties go to the longer last piece. Null text counts as empty and has no pieces.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MARK = "▁".encode()
#: A character written as bytes costs this much more than the rarest piece.
PENALTY, CACHE, WAVE, SLICE = 10.0, 300_000, 1 << 19, 500


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value, shift, at = value | (b & 127) << shift, shift + 7, at + 1
        if b < 128:
            return value, at


def fields(data: bytes):
    """(number, value) of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = read_varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = read_varint(data, at)
        else:
            n, at = (8, at) if kind == 1 else (4, at) if kind == 5 else read_varint(data, at)
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id of a SentencePiece model file; types: 1 normal, 2 unknown, 3 control, 4 user, 5 unused, 6 byte."""
    out = []
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            out.append((piece[1].decode(), float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]), piece.get(3, 1)))
    return out


def zipf_scores(pieces: list[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """Merge ranks as log probabilities: the k-th piece gets -log(k + 2); pieces without a rank of their own come last."""
    worst = sum(1 for p in pieces if p[2] == 1)
    return [(p, -float(np.log(min(-s, worst) + 2)) if t == 1 else s, t) for p, s, t in pieces]


class Trie:
    """Double array: the child of node s by byte b is t = base[s] + b if check[t] == s. leaf[t] is the id of the piece that ends at t, or -1."""

    def __init__(self, pieces: list[tuple[bytes, int]]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for piece, i in pieces:
            node = 0
            for b in piece:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][b]
            ends[node] = i
        size = 2 * len(children) + 1024
        self.base, self.check, self.leaf = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[0], place, low, lone, queue = False, {0: 0}, 1, 257, [0]
        for node in queue:
            below = np.array(sorted(children[node]))
            if not len(below):
                continue
            while not free[low]:
                low += 1
            at, fits = low, ()  # free slots for the least byte, a stretch at a time, until all bytes fit
            if len(below) == 1:  # any free slot does; beyond the first 256 its base is positive
                while not free[lone]:
                    lone += 1
                fits = (lone,)
            while not len(fits):
                slots = at + np.flatnonzero(free[at : at + 2048])
                slots = slots[slots > below[0]]
                fits = slots[free[np.minimum(slots[:, None] - below[0] + below, size - 1)].all(axis=1)]
                if len(fits):
                    break
                at += 2048
                if at + 2048 + 256 > size:
                    size += 8192
                    free = np.append(free, np.ones(8192, bool))
                    self.base, self.check, self.leaf = (np.append(a, np.full(8192, v, np.int32)) for a, v in ((self.base, 0), (self.check, -1), (self.leaf, -1)))
            base = int(fits[0] - below[0])
            self.base[place[node]] = base
            free[base + below] = False
            for b in below.tolist():
                child = children[node][b]
                self.check[base + b], self.leaf[base + b], place[child] = place[node], ends[child], base + b
                queue.append(child)
        self.depth = max((len(p) for p, _ in pieces), default=0)


class Vocabulary:
    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.spelling = [p.encode() if t in (1, 4) else b"" for p, _, t in pieces]
        self.score, bytes_ = np.array([s for _, s, _ in pieces]), {}
        usable = []
        for i, (p, _, t) in enumerate(pieces):
            if t == 6:
                bytes_[int(p[1:-1], 16)] = i
                self.spelling[i] = bytes([int(p[1:-1], 16)])
            elif t in (1, 4):
                if "▁" in p.lstrip("▁"):
                    raise ValueError(f"piece {p!r} reaches across a blank")
                usable.append((p.encode(), i))
        if len(bytes_) != 256:
            raise ValueError("byte fallback needs all 256 byte pieces")
        self.byte_ids = np.array([bytes_[b] for b in range(256)], np.int32)
        self.is_byte = np.zeros(len(pieces), bool)
        self.is_byte[self.byte_ids] = True
        self.trie = Trie(usable)
        self.unknown = min((self.score[i] for _, i in usable), default=0.0) - PENALTY
        self.text = [b" " * (len(s) // 3) + s.lstrip(MARK) if s.startswith(MARK) and not s.replace(MARK, b"") else s.replace(MARK, b" ") if not self.is_byte[i] else s for i, s in enumerate(self.spelling)]
        self.segment = re.compile(r" *[^ \n]+|\n| +" if not any("\n" in p for p, _, t in pieces if t in (1, 4)) else r" *[^ ]+| +")

    def spelled(self, segments: list[str]) -> list[bytes]:
        """Markers for blanks; a literal marker becomes a byte that no text has, which no piece begins, and is written as its bytes later."""
        if not segments:
            return []
        return "\ud801".join(segments).replace("▁", "\ud800").replace(" ", "▁").encode("utf-8", "surrogatepass").split(b"\xed\xa0\x81")

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, count) of the segments, all of them a byte further with every step."""
        spelled = self.spelled(segments)
        size = np.array([len(s) for s in spelled], np.int64)
        order = np.argsort(size, kind="stable")  # like lengths together
        at, ids, counts = 0, [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        while at < len(order):
            end = at + max(1, int(np.searchsorted(np.cumsum(size[order[at : at + WAVE]]), WAVE, "right")))
            got, n = self._wave([spelled[i] for i in order[at:end].tolist()])
            ids.append(got)
            counts.append(n)
            at = end
        count, first = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        count[order] = np.concatenate(counts)
        first[order] = np.cumsum(count[order]) - count[order]
        return np.concatenate(ids), first, count

    def _wave(self, spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each segment has."""
        size = np.array([len(s) for s in spelled])
        data = np.frombuffer(b"".join(spelled), np.uint8)
        start = np.cumsum(size) - size
        ends, total = start + size, len(data)
        # edges: every piece that begins anywhere, found for all places at once, one byte deeper a step
        place, node, first = np.arange(total), np.zeros(total, np.int64), np.arange(total)
        last = np.repeat(ends, size)
        edges = []
        for _ in range(self.trie.depth):
            keep = place < last[first]
            place, node, first = place[keep], node[keep], first[keep]
            if not len(place):
                break
            child = np.minimum(self.trie.base[node] + data[place], len(self.trie.check) - 1)
            keep = self.trie.check[child] == node
            place, node, first = place[keep] + 1, child[keep], first[keep]
            leaf = self.trie.leaf[node]
            hit = leaf >= 0
            edges.append((first[hit], place[hit], leaf[hit]))
        begins = (data & 0xC0) != 0x80
        width = np.select([data < 0x80, data < 0xE0, data < 0xF0], [1, 2, 3], 4)
        first = np.concatenate([*(e[0] for e in edges), np.flatnonzero(begins)])
        to = np.concatenate([*(e[1] for e in edges), np.flatnonzero(begins) + width[begins]])
        piece = np.concatenate([*(e[2] for e in edges), np.full(int(begins.sum()), -1, np.int64)])
        cost = np.where(piece >= 0, self.score[piece], self.unknown)
        # Viterbi: by place within the segment, all segments together; an edge's place is that of its end
        offset = to - np.repeat(start, size)[first]
        by = np.lexsort((first, to, offset))
        first, to, piece, cost, offset = first[by], to[by], piece[by], cost[by], offset[by]
        back, by_piece = np.zeros(total + 1, np.int64), np.full(total + 1, -1, np.int64)
        value = np.zeros(total + 1)  # of the best way to a place; what ends a segment stands apart, as its place is the next one's start
        cuts = np.searchsorted(offset, np.arange(1, int(size.max(initial=0)) + 2))
        whose = np.repeat(np.arange(len(spelled)), size)
        end_back, end_piece = np.zeros(len(spelled), np.int64), np.full(len(spelled), -1, np.int64)
        for k in range(len(cuts) - 1):
            lo, hi = cuts[k], cuts[k + 1]
            if lo == hi:
                continue
            f, t = first[lo:hi], to[lo:hi]
            v = value[f] + cost[lo:hi]
            group = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            top = np.maximum.reduceat(v, group)
            n = np.diff(np.append(group, len(t)))
            is_top = np.flatnonzero(v == np.repeat(top, n))
            pick = is_top[np.searchsorted(is_top, group)]  # the first of a group: the longest last piece
            tt, ff, pp = t[pick], f[pick], piece[lo:hi][pick]
            own = whose[ff]
            final = tt == ends[own]
            end_back[own[final]], end_piece[own[final]] = ff[final], pp[final]
            mid = ~final
            value[tt[mid]], back[tt[mid]], by_piece[tt[mid]] = top[mid], ff[mid], pp[mid]
        # back through all segments together
        live = size > 0
        who, pos, ids, end = np.flatnonzero(live), end_back[live], end_piece[live], ends[live]
        steps, step = [], 0
        while len(who):
            steps.append((who, np.full(len(who), step), ids, pos, end))
            more = pos > start[who]
            who, end, pos = who[more], pos[more], pos[more]
            ids, pos = by_piece[pos], back[pos]
            step += 1
        if not steps:
            return np.zeros(0, np.int32), np.zeros(len(spelled), np.int64)
        who, rank, ids, pos, end = (np.concatenate([s[i] for s in steps]) for i in range(5))
        by = np.lexsort((-rank, who))
        who, ids, pos, end = who[by], ids[by], pos[by], end[by]
        out_len = np.where(ids >= 0, 1, end - pos)
        whole = np.repeat(ids, out_len)
        loose = np.flatnonzero(whole < 0)
        if len(loose):
            inside = np.arange(len(whole)) - np.repeat(np.cumsum(out_len) - out_len, out_len)
            source = data[np.repeat(pos, out_len)[loose] + inside[loose]]
            # the stand-in for a literal marker (ED A0 80) is written as the marker's own bytes
            lead = data[np.repeat(pos, out_len)[loose]]
            nxt = data[np.minimum(np.repeat(pos, out_len)[loose] + 1, total - 1)]
            stand = (lead == 0xED) & (nxt == 0xA0)
            marker = np.frombuffer(MARK, np.uint8)[np.minimum(inside[loose], 2)]
            whole[loose] = self.byte_ids[np.where(stand, marker, source)]
        return whole.astype(np.int32), np.bincount(who, out_len, len(spelled)).astype(np.int64)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts of rows of ids that end at ends (the first is 0): the bytes of every piece, found by place, without each row's first blank."""
        if not hasattr(self, "joined"):
            self.joined = np.frombuffer(b"".join(self.text), np.uint8)
            self.width = np.array([len(t) for t in self.text], np.int64)
            self.start = np.cumsum(self.width) - self.width
        width = self.width[ids]
        bytes_end = np.concatenate([[0], np.cumsum(width)])
        data = self.joined[np.repeat(self.start[ids] - bytes_end[:-1], width) + np.arange(bytes_end[-1])]
        row_end = bytes_end[ends]
        keep = np.ones(len(data), bool)
        keep[row_end[:-1][row_end[1:] > row_end[:-1]]] = False
        offsets = row_end - np.concatenate([[0], np.cumsum(row_end[1:] > row_end[:-1])])
        out = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[keep]))
        out.validate(full=True)
        return out.cast(pa.string())


class Encoder:
    """Encodes texts, each distinct segment once; what it knows is dropped when there is too much of it."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self):
        self.place: dict[str, int] = {}
        self.ids, self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of the texts; ends begins with 0."""
        if len(self.place) > CACHE:
            self.forget()
        pieces = [self.v.segment.findall(" " + t) if t else [] for t in texts]
        flat = [s for p in pieces for s in p]
        new = list({s for s in flat if s not in self.place})
        if new:
            ids, first, count = self.v.encode(new)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.first, self.count, self.ids = np.append(self.first, first + len(self.ids)), np.append(self.count, count), np.append(self.ids, ids)
        at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        n = self.count[at]
        before = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.first[at] - before[:-1], n) + np.arange(before[-1])]
        return ids, before[np.concatenate([[0], np.cumsum([len(p) for p in pieces], dtype=np.int64)])]


def _slices(batches):
    return (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE))


def _ids(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))


def _encode(vocabulary):
    def encode(batches):
        encoder = Encoder(vocabulary.value)
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("row"), _ids(*encoder(batch.column("text").to_pylist()))], ["row", "ids"])

    return encode


def _decode(vocabulary):
    def decode(batches):
        for batch in _slices(batches):
            ids = batch.column("ids").fill_null([])
            ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), vocabulary.value.decode(ids.flatten().to_numpy(zero_copy_only=False), ends)], ["row", "decoded"])

    return decode


def _there_and_back(vocabulary):
    def there_and_back(batches):
        encoder = Encoder(vocabulary.value)
        for batch in _slices(batches):
            ids, ends = encoder(batch.column("text").to_pylist())
            same = pc.equal(vocabulary.value.decode(ids, ends), pc.fill_null(batch.column("text"), ""))
            yield pa.RecordBatch.from_arrays([batch.column("row"), _ids(ids, ends), same], ["row", "ids", "roundtrip"])

    return there_and_back


def _mapped(df: DataFrame, column: str, made, pieces, out: dict[str, str]) -> DataFrame:
    """The vocabulary is built once and broadcast."""
    return C.mapped(df, column, made(df.sparkSession.sparkContext.broadcast(Vocabulary(pieces))), out)


def encode(docs: DataFrame, pieces: list[tuple[str, float, int]]) -> DataFrame:
    """docs with ids array<int> in place of text."""
    return _mapped(docs, "text", _encode, pieces, {"ids": "array<int>"})


def decode(encoded: DataFrame, pieces: list[tuple[str, float, int]]) -> DataFrame:
    """encoded plus decoded string; null ids give an empty text."""
    return _mapped(encoded.withColumn("__ids", F.col("ids")), "ids", _decode, pieces, {"decoded": "string"}).withColumnRenamed("__ids", "ids")


def round_trip(docs: DataFrame, pieces: list[tuple[str, float, int]]) -> DataFrame:
    """docs with ids array<int> in place of text, and roundtrip: whether the decoded ids are the text (null: empty) again. One pass of a task does both."""
    return _mapped(docs, "text", _there_and_back, pieces, {"ids": "array<int>", "roundtrip": "boolean"})


def load_pieces(path: str = "/opt/tokenizers/piece_bpe_32k.model") -> list[tuple[str, float, int]]:
    """The pieces of a model file on the driver, with scores of merge ranks turned into log probabilities."""
    with open(path, "rb") as f:
        return zipf_scores(read_model(f.read()))


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded; roundtrip says whether decoding gave it back."""
    docs = C.table(spark, sf_dir, "documents")
    coded = round_trip(docs.select("doc_id", C.text_of(docs).alias("text")), load_pieces())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "roundtrip")
