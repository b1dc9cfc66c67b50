"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Relational from the tokens on. A text, with the blank before it that both tokenizers see, is split before every blank or line end that follows a letter,
digit or ASCII sign. Neither tokenizer can join what such a place parts (A's pattern starts a new word there, none of B's pieces holds one; both are
checked when the files are read, and texts stay whole where that fails), so tokens of a segment are those of the text, every segment's end is a cut of
both sides, and what is computed once for a distinct segment holds wherever it stands. Distinct segments with their counts are tokenised, their tokens
exploded with their places, windowed sums of the tokens' byte lengths (a join with the vocabularies) give every token its end, and tokens of both sides
meet where segment and end are equal. Those ends are cuts, and the cuts so far number the groups. Documents then join the results of their segments.

Tokenised segments are dealt by hash, tokens still in one array; from there to one row a segment nothing is shuffled, since all windows and aggregates
go by the segment. The equi-join on (segment, end) is a full outer one, after which Spark's join forgets how its rows are dealt; so both sides are one relation,
sorted by (segment, end), and the rows of an end are neighbours in it. Links are not taken as all pairs of a group: two tokens overlap on a range
between one end and the one before, and every distinct end closes just one such range, so its link is the pair of tokens that are open there, filled
from the next end of either side. A group without inner cuts, however long, gives as many links as it has ends and never a product.

Null and empty texts, and texts whose joined token bytes are not the text's own on either side, have no tokens and count nowhere. Repeated texts count as
often as they stand; rows keep their own doc_id, null or repeated. Ties: every link whose pair has the highest count of its B id is a best one. An empty
table gives an empty one; further columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: The public vocabularies, unless the session's fluxline.tokenizers.a and .b name others.
FILES = {"a": "/opt/tokenizers/byte_bpe_50k.json", "b": "/opt/tokenizers/piece_bpe_32k.model"}
#: Ids of B are stored as id + SIDE beside those of A; a pair of ids is a * SIDE + b.
SIDE = 1 << 24
#: Characters for one task, and the most tasks that are asked for by it.
CHARS, TASKS = 3_000_000, 20_000
#: Most segments whose results are broadcast, the most frequent ones (some 200 bytes each); documents join all others by a shuffle.
HOT = 450_000
#: Where a text may be split, for Spark and for the check of B's pieces.
SPLIT, JOINED = r"(?<=[\p{L}\p{N}\x21-\x7E])(?=[ \n])", r"[\p{L}\p{N}\x21-\x7E]▁|\n"
#: Pairs of ids up to which their counts are broadcast (some 50 bytes each); more are joined by a shuffle of (text, pair).
PAIRS = 400_000


def file_of(spark: SparkSession, side: str) -> bytes:
    with open(spark.conf.get(f"fluxline.tokenizers.{side}", FILES[side]), "rb") as f:
        return f.read()


_loaded: dict = {}


class ByteLevel:
    """Tokenizer A: byte-level BPE of a tokenizers file."""

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(file.decode())
        self.tokenizer.encode_special_tokens = True
        # the usual byte alphabet: printable Latin-1 characters stand for themselves, the others for those from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.bytes = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.widths = np.array([len(b) for b in self.bytes])

    def separable(self) -> bool:
        """Whether its pattern starts a new word at every white space after something else."""
        file = json.loads(self.tokenizer.to_str())
        rule = file["pre_tokenizer"] or {}
        return file["normalizer"] is None and rule.get("type") == "ByteLevel" and rule.get("use_regex") is True and rule.get("add_prefix_space") is False

    def __call__(self, texts: list[str]) -> list[list[int]]:
        """Tokens of texts as they are, with the blank before them if they have one."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Tokenizer B: a SentencePiece model with byte fallback."""

    def __init__(self, file: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=file)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.model.id_to_piece(i)) for i in range(self.model.vocab_size()))]
        self.widths = np.array([len(b) for b in self.bytes])

    def separable(self) -> bool:
        """Whether no piece holds a place where texts are split."""
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()) if not self.model.is_byte(i))
        return not any(regex.search(JOINED, p) for p in pieces)

    def __call__(self, texts: list[str]) -> list[list[int]]:
        """Tokens of texts as they are. The model puts a blank before a text: it replaces the text's own, or else its token goes again."""
        blank = self.model.piece_to_id("▁")
        coded = self.model.encode([t[1:] if t[:1] == " " else t for t in texts], num_threads=1)
        return [ids if t[:1] == " " and len(t) > 1 else [blank] if t == " " else ids[1:] for t, ids in zip(texts, coded)]


class Both:
    """Tokens of both sides of a segment, A's and then B's with SIDE added; none unless both spell it. Files are parsed once a Python worker."""

    def __init__(self, files):
        self.files = files

    def sides(self):
        key = tuple(map(zlib.crc32, self.files.value))
        if key not in _loaded:
            _loaded[key] = (ByteLevel(self.files.value[0]), Pieces(self.files.value[1]))
        return _loaded[key]

    def __call__(self, texts: list[bytes]) -> pa.Array:
        """Sides are checked for a batch as a whole, and segment by segment only where that fails."""
        sides, plain = self.sides(), [t.decode(errors="replace") for t in texts]
        coded = [s(plain) for s in sides]
        size = np.array([len(t) for t in texts])
        good = np.ones(len(texts), bool)
        for side, ids in zip(sides, coded):
            flat = list(chain.from_iterable(ids))
            ends = np.cumsum([0, *map(len, ids)])
            widths = np.concatenate([[0], np.cumsum(side.widths[flat])])
            if b"".join(map(side.bytes.__getitem__, flat)) != b"".join(texts) or not np.array_equal(np.diff(widths[ends]), size):
                good &= [b"".join(map(side.bytes.__getitem__, i)) == t for i, t in zip(ids, texts)]
        a, b = ([i if g else [] for i, g in zip(ids, good)] for ids in coded)
        flat = np.fromiter(chain.from_iterable(chain.from_iterable(zip(a, b))), np.int32)
        counts = np.array([[len(x), len(y)] for x, y in zip(a, b)], np.int32).reshape(-1, 2)
        flat += np.repeat(np.tile(np.array([0, SIDE], np.int32), len(texts)), counts.ravel())
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts.sum(1))]), pa.int32()), pa.array(flat))


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]):
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Lists of rows that come sorted by their key are aggregated one key after another; others in a table of keys, and not in one that after 128 keys sorts
#: all rows: a task holds CHARS characters of text, whatever the number of keys.
STREAMED = {"spark.sql.execution.useObjectHashAggregateExec": "false"}
TABLED = {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "100000000"}


def _hashed(df: DataFrame, name: str, a: str, b: str) -> DataFrame:
    return df.withColumns({a: F.xxhash64(name), b: F.xxhash64(F.lit(1), name)})


def separable(spark: SparkSession) -> bool:
    return ByteLevel(file_of(spark, "a")).separable() and Pieces(file_of(spark, "b")).separable()


def segments(text: Column, split: bool) -> Column:
    """array<string> of the segments of a text, the blank before it included; none of an empty text."""
    whole = F.concat(F.lit(" "), text)
    return F.when(text != "", F.split(whole, SPLIT) if split else F.array(whole)).otherwise(F.array().cast("array<string>"))


def _tasks(spark: SparkSession, chars: int | None) -> int:
    return max(C.partitions(spark), min(TASKS, -(-(chars or 0) // CHARS)))


def tokens(distinct: DataFrame) -> DataFrame:
    """(t1, t2, copies, codes) of distinct segments (t1, t2, text, copies), dealt by their hashes t1 and t2."""
    spark = distinct.sparkSession
    sides = Both(spark.sparkContext.broadcast((file_of(spark, "a"), file_of(spark, "b"))))

    @F.arrow_udf("array<int>")
    def codes(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([sides(texts.slice(i, 1024).to_pylist()) for i in range(0, len(texts), 1024)] or [pa.array([], pa.list_(pa.int32()))])

    chars = distinct.agg(F.sum(F.length("text").cast("long"))).first()[0]
    # not deterministic: else Spark takes the tokens a second time to see whether there are any
    coded = distinct.select("t1", "t2", "copies", codes.asNondeterministic()(F.col("text").cast("binary")).alias("codes"))
    return coded.repartition(_tasks(spark, chars), "t1", "t2").sortWithinPartitions("t1", "t2")


def _lengths(spark: SparkSession) -> DataFrame:
    """(code, len): bytes of every token of both vocabularies, under a hundred thousand rows."""
    a, b = ByteLevel(file_of(spark, "a")).bytes, Pieces(file_of(spark, "b")).bytes
    rows = pa.table({"code": pa.array([*range(len(a)), *(i + SIDE for i in range(len(b)))], pa.int32()), "len": pa.array([*map(len, a), *map(len, b)], pa.int32())})
    return spark.createDataFrame(rows)


def ends(texts: DataFrame) -> DataFrame:
    """(t1, t2, copies, end, a, b) of every token: the byte where it ends, and its id under a or b."""
    rows = texts.select("t1", "t2", "copies", F.posexplode("codes").alias("pos", "code"))
    rows = rows.join(F.broadcast(_lengths(texts.sparkSession)), "code").withColumn("side", F.col("code") >= SIDE)
    sofar = Window.partitionBy("t1", "t2", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum("len").over(sofar))
    return rows.select("t1", "t2", "copies", "end", F.when(~F.col("side"), F.col("code")).alias("a"), F.when(F.col("side"), F.col("code") - SIDE).alias("b"))


def links(rows: DataFrame) -> DataFrame:
    """(t1, t2, copies, end, a, b, ends_a, ends_b) of every link of ends' rows, by descending end: tokens a and b overlap just before end; ends_a and
    ends_b say which of them end there."""
    w = Window.partitionBy("t1", "t2").orderBy(F.desc("end"), F.col("b").asc_nulls_first())
    opened = w.rowsBetween(Window.unboundedPreceding, 0)
    meets = F.lag("end").over(w).eqNullSafe(F.col("end"))  # a row of B after one of A with the same end
    rows = rows.withColumns({"open_a": F.last("a", True).over(opened), "open_b": F.last("b", True).over(opened), "ends_a": F.col("a").isNotNull() | meets, "last": ~F.lead("end").over(w).eqNullSafe(F.col("end"))})
    return rows.filter("last").select("t1", "t2", "copies", "end", F.col("open_a").alias("a"), F.col("open_b").alias("b"), "ends_a", F.col("b").isNotNull().alias("ends_b"))


def _part(codes: str, start: Column, stop: Column, bit: int) -> Column:
    """Ids, with commas, of the tokens of one side that end at links start to stop."""
    ended = F.filter(F.sequence(start, stop), lambda i: F.get(codes, i).bitwiseAND(F.lit(bit)) > 0)
    an_id = lambda i: F.shiftright(F.get(codes, i), 26) if bit == 1 else F.shiftright(F.get(codes, i), 2).bitwiseAND(F.lit(SIDE - 1))
    return F.array_join(F.transform(ended, lambda i: an_id(i).cast("string")), ",")


def align(distinct: DataFrame) -> DataFrame:
    """(t1, t2, copies, n_a, n_b, n_groups, groups, pairs) of each of the distinct segments (t1, t2, text, copies) that both sides spell: groups is `a1,a2|b1;a3|b2,b3`, pairs
    array<long> are the links in text order as a * SIDE + b."""
    kind = F.col("ends_a").cast("long") + 2 * F.col("ends_b").cast("long")
    rows = links(ends(tokens(distinct))).select("t1", "t2", "copies", (4 * (F.col("a").cast("long") * SIDE + F.col("b")) + kind).alias("code"))
    texts = rows.groupBy("t1", "t2").agg(F.first("copies").alias("copies"), F.collect_list("code").alias("codes")).withColumn("codes", F.reverse("codes"))
    texts = texts.withColumn("cuts", F.filter(F.sequence(F.lit(0), F.size("codes") - 1), lambda i: F.get("codes", i).bitwiseAND(F.lit(3)) == 3))

    def group(cut: Column, g: Column) -> Column:
        start = F.coalesce(F.get("cuts", g - 1), F.lit(-1)) + 1
        return F.concat(_part("codes", start, cut, 1), F.lit("|"), _part("codes", start, cut, 2))

    count = lambda bit: F.size(F.filter("codes", lambda c: c.bitwiseAND(F.lit(bit)) > 0)).cast("long")
    groups = F.array_join(F.transform("cuts", group), ";")
    return texts.select("t1", "t2", "copies", count(1).alias("n_a"), count(2).alias("n_b"), F.size("cuts").cast("long").alias("n_groups"), groups.alias("groups"), F.transform("codes", lambda c: F.shiftright(c, 2)).alias("pairs"))


def pair_counts(words: DataFrame) -> DataFrame:
    """(pair, count, best): links of the whole corpus that hold each pair of ids, and whether no other pair of its B id has more."""
    counts = C.cut(words.select("copies", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("count")))
    b = F.col("pair").bitwiseAND(F.lit(SIDE - 1))
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return counts.join(most, b == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def _without_misspelt(docs: DataFrame, distinct: DataFrame, words: DataFrame, split: bool) -> DataFrame:
    """words with copies less those in texts that hold a segment which some side misspells; usually there is none, and words are as many as segments."""
    if distinct.count() == words.count():
        return words
    bad = distinct.join(words, ["t1", "t2"], "left_anti").select("t1", "t2")
    rows = _hashed(docs.select(F.monotonically_increasing_id().alias("row"), F.explode(segments(F.col("text"), split)).alias("segment")), "segment", "t1", "t2")
    rows = C.cut(rows.join(bad.withColumn("bad", F.lit(1)), ["t1", "t2"], "left").select("row", "t1", "t2", "bad"))
    gone = rows.join(rows.filter("bad = 1").select("row").distinct(), "row", "left_semi").groupBy("t1", "t2").agg(F.count("*").alias("gone"))
    return words.join(gone, ["t1", "t2"], "left").withColumn("copies", F.col("copies") - F.coalesce("gone", F.lit(0))).drop("gone")


#: What documents add up over their segments. Links are not among them: there is one for each distinct end, so n_a + n_b - n_groups.
SUMS = ["n_a", "n_b", "n_groups", "n_best", "count_sum"]


def lexicon(docs: DataFrame, split: bool) -> DataFrame:
    """(s1, s2, copies, *SUMS, groups) of every distinct segment of docs (text) that both sides spell; copies: how often it stands in the corpus."""
    spark = docs.sparkSession
    distinct = docs.select(F.explode(segments(F.col("text"), split)).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    distinct = C.cut(_hashed(distinct, "text", "t1", "t2"))
    with _settings(spark, STREAMED):
        words = C.cut(align(distinct))
    cuts = [distinct, words]
    words = _without_misspelt(docs, distinct, words, split)
    counts = C.cut(pair_counts(words))
    rows = words.select("t1", "t2", F.explode("pairs").alias("pair"))
    rows = rows.join(F.broadcast(counts), "pair") if counts.count() <= PAIRS else rows.join(counts, "pair")
    sums = rows.groupBy("t1", "t2").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    whole = words.select("t1", "t2", "copies", "n_a", "n_b", "n_groups", "groups").join(sums, ["t1", "t2"])
    out = C.cut(whole.select(F.col("t1").alias("s1"), F.col("t2").alias("s2"), "copies", *SUMS, "groups"))
    C.free(*cuts)
    return out


def alignment(docs: DataFrame, shown=lambda groups: groups) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row of docs (doc_id, text); groups is `a1,a2|b1;a3|b2,b3`, or what shown
    makes of that column (a digest, say, so that less travels), and empty without tokens."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", C.text_of(docs).alias("text"))
    split = separable(spark)
    found = lexicon(docs, split)
    # the least count that at most HOT segments reach; a row a count goes through one task
    reached = found.groupBy("copies").count().withColumn("segments", F.sum("count").over(Window.orderBy(F.desc("copies"))))
    least = reached.filter(F.col("segments") <= HOT).agg(F.min("copies")).first()[0]
    hot = F.broadcast(found.filter(F.col("copies") >= (1 << 62 if least is None else least)).select("s1", "s2", *SUMS, "groups"))
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0]
    docs = _hashed(docs, "text", "t1", "t2")
    n = _tasks(spark, chars)
    texts = docs.filter("text <> ''").groupBy("t1", "t2").agg(F.first("text").alias("text"))  # copies meet before they are dealt
    rows = _hashed(texts.select("t1", "t2", F.posexplode(segments(F.col("text"), split)).alias("pos", "segment")), "segment", "s1", "s2").drop("segment")
    rows = rows.join(hot, ["s1", "s2"], "left")
    one = F.struct("pos", "groups")
    sums = [F.sum(c).alias(c) for c in SUMS]
    often = rows.groupBy("t1", "t2").agg(*sums, F.collect_list(F.when(F.col("groups").isNotNull(), one)).alias("some"))
    rare = rows.filter("groups IS NULL").select("t1", "t2", "pos", "s1", "s2").join(found, ["s1", "s2"], "left")
    rare = rare.groupBy("t1", "t2").agg(*(F.sum(c).alias(f"rare_{c}") for c in SUMS), F.collect_list(one).alias("rest"), F.max(F.col("groups").isNull()).alias("misspelt"))
    none = F.array().cast("array<struct<pos:int,groups:string>>")
    groups = F.array_join(F.transform(F.array_sort(F.concat("some", F.coalesce("rest", none))), lambda g: g["groups"]), ";")
    total = [(F.coalesce(c, F.lit(0)) + F.coalesce(f"rare_{c}", F.lit(0))).alias(c) for c in SUMS]
    whole = often.join(rare, ["t1", "t2"], "left").filter(~F.coalesce("misspelt", F.lit(False))).select("t1", "t2", *total, shown(groups).alias("groups"))
    # texts and what comes from their rare segments are dealt alike, CHARS a task
    with _settings(spark, TABLED | {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        whole = C.cut(whole)
    C.free(found)
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in SUMS]
    done = docs.select("doc_id", "t1", "t2").join(whole, ["t1", "t2"], "left").select("doc_id", *zero, F.coalesce("groups", F.lit("")).alias("groups"))
    return done.withColumn("n_links", F.col("n_a") + F.col("n_b") - F.col("n_groups"))


def op12_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    done = alignment(C.table(spark, sf_dir, "documents"), lambda groups: F.sha2(F.encode(groups, "UTF-8"), 256))
    return done.withColumnRenamed("groups", "groups_sha256")
