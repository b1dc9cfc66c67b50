"""Homomorphic multiset fingerprints of documents (native DataFrame functions only).

A text is a multiset of paragraphs (lines that hold a word). Every paragraph hashes to a wide vector and a fingerprint is the sum of these
vectors, each coordinate modulo a power of two. Sums commute, so paragraph order does not matter, and ``add`` / ``remove`` update a
fingerprint by the paragraphs that came or went without a look at the rest.

The vector has two parts. ``DENSE`` coordinates modulo 2**60, one hash seed each, decide equality. ``LEVELS * LANES`` sparse coordinates
modulo 2**16 serve likeness: a paragraph is cut into runs of four words, a run adds its value to one lane of level 0, and to one of level k if
the low 2k bits of its hash are zero. Runs that two texts share leave the same sums, so the share of equal lanes among those in use estimates
how much two texts have in common; long texts are read off sparser levels. A text has 2**31 bytes at most, so 2**28 runs; of two such texts about two
runs are left on the last level, which therefore never fills up.

Null text counts as empty; an empty text has the all-zero fingerprint. xxhash64 is no cryptographic hash: equality holds against accidents,
not against an adversary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

DENSE, LEVELS, LANES = 4, 15, 32
DENSE_MASK, CELL_MASK = (1 << 60) - 1, 0xFFFF
#: A level with more lanes in use than this is too full to compare.
FULL = 22
RUN = r"[^\x20\x09-\x0D]+(?:[\x20\x09]+[^\x20\x09-\x0D]+){0,3}"


def _long(v: int) -> Column:
    return F.lit(v).cast("long")


def _dense(seed: int):
    return lambda a, p: (a + F.xxhash64(_long(seed), p).bitwiseAND(_long(DENSE_MASK))).bitwiseAND(_long(DENSE_MASK))


def _at_level(k: int):
    return lambda h: h.bitwiseAND(_long(4**k - 1)) == 0


def _pack(h: Column) -> Column:
    """Lane above, value below."""
    return F.shiftrightunsigned(h, 12).bitwiseAND(_long((LANES << 16) - 1))


def _lanes(name: str) -> Column:
    def lane(i: Column) -> Column:
        own = F.filter(F.col(name), lambda x: F.shiftright(x, 16) == i)
        return F.aggregate(own, _long(0), lambda a, x: (a + x).bitwiseAND(_long(CELL_MASK)))

    return F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lane)


def vector(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add out: struct<dense array<long>, cells array<long>>, the wide vector of a text column."""
    t = F.coalesce(F.col(text), F.lit(""))
    pars, hs = f"__{out}_pars", f"__{out}_hs"
    df = df.withColumn(pars, F.filter(F.split(t, "\n"), lambda p: p.rlike(C.WORD)))
    df = df.withColumn(hs, F.transform(F.regexp_extract_all(t, F.lit(RUN), F.lit(0)), lambda r: F.xxhash64(_long(77), r)))
    packed = [f"__{out}_{k}" for k in range(LEVELS)]
    kept = [f"__{out}_hs{k}" for k in range(LEVELS)]
    for k in range(LEVELS):  # each level is taken from the one before
        df = df.withColumn(kept[k], F.filter(F.col(kept[k - 1]), _at_level(k)) if k else F.col(hs))
    df = df.withColumns({name: F.transform(F.col(hs_k), _pack) for name, hs_k in zip(packed, kept)})
    # the second use of each level's array (its size) keeps the optimizer from moving the array's making into the loop over lanes
    cells = F.flatten(F.array(*(F.when(F.size(name) > 0, _lanes(name)).otherwise(F.array_repeat(_long(0), LANES)) for name in packed)))
    dense = [F.aggregate(F.col(pars), _long(0), _dense(s)) for s in range(DENSE)]
    return df.withColumn(out, F.struct(F.array(*dense).alias("dense"), cells.alias("cells"))).drop(pars, hs, *kept, *packed)


def _combined(a: Column, b: Column, sign: int) -> Column:
    def part(name: str, mask: int) -> Column:
        return F.zip_with(a[name], b[name], lambda x, y: (x + y * F.lit(sign)).bitwiseAND(_long(mask))).alias(name)

    return F.struct(part("dense", DENSE_MASK), part("cells", CELL_MASK))


def add(a: Column, b: Column) -> Column:
    """The vector of the paragraphs of both texts together."""
    return _combined(a, b, 1)


def remove(a: Column, b: Column) -> Column:
    """The vector of a's paragraphs without b's."""
    return _combined(a, b, -1)


def as_text(v: Column) -> Column:
    """The fingerprint as lower-case hex: 15 digits a dense coordinate, 4 a sparse one."""
    wide = F.array_join(F.transform(v["dense"], lambda x: F.lpad(F.hex(x), 15, "0")), "")
    return F.lower(F.concat(wide, F.array_join(F.transform(v["cells"], lambda x: F.lpad(F.hex(x), 4, "0")), "")))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: equal lanes over lanes in use, from the finest level that is not too full; 1 if the vectors are equal."""
    marks = F.zip_with(a["cells"], b["cells"], lambda x, y: F.when((x == 0) & (y == 0), 0).when(x == y, 2).otherwise(1))

    def at(k: int) -> Column:
        level = F.slice(marks, k * LANES + 1, (LEVELS - k) * LANES)
        return F.size(F.filter(level, lambda m: m == 2)) / F.size(F.filter(level, lambda m: m > 0))

    def used(k: int) -> Column:
        return F.size(F.filter(F.slice(marks, k * LANES + 1, LANES), lambda m: m > 0))

    out = F.lit(0.0)
    for k in reversed(range(LEVELS)):
        fits = (used(k) > 0) if k == LEVELS - 1 else (used(k) > 0) & (used(k) <= FULL)
        out = F.when(fits, at(k)).otherwise(out)
    return F.when((a["dense"] == b["dense"]) & (a["cells"] == b["cells"]), F.lit(1.0)).otherwise(out)


def neighbours(docs: DataFrame) -> DataFrame:
    """(k, h, n, next_k, next_h, prev_k, prev_h, prev_n) of each distinct (doc_id, text) in ascending doc_id, the last followed by the first.

    Ids are dealt by range; each range finds its own neighbours and only the two ends of a range (two rows a partition) meet in one task.
    k is doc_id with null as the least long, h the text's hash, which orders repeated ids.
    """
    ids = keyed(docs).groupBy("k", "h").agg(F.max("n").alias("n"))
    ids = C.cut(ids.repartitionByRange("k", "h").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy("k", "h")
    row = F.struct("k", "h", "n")
    ends = ids.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    order, whole = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part",
        F.coalesce(F.lead("first").over(order), F.first("first").over(whole)).alias("after"),
        F.coalesce(F.lag("last").over(order), F.last("last").over(whole)).alias("before"),
    )
    linked = ids.withColumns({"after_in": F.lead(row).over(inside), "before_in": F.lag(row).over(inside)}).join(ends, "part")
    nxt, prev = F.coalesce("after_in", "after"), F.coalesce("before_in", "before")
    return linked.select("k", "h", "n", nxt["k"].alias("next_k"), nxt["h"].alias("next_h"), prev["k"].alias("prev_k"), prev["h"].alias("prev_h"), prev["n"].alias("prev_n"))


def keyed(docs: DataFrame) -> DataFrame:
    t = C.text_of(docs)
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), _long(-(1 << 63))).alias("k"), F.xxhash64(t).alias("h"), F.length(t).cast("long").alias("n"), t.alias("body"))


def edited_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, body, edited, vec, next_vec): each text, the text whose last quarter comes from the next one's start, and vectors.

    Both uses of the texts take the same columns, so that they share one exchange.
    """
    base = keyed(docs).drop("n").join(neighbours(docs), ["k", "h"])
    sent = vector(base, "body", "vec").select(
        F.col("prev_k").alias("k"), F.col("prev_h").alias("h"), F.expr("substring(body, 1, CAST(prev_n DIV 4 AS INT))").alias("piece"), F.col("vec").alias("next_vec")
    )
    sent = sent.groupBy("k", "h").agg(F.first("piece").alias("piece"), F.first("next_vec").alias("next_vec"))  # a repeated row sends the same again
    both = base.join(sent, ["k", "h"]).withColumn("edited", F.expr("concat(substring(body, 1, CAST(n - n DIV 4 AS INT)), piece)"))
    doc_id = F.when(F.col("k") != _long(-(1 << 63)), F.col("k")).alias("doc_id")
    return vector(both, "body", "vec").select(doc_id, F.col("n").alias("n_chars"), "body", "edited", "vec", "next_vec")


def op9_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """One row per row of documents. Equal ids order by text hash; a row repeated whole gives the same result again."""
    df = vector(edited_documents(C.table(spark, sf_dir, "documents")), "edited", "edited_vec")
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("vec")).alias("fingerprint"),
        as_text(F.col("edited_vec")).alias("edited_fingerprint"),
        likeness(F.col("vec"), F.col("edited_vec")).alias("near_edited"),
        likeness(F.col("vec"), F.col("next_vec")).alias("near_next"),
    )
