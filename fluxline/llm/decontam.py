"""Benchmark decontamination (native DataFrame functions only): a broadcast hash set of normalised test n-grams meets the word windows of documents.

A-Z is lower-cased and words are runs of anything but ASCII characters other than digits and letters. A window is GRAM consecutive words of a
benchmark item; an item of fewer words, but not none, is one window as a whole. Windows of all items are hashed, equal ones become one row with the
ids of all their items, and that table is broadcast; beyond BLOCK windows it goes in several blocks, each broadcast on its own against all
documents, so that a broadcast never grows with the benchmark. Each document hashes its words once, then every window of every length in use from
those hashes, in one pass without a shuffle; a window that meets the set counts only if its words are equal too (the verification, within the
join). What is shuffled are hits and one row a document.

Null and empty texts have no words: no hit, no item. A null item_id counts as an empty one; items that repeat an id are one item, hit by any of
them; repeated documents are judged alike, each in a row of its own, and a null doc_id is an id like others; an empty benchmark hits nothing and an
empty table of documents gives an empty one. occurrences reads no further columns; they pass through clean untouched, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

GRAM = 10
#: Most windows of one broadcast (some 200 bytes each).
BLOCK = 200_000
#: A word after lower-casing, and in a text as it is.
WORD, RAW_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "".join(map(chr, range(65, 91)))
#: Places and lengths of windows travel as one number, place * STRIDE + length.
STRIDE = 64


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, UPPER.lower()), F.lit(WORD), F.lit(0))


def _hash(hashes: Column, at: Column, k: Column, lengths: list[int]) -> Column:
    """Hash of the window of k words from place at on, null for other lengths; hashes are those of the words."""
    return reduce(lambda rest, n: F.when(k == n, F.xxhash64(*(F.get(hashes, at + j) for j in range(n)))).otherwise(rest), lengths, F.lit(None).cast("long"))


def benchmark_windows(benchmark: DataFrame, gram: int = GRAM) -> DataFrame:
    """(gram_k, gram_words, gram_h, items): each distinct window of the items (item_id, text) once, with the sorted ids of all items that hold it."""
    items = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("item"), words_of(C.text_of(benchmark)).alias("words"))
    items = items.filter(F.size("words") > 0).withColumn("gram_k", F.least(F.size("words"), F.lit(gram)))
    at = items.select("item", "words", "gram_k", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("gram_k") + 1)).alias("at"))
    grams = at.select("item", "gram_k", F.slice("words", F.col("at"), F.col("gram_k")).alias("gram_words"))
    hashes = F.transform("gram_words", lambda w: F.xxhash64(w))
    grams = grams.groupBy("gram_k", "gram_words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return grams.withColumn("gram_h", _hash(hashes, F.lit(0), F.col("gram_k"), list(range(1, gram + 1))))


def occurrences(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, spans, items) of each row of docs (doc_id, text): n_hit words lie inside occurring windows, spans
    array<struct<start, stop>> are their places (0-based, stop excluded), items the sorted ids of all items that occur. text_key is a hash of the text."""
    if not 0 < gram < STRIDE - 1:
        raise ValueError(f"gram must be between 1 and {STRIDE - 2} words")
    grams = C.cut(benchmark_windows(benchmark, gram))
    total, lengths = grams.count(), sorted(r.gram_k for r in grams.select("gram_k").distinct().collect())
    text = C.text_of(docs)
    df = docs.select("doc_id", F.xxhash64(text).alias("text_key"), F.monotonically_increasing_id().alias("row"), words_of(text).alias("words"))
    df = df.withColumns({"n_words": F.size("words"), "hashes": F.transform("words", lambda w: F.xxhash64(w))})
    # -1 stands for the document itself; windows are hashed, met and verified in one stage, where words are a reference and no copy
    none = F.array().cast("array<int>")
    codes = [F.when(F.col("n_words") >= k, F.sequence(F.lit(k), (F.col("n_words") - k) * STRIDE + k, F.lit(STRIDE))).otherwise(none) for k in lengths]
    df = df.select("*", F.explode(F.concat(F.array(F.lit(-1)), *codes)).alias("code"))
    df = df.withColumns({"at": F.floor(F.col("code") / STRIDE).cast("int"), "k": F.when(F.col("code") >= 0, F.col("code") % STRIDE).otherwise(0)})
    df = df.withColumn("h", _hash(F.col("hashes"), F.col("at"), F.col("k"), lengths))
    equal = reduce(Column.__and__, ((F.col("k") <= j) | F.get("words", F.col("at") + j).eqNullSafe(F.get("gram_words", F.lit(j))) for j in range(max(lengths, default=0))), F.col("k") == F.col("gram_k"))
    parts, n = [], -(-total // block) or 1
    for i in range(n):
        some = F.broadcast(grams.filter(F.pmod("gram_h", F.lit(n)) == i) if n > 1 else grams)
        met = df.join(some, (F.col("h") == F.col("gram_h")) & equal, "left").filter(F.col("items").isNotNull() | ((F.col("code") == -1) if i == 0 else F.lit(False)))
        parts.append(met.select("doc_id", "text_key", "row", "n_words", F.when(F.col("items").isNotNull(), F.col("code")).alias("code"), "items"))
    met = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "text_key", "row", "n_words").agg(F.collect_set("code").alias("codes"), F.collect_set("items").alias("items"))
    places = F.flatten(F.transform("codes", lambda c: F.sequence(F.floor(c / STRIDE).cast("int"), F.floor(c / STRIDE).cast("int") + c % STRIDE - 1)))
    met = met.withColumn("covered", F.array_distinct(places)).withColumn("after", F.transform("covered", lambda p: p + 1))
    starts, stops = F.array_sort(F.array_except("covered", "after")), F.array_sort(F.array_except("after", "covered"))
    spans = F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop")))
    return met.select("doc_id", "text_key", "n_words", F.size("covered").alias("n_hit"), spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def without_spans(text: Column | str, spans: Column | str) -> Column:
    """text without the words inside spans and without what stands between them and the word before."""
    text, spans = (F.col(c) if isinstance(c, str) else c for c in (text, spans))
    words, between = F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0)), F.split(text, RAW_WORD)
    n = F.size(words)
    kept = F.zip_with(F.concat(F.array(F.lit(0)), spans["stop"]), F.concat(spans["start"], F.array(n)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def glued(x: Column) -> Column:
        """x: words, between and kept as values, so that none is taken again for each word."""
        run = lambda r: F.array_join(F.transform(F.sequence(r["a"], r["b"] - 1), lambda i: F.concat(F.get(x["between"], i), F.get(x["words"], i))), "")
        return F.concat(F.array_join(F.transform(F.filter(x["kept"], lambda r: r["a"] < r["b"]), run), ""), F.element_at(x["between"], -1))

    return F.transform(F.array(F.struct(words.alias("words"), between.alias("between"), kept.alias("kept"))), glued)[0]


def clean(docs: DataFrame, benchmark: DataFrame, how: str = "spans", gram: int = GRAM) -> DataFrame:
    """docs (doc_id, text, ...) without contaminated rows (how="documents"), or with contaminated words cut out of their texts (how="spans")."""
    if how not in ("spans", "documents"):
        raise ValueError("how must be 'spans' or 'documents'")
    found = occurrences(docs, benchmark, gram).filter("n_hit > 0").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "spans").dropDuplicates(["__id", "__key"])
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), docs["doc_id"].alias("id"), C.text_of(docs).alias("whole")).withColumn("key", F.xxhash64("whole"))
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))
    if how == "documents":
        return rows.join(found, same, "left_anti").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
    rows = rows.join(found, same, "left")
    text = F.when(F.col("spans").isNotNull(), without_spans("whole", "spans")).otherwise(F.col("row.text"))
    return rows.select(*((text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op13_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = occurrences(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256)
    return found.select("doc_id", F.col("n_words").cast("long"), F.col("n_hit").cast("long"), F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS w FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(len(w), {GRAM}) AS k FROM b WHERE len(w) > 0))
), hits AS (
  SELECT r, i, x.k, item
  FROM (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g))) x
  JOIN g ON x.k = g.k AND x.gram = g.gram
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r
), found AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""
