"""Language identification by compression.

Each language gets a raw-content zstandard dictionary: training texts (of long ones four pieces from all over the text, a quarter of the dictionary
together) in the order of a hash, joined up to ``DICTIONARY`` bytes. That is the bound of the fit; the texts that are predicted are read whole. A text is
compressed once per dictionary and belongs to the language whose dictionary leaves the fewest bytes; score is the margin, the share of bytes
that it saves over the second best. ``rejected`` marks margins under ``MARGIN``; the prediction stands beside it, so that a caller who needs a
language for every text has one. Equal sizes (very short texts) go to the language whose dictionary holds the text's words more often, then to
that with more training documents, then to the smaller name.

The dictionaries are the only bounded sample: ``SLOTS`` texts a language at most, whichever have the least hash in each of as many hash classes,
so the training set's size and order do not matter. Texts compare by their letters: lower case, and a blank
for any run of other characters. A text that is null or has no letter is ``und`` with score 0;
if no training row has a language, every text is. Repeated rows get the same answer, an empty table gives an empty one, and columns named like the results
are replaced.
"""

from __future__ import annotations

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SLOTS, DICTIONARY, LEVEL, MARGIN = 96, 112 * 1024, 6, 0.01
NO_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")


def letters(text: str) -> str:
    """Lower case, every run of anything but letters (Unicode class L) and their marks as one blank; empty without a letter."""
    return NO_LETTERS.sub(" ", text.lower()).strip() if LETTER.search(text) else ""


def train(docs: DataFrame) -> list[tuple[str, bytes]]:
    """(language, dictionary) of docs (text, lang), languages with more documents first. At most SLOTS texts a language reach the driver."""
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    slots = rows.groupBy("lang", F.pmod("h", F.lit(SLOTS)).alias("slot")).agg(F.min("h").alias("h"), F.count("*").alias("n"))
    n: dict[str, int] = {}
    chosen = slots.collect()  # SLOTS rows a language
    for r in chosen:
        n[r["lang"]] = n.get(r["lang"], 0) + r["n"]
    texts = rows.filter(F.col("h").isin([r["h"] for r in chosen])).groupBy("lang", "h").agg(F.first("text").alias("text"))
    # of a text longer than a quarter of the dictionary, four pieces spread over all of it
    piece, size = DICTIONARY // 16, F.length("text")
    spread = F.concat_ws(" ", *(F.substring("text", (F.floor((size - piece) * i / 3) + 1).cast("int"), F.lit(piece)) for i in range(4)))
    texts = texts.select("lang", F.struct("h", F.when(size > 4 * piece, spread).otherwise(F.col("text")).alias("text")).alias("one"))
    langs = texts.groupBy("lang").agg(F.array_sort(F.collect_list("one")).alias("texts")).select("lang", F.substring(F.array_join("texts.text", "\n"), 1, DICTIONARY).alias("content")).collect()
    return [(r["lang"], letters(r["content"]).encode()[:DICTIONARY]) for r in sorted(langs, key=lambda r: (-n[r["lang"]], r["lang"]))]


def _classify(model: list[tuple[str, bytes]], margin: float):
    def classify(batches):
        packers = []
        for _, content in model:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            packers.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False))
        for batch in batches:
            langs, scores, rejected = [], [], []
            for value in batch.column("text"):
                data = letters(value.as_py() or "").encode()
                if not packers or not data:
                    best, score = "und", 0.0
                else:
                    sizes = [len(p.compress(data)) for p in packers]
                    at = min(range(len(sizes)), key=sizes.__getitem__)
                    if sizes.count(sizes[at]) > 1:
                        words = set(data.split())
                        tied = [i for i, n in enumerate(sizes) if n == sizes[at]]
                        at = max(tied, key=lambda i: sum(model[i][1].count(w) for w in words))
                    second = min(sizes[:at] + sizes[at + 1 :], default=len(data) + sizes[at])
                    best, score = model[at][0], max(0.0, 1.0 - sizes[at] / second)
                langs.append(best)
                scores.append(score)
                rejected.append(score < margin)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(langs, "string"), pa.array(scores, "double"), pa.array(rejected, "bool")], ["row", "lang_pred", "score", "rejected"])

    return classify


def predict(docs: DataFrame, model: list[tuple[str, bytes]], margin: float = MARGIN) -> DataFrame:
    """docs without text, plus lang_pred, score, rejected."""
    return C.mapped(docs, "text", _classify(model, margin), {"lang_pred": "string", "score": "double", "rejected": "boolean"})


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    held_out = C.crc_bucket("doc_id", 3) == 1
    model = train(docs.filter(~held_out).select(docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang")))
    return predict(docs.select("doc_id", held_out.alias("held_out"), docs["text"].cast("string").alias("text")), model)
