import hashlib
import re

import pytest
from pyspark.sql import functions as F

from fluxline.llm import common as C
from fluxline.llm import fingerprint, langid, lm, mixing, sentencepiece, toxicity

SF = "/root/testdata/sf0.001"
ODD = [(9000001, None), (9000002, ""), (9000003, "½ ² Ⅷ 123"), (9000004, "word " * 30000), (9000004, "word " * 30000), (None, "no id at all")]


@pytest.fixture(scope="module")
def docs(spark):
    df = C.table(spark, SF, "documents").select("doc_id", "text", "lang")
    return df.unionByName(spark.createDataFrame(ODD, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))).cache()


def test_language_on_held_out_documents(spark, docs):
    held = C.crc_bucket("doc_id", 3) == 1
    model = langid.train(docs.filter(~held))
    got = langid.predict(docs.withColumns({"score": F.lit("x"), "row": F.lit(1)}), model).filter(held)
    assert got.filter("lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    und = langid.predict(spark.createDataFrame(ODD[:3], "doc_id long, text string"), model).collect()
    assert {(r.lang_pred, r.score) for r in und} == {("und", 0.0)}
    assert langid.predict(docs.limit(0), []).count() == 0 and langid.predict(docs.limit(3), []).first().lang_pred == "und"


def test_toxicity_learns_and_stands_odd_rows(spark, docs):
    made = [(i, f"{'vile gruk' if i % 4 == 0 else 'calm tree'} number {i} of the list") for i in range(200)]
    texts = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)] + [(5, None)], "doc_id long, toxic int")
    model = toxicity.train(texts, labels)
    got = toxicity.score(texts.withColumns({"score": F.lit(1), "predicted": F.lit(2)}), model).filter("doc_id >= 100").collect()
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) == bool(r.predicted) for r in got)
    odd = toxicity.score(docs.drop("lang"), model).filter("doc_id IS NULL OR doc_id > 9000000").collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(docs.limit(0), toxicity.train(texts.limit(0), labels)).count() == 0


def test_language_model_counts_equal_brute_force(spark, docs):
    rows = docs.select("doc_id", (C.crc_bucket("doc_id", 5) == 1).alias("held_out"), C.text_of(docs).alias("text"))
    got = lm.score_documents(rows).collect()
    texts = rows.collect()
    count, total = {}, 0
    for r in texts:
        if not r.held_out:
            for w in [*lm.words_of(r.text), b"\n"]:
                count[w], total = count.get(w, 0) + 1, total + 1
    want = sorted((r.doc_id or -1, len(lm.words_of(r.text)) + 1, sum(w in count for w in [*lm.words_of(r.text), b"\n"])) for r in texts)
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known) for r in got) == want and {r.train_tokens for r in got} == {total}
    assert all(r.score < 0 for r in got)


def test_edited_texts_and_likeness(spark, docs):
    rows = [(1, "one two three four five six seven eight nine ten"), (3, None), (5, "one two three four five six seven eight nine ten"), (7, "é" * 9), (7, "é" * 9)]
    df = fingerprint.edited_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest()) for r in df.collect()}
    texts = {1: rows[0][1], 3: "", 5: rows[2][1], 7: rows[3][1]}
    ids = sorted(texts)
    for i, own in texts.items():
        after, n = texts[ids[(ids.index(i) + 1) % len(ids)]], len(own) // 4
        assert (i, len(own), hashlib.sha256((own[: len(own) - n] + after[:n]).encode()).hexdigest()) in got
    vec = fingerprint.vector(spark.createDataFrame([("a b\nc d", "c d\na b", "a b", "c d")], "p string, q string, x string, y string"), "p", "vp")
    for c in "qxy":
        vec = fingerprint.vector(vec, c, f"v{c}")
    same, grown, shrunk = vec.select(F.col("vp.dense") == F.col("vq.dense"), fingerprint.add(F.col("vx"), F.col("vy"))["dense"] == F.col("vp.dense"), fingerprint.remove(F.col("vp"), F.col("vy"))["dense"] == F.col("vx.dense")).first()
    assert same and grown and shrunk


def test_pieces_are_the_best_by_brute_force():
    pieces = sentencepiece.load_pieces()
    v = sentencepiece.Vocabulary(pieces)
    score = {p.encode(): s for p, s, t in pieces if t in (1, 4)}
    for text in ("the quick brown fox", "internationalisation  of   things", "aaaaaaaa bbbb", "Das ist ein Satz."):
        spelled = (" " + text).replace(" ", "▁").encode()
        best = [0.0] + [None] * len(spelled)
        for i in range(len(spelled)):
            if best[i] is not None:
                for j in range(i + 1, min(len(spelled), i + 64) + 1):
                    if spelled[i:j] in score and (best[j] is None or best[i] + score[spelled[i:j]] > best[j]):
                        best[j] = best[i] + score[spelled[i:j]]
        ids, ends = sentencepiece.Encoder(v)([text])
        assert sum(v.score[i] for i in ids) == pytest.approx(best[-1]) and v.decode(ids, ends).to_pylist() == [text]


def test_sizes_of_the_mix_make_no_lists_of_words(spark):
    texts = [None, "", " \t\n", "a", " one  two three \r\n", "\x0b\U0001f600\U0001f600 x\x00y\x1cz\x0c", "$1 \\ $", "é 　 \x85"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = df.select("id", mixing.n_words(mixing.C.text_of(df)).alias("n"))
    assert {r.id: r.n for r in got.collect()} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    assert "regexp_extract_all" not in mixing.units_of(df.withColumnRenamed("id", "doc_id").withColumn("source", F.lit("s")))._jdf.queryExecution().optimizedPlan().toString()
