import random

import pytest
from pyspark.sql import functions as F

from fluxline.llm import chat, mixing, sentencepiece, shingle_join

VOCAB = [f"w{i}" for i in range(400)]


def brute_components(texts):
    def grams(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets, root = {i: grams(t) for i, t in texts}, {i: i for i, _ in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_join_equals_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        words = [rng.choice(VOCAB) for _ in range(rng.choice([3, 5, 9, 30, 120, 300]))]
        for _ in range(8):  # copies that drift apart, so that groups are chains
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = rng.choice(VOCAB)
    texts += ["", None, "one", "one", "  \t "]
    rows = list(enumerate(texts))
    got = shingle_join.near_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows)


def test_jaccard_join_of_nothing(spark):
    assert shingle_join.near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chat_round_trip_with_conflicts(spark):
    rows = [(1, 0, "user", "</s>[INST] a\\b"), (1, 1, "assistant", "[/INST]<s>"), (2, 0, "user", None), (None, 0, None, "x")]
    df = chat.parse(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in df.collect()}
    assert got == {1: [("user", "</s>[INST] a\\b"), ("assistant", "[/INST]<s>")], 2: [("user", "")], None: [("", "x")]}
    assert df.agg(F.min("intact")).first()[0]


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randrange(1, 60), rng.choice(["a", "b", "c"])) for i in range(600)] + [(9001, None, None), (9002, "", "a")]
    df = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).withColumn("taken", F.col("size") * F.col("copies"))
    assert df.count() == len(rows) and df.filter("copies > 2").count() == 0
    for r in df.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert r.taken == pytest.approx(r.target, abs=61)


def test_pieces_round_trip(spark):
    pieces = sentencepiece.load_pieces()
    texts = ["", None, "Hello  world", "a▁b", " lead", "日本語 🙂\n\n tail ", "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    got = sentencepiece.decode(sentencepiece.encode(df, pieces), pieces)
    assert {r.doc_id: r.decoded for r in got.collect()} == {i: t or "" for i, t in enumerate(texts)}
