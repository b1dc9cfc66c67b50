import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from fluxline.llm import align


def brute(rows):
    """Links by comparing all byte ranges of both sides, groups by common ends, counts over the corpus."""
    sides = (align.ByteLevel(open(align.FILES["a"], "rb").read()), align.Pieces(open(align.FILES["b"], "rb").read()))
    out, counts = [], Counter()
    for doc, text in rows:
        spans = []
        for side in sides:
            at, one = 0, []
            for i in side([" " + text])[0] if text else []:
                one.append((at, at + len(side.bytes[i]), i))
                at = one[-1][1]
            spans.append(one)
        joined = [b"".join(s.bytes[i] for _, _, i in one) for s, one in zip(sides, spans)]
        if not text or any(j != (" " + text).encode() for j in joined):
            spans = [[], []]
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        before, groups = 0, []
        for c in cuts:
            groups.append("|".join(",".join(str(i) for _, e, i in one if before < e <= c) for one in spans))
            before = c
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        counts.update(links)
        out.append((doc, len(spans[0]), len(spans[1]), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if cuts else ""))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(((d, a, b, g, len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), h) for d, a, b, g, k, h in out), key=repr)


ROWS = [
    (1, "Hello world, tokenizers!"), (2, "Hello world, tokenizers!"), (2, "naïve café — 日本語 🙂\n\n\ttabs"), (3, None), (4, ""), (5, " "), (None, "no id   with   runs      of blanks "), (6, "literal <0x41> <s> </s> <|endoftext|> <unk>"),
    (7, "a▁b is spelt otherwise"), (8, "a" * 500 + "b"), (9, "\x00\x01 control"), (10, "é ½ ² ﬁ"), (11, "\n"), (12, "1234567890 3.14159"),
]


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    made = [(100 + i, "".join(rng.choice(["the ", "in", "tion", " ", "ü", "ß", "\n", "zz", "9", "'s", "日", "  ", "er", "."]) for _ in range(rng.randrange(80)))) for i in range(60)]
    rows = ROWS + made
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS t1", "2 AS copies", "3 AS `end`")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for hot in (align.HOT, 5):
        monkeypatch.setattr(align, "HOT", hot)
        got = align.alignment(docs).withColumn("groups_sha256", F.expr("if(groups = '', '', sha2(groups, 256))"))
        assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == brute(rows)
    monkeypatch.setattr(align, "separable", lambda spark: False)
    assert sorted(map(repr, align.alignment(docs).collect())) == sorted(map(repr, got.drop("groups_sha256").collect()))


def test_pairs_beyond_the_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    want = sorted(map(repr, align.alignment(docs).collect()))
    monkeypatch.setattr(align, "PAIRS", 3)
    assert sorted(map(repr, align.alignment(docs).collect())) == want


def test_groups_spell_the_tokens(spark):
    for r in align.alignment(spark.createDataFrame(ROWS, "doc_id long, text string")).filter("n_a > 0").collect():
        sides = [[x for g in r.groups.split(";") for x in g.split("|")[i].split(",")] for i in (0, 1)]
        assert (len(sides[0]), len(sides[1]), len(r.groups.split(";"))) == (r.n_a, r.n_b, r.n_groups) and r.n_links == r.n_a + r.n_b - r.n_groups


def test_nothing_to_align(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align.alignment(docs).count() == 0
    assert align.alignment(spark.createDataFrame([(1, None)], "doc_id long, text string")).first().n_a == 0


def test_tokens_are_shuffled_only_as_segments(spark):
    words = spark.createDataFrame([(1, 2, " some", 3)], "t1 long, t2 long, text string, copies long")
    with align._settings(spark, align.STREAMED):
        plan = align.align(words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
