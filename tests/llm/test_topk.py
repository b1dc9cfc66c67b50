import numpy as np
from pyspark.sql import functions as F

from fluxline.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=5):
    v = [(i, np.floor(256 * np.array(e, np.float32).astype(float)).astype(np.int64)) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = {}
    for i, a in {(i, tuple(a)) for i, a in v if i % 50 == 0}:
        found = sorted((-int(np.dot(a, b)), j) for j, b in v if j != i and len(b) == len(a))[:k]
        out.update({(i, r + 1): (j, -s) for r, (s, j) in enumerate(found)})
    return out


def test_equals_brute_force_with_ties_repeats_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 100)  # several blocks, so that bars travel
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(401)]
    rows += [(500 + i, [0.5] * 8) for i in range(6)] + [(700, [1.0, 2.0]), (701, [1.0, 2.0]), (702, [-1.0, -2.0])]
    rows += [(800, None), (801, [1.0] * 7 + [None]), (802, [float("nan")] * 8), (803, [float("inf")] * 8), (None, [1.0] * 8), (120, rows[120][1]), (120, rows[120][1]), (850, [])]
    df = topk.vectors(spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit(1), "v": F.lit("x")}))
    queries = df.filter(F.col("vec_id") % 50 == 0).dropDuplicates(["vec_id", "v"])
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(queries, df).collect()}
    assert got == brute(rows)


def test_reading_stops_where_the_data_let_it(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.exponential(size=4) ** 3]) for i in range(3000)]
    df = topk.vectors(spark.createDataFrame(rows, SCHEMA))
    got = topk.reads(df.filter(F.col("vec_id") % 50 == 0), df).first()
    assert got.stopped == 1 and got.share < 0.5


def test_of_nothing(spark):
    df = topk.vectors(spark.createDataFrame([], SCHEMA))
    assert topk.top_k(df, df).count() == 0
