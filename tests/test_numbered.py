"""Row numbers of input order and values taken over from lines above, against plain loops."""

import random

from pyspark.sql import functions as F

from fluxline.operators.numbered import numbered
from fluxline.operators.survey import as_survey
from fluxline.sources import lines as L
from fluxline.sources import xyz


def test_numbers_do_not_depend_on_partitions(spark):
    rows = [(i * 7 % 50, None if i % 9 == 0 else f"v{i % 4}") for i in range(200)]
    for parts in (1, 3, 8):
        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "part int, place string")
        got = sorted((r.fid, r.part, r.place) for r in numbered(df, "fid").collect())
        assert got == [(i + 1, *r) for i, r in enumerate(rows)]
    again = numbered(spark.createDataFrame([(5, "a"), (5, "a")], "fid int, x string"), "fid")
    assert again.columns == ["x", "fid"] and sorted(r.fid for r in again.collect()) == [1, 2]
    assert numbered(spark.createDataFrame([], "x string"), "fid").count() == 0


def test_numbers_hold_through_shuffles(spark):
    """Numbers are those of one reading: both branches of a join, each dealt anew, agree."""
    df = numbered(spark.range(500).select(F.col("id").alias("v")), "fid")
    both = df.repartition(7).withColumnRenamed("v", "a").join(df.repartition(3, "v").withColumnRenamed("v", "b"), "fid")
    assert both.filter("a <> b OR a + 1 <> fid").count() == 0 and both.count() == 500


def test_survey_without_fid_keeps_input_rows(spark):
    rows = [(f"L{i % 3}", f"2025-02-03 04:05:{i % 20:02d}", float(i), 0.0, 5e4) for i in range(60)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 6), "line string, at string, x double, y double, mag double")
    got = as_survey(df.withColumn("time", F.col("at").cast("timestamp")).drop("at")).collect()
    assert sorted((r.fid, r.x) for r in got) == [(i + 1, float(i)) for i in range(60)]
    for r in got:  # equal times: the earlier input row first
        assert all(o.seq > r.seq for o in got if o.line == r.line and (o.time, o.fid) > (r.time, r.fid))


def test_lines_of_a_file_of_many_splits(spark, tmp_path):
    texts = {f"f{k}.txt": [f"{k} line {i} " + "x" * (i * 31 % 90) for i in range(n)] for k, n in ((0, 400), (1, 1), (2, 150), (3, 0))}
    for name, rows in texts.items():
        (tmp_path / name).write_text("".join(r + "\n" for r in rows))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000b")
        got = L.read_lines(spark, str(tmp_path))
        assert sorted((r.file.split("/")[-1], r.n, r.value) for r in got.collect()) == sorted((f, i + 1, v) for f, rows in texts.items() for i, v in enumerate(rows))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "row_number" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_values_from_above(spark):
    rng, rows, want = random.Random(6), [], []
    for file, n in (("a", 60), ("b", 1), ("c", 23)):
        last = None
        for i in range(1, n + 1):
            v = f"h{rng.randrange(100)}" if rng.random() < 0.12 else None
            if rng.random() < 0.8:  # numbers may have gaps
                last = v or last
                rows.append((file, i, v))
                want.append((file, i, last))
    df = spark.createDataFrame(rows, "file string, n long, v string").repartition(5)
    for size in (1, 4, 1000):
        assert sorted((r.file, r.n, r.v or "") for r in L.last_above(df, "v", size).collect()) == sorted((f, i, v or "") for f, i, v in want)
        assert [(r.file, r.n) for r in L.places(df, "k", size).orderBy("k").collect()] == [(f, i) for f, i, _ in rows]
        assert L.places(df, "k", size).agg(F.min("k"), F.max("k")).first() == (1, len(rows))


def test_survey_of_a_split_file(spark, tmp_path):
    out = ["/ x y time mag"]
    for k in range(5):
        out += [f"{'Tie' if k == 4 else 'LINE'} {70 - k}"] + [f"{k}.5 {i} {600 * k + i} {5e4 + i}" for i in range(40)]
    (tmp_path / "s.xyz").write_text("\n".join(out) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
        got = xyz.read_xyz(L.read_lines(spark, str(tmp_path / "s.xyz"))).select("fid", "line", "line_type", "x", "y").orderBy("fid").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [tuple(r) for r in got] == [(40 * k + i + 1, str(70 - k), "tie" if k == 4 else "traverse", k + 0.5, float(i)) for k in range(5) for i in range(40)]
