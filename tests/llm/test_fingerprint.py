import random

from pyspark.sql import functions as F

from fluxline.llm import fingerprint


def test_likeness_holds_for_long_texts(spark):
    rng = random.Random(9)
    a = [f"{rng.randrange(16**6):06x}" for _ in range(400_000)]
    b = a[:300_000] + [f"{rng.randrange(16**6):06x}" for _ in range(100_000)]
    c = [f"{rng.randrange(16**6):06x}" for _ in range(400_000)]
    df = spark.createDataFrame([tuple(" ".join(x) for x in (a, b, c))], "a string, b string, c string")
    for name in "abc":
        df = fingerprint.vector(df, name, f"v_{name}")
    near, far = df.select(fingerprint.likeness(F.col("v_a"), F.col("v_b")), fingerprint.likeness(F.col("v_a"), F.col("v_c"))).first()
    assert 0.35 < near < 0.85 and far < 0.1  # three quarters in common: 0.6
