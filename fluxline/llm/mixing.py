"""Mixing sources to target weights by the cube method (balanced sampling).

Each source gets a target, and each of its documents the same expected number of copies f = target / source size, at most 2. floor(f) copies
are certain; the fraction is an inclusion probability that the cube method rounds to 0 or 1 while it holds two totals of the source, documents
and words. The flight phase walks through the null space of these two constraints (three open documents at a time, so that one of them settles
with each step) in blocks of about ``BLOCK`` documents of one source; every block leaves two open documents at most. Those of a source's
blocks meet in blocks of the next level, until one block is left. A step of three would leave that block's longest documents for last, whose words
no other could then make up for; so there each step moves the longest open document against all others at once, along the direction in the null space that is
nearest to p (1 - p) of each, until it or another settles. What is left for the landing is the two shortest documents: they take the joint distribution
that keeps both probabilities and the words nearest. A hot source is only more blocks; no group ever grows with the data.

Draws are seeded by source, level and block, and documents order by (size, id, text hash), so reruns agree. Sizes are counts of words
(null text: 0). Documents of size 0 count as documents only. A source of size 0 has target 0. A repeated row shares the fate of its copies.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS, SHARE, LIMIT, BLOCK = (3, 1, 2), 1.5, 2, 2000
UNIT = "source string, doc_id long, h long, size long, m long, source_size long, target double, base long, blocks long, pi double"


def n_words(text: Column) -> Column:
    """Number of words of the contract. A letter of each is left and counted; regexp_count would make a list of all words first."""
    return F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]*+(?:([^\x20\x09-\x0D])[^\x20\x09-\x0D]*+)?", "$1")).cast("long")


def units_of(docs: DataFrame) -> DataFrame:
    """(source, doc_id, h, size, m) of each distinct (doc_id, source, text); m: its rows. h is the text's hash."""
    t = C.text_of(docs)
    rows = docs.select(docs["source"].cast("string").alias("source"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(t).alias("h"), n_words(t).alias("size"))
    return rows.groupBy("source", "doc_id", "h").agg(F.max("size").alias("size"), F.count("*").alias("m"))


def targets(units: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, n, source_size, target): a row a source.

    Weights follow code point order, null last, and repeat. What a source can't take beyond limit times its size is shared again by weight: in
    ascending order of limit * size / weight, sources are full up to the first whose share of what is left fits.
    """
    per = units.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("m")).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns(
        {
            "pos": F.row_number().over(order),
            "level": (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    open_ = F.min(F.when(F.col("cap") > F.col("w") * F.col("level"), F.struct("pos", "level"))).over(whole)
    per = per.withColumn("open", open_)
    target = F.when(F.col("open").isNull() | (F.col("pos") < F.col("open.pos")), F.col("cap")).otherwise(F.col("w") * F.col("open.level"))
    return per.select("source", "n", "source_size", target.alias("target"))


def flight(size: np.ndarray, weight: np.ndarray, pi: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Round pi to 0 or 1, holding sum(weight * pi) and sum(weight * size * pi); two stay open at most."""
    out, todo, window, k = pi.astype(float), [int(i) for i in np.flatnonzero((pi > 0) & (pi < 1))][::-1], [], 0
    a, b = weight.astype(float), (weight * size).astype(float)
    while True:
        while len(window) < 3 and todo:
            window.append(todo.pop())
        if len(window) < 3:
            return out
        i, j, l = window
        u = [a[j] * b[l] - a[l] * b[j], a[l] * b[i] - a[i] * b[l], a[i] * b[j] - a[j] * b[i]]
        if not any(u):  # the three are alike: any pair of them balances
            u = [a[j], -a[i], 0.0]
        up = min((1 - out[x] if v > 0 else out[x]) / abs(v) for x, v in zip(window, u) if v)
        down = min((out[x] if v > 0 else 1 - out[x]) / abs(v) for x, v in zip(window, u) if v)
        step = up if draws[k % len(draws)] * (up + down) < down else -down
        k += 1
        for x, v in zip(window, u):
            y = out[x] + step * v
            out[x] = 0.0 if y < 1e-9 else 1.0 if y > 1 - 1e-9 else y
        window = [x for x in window if 0 < out[x] < 1]


def flight_of_longest(words: np.ndarray, count: np.ndarray, pi: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """As flight, for one block: the longest open document moves against all others; both totals are held, and with two others or one, words alone."""
    out, k = pi.astype(float), 0
    a, b = count.astype(float), words.astype(float)
    while True:
        open_ = np.flatnonzero((out > 0) & (out < 1))
        if len(open_) < 3:
            return out
        i = open_[np.argmax(b[open_])]
        rest = open_[open_ != i]
        v = out[rest] * (1 - out[rest])
        s = [[(v * a[rest] * x).sum() for x in (a[rest], b[rest])], [(v * b[rest] * x).sum() for x in (a[rest], b[rest])]]
        det = s[0][0] * s[1][1] - s[0][1] * s[1][0]
        if det > 1e-9 * s[0][0] * s[1][1]:
            alpha, beta = (-a[i] * s[1][1] + b[i] * s[0][1]) / det, (-b[i] * s[0][0] + a[i] * s[1][0]) / det
        elif s[1][1] > 0:
            alpha, beta = 0.0, -b[i] / s[1][1]
        else:
            alpha, beta = -a[i] / s[0][0], 0.0
        at, u = np.append(i, rest), np.append(1.0, v * (alpha * a[rest] + beta * b[rest]))
        moved = u != 0
        at, u = at[moved], u[moved]
        up = (np.where(u > 0, 1 - out[at], out[at]) / np.abs(u)).min()
        down = (np.where(u > 0, out[at], 1 - out[at]) / np.abs(u)).min()
        step = up if draws[k % len(draws)] * (up + down) < down else -down
        y = out[at] + step * u
        out[at] = np.where(y < 1e-9, 0.0, np.where(y > 1 - 1e-9, 1.0, y))
        k += 1


def landed(words: np.ndarray, pi: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Settle the open ones of pi (two at most) by the joint distribution that keeps both probabilities and the least expected square of words off."""
    out, open_ = pi.copy(), np.flatnonzero((pi > 0) & (pi < 1))
    if len(open_) == 1:
        out[open_] = draws[0] < pi[open_[0]]
    elif len(open_) == 2:
        p, q = pi[open_]
        off = lambda x, y: (words[open_[0]] * (x - p) + words[open_[1]] * (y - q)) ** 2
        together = off(1, 1) + off(0, 0) < off(1, 0) + off(0, 1)
        both = min(p, q) if together else max(0.0, p + q - 1)
        at = int(np.searchsorted(np.cumsum([both, p - both, q - both]), draws[0], "right"))
        out[open_] = [(1, 1), (1, 0), (0, 1), (0, 0)][at]
    return out


def _fly(level: int):
    def fly(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "doc_id", "h"], ascending=[False, True, True], kind="stable")
        draws = np.random.default_rng(zlib.crc32(repr((key[0], level, int(key[1]))).encode())).random(2 * len(block) + 4)
        size, m, pi, land = block["size"].to_numpy(), block["m"].to_numpy(), block["pi"].to_numpy(), bool((block["blocks"] == 1).all())
        words = m * size
        if land:
            block["pi"] = landed(words, flight_of_longest(words, m, pi, draws[:-2]), draws[-2:])
        else:
            block["pi"] = flight(size, m, pi, draws)
        return block.drop(columns="block")

    return fly


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, doc_id, h, size, m, source_size, target, copies): a row each distinct document; copies is 0 to limit."""
    units = C.cut(units_of(docs))
    per = C.cut(targets(units, weights, share, limit))
    f = F.least(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0), F.lit(float(limit)))
    near = F.abs(f - F.round(f)) < 1e-9
    f = F.when(near, F.round(f)).otherwise(f)
    named = per.select(F.col("source").alias("of"), "n", "source_size", "target")
    rows = units.join(named, F.col("source").eqNullSafe(F.col("of"))).withColumn("f", f)
    blocks = F.ceil(F.col("n") / BLOCK)
    rows = rows.select("source", "doc_id", "h", "size", "m", "source_size", "target", F.floor("f").alias("base"), blocks.alias("blocks"), (F.col("f") - F.floor("f")).alias("pi"))
    most, level, settled, is_open = math.ceil((per.agg(F.max("n")).first()[0] or 0) / BLOCK), 0, [], (F.col("pi") > 0) & (F.col("pi") < 1)
    while True:
        own = F.pmod(F.xxhash64("doc_id", "h", F.lit(level)), F.col("blocks"))
        rows = C.cut(rows.withColumn("block", own).groupBy("source", "block").applyInPandas(_fly(level), UNIT))
        settled.append(rows.filter(~is_open))
        if most <= 1:
            break
        rows, most, level = rows.filter(is_open).withColumn("blocks", F.ceil(F.col("blocks") * 2 / BLOCK)), math.ceil(most * 2 / BLOCK), level + 1
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out.withColumn("copies", F.col("base") + F.col("pi").cast("long")).drop("base", "blocks", "pi")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; columns of any names pass through."""
    t = C.text_of(docs)
    key = {"source": docs["source"].cast("string"), "doc_id": docs["doc_id"].cast("long"), "h": F.xxhash64(t)}
    rows = docs.select(F.struct(*docs.columns).alias("row"), *(c.alias(name) for name, c in key.items()))
    taken = mix(docs).filter("copies > 0").select(*(F.col(c).alias(f"of_{c}") for c in key), "copies")
    joined = rows.join(taken, F.col("h") == F.col("of_h")).filter(F.col("source").eqNullSafe(F.col("of_source")) & F.col("doc_id").eqNullSafe(F.col("of_doc_id")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op8_mixing_sources(spark, sf_dir: str) -> DataFrame:
    df = mix(C.table(spark, sf_dir, "documents"))
    df = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return df.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
