"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed n-grams (``ORDERS`` code points, lower case, a blank at both ends) that it holds. From a training
sample, the log-count ratio r of a feature compares the shares of toxic and other texts that hold it; the features that tell the classes
apart (G statistic at least ``LEAST_G``) go on, each with the value r where present, and a logistic regression weighs them. A text of any length is
scored whole. ``KEPT`` bounds the model: of more such features the best are taken, so that the fit's rows (``SAMPLE`` texts of at most ``KEPT`` numbers,
in practice a few hundred) fit the driver, which reads them as one flat array a slice at a time.

The training sample is bounded: at most ``SAMPLE`` labelled rows, those with the least hash of doc_id. Its ids are all that is broadcast
besides the weights; n-gram counts add up in chunks over tasks. A doc_id labelled twice counts as toxic if any label says so; null labels are
no labels. Null text counts as empty; an empty text scores what the intercept says. Without labels every score is 1/3.
Repeated rows score alike, an empty table gives an empty one, and columns named like the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ORDERS, BITS, CHUNK, KEPT, SAMPLE, SLICE = (3, 4, 5, 6), 20, 1 << 14, 8192, 20_000, 1000
STEPS, RATE, RIDGE = 120, 0.03, 3e-3
#: Features under this G statistic are noise (8 is p = 0.005 for one feature).
LEAST_G = 8.0


def ngrams(text: str | None) -> np.ndarray:
    """Hashed n-grams of a text, with repeats."""
    chars = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    rolling, out = np.zeros(len(chars), np.uint64), [np.zeros(0, np.int32)]
    for n in range(1, min(max(ORDERS), len(chars)) + 1):
        rolling = rolling[: len(chars) - n + 1] * np.uint64(1000003) + chars[n - 1 :]
        if n in ORDERS:
            out.append(((rolling * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out)


def _count(batches):
    """Texts by class that hold each feature, in chunks of features; chunk -1 has the numbers of texts."""
    held, texts = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            held[int(toxic)][np.unique(ngrams(text))] += 1
            texts[int(toxic)] += 1
    if texts.sum():
        at = range(0, 1 << BITS, CHUNK)
        rows = [(-1, texts.tobytes())] + [(i, held[:, i : i + CHUNK].tobytes()) for i in at]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], "int32"), pa.array([r[1] for r in rows], "binary")], ["chunk", "held"])


def _add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"chunk": [key[0]], "held": [sum(np.frombuffer(x, np.int64) for x in rows["held"]).tobytes()]})


def _present(kept: np.ndarray):
    """The positions in kept (ascending) of each text's features."""

    def present(batches):
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                f = np.unique(ngrams(text))
                at = np.minimum(np.searchsorted(kept, f), len(kept) - 1)
                found.append(at[kept[at] == f].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["toxic", "found"])

    return present


def _fit(col: np.ndarray, ends: np.ndarray, toxic: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam steps over the whole sample, read a slice of texts at a time; returns weights (times r) and intercept.

    col: the features of all texts one after another, those of text i from ends[i] to ends[i + 1].
    """
    n = len(ends) - 1
    share = np.where(toxic > 0, np.sqrt((toxic == 0).sum() / max(1, (toxic > 0).sum())), 1.0)  # halfway to balanced classes
    share /= share.sum()
    w = np.zeros(len(r) + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        weight, grad, last = r * w[:-1], np.zeros(len(r)), 0.0
        for lo in range(0, n, SLICE):
            hi = min(n, lo + SLICE)
            own, size = col[ends[lo] : ends[hi]], np.diff(ends[lo : hi + 1])
            total = np.concatenate([[0.0], np.cumsum(weight[own])])
            z = total[ends[lo + 1 : hi + 1] - ends[lo]] - total[ends[lo:hi] - ends[lo]] + w[-1]
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[lo:hi]) * share[lo:hi]
            grad += np.bincount(own, np.repeat(g, size), minlength=len(r))
            last += g.sum()
        grad = np.append(grad * r + RIDGE * w[:-1], last)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:-1] * r, float(w[-1])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """(weight of each hashed n-gram, intercept) from documents (doc_id, text) and labels (doc_id, toxic)."""
    sample = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = C.cut(docs.join(F.broadcast(sample), "doc_id").select(C.text_of(docs).alias("text"), (F.col("toxic") > 0).cast("int").alias("toxic")))  # at most SAMPLE ids
    counted = rows.mapInArrow(_count, "chunk int, held binary").groupBy("chunk").applyInPandas(_add, "chunk int, held binary").collect()
    weights = np.zeros(1 << BITS, np.float32)
    if not counted:
        return weights, float(np.log(0.5))
    held = np.zeros((2, 1 << BITS))
    for c in counted:
        got = np.frombuffer(c["held"], np.int64).reshape(2, -1)
        if c["chunk"] < 0:
            n = got[:, 0].astype(float)
        else:
            held[:, c["chunk"] : c["chunk"] + CHUNK] = got
    r = np.log((held[1] + 1) / (n[1] + 2)) - np.log((held[0] + 1) / (n[0] + 2))
    g, both = np.zeros(1 << BITS), held.sum(axis=0)
    for mine, share in ((held[1], n[1] / n.sum()), (held[0], n[0] / n.sum())):
        own = n.sum() * share
        for seen, expected in ((mine, both * share), (own - mine, (n.sum() - both) * share)):
            g += np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0)
    best = np.argsort(-g, kind="stable")[:KEPT]
    kept = np.sort(best[g[best] >= LEAST_G]).astype(np.int32)
    if not len(kept):
        return weights, float(np.log((n[1] + 0.5) / (n[0] + 1)))
    got = rows.mapInArrow(_present(kept), "toxic int, found array<int>").toArrow()  # at most SAMPLE rows of KEPT features
    toxic, found = got["toxic"].to_numpy().astype(float), got["found"].chunks
    ends = np.cumsum(np.concatenate([[0], *(c.value_lengths().to_numpy(zero_copy_only=False) for c in found)]))
    col = np.concatenate([c.flatten().to_numpy() for c in found])
    del got, found
    w, intercept = _fit(col, ends.astype(np.int64), toxic, r[kept])
    weights[kept] = w
    return weights, intercept


def _score(model):
    def score(batches):
        weights, intercept = model.value
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column("text")):
                f = ngrams(text.as_py())
                scores[i] = weights[np.unique(f[weights[f] != 0])].sum(dtype=float) + intercept
            scores = 1 / (1 + np.exp(-np.clip(scores, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["row", "score", "predicted"])

    return score


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """docs without text, plus score and predicted. The weights broadcast are 4 MB whatever was learnt from."""
    return C.mapped(docs, "text", _score(docs.sparkSession.sparkContext.broadcast(model)), {"score": "double", "predicted": "int"})


def _clean(model):
    def clean(batches):
        weights, intercept = model.value
        for batch in batches:
            keep = []
            for text in batch.column("text"):
                f = ngrams(text.as_py())
                keep.append(bool(weights[np.unique(f[weights[f] != 0])].sum(dtype=float) + intercept < 0))  # a score under 0.5
            yield batch.filter(pa.array(keep, pa.bool_()))

    return clean


def clean(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The rows of docs that score under 0.5, unchanged."""
    return docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(model)), docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    model = train(docs.select("doc_id", "text"), labels.filter(C.crc_bucket("doc_id", 5) != 0).select("doc_id", "toxic"))
    return score(docs.select("doc_id", (C.crc_bucket("doc_id", 5) == 0).alias("held_out"), C.text_of(docs).alias("text")), model)
