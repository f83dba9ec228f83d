"""Quality by histogram gradient-boosted trees over document statistics.

Each whole text is reduced to the statistics named in FEATURES. Trees of one
depth are grown level by level from histograms of gradients over quantile bins,
each new tree on the logistic loss left by those before. The trees are flattened
into arrays, a row a tree, in which the children of node i are 2i + 1 and 2i + 2,
so that all rows walk down a tree together in numpy.

Scale: one pass over the texts makes a narrow table of statistics, kept in the
shared folder; fitting takes from it the rows of a bounded sample (`limit`
labelled documents); scoring is a pass over it with a model of a few kilobytes.

Cases: null and empty texts have zero statistics and a score as any other;
without labels of both kinds every score is the labels' mean, or 0.5 without
any; repeated rows score alike; an empty table gives no rows; texts of any
length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import cut, slices

FEATURES = (
    "log_bytes", "log_words", "bytes_per_word", "longest_word", "distinct_words", "repeated_neighbours", "distinct_lines",
    "lines_per_word", "upper", "lower", "digits", "high_bytes", "spaces", "hash_star", "dollar_percent_amp", "angle_pipe", "stops",
    "commas", "exclaims", "quotes_brackets", "dashes_slashes_at", "other_ascii", "capital_words", "ended_lines",
)
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", None, " \t\r\v\f", "#*", "$%&", "<>|", ".?:;", ",", "!", "\"'()[]{}", "-_/\\@", "^`~+=")
BINS, DEPTH, TREES, RATE, RIDGE, LEAST = 64, 4, 80, 0.15, 1.0, 5.0


def byte_classes() -> np.ndarray:
    out = np.full(256, len(CLASSES))
    for k, chars in enumerate(CLASSES):
        if chars is None:
            out[128:] = k
        else:
            out[[ord(c) for c in chars]] = k
    return out


BYTE_CLASS = byte_classes()


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, size = max(1, len(words)), max(1, len(raw))
    kinds = np.bincount(BYTE_CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=len(CLASSES) + 1)[: len(CLASSES)] / size
    distinct = set(words)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), len(raw) / n, np.log1p(max(map(len, distinct), default=0)), len(distinct) / n,
        sum(map(eq, words, words[1:])) / n, len(set(lines)) / max(1, len(lines)), len(lines) / n, *kinds.tolist(),
        sum(map(bytes.istitle, words)) / n, sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / max(1, len(lines)),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """__doc and __x (FEATURES) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, ["__doc", "__text"], text="__text"):
            rows = np.array([statistics(t) for t in part["__text"]], np.float32)
            x = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(part["__doc"], pa.int64()), x], names=["__doc", "__x"])

    named = docs.select(F.col(id_col).cast("long").alias("__doc"), F.col(text).alias("__text"))
    return named.mapInArrow(run, "__doc long, __x array<float>")


@dataclass
class Forest:
    """Tree t's node i sends rows whose feature[t, i] is above threshold[t, i] to
    2i + 2, others to 2i + 1; leaf holds the values of the last level."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Trees for labels y (0 or 1) of the rows of x."""
    inner = 2**DEPTH - 1
    if len(y) == 0 or y.min() == y.max():
        mean = (y.sum() + 0.5) / (len(y) + 1)
        return Forest(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), float(np.log(mean / (1 - mean))))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    start = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(len(y), start)
    features, thresholds, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, threshold, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, n = 2**level - 1, 2**level
            at = node - first
            gain = np.full((n, len(edges), BINS), -np.inf)
            for f, b in enumerate(binned):
                gs = np.cumsum(np.bincount(at * BINS + b, g, n * BINS).reshape(n, BINS), 1)
                hs = np.cumsum(np.bincount(at * BINS + b, h, n * BINS).reshape(n, BINS), 1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                fit_ = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
                fit_[(hs < LEAST) | (ht - hs < LEAST)] = -np.inf
                gain[:, f] = fit_
                gain[:, f, len(edges[f]) :] = -np.inf
            best = gain.reshape(n, -1).argmax(1)
            for i, (k, value) in enumerate(zip(best, gain.reshape(n, -1).max(1))):
                if value > 1e-6:
                    feature[first + i], threshold[first + i] = k // BINS, edges[k // BINS][k % BINS]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - inner
        gs, hs = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
        leaf = -RATE * gs / (hs + RIDGE)
        total += leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Forest(np.array(features), np.array(thresholds), np.array(leaves), start)


def fit_on(statistics_: DataFrame, training: DataFrame) -> Forest:
    """A forest of the training rows (__doc, __label; few: they are broadcast)."""
    rows = statistics_.join(F.broadcast(training.withColumnRenamed("__doc", "__known")), F.col("__doc") == F.col("__known")).select("__doc", "__x", "__label").toPandas()
    rows = rows.sort_values("__doc", kind="stable").drop_duplicates("__doc")
    x = np.stack(rows["__x"].to_numpy()) if len(rows) else np.zeros((0, len(FEATURES)), np.float32)
    return fit(x.astype(np.float32), rows["__label"].to_numpy(np.float64))


def score(statistics_: DataFrame, forest: Forest) -> DataFrame:
    """__doc and score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("__x").flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("__doc"), pa.array(forest.scores(x))], names=["__doc", "score"])

    return statistics_.mapInArrow(run, "__doc long, score double")


def quality_scores(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col and score of each row of docs, by a forest of the training rows."""
    made = cut(document_statistics(docs, id_col, text))
    return score(made, fit_on(made, training)).withColumnRenamed("__doc", id_col)


def kept_documents(docs: DataFrame, training: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that score `threshold` or more, as they are.

    The forest is fitted on the training rows among docs; then each text is scored
    where it is, and no text moves between machines."""
    known = training.select(F.col("__doc").alias("__known"))
    sample = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text).alias("__text"))
    sample = sample.join(F.broadcast(known), F.col("__id") == F.col("__known"), "left_semi")
    forest = fit_on(document_statistics(sample, "__id", "__text"), training)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(forest.scores(np.array([statistics(t) for t in texts], np.float32).reshape(-1, len(FEATURES))))

    return docs.withColumn("__score", scored(F.col(text))).where(F.col("__score") >= threshold).drop("__score")
