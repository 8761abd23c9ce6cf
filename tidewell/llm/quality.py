"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk towards the pooled one and towards a scaled identity; the score is the
logistic of the difference of the two log densities (Mahalanobis distances through cached Cholesky factors) plus the log
prior odds, calibrated on the labelled rows by a logistic of one slope and one shift. Moments are summed per partition and by Spark, so fitting takes one pass and any number of labelled rows.

Defined cases: null texts count as empty and are scored like any other; label rows with a null label or id are left out,
repeated label rows count each; with one class only, or none, every score is that class's prior (0.5 without labels);
other columns of either table are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_mod, saved, table
from .words import slices, word_hashes

NAMES = ("log_words", "word_length", "distinct_words", "top_word", "repeats", "upper", "symbols", "exclaims", "bars", "digits", "lines", "stops", "distinct_lines")


def _kinds() -> dict[str, np.ndarray]:
    def of(chars: str) -> np.ndarray:
        mask = np.zeros(256, bool)
        mask[list(chars.encode())] = True
        return mask

    upper, lower = of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), of("abcdefghijklmnopqrstuvwxyz")
    return {"upper": upper, "letter": upper | lower, "symbol": of("#$%&*+/<=>@[\\]^_`{}~"), "exclaim": of("!"), "bar": of("|"), "digit": of("0123456789"), "line": of("\n"), "stop": of(".?"), "space": of(" \t\n\v\f\r")}


KINDS = _kinds()


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of NAMES for each document buf[offsets[i]:offsets[i+1]]."""
    def count(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets]).astype(float)

    n = np.diff(offsets).astype(float)
    of = {k: count(v[buf]) for k, v in KINDS.items()}
    words, at = word_hashes(buf, offsets)
    nw = np.diff(at).astype(float)
    again = np.concatenate([[False], words[1:] == words[:-1]])[:len(words)]
    again[at[:-1][nw > 0]] = False  # a document's first word repeats none of the document before
    same = np.concatenate([[0], np.cumsum(again)])
    repeats = (same[at[1:]] - same[at[:-1]]).astype(float)
    distinct, top, lines = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    for i in range(len(n)):
        if at[i + 1] > at[i]:
            c = np.unique(words[at[i]:at[i + 1]], return_counts=True)[1]
            distinct[i], top[i] = len(c), c.max()
        found = buf[offsets[i]:offsets[i + 1]].tobytes().split(b"\n")
        lines[i] = math.log((len(set(found)) + 4) / (len(found) + 4))
    w = np.maximum(nw, 1)

    def share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.log((x + 0.5) / (of + 10) + 0.01)

    return np.column_stack([
        np.log1p(nw), np.log1p((n - of["space"]) / w), np.log((distinct + 1) / (np.sqrt(nw) + 1)), share(top, nw), share(repeats, nw),
        share(of["upper"], of["letter"]), share(of["symbol"], nw), share(of["exclaim"], nw), share(of["bar"], nw), share(of["digit"], nw),
        share(of["line"], nw), share(of["stop"], nw), lines,
    ])


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats array<double>): a narrow map."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in slices(batch.column(1)):
                x = statistics(buf, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(list(x), pa.list_(pa.float64()))], ["id", "stats"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, stats array<double>")


@dataclass
class Quadratic:
    """Fitted classes 0 and 1: prior, mean, inverse Cholesky factor, log determinant; None where a class has no rows. ``slope`` and ``shift`` calibrate the log odds."""

    classes: tuple
    slope: float = 1.0
    shift: float = 0.0

    @property
    def whole(self) -> bool:
        return all(c is not None for c in self.classes)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for prior, mean, root, logdet in self.classes:
            d = (x - mean) @ root.T
            logs.append(math.log(prior) - 0.5 * (logdet + np.einsum("ij,ij->i", d, d)))
        return logs[1] - logs[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.whole:
            have = [c is not None for c in self.classes]
            return np.full(len(x), float(have[1]) if any(have) else 0.5)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.log_odds(x) + self.shift, -700, 700)))


def platt(bins: list[tuple[float, int, float]]) -> tuple[float, float]:
    """Slope and shift of a logistic over (log odds, label, count), a little ridge keeping separable classes finite."""
    z, y, n = (np.array(c, float) for c in zip(*bins, strict=True))
    w = n / n.sum()
    scale = max(1e-9, math.sqrt(float((w * z * z).sum())))
    a = np.column_stack([z / scale, np.ones(len(z))])
    beta = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -500, 500)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(2), a.T @ (w * (y - p)) - 1e-4 * beta)
        beta = beta + step * min(1.0, 2 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(labelled: DataFrame, to_pooled: float = 0.05, to_identity: float = 0.2) -> Quadratic:
    """From rows (label 0 or 1, stats): one sum per moment reaches the driver."""
    d = len(NAMES)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + len(upper[0])))
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).flatten()).reshape(-1, d)
                label = np.asarray(batch.column(0))
                for c in (0, 1):
                    y = x[label == c]
                    sums[c] += np.concatenate([[len(y)], y.sum(0), (y.T @ y)[upper]])
        for c in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([c] * sums.shape[1], pa.int32()), pa.array(range(sums.shape[1]), pa.int32()), pa.array(sums[c])], ["label", "i", "v"])

    got = np.zeros((2, 1 + d + len(upper[0])))
    for r in labelled.select(F.col("label").cast("int"), "stats").mapInArrow(run, "label int, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).collect():
        got[r["label"], r["i"]] = r["v"]
    n, out, scatter = got[:, 0], [], []
    for c in (0, 1):
        mean = got[c, 1:1 + d] / max(n[c], 1)
        s = np.zeros((d, d))
        s[upper] = got[c, 1 + d:]
        s = s + np.triu(s, 1).T
        scatter.append((mean, s - n[c] * np.outer(mean, mean)))
    pooled = (scatter[0][1] + scatter[1][1]) / max(n.sum(), 1)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    for c in (0, 1):
        if not n[c]:
            out.append(None)
            continue
        own = (1 - to_pooled) * scatter[c][1] / n[c] + to_pooled * pooled
        own = own / np.outer(scale, scale)
        own = (1 - to_identity) * own + to_identity * np.trace(own) / d * np.eye(d) + 1e-9 * np.eye(d)
        root = np.linalg.cholesky(own)
        logdet = 2 * (np.log(np.diag(root)).sum() + np.log(scale).sum())
        out.append((n[c] / n.sum(), scatter[c][0], np.linalg.inv(root) / scale, logdet))
    model = Quadratic(tuple(out))
    if model.whole:
        step = 0.5  # bins of the log odds, 801 a class at most
        z = F.round(F.least(F.greatest(_log_odds(model, "stats"), F.lit(-200.0)), F.lit(200.0)) / step) * step
        model.slope, model.shift = platt([(r["z"], r["label"], r["n"]) for r in labelled.select(F.col("label").cast("int").alias("label"), z.alias("z")).groupBy("label", "z").agg(F.count(F.lit(1)).alias("n")).collect()])
    return model


def _log_odds(model: Quadratic, stats: Column | str) -> Column:
    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(model.log_odds(np.array(s.tolist(), float).reshape(-1, len(NAMES))))

    return run(stats)


def score(model: Quadratic, stats: Column | str) -> Column:
    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array(s.tolist(), float).reshape(-1, len(NAMES))))

    return run(stats)


def text_score(model: Quadratic, text: Column | str) -> Column:
    """The score of a text column, for filters that keep whole rows."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        found = [model.scores(statistics(buf, offsets)) for _, _, buf, offsets in slices(pa.array(s, pa.string()))]
        return pd.Series(np.concatenate(found) if found else np.zeros(0))

    return run(text)


def classified(docs: DataFrame, labels: DataFrame, name: str = "quality", at_least: float = 0.3, folds: int = 5) -> tuple[DataFrame, Quadratic]:
    """(doc_id, held_out, score, predicted) for every document, learnt from labelled rows outside the held-out fold."""
    stats = saved(with_statistics(docs), "stats")
    known = labels.select("doc_id", F.col(name).alias("label")).where(F.col("label").isin(0, 1))
    model = fit(stats.where(fold_mod("doc_id", folds) != 0).join(known, "doc_id"))
    out = stats.select("doc_id", (fold_mod("doc_id", folds) == 0).alias("held_out"), score(model, "stats").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= at_least).cast("int")), model


def op6_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]
