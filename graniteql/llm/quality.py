"""Operator 4: a quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE characters. A passage's features are shares of pairs of neighbouring
character classes and shares of characters that recur at short distances. An encoder turns them into a vector; a
gated attention (a tanh layer times a sigmoid layer) weighs the passages; the weighted sum gives the score. Encoder,
attention and output are learned together from document labels alone, by gradient descent on the driver, from a
bounded sample of the labelled documents (see `labelled`). Every passage of every text is scored.

Defined cases: a null text is an empty one; an empty text is a bag of one empty passage and gets a score too; a very long
text's passages are encoded some at a time, with the same result; without labels of both classes the score is the smoothed
share of label 1 (0.5 without any label); repeated rows get equal scores; an empty table gives no rows; extra columns take
no part, and one named as the result is replaced.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniteql.llm import labelled
from graniteql.llm.common import groups, plainly, ship

PASSAGE, LAGS, HIDDEN, ATTENTION = 512, (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16), 24, 16
#: Characters that are turned into code points at once.
AT_ONCE = PASSAGE * 1024
N = 14
FEATURES = N * N + len(LAGS) + 2


@lru_cache(1)
def _classes() -> np.ndarray:
    """A class for each code point; those beyond the table are of class 13."""
    out = np.full(0x3000, 13, np.uint8)
    for i in range(len(out)):
        c = chr(i)
        kind = unicodedata.category(c)
        out[i] = 0 if c == "\n" else 1 if c.isspace() else 2 if kind == "Lu" and i < 128 else 3 if kind == "Lu" else 4 if kind[0] == "L" and i < 128 else 5 if kind[0] == "L" else 6 if kind[0] == "N" else 7 if c == "." else 8 if c == "," else 9 if c in "!?" else 10 if c in "'\"-:;()" else 11 if c in "#$%&*+<=>@\\^_`{|}~/[]" else 12 if kind[0] in "PS" else 13
    return out


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and how many each text has."""
    counts = np.array([max(1, -(-len(t) // PASSAGE)) for t in texts], np.int64)
    out = np.zeros((counts.sum(), FEATURES), np.float32)
    at, part, starts, length = 0, [], [], 0

    def flush() -> None:
        nonlocal part, length, at
        if not part:
            return
        x = np.frombuffer("".join(p for p, _ in part).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.concatenate([np.minimum(PASSAGE, len(p) - np.arange(0, max(1, len(p)), PASSAGE)) for p, _ in part])
        where = np.concatenate([np.arange(first, first + max(1, -(-len(p) // PASSAGE))) for p, first in part])
        which = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        f = np.zeros((len(sizes), FEATURES), np.float32)
        n = np.maximum(sizes, 1)[:, None]
        if len(x):
            kind = _classes()[np.minimum(x, 0x2FFF)].astype(np.int64)
            later = inside[1:] > 0
            pair = (which[1:] * (N * N) + kind[:-1] * N + kind[1:])[later]
            f[:, : N * N] = np.sqrt(np.bincount(pair, minlength=len(sizes) * N * N).reshape(-1, N * N) / n)
            for k, lag in enumerate(LAGS):
                same = np.flatnonzero(x[lag:] == x[:-lag]) + lag if len(x) > lag else np.zeros(0, np.int64)
                same = same[inside[same] >= lag]
                f[:, N * N + k] = np.bincount(which[same], minlength=len(sizes)) / n[:, 0]
        f[:, -2] = sizes / PASSAGE
        f[:, -1] = sizes == 0
        out[where] = f
        part, length = [], 0

    for t, c in zip(texts, counts, strict=True):
        for i in range(0, max(1, len(t)), AT_ONCE):
            piece = t[i : i + AT_ONCE]
            part.append((piece, at + i // PASSAGE))
            length += len(piece)
            if length >= AT_ONCE:
                flush()
        at += int(c)
    flush()
    return out, counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Gated attention over the passages of a document."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float64)
        self.p = {"W": draw(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION), "c": draw(HIDDEN), "d": np.zeros(1)}
        self.mean, self.scale, self.constant, self.shift = np.zeros(FEATURES), np.ones(FEATURES), None, 0.0

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.p, np.cumsum(counts) - counts
        h = np.tanh(((x - self.mean) / self.scale) @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (v * u) @ p["w"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), counts))
        a = s / np.repeat(np.add.reduceat(s, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"h": h, "v": v, "u": u, "a": a, "z": z, "logit": z @ p["c"] + p["d"][0], "starts": starts}

    def scores(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each document's score, and its passages' attention."""
        if not texts:
            return np.zeros(0), []
        x, counts = passages(texts)
        if self.constant is not None:
            return np.full(len(texts), self.constant), np.split(1 / np.repeat(counts, counts), np.cumsum(counts)[:-1])
        f = self.forward(x, counts)
        return _sigmoid(f["logit"] + self.shift), np.split(f["a"], f["starts"][1:])

    def fit(self, rows: list[tuple[str, int]], epochs: int = 10, batch: int = 64, rate: float = 4e-3, decay: float = 1e-4) -> Model:
        y = np.array([r[1] for r in rows], float)
        if len(set(y.tolist())) < 2:
            self.constant = float((y.sum() + 1) / (len(y) + 2))
            return self
        x, counts = passages([r[0] for r in rows])
        self.mean, self.scale = x.mean(0).astype(float), x.std(0).astype(float) + 1e-2
        ends = np.cumsum(counts)
        rng, step = np.random.default_rng(5), 0
        m, v2 = {k: np.zeros_like(w) for k, w in self.p.items()}, {k: np.zeros_like(w) for k, w in self.p.items()}
        steps = epochs * -(-len(y) // batch)
        for _ in range(epochs):
            for rows_at in np.array_split(rng.permutation(len(y)), -(-len(y) // batch)):
                step += 1
                c = counts[rows_at]
                at = np.concatenate([np.arange(ends[i] - counts[i], ends[i]) for i in rows_at])
                g = self._gradient(x[at], c, y[rows_at])
                now = rate * 0.5 * (1 + np.cos(np.pi * step / steps))
                for k, w in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v2[k] = 0.999 * v2[k] + 0.001 * g[k] ** 2
                    w -= now * (m[k] / (1 - 0.9**step) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8) + decay * w)
        return self

    def _gradient(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, counts)
        h, a, v, u = f["h"], f["a"], f["v"], f["u"]
        error = (_sigmoid(f["logit"]) - y) / len(y)
        dz = np.repeat(error[:, None] * p["c"], counts, axis=0)
        da = (dz * h).sum(1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, f["starts"]), counts))
        dv, du = ds[:, None] * u * p["w"] * (1 - v**2), ds[:, None] * v * p["w"] * u * (1 - u)
        dh = (a[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - h**2)
        return {"W": ((x - self.mean) / self.scale).T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ ds, "c": f["z"].T @ error, "d": np.array([error.sum()])}


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    rows = labelled.sample(docs, labels, label)
    model = Model().fit(rows)
    model.shift = labelled.shift(labels, label, rows)
    return model


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Adds the score of the column text; a column of that name is replaced."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f.name for f in docs.schema.fields if f.name != name]

    def run(batches):
        for batch in batches:
            scores = [shared.value.scores(part)[0] for part in groups(batch.column("text"), AT_ONCE)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in fields), pa.array(np.concatenate([np.zeros(0), *scores]))], names=[*fields, name])

    return docs.mapInArrow(run, docs.select(*fields).withColumn(name, F.lit(0.0)).schema)


def predictions(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows whose score reaches the threshold, with their columns. labels: doc_id, quality."""
    docs, names = plainly(docs, "doc_id", "text")
    return scored(docs, fitted(docs, labels), "__quality").where(F.col("__quality") >= threshold).drop("__quality").toDF(*names)
