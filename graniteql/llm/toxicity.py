"""Operator 10: toxicity by a linear-chain conditional random field over words.

Token labels come from document labels: words that documents labelled toxic have significantly more often than others
(a likelihood ratio) are tagged toxic where they stand in such a document, and so are rarer words of a significant group
of words that begin alike, if their posterior share is over one half; all other words are not. A chain with two tags is
trained on sentences with those tags; a word's features are itself, its first and last letters and its length, so that
inflections of a word count too. Forward-backward marginals give each word's probability of being toxic; a document's
score is a calibrated function of the probability that it has a toxic word and of the expected number and share of them;
runs of words over one half are the offending spans.

The fit takes a bounded sample of labelled documents (see `labelled`). All words of every text are tagged.

Defined cases: a null text is an empty one; a text without words gets the score of a document with no toxic word and has
no span; a very long text is tagged in parts that end where sentences end (a run over a cut within a sentence of over
PART characters is two spans); without labels of both classes the score is the smoothed share of label 1 (0.5 without
any label) and there are no spans; ties do not arise; repeated rows get equal scores; an empty table gives no rows;
extra columns take no part, and those named as the results are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graniteql.llm import labelled
from graniteql.llm.common import groups, plainly, ship
from graniteql.llm.pretokens import Known
from graniteql.llm.quality import _sigmoid

#: A word, or the end of a sentence, at which the chain starts anew.
TOKEN = re.compile(r"[^\W\d_]+|[.?\n]")
ENDS, END, BLANK = frozenset(".?\n"), re.compile(r"[.?\n]"), re.compile(r"\s")
PART = 500_000
HASHED, MOST_WORDS, LIKELY = 1 << 18, 20_000, 0.5
#: Letters of a word that tell its group; how many documents the group's share counts for.
STEM, PRIOR = 6, 2
#: Words of sentences that enter the fit of the chain, at most half of them from sentences with a word to be tagged;
#: words known to a worker at once.
TRAINED, REMEMBERED = 600_000, 100_000


def lowered(text: str) -> str:
    """The text in lower case, as long as it was: of all letters only one becomes two, and is replaced first."""
    return text.replace("\u0130", "i").lower()


def features(word: str) -> list[int]:
    """Places of a word's features in the weights."""
    names = ("w" + word, "p" + word[:4], "q" + word[:6], "s" + word[-4:], f"l{min(len(word), 12)}", "b")
    return [zlib.crc32(n.encode()) % HASHED for n in names]


class Chain:
    """Two tags; a word's score for the toxic tag, 0 for the other; transitions; a start."""

    def __init__(self):
        self.weights, self.trans, self.start = np.zeros(HASHED), np.zeros((2, 2)), np.zeros(2)
        self.calibration, self.constant, self.shift = np.zeros(5), None, 0.0
        self._ready = False

    def __getstate__(self):
        kept = np.flatnonzero(self.weights)
        return {"kept": kept, "values": self.weights[kept], "trans": self.trans, "start": self.start, "calibration": self.calibration, "constant": self.constant, "shift": self.shift}

    def __setstate__(self, state):
        self.__init__()
        self.weights[state["kept"]] = state["values"]
        for k in ("trans", "start", "calibration", "constant", "shift"):
            setattr(self, k, state[k])

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The probability of the toxic tag, for chains one after another. All chains take a step together, longest
        first, so that a step is one operation over those that are not yet over."""
        if not len(scores):
            return np.zeros(0)
        forward, backward = self._messages(scores, lengths)
        return _sigmoid(forward + backward)

    def _messages(self, scores, lengths):
        """Log-odds: forward with the word's own score, backward without."""
        t, start = self.trans, self.start
        order = np.argsort(-lengths, kind="stable")
        begins = (np.cumsum(lengths) - lengths)[order]
        n = lengths[order]
        active = len(n) - np.searchsorted(n[::-1], np.arange(n[0] if len(n) else 0), "right")  # chains with a word at each step
        forward, backward = np.zeros(len(scores)), np.zeros(len(scores))
        m = start[1] - start[0] + scores[begins[: active[0]]] if len(active) else None
        for i, k in enumerate(active):
            if i:
                m = m[:k]
                m = scores[begins[:k] + i] + np.logaddexp(m + t[1, 1], t[0, 1]) - np.logaddexp(m + t[1, 0], t[0, 0])
            forward[begins[:k] + i] = m
        b = np.zeros(0)
        for i in range(len(active) - 1, -1, -1):
            k = active[i]
            if i < len(active) - 1:
                nxt = scores[begins[: len(b)] + i + 1] + b
                b = np.logaddexp(nxt + t[1, 1], t[1, 0]) - np.logaddexp(nxt + t[0, 1], t[0, 0])
            b = np.concatenate([b, np.zeros(k - len(b))])  # chains that end here
            backward[begins[:k] + i] = b
        return forward, backward

    # -- fit ---------------------------------------------------------------------------------------------------

    def _fit_chain(self, rows: np.ndarray, words: np.ndarray, lengths: np.ndarray, tags: np.ndarray, epochs: int = 50, rate: float = 1.0, decay: float = 1e-3) -> None:
        """rows: each known word's features; words: the sentences' words. Full gradient steps on the conditional
        likelihood (Adagrad)."""
        begins = np.cumsum(lengths) - lengths
        inner = np.ones(len(tags), bool)
        inner[begins] = False
        at = np.flatnonzero(inner)
        used, local = np.unique(rows, return_inverse=True)
        local = local.reshape(rows.shape)
        w = np.zeros(len(used))
        g2w, g2t, g2s = np.full(len(used), 1e-3), np.full((2, 2), 1e-3), np.full(2, 1e-3)
        real = np.zeros((2, 2))
        np.add.at(real, (tags[at - 1], tags[at]), 1)
        first = np.bincount(tags[begins], minlength=2).astype(float)
        self.trans = np.log((real + 0.1) / (real + 0.1).sum(1, keepdims=True))  # tags alone; then all is learned together
        self.start = np.log((first + 0.1) / (first + 0.1).sum())
        for _ in range(epochs):
            scores = w[local].sum(1)[words]
            f, b = self._messages(scores, lengths)
            p = _sigmoid(f + b)
            off = np.bincount(words, tags - p, len(rows))
            gw = np.bincount(local.ravel(), np.repeat(off, local.shape[1]), len(w)) - decay * w
            # pair marginals, from the messages around each step
            logs = np.stack([self.trans[i, j] + i * f[at - 1] + j * (scores[at] + b[at]) for i in (0, 1) for j in (0, 1)])
            logs -= logs.max(0)
            pairs = np.exp(logs)
            pairs /= pairs.sum(0)
            gt = real - pairs.sum(1).reshape(2, 2)
            gs = first - np.array([(1 - p[begins]).sum(), p[begins].sum()])
            for x, g, g2 in ((w, gw, g2w), (self.trans, gt, g2t), (self.start, gs, g2s)):
                g2 += g**2
                x += rate * g / np.sqrt(g2)
        self.weights[:] = 0
        self.weights[used] = w

    def fit(self, rows: list[tuple[str, int]]) -> Chain:
        y = np.array([r[1] for r in rows])
        if len(set(y.tolist())) < 2:
            self.constant = float((y.sum() + 1) / (len(y) + 2))
            return self
        marked = toxic_words(rows)
        number: dict[str, int] = {}
        telling: list[tuple[np.ndarray, np.ndarray]] = []
        plain: list[tuple[np.ndarray, np.ndarray]] = []
        for text, label in rows:
            part: list[str] = []
            for w in (*TOKEN.findall(lowered(text)), "."):
                if w not in ENDS:
                    part.append(w)
                elif part:
                    told = np.array([x in marked for x in part])
                    words = np.array([number.setdefault(x, len(number)) for x in part], np.int32)
                    (telling if told.any() else plain).append((words, told & (label == 1)))
                    part = []
        sentences = _thinned(telling, TRAINED // 2)
        sentences += _thinned(plain, TRAINED - sum(len(s[0]) for s in sentences))
        if sentences:
            words, tags = np.concatenate([s[0] for s in sentences]), np.concatenate([s[1] for s in sentences]).astype(np.int64)
            kept, words = np.unique(words, return_inverse=True)
            every = list(number)
            self._fit_chain(np.array([features(every[i]) for i in kept.tolist()], np.int64), words, np.array([len(s[0]) for s in sentences]), tags)
        del sentences, telling, plain, number
        x = np.concatenate([self.summaries([t for t, _ in rows[i : i + 100]]) for i in range(0, len(rows), 100)])
        self.calibration = _logistic(x, y)
        return self

    # -- use ---------------------------------------------------------------------------------------------------

    def ready(self) -> Chain:
        if not self._ready:
            self.known = Known(REMEMBERED, lambda w: float(self.weights[features(w)].sum()))
            self._ready = True
        return self

    def word_scores(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.ready().known.__getitem__, words), float, len(words))

    def tagged(self, tokens: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Of several documents' tokens, one after another: each token's marginal (0 for ends), and how many each has."""
        counts = np.array([len(t) for t in tokens], np.int64)
        flat = [w for t in tokens for w in t]
        end = np.fromiter((w in ENDS for w in flat), bool, len(flat))
        p = np.zeros(len(flat))
        words = np.flatnonzero(~end)
        if len(words):
            border = np.zeros(len(flat) + 1, bool)  # a chain starts at a document and after an end
            border[np.cumsum(counts) - counts] = True
            border[1:] |= end
            chain = np.cumsum(border[:-1])[words]
            lengths = np.diff(np.flatnonzero(np.r_[True, chain[1:] != chain[:-1], True]))
            p[words] = self.marginals(self.word_scores([flat[i] for i in words]) if end.any() else self.word_scores(flat), lengths)
        return p, counts

    def summaries(self, texts: list[str], spans: list[list[tuple[int, int, float]]] | None = None) -> np.ndarray:
        """Of each text: log-odds of its surest word and of having a toxic word at all; logarithms of the expected
        number of toxic words among the likely ones and of their share. To spans, if given, a list is added for each
        text of its runs of toxic words: start, end, highest marginal."""
        found: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        sums, most = np.zeros((len(texts), 3)), np.zeros(len(texts))
        part: list[list[str]] = []
        owner: list[tuple[int, str, int]] = []  # of each part: its text's number, itself, where it starts

        def add() -> None:
            p, counts = self.tagged(part)
            doc = np.repeat(np.array([o[0] for o in owner], np.int64), counts)
            for k, v in enumerate((np.log1p(-np.minimum(p, 1 - 1e-9)), np.where(p > LIKELY, p, 0), np.ones(len(p)))):
                sums[:, k] += np.bincount(doc, v, len(texts))
            np.maximum.at(most, doc, p)
            if spans is not None and (p > 0.5).any():
                ends = np.cumsum(counts)
                for i in np.unique(np.searchsorted(ends, np.flatnonzero(p > 0.5), "right")).tolist():
                    number, text, at = owner[i]
                    found[number] += _runs(text, p[ends[i] - counts[i] : ends[i]], at)
            part.clear()
            owner.clear()

        for i, text in enumerate(texts):
            at = 0
            for piece in sentences_of(lowered(text)):
                part.append(TOKEN.findall(piece))
                owner.append((i, piece, at))
                at += len(piece)
                if sum(map(len, part)) > 200_000:
                    add()
        add()
        if spans is not None:
            spans += found
        none, likely, counts = sums.T
        some = -np.expm1(np.minimum(none, -1e-6))
        top = np.clip(most, 1e-6, 1 - 1e-6)
        return np.stack([np.log(top / (1 - top)) / 4, (np.log(some) - np.maximum(none, -14)) / 4, np.log1p(likely), np.log((likely + 0.1) / (counts + 5))], 1)

    def scores(self, texts: list[str], spans: list | None = None) -> np.ndarray:
        """The score of each text; spans as in summaries()."""
        if self.constant is not None or not texts:
            if spans is not None:
                spans += [[] for _ in texts]
            return np.full(len(texts), self.constant if self.constant is not None else 0.5)
        return _sigmoid(self.summaries(texts, spans) @ self.calibration[:-1] + self.calibration[-1] + self.shift)

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        """Runs of toxic words of a text: start, end, highest marginal."""
        found: list[list[tuple[int, int, float]]] = []
        self.scores([text], found)
        return found[0]


def _runs(text: str, p: np.ndarray, at: int) -> list[tuple[int, int, float]]:
    """Runs of words over one half in a lowered text that starts at a place. p: of its tokens."""
    out: list[tuple[int, int, float]] = []
    previous = -2
    for i, m in enumerate(TOKEN.finditer(text)):
        if (q := float(p[i])) > 0.5:
            if i == previous + 1:
                out[-1] = (out[-1][0], at + m.end(), max(out[-1][2], q))
            else:
                out.append((at + m.start(), at + m.end(), q))
            previous = i
    return out


def sentences_of(text: str) -> Iterator[str]:
    """A text in parts of about PART characters that end where sentences end; a sentence longer than that is cut at a
    blank, or nowhere if it has none."""
    at = 0
    while len(text) - at > 2 * PART:
        found = END.search(text, at + PART, at + 2 * PART) or BLANK.search(text, at + PART)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


def _thinned(sentences: list, words: int) -> list:
    """Evenly spaced ones of the sentences, of about so many words."""
    total = sum(len(s[0]) for s in sentences)
    return sentences[:: max(1, -(-total // max(1, words)))]


def toxic_words(rows: list[tuple[str, int]]) -> set[str]:
    """Words of which at least half of the documents are toxic, and so many that the likelihood ratio against the
    general share of toxic documents exceeds the number of words tested: about one is expected by chance. Also words
    that are too rare for that but begin as words of a group do (STEM letters) that passes the test as a whole, if the
    posterior share with the group's as its prior, worth PRIOR documents, is over one half. At most MOST_WORDS of
    them, the surest first. rows: text, label."""
    counts = {True: (Counter(), Counter()), False: (Counter(), Counter())}  # of words, of their stems: every, toxic
    for text, label in rows:
        words = set(TOKEN.findall(lowered(text))) - ENDS
        for kind, found in ((False, words), (True, {w[:STEM] for w in words})):
            counts[kind][0].update(found)
            if label:
                counts[kind][1].update(found)
    share = sum(r[1] for r in rows) / len(rows)

    def tested(every: Counter, toxic: Counter) -> dict[str, float]:
        bound, out = np.log(sum(n >= 3 for n in every.values()) or 1), {}
        for w, a in toxic.items():
            n = every[w]
            if a >= 3 and a / n > max(0.5, share):
                ratio = a * np.log(a / n / share) + ((n - a) * np.log((n - a) / n / (1 - share)) if a < n else 0)
                if ratio > bound:
                    out[w] = ratio
        return out

    every, toxic = counts[False]
    found, stems = tested(every, toxic), tested(*counts[True])
    for w, a in toxic.items():
        if w not in found and (ratio := stems.get(w[:STEM])) and (a + PRIOR * counts[True][1][w[:STEM]] / counts[True][0][w[:STEM]]) / (every[w] + PRIOR) > 0.5:
            found[w] = ratio / len(w)
    return {w for _, w in sorted(((r, w) for w, r in found.items()), reverse=True)[:MOST_WORDS]}


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1.0) -> np.ndarray:
    """Weights and a constant, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        g = x.T @ (p - y) + ridge * np.r_[w[:-1], 0]
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Chain:
    rows = labelled.sample(docs, labels, label)
    model = Chain().fit(rows)
    model.shift = labelled.shift(labels, label, rows)
    return model


def scored(docs: DataFrame, model: Chain, name: str = "score", spans: str | None = None) -> DataFrame:
    """Adds the score of the column text and, if named, its offending spans; columns of those names are replaced."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = [name] + [spans] * bool(spans)
    fields = [f.name for f in docs.schema.fields if f.name not in new]
    schema = docs.select(*fields).withColumn(name, F.lit(0.0))
    if spans:
        schema = schema.withColumn(spans, F.array().cast("array<struct<start:int,end:int,score:double>>"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            scores, runs = [np.zeros(0)], [] if spans else None
            for part in groups(batch.column("text"), 500_000):
                scores.append(shared.value.scores(part, runs))
            columns = [*(batch.column(k) for k in fields), pa.array(np.concatenate(scores))]
            if spans:
                columns.append(pa.array([[dict(zip(("start", "end", "score"), s, strict=True)) for s in x] for x in runs], kind))
            yield pa.RecordBatch.from_arrays(columns, names=[*fields, *new])

    return docs.mapInArrow(run, schema.schema)


def predictions(docs: DataFrame, model: Chain, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, and spans: start, end and highest marginal of the offending runs of words, in
    characters of the text."""
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model, spans="spans")
    return out.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "spans")


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows whose score stays below the threshold, with their columns. labels: doc_id, toxic."""
    docs, names = plainly(docs, "doc_id", "text")
    return scored(docs, fitted(docs, labels), "__toxicity").where(F.col("__toxicity") < threshold).drop("__toxicity").toDF(*names)
