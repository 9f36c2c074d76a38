"""Toxicity by a classifier chain."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import discard, fresh, stage, texts

#: Categories in chain order; each is 0/1 in the table of labels or derived by ``derive`` below.
CATEGORIES = ("toxic_junk", "toxic_prose", "toxic")
#: Most labelled documents that are used for fitting, words that become inputs, and folds.
SAMPLE, INPUTS, FOLDS = 3_000, 256, 5
#: An input is so many times as frequent in toxic texts as in others, at least.
RATIO = 9
_LETTERS = re.compile(r"[^\W\d_]+")
#: Besides whole words, beginnings of so many letters are inputs, marked by a caret.
BEGINNINGS = (4, 5, 6, 7)


@dataclass(frozen=True)
class Chain:
    """Fitted chain: input words, and per category the weights of words, earlier probabilities and bias."""

    words: tuple[str, ...]
    weights: tuple[np.ndarray, ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (rows, categories) for 0/1 inputs."""
        out = np.zeros((len(x), len(self.weights)))
        for k, w in enumerate(self.weights):
            out[:, k] = _sigmoid(np.hstack([x, out[:, :k], np.ones((len(x), 1))]) @ w)
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _words(text: str) -> set[str]:
    return {w for t in set(text.lower().split()) for w in _LETTERS.findall(t)}


def _features(word: str) -> list[str]:
    return [word, *("^" + word[:k] for k in BEGINNINGS if len(word) > k)]


def _all_features(words: set[str]) -> set[str]:
    return {f for w in words for f in _features(w)}


def _fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01, steps: int = 25) -> np.ndarray:
    """Logistic regression of weighted rows with a ridge on all but the bias, by Newton steps."""
    w = np.zeros(x.shape[1])
    if y.min() == y.max():  # only one class: a constant
        w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return w
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + penalty * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_chain(rows: list[tuple[set[str], tuple[int, ...]]], inputs: int = INPUTS, folds: int = FOLDS, share: float | None = None) -> Chain:
    """Fit on ``(words, categories)`` rows; the last category chooses the input words.

    ``share`` is the share of the last category among all documents, if rows of it were drawn more often than others: rows are
    weighted such that probabilities hold for that share.

    Words and beginnings are ranked by the likelihood ratio of being in a text of the category. A later model sees
    an earlier category's probability as it is out of fold, so that it learns how far to trust it.
    """
    y = np.array([r[1] for r in rows], float).reshape(len(rows), -1)
    target = y[:, -1] > 0
    pos, neg = Counter(), Counter()
    for (ws, _), t in zip(rows, target, strict=True):
        (pos if t else neg).update(_all_features(ws))
    n1, n0 = max(1, int(target.sum())), max(1, int((~target).sum()))

    def gain(w: str) -> float:
        a, b = pos[w], neg[w]
        p, q, m = a / n1, b / n0, (a + b) / (n1 + n0)
        if a < 5 or p < RATIO * q:  # too rare, or usual in clean texts as well
            return 0.0
        g = a * np.log(p / m) + (b * np.log(q / m) if b else 0.0)
        g += (n1 - a) * np.log((1 - p) / (1 - m)) if a < n1 else 0.0
        return 2 * (g + ((n0 - b) * np.log((1 - q) / (1 - m)) if b < n0 else 0.0))

    # 15 is beyond what any of a hundred thousand chance words reaches often.
    ranked = sorted(((gain(w), w) for w in pos), key=lambda t: (-t[0], t[1]))
    words = tuple(w for g, w in ranked[:inputs] if g > 15)
    at = {w: i for i, w in enumerate(words)}
    x = np.zeros((len(rows), len(words)))
    for i, (ws, _) in enumerate(rows):
        x[i, [at[w] for w in _all_features(ws) if w in at]] = 1
    fold = np.arange(len(rows)) % folds
    weight = np.ones(len(rows))
    if share is not None and 0 < target.sum() < len(rows):
        weight = np.where(target, share / target.mean(), (1 - share) / (1 - target.mean()))
    weights, earlier = [], np.zeros((len(rows), 0))
    for k in range(y.shape[1]):
        z = np.hstack([x, earlier, np.ones((len(rows), 1))])
        held = np.zeros(len(rows))
        for f in range(folds):
            inside = fold != f
            if inside.any() and (~inside).any():
                held[~inside] = _sigmoid(z[~inside] @ _fit_linear(z[inside], y[inside, k], weight[inside]))
        weights.append(_fit_linear(z, y[:, k], weight))
        earlier = np.hstack([earlier, held[:, None]])
    return Chain(words, tuple(weights))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[tuple[set[str], tuple[int, ...]]], float]:
    """At most ``sample`` labelled documents, one per distinct text, and the share of toxic labels among all.

    Up to half of them are toxic, the others clean, both in the order of a hash of their id, so that all of few toxic
    labels are used. Categories: toxic text of low quality, toxic text of good quality, toxic. The distinct words are
    made on the executors.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"), F.min("quality").cast("int").alias("quality"))
    marks = marks.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")  # labels without a document teach nothing
    marks, path = stage(marks, "toxicity-labels")
    sizes = marks.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("toxic") > 0, 1)).alias("toxic")).first()
    some = min(sizes.toxic, sample // 2)
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = marks.where("toxic > 0").orderBy(*order).limit(some).unionByName(marks.where("toxic <= 0").orderBy(*order).limit(sample - some))
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [sorted(_words(t.decode())) for t in texts(b, "text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "toxic", "quality")), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "toxic", "quality", "words"])

    joined = body.join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    got = joined.select("doc_id", "toxic", "quality", "text").mapInArrow(reduce, "doc_id long, toxic int, quality int, words array<string>").collect()
    out, seen = [], set()
    for r in sorted(got, key=lambda r: (r.doc_id, r.words)):
        key = frozenset(r.words)
        if key not in seen:
            seen.add(key)
            t = int(r.toxic > 0)
            out.append((set(r.words), (int(t and r.quality == 0), int(t and r.quality != 0), t)))
    discard(docs.sparkSession, path)
    return out, sizes.toxic / max(1, sizes.n)


def score_toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Category probabilities and the verdict on the last category; all input columns stay.

    Adds ``p_<category>`` doubles and ``toxic_rejected``; input columns of these names keep theirs, and
    the new ones get an underscore. Case does not matter; a word is a run of letters. Null, empty
    and letterless texts have no inputs and are judged by the biases, which means not toxic. Repeated
    rows get equal results; an empty table gives an empty result.
    """
    names = fresh(docs.columns, *[f"p_{c}" for c in CATEGORIES], "toxic_rejected")
    at = {w: i for i, w in enumerate(chain.words)}
    # Plain names inside: those of the input may hold dots.
    plain = [f"c{i}" for i in range(len(docs.columns))]
    given = docs.toDF(*plain)
    body = plain[[c.lower() for c in docs.columns].index(text_col.lower())]
    schema = T.StructType(list(given.schema.fields))
    for i in range(len(names) - 1):
        schema = schema.add(f"p{i}", "double")
    schema = schema.add("rejected", "boolean")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for b in batches:
            x = np.zeros((b.num_rows, len(at)))
            for i, t in enumerate(texts(b, body)):
                for w in set(t.decode().lower().split()):
                    hit = known.get(w)
                    if hit is None:
                        hit = known[w] = tuple(at[f] for p in _LETTERS.findall(w) for f in _features(p) if f in at)
                    if hit:
                        x[i, list(hit)] = 1
                if len(known) > 300_000:
                    known.clear()
            p = chain.scores(x)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= threshold)], names=schema.names)

    return given.mapInArrow(judge, schema).toDF(*docs.columns, *names)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled documents and score all of them (see ``score_toxicity``).

    Without any toxic label nothing is rejected.
    """
    rows, share = training_rows(docs, labels)
    chain = fit_chain(rows, share=share) if rows else Chain((), tuple(np.array([0.0] * k + [-20.0]) for k in range(len(CATEGORIES))))
    return score_toxicity(docs, chain)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that ``toxicity`` does not reject, with the columns of the input, whatever their names."""
    verdict = fresh(docs.columns, *[f"p_{c}" for c in CATEGORIES], "toxic_rejected")[-1]
    return toxicity(docs, labels).where(~F.col(verdict)).select(*[F.col(f"`{c}`") for c in docs.columns])
