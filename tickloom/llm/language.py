"""Language of words in mixed text by a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import slices, texts
from tickloom.llm.wordbpe import Codes

#: Most documents and words per training chain that are used for fitting, steps, and hashed features.
SAMPLE, CHAIN, STEPS, BATCH, FEATURES = 1_500, 160, 80, 384, 1 << 15
#: Words per language in the lexicons.
LEXICON = 300
#: Distinct words whose scores a Python worker remembers, and chains that are summed over at once.
WORDS, TOGETHER = 200_000, 16_384
_LETTERS = re.compile(r"[^\W\d_]+")


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of marked words (``^word$``, so affixes as well) and the word of each."""
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    grams, owners = [], []
    for n in (2, 3, 4):
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint64(n))
        for j in range(n):
            h = (h ^ codes[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = owner[:m] == owner[n - 1 :]
        grams.append((h[inside] % np.uint64(FEATURES)).astype(np.int64))
        owners.append(owner[:m][inside])
    return np.concatenate(grams), np.concatenate(owners)


def _clean(token: str) -> str:
    """Letters of a word, in lower case; empty if it has none."""
    return "".join(c for w in _LETTERS.findall(token.lower()) for c in (w if w.isalpha() else filter(str.isalpha, w)))


@dataclass
class Chain:
    """Labels, feature weights, transition weights and the lexicon (word to languages)."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    lexicon: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Features of cleaned words, lexicon entries among them, and the word of each."""
        grams, owners = _features(words)
        extra = [(FEATURES + k, i) for i, w in enumerate(words) for k in self.lexicon.get(w, ())]
        if extra:
            grams, owners = np.append(grams, [x for x, _ in extra]), np.append(owners, [i for _, i in extra])
        return grams, owners

    def scores(self, words: list[str]) -> np.ndarray:
        """Score of each label for cleaned words; a word without letters scores nothing."""
        if not words or not self.labels:
            return np.zeros((len(words), len(self.labels)))
        grams, owners = self.inputs(words)
        table = np.stack([np.bincount(owners, self.weights[grams, j], len(words)) for j in range(len(self.labels))], axis=1)
        table[[i for i, w in enumerate(words) if not w]] = 0
        return table


def posteriors(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Label probabilities of every word by forward-backward, chains side by side.

    ``scores`` holds the chains' words one after the other; chains must come longest first.
    """
    n, k = scores.shape
    starts = np.cumsum(lengths) - lengths
    up = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(moves)
    ahead, back = np.empty((n, k)), np.empty((n, k))
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # chains longer than t
    last = None
    for t in range(longest):
        rows = starts[: active[t]] + t
        a = up[rows] if last is None else (last[: active[t]] @ step) * up[rows]
        last = a / a.sum(axis=1, keepdims=True)
        ahead[rows] = last
    b = np.ones((0, k))
    for t in range(longest - 1, -1, -1):
        rows = starts[: active[t]] + t
        new = np.ones((active[t], k))
        if len(b):
            new[: len(b)] = b
        back[rows] = new
        b = (new * up[rows]) @ step.T
        b /= b.sum(axis=1, keepdims=True)
    p = ahead * back
    return p / p.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, str]], seed: int = 1) -> Chain:
    """Fit on ``(text, language)`` rows.

    Two lines of different documents make one chain, so that texts that change language are learned
    from, transitions included. Weights follow the gradient of the log-likelihood (observed less
    expected counts), by Adam over batches of chains.
    """
    labels = sorted({lang for _, lang in rows})
    k, rng = len(labels), np.random.default_rng(seed)
    counts = [Counter() for _ in labels]
    lines: list[tuple[list[str], int]] = []
    for text, lang in rows:
        y = labels.index(lang)
        for line in text.split("\n"):
            words = [w for w in map(_clean, line.split()) if w]
            counts[y].update(words)
            lines += [(words[i : i + CHAIN // 2], y) for i in range(0, len(words), CHAIN // 2)]
    lexicon: dict[str, list[int]] = {}
    for y, c in enumerate(counts):
        for w, _ in c.most_common(LEXICON):
            lexicon.setdefault(w, []).append(y)
    model = Chain(labels, np.zeros((FEATURES + k, k)), np.zeros((k, k)), {w: tuple(v) for w, v in lexicon.items()})
    if k < 2 or not lines:
        return model
    # Languages alike in the batches, whatever their shares.
    by = [[i for i, (_, y) in enumerate(lines) if y == label] for label in range(k)]
    by = [b for b in by if b]
    m, v = [np.zeros_like(model.weights), np.zeros_like(model.moves)], [np.zeros_like(model.weights), np.zeros_like(model.moves)]
    for step in range(1, STEPS + 1):
        chains = []
        for _ in range(BATCH):
            (wa, ya), (wb, yb) = (lines[b[rng.integers(len(b))]] for b in (by[rng.integers(len(by))], by[rng.integers(len(by))]))
            chains.append((wa + wb, [ya] * len(wa) + [yb] * len(wb)))
        chains.sort(key=lambda c: -len(c[0]))
        lengths = np.array([len(c[0]) for c in chains])
        codes: dict[str, int] = {}
        at = np.array([codes.setdefault(w, len(codes)) for c in chains for w in c[0]])
        y = np.concatenate([c[1] for c in chains])
        grams, owners = model.inputs(list(codes))
        emit = np.stack([np.bincount(owners, model.weights[grams, j], len(codes)) for j in range(k)], axis=1)
        p = posteriors(emit[at], lengths, model.moves)
        gap = -p
        gap[np.arange(len(y)), y] += 1
        per_word = np.stack([np.bincount(at, gap[:, j], len(codes)) for j in range(k)], axis=1)
        g0 = np.stack([np.bincount(grams, per_word[owners, j], FEATURES + k) for j in range(k)], axis=1)
        g0 = g0 / len(y) - 1e-6 * model.weights
        ends = np.cumsum(lengths)
        inner = np.ones(len(y), bool)
        inner[ends - 1] = False
        i = np.flatnonzero(inner)
        seen = np.zeros((k, k))
        np.add.at(seen, (y[i], y[i + 1]), 1)
        joint = p[i][:, :, None] * np.exp(model.moves)[None] * (p[i + 1] / np.maximum(p[i] @ np.exp(model.moves), 1e-12))[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        g1 = (seen - joint.sum(axis=0)) / len(y)
        for j, (w, g) in enumerate(((model.weights, g0), (model.moves, g1))):
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.99 * v[j] + 0.01 * g * g
            w += 0.1 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-9)
    return model


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[str, str]]:
    """Equally many labelled texts per language, at most ``sample`` (or one per language if there are more languages).

    Of each language the texts with the least hashes, none of them held out; equal texts of a language count once. A
    language with fewer texts than its share gives all of them.
    """
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null").where(~held_out())
    luck = F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 30))
    drawn = labelled.select("text", "lang", luck.alias("luck"))
    shares = {r.lang: r.n for r in drawn.groupBy("lang").agg(F.approx_count_distinct("luck", 0.02).alias("n")).collect()}  # one row per language
    if not shares:
        return []
    each = max(1, sample // len(shares))
    # So many per language that chance and the rounding of the counts hardly ever leave less than ``each``.
    drawn_each = 1.1 * each + 6 * each**0.5 + 20
    most = F.element_at(F.create_map(*[F.lit(x) for lang, n in shares.items() for x in (lang, min(1.0, drawn_each / max(1, n)) * (1 << 30))]), F.col("lang"))
    got = drawn.where(F.col("luck") < most).distinct().collect()
    taken, out = Counter(), []
    for r in sorted(got, key=lambda r: (r.luck, r.lang, r.text)):
        if taken[r.lang] < each:
            taken[r.lang] += 1
            out.append((r.text, r.lang))
    return out


def predict(docs: DataFrame, model: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every text; words are labelled along each line of it.

    Result, one row per input row: ``doc_id``, ``lang_pred`` (a learned language, or ``und`` if text is
    null or has no letter), ``score`` (mean probability of that language over the words with letters;
    0 for ``und``), ``shares`` (that mean for every language). Repeated rows get equal results; ties go to the
    language first in order; very long texts are read whole; an empty table gives an empty result;
    other columns are not looked at. Without any training row all texts are ``und``.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    labels = np.array([*model.labels, "und"], dtype=object)
    k = len(model.labels)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        table, lettered = np.zeros((0, k)), np.zeros(0, bool)
        for b in slices(batches, "text", 4 << 20):
            if len(numbers) > WORDS:
                numbers, table, lettered = {}, np.zeros((0, k)), np.zeros(0, bool)
            first = len(numbers)
            number = Codes(numbers)
            chains = [(np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)), i) for i, t in enumerate(texts(b, "text")) for line in t.decode().split("\n") if (ws := line.split())]
            numbers = number
            new = [_clean(w) for w in islice(number, first, None)]
            table, lettered = np.vstack([table, model.scores(new)]), np.append(lettered, np.array([bool(w) for w in new], bool))
            total, many = np.zeros((b.num_rows, k)), np.zeros(b.num_rows)
            chains.sort(key=lambda c: -len(c[0]))
            for lo in range(0, len(chains) if k else 0, TOGETHER):
                part = chains[lo : lo + TOGETHER]
                lengths = np.array([len(c[0]) for c in part])
                words, owner = np.concatenate([c[0] for c in part]), np.array([c[1] for c in part])
                cut = np.cumsum(lengths) - lengths
                p = posteriors(table[words], lengths, model.moves) * lettered[words][:, None]
                np.add.at(total, owner, np.add.reduceat(p, cut, axis=0))
                np.add.at(many, owner, np.add.reduceat(lettered[words].astype(float), cut))
            shares = total / np.maximum(many, 1)[:, None]
            best = np.where(many > 0, shares.argmax(axis=1) if k else 0, k)
            score = np.where(many > 0, shares.max(axis=1) if k else 0.0, 0.0)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(labels[best].tolist(), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(shares.tolist(), pa.list_(pa.float64()))], names=["id", "lang_pred", "score", "shares"])

    return src.mapInArrow(label, "id long, lang_pred string, score double, shares array<double>").withColumnRenamed("id", id_col)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out (crc32 of the id, modulo 4, is not 2) and label all."""
    rows = training_rows(docs)
    out = predict(docs, fit(rows))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "shares")
