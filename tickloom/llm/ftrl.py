"""Text quality by a logistic regression of hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import discard, join_ids, slices, stage, texts, worker_state

#: Most labelled documents that are used for fitting; up to half of them have the rarer label.
SAMPLE = 20_000
#: Weights, longest word n-gram, passes over the sample, and rows of a part; parts are passed over side by side.
WEIGHTS, LONGEST, PASSES, PART_ROWS = 1 << 18, 2, 5, 5_000
#: Learning rate and its offset, and both penalties, of the updates.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.02
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: A word beside itself also counts by its shape: every letter one class, every digit another.
_SHAPE = bytes(
    97 if chr(c).isalpha() and c < 128 or c >= 128 else 48 if 48 <= c < 58 else c for c in range(256)
)


def _code(word: bytes) -> tuple[int, int]:
    """Hash of a word, and of its shape with equal neighbours taken as one."""
    shape = word.translate(_SHAPE)
    short = bytes(c for i, c in enumerate(shape) if i == 0 or c != shape[i - 1])
    return zlib.crc32(word) | len(word) << 32, zlib.crc32(short, 1) | 1 << 60


def features(text: bytes, longest: int = LONGEST, known: dict[bytes, tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and values of the n-grams of a whole text, words and shapes alike.

    Words are lower-cased (A-Z) and end at ASCII white space. An n-gram found k times counts 1 + ln k; values have length 1.
    """
    known = {} if known is None else known
    codes = []
    for w in text.lower().split():
        c = known.get(w)
        if c is None:
            c = known[w] = _code(w)
        codes.append(c)
    if not codes:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    grams = []
    for column in np.array(codes, np.uint64).T:
        h = column * _A
        for n in range(1, longest + 1):
            if n > 1:
                if len(column) < n:
                    break
                h = (h[:-1] * _B) ^ (column[n - 1 :] * _A)
            grams.append((h ^ (h >> np.uint64(29))) * _B >> np.uint64(64 - (WEIGHTS.bit_length() - 1)))
    # A word after itself, whichever it is, is a bigram of its own.
    words = np.array(codes, np.uint64)[:, 0]
    grams.append(np.zeros(int((words[1:] == words[:-1]).sum()), np.uint64))
    at, n = np.unique(np.concatenate(grams).astype(np.int32), return_counts=True)
    value = 1 + np.log(n)
    return at, (value / np.sqrt(value @ value)).astype(np.float32)


@dataclass
class State:
    """Sums of adjusted gradients ``z`` and of squared gradients ``n``; the last place is the bias."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def new(cls) -> State:
        return cls(np.zeros(WEIGHTS + 1), np.zeros(WEIGHTS + 1))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The leader: closed-form minimum of the linearised losses with both penalties."""
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, value: np.ndarray, label: float, weight: float) -> None:
        at, value = np.append(at, WEIGHTS), np.append(value, 1.0)
        w = self.weights(at)
        g = weight * (_sigmoid(w @ value) - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def held_out(id_col: str) -> Column:
    """True for the ids that are kept for a check: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[DataFrame, str, float]:
    """Staged ``part, luck, label, at, value`` of ``sample`` labelled documents at most, its path, and the share of label 1.

    Ids are taken in the order of a hash; up to half of the sample has the rarer label. Held-out ids teach nothing.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label")).where(~held_out("doc_id"))
    # Labels without a document teach nothing either.
    marks = marks.join(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id")), "doc_id", "left_semi")
    marks, path = stage(marks.withColumn("luck", F.xxhash64("doc_id")), "ftrl-labels")
    sizes = {r.label: r.n for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rare = 0 if sizes.get(0, 0) <= sizes.get(1, 0) else 1
    some = min(sizes.get(rare, 0), sample // 2)
    drawn = [marks.where(f"label = {k}").orderBy("luck", "doc_id").limit(n) for k, n in ((rare, some), (1 - rare, sample - some))]
    chosen, chosen_path = stage(drawn[0].unionByName(drawn[1]), "ftrl-sample")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            pairs = [features(t) for t in texts(b, "text")]
            cols = [b.column("luck"), b.column("label"), pa.array([a for a, _ in pairs], pa.list_(pa.int32())), pa.array([v for _, v in pairs], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["luck", "label", "at", "value"])

    body = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = join_ids(body, chosen, "doc_id", "inner").select("luck", "label", "text").mapInArrow(hashed, "luck long, label int, at array<int>, value array<float>")
    n = sum(sizes.values())
    parts = -(-min(n, sample) // PART_ROWS)
    rows, rows_path = stage(rows.withColumn("part", F.pmod("luck", F.lit(max(1, parts))).cast("int")), "ftrl-rows")
    discard(docs.sparkSession, path, chosen_path)
    return rows, rows_path, sizes.get(1, 0) / n if n else 0.0


def fit(rows: DataFrame, share: float, passes: int = PASSES) -> np.ndarray:
    """Weights fitted on ``part, luck, label, at, value``; ``share`` is the share of label 1 that probabilities hold for.

    In each pass every part is gone through in the order of ``luck`` by a task of its own, from the same state; the
    states of all parts are averaged then. A state has ``2 * WEIGHTS`` numbers, whatever the size of the corpus.
    """
    spark = rows.sparkSession
    drawn = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones"), F.max("part").alias("last")).first()
    mean = (drawn.ones or 0) / max(1, drawn.n)
    weight = (1.0, 1.0) if mean in (0.0, 1.0) else ((1 - share) / (1 - mean), share / mean)
    dealt = rows.repartition((drawn.last or 0) + 1, "part").sortWithinPartitions("part", "luck")
    state = State.new()
    for _ in range(passes):
        sent = spark.sparkContext.broadcast((state.z, state.n))

        def learn(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            part, own = None, None

            def close() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([own.z.tobytes()]), pa.array([own.n.tobytes()])], names=["z", "n"])

            for b in batches:
                for p, y, at, value in zip(*(b.column(c).to_pylist() for c in ("part", "label")), b.column("at"), b.column("value"), strict=True):
                    if p != part:
                        if own is not None:
                            yield close()
                        part, own = p, State(sent.value[0].copy(), sent.value[1].copy())
                    own.update(np.array(at.values), np.array(value.values, float), y, weight[int(y)])
            if own is not None:
                yield close()

        got = dealt.mapInArrow(learn, "z binary, n binary").collect()  # a state for each part, of which SAMPLE and PART_ROWS allow four
        sent.unpersist()
        if not got:
            break
        state = State(*(np.mean([np.frombuffer(r[c]) for r in got], axis=0) for c in ("z", "n")))
    return state.weights()


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; other columns are not read.

    The score is the probability of label 1, a sparse dot product of the n-grams of the whole text. Null and empty texts and
    texts of white space have the bias alone. Repeated rows get equal results; a null id is not held out; an empty table
    gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)


    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        known = worker_state("ftrl-words", dict)
        for b in slices(batches, "text"):
            logits = []
            for t in texts(b, "text"):
                at, value = features(t, known=known)
                logits.append(w[-1] + float(w[at] @ value))
                if len(known) > 500_000:
                    known.clear()
            s = _sigmoid(np.array(logits))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    flat = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return flat.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled documents that are not held out and ``score`` all of them. Without any label all scores are 0.5."""
    rows, path, share = training_rows(docs, labels)
    weights = fit(rows, share)
    discard(docs.sparkSession, path)
    return score(docs, weights)
