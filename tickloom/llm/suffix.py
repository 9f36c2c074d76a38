"""Repeated passages by sparse suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import join_ids, slices, stage, texts
from tickloom.llm.minhash import WORDS, _WordHash

#: Words of a passage, of a minimiser, and minimisers in one window.
PASSAGE, GRAM, WINDOW = 50, 8, 35
#: Words that a suffix surely shares with the other copy of a passage: its minimiser lies among the first
#: WINDOW places. The words before and after these are kept as context.
PREFIX = PASSAGE - WINDOW + 1
BEFORE, AFTER = WINDOW - 1, PASSAGE - PREFIX
#: Suffixes next to each other in sorted order that are compared.
NEIGHBOURS = 4
#: Suffixes of a common prefix that one task compares.
MOST = 50_000

_M = np.uint64(0x9E3779B97F4A7C15)


def _rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    m = len(h) - size + 1
    acc = h[:m].copy()
    for j in range(1, size):
        acc = (acc ^ (acc >> np.uint64(29))) * _M + h[j : j + m]
    acc ^= acc >> np.uint64(32)
    return acc * _M


def minimisers(h: np.ndarray) -> np.ndarray:
    """Places whose GRAM-word hash is the least of some WINDOW places in a row."""
    g = _rolling(h, GRAM)
    if len(g) <= WINDOW:
        return np.array([int(g.argmin())])
    view = np.lib.stride_tricks.sliding_window_view(g, WINDOW)
    return np.unique(np.arange(len(view)) + view.argmin(axis=1))


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's suffixes: hashes of their first words, places, and the short hashes of all words of the text."""
    known = _WordHash()
    for b in batches:
        out: list[tuple] = []
        size = 0

        def emit(out: list[tuple]) -> pa.RecordBatch:
            docs, hashes, places, words = zip(*out, strict=True)
            cuts = pa.array(np.cumsum([0, *map(len, places)]), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(x))) for x in (hashes, places)]
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *lists, pa.array(words, pa.binary())], names=["doc", "h", "place", "words"])

        for doc, t in zip(b.column("id").to_pylist(), texts(b, "text"), strict=True):
            words = t.lower().split()
            if doc is None or len(words) < PASSAGE:
                continue
            if len(known) > WORDS:
                known.clear()
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            at = minimisers(h)
            at = at[at + PREFIX <= len(h)]
            if not len(at):
                continue
            short = np.maximum((h >> np.uint64(48)).astype("<u2"), np.uint16(1))  # 0 is beyond the text
            out.append((doc, _rolling(h, PREFIX)[at].view(np.int64), at.astype(np.int32), short.tobytes()))
            size += len(h)
            if size > 1_000_000:
                yield emit(out)
                out, size = [], 0
        if out:
            yield emit(out)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of short hashes as binary values that sort like them."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(2 * width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows.astype(">u2")))])


def _surroundings(only: np.ndarray | None = None):
    """Suffixes with the words around them, of texts as ``_suffixes`` gives them; equal ones of a text are one row.

    ``only``: sorted hashes of the suffixes that are wanted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "words", 1 << 20):
            n = b.column("place").value_lengths().to_numpy()
            h, place = b.column("h").flatten().to_numpy(), b.column("place").flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), n)
            if only is not None:
                ok = np.flatnonzero(only[np.minimum(np.searchsorted(only, h), len(only) - 1)] == h)
                h, place, row = h[ok], place[ok], row[ok]
            if not len(h):
                continue
            gap = b"\0" * (2 * max(BEFORE, AFTER))
            blobs = b.column("words").to_pylist()
            flat = np.frombuffer(gap + b"".join(x + gap for x in blobs), "<u2")
            sizes = np.array([len(x) + len(gap) for x in blobs]) // 2
            at = (np.cumsum(sizes) - sizes + len(gap) // 2)[row] + place
            left = np.lib.stride_tricks.sliding_window_view(flat, BEFORE)[at - BEFORE][:, ::-1]
            right = np.lib.stride_tricks.sliding_window_view(flat, AFTER)[at + PREFIX]
            same = _growing(_mix(h.view(np.uint64), row.astype(np.uint64), 0), np.concatenate([left, right], axis=1))[-1]
            _, first, group = np.unique(same, return_index=True, return_inverse=True)
            cuts = pa.array(np.cumsum([0, *np.bincount(group)]), pa.int32())
            places = pa.ListArray.from_arrays(cuts, pa.array(place[np.argsort(group, kind="stable")]))
            doc = b.column("doc").to_numpy()[row[first]]
            yield pa.RecordBatch.from_arrays([pa.array(h[first]), _binary(right[first]), _binary(left[first]), pa.array(doc), places], names=["h", "after", "before", "doc", "places"])

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(len(column), width) if width else np.empty((len(column), 0), np.uint16)


def _mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    key = (a * _M) ^ (b + np.uint64(salt))
    return (key ^ (key >> np.uint64(32))) * _M


def _growing(acc: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """Hashes of each row's first 0, 1, ... words, from a start."""
    out = [acc]
    for j in range(words.shape[1]):
        acc = ((acc ^ (acc >> np.uint64(29))) * _M) + words[:, j]
        out.append(acc)
    return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each pair of rows."""
    return np.logical_and.accumulate((a == b) & (a != 0), axis=1).sum(axis=1)


def _compare(h: np.ndarray, right: np.ndarray, left: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words before and after each suffix that it shares with a neighbour, if both make a passage; else -1."""
    n = len(h)
    before, after = np.full(n, -1), np.full(n, -1)
    # Runs of equal suffixes with equal context stand for one suffix, which has one or more documents.
    new = np.ones(n, bool)
    new[1:] = (h[1:] != h[:-1]) | (right[1:] != right[:-1]).any(axis=1) | (left[1:] != left[:-1]).any(axis=1)
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
    b, a = np.full(len(first), -1), np.full(len(first), -1)
    many = low != high
    full_l, full_r = (left[first] != 0).sum(axis=1), (right[first] != 0).sum(axis=1)
    whole = many & (full_l + full_r + PREFIX >= PASSAGE)
    b[whole], a[whole] = full_l[whole], full_r[whole]
    for s in range(1, NEIGHBOURS + 1):
        i = np.flatnonzero(h[first[:-s]] == h[first[s:]]) if len(first) > s else np.empty(0, int)
        i = i[(low[i] != low[i + s]) | many[i] | many[i + s]]
        if len(i):
            x, y = first[i], first[i + s]
            l, r = _common(left[x], left[y]), _common(right[x], right[y])
            good = l + r + PREFIX >= PASSAGE
            for j in (i[good], i[good] + s):
                np.maximum.at(b, j, l[good])
                np.maximum.at(a, j, r[good])
    return b[run], a[run]


def _matches(key: np.ndarray, right: np.ndarray, left: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of whole groups, the least and the greatest number of words ahead at which a row makes a passage; -1 if none.

    A passage takes some words from the row's right and as many from its left as are missing; it is one if a second document
    of the group, by key, has the same words.
    """
    n, width = right.shape
    least, most = np.full(n, -1), np.full(n, -1)
    ahead, behind = _growing(key.view(np.uint64), right), _growing(np.zeros(n, np.uint64), left)
    n_right, n_left = ((m != 0).sum(axis=1) for m in (right, left))  # 0 is only beyond the text
    for j in range(width + 1):
        ok = np.flatnonzero((n_right >= j) & (n_left >= width - j))
        if not len(ok):
            continue
        k = _mix(ahead[j][ok], behind[width - j][ok], j)
        order = np.argsort(k, kind="stable")
        k, ok = k[order], ok[order]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        two = np.minimum.reduceat(lo[ok], first) < np.maximum.reduceat(hi[ok], first)
        hit = ok[np.repeat(two, np.diff(np.append(first, len(k))))]
        most[hit] = j
        least[hit[least[hit] < 0]] = j
    return least, most


def _spans(doc: np.ndarray, places: pa.Array, before: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
    """Spans at all places of each row, as far as the words before and after its suffix."""
    row = np.repeat(np.arange(len(doc)), places.value_lengths().to_numpy())
    place = places.flatten().to_numpy()
    return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array((place - before[row]).astype(np.int32)), pa.array((place + PREFIX + after[row]).astype(np.int32))], names=["doc", "start", "stop"])


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups; rows come sorted by group."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        cut = len(k)
        while cut and k[cut - 1] == k[-1]:
            cut -= 1
        if kept and kept[-1].column(key)[-1].as_py() == k[0]:
            if not cut:  # one group, which goes on
                kept.append(b)
                continue
        elif kept:
            yield pa.concat_batches(kept)
            kept = []
        if cut:
            yield pa.concat_batches([*kept, b.slice(0, cut)])
        kept = [b.slice(cut)]
    if kept:
        yield pa.concat_batches(kept)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of sorted suffixes: neighbours are compared, and where more suffixes share a prefix, every split of a passage."""
    for b in _groups(batches, "h"):
        h, doc = b.column("h").to_numpy(), b.column("doc").to_numpy()
        right, left = _matrix(b.column("after"), AFTER), _matrix(b.column("before"), BEFORE)
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        n = np.diff(np.append(first, len(h)))
        few = np.repeat(n <= NEIGHBOURS + 1, n)
        before, after = np.full(len(h), -1), np.full(len(h), -1)
        if few.any():
            before[few], after[few] = _compare(h[few], right[few], left[few], doc[few])
        many = ~few
        if many.any():
            least, most = _matches(h[many], right[many], left[many], doc[many], doc[many])
            before[many], after[many] = np.where(least < 0, -1, PASSAGE - PREFIX - least), most
        ok = np.flatnonzero(after >= 0)
        yield _spans(doc[ok], b.column("places").take(pa.array(ok)), before[ok], after[ok])


def _in_full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of suffixes whose surroundings another document has too: as far as these reach."""
    for b in batches:
        if b.num_rows:
            before, after = ((_matrix(b.column(c), n) != 0).sum(axis=1) for c, n in (("before", BEFORE), ("after", AFTER)))
            yield _spans(b.column("doc").to_numpy(), b.column("places"), before, after)


_SPLITS = "key long, first int, last int, after binary, before binary, lo long, hi long, places array<int>"


def _ranges(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """Rows by their range of splits."""
    first, last = b.column("first").to_numpy(), b.column("last").to_numpy()
    for x, y in sorted(set(zip(first.tolist(), last.tolist(), strict=True))):
        yield b.take(pa.array(np.flatnonzero((first == x) & (last == y)))), x, y


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the rows of one document in whole groups; the other rows are only compared with."""
    for b in _groups(batches, "key"):
        for r, first, last in _ranges(b):
            lo, hi = r.column("lo").to_numpy(), r.column("hi").to_numpy()
            least, most = _matches(r.column("key").to_numpy(), _matrix(r.column("after"), last - first), _matrix(r.column("before"), last - first), lo, hi)
            ok = np.flatnonzero((least >= 0) & (lo == hi))
            yield _spans(lo[ok], r.column("places").take(pa.array(ok)), PASSAGE - PREFIX - first - least[ok], first + most[ok])


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row as two, of half its range of splits; words that all splits of a half take go into its key."""
    for b in batches:
        if not b.num_rows:
            continue
        for r, first, last in _ranges(b):
            right, left = (_matrix(r.column(c), last - first) for c in ("after", "before"))
            ahead, behind = _growing(r.column("key").to_numpy().view(np.uint64), right), _growing(np.zeros(r.num_rows, np.uint64), left)
            middle = (first + last) // 2
            for x, y in ((first, middle), (middle + 1, last)):
                i, j = x - first, last - y
                ok = np.flatnonzero(((right != 0).sum(axis=1) >= i) & ((left != 0).sum(axis=1) >= j))
                key = _mix(ahead[i][ok], behind[j][ok], x << 8 | y).view(np.int64)
                kept = [r.column(c).take(pa.array(ok)) for c in ("lo", "hi", "places")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), *(pa.array(np.full(len(ok), v, np.int32)) for v in (x, y)), _binary(right[ok, i : i + y - x]), _binary(left[ok, j : j + y - x]), *kept],
                    names=["key", "first", "last", "after", "before", "lo", "hi", "places"],
                )


def _crowded(rows: DataFrame) -> DataFrame:
    """Passages around suffixes of which more than MOST share their first words.

    Each different surrounding becomes one row with its least and greatest document. What two documents share in full is a
    passage at all its places. The others go by the ways to split a passage into words before and after: rows that agree in the
    words which all splits of a range need are one group; a group of at most MOST rows is compared in one task, the rows of a
    larger one go on with half the range each. With one split left, a key of two documents is a passage of both.
    """
    around = F.xxhash64("after", "before").alias("around")
    single = rows.groupBy("h", "after", "before", "doc").agg(F.flatten(F.collect_list("places")).alias("places"))  # of one document
    apart = single.groupBy("h", "after", "before").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.max_by("places", "doc").alias("places"))
    apart, _ = stage(apart.withColumn("places", F.when(F.col("lo") == F.col("hi"), F.col("places")).otherwise(F.array().cast("array<int>"))), "suffix-surroundings")
    both, _ = stage(apart.where("lo < hi").select("h", around), "suffix-whole")
    spans = join_ids(rows.select("*", around), both, ["h", "around"], "left_semi").drop("around").mapInArrow(_in_full, _OUT)
    todo = apart.select(F.col("h").alias("key"), F.lit(0).alias("first"), F.lit(PASSAGE - PREFIX).alias("last"), "after", "before", "lo", "hi", "places")
    while True:
        large, _ = stage(todo.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST).select("key"), "suffix-large")
        small = join_ids(todo, large, "key", "left_anti").repartition("key").sortWithinPartitions("key")
        spans = spans.unionByName(small.mapInArrow(_by_split, _OUT))
        if large.isEmpty():
            return spans
        more = join_ids(todo, large, "key", "left_semi")
        last = more.where("first = last")
        shared, _ = stage(last.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("key"), "suffix-keys")
        found = join_ids(last.where("lo = hi"), shared, "key", "left_semi").select("lo", "first", F.explode("places").alias("place"))
        start = F.col("place") + F.col("first") - (PASSAGE - PREFIX)
        spans = spans.unionByName(found.select(F.col("lo").alias("doc"), start.alias("start"), (start + PASSAGE).alias("stop")))
        todo, _ = stage(more.where("first < last").mapInArrow(_halves, _SPLITS), "suffix-halves")


_OUT = "doc long, start int, stop int"


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of at least PASSAGE words that another document has too.

    Words are runs without ASCII white space after lower-casing A-Z. Suffixes are kept at minimiser
    places only, so about 2 / (WINDOW + 1) of all; two copies of a passage share one of its first WINDOW places. Suffixes, each with
    BEFORE words before it, whose prefix a second document has are sorted; each is compared with its neighbours, in both
    directions from its place. A suffix's prefix is compared by a 64-bit hash, its
    surroundings by 16-bit hashes of their words. Where more suffixes share a prefix than neighbours are compared, all ways to
    place a passage around them are compared, by key, within the task; beyond MOST suffixes the rows are parted by the words
    that they share, so that no task gets all rows of a frequent passage. Matches of one document that overlap become one span.

    Result, one row per span: ``doc_id``, ``start``, ``stop`` (word numbers from 0, end excluded),
    ``n_words``. Null, empty and short texts have no spans; rows without an id are left out; rows
    with the same id are one document, and repeats within one document do not count. An empty table gives an empty result;
    other columns are not looked at.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # Written, so that the texts are read once; words around suffixes are cut out of their text's when they are needed.
    found, _ = stage(src.mapInArrow(_suffixes, "doc long, h array<long>, place array<int>, words binary"), "suffixes")
    sizes = found.select("doc", F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    shared, _ = stage(sizes.where("lo < hi").select("h", (F.col("n") > MOST).alias("crowded")), "suffix-shared")
    kind = "h long, after binary, before binary, doc long, places array<int>"
    near = join_ids(found.mapInArrow(_surroundings(), kind), shared.where("not crowded").select("h"), "h", "left_semi")
    spans = near.repartition("h").sortWithinPartitions("h", "after", "before", "doc").mapInArrow(_neighbours, _OUT)
    crowded = [r.h for r in shared.where("crowded").select("h").collect()]  # at most one for MOST suffixes
    if crowded:
        spans = spans.unionByName(_crowded(found.mapInArrow(_surroundings(np.sort(np.array(crowded, np.int64))), kind)))
    spans = spans.select(F.col("doc").alias(id_col), "start", "stop").distinct()
    return _merged(spans, id_col)


def _merged(spans: DataFrame, id_col: str) -> DataFrame:
    """Overlapping spans of one document as one; a document has few, bounded by its length."""
    w = Window.partitionBy(id_col).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("fresh", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("grp", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(id_col, "grp").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return out.select(id_col, "start", "stop", (F.col("stop") - F.col("start")).alias("n_words"))
