"""Near duplicates by b-bit MinHash."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import discard, fresh, join_ids, stage, texts
from tickloom.llm.graph import components

#: Rows per band and bands. Two sets of similarity 0.8 meet in a band with probability 0.26; they
#: meet in none of the bands with probability 3.6e-9.
ROWS, BANDS = 6, 64
#: Low bits kept of each minimum.
BITS = 8
#: Members of one band, and their shingles, that make one block.
BLOCK, BLOCK_SHINGLES = 512, 250_000
#: Members, and shingles of members, whose texts meet in one task.
TASK_ROWS, TASK_SHINGLES = 4_000, 2_000_000
#: Distinct words whose hashes a Python worker remembers at once.
WORDS = 400_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_hashes(words: list[bytes], size: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words make one shingle."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    m = max(1, n - size + 1)
    acc = h[:m] ^ np.uint64(min(n, size))
    for j in range(1, min(n, size)):
        acc = (acc ^ (acc >> np.uint64(29))) * _M1 + h[j : j + m]
    acc = (acc ^ (acc >> np.uint64(32))) * _M2
    return np.unique(acc ^ (acc >> np.uint64(31)))


def functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def signature(hashes: np.ndarray, mul: np.ndarray, add: np.ndarray) -> bytes:
    """The low byte of the minimum under each permutation."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(best, (mul[:, None] * x[None, i : i + 1024] + add[:, None]).min(axis=1), out=best)
    return (best & np.uint32((1 << BITS) - 1)).astype(np.uint8).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of packed signatures (last axis: 64-bit lanes of eight values).

    Values that differ are counted as bits; the chance 2^-b that different minima share their low
    bits is taken out.
    """
    x = a ^ b
    for s in (4, 2, 1):
        x |= x >> np.uint64(s)
    same = 1 - np.bitwise_count(x & np.uint64(0x0101010101010101)).sum(axis=-1, dtype=np.int64) / (8 * a.shape[-1])
    chance = 2.0**-BITS
    return (same - chance) / (1 - chance)


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    threshold: tuple[int, int] = (80, 100),
    slack: float = 0.11,
) -> DataFrame:
    """Components of documents whose sets of word shingles have Jaccard similarity >= threshold.

    Words are runs without ASCII white space after lower-casing A-Z. Equal sets fold into one node
    first, so copies of any number meet once. Bands of the packed signatures give candidates, the
    estimate of a candidate must reach the threshold less
    ``slack`` (five standard errors), and the full sets decide. First each node meets one pivot:
    of each band that member which shares most over all bands, of these the most frequent. Within bands whose members are then still in
    different components, members of different components are compared in blocks, each pair in the
    first band that it shares, so no link depends on the choice of the pivot, and no band is
    capped. The full sets of a block are at hand there, so likely pairs are decided on the spot and only links
    come out, at most one for two components in a task.

    Result, one row per input row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest doc_id
    reachable), ``kept`` (doc_id = component_id). Texts without words (null, empty, white space) have
    no shingles, link with nothing and are kept. Rows with the same id are one document. A null id
    never names a component; if all equal texts lack an id, component_id is null and the row is
    kept. An empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    mul, add = functions(ROWS * BANDS)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        recent: dict[bytes, bytes] = {}
        for b in batches:
            counts, prints, signs = [], [], []
            for t in texts(b, "text"):
                h = shingle_hashes(t.lower().split(), shingle, known)
                counts.append(len(h))
                fp = xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None
                if fp is not None and fp not in recent:
                    recent[fp] = signature(h, mul, add)
                prints.append(fp)
                signs.append(recent.get(fp) if fp else None)
                if len(known) > WORDS:
                    known.clear()
                if len(recent) > 20_000:
                    recent.clear()
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), pa.array(signs, pa.binary())], names=["id", "n", "fp", "sig"])

    signed_rows, signed_path = stage(src.mapInArrow(sign, "id long, n long, fp binary, sig binary"), "near-signed")
    # The result reads these; signatures go on with the nodes alone.
    rows, _ = stage(signed_rows.select("id", "n", "fp"), "near-rows")

    # One node per distinct set, named by its smallest document.
    groups = signed_rows.where("fp is not null").groupBy("fp").agg(F.min("id").alias("node"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    nodes, nodes_path = stage(groups.where("node is not null").groupBy("node").agg(F.first("sig").alias("sig"), F.max("n").alias("n")), "near-nodes")
    discard(spark, signed_path)
    named_by = rows.where("fp is not null").groupBy("fp").agg(F.min("id").alias("node")).where("node is not null")

    j = F.sequence(F.lit(0), F.lit(BANDS - 1))
    bands = nodes.select("node", "n", F.posexplode(F.transform(j, lambda k: F.xxhash64(k, F.col("sig").substr(k * ROWS + 1, F.lit(ROWS))))).alias("j", "band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members, members_path = stage(bands.join(shared, "band"), "near-members")
    # A band's pivot is its member with the most company over all bands: the text that copies vary.
    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    known = members.join(company, "node")
    pivots = known.groupBy("band").agg(F.max(F.struct("company", -F.col("node"))).alias("m")).select("band", (-F.col("m.col2")).alias("pivot"))

    met, met_path = stage(members.select("node").distinct(), "near-met")
    if met.isEmpty():
        discard(spark, members_path, met_path)
        return _result(rows, None, id_col)
    bodies, bodies_path = stage(join_ids(src.where("id is not null"), met.withColumnRenamed("node", "id"), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), "near-texts")
    signs = nodes.join(met, "node", "left_semi").select("node", "sig")

    floor = threshold[0] / threshold[1] - slack

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, c = (np.frombuffer(b"".join(b.column(x).to_pylist()), np.uint64).reshape(b.num_rows, -1) for x in ("sa", "sb"))
                out = pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"])
                yield out.filter(pa.array(similarity(a, c) >= floor))

    often = members.join(pivots, "band").where("node != pivot").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("k"))
    star = often.groupBy("node").agg(F.max(F.struct("k", -F.col("pivot"))).alias("m")).select((-F.col("m.col2")).alias("a"), F.col("node").alias("b"))
    signed = star.join(signs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(signs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    near, near_path = stage(signed.mapInArrow(estimate, "a long, b long"), "near-star")

    def confirm(pairs: DataFrame, label: str) -> tuple[DataFrame, str]:
        """The pairs whose full sets are similar enough."""

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[bytes, frozenset] = {}
            for b in batches:
                good = []
                for x, y in zip(texts(b, "ta"), texts(b, "tb"), strict=True):
                    p, q = (known.get(t) or known.setdefault(t, _shingles(t, shingle)) for t in (x, y))
                    both = len(p & q)
                    good.append(threshold[1] * both >= threshold[0] * (len(p) + len(q) - both))
                    if sum(map(sys.getsizeof, (x, y))) > 1 << 20 or len(known) > 200:
                        known.clear()
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

        named = pairs.select("a", "b").join(bodies.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(bodies.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        return stage(named.mapInArrow(check, "a long, b long"), label)

    first, first_path = confirm(near, "near-first")
    part, part_path = stage(components(first), "near-part")
    pairs, work_path = _within_bands(members, part, signs, bodies, shingle, threshold, floor)
    second, second_path = stage(pairs, "near-second")
    discard(spark, work_path)
    whole, whole_path = stage(components(first.unionByName(second)), "near-components")
    named, _ = stage(named_by.join(whole, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "near-named")
    discard(spark, nodes_path, members_path, met_path, bodies_path, near_path, first_path, part_path, second_path, whole_path)
    return _result(rows, named, id_col)


def _shingles(text: bytes, size: int) -> frozenset:
    words = text.lower().split()
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*(words[i:] for i in range(size)), strict=False))


def _result(rows: DataFrame, named: DataFrame | None, id_col: str) -> DataFrame:
    if named is None:
        named = rows.where("fp is not null").groupBy("fp").agg(F.min("id").alias("component_id"))
    out = rows.select("id", "n", "fp").join(named, "fp", "left")
    label = F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), label.alias("component_id"), F.col("id").eqNullSafe(label).alias("kept"))


def _within_bands(members: DataFrame, part: DataFrame, signs: DataFrame, bodies: DataFrame, shingle: int, threshold: tuple[int, int], floor: float) -> tuple[DataFrame, str]:
    """Links between documents that share a band and lie in different components.

    The band's largest component need not meet itself. Its members lie in blocks of at most about BLOCK
    members and BLOCK_SHINGLES shingles; the others in blocks of their own, which meet each other and all
    blocks of the largest component. Pieces of work on the same blocks of the same largest component, one for each band, go to
    one task, and a text goes to a task once, whatever the number of its pieces there. Returns the links, yet to be
    computed, and the path of the staged pieces they are computed from.
    """
    rows = members.join(part, "node", "left").select("band", "j", "node", "n", F.coalesce("component", "node").alias("c"))
    sizes = rows.groupBy("band", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    mixed = sizes.groupBy("band").agg(F.max(F.struct("k", "s", "c")).alias("top"), F.sum("k").alias("k"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("cs")).where("cs > 1")

    def blocks(k: Column, s: Column) -> Column:
        return F.greatest(F.ceil(k / BLOCK), F.ceil(s / BLOCK_SHINGLES), F.lit(1)).cast("int")

    mixed = mixed.select("band", F.col("top.c").alias("main"), blocks(F.col("top.k"), F.col("top.s")).alias("p"), blocks(F.col("k") - F.col("top.k"), F.col("s") - F.col("top.s")).alias("q"))
    spread = F.pmod(F.xxhash64("node"), F.lit(1 << 30)).cast("int")
    rows = rows.join(mixed, "band").withColumn("is_main", F.col("c") == F.col("main")).withColumn("own", F.when(F.col("is_main"), spread % F.col("p")).otherwise(spread % F.col("q")))
    # Pieces of work (x, y): y < q means two blocks of others, else block y - q of the largest component.
    of_main = F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda x: F.struct(x.alias("x"), (F.col("q") + F.col("own")).alias("y")))
    of_other = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("x"), F.greatest(x, F.col("own")).alias("y"))),
        F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda y: F.struct(F.col("own").alias("x"), (F.col("q") + y).alias("y"))),
    )
    work = rows.withColumn("w", F.explode(F.when(F.col("is_main"), of_main).otherwise(of_other))).select("node", "n", "c", "is_main", "j", F.xxhash64("band", "w.x", "w.y").alias("piece"), F.xxhash64("main", "w.x", "w.y").alias("place"))
    work, work_path = stage(work, "near-work")
    load = work.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("s")).first()
    groups = max(1, load.k // TASK_ROWS, load.s // TASK_SHINGLES)

    def compare(pdf: pd.DataFrame, bodies_here: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece", kind="stable")
        held = bodies_here.sort_values("node_sent")
        at = np.searchsorted(held["node_sent"].to_numpy(), pdf["node"].to_numpy())
        every = np.frombuffer(b"".join(held["sig"]), np.uint64).reshape(len(held), -1)
        texts_here = held["text"].to_numpy()
        node, comp, main, piece, band = (pdf[c].to_numpy() for c in ("node", "c", "is_main", "piece", "j"))
        known, sets, joined, out = _WordHash(), {}, {}, []

        def full(x: int) -> frozenset:
            if node[x] not in sets:
                sets[node[x]] = frozenset(shingle_hashes(texts_here[at[x]].encode().lower().split(), shingle, known).tolist())
            return sets[node[x]]

        def root(c: int) -> int:
            while c in joined:
                joined[c] = c = joined.get(joined[c], joined[c])
            return c

        cuts = np.flatnonzero(np.diff(piece)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
            sets.clear()
            known.clear()
            sig = every[at[lo:hi]]
            bands = sig.view(np.uint8).reshape(hi - lo, BANDS, ROWS)
            for i in range(lo, hi):
                if main[i]:
                    continue
                j = np.arange(lo, hi)
                j = j[(comp[lo:hi] != comp[i]) & (main[lo:hi] | (j > i))]
                likely = similarity(sig[j - lo], sig[i - lo])
                j = j[np.argsort(-likely, kind="stable")][: int((likely >= floor).sum())]  # likeliest first
                for x in j[(bands[j - lo] == bands[i - lo]).all(axis=2).argmax(axis=1) == band[i]]:
                    a, b = root(comp[i]), root(comp[x])
                    if a == b:
                        continue
                    p, q = full(i), full(x)
                    both = len(p & q)
                    if threshold[1] * both >= threshold[0] * (len(p) + len(q) - both):
                        joined[a] = b
                        out.append((min(node[i], node[x]), max(node[i], node[x])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    dealt = work.select("node", "c", "is_main", "j", "piece", F.pmod(F.col("place"), F.lit(groups)).alias("g"))
    sent = dealt.select("g", "node").distinct().join(signs, "node").join(bodies.select(F.col("id").alias("node"), F.coalesce("text", F.lit("")).alias("text")), "node")
    # New names, as both sides come from the same pieces.
    sent = sent.select(F.col("g").alias("g_sent"), F.col("node").alias("node_sent"), "sig", "text")
    return dealt.groupBy("g").cogroup(sent.groupBy("g_sent")).applyInPandas(compare, "a long, b long"), work_path


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents that ``near_dedup`` keeps, with the columns of the input, whatever their names."""
    (mark,) = fresh(docs.columns, "x_id")
    kept = near_dedup(docs, id_col, text_col, **kw).where("kept").select(F.col(f"`{id_col}`").alias(mark)).distinct()
    return docs.join(kept, docs[f"`{id_col}`"].cast("long").eqNullSafe(kept[mark]), "left_semi")
