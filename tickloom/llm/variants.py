"""Spelling variants by a frontier of states over a trie, advanced level by level with joins."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import discard, slices, stage

#: Letters of a run; only A-Z are lower-cased.
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: One run in so many is damaged.
DAMAGE = 97
#: A word has so many code points and occurrences, at least.
LETTERS, OCCURRENCES = 5, 3
#: Words beyond so many letters are compared by their deletions instead of a trie that deep.
DEEPEST = 64
#: Each trie node holds so many 64-bit masks of the endings below it.
MASKS = 4
#: Odd multiplier of the polynomial hash of long words (modulo 2^64) and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = DAMAGE) -> DataFrame:
    """``word, n``: occurrences of all runs of letters in whole texts, counted per batch before the shuffle.

    A run loses one code point where ``damage`` divides the crc32 of ``<id>:<run>`` (0: never); a null id counts as
    an empty one. A run that loses its only letter is no word. Null and empty texts have none.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            total: Counter[str] = Counter()
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = Counter(_RUN.findall((t or "").translate(_LOWER)))
                head = zlib.crc32(f"{'' if i is None else i}:".encode())
                for w, k in found.items():
                    h = zlib.crc32(w.encode(), head)
                    if damage and h % damage == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                    total[w] += k
            total.pop("", None)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    flat = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return flat.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _shared(a: str, b: str) -> Column:
    """Whether endings below two nodes can be equal: their masks have a common bit."""
    return F.expr(" OR ".join(f"({a}.m{j} & {b}.m{j}) != 0" for j in range(MASKS)))


def _edges(words: DataFrame) -> DataFrame:
    """The trie as rows ``parent, ch, child, ends`` with masks of the endings below ``child``.

    A node is the hash of its prefix; nodes that collide act as one, which can only add candidates.
    """
    cells = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("k")).selectExpr(
        "xxhash64(substring(word, 1, k - 1)) AS parent",
        "substring(word, k, 1) AS ch",
        "xxhash64(substring(word, 1, k)) AS child",
        "k = length(word) AS ends",
        f"CAST(pmod(xxhash64(substring(word, k + 1)), {64 * MASKS}) AS INT) AS bit",
    )
    masks = [F.expr(f"bit_or(CASE WHEN bit DIV 64 = {j} THEN shiftleft(1L, bit % 64) ELSE 0L END) AS m{j}") for j in range(MASKS)]
    return cells.groupBy("parent", "ch", "child").agg(F.max("ends").alias("ends"), *masks)


def _seeds(edges: DataFrame) -> DataFrame:
    """All states right after their edit: ``p, q, skip, hit``.

    Two siblings are a replaced letter. A node and its child are a letter more in ``q``; ``skip`` keeps the next letter from
    being the same one, so that of a run of equal letters only the last counts as inserted and a pair comes up once.
    """
    a, b = edges.alias("a"), edges.alias("b")
    replaced = a.join(b, F.expr("a.parent = b.parent AND a.ch < b.ch") & _shared("a", "b")).selectExpr(
        "a.child AS p", "b.child AS q", "CAST(NULL AS STRING) AS skip", "a.ends AND b.ends AS hit"
    )
    inserted = a.join(b, F.expr("a.child = b.parent") & _shared("a", "b")).selectExpr("a.child AS p", "b.child AS q", "b.ch AS skip", "a.ends AND b.ends AS hit")
    # The root has every ending below it.
    first = edges.where(F.expr("parent = xxhash64('')")).selectExpr("parent AS p", "child AS q", "ch AS skip", "false AS hit")
    return replaced.unionByName(inserted).unionByName(first)


def _advance(states: DataFrame, edges: DataFrame) -> DataFrame:
    """One level: both sides of each state follow the same letter."""
    f, a, b = states.alias("f"), edges.alias("a"), edges.alias("b")
    onward = f.join(a, F.expr("f.p = a.parent AND (f.skip IS NULL OR f.skip != a.ch)"))
    return onward.join(b, F.expr("f.q = b.parent AND a.ch = b.ch") & _shared("a", "b")).selectExpr(
        "a.child AS p", "b.child AS q", "CAST(NULL AS STRING) AS skip", "a.ends AND b.ends AS hit"
    )


def _long_pairs(words: DataFrame) -> DataFrame:
    """Candidate pairs ``p, q`` of which one word at least is longer than ``DEEPEST``: equal after one deletion."""

    def deletions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, w in zip(b.column("node").to_pylist(), b.column("word").to_pylist(), strict=True):
                c = np.array([ord(x) for x in w], np.uint64)
                term = c * np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(c) - 1, _BASE, np.uint64)]))
                upto = np.concatenate([[np.uint64(0)], np.cumsum(term, dtype=np.uint64)])
                gone = upto[:-1] + (upto[-1] - upto[1:]) * np.uint64(_INVERSE)
                n = len(w)
                for lo in range(0, n, 1 << 16):
                    part = gone[lo : lo + (1 << 16)].view(np.int64)
                    k = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([node] * k, pa.int64()), pa.array([n] * k, pa.int32()), pa.array(np.arange(lo, lo + k, dtype=np.int32)), pa.array(part)],
                        names=["node", "size", "at", "key"],
                    )
                yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([n], pa.int32()), pa.array([-1], pa.int32()), pa.array(upto[-1:].view(np.int64))], names=["node", "size", "at", "key"])

    rows, path = stage(words.select(F.expr("xxhash64(word) AS node"), "word").mapInArrow(deletions, "node long, size int, at int, key long"), "variant-long")
    a, b = rows.alias("a"), rows.where("at >= 0").alias("b")
    replaced = a.where("at >= 0").join(b, F.expr("a.size = b.size AND a.at = b.at AND a.key = b.key AND a.node < b.node"))
    inserted = a.where("at < 0").join(b, F.expr("a.size + 1 = b.size AND a.key = b.key"))
    pairs = replaced.select("a.node", "b.node", "b.size").union(inserted.select("a.node", "b.node", "b.size")).toDF("p", "q", "size")
    return pairs.where(f"size > {DEEPEST}").select("p", "q").distinct()


def near_words(words: DataFrame) -> DataFrame:
    """Pairs ``a, b`` (each in both orders) of distinct ``words.word`` that differ by one code point inserted, deleted or replaced.

    A state (prefix of a word, node, edits) stands for all words of that prefix, so words of a common beginning share their
    states. States without an edit are the nodes themselves; those after their edit advance one letter a round by two joins
    with the edge table, and end where no ending below both sides can be equal. A node has at most one state for each way to
    edit its prefix once, and one edge a letter, so no join key is hot. States at two word ends are neighbours; they
    are compared letter by letter at last. Words beyond ``DEEPEST`` letters meet by the hashes of their deletions. Words have at least one letter.
    """
    spark = words.sparkSession
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    edges, edge_path = stage(_edges(words.where(F.length("word") <= DEEPEST)), "variant-edges")
    states, path = stage(_seeds(edges), "variant-states")
    paths, found = [path], [states]
    while not states.isEmpty():
        states, path = stage(_advance(states, edges), "variant-states")
        paths.append(path)
        found.append(states)
    pairs = found[0].where("hit").select("p", "q")
    for f in found[1:]:
        pairs = pairs.unionByName(f.where("hit").select("p", "q"))
    if longest > DEEPEST:
        pairs = pairs.unionByName(_long_pairs(words.where(F.length("word") >= DEEPEST)))
    ids = words.select(F.expr("xxhash64(word) AS node"), "word")
    named = pairs.join(ids.toDF("p", "a"), "p").join(ids.toDF("q", "b"), "q")
    # Colliding nodes may bring a pair twice; a pair has no other way to come up again.
    near = named.where("levenshtein(a, b, 1) = 1").select("a", "b").distinct()
    near, _ = stage(near, "variant-near")
    discard(spark, edge_path, *paths)
    return near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _roots(links: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: pointers double until they stay. Occurrences double along each link, so six rounds
    reach the end of any chain; a round is left out as soon as the last changed nothing."""
    spark = links.sparkSession
    roots, path = stage(links.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        new, new_path = stage(joined, "variant-roots")
        moved = not new.where("moved").isEmpty()
        roots = new.select("word", "root")
        discard(spark, path)
        path = new_path
        if not moved:
            return roots


def variant_forms(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for distinct words with their numbers of occurrences ``n``.

    The form is the near word of largest ``n`` (ties: the smallest in code-point order), if that is twice the word's at
    least; the root is the last word that forms lead to.
    """
    words, _ = stage(words.select("word", "n"), "variant-words")
    near = near_words(words).join(words.toDF("b", "bn"), "b")
    best = near.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("bn")).alias("m"), F.col("b").alias("form"))).alias("best"))
    rows = words.join(best, "word", "left").selectExpr(
        "word", "n", "coalesce(n_near, 0L) AS n_near", "CASE WHEN -best.m >= 2 * n THEN best.form END AS form", "CASE WHEN -best.m >= 2 * n THEN -best.m END AS form_n"
    )
    rows, _ = stage(rows, "variant-forms")
    roots = _roots(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = DAMAGE) -> DataFrame:
    """``variant_forms`` of the words of whole texts: ``LETTERS`` code points and ``OCCURRENCES`` at least.

    Null and empty texts have no words; repeated rows count again; other columns are not read; an empty table
    gives an empty result.
    """
    counts = word_counts(docs, id_col, text_col, damage)
    return variant_forms(counts.where((F.length("word") >= LETTERS) & (F.col("n") >= OCCURRENCES)))
