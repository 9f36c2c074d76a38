"""Exact duplicates by an extendible-hash index on shared files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import fresh, stage, texts

#: Bytes of text that one task compares before it starts anew; bounds the memory of a map task.
LOCAL_BYTES = 48 << 20


def grow_directory(cells: dict[int, int], capacity: int, max_depth: int) -> tuple[int, list[int]]:
    """Global depth and directory (bucket number by key prefix) after all splits.

    ``cells`` holds bytes by prefix of ``max_depth`` bits. It starts with one bucket. An overfull
    bucket splits by one more bit; if its depth equals the global depth, the directory doubles first.
    A bucket of full depth is not split further: its owner streams it, whatever its size.
    """
    counts = np.zeros(1 << max_depth, dtype=np.int64)
    counts[list(cells)] = list(cells.values())
    size = [counts]
    for _ in range(max_depth):
        size.append(size[-1].reshape(-1, 2).sum(axis=1))
    size.reverse()  # bytes by prefix, one array per depth
    depth, directory, buckets = 0, [0], [(0, 0)]  # bucket: prefix, local depth
    todo = [0]
    while todo:
        b = todo.pop()
        prefix, local = buckets[b]
        if local == max_depth or size[local][prefix] <= capacity:
            continue
        if local == depth:
            directory = [x for x in directory for _ in (0, 1)]
            depth += 1
        new = len(buckets)
        buckets[b] = (prefix << 1, local + 1)
        buckets.append((prefix << 1 | 1, local + 1))
        span = 1 << (depth - local - 1)
        first = (prefix << 1 | 1) * span
        directory[first : first + span] = [new] * span
        todo += [b, new]
    return depth, directory


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: bool = False,
    bucket_bytes: int = 4 << 20,
    max_depth: int = 16,
) -> DataFrame:
    """Mark copies: texts equal after lower-casing A-Z; null counts as empty.

    Each map task first folds the copies among its own rows, comparing bytes, so that a text sends
    one row per task. These rows are keyed by a 64-bit hash. A histogram over the first ``max_depth``
    bits (at most 2^max_depth rows, whatever the input) drives directory doubling; owner tasks take
    the key ranges of the buckets, stream them in key order, chain texts of equal hash and compare
    their bytes, and write the index to the shared folder.

    Result, one row per input row: ``doc_id``, ``keep_id`` (largest doc_id of equal texts),
    ``group_size``, ``kept``, ``text_sha256``; with ``carry`` all input columns as well, whose names
    give way to these four. Of repeated rows with the same id and text just one is kept. A null id
    never beats another; if all ids of a group are null, ``keep_id`` is null and one row is kept.
    An empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    results = ("keep_id", "group_size", "kept", "text_sha256")
    other = [c for c in docs.columns if c not in (id_col, text_col) and c.lower() not in results] if carry else []
    key, tag, head, row = fresh([*docs.columns, *results], "x_key", "x_tag", "x_head", "x_row")
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{text_col}`").cast("string").alias(text_col), *[F.col(f"`{c}`") for c in other])
    schema = T.StructType([*src.schema.fields, T.StructField(key, T.LongType()), T.StructField(tag, T.LongType()), T.StructField(head, T.BooleanType()), T.StructField(row, T.LongType()), T.StructField("text_sha256", T.StringType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        seen: dict[bytes, tuple[int, int, str]] = {}
        held = n = 0
        for b in batches:
            keys, tags, heads, shas = [], [], [], []
            for t in texts(b, text_col):
                t = t.lower()  # bytes: A-Z only
                known = seen.get(t)
                if known is None:
                    known = seen[t] = (xxhash.xxh64_intdigest(t) - (1 << 63), base + n, hashlib.sha256(t).hexdigest())
                    held += len(t)
                    heads.append(True)
                else:
                    heads.append(False)
                keys.append(known[0])
                tags.append(known[1])
                shas.append(known[2])
                n += 1
                if held > LOCAL_BYTES:
                    seen.clear()
                    held = 0
            columns = list(b.columns)
            if not carry:  # a folded copy's text is not needed again
                at = b.schema.get_field_index(text_col)
                columns[at] = pc.if_else(pa.array(heads), columns[at], None)
            rows = pa.array(range(base + n - len(keys), base + n), pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.int64()), pa.array(tags, pa.int64()), pa.array(heads), rows, pa.array(shas, pa.string())], names=[*b.schema.names, key, tag, head, row, "text_sha256"])

    rows, _ = stage(src.mapInArrow(fold, schema), "exact-rows")

    cell = F.shiftrightunsigned(F.col(key).bitwiseXOR(F.lit(-(1 << 63))), 64 - max_depth).cast("int")
    heads = rows.where(F.col(head)).select(tag, key, F.col(text_col).alias("text"), cell.alias("cell"))
    histogram = heads.groupBy("cell").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("n"))
    cells = {r.cell: r.n for r in histogram.collect()}  # at most 2^max_depth rows
    depth, directory = grow_directory(cells, bucket_bytes, max_depth)
    routes = spark.createDataFrame([(c, directory[c >> (max_depth - depth)]) for c in cells], "cell int, bucket int")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, chain = None, []
        for b in batches:
            places = []
            for k, t in zip(b.column("key").to_pylist(), texts(b, "text"), strict=True):
                t = t.lower()
                if k != current:
                    current, chain = k, []
                for place, other_text in enumerate(chain):
                    if other_text == t:
                        break
                else:
                    place = len(chain)
                    chain.append(t)
                places.append(place)
            yield pa.RecordBatch.from_arrays([b.column("bucket"), b.column("key"), pa.array(places, pa.int32()), b.column("tag")], names=["bucket", "key", "chain", "tag"])

    owned = (
        heads.join(F.broadcast(routes), "cell")
        .select("bucket", F.col(key).alias("key"), F.col(tag).alias("tag"), "text")
        .repartition("bucket")
        .sortWithinPartitions("bucket", "key")
        .mapInArrow(own, "bucket int, key long, chain int, tag long")
    )
    index, _ = stage(owned, "exact-index")

    # Sizes per task and text first, so that a frequent text meets in a few rows.
    folded = rows.groupBy(F.col(tag).alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.col(id_col), F.col(row))).alias("top"))
    entries = index.join(folded, "tag")
    classes = entries.groupBy("key", "chain").agg(F.sum("n").alias("group_size"), F.max("top").alias("top"))
    verdict, _ = stage(
        index.join(classes, ["key", "chain"]).select(F.col("tag").alias(tag), F.col(f"top.{id_col}").alias("keep_id"), "group_size", F.col(f"top.{row}").alias("keep_row")), "exact-classes"
    )
    extra = [F.col(f"`{c}`") for c in docs.columns if c == text_col or c in other] if carry else []
    return rows.join(verdict, tag).select(id_col, *extra, "keep_id", "group_size", (F.col(row) == F.col("keep_row")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that ``exact_dedup`` keeps, with the columns of the input, whatever their names."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    out = exact_dedup(docs.toDF(*names), at[id_col], at[text_col], carry=True).where("kept")
    return out.select(*[F.col(at[c]).alias(c) for c in docs.columns])
