"""BPE encoding and decoding through a table of distinct words."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import slices, texts
from tickloom.llm.wordbpe import Codes, WordEncoder, gather

#: Bytes of text whose words share one list; bounds the memory of a task.
CHUNK_BYTES = 32 << 20
#: Words are dealt to so many owners by hash.
OWNERS = 128


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """Id-to-piece table of a tokenizer file; its size is that of the vocabulary."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return spark.createDataFrame(pd.DataFrame(sorted((i, p) for p, i in t.get_vocab(with_added_tokens=True).items()), columns=["id", "piece"]))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, list[np.ndarray], list[bytes], int]]:
    """Number, rows, word places per row, distinct words in order of frequency, and a check sum of these."""
    part, n = TaskContext.get().partitionId(), 0
    for b in slices(batches, "text", CHUNK_BYTES):
        known = Codes()
        lines = [np.fromiter(map(known.__getitem__, t.split()), np.int64) for t in texts(b, "text")]
        order = np.argsort(-np.bincount(np.concatenate(lines), minlength=len(known)), kind="stable")
        place = np.empty(len(order), "<u4")
        place[order] = np.arange(len(order))
        words = list(known)
        words = [words[i] for i in order]
        yield part << 32 | n, b, [place[x] for x in lines], words, zlib.crc32(b" ".join(words))
        n += 1


def _packed(a: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _split_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's distinct words, in one row per owner, with their places in the chunk's list."""
    for chunk, _, _, words, check in _chunks(batches):
        owner = np.fromiter((zlib.crc32(w) % OWNERS for w in words), np.int64, len(words))
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(OWNERS + 1))
        mine = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        used = [o for o in range(OWNERS) if len(mine[o])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([chunk] * len(used), pa.int64()),
                pa.array([check] * len(used), pa.int64()),
                pa.array(used, pa.int32()),
                pa.array([_packed(mine[o]) for o in used], pa.binary()),
                pa.array([[words[i].decode() for i in mine[o]] for o in used], pa.list_(pa.string())),
            ],
            names=["chunk", "check", "owner", "places", "words"],
        )


def _place_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows with the place of each word of their texts in the chunk's list."""
    for chunk, b, lines, _, check in _chunks(batches):
        step = 128
        ids = b.column("id").to_pylist()
        starts = range(0, len(lines), step)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([chunk] * len(starts), pa.int64()),
                pa.array([check] * len(starts), pa.int64()),
                pa.array([ids[i : i + step] for i in starts], pa.list_(pa.int64())),
                pa.array([[len(x) for x in lines[i : i + step]] for i in starts], pa.list_(pa.int32())),
                pa.array([_packed(np.concatenate(lines[i : i + step])) for i in starts], pa.binary()),
            ],
            names=["chunk", "check", "ids", "lengths", "codes"],
        )


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """Ids of the words in each row's list; rows of one owner meet in one task, which encodes a word once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = WordEncoder(path, remember=1_000_000)
        for b in batches:
            ids = [own.encode(ws) for ws in b.column("words").to_pylist()]
            counts = [_packed(np.array([len(x) // 4 for x in row])) for row in ids]
            flat = [_packed(np.frombuffer(b"".join(row), "<u4")) for row in ids]
            yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("check"), b.column("places"), pa.array(counts, pa.binary()), pa.array(flat, pa.binary())], names=["chunk", "check", "places", "counts", "flat"])

    dealt = words.repartition("owner").sortWithinPartitions("owner")
    return dealt.select("chunk", "check", "places", "words").mapInArrow(encode, "chunk long, check long, places binary, counts binary, flat binary")


def decode(encoded: DataFrame, path: str, key: str, ids: str = "ids") -> DataFrame:
    """``(key, decoded)``: ids to pieces by a join, put together in order.

    The table of pieces is as large as the vocabulary file and is broadcast. This tokenizer has no
    decoder, so pieces are joined by spaces. No ids give an empty string.
    """
    table = F.broadcast(pieces(encoded.sparkSession, path))
    long = encoded.select(F.col(key), F.posexplode_outer(ids).alias("pos", "id")).join(table, "id", "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "piece"))))
    return long.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x.piece), " ").alias("decoded"))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: str = "digests") -> DataFrame:
    """Ids and decoded text of every document.

    Words are split at ASCII white space; each chunk of documents numbers its distinct words. The
    word lists, not the texts, go to owners by the hash of the word, so each distinct word of the
    corpus is encoded once; the ids go back to their chunk, and to their places in its list. A
    second pass over the documents sends the texts as numbers in that list, and puts the ids in
    their place; the decoded text comes from the joined id-to-piece table of the vocabulary.
    Both passes must number words alike, so ``docs`` has to be a scan or a written table, whose rows come in the
    same order each time; a check sum over the list stops the job otherwise.

    Result, one row per input row: ``doc_id``, ``n_tokens`` and either ``ids`` (binary,
    little-endian unsigned 32-bit) and ``decoded`` (``outputs="texts"``), or their hex SHA-256
    ``ids_sha256`` and ``decoded_sha256``. Null text counts as empty: no ids, empty decoded text.
    Repeated rows and null ids come back as they are; an empty table gives an empty result; other
    columns are not looked at.
    """
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    piece = np.array([p.encode() for p, _ in sorted(vocabulary.items(), key=lambda x: x[1])], dtype=object)
    piece = docs.sparkSession.sparkContext.broadcast(piece)  # as large as the vocabulary file
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    lists = encode_words(src.mapInArrow(_split_words, "chunk long, check long, owner int, places binary, words array<string>"), path)
    blocks = src.mapInArrow(_place_words, "chunk long, check long, ids array<long>, lengths array<int>, codes binary")
    digests = outputs == "digests"
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    fields = ", ".join(f"{n} {t}" for n, t in zip(names, ("string", "string") if digests else ("binary", "string"), strict=True))

    def assemble(rows: pa.Table, own: pa.Table) -> pa.Table:
        if len({*rows.column("check").to_pylist(), *own.column("check").to_pylist()}) > 1:
            raise ValueError("the documents came in another order on the second pass; write them to a table first")
        places = [_unpacked(x) for x in own.column("places").to_pylist()]
        counts = [_unpacked(x).astype(np.int64) for x in own.column("counts").to_pylist()]
        flat = [_unpacked(x) for x in own.column("flat").to_pylist()]
        n = sum(map(len, places))
        lengths, starts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = 0
        for p, c, f in zip(places, counts, flat, strict=True):
            lengths[p], starts[p] = c, at + np.cumsum(c) - c
            at += len(f)
        flat = np.concatenate(flat) if flat else np.empty(0, "<u4")
        # Id-to-piece join, once per distinct word of the chunk.
        pieces_of = piece.value
        decoded = [b" ".join(pieces_of[flat[a : a + k]].tolist()) for a, k in zip(starts.tolist(), lengths.tolist(), strict=True)]
        out: list[tuple] = []
        for docs_, sizes, blob in zip(rows.column("ids").to_pylist(), rows.column("lengths").to_pylist(), rows.column("codes").to_pylist(), strict=True):
            codes = _unpacked(blob).astype(np.int64)
            at = 0
            for doc, k in zip(docs_, sizes, strict=True):
                own_codes = codes[at : at + k]
                at += k
                ids = gather(own_codes, flat, starts, lengths).astype("<u4").tobytes()
                # A word of Unicode white space only has no ids, and no place in the decoded text.
                text = b" ".join([decoded[c] for c in own_codes[lengths[own_codes] > 0].tolist()])
                out.append((doc, len(ids) // 4, hashlib.sha256(ids).hexdigest() if digests else ids, hashlib.sha256(text).hexdigest() if digests else text.decode()))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.string() if digests else pa.binary(), pa.string()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[id_col, "n_tokens", *names])

    return blocks.groupBy("chunk").cogroup(lists.groupBy("chunk")).applyInArrow(assemble, f"`{id_col}` long, n_tokens long, {fields}")
