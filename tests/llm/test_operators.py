"""Edge cases, brute-force twins and round trips of the document operators."""

import hashlib
import zlib
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import suffix
from tickloom.llm.bpe import decode, encode_documents
from tickloom.llm.common import stage
from tickloom.llm.exact import deduplicated, exact_dedup, grow_directory
from tickloom.llm.language import fit, identify, predict, training_rows
from tickloom.llm.minhash import _WordHash, near_dedup, one_per_group
from tickloom.llm.packing import pack
from tickloom.llm.pii import pseudonymize
from tickloom.llm.quality import quality
from tickloom.llm.queries import ORACLES, QUERIES
from tickloom.llm.sharding import shard
from tickloom.llm.suffix import GRAM, _rolling, repeated_passages
from tickloom.llm.toxicity import Chain, fit_chain, score_toxicity, toxicity, without_toxic
from tickloom.llm.wordbpe import WordEncoder, WordTable

SMALL = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("word_bpe_49k.json")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_exact(docs, empty):
    rows = exact_dedup(docs).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: r for r in rows}
    assert (got[1].keep_id, got[1].group_size, got[1].kept) == (2, 3, False)
    assert sorted(r.kept for r in rows if r.doc_id == 2) == [False, True]  # of repeated rows one stays
    assert got[3].keep_id == got[4].keep_id == 4 and got[3].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[8].group_size == 1  # only A-Z are folded
    assert got[None].kept and got[None].keep_id is None
    kept = deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == 8
    assert exact_dedup(empty).count() == 0 and deduplicated(empty).count() == 0


def test_exact_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.execute(ORACLES["op1_exact_dedup"]).df().sort_values("doc_id")
    got = QUERIES["op1_exact_dedup"](spark, SMALL).toPandas().sort_values("doc_id")
    assert (got[want.columns].to_numpy() == want.to_numpy()).all()


def test_directory_splits_until_buckets_fit():
    cells = {i: 10 for i in range(0, 256, 2)} | {7: 500}
    depth, directory = grow_directory(cells, 100, 8)
    load = {}
    for c, n in cells.items():
        load.setdefault(directory[c >> (8 - depth)], []).append((c, n))
    assert all(sum(n for _, n in v) <= 100 or len(v) == 1 for v in load.values())


def test_near(docs, empty):
    got = by_id(near_dedup(docs, shingle=2))
    assert got[1].component_id == got[2].component_id == 1 and not got[2].kept
    assert got[6].component_id == 5 and got[5].kept
    for d in (3, 4, 7):
        assert got[d].n_shingles == 0 and got[d].component_id == d and got[d].kept
    assert got[None].component_id is None and got[None].kept
    kept = one_per_group(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 7, 8, 9, None}
    assert near_dedup(empty).count() == 0


def test_near_against_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = set(zip(w, w[1:], strict=False)) if len(w) > 1 else set(w)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    got = by_id(QUERIES["op2_minhash_near_dedup"](spark, SMALL))
    assert {d: r.component_id for d, r in got.items()} == {d: find(d) for d in sets}
    assert all(got[d].n_shingles == len(s) for d, s in sets.items())


def test_language(spark, docs, empty):
    train = [("the cat and the dog are in the house\n" * 5, "en"), ("le chat et le chien sont dans la maison\n" * 5, "fr")] * 20
    model = fit(train)
    got = by_id(predict(docs, model))
    assert got[1].lang_pred == "en" and got[3].lang_pred == got[4].lang_pred == got[7].lang_pred == "und"
    mixed = spark.createDataFrame([(1, "the dog and the cat le chien et le chat dans la maison")], "doc_id long, text string")
    share = predict(mixed, model).first().shares
    assert min(share) > 0.2
    assert identify(empty).count() == 0
    out = QUERIES["op3_crf_language"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() >= 0.97 * out.count()


def test_number_signs_are_no_letters(spark):
    model = fit([("the cat and the dog\n" * 5, "en"), ("le chat et le chien\n" * 5, "fr")] * 10)
    odd = spark.createDataFrame([(1, "½ ²"), (2, "Ⅷ ①"), (3, "x½")], "doc_id long, text string")
    got = by_id(predict(odd, model))
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[3].lang_pred != "und"


def test_language_rows_of_a_rare_language(spark):
    sizes = {"en": 6000, "fr": 1500, "xx": 60}
    rows = [(i, f"{lang} text {i}", lang) for lang, n in sizes.items() for i in range(n)]
    rows += [(i, "one text many times", "xx") for i in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = Counter(lang for _, lang in training_rows(d, sample=90))
    assert got == {"en": 30, "fr": 30, "xx": 30}


def test_bpe_round_trip(spark, docs, empty):
    t = Tokenizer.from_file(BPE)
    out = encode_documents(docs, BPE, outputs="texts")
    for r, src in zip(sorted(out.collect(), key=lambda r: (r.doc_id or 0, r.n_tokens)), sorted(docs.collect(), key=lambda r: (r.doc_id or 0, len(r.text or ""))), strict=True):
        want = t.encode(src.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.decoded == t.decode(want, skip_special_tokens=False)
    again = decode(spark.createDataFrame([(1, t.encode("It's odd <|endoftext|> 日本!").ids), (2, [])], "k long, ids array<int>"), BPE, "k").collect()
    assert {r.k: r.decoded for r in again} == {1: t.decode(t.encode("It's odd <|endoftext|> 日本!").ids, skip_special_tokens=False), 2: ""}
    assert encode_documents(empty, BPE).count() == 0


def test_bpe_words_without_ids(spark):
    t = Tokenizer.from_file(BPE)
    texts = ["a \u00a0 b", "\u3000 \u00a0", "\u0085 end", "a\u00a0b \u3000"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = by_id(encode_documents(d, BPE, outputs="texts"))
    for i, text in enumerate(texts):
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want and got[i].decoded == t.decode(want, skip_special_tokens=False)


def test_toxicity(docs, empty, spark):
    rows = [({f"w{i}", "vile"} if i % 3 == 0 else {f"w{i}", "fine"}, (0, int(i % 3 == 0), int(i % 3 == 0))) for i in range(90)]
    chain = fit_chain(rows)
    two = spark.createDataFrame([(1, "Vile, w1!"), (2, "fine"), (3, None), (4, "")], "doc_id long, text string")
    assert [r.toxic_rejected for r in score_toxicity(two, chain).orderBy("doc_id").collect()] == [True, False, False, False]
    clash = docs.withColumn("p_toxic", F.lit(1))
    assert "p_toxic_" in score_toxicity(clash, chain).columns
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert without_toxic(docs, labels).count() == docs.count() and without_toxic(empty, labels).count() == 0
    assert isinstance(chain, Chain) and chain.scores(np.zeros((1, len(chain.words)))).shape == (1, 3)


def test_toxicity_of_few_toxic_labels(spark):
    """One toxic text in 200, each with one of five words; all toxic labels are learned from, and the share of toxic texts is kept."""
    rng = np.random.default_rng(3)
    vile = ["grubnak", "skorvel", "thrimbo", "quazzet", "plunfek"]
    some = lambda: ["".join(x) for x in rng.choice(list("abcdefghij"), (20, 3))]
    rows = [(i, " ".join([*some(), *([vile[i // 200 % 5]] if i % 200 == 0 else [])])) for i in range(8000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 200 == 0)) for i in range(8000)], "doc_id long, quality int, toxic int")
    rejected = {r.doc_id for r in toxicity(d, labels).where("toxic_rejected").collect()}
    assert rejected == set(range(0, 8000, 200))


def test_quality(docs, empty):
    got = by_id(quality(docs))
    assert got[4].n_words == 0 and got[4].base_failed and not got[4].kept
    assert got[5].n_words == 30_000 and got[5].n_repeat_words == 0
    assert quality(empty).count() == 0


def test_passages(docs, empty):
    out = repeated_passages(docs).collect()
    assert {(r.doc_id, r.start, r.stop) for r in out} == {(5, 0, 30_000), (6, 0, 30_000)}
    assert repeated_passages(empty).count() == 0


def passages_by_brute_force(words):
    """(document, word number) of every word in a run of 50 that another document has too."""
    seen = {}
    for d, w in words.items():
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), set()).add(d)
    return {(d, p) for d, w in words.items() for i in range(len(w) - 49) if len(seen[tuple(w[i : i + 50])]) > 1 for p in range(i, i + 50)}


def covered(spans):
    return {(r.doc_id, p) for r in spans.collect() for p in range(r.start, r.stop)}


def test_passages_against_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    words = {r.doc_id: (r.text or "").encode().lower().split() for r in rows}
    assert covered(QUERIES["op7_sparse_suffix_passages"](spark, SMALL)) == passages_by_brute_force(words)


@pytest.mark.parametrize("own", [40, 70])
def test_passages_around_a_line_of_all_documents(spark, own):
    """Every document holds one line; pairs share words before it, after it or on both sides, other documents sort between."""
    rng = np.random.default_rng(7)
    text = [f"line{i}" for i in range(100_000)]
    at = int(_rolling(np.fromiter(map(_WordHash().__getitem__, (w.encode() for w in text)), np.uint64, len(text)), GRAM)[:-20].argmin())
    line = text[at : at + 20]  # its first place is a minimiser of all windows that hold it
    some = lambda n: [f"w{x}" for x in rng.integers(0, 1_000_000, n)]
    words = {}
    for pair in range(120):
        behind, ahead = [(32, 0), (0, 32), (15, 16), (29, 0)][pair % 4]  # the last shares 49 words only
        left, right = some(behind), some(ahead)
        for d in (pair, 1000 + pair):
            words[d] = some(own - behind) + left + line + right + some(own - ahead)
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in words.items()], "doc_id long, text string").repartition(5)
    want = passages_by_brute_force(words)
    assert {d for d, _ in want} == {d for d in words if d % 1000 % 4 != 3}
    assert covered(repeated_passages(df)) == want


def test_passages_with_a_line_many_times_in_one_document(spark):
    """The other document's rows come batches and partitions after most rows of the first."""
    line = [f"l{i}" for i in range(12)]
    words = {1: line * 3000, 2: line * 20, 3: [f"w{i}" for i in range(60)] + line * 6, 4: [f"v{i}" for i in range(200)]}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in words.items()], "doc_id long, text string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        assert covered(repeated_passages(df)) == passages_by_brute_force(words)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("most", [2, 20])
def test_passages_of_a_prefix_beyond_one_task(spark, monkeypatch, most):
    """A prefix of more suffixes than a task compares: rows are parted by shared words, down to one split of a passage."""
    monkeypatch.setattr(suffix, "MOST", most)
    rng = np.random.default_rng(11)
    text = [f"line{i}" for i in range(100_000)]
    at = int(_rolling(np.fromiter(map(_WordHash().__getitem__, (w.encode() for w in text)), np.uint64, len(text)), GRAM)[:-20].argmin())
    line, left, right = text[at : at + 20], [f"l{i}" for i in range(40)], [f"r{i}" for i in range(40)]
    words = {}
    for d in range(90):  # the same words around the line, some of them changed
        before, after = list(left), list(right)
        for side in (before, after):
            for i in rng.integers(0, 40, rng.integers(0, 3)):
                side[i] = f"x{rng.integers(0, 4)}"
        words[d] = before[rng.integers(0, 30) :] + line + after[: rng.integers(10, 40)]
    words |= {100 + d: words[d] for d in range(9)}
    words[200] = line * 40
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in words.items()], "doc_id long, text string").repartition(5)
    assert covered(repeated_passages(df)) == passages_by_brute_force(words)


def test_passages_stage_less_than_the_texts(spark, monkeypatch):
    """A text's words are staged once, whatever the number of its suffixes and of ways to split a passage around them."""
    paths = []

    def staged(df, label):
        out = stage(df, label)
        paths.append(out[1])
        return out

    monkeypatch.setattr(suffix, "stage", staged)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    repeated_passages(docs).count()
    size = sum(f.stat().st_size for p in paths for f in Path(p).rglob("*.parquet"))
    assert size < 0.6 * docs.agg(F.sum(F.octet_length("text"))).first()[0]


def test_shards(docs, empty, spark):
    out = shard(docs, shards=3).collect()
    assert len(out) == docs.count() and {r.law for r in out} == {"bytes"}
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert shard(empty).count() == 0


def test_shards_keep_equal_texts_and_bytes_near_equal(spark):
    rows = [(i, f"text {i} " + "x" * (i * 37 % 500), "s", "en") for i in range(3000)]
    rows += [(10_000 + i, "copy " * 10, "s", "en") for i in range(400)]  # two thirds of a shard
    rows += [(20_000 + i, "many " * 20, "t", "de") for i in range(2000)]  # several shards
    rows += [(30_000 + i, None, None, None) for i in range(30)]
    out = shard(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), shards=20).collect()
    load, places = Counter(), {}
    text = {r[0]: r[1] for r in rows}
    for r in out:
        load[r.shard] += r.size
        places.setdefault(text[r.doc_id], set()).add(r.shard)
    whole = sum(load.values()) / 20
    assert len(out) == len(rows) and set(load) == set(range(20))
    assert max(load.values()) < 1.05 * whole and min(load.values()) > 0.95 * whole
    assert [t for t, s in places.items() if len(s) > 1] == ["many " * 20]


@pytest.mark.parametrize("stage", ["toxicity", "exact dedup", "near dedup", "personal data"])
def test_stages_keep_odd_columns(spark, docs, stage):
    import corpus_pipeline

    odd = docs.withColumn("a.b", F.lit(1)).withColumn("n_replaced", F.lit("own"))
    out = dict(corpus_pipeline.STAGES)[stage](spark, odd, SMALL)
    assert out.columns == odd.columns and out.count() <= odd.count()


def test_pseudonyms(docs, empty, spark):
    text = "write to und.34@mail7.example.com, +1 (656) 555-6669, 4795326016703902, 208.240.42.236, 1984-02-29, 123-45-6789; not 2852466340876421"
    d = spark.createDataFrame([(1, text), (2, "656-555-6669 again"), (3, None)], "doc_id long, text string")
    new = pseudonymize(d, "key")
    a, b, c = sorted(new.collect())
    assert a.n_replaced == 6 and c.text is None and "2852466340876421" in a.text
    for secret in ("und.34@", "555-6669", "4795326016703902", "208.240.42.236", "1984-02-29", "123-45-6789"):
        assert secret not in a.text
    assert a.text.split("+1 ")[1][:14].replace("(", "").replace(") ", "-") == b.text[:12]  # linked
    back = pseudonymize(new.drop("n_replaced"), "key", inverse=True)
    assert sorted(r.text for r in back.collect() if r.text) == sorted([text, "656-555-6669 again"])
    assert pseudonymize(docs, "k").columns == [*docs.columns, "n_replaced"] and pseudonymize(empty, "k").count() == 0


def test_pseudonyms_of_cards_beside_other_digits(spark):
    """Luhn-valid cards before an expiry date or a security code, or after a short number, go and come back."""
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1111", "3782 822463 10005", "4795326016703902"]
    texts = [f"{a}{c}{b}" for c in cards for a, b in [("", " 05/27"), ("", " 123"), ("2 ", ""), ("7 ", " 12"), ("", "")]]
    texts += [f"4111 1111 1111 1111 {i}" for i in range(100, 160)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = pseudonymize(d, "key").drop("n_replaced")
    got = by_id(new)
    assert [t for i, t in enumerate(texts) if any(c in got[i].text for c in cards)] == []
    assert all(len(got[i].text) == len(t) for i, t in enumerate(texts))
    back = by_id(pseudonymize(new, "key", inverse=True))
    assert [back[i].text for i in range(len(texts))] == texts
    other = spark.createDataFrame([(1, "4111 1111 1111 1112 05/27 and 12 34 56 78 90 12 34 56 78")], "doc_id long, text string")
    assert pseudonymize(other, "key").first().text == other.first().text


@pytest.mark.parametrize("size", [64, 4096])
def test_packing(docs, empty, size):
    t = Tokenizer.from_file(BPE)
    out = pack(docs, BPE, size=size, open_windows=4).collect()
    pieces, windows = {}, {}
    for r in sorted(out, key=lambda r: (r.doc_tokens, r.start)):
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id not in (2,):
            pieces.setdefault(r.doc_id, []).append(r)
    for src in docs.where("doc_id != 2").collect():
        want = np.array([*t.encode(src.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert b"".join(r.ids for r in pieces[src.doc_id]) == want
        assert all(zlib.crc32(r.ids) and r.doc_tokens == len(want) // 4 for r in pieces[src.doc_id])
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= size
    assert sum(sum(n for _, n in w) < size for w in windows.values()) <= 4
    assert pack(empty, BPE).count() == 0


def test_word_table(monkeypatch):
    """Ids are the library's for words with marks, other alphabets and odd spaces; plain words beside marks share one call."""
    t = Tokenizer.from_file(BPE)
    words = "Straße straße, MASSE&&& ending*** (word) it's we'll don't, a_b a_ 'tis x<|endoftext|> y<| end.) É%%% é~ ÿ` ß ß# 日本! İstanbul ǅ 12,5 3% - ... &&& a\u0338 a=\u0338 ﬁn x\x1cy \x85".split(" ")
    rng = np.random.default_rng(3)
    lines = ["", None, "  ", " lead", "trail\t\x0b\n", *(" ".join(rng.choice(words, 30)) for _ in range(200)), *words]
    lines += ["".join(rng.choice([*"abÉß&.,-'*<>|_~\"1日 "], 40)) for _ in range(300)]
    for most in (700_000, 20):
        table = WordTable(BPE, most=most)
        for texts in (lines, lines[::-1]):
            got = [x for i in range(0, len(texts), 40) for x in table.encode(pa.array(texts[i : i + 40], pa.string()))]
            assert [x.tolist() for x in got] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert table.encode(pa.array([], pa.string())) == []
    own, calls = WordEncoder(BPE), []
    monkeypatch.setattr(own, "tokenizer", SimpleNamespace(encode_batch_fast=lambda x, **k: (calls.extend(x), t.encode_batch_fast(x, **k))[1], encode=t.encode))
    own.encode([a + b for a in ("straße", "lichß", "word") for b in ("", ",", "&&&", "***", "%)")])
    assert sorted(calls) == sorted(["straße lichß word", ",", "&&&", "***", "%)"])


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    out = QUERIES["pipeline"](spark, SMALL)
    assert out.count() > 100 and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "personal data", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
