"""Conversation repair, spelling variants and the quality classifier: edge cases, brute-force versions, twins."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm.ftrl import WEIGHTS, features, fit, quality_scores, score, training_rows
from tickloom.llm.queries import ORACLES, QUERIES
from tickloom.llm.repair import Parser, cheapest, damaged, damaged_and_repaired, repair_report, repaired_turns
from tickloom.llm.variants import near_words, spelling_variants, variant_forms, word_counts

SF = "/root/testdata/sf0.001"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def plain_repair(rows):
    """Backwards over rows ``(initial, fault)``: least cost and audit from each role that may stand before."""
    best = None
    for i in range(len(rows), -1, -1):
        now = {}
        for q in NEXT:
            ways = [(0, "")] if i == len(rows) and q in ("", "a") else []
            if i < len(rows):
                initial, fault = rows[i]
                ways.append((best[q][0] + 4, "D" + best[q][1]))
                if fault in (0, 3):
                    if initial and initial in NEXT[q]:
                        ways.append((best[initial][0] + fault, "K" + best[initial][1]))
                    ways += [(best[t][0] + fault + 3, "R" + best[t][1]) for t in "ua" if t in NEXT[q]]
            now[q] = min(ways) if ways else (10**9, "")
        for _ in range(4):
            for q in NEXT:
                now[q] = min([now[q], *[(now[t][0] + 3, "I" + now[t][1]) for t in "ua" if t in NEXT[q]]])
        best = now
    return best[""]


def random_rows(rng, n):
    return tuple((rng.choice(["u", "a", "s", ""]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n))


def test_parser_against_plain_repair():
    rng = random.Random(7)
    for _ in range(3000):
        rows = random_rows(rng, rng.randint(0, 9))
        assert cheapest(rows) == plain_repair(rows)
    rows = random_rows(rng, 3000)
    parser, audit, open_ = Parser(), "", 0
    for i in range(0, len(rows), 50):
        audit += parser.feed(rows[i : i + 50])
        open_ = max(open_, *[len(a) for _, a, _ in parser.frontier.values()])
    cost, rest = parser.finish()
    assert (cost, audit + rest) == plain_repair(rows) and open_ < 50


TURNS = [
    (1, 0, "user", "Hi there."),
    (1, 1, "assistant", "Well,"),
    (2, None, None, "x."),
    (2, 0, "user", None),
    (2, 0, "user", ""),
    (2, 5, "system", "s."),
    (None, 0, "assistant", "No one asked."),
    (3, 1, "user", "same."),
    (3, 1, "user", "same."),  # repeated row
    (3, 2, "user", "same."),
    (4, 3, "tool", "long text. " * 30_000),
    (5, None, "user", "\t \n"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_report_of_odd_rows(spark):
    turns = spark.createDataFrame(TURNS, SCHEMA).withColumn("a.b", F.lit(1)).withColumn("fault", F.lit("x")).withColumn("h", F.lit(2))
    got = {r.conv_id: r for r in repair_report(turns).collect()}
    assert (got[1].cost, got[1].audit, got[1].truncated) == (3, "KK", 1)
    assert got[1].repaired_sha256 == hashlib.sha256(b"user:Hi there.\nassistant:Well,").hexdigest()
    # the two rows with text become a user's and an assistant's
    assert (got[2].blank, got[2].gaps, got[2].illegal, got[2].audit, got[2].cost) == (2, 4, 3, "RDDR", 14)
    assert (got[None].audit, got[None].cost) == ("IK", 3)
    assert (got[3].duplicate, got[3].audit, got[3].cost) == (2, "KDDI", 11)
    assert (got[4].audit, got[4].cost) == ("D", 4)
    assert (got[5].gaps, got[5].blank, got[5].audit, got[5].repaired_sha256) == (0, 1, "D", hashlib.sha256(b"").hexdigest())
    rows = sorted(repaired_turns(turns).where("conv_id = 3").collect(), key=lambda r: r.position)
    assert [(r.role, r.text, r.edit) for r in rows] == [("user", "same.", "K"), ("assistant", "", "I")]
    empty = turns.where("false")
    assert repair_report(empty).count() == repaired_turns(empty).count() == damaged_and_repaired(empty).count() == 0
    everything = {r.conv_id: r for r in damaged_and_repaired(turns).collect()}
    assert set(everything) == {1, 2, 3, 4, 5, None}


def test_long_conversation_is_streamed(spark):
    rng = random.Random(3)
    rows = [(9, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", f"t{i}."])) for i in range(5000)]
    seen, marked = set(), []
    for _, _, role, text in rows:
        fault = 2 if (role, text) in seen else 0 if text[-1] == "." else 3
        seen.add((role, text))
        marked.append((role[0], fault))
    got = repair_report(spark.createDataFrame(rows, SCHEMA)).first()
    assert (got.cost, got.audit) == plain_repair(marked)
    out = sorted(repaired_turns(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.position)
    assert got.repaired_sha256 == hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in out).encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_glr_repair", "op12_trie_frontier_variants"])
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    want = {r[0]: tuple(r) for r in rel.fetchall()}
    got = {r[0]: tuple(r) for r in QUERIES[name](spark, SF).select(*names).collect()}
    assert got == want


def test_every_damage_occurs(spark):
    turns = spark.range(400).selectExpr("id AS conv_id", "0L AS turn", "'assistant' AS role", "'Wait! Really? Yes.' AS text")
    kinds = Counter((r.role, r.text) for r in damaged(turns).collect())
    want = Counter()
    for i in range(400):
        k = zlib.crc32(f"{i}:0".encode()) % 20
        if k:
            text = "" if k == 1 else "Wait Really Yes" if k == 2 else "Wait! Really? Yes."
            want["user" if k == 4 else "assistant", text] += 2 if k == 3 else 1
    assert kinds == want


def plain_variants(counts):
    near = defaultdict(set)
    gone = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            gone[w[:i] + w[i + 1 :]].add((i, w))
    for short, places in gone.items():
        for i, w in places:
            if short in counts:
                near[w].add(short)
                near[short].add(w)
            near[w] |= {x for j, x in places if i == j and x != w}
    out = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        out[w] = (best if best is not None and counts[best] >= 2 * n else None, len(near[w]))
    return out


def test_variants_against_plain_version(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(400)}
    base = ["x" * 64, "x" * 65, "x" * 66, "y" * 200, "y" * 199 + "z", "z" + "y" * 199, "y" * 100 + "q" + "y" * 100, "ab" * 2000, "ab" * 1000 + "ba" + "ab" * 999]
    counts = {w: rng.randint(1, 40) for w in sorted(words) + base}
    got = {r.word: r for r in variant_forms(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    want = plain_variants(counts)
    assert {w: (r.form, r.n_near) for w, r in got.items()} == want
    for w, r in got.items():
        root = w
        while want[root][0] is not None:
            root = want[root][0]
        assert r.root == root and r.form_n == (None if r.form is None else counts[r.form])


def test_variants_of_odd_documents(spark, docs, empty):
    many = docs.withColumn("a.b", F.lit(1)).withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    got = {r.word: r.n for r in word_counts(many, damage=0).collect()}
    assert got["cat"] == 3 and got["école"] == 1 and got["École"] == 1 and got["w"] == 60_000
    assert spelling_variants(empty).count() == 0 and spelling_variants(many).count() == 0
    assert near_words(spark.createDataFrame([], "word string, n long")).count() == 0


def test_features_are_hashed_ngrams():
    at, value = features(b"The cat the CAT")
    assert len(at) == len(set(at)) and at.max() < WEIGHTS and abs((value**2).sum() - 1) < 1e-6
    assert (features(b"the cat the cat")[0] == at).all()
    assert len(features(b"")[0]) == len(features(b" \n\t")[0]) == 0
    one = features(b"the")
    assert len(one[0]) == 2  # the word and its shape


def test_quality_classifier_learns(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["red", "green", "blue"] if i % 5 else ["junk", "spam", "red"], 12)), int(i % 5 > 0)) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = table.select("doc_id", "quality", F.lit(0).alias("toxic"))
    out = quality_scores(table.drop("quality").withColumn("a.b", F.lit(1)).withColumn("score", F.lit("own")), labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    held = out.join(labels, "doc_id").where("held_out").collect()
    assert len(held) > 100 and np.mean([r.predicted == r.quality for r in held]) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)


def test_held_out_labels_teach_nothing(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "'some text' AS text")
    held = docs.where("crc32(cast(doc_id AS string)) % 4 = 2")
    rows, _, share = training_rows(docs, held.selectExpr("doc_id", "1 AS quality"))
    assert rows.count() == 0 and share == 0.0


def test_quality_of_odd_documents(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (99, 0), (5, None)], "doc_id long, quality int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    same = {r.doc_id: r.score for r in got if r.doc_id in (3, 4, 7)}
    assert len(set(same.values())) == 1  # empty, null and blank texts have the bias alone
    assert quality_scores(empty, labels).count() == 0
    nothing = quality_scores(docs, labels.where("false")).collect()
    assert {r.score for r in nothing} == {0.5}
    assert not next(r for r in got if r.doc_id is None).held_out


def test_quality_on_the_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op13_ftrl_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    order = out.score.rank()
    ones, zeros = (out.quality == 1).sum(), (out.quality == 0).sum()
    area = (order[out.quality == 1].sum() - ones * (ones + 1) / 2) / (ones * zeros)
    assert area > 0.98 and (out.predicted == out.quality).mean() > 0.93


def test_fit_without_rows(spark):
    rows = spark.createDataFrame([], "luck long, label int, at array<int>, value array<float>, part int")
    assert score(spark.createDataFrame([(1, "a")], "doc_id long, text string"), fit(rows, 0.0)).first().score == 0.5
