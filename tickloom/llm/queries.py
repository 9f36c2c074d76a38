"""Registered queries of the document operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


#: DuckDB: lower-casing of A-Z only.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op1_exact_dedup",
    f"""
WITH t AS (SELECT doc_id, {_LOWER} AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.body) AS text_sha256 FROM t JOIN g USING (body)""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.exact import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


@query("op2_minhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.minhash import near_dedup

    return near_dedup(documents(spark, sf_dir), shingle=2)





@query("op4_bpe_word_table")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tickloom.llm.bpe import encode_documents

    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_bounded_space_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from tickloom.llm.packing import pack

    out = pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op5_toxicity_chain")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.toxicity import toxicity

    out = toxicity(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.drop("text")


@query("op8_kd_tree_sharding")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.sharding import shard

    return shard(documents(spark, sf_dir))

#: Key of the pseudonyms in the registered query; a user passes a secret of their own.
PSEUDONYM_KEY = "tickloom-demonstration-key"


@query("op9_feistel_pseudonyms")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.pii import pseudonymize

    return pseudonymize(documents(spark, sf_dir).select("doc_id", "text"), PSEUDONYM_KEY)


@query("op6_quality_outliers")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.quality import quality

    return quality(documents(spark, sf_dir))


@query("op3_crf_language")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.language import identify

    return identify(documents(spark, sf_dir))


@query("op7_sparse_suffix_passages")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.suffix import repeated_passages

    return repeated_passages(documents(spark, sf_dir))


#: DuckDB: the table of the crc32, by its rule, and the crc32 of a list of bytes.
_CRC_TABLE = """crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i))"""


def _crc(data: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


def _utf8(text: str) -> str:
    """Bytes of a text of code points up to U+07FF."""
    return f"flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END))"


#: Roles before (e: none), inserted turns, role after.
_INSERTS = """(VALUES ('e', 'e', '', ''), ('e', 'u', 'I', '\nuser:'), ('e', 'a', 'II', '\nuser:\nassistant:'), ('s', 's', '', ''), ('s', 'u', 'I', '\nuser:'),
  ('s', 'a', 'II', '\nuser:\nassistant:'), ('u', 'u', '', ''), ('u', 'a', 'I', '\nassistant:'), ('a', 'a', '', ''), ('a', 'u', 'I', '\nuser:')) ins(q, mid, letters, rep)"""
_FOLLOWS = "(VALUES ('e', 's'), ('e', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')) f(mid, nxt)"


@query(
    "op11_glr_repair",
    rf"""
WITH RECURSIVE {_CRC_TABLE},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc(_utf8("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"))} % 20 AS f FROM conversations, crc_table),
dmg AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
  CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM o WHERE f != 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM dmg),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM p),
m AS (SELECT *, role[1] AS ini, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN again THEN 2 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 3 ELSE 0 END AS fault FROM r),
edits AS (SELECT ins.q, ini, fault, e.to_, ins.letters || e.letter AS letters, ins.rep AS rep, e.role AS role, e.keeps, 3 * length(ins.letters) + e.cost AS cost
  FROM {_INSERTS}, (SELECT DISTINCT ini, fault FROM m) kinds, LATERAL (
    SELECT ins.mid AS to_, 'D' AS letter, NULL AS role, false AS keeps, 4 AS cost
    UNION ALL SELECT f.nxt, 'K', NULL, true, CASE WHEN fault = 3 THEN 3 ELSE 0 END FROM {_FOLLOWS} WHERE f.mid = ins.mid AND f.nxt = ini AND fault IN (0, 3)
    UNION ALL SELECT f.nxt, 'R', CASE f.nxt WHEN 'u' THEN 'user' ELSE 'assistant' END, true, CASE WHEN fault = 3 THEN 6 ELSE 3 END FROM {_FOLLOWS} WHERE f.mid = ins.mid AND f.nxt != 's' AND fault IN (0, 3)) e),
z AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 'e' AS q, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS b FROM m
  UNION ALL SELECT z.conv_id, z.i + 1, edits.to_, min({{'c': z.b.c + edits.cost, 'a': z.b.a || edits.letters,
      'r': z.b.r || edits.rep || CASE WHEN edits.keeps THEN chr(10) || coalesce(edits.role, m.role) || ':' || m.text ELSE '' END}})
    FROM z JOIN m ON m.conv_id IS NOT DISTINCT FROM z.conv_id AND m.i = z.i + 1 JOIN edits ON edits.q = z.q AND edits.ini = m.ini AND edits.fault = m.fault GROUP BY 1, 2, 3),
done AS (SELECT z.conv_id, min({{'c': z.b.c + 3 * length(ins.letters), 'a': z.b.a || ins.letters, 'r': z.b.r || ins.rep}}) AS b
  FROM z JOIN (SELECT conv_id, max(i) AS last FROM m GROUP BY 1) n ON n.conv_id IS NOT DISTINCT FROM z.conv_id AND z.i = n.last JOIN {_INSERTS} ON ins.q = z.q WHERE ins.mid IN ('e', 'a') GROUP BY 1),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(b.r[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.repair import damaged_and_repaired

    return damaged_and_repaired(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet"))


@query(
    "op12_trie_frontier_variants",
    f"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS w FROM documents),
d AS (SELECT doc_id, w, count(*) AS k FROM r GROUP BY ALL),
h AS (SELECT w, k, {_crc(_utf8("doc_id::VARCHAR || ':' || w"))} AS h FROM d, crc_table),
x AS (SELECT CASE WHEN h % 97 = 0 THEN substring(w, 1, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM x WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
e AS (SELECT word, i, substring(word, 1, i - 1) || substring(word, i + 1) AS short FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word AS a, b.word AS b FROM e a JOIN e b ON a.short = b.short AND a.i = b.i AND a.word != b.word
  UNION SELECT v.word, e.word FROM v JOIN e ON e.short = v.word UNION SELECT e.word, v.word FROM v JOIN e ON e.short = v.word),
best AS (SELECT a, count(*) AS n_near, min({{'m': -v.n, 'b': near.b}}) AS best FROM near JOIN v ON v.word = near.b GROUP BY a),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * v.n THEN best.b END AS form, CASE WHEN -best.m >= 2 * v.n THEN -best.m END AS form_n
  FROM v LEFT JOIN best ON best.a = v.word),
chain AS (SELECT word, word AS root FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, chain.root, f.n, f.n_near, f.form_n FROM f JOIN chain USING (word) JOIN f last ON last.word = chain.root AND last.form IS NULL""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.variants import spelling_variants

    return spelling_variants(documents(spark, sf_dir))


@query("op13_ftrl_quality")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.ftrl import quality_scores

    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
