"""The queries opN_<name> over whole tables, their SQL, and the registry that the entry module adds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.llm import ann, bitslice, chat, jaccard, langid, lm, mixing, packing, suffix, toxicity
from weftnet.llm.common import WORD, id_crc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_files() -> dict:
    import public_tokenizers

    return {"rank_file": public_tokenizers.path("byte_bpe_50k.tiktoken"), "json_file": public_tokenizers.path("byte_bpe_50k.json"), "pattern": public_tokenizers.PATTERN}


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"), id_crc() % 3 == 1)


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_documents(table(spark, sf_dir, "documents"), **tokenizer_files()))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), id_crc() % 5 != 0)
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.remove_repeats(table(spark, sf_dir, "documents")))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lm.train(docs, id_crc() % 7 != 2, order=3)
    scored = lm.score(docs, model)
    return scored.select("doc_id", (id_crc() % 7 == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), *[F.round(c, 6).alias(c) for c in ("base_score", "score")])


def op9_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, (1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM t),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM l),
c AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS copies,
             CASE WHEN source_size > 0 THEN round(target)::BIGINT % source_size ELSE 0 END AS budget FROM g),
p AS (SELECT source, place, sum(size) AS here, sum(sum(size)) OVER (PARTITION BY source ORDER BY place) - sum(size) AS before FROM d GROUP BY source, place)
SELECT d.doc_id, d.size, c.source_size, c.target,
       (d.size * c.copies + CASE WHEN d.size = 0 THEN 0 WHEN p.before + p.here <= c.budget THEN d.size
                                 WHEN p.before <= c.budget THEN floor(d.size * (c.budget - p.before)::DOUBLE / p.here) ELSE 0 END)::BIGINT AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.place = p.place
"""


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    messages = rows.unionByName(more).select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    return chat.digest(chat.read_back(chat.format_chats(messages)))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '{WORD}')"

OP6_SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS x FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT r.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(reached)::BIGINT AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP7_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(n - 99)) AS i FROM d WHERE n >= 100)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
      FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM m)),
x AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, g),
y AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM x),
k AS (SELECT y.doc_id, count(*) AS spans, sum(b - a) AS gone, max(b) AS last, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM y JOIN d ON d.doc_id = y.doc_id GROUP BY y.doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(k.gone, 0)::BIGINT AS n_removed, coalesce(k.spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k.kept, '') || substr(h, 2 * coalesce(k.last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

#: crc32 of the id as text, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
       lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)))"""


def _discounts(of: str) -> str:
    """Modified Kneser-Ney discounts of a table of counts k, as in lm.discounts."""
    count = ", ".join(f"(count(*) FILTER (k = {i}))::DOUBLE AS n{i}" for i in (1, 2, 3, 4))
    d = {1: ("1 - 2 * y * n2 / n1", 1.0), 2: ("2 - 3 * y * n3 / n2", 2.0)}
    d[3] = (f"CASE WHEN n3 > 0 THEN 3 - 4 * y * n4 / n3 ELSE least(greatest({d[2][0]}, 0.05), 2.0) END", 3.0)
    shown = ", ".join(f"CASE WHEN n1 > 0 AND n2 > 0 THEN least(greatest({x}, 0.05::DOUBLE), {top}::DOUBLE) ELSE 0.5::DOUBLE END AS d{i}" for i, (x, top) in d.items())
    return f"(SELECT {shown} FROM (SELECT *, n1 / (n1 + 2 * n2) AS y FROM (SELECT {count} FROM {of})))"


def _discount(k: str, d: str) -> str:
    return f"CASE WHEN {k} IS NULL THEN 0 WHEN {k} = 1 THEN {d}.d1 WHEN {k} = 2 THEN {d}.d2 ELSE {d}.d3 END"


def _follow(of: str, context: str) -> str:
    """Sums by context of a table of counts k: their sum and how many are 1, 2, more."""
    return f"(SELECT {context}, sum(k)::DOUBLE AS k, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, count(*) FILTER (k > 2) AS n3 FROM {of} GROUP BY ALL)"


OP8_SQL = f"""
WITH t AS (SELECT doc_id, {_CRC} % 7 = 2 AS held_out, list_append({_WORDS}, chr(10)) AS w FROM documents),
f AS (SELECT doc_id, held_out, unnest(w) AS w, unnest(list_concat([chr(32)], w[:-2])) AS h, unnest(list_concat([chr(32), chr(32)], w[:-3])[:len(w)]) AS g FROM t),
c AS (SELECT w, count(*) AS k FROM f WHERE NOT held_out GROUP BY w),
z AS (SELECT sum(k)::BIGINT AS n, count(*)::BIGINT AS v FROM c),
p3 AS (SELECT g, h, w, count(*) AS k FROM f WHERE NOT held_out GROUP BY g, h, w),
p2 AS (SELECT h, w, count(*) AS k FROM p3 GROUP BY h, w),
p1 AS (SELECT w, count(*) AS k FROM p2 GROUP BY w),
x3 AS {_follow("p3", "g, h")}, x2 AS {_follow("p2", "h")},
d1 AS {_discounts("p1")}, d2 AS {_discounts("p2")}, d3 AS {_discounts("p3")},
s AS (SELECT sum({_discount("p1.k", "d1")}) AS spare, sum(p1.k)::DOUBLE AS types FROM p1, d1),
l1 AS (SELECT f.*, c.k AS known, z.n, z.v, (coalesce(p1.k, 0) - {_discount("p1.k", "d1")} + s.spare / (z.v + 1)) / s.types AS one
       FROM f CROSS JOIN z CROSS JOIN s CROSS JOIN d1 LEFT JOIN c ON c.w = f.w LEFT JOIN p1 ON p1.w = f.w),
l2 AS (SELECT l1.*, CASE WHEN x2.k IS NULL THEN one ELSE (coalesce(p2.k, 0) - {_discount("p2.k", "d2")} + (d2.d1 * x2.n1 + d2.d2 * x2.n2 + d2.d3 * x2.n3) * one) / x2.k END AS two
       FROM l1 CROSS JOIN d2 LEFT JOIN p2 ON p2.h = l1.h AND p2.w = l1.w LEFT JOIN x2 ON x2.h = l1.h),
l3 AS (SELECT l2.*, CASE WHEN x3.k IS NULL THEN two ELSE (coalesce(p3.k, 0) - {_discount("p3.k", "d3")} + (d3.d1 * x3.n1 + d3.d2 * x3.n2 + d3.d3 * x3.n3) * two) / x3.k END AS three
       FROM l2 CROSS JOIN d3 LEFT JOIN p3 ON p3.g = l2.g AND p3.h = l2.h AND p3.w = l2.w LEFT JOIN x3 ON x3.g = l2.g AND x3.h = l2.h)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count(known)::BIGINT AS n_known, max(n)::BIGINT AS train_tokens,
       round(sum(log10((coalesce(known, 0) + 1) / (n + v + 1)::DOUBLE)), 6) AS base_score, round(sum(log10(three)), 6) AS score
FROM l3 GROUP BY doc_id, held_out
"""

OP10_SQL = rf"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
x AS (SELECT *, replace(replace(role, '\', '\\'), chr(10), '\n') AS shown FROM m)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(chat.TURN)} + length(shown) + len(regexp_extract_all(shown, '{chat.FOUND}')) + 1 + length(text) + len(regexp_extract_all(text, '{chat.FOUND}')) + {len(chat.END)})::BIGINT AS formatted_chars
FROM x GROUP BY conv_id
"""

QUERIES = {
    "op1_language_id": op1_language_id,
    "op4_pack_sequences": op4_pack_sequences,
    "op2_mix_sources": op2_mix_sources,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_lm_scores": op8_lm_scores,
    "op9_bit_sliced_top_k": op9_bit_sliced_top_k,
    "op10_chat_format": op10_chat_format,
}
ORACLE_SQL = {"op6_ngram_jaccard": OP6_SQL, "op7_suffix_dedup": OP7_SQL, "op8_lm_scores": OP8_SQL, "op9_bit_sliced_top_k": OP9_SQL, "op2_mix_sources": OP2_SQL, "op10_chat_format": OP10_SQL}
