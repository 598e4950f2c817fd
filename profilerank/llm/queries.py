"""Registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from profilerank.llm import (
    chat, compression, decontaminate, minhash, mixing, packing, phrases, repeats, spelling, tokens, vectors, whitening,
)

TOKENIZER = "byte_bpe_50k"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def tokenizer_files() -> dict[str, str]:
    """The tokenizer and its ranks, where the package of public tokenizers lies on every machine."""
    return {"tokenizer": public_tokenizers.path(f"{TOKENIZER}.json"),
            "ranks": public_tokenizers.path(f"{TOKENIZER}.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as pieces of sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), **tokenizer_files())


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that occur earlier."""
    return phrases.digest(phrases.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 400-byte strings that occur elsewhere."""
    return repeats.digest(repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role")
    rows = rows.union(extra.withColumn("text", F.lit(CONTROL_TEXT)))
    return chat.digests(chat.formatted(chat.canonical_turns(rows)))


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length('<turn:' || replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') || '>'
                   || replace(replace(text, '\', '\b'), '<', '\l') || '</turn>') AS n FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items in every document."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return tokens.token_counts(table(spark, sf_dir, "documents"), **tokenizer_files())


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    return compression.language_ids(docs, compression.fit_languages(docs))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and class of every embedding."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return compression.toxicity(docs, compression.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of the vocabulary."""
    return spelling.variants(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE steps(i, bit, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, bit + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE bit < 8),
crc_table AS (SELECT list(c ORDER BY i) AS entries FROM steps WHERE bit = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
lowered AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, count(*) AS k
  FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT low, k, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(id || ':' || low))),
      lambda i: ('0x' || substr(hex(encode(id || ':' || low)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM lowered, crc_table),
made AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(low, 1, (h % length(low))::BIGINT) || substr(low, (h % length(low))::BIGINT + 2) ELSE low END AS word, k
  FROM hashed),
vocab AS (SELECT word, sum(k)::BIGINT AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab),
holes AS (SELECT word, n, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS p FROM places),
cuts AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS p FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.p = b.p AND a.word <> b.word
  UNION ALL SELECT c.word, v.word, v.n FROM cuts c JOIN vocab v ON c.p = v.word
  UNION ALL SELECT v.word, c.word, c.n FROM cuts c JOIN vocab v ON c.p = v.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS near, max(m) AS near_n FROM near GROUP BY word),
forms AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0)::BIGINT AS n_near,
    CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n
  FROM vocab v LEFT JOIN best b ON b.word = v.word),
walk(word, stop) AS (
  SELECT word, word FROM forms
  UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON walk.stop = forms.word WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, w.stop AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk w ON w.word = f.word JOIN forms e ON e.word = w.stop WHERE e.form IS NULL"""


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of the sources takes of every document."""
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


OP12_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+'))::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
sums AS (SELECT sum(source_size)::HUGEINT AS total, sum(weight)::HUGEINT AS weights FROM sources),
fill(round, rest, open) AS (
  SELECT 0, total, weights FROM sums
  UNION ALL
  SELECT round + 1, rest_now, open_now FROM (
    SELECT any_value(round) AS round, any_value(rest) AS rest, any_value(open) AS open,
      (SELECT total FROM sums) - coalesce(sum(3 * source_size) FILTER (weight * rest > 3 * source_size * open), 0) AS rest_now,
      coalesce(sum(weight) FILTER (NOT weight * rest > 3 * source_size * open), 1) AS open_now
    FROM sources, fill)
  WHERE rest <> rest_now OR open <> open_now),
level AS (SELECT rest, open FROM fill ORDER BY round DESC LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN weight * rest > 3 * source_size * open THEN (3 * source_size)::DOUBLE
    ELSE weight::DOUBLE * rest::DOUBLE / open::DOUBLE END AS target FROM sources, level),
placed AS (
  SELECT s.doc_id, s.size, s.source, t.source_size, t.target, least(3 * t.source_size, floor(t.target + 0.5)::BIGINT) AS take,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(concat_ws(':', 'mix', s.doc_id::VARCHAR)), s.doc_id NULLS FIRST, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, source,
  coalesce((take // nullif(source_size, 0)) * size + least(size, greatest(0, take % nullif(source_size, 0) - before)), 0)::BIGINT AS taken
FROM placed"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of every embedding."""
    rows = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op5_chat": OP5_SQL, "op11_spelling": OP11_SQL, "op12_mixing": OP12_SQL}
