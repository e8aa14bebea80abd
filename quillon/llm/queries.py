"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.chat import conversations_as_json, format_chat, loss_text, parsed_turns
from quillon.llm.embedding_dedup import embedding_dedup
from quillon.llm.exact_dedup import exact_dedup
from quillon.llm.line_dedup import line_dedup
from quillon.llm.main_text import extract_main_text
from quillon.llm.mixing import mix_sources, shard_counts
from quillon.llm.packing import pack_documents
from quillon.llm.quality import quality_scores
from quillon.llm.shared import shared_dir
from quillon.llm.simhash import simhash_components
from quillon.llm.spelling import spelling_groups
from quillon.llm.token_files import read_token_files, write_token_files
from quillon.llm.tokens import vocabulary
from quillon.llm.url_filter import judge_urls
from quillon.llm.whitening import whiten


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)


#: The text of both turns of conversation -7: control strings, and an escape in front of one.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = [F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(CONTROL_TEXT).alias("text")) for i, r in enumerate(("user", "assistant"))]
    rows = rows.unionByName(spark.range(1).select(F.inline(F.array(*more))))
    chats = format_chat(conversations_as_json(rows)).select("conv_id", "formatted", "loss_spans")
    back = chats.withColumn("_turns", parsed_turns(F.col("formatted"))).withColumn("_loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    digest = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two turns of a conversation (pair), written in one of eight layouts (two of them unknown), and what the formatter makes of them."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.expr("turn div 2").alias("pair"), (F.col("turn") % 2).alias("side"), "text")
    first = rows.groupBy("conv_id", "pair").agg(*[F.max(F.when(F.col("side") == i, F.coalesce("text", F.lit("")))).alias(c) for i, c in enumerate("ab")]).na.fill("")
    as_json = lambda **names: F.to_json(F.struct(*[F.col(c).alias(n.replace("_", " ").strip()) for n, c in names.items()]))
    pair = lambda role, text, a, b: F.array(*[F.struct(F.lit(r).alias(role), F.col(c).alias(text)) for r, c in ((a, "a"), (b, "b"))])
    layouts = [
        F.to_json(F.struct(pair("role", "content", "user", "assistant").alias("messages"))), F.to_json(F.struct(pair("from", "value", "human", "gpt").alias("conversations"))), as_json(instruction="a", output="b"),
        as_json(prompt="a", response="b"), as_json(prompt="a", completion="b"), as_json(question="a", answer="b"), as_json(x_prompt="a", y_response="b"), F.to_json(F.struct(pair("role", "content", "user", "assistant").alias("x messages"))),
    ]
    json = F.element_at(F.array(*layouts), F.pmod(F.col("conv_id") + F.col("pair"), F.lit(len(layouts))).cast("int") + 1)
    out = format_chat(first.select("conv_id", "pair", json.alias("json")))
    return out.select("conv_id", "pair", "layout", F.sha2("formatted", 256).alias("formatted_sha256"), F.try_element_at("loss_spans", F.lit(1))["length"].alias("loss_length"))


def mix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, shards, slots: over how many output shards a source's blocks are spread, and how many there are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return shard_counts(docs).groupBy("source").agg(F.count("*").alias("shards"), F.sum("slots").alias("slots"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs, with_text=False).select("doc_id", "size", "source_size", "target", "taken")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return embedding_dedup(vectors).select("vec_id", "n_links", "component_id", "kept")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, vocabulary("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, path)


# formatted_chars: "### ", the role, ": ", the text with its escapes (each longer or shorter than its control string), "</turn>\\n"
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(docs, labels).select("doc_id", "lang", "perplexity", "threshold", "kept")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


#: The rules that op13_url_filter judges by: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


OP3_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '### ', '\s'), '</turn>', '\e') AS body FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + length(body) + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

CHAT_LAYOUTS_SQL = r"""
WITH f AS (SELECT conv_id, turn // 2 AS pair, coalesce(max(coalesce(text, '')) FILTER (turn % 2 = 0), '') AS a, coalesce(max(coalesce(text, '')) FILTER (turn % 2 = 1), '') AS b FROM conversations GROUP BY ALL),
e AS (SELECT conv_id, pair, replace(replace(replace(a, '\', '\b'), '### ', '\s'), '</turn>', '\e') AS a, replace(replace(replace(b, '\', '\b'), '### ', '\s'), '</turn>', '\e') AS b, (conv_id + pair) % 8 AS k FROM f)
SELECT conv_id, pair, (['messages', 'conversations', 'instruction', 'prompt', 'completion', 'question', NULL, NULL])[k + 1] AS layout,
  CASE WHEN k < 6 THEN sha256('### user: ' || a || '</turn>' || chr(10) || '### assistant: ' || b || '</turn>' || chr(10)) END AS formatted_sha256, CASE WHEN k < 6 THEN length(b) END AS loss_length FROM e
"""

OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(generate_series(1, len(parts))) AS i, unnest(parts) AS line FROM (
    SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)),
s AS (
  SELECT doc_id, i, line, list_sort(list_distinct(list_filter(
    regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS words
  FROM l),
f AS (SELECT words, len(words) AS n, arg_min(doc_id, (doc_id, i)) AS doc_id, arg_min(i, (doc_id, i)) AS i FROM s WHERE len(words) > 0 GROUP BY words),
t AS (SELECT doc_id, i, n, unnest(words) AS w FROM f),
p AS (
  SELECT y.doc_id, y.i FROM t x JOIN t y ON x.w = y.w AND (x.doc_id, x.i) < (y.doc_id, y.i) AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n
  GROUP BY y.doc_id, y.i, x.doc_id, x.i, x.n, y.n HAVING 5 * count(*) >= 4 * (x.n + y.n - count(*))),
g AS (
  SELECT s.*, len(words) > 0 AND ((f.doc_id, f.i) <> (s.doc_id, s.i) OR (s.doc_id, s.i) IN (SELECT (doc_id, i) FROM p)) AS gone
  FROM s LEFT JOIN f USING (words) )
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text
FROM documents d LEFT JOIN (
  SELECT g.doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept
  FROM g GROUP BY g.doc_id) k ON d.doc_id = k.doc_id
"""

OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS original,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare
  FROM documents),
g AS (SELECT doc_id, sha256(bare) AS text_sha256,
        first_value(doc_id) OVER (PARTITION BY bare ORDER BY length(original) DESC, doc_id) AS keep_id,
        count(*) OVER (PARTITION BY bare) AS group_size
      FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

OP13_SQL = r"""
WITH r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS given, rest FROM a),
p AS (SELECT row_number() OVER () AS i, page_id, translate(given, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(given) + 1), '^[^?#]*') AS path FROM b),
f AS (SELECT i, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN f USING (i)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_main_text": op1_main_text,
    "op2_packing": op2_packing,
    "op3_chat": op3_chat,
    "chat_layouts": chat_layouts,
    "op4_simhash": op4_simhash,
    "op5_mixing": op5_mixing,
    "mix_shards": mix_shards,
    "op6_line_dedup": op6_line_dedup,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_token_files": op9_token_files,
    "op10_quality": op10_quality,
    "op11_spelling": op11_spelling,
    "op12_whitening": op12_whitening,
    "op13_url_filter": op13_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat": OP3_SQL,
    "chat_layouts": CHAT_LAYOUTS_SQL,
    "op6_line_dedup": OP6_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op13_url_filter": OP13_SQL,
}
