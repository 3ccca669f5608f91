"""Registered queries of the text operators and their SQL twins."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bourselake.llm import bpe, chat, decontam, licenses, lm, periodic, pii, quality, repair, secret_scan, simhash, topk, toxicity
from bourselake.llm.common import bucket5, table
from bourselake.session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return keep


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


CHAT_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
turns AS (
  SELECT conv_id, turn, role, text,
    4 + length(role) + 2 + length(text) + 8
    + length(text) - length(replace(text, '\', ''))
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda r: length(r) - 2)), 0)
    + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS formatted
  FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(formatted) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


@query("op1_chat_formatting", CHAT_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as threads: each row answers the row before it."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    said = said.unionByName(extra)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order)
    thread = said.select(F.col("conv_id").alias("tree"), node.alias("node"), "role", "text", F.lit(0).alias("score"))
    thread = thread.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
    made = chat.format_chat(thread)
    turns, loss = chat.parse(F.col("formatted")), chat.learned(F.col("formatted"), F.col("loss"))
    read = made.select("tree", "formatted", turns.alias("turns"), loss.alias("learned"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(lines, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
                       F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                       "score")


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = docs.select("doc_id", (bucket5("doc_id") == 0).alias("held_out"),
                       toxicity.toxicity(docs, table(spark, sf_dir, "labels")).alias("made"))
    return made.select("doc_id", "held_out", F.col("made.score").alias("score"),
                       F.when(F.col("made.score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("made.spans").alias("n_spans"))


@query("op8_benchmark_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decontam.with_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), "found")
    n_hit = F.size("found.hits").cast("long")
    return docs.select("doc_id", "found.n_words", n_hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query("op5_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in (*pii.PATTERNS, "term")]
    return made.select("doc_id", *counts, F.sha2(pii.all_spans(pii.PATTERNS), 256).alias("base_sha256"),
                       pii.all_spans((*pii.PATTERNS, "term")).alias("spans"))


@query("op6_secret_scans")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = secret_scan.secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = tuple(secret_scan.PATTERNS)
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in (*kinds, "random")]
    return made.select("doc_id", *counts, F.sha2(secret_scan.span_rows(kinds), 256).alias("base_sha256"),
                       secret_scan.span_rows((*kinds, "random")).alias("spans"))


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_lm_scoring")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_license_scans")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a tree: source, language, hundreds of ids."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    made = licenses.scan_licenses(docs.select(path.alias("path"), "text"))
    return made.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "license", F.round("cosine", 6).alias("cosine"), "origin")


@query("op10_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe(table(spark, sf_dir, "documents").select("doc_id", "text"), **tokenizer_files())


def tokenizer_files() -> dict[str, str]:
    import public_tokenizers
    return {"path": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"),
            "pattern": public_tokenizers.PATTERN}


TOP_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
placed AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM met)
SELECT * FROM placed WHERE rank <= 5
"""


@query("op11_topk_search", TOP_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, F.col("vec_id") % 50 == 0)


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), plant=True)


def edit_sql(cell: str, cost: str, letters: str) -> str:
    """A cell, nine digits of cost and the letters so far, after one more edit; null stays null."""
    return f"lpad(CAST(CAST(left({cell}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({cell}, 10) || '{letters}'"


INSERTED_SQL = (f"e0 AS c0, e1 AS c1, least(e2, {edit_sql('e0', '2', 'I')}, {edit_sql('e1', '2', 'I')}, {edit_sql('e3', '2', 'I')}) AS c2, "
                f"least(e3, {edit_sql('e2', '2', 'I')}, {edit_sql('e0', '4', 'II')}, {edit_sql('e1', '4', 'II')}) AS c3")


def row_sql(state: int, sources: tuple[int, ...], keep: str) -> str:
    ways = [edit_sql(f"c{state}", "3", "D")]
    for s in sources:
        if state > 1:
            ways.append(f"CASE WHEN stays THEN {edit_sql(f'c{s}', '2 + ragged', 'R')} END")
        ways.append(f"CASE WHEN stays AND initial = '{keep}' THEN {edit_sql(f'c{s}', 'ragged', 'K')} END")
    return f"least({', '.join(ways)}) AS e{state}"


REPAIR_SQL = rf"""
WITH RECURSIVE named AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place FROM conversations),
coded AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(place) + 1), lambda i: CAST(ascii(substr(place, i, 1)) AS BIGINT))),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))), 4294967295) % 20 AS what FROM named),
damaged AS (
  SELECT key, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN what = 1 THEN '' WHEN what = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE what WHEN 3 THEN 2 WHEN 0 THEN 0 ELSE 1 END)) AS copy FROM coded),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
    row_number() OVER (PARTITION BY key, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS later,
    right(regexp_replace(text, '[ 	-]+', '', 'g'), 1) AS last, left(role, 1) AS initial FROM damaged),
judged AS (
  SELECT *, last = '' AS blank, last <> '' AND later AS duplicate, last NOT IN ('', '.', '!', '?') AND NOT later AS truncated,
    last <> '' AND NOT later AS stays, CASE WHEN last IN ('.', '!', '?') THEN 0 ELSE 1 END AS ragged,
    lag(initial) OVER (PARTITION BY key ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM placed),
counted AS (
  SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate,
    count_if(truncated) AS truncated, count_if(illegal) AS illegal, max(i) AS n FROM judged GROUP BY key),
walk AS (
  SELECT key, CAST(0 AS BIGINT) AS i, '000000000' AS e0, CAST(NULL AS VARCHAR) AS e1, CAST(NULL AS VARCHAR) AS e2, CAST(NULL AS VARCHAR) AS e3 FROM counted
  UNION ALL
  SELECT j.key, j.i, {row_sql(0, (), '')}, {row_sql(1, (0,), 's')}, {row_sql(2, (0, 1, 3), 'u')}, {row_sql(3, (2,), 'a')}
  FROM (SELECT key, i, {INSERTED_SQL} FROM walk) w JOIN judged j ON j.key = w.key AND j.i = w.i + 1),
best AS (
  SELECT w.key, least(c0, c3) AS cell FROM (SELECT key, i, {INSERTED_SQL} FROM walk) w JOIN counted c ON c.key = w.key AND c.n = w.i),
told AS (
  SELECT key, substr(cell, 10) AS audit, CAST(0 AS BIGINT) AS spot, CAST(0 AS BIGINT) AS i, 0 AS state, CAST(NULL AS VARCHAR) AS lines FROM best
  UNION ALL
  SELECT key, audit, spot + 1, CASE WHEN what = 'I' THEN i ELSE i + 1 END,
    CASE what WHEN 'D' THEN state WHEN 'K' THEN CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE WHEN state = 2 THEN 3 ELSE 2 END END,
    CASE WHEN what = 'D' THEN lines ELSE concat_ws(chr(10), lines, CASE WHEN what = 'K' THEN role WHEN state = 2 THEN 'assistant' ELSE 'user' END || ':'
      || CASE WHEN what = 'I' THEN '' ELSE text END) END
  FROM (SELECT t.*, substr(t.audit, t.spot + 1, 1) AS what, j.role, j.text, j.initial FROM told t LEFT JOIN judged j ON j.key = t.key AND j.i = t.i + 1
        WHERE t.spot < length(t.audit))),
final AS (
  SELECT c.*, CAST(left(b.cell, 9) AS BIGINT) AS cost, t.audit, sha256(coalesce(t.lines, '')) AS digest
  FROM counted c JOIN best b ON b.key = c.key JOIN told t ON t.key = c.key AND t.spot = length(t.audit))
SELECT v.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN final f ON f.key = coalesce(CAST(v.conv_id AS VARCHAR), ' ')
"""


@query("op13_conversation_repair", REPAIR_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"), damage=True)


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
