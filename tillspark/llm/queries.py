"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, near_dup, quality_mil, quality_rules, suffix_dedup, toxicity
from .common import crc_fold, table
from .line_dedup import MIN_SITES, dedup_lines
from .url_filter import filter_urls, key_table

URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Domains that are blocked where no rule fits.
BLOCKED_HOSTS = ("adult-x.example.net", "ads-track.example.com", "casino-win.example.com", "cheap-pills.example.com", "free-bets.example.com", "phish.example.com", "spam-farm.example.com")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = key_table(spark, BLOCKED_HOSTS)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = f"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?:.|\\n)*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?:.|\\n)*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/'
  END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN {" OR ".join(f"host = '{h}' OR host LIKE '%.{h}'" for h in BLOCKED_HOSTS)} THEN 'block'
            ELSE 'allow' END AS verdict
FROM ruled
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


OP3_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
trimmed AS (
  SELECT *, trim(raw, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS line FROM lines),
spread AS (
  SELECT line, arg_min(struct_pack(d := doc_id, p := pos), struct_pack(d := doc_id, p := pos)) AS first
  FROM trimmed WHERE line <> ''
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (
  SELECT t.doc_id, t.pos, t.raw, t.line,
         s.line IS NOT NULL AND struct_pack(d := t.doc_id, p := t.pos) <> s.first AS cut
  FROM trimmed t LEFT JOIN spread s ON t.line = s.line)
SELECT d.doc_id, CAST(coalesce(m.n_lines, 0) AS BIGINT) AS n_lines,
       CAST(coalesce(m.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(m.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) FILTER (WHERE line <> '') AS n_lines, count(*) FILTER (WHERE cut) AS n_removed,
         string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT cut) AS kept
  FROM marked GROUP BY doc_id) m USING (doc_id)
"""


def _classified(spark: SparkSession, sf_dir: str, model, label: str, folds: int, held: int) -> DataFrame:
    """Scores of all documents by a model that learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_fold(F.col("doc_id"), folds) == held
    fitted = model.train(docs, table(spark, sf_dir, "labels"), label, ~held_out)
    return model.score(docs.withColumn("held_out", held_out), fitted).select("doc_id", "held_out", "score", "predicted")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, toxicity, "toxic", 3, 1)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs, quality_rules.train(docs, table(spark, sf_dir, "labels"))).drop("text")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, quality_mil, "quality", 4, 2)


def vocabulary_path() -> str:
    """The file of the public vocabulary, installed alike on the driver and the executors."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = vocabulary_path()
    coded = bpe.decode(bpe.encode(docs, path).drop("text"), path)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), sha(ids).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it contains."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))


CHAT_PROBE = "\\### Assistant: </turn> ok"
CHAT_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of what a formatted conversation gives back when it is parsed."""
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
    for pdf in batches:
        rows = []
        for conv, text, spans in zip(pdf["conv_id"], pdf["formatted"], pdf["loss_spans"], strict=True):
            turns = chat.parse(text)
            loss = "".join(chat.unescape(text[s["start"] : s["stop"]]) for s in spans)
            rows.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHAT_DIGEST.split(", ")])


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CHAT_PROBE).alias("text")
    )
    trees = chat.linear(rows.unionByName(probe))
    out = chat.format_trees(trees).select(F.col("tree_id").alias("conv_id"), "formatted", "loss_spans")
    return out.mapInPandas(_read_back, CHAT_DIGEST)


OP10_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '<', '\<') AS safe,
         replace(replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '<', '\<'), ':', '\:'), chr(10), '\' || chr(10)) AS safe_role
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(safe_role) + length(safe) + 14) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_bpe": op8_bpe,
    "op9_decontamination": op9_decontamination,
    "op10_chat_format": op10_chat_format,
}
ORACLES = {"op1_url_filter": OP1_SQL, "op3_line_dedup": OP3_SQL, "op10_chat_format": OP10_SQL}
