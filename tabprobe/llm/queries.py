"""Queries over the driver's tables, one per operator, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe.llm.chat import format_chats, read_back
from tabprobe.llm.decontaminate import contaminated
from tabprobe.llm.exact_dedup import exact_dedup
from tabprobe.llm.lexical import ranked_search
from tabprobe.llm.license_scan import scan_licenses
from tabprobe.llm.line_dedup import dedup_lines
from tabprobe.llm.manifest import FIELDS, build_manifest, leaf_digest, proof_digest, proofs, verify
from tabprobe.llm.minhash import near_duplicates
from tabprobe.llm.piece_codec import encode_decode
from tabprobe.llm.quality import quality_scores
from tabprobe.llm.sql import license_sql, manifest_sql, near_sql, passages_sql, ranked_sql
from tabprobe.llm.suffix_dedup import dedup_passages
from tabprobe.llm.toxicity import toxicity_scores
from tabprobe.llm.url_filter import HOST_RULES, WORD_RULES, judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_passages(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["stop"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def piece_model() -> str:
    """The public tokenizer's model file; read on the driver only."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(_table(spark, sf_dir, "documents"), piece_model())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), k=2, percent=80)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoted = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", quoted), (-7, 1, "assistant", quoted)], turns.schema)
    return read_back(format_chats(turns.unionByName(extra)))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    without_breaks = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    later = leaf_digest([without_breaks if c == "text" else F.col(c) for c in FIELDS])
    manifest = build_manifest(_table(spark, sf_dir, "documents"), tampered=later)
    return verify(proofs(manifest)).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root",
                                           proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality": op2_quality,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_piece_codec": op5_piece_codec,
    "op6_near_dedup": op6_near_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_chat_format": op8_chat_format,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_ranked_search": op12_ranked_search,
    "op13_license_scan": op13_license_scan,
}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op1_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, {_FOLD.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
repeated AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.pos, k.line, r.first IS NOT NULL AND r.first <> k.doc_id AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op3_suffix_dedup": passages_sql(),
    "op6_near_dedup": near_sql(),
    "op9_exact_dedup": f"""
WITH n AS (SELECT doc_id, sha256({_FOLD.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)""",
    "op11_merkle_manifest": manifest_sql(),
    "op12_ranked_search": ranked_sql(),
    "op13_license_scan": license_sql(),
}


def _url_sql() -> str:
    """Brute force over all rules, without tokens or index."""
    rows = ", ".join(f"('{h}', '{p}', '{r.verdict}', '{r.name}')" for r in HOST_RULES
                     for h, p in [(r.name.split("/")[0], r.name[r.name.index("/"):])])
    words = " OR ".join(f"regexp_matches(target, '(^|[^A-Za-z0-9]){r.name}([^A-Za-z0-9]|$)')" for r in WORD_RULES)
    first = "CASE " + " ".join(f"WHEN regexp_matches(target, '(^|[^A-Za-z0-9]){r.name}([^A-Za-z0-9]|$)') THEN '{r.name}'"
                               for r in sorted(WORD_RULES, key=lambda r: (r.length, r.name), reverse=True)) + " END"
    return f"""
WITH rules(rhost, rpath, rverdict, rname) AS (VALUES {rows}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, {_FOLD.format("regexp_extract(r, '^[^/?#]*', 0)")} AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, substr(r, length(regexp_extract(r, '^[^/?#]*', 0)) + 1) AS tail FROM rest),
best AS (
  SELECT page_id, arg_max(rname, length(rname)) AS rule, arg_max(rverdict, length(rname)) AS rverdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
w AS (SELECT p.*, b.rule, b.rverdict, host || tail AS target FROM parts p LEFT JOIN best b USING (page_id))
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN rverdict WHEN {words} THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NULL THEN {first} END AS word_rule
FROM w"""


ORACLE["op4_url_filter"] = _url_sql()
