"""Queries of the training-data operators over the given tables, and SQL that returns the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrilens.llm.common import table
from petrilens.llm.conversations import damage_and_repair
from petrilens.llm.decontaminate import find_leaks
from petrilens.llm.html_text import extract_main_text
from petrilens.llm.licenses import scan_licenses
from petrilens.llm.mixing import mix_plan
from petrilens.llm.packing import pack
from petrilens.llm.pii import find_pii, fit_field
from petrilens.llm.simhash import near_duplicates
from petrilens.llm.spellings import group_spellings
from petrilens.llm.sql import SQL  # noqa: F401
from petrilens.llm.token_files import token_files
from petrilens.llm.topk import top_k
from petrilens.llm.toxicity import fit_toxicity, score_toxicity
from petrilens.llm.url_lists import filter_urls, url_host

#: Vocabulary file of the token files; a parameter of the operator.
TOKENIZER = "byte_bpe_50k.json"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit_toxicity(docs, labels, use=~held_out)
    scored = score_toxicity(docs.select("doc_id", "lang", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "start", "n_words", "similarity")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_pii(docs, fit_field(docs))
    return found.withColumn("base_sha256", F.sha2("base", 256)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def url_captures(pages: DataFrame) -> DataFrame:
    """page_id, url, fetched_on: the given pages have no fetch time, so one day of 2024 follows from the id."""
    return pages.select("page_id", "url", F.expr("date_add(DATE '2024-01-01', cast(pmod(page_id, 366) as int))").alias("fetched_on"))


def url_changes(pages: DataFrame) -> DataFrame:
    """A dated blocklist made of the given pages: hosts, their parent domains and first path parts by the digits of
    their md5: some are listed in 2024, some of these are delisted later and some of these listed again."""
    host = url_host(F.col("url"))
    first = F.regexp_extract("url", r"^[a-z]+://[^/]+/([^/?#]+)/", 1)
    rows = pages.select(host.alias("host"), first.alias("part")).filter("host <> ''")
    names = rows.select(F.col("host").alias("pattern"), F.lit("hosts").alias("list")).union(
        rows.select(F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1), F.lit("domains"))
    ).union(rows.filter("part <> ''").select(F.concat_ws("/", "host", "part", F.lit("")), F.lit("paths"))).filter("pattern <> ''").distinct()
    digit = lambda k, n: F.conv(F.substring(F.md5("pattern"), k, n), 16, 10).cast("int")
    names = names.filter(digit(1, 1) < 4).withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), digit(2, 2)))
    turn = lambda days, action, cond: names.filter(cond).select("list", "pattern", F.date_add("d", days).alias("dated"), F.lit(action).alias("action"))
    return turn(F.lit(0), "add", F.lit(True)).union(turn(digit(4, 1) + 1, "remove", digit(5, 1) < 10)).union(turn(digit(4, 1) + 30, "add", digit(5, 1) < 5))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = filter_urls(url_captures(pages), url_changes(pages))
    return found.withColumns({c: F.col(c).cast("string") for c in ("fetched_on", "listed_on")})


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), tokenizer=tokenizer_path())


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage_and_repair(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer=tokenizer_path(), carry=F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_html_text": op2_html_text,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_decontamination": op5_decontamination,
    "op6_pii": op6_pii,
    "op7_url_filter": op7_url_filter,
    "op8_licenses": op8_licenses,
    "op9_topk": op9_topk,
    "op10_token_files": op10_token_files,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_packing": op13_packing,
}
