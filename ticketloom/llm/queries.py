"""Queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm import langid, leak, mail, markup, mcl, mixing, pii, quality, residue
from ticketloom.llm.sql import SQL
from ticketloom.session import read

__all__ = ["QUERIES", "SQL"]


def _codes(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """The label table; more than a thousand languages are an error, not a sample."""
    rows = read(spark, root, "language_codes").where("lang is not null").select("lang", "label").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("language_codes has more than 1000 rows")
    return [(r.lang, r.label) for r in rows]


def _language_network(spark: SparkSession, root: str) -> tuple[langid.Network, list[tuple[str, str]]]:
    codes = _codes(spark, root)
    named = langid.named_language(F.col("ticket_language"), codes).alias("lang")
    tickets = read(spark, root, "tickets").select(F.col("issue_id").alias("id"), F.col("description").alias("text"), named)
    return langid.train_on(read(spark, root, "documents"), doubtful=tickets), codes


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    net, codes = _language_network(spark, root)
    wrong = langid.wrong_labels(read(spark, root, "tickets"), net, codes, "issue_id", "description", "ticket_language")
    return wrong.select("issue_id", "lang")


def p1_segments(spark: SparkSession, root: str) -> DataFrame:
    """Every segment of every description with its language and confidence."""
    net, _ = _language_network(spark, root)
    tickets = read(spark, root, "tickets").groupBy("issue_id").agg(F.min("description").alias("description"))
    return langid.label_segments(tickets, net, "issue_id", "description")


def _clusters(spark: SparkSession, root: str) -> DataFrame:
    return mcl.cluster_vectors(read(spark, root, "helpdesk_summaries_embeddings"), "issue_id", "embeddings")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return mcl.first_members(_clusters(spark, root)).select(F.col("first_id").alias("first_issue_id"), F.col("id").alias("issue_id"))


def p2_summary(spark: SparkSession, root: str) -> DataFrame:
    """Each cluster's size and most typical issues."""
    return mcl.cluster_summary(_clusters(spark, root))


_PII_FIELDS = ["description", "solution"]


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    tickets = read(spark, root, "tickets")
    return pii.find_pii(tickets, pii.fit(tickets, "issue_id", _PII_FIELDS), "issue_id", _PII_FIELDS)


def p4_redacted(spark: SparkSession, root: str) -> DataFrame:
    """The tickets' texts with typed placeholders."""
    tickets = read(spark, root, "tickets").select("issue_id", "exported_at", *_PII_FIELDS)
    return pii.redact(tickets, pii.fit(tickets, "issue_id", _PII_FIELDS), _PII_FIELDS)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return residue.find_residue(read(spark, root, "tickets"), "issue_id", "summary_in_english", "components").select(F.col("id").alias("issue_id"))


def p5_forms(spark: SparkSession, root: str) -> DataFrame:
    """Every distinct normal form with its counts and class."""
    return residue.form_table(read(spark, root, "tickets"), "issue_id", "summary_in_english", "components").drop("h1", "h2")


def p5_to_embed(spark: SparkSession, root: str) -> DataFrame:
    """The tickets that go on to embedding."""
    return residue.keep_content(read(spark, root, "tickets"), "issue_id", "summary_in_english", "components").select("issue_id", "exported_at", "summary_in_english")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return mail.find_inherited(read(spark, root, "tickets"), "issue_id", "description", "created_at")


def p6_new_text(spark: SparkSession, root: str) -> DataFrame:
    """Every description cut down to its newly written lines."""
    return mail.newly_written(read(spark, root, "tickets"), "issue_id", "description", "created_at")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return markup.find_markup(read(spark, root, "tickets"), "issue_id", "description", "creator")


def p7_clean(spark: SparkSession, root: str) -> DataFrame:
    """Every description without markup."""
    rows = read(spark, root, "tickets").select("issue_id", "exported_at", "description", "creator")
    return markup.clean_text(rows, "issue_id", "description", "creator").select("issue_id", "exported_at", "clean_text")


def p7_wrappers(spark: SparkSession, root: str) -> DataFrame:
    """The wrappers of each web site."""
    pages = read(spark, root, "web_pages").withColumn("host", F.expr("try_parse_url(url, 'HOST')"))
    return markup.infer_wrappers(markup.signatures(pages, "page_id", "html", "host")).select("host", "wrapper").distinct()


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return leak.find_leaks(read(spark, root, "documents"), read(spark, root, "eval_items"))


def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(read(spark, root, "documents"), read(spark, root, "source_targets")).select("doc_id", "source", "copy_no", "text")


def p9_report(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix_report(read(spark, root, "documents"), read(spark, root, "source_targets"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return quality.text_types(read(spark, root, "documents")).where("prose < 0.5").select("doc_id").distinct()


def p10_types(spark: SparkSession, root: str) -> DataFrame:
    return quality.text_types(read(spark, root, "documents"))


def p10_stats(spark: SparkSession, root: str) -> DataFrame:
    return quality.statistics(read(spark, root, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_segments, p2_found, p2_summary, p4_found, p4_redacted, p5_found, p5_forms, p5_to_embed, p6_found, p6_new_text, p7_found, p7_clean, p7_wrappers, p8_found, p9_mix, p9_report, p10_found, p10_types, p10_stats)}
