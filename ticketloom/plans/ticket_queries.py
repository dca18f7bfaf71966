"""Queries on the ticket table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.functions import text
from ticketloom.functions.tokens import token_count
from ticketloom.operators import tickets
from ticketloom.session import read


def _key(df: DataFrame, *more: str) -> DataFrame:
    return df.select("issue_id", "status", "exported_at", *more)


def ticket_filter_english(spark: SparkSession, root: str) -> DataFrame:
    return _key(tickets.only_english(read(spark, root, "tickets")))


def ticket_filter_unlinked(spark: SparkSession, root: str) -> DataFrame:
    return _key(tickets.only_unlinked(read(spark, root, "tickets")))


def ticket_clean_summary(spark: SparkSession, root: str) -> DataFrame:
    df = read(spark, root, "tickets")
    return _key(df.withColumn("cleaned_summary", text.clean_summary(F.col("summary_in_english"))), "cleaned_summary")


def ticket_filter_summary(spark: SparkSession, root: str) -> DataFrame:
    return _key(tickets.with_clean_summary(read(spark, root, "tickets")), "cleaned_summary")


def ticket_strip_color(spark: SparkSession, root: str) -> DataFrame:
    df = read(spark, root, "tickets")
    return _key(df.withColumn("description", F.regexp_replace("description", text.COLOR, "")), "description")


def ticket_clean_description(spark: SparkSession, root: str) -> DataFrame:
    return _key(tickets.with_clean_description(read(spark, root, "tickets")), "description")


def doc_filter_email_content(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "documents").select("doc_id", text.filter_email_content(F.col("text")).alias("text"))


def ticket_clean_pipeline(spark: SparkSession, root: str) -> DataFrame:
    return _key(tickets.clean_tickets(read(spark, root, "tickets")), "cleaned_summary", "description")


def ticket_stage_counts(spark: SparkSession, root: str) -> DataFrame:
    return tickets.stage_counts(read(spark, root, "tickets"))


RAW_NAMES = {
    "components": "Component/s",
    "category": "Custom field (Category)",
    "classification": "Custom field (Classification)",
    "classification_calculated": tickets.CALCULATED,
    "country": "Custom field (Country)",
}


def ticket_rename_fields(spark: SparkSession, root: str) -> DataFrame:
    raw = read(spark, root, "tickets").select("issue_id", "status", "exported_at", *[F.col(a).alias(b) for a, b in RAW_NAMES.items()])
    return tickets.rename_fields(raw)


def embed_metadata_struct(spark: SparkSession, root: str) -> DataFrame:
    docs = tickets.embedding_documents(tickets.with_clean_summary(read(spark, root, "tickets").dropDuplicates()))
    return docs.select("id", "document", "metadata.issue_key", "metadata.status", "metadata.parent_id", "metadata.token_count")


def embed_batches(spark: SparkSession, root: str) -> DataFrame:
    return tickets.numbered_batches(read(spark, root, "documents").select("doc_id"), "doc_id", 500)


def token_stats(spark: SparkSession, root: str) -> DataFrame:
    n = text.word_count(F.col("text"))
    return read(spark, root, "documents").agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_tokens"), F.round(F.avg(n), 6).alias("mean_tokens"))


def token_stats_by_source(spark: SparkSession, root: str) -> DataFrame:
    n = text.word_count(F.col("text"))
    return read(spark, root, "documents").rollup("source").agg(F.grouping("source").cast("int").alias("is_total"), F.count("*").alias("n_docs"), F.sum(n).alias("n_tokens"))


def json_segment_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Segmented JSON documents made of the documents of an issue: each document is a segment, its order the key."""
    docs = read(spark, root, "documents").where("issue_id is not null")
    from pyspark.sql import Window

    keyed = docs.withColumn("k", F.row_number().over(Window.partitionBy("issue_id").orderBy("doc_id")).cast("string"))
    pairs = F.map_from_entries(F.collect_list(F.struct("k", F.struct("text"))))
    raw = keyed.groupBy("issue_id").agg(F.to_json(pairs).alias("raw"))
    return tickets.segment_tokens(raw, "issue_id", "raw").select(F.col("file").alias("issue_id"), "n_segments", "n_tokens")


def json_segment_totals(spark: SparkSession, root: str) -> DataFrame:
    """The same documents, one row each and one for all of them."""
    return tickets.with_grand_total(json_segment_tokens(spark, root).withColumnRenamed("issue_id", "file"))


def token_stats_bpe(spark: SparkSession, root: str) -> DataFrame:
    """Tokens of a public vocabulary."""
    counted = read(spark, root, "documents").select(token_count(F.col("text")).alias("n"))
    return counted.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.round(F.avg("n"), 6).alias("mean_tokens"))


def token_stats_bpe_by_source(spark: SparkSession, root: str) -> DataFrame:
    counted = read(spark, root, "documents").select("source", token_count(F.col("text")).alias("n"))
    return counted.rollup("source").agg(F.grouping("source").cast("int").alias("is_total"), F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))


QUERIES = {
    f.__name__: f
    for f in (
        ticket_clean_pipeline, ticket_filter_english, ticket_filter_unlinked, ticket_clean_summary, ticket_filter_summary, ticket_strip_color, ticket_clean_description,
        doc_filter_email_content, ticket_stage_counts, ticket_rename_fields, embed_metadata_struct, embed_batches, token_stats, token_stats_by_source, token_stats_bpe, token_stats_bpe_by_source, json_segment_tokens,
        json_segment_totals,
    )
}

# --- SQL: RE2 has no look-behind, so the full stops of abbreviations are masked before a line is cut -------------------
_WS = text.WS
_MASKED = "|".join(text._escaped(a) for a in text.ABBREVIATIONS)


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{_WS}+|{_WS}+\z', '', 'g')"


_ENDS = " or ".join(f"contains(lower(p), '{x}')" for x in text.SIGN_OFFS + text.PRIVACY)


def _mail(source: str, x: str) -> str:
    """CTEs that end in table k: the source's columns and the kept lines of x; _MAIL_TEXT joins them."""
    lines = rf"""list_filter(string_split_regex({x}, '{text.LB}'), lambda p: {_strip("p")} <> '' and not regexp_matches(p, '(?i){text.HEADER}') and not regexp_matches(p, '{text.TABLE}'))"""
    return f"""with l as (select *, {lines} as ls from {source}),
s as (select *, list_filter(range(1, len(ls) + 1), lambda i: {_ENDS.replace("lower(p)", "lower(ls[i])")}) as stops from l),
k as (select *, case when len(stops) > 0 then ls[1:stops[1] - 1] else ls end as kept from s)"""


_CUT = rf"string_split_regex(regexp_replace(p, '({_MASKED})\.( +)', '\1' || chr(1) || '\2', 'g'), '\. +')"
_JOINED = f"array_to_string(list_filter(list_transform({_CUT}, lambda s: {_strip('replace(s, chr(1), chr(46))')}), lambda s: s <> ''), '. ')"
_MAIL_TEXT = f"array_to_string(list_filter(list_transform(kept, lambda p: case when {_JOINED} = '' or {_JOINED} like '%.' then {_JOINED} else {_JOINED} || '.' end), lambda s: s <> ''), ' ')"
_BODY = _MAIL_TEXT
for _a in text.ARTEFACTS:
    _BODY = f"replace({_BODY}, '{_a}', '')"
_DESCRIPTION = f"case when description is null then null else {_strip(f"regexp_replace({_BODY}, '{_WS}+', ' ', 'g')")} end"
_NO_COLOR = rf"regexp_replace(description, '{text.COLOR}', '', 'g')"
_SUMMARY = f"lower({_strip(f"regexp_replace(coalesce(summary_in_english, ''), '{text.PREFIX}', '', 'g')")})"
_WANTED = f"not regexp_matches({_SUMMARY}, '{text.UNWANTED}')"
_EN = f"ticket_language = '{tickets.ENGLISH}'"


def _words(x: str) -> str:
    return f"len(list_filter(string_split_regex(coalesce({x}, ''), '{_WS}+'), lambda w: w <> ''))"


SQL = {
    "ticket_filter_english": f"select issue_id, status, exported_at from tickets where {_EN}",
    "ticket_filter_unlinked": "select issue_id, status, exported_at from tickets where relates is null",
    "ticket_clean_summary": f"select issue_id, status, exported_at, {_SUMMARY} as cleaned_summary from tickets",
    "ticket_filter_summary": f"select issue_id, status, exported_at, {_SUMMARY} as cleaned_summary from tickets where {_WANTED}",
    "ticket_strip_color": rf"select issue_id, status, exported_at, regexp_replace(description, '{text.COLOR}', '', 'g') as description from tickets",
    "ticket_clean_description": f"{_mail('tickets', _NO_COLOR)} select issue_id, status, exported_at, {_DESCRIPTION} as description from k",
    "doc_filter_email_content": f"{_mail('documents', 'text')} select doc_id, case when text is null then null else {_MAIL_TEXT} end as text from k",
    "ticket_clean_pipeline": f"{_mail('tickets', _NO_COLOR)} select issue_id, status, exported_at, {_SUMMARY} as cleaned_summary, {_DESCRIPTION} as description from k where {_EN} and relates is null and {_WANTED}",
    "ticket_stage_counts": f"""
select *, round(n_english / n_read, 6) as share_english, round(n_unlinked / n_read, 6) as share_unlinked, round(n_answered / n_read, 6) as share_answered
from (select count(*) as n_read, count(*) filter ({_EN}) as n_english, count(*) filter ({_EN} and relates is null) as n_unlinked,
  count(*) filter ({_EN} and relates is null and {_WANTED}) as n_answered from tickets)""",
    "ticket_rename_fields": 'select issue_id, status, exported_at, components as "Components", category as "Category", classification as "Classification", classification_calculated as "Classification (Calculated)", country as "Country" from tickets',
    "embed_metadata_struct": f"select cast(issue_id as varchar) as id, {_SUMMARY} as document, issue_key, status, parent_id, {_words(_SUMMARY)} as token_count from (select distinct * from tickets) where {_WANTED}",
    "embed_batches": "select doc_id, cast(floor((row_number() over (order by doc_id) - 1) / 500) as bigint) as batch_no from documents",
    "token_stats": f"select count(*) as n_docs, sum({_words('text')}) as n_tokens, round(avg({_words('text')}), 6) as mean_tokens from documents",
    "token_stats_by_source": f"select source, grouping(source) as is_total, count(*) as n_docs, sum({_words('text')}) as n_tokens from documents group by rollup (source)",
    "json_segment_totals": f"""
select issue_id as file, grouping(issue_id) as is_total, count(*) as n_files, sum(n) as n_segments, sum(k) as n_tokens
from (select issue_id, count(*) as n, sum({_words('text')}) as k from documents where issue_id is not null group by issue_id) group by rollup (issue_id)""",
    "json_segment_tokens": f"select issue_id, count(*) as n_segments, sum({_words('text')}) as n_tokens from documents where issue_id is not null group by issue_id",
}
