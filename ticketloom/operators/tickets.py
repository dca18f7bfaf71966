"""Cleaning ticket exports: renaming, filters, derived text, counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.functions import text

CALCULATED = "Custom field (Classification (Calculated))"
ENGLISH = "EN - English"


def rename_fields(df: DataFrame) -> DataFrame:
    """Export names without their `Custom field (...)` wrapper; the calculated classification must exist."""
    if CALCULATED not in df.columns:
        raise ValueError(f"the export has no column {CALCULATED!r}")
    names = {c: c.replace("Custom field (", "").replace(")", "") for c in df.columns if "Custom field" in c}
    names |= {CALCULATED: "Classification (Calculated)", "Component/s": "Components"}
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def only_english(df: DataFrame, language: str = "ticket_language") -> DataFrame:
    return df.where(F.col(language) == ENGLISH)


def only_unlinked(df: DataFrame, relates: str = "relates") -> DataFrame:
    return df.where(F.col(relates).isNull())


def with_clean_summary(df: DataFrame, summary: str = "summary_in_english") -> DataFrame:
    """Adds cleaned_summary and drops the rows whose summary says that nobody can answer."""
    return df.withColumn("cleaned_summary", text.clean_summary(F.col(summary))).where(~text.is_unwanted_summary(F.col("cleaned_summary")))


def with_clean_description(df: DataFrame, description: str = "description") -> DataFrame:
    return df.withColumn(description, text.clean_description(F.col(description)))


def clean_tickets(df: DataFrame) -> DataFrame:
    """The whole pipeline in one stage: filters first, text work on what is left."""
    return df.transform(only_english).transform(only_unlinked).transform(with_clean_summary).transform(with_clean_description)


def stage_counts(df: DataFrame) -> DataFrame:
    """One row: rows read and left after each filter, with the share of the first; one pass, one aggregate."""
    english = F.coalesce(F.col("ticket_language") == ENGLISH, F.lit(False))
    unlinked = english & F.col("relates").isNull()
    answered = unlinked & ~text.is_unwanted_summary(text.clean_summary(F.col("summary_in_english")))
    n = F.count("*")
    counts = [n.alias("n_read")] + [F.count_if(p).alias(f"n_{name}") for name, p in (("english", english), ("unlinked", unlinked), ("answered", answered))]
    out = df.agg(*counts)
    return out.withColumns({f"share_{k}": F.when(F.col("n_read") > 0, F.round(F.col(f"n_{k}") / F.col("n_read"), 6)) for k in ("english", "unlinked", "answered")})


METADATA = [
    "summary", "issue_key", "issue_id", "parent_id", "issue_type", "status", "priority", "resolution", "creator", "components", "description",
    "category", "classification", "classification_calculated", "country", "solution", "summary_solution", "summary_in_english", "user_category",
]


Counter = Callable[[Column], Column]


def embedding_documents(df: DataFrame, text_columns: tuple[str, ...] = ("cleaned_summary", "summary_in_english"), row_level: bool = False, count: Counter = text.word_count) -> DataFrame:
    """(id, document, metadata): the text is the first of the columns that exists; with row_level the first not null in the row.

    count: how token_count is worked out, words by default; `functions.tokens.token_count` counts those of a tokenizer."""
    have = [c for c in text_columns if c in df.columns]
    document = F.coalesce(*[F.col(c) for c in have]) if row_level else F.col(have[0])
    fields = [c for c in METADATA if c in df.columns]
    return df.select(
        F.col("issue_id").cast("string").alias("id"),
        document.alias("document"),
        F.struct(*fields, count(document).alias("token_count")).alias("metadata"),
    )


def numbered_batches(df: DataFrame, id_col: str, size: int = 500) -> DataFrame:
    """Adds batch_no, `size` rows each in order of the id.

    Rows get their number within a range partition; the partitions' offsets, one row a partition, are joined to it. No task
    sees more than its partition."""
    from pyspark.sql import Window

    from ticketloom.session import written

    ranged = written(df.repartitionByRange(id_col).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))
    row = F.row_number().over(Window.partitionBy("_part").orderBy(id_col))
    numbered = ranged.withColumn("_row", row).join(F.broadcast(offsets), "_part")  # as many rows as partitions
    return numbered.withColumn("batch_no", F.floor((F.col("_row") + F.col("_offset") - 1) / size)).drop("_part", "_row", "_offset")


def insert_new(old: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """The union in which an id that exists already keeps its old row."""
    return old.unionByName(new.join(old.select(id_col), id_col, "left_anti"))


def segment_tokens(raw: DataFrame, file_col: str, json_col: str) -> DataFrame:
    """(file, n_segments, n_tokens) of segmented JSON documents: only keys of digits count, each value has a text.

    A broken document or a segment without a text gives a row with the reason in `error` and null counts."""
    values = F.from_json(json_col, "map<string,string>")
    segments = F.map_entries(F.map_filter(values, lambda k, v: k.rlike(r"\A\p{N}+\z")))
    texts = F.transform(segments, lambda e: F.get_json_object(e["value"], "$.text"))
    missing = F.exists(texts, lambda t: t.isNull())
    tokens = F.aggregate(F.transform(texts, text.word_count), F.lit(0), lambda a, x: a + x)
    error = F.when(values.isNull(), "invalid JSON").when(missing, "segment without text")
    return raw.select(
        F.col(file_col).alias("file"), F.when(error.isNull(), F.size(segments)).alias("n_segments"), F.when(error.isNull(), tokens).alias("n_tokens"), error.alias("error")
    )


def segment_token_totals(raw: DataFrame, file_col: str, json_col: str, count: Counter) -> DataFrame:
    """(file, n_segments, n_tokens, error) like `segment_tokens`, with a counter that a higher-order function cannot hold, such
    as a tokenizer: the texts become rows and are summed again by file. A repeated file name counts once a row."""
    values = F.from_json(json_col, "map<string,string>")
    segments = F.map_entries(F.map_filter(values, lambda k, v: k.rlike(r"\A\p{N}+\z")))
    texts = F.transform(segments, lambda e: F.get_json_object(e["value"], "$.text"))
    error = F.when(values.isNull(), "invalid JSON").when(F.exists(texts, lambda t: t.isNull()), "segment without text")
    rows = raw.select(F.col(file_col).alias("file"), texts.alias("texts"), error.alias("error"))
    good = rows.where("error is null").select("file", F.size("texts").alias("n"), F.posexplode_outer("texts").alias("at", "t"))
    counted = good.select("file", F.when(F.coalesce(F.col("at"), F.lit(0)) == 0, F.col("n")).otherwise(F.lit(0)).alias("n"), F.coalesce(count(F.col("t")), F.lit(0)).alias("k"))
    sums = counted.groupBy("file").agg(F.sum("n").cast("int").alias("n_segments"), F.sum("k").cast("long").alias("n_tokens"), F.lit(None).cast("string").alias("error"))
    bad = rows.where("error is not null").select("file", F.lit(None).cast("int").alias("n_segments"), F.lit(None).cast("long").alias("n_tokens"), "error")
    return sums.unionByName(bad)


def with_grand_total(per_file: DataFrame) -> DataFrame:
    """(file, n_files, n_segments, n_tokens): a row for each file that could be read, and one without a name for all of them."""
    good = per_file.where("error is null") if "error" in per_file.columns else per_file
    sums = [F.count("*").alias("n_files"), F.sum("n_segments").alias("n_segments"), F.sum("n_tokens").alias("n_tokens")]
    return good.rollup("file").agg(F.grouping("file").cast("int").alias("is_total"), *sums)
