"""Profiling metadata and making plot tables of clustered points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.functions import text

# Columns that are no colour keys, and long texts that no hover table shows.
NOT_KEYS = {"doc_id", "document_text", "description", "summary", "summary_solution", "summary_in_english"}
LONG_TEXTS = {"description", "solution", "summary_solution", "summary_in_english", "document_text"}
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "timestamp", "timestamp_ntz", "date", "decimal")


def color_keys(df: DataFrame, most: int = 50) -> DataFrame:
    """(column_name, n_distinct) of the columns that can colour points: texts and booleans with a value, numbers and times with
    fewer than `most` different ones. One aggregate over all columns."""
    names = [f.name for f in df.schema.fields if f.name not in NOT_KEYS and f.dataType.simpleString().split("(")[0] in (*NUMBERS, "string", "boolean")]
    free = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("string", "boolean")}
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, n_distinct long")
    counts = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in names])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_distinct"), F.lit(c in free).alias("free")) for c in names]))
    return counts.select(rows.alias("r")).select("r.*").where((F.col("n_distinct") > 0) & (F.col("free") | (F.col("n_distinct") < most))).drop("free")


def trimmed(df: DataFrame, axes: list[str], q: float = 0.025) -> DataFrame:
    """The rows within the exact q and 1 - q quantiles of every axis; all rows if none is. Bounds come from all rows."""
    bounds = df.agg(*[F.percentile(c, F.array(F.lit(q), F.lit(1 - q))).alias(c) for c in axes]).first()
    if any(bounds[c] is None for c in axes):
        return df
    keep: Column = F.lit(True)
    for c in axes:
        keep = keep & F.col(c).between(bounds[c][0], bounds[c][1])
    kept = df.where(keep)
    return df if kept.isEmpty() else kept


def coordinates(df: DataFrame, vector_col: str, dims: int) -> DataFrame:
    """Adds x, y and for three dimensions z from the first numbers of the vector."""
    if dims not in (2, 3):
        raise ValueError("a plot has 2 or 3 dimensions")
    return df.withColumns({name: F.get(vector_col, F.lit(i)).cast("double") for i, name in zip(range(dims), "xyz")})


def label_histogram(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(label), F.lit(-1)).alias("label")).count().select(text.label_text(F.col("label")).alias("label"), F.col("count").alias("n"))


def noise_stats(df: DataFrame, label: str) -> DataFrame:
    """One row: clusters without noise, rows of noise, rows."""
    v = F.coalesce(F.col(label), F.lit(-1))
    return df.agg(F.count_distinct(F.when(v != -1, v)).alias("n_clusters"), F.count_if(v == -1).alias("n_noise"), F.count("*").alias("n_rows"))


def cluster_score(df: DataFrame, label: str, probability: str, threshold: float = 0.05) -> DataFrame:
    """One row: label_count without noise, and cost, the share of rows below the probability; (0, 1.0) for no rows."""
    count = F.count_distinct(F.when(F.col(label) != -1, F.col(label)))
    low = F.avg((F.coalesce(F.col(probability), F.lit(0.0)) < threshold).cast("double"))
    return df.agg(count.alias("label_count"), F.round(F.coalesce(low, F.lit(1.0)), 6).alias("cost"))


def hover_columns(df: DataFrame, color: str | None = None) -> list[str]:
    names = [c for c in df.columns if c not in LONG_TEXTS and c not in ("hover_text", color)]
    return ["hover_text", *names, *([color] if color else [])]


def hover_always(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("hover_text", text.cut_always(F.col(source)))


def hover_long(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("hover_text", text.cut_long(F.col(source)))


def formatted(fields: list[str] | dict[str, str]) -> Column:
    """`name: value` lines of the fields that are not null; a dict gives the columns other names."""
    names = fields if isinstance(fields, dict) else {c: c for c in fields}
    return F.concat_ws("\n", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"))) for c, name in names.items()])


def color_key(choices: list[str], choice: str | int | None) -> str:
    """The chosen key by name or number (from 1), else cluster_label, else the first."""
    if isinstance(choice, str) and choice.strip().isdigit():
        choice = int(choice)
    if isinstance(choice, int) and 1 <= choice <= len(choices):
        return choices[choice - 1]
    if choice in choices:
        return choice
    return "cluster_label" if "cluster_label" in choices or not choices else choices[0]


def with_labels(metadata: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "cluster_label") -> DataFrame:
    """The metadata rows with the label of their id (labels: id, label); rows without one are noise. An older column of that
    name is replaced; of several labels of an id the least counts, so no row is doubled."""
    one = labels.groupBy(F.col("id").alias(id_col)).agg(F.min(label).alias(label))
    return metadata.drop(label).join(one, id_col, "left").withColumn(label, F.coalesce(label, F.lit(-1)))


def aligned(df: DataFrame, lists: list[str]) -> DataFrame:
    """The list columns cut to the shortest one of their row, as one row a position (from 0) and a column for each list. A null
    list makes no row, like an empty one."""
    n = F.least(*[F.coalesce(F.size(c), F.lit(0)) for c in lists]) if len(lists) > 1 else F.coalesce(F.size(lists[0]), F.lit(0))
    cut = [F.slice(c, F.lit(1), F.greatest(n, F.lit(0))).alias(c) for c in lists]
    rest = [c for c in df.columns if c not in lists]
    return df.select(*rest, *cut).select(*rest, F.posexplode(F.arrays_zip(*lists)).alias("position", "_item")).select(*rest, "position", *[F.col(f"_item.{c}").alias(c) for c in lists])


# The metadata shown beside a search result, and the names they are shown under.
SHOWN = {
    "issue_key": "Issue key", "issue_type": "Issue Type", "status": "Status", "priority": "Priority", "category": "Category", "classification": "Classification",
    "country": "Country", "user_category": "User category", "token_count": "token_count",
}


def search_results(hits: DataFrame, documents: DataFrame, id_col: str, document: str) -> DataFrame:
    """(query_id, rank, id, document, shown, relevance): each hit (query_id, id, distance, rank) as it is shown."""
    fields = {c: n for c, n in SHOWN.items() if c in documents.columns}
    shown = documents.select(F.col(id_col).alias("id"), F.col(document).alias("document"), formatted(fields).alias("shown"))
    return hits.join(shown, "id").select("query_id", "rank", "id", "document", "shown", F.round(1 - F.col("distance"), 4).alias("relevance"))
