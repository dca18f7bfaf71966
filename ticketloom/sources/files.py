"""Reading ticket exports, segmented JSON documents, vector collections and web pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ticketloom.operators.contract import FIELDS
from ticketloom.operators.tickets import segment_tokens

_CUSTOM = {"Category", "Classification", "Classification (Calculated)", "Country", "Solution", "Language", "Summary Solution", "Summary in English", "User category"}
#: The header of a raw export.
EXPORT_COLUMNS = [f"Custom field ({name})" if name in _CUSTOM else name for name, _ in FIELDS]
# Texts that stand for a missing value.
NA_VALUES = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def _as_missing(df: DataFrame, na_values: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.col(c).isin(na_values), F.col(c)) for c, t in df.dtypes if t == "string"}) if na_values else df


def read_exports(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, na_values: list[str] = NA_VALUES) -> DataFrame:
    """Semicolon-separated exports with a header, quoted fields over several lines and doubled quotes; all columns as text.

    Only the wanted columns are parsed. The files' header must hold each of them; the first bad file fails the read."""
    columns = columns or EXPORT_COLUMNS
    paths = [paths] if isinstance(paths, str) else paths
    reader = spark.read.option("sep", ";").option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST")
    parts = None
    for p in paths:
        df = reader.csv(p)
        names: dict[str, str] = {}
        for i, c in enumerate(df.columns):  # a repeated header name comes with its position behind it; the first is meant
            name = c.lstrip("\ufeff")
            plain = name[: -len(str(i))] if name.endswith(str(i)) and name not in columns else name
            names.setdefault(plain if plain in columns else name, c)
        missing = [c for c in columns if c not in names]
        if missing:
            raise ValueError(f"{p} has no columns {missing}")
        df = df.select(*[F.col(f"`{names[c]}`").alias(c) for c in columns], F.input_file_name().alias("export_file"))
        parts = df if parts is None else parts.unionByName(df)
    return _as_missing(parts, na_values)


def read_cleaned(spark: SparkSession, folder: str, suffix: str = "_cleaned.csv") -> DataFrame:
    """All comma-separated files of a folder whose name ends in the suffix; a byte order mark is dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("pathGlobFilter", f"*{suffix}").csv(folder)
    return df.withColumnsRenamed({c: c.lstrip("\ufeff") for c in df.columns if c.startswith("\ufeff")})


def read_segmented_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_segments, n_tokens, error) of one .json file or of the .json files of a folder, not of its subfolders.

    Another suffix, a missing path and a folder without such files are errors."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    if fs.getFileStatus(at).isFile():
        if not path.lower().endswith(".json"):
            raise ValueError(f"{path} is no .json file")
    elif not any(s.isFile() and s.getPath().getName().endswith(".json") for s in fs.listStatus(at)):
        raise ValueError(f"{path} holds no .json file")
    text = spark.read.option("pathGlobFilter", "*.[jJ][sS][oO][nN]").text(path, wholetext=True).withColumn("file", F.input_file_name())
    return segment_tokens(text, "file", "value")


def read_collection(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A vector collection; metadata fields become columns. Only the wanted columns are read."""
    df = spark.read.parquet(path)
    if "metadata" in df.columns:
        df = df.select(*[c for c in df.columns if c != "metadata"], "metadata.*")
    return df.select(*columns) if columns else df


def collection_count(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).count()


Fetch = Callable[[str, float], tuple[int, str]]


def http_fetch(url: str, timeout: float) -> tuple[int, str]:
    """Status and text of one request, on the standard library."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": "ticketloom"}), timeout=timeout) as r:  # noqa: S310
        return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")


def fetch_pages(urls: DataFrame, fetch: Fetch = http_fetch, timeout: float = 30.0, delay: float = 1.0) -> DataFrame:
    """(url, status, html, error): one request a row, `delay` seconds before each; what fails becomes a row with its error."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for pdf in batches:
            out = []
            for url in pdf["url"]:
                time.sleep(delay)
                try:
                    status, html = fetch(url, timeout)
                    out.append((url, status, html, None) if 200 <= status < 300 else (url, status, None, f"status {status}"))
                except Exception as e:
                    out.append((url, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["url", "status", "html", "error"]).astype({"status": "Int64"})

    return urls.select("url").mapInPandas(scan, "url string, status long, html string, error string")


def literal_pages(spark: SparkSession, base: str, slugs: list[str]) -> DataFrame:
    """(url) of fixed pages below a base URL."""
    from urllib.parse import urljoin

    return spark.createDataFrame([(urljoin(base, s),) for s in slugs], StructType([StructField("url", StringType())]))
