"""Writing cleaned tickets, vector collections, page files and tuning results."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.operators.tickets import insert_new, numbered_batches


def write_cleaned(df: DataFrame, folder: str, single: bool = False) -> None:
    """Comma-separated files with a header; doubled quotes inside quoted fields. One file only where asked."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


def write_cleaned_file(df: DataFrame, input_file: str) -> str:
    """One file `<stem>_cleaned<suffix>` beside the input, with a byte order mark and a header, replaced if it exists; its path.

    The parts are written by the tasks and put together as streams of bytes."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    head, _, name = input_file.rpartition("/")
    stem, dot, suffix = name.rpartition(".")
    target = f"{head}/{stem}_cleaned.{suffix}" if dot and stem else f"{head}/{name}_cleaned"
    parts = f"{target}.parts"
    df.write.mode("overwrite").option("escape", '"').option("header", False).csv(parts)
    at, folder = jvm.org.apache.hadoop.fs.Path(target), jvm.org.apache.hadoop.fs.Path(parts)
    fs = at.getFileSystem(conf)
    out = fs.create(at, True)
    try:
        quoted = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\r\n') else c for c in df.columns)
        out.write(bytearray(f"\ufeff{quoted}\n".encode()))
        for path in sorted(str(s.getPath()) for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")):
            part = fs.open(jvm.org.apache.hadoop.fs.Path(path))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            finally:
                part.close()
    finally:
        out.close()
    fs.delete(folder, True)
    return target


_ABOUT = "_about.json"


def create_collection(spark: SparkSession, path: str, schema: str, **about: str) -> bool:
    """An empty collection of that schema with what is told about it, if none is there yet; whether it was made."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at):
        return False
    spark.createDataFrame([], schema).write.parquet(path)
    out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}/{_ABOUT}"), True)
    out.write(bytearray(json.dumps({"created": datetime.now().isoformat(timespec="seconds"), **about}).encode()))
    out.close()
    return True


def about_collection(spark: SparkSession, path: str) -> dict[str, str]:
    """What `create_collection` was told; empty where nothing was."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/{_ABOUT}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return {}
    part = fs.open(at)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(part, "UTF-8"))
    finally:
        part.close()


def append_new(df: DataFrame, path: str, id_col: str = "id") -> None:
    """Adds the rows whose id the collection does not hold yet; creates it if absent."""
    spark = df.sparkSession
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        old = spark.read.parquet(path)
        df = df.join(old.select(id_col), id_col, "left_anti").select(*old.columns)
    df.write.mode("append").parquet(path)


def embed_in_batches(df: DataFrame, embed: Callable[[list[str]], list[list[float]]], size: int = 500, pause: float = 0.0) -> DataFrame:
    """Adds `embedding` by calling `embed` with up to `size` documents at a time, pausing between two calls of a task."""
    schema = df.select("*", F.array().cast("array<float>").alias("embedding")).schema

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for pdf in batches:
            for at in range(0, len(pdf), size):
                if not first:
                    time.sleep(pause)
                first = False
                part = pdf.iloc[at : at + size].copy()
                part["embedding"] = embed([t or "" for t in part["document"]])
                yield part

    return df.mapInPandas(scan, schema)


def hashed_embedder(dim: int = 96) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for a hosted model: signed hashed words and word pairs, of unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        import numpy as np
        import xxhash

        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            words = t.lower().split()
            for w in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
                h = xxhash.xxh64_intdigest(w)
                out[i, h % dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()

    return embed


def write_files(df: DataFrame, folder: str, name: str = "filename", content: str = "content", order: str | None = None) -> DataFrame:
    """One text file a row in a folder that all executors share, on any file system that pyarrow knows by its address; returns
    (filename, error), nothing is raised.

    Of rows with one name the one of greatest `order` is the last writer, by default and on ties that of greatest content, so
    runs agree. A null content is an empty file."""
    last = F.struct(F.col(order), F.col(content)) if order else F.struct(F.col(content))
    chosen = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("filename")).agg(F.max(last).alias("last")).select("filename", F.col(f"last.{content}").alias("content"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        where = folder if "://" in folder else f"file://{folder}"
        files, root = fs.FileSystem.from_uri(where)
        files.create_dir(root, recursive=True)
        for pdf in batches:
            out = []
            for n, c in zip(pdf["filename"], pdf["content"]):
                try:
                    with files.open_output_stream(f"{root}/{n}") as f:
                        f.write((c or "").encode())
                    out.append((n, None))
                except (OSError, ValueError) as e:
                    out.append((n, str(e)))
            yield pd.DataFrame(out, columns=["filename", "error"])

    return chosen.mapInPandas(scan, "filename string, error string")


# The columns of the results of either search.
RANDOM_COLUMNS = "run_id int, n_neighbors int, n_components int, min_cluster_size int, label_count int, cost double"
BAYESIAN_COLUMNS = "trial_id int, n_neighbors int, n_components int, min_cluster_size int, label_count int, loss double, status string, eval_time double"


def write_tuning(trials: DataFrame, method: str, evals: int, folder: str, prefix: str = "tuning_results", now: datetime | None = None) -> str | None:
    """A CSV folder named by method, evaluations and time; missing columns become null, no trials write nothing."""
    if method not in ("random", "bayesian"):
        raise ValueError("method must be random or bayesian")
    if trials.isEmpty():
        return None
    wanted = [c.split() for c in (RANDOM_COLUMNS if method == "random" else BAYESIAN_COLUMNS).split(", ")]
    cols = [(F.col(c) if c in trials.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted]
    path = f"{folder}/{prefix}_{method}_{evals}evals_{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}"
    trials.select(*cols).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


__all__ = ["about_collection", "append_new", "create_collection", "embed_in_batches", "hashed_embedder", "insert_new", "numbered_batches", "write_cleaned", "write_cleaned_file", "write_files", "write_tuning"]
