"""Mixing sources to target weights.

Tokens are counted per document with a public tokenizer, summed per source, and turned into repetition rates. Each
document is emitted floor(rate) times and once more when its seeded hash falls below the rate's fraction.

Sources without a target (null ones too) get rate 0, sources without documents are left out and the remaining targets
scaled to sum 1. Without `total_tokens` the total is the largest at which every source reaches its target within its
cap, so the shares come out exact up to the last Bernoulli copy; with it, a source whose cap is too small falls short and
the report says so. A null text counts 0 tokens, an empty one too. Repeated ids draw the same copy. Ties cannot
occur. Empty tables give empty results. Columns of the input all stay; one named copy_no is replaced.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.functions.tokens import TOKENIZER, token_count

#: At most so many sources may have a target; the rates are sent to every task.
MAX_SOURCES = 10_000


def draw(id_col: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11).cast("double") / F.lit(float(2**53))


def source_tokens(docs: DataFrame, source_col: str = "source", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(source, n_docs, n_tokens), summed before the shuffle."""
    counted = docs.select(F.col(source_col).alias("source"), token_count(F.col(text_col), tokenizer).alias("n"))
    return counted.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))


def rates(tokens: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[dict]:
    """One dict per target: source_name, target_share, max_repeats, n_docs, n_tokens, rate.

    Reads as many rows as there are targets, which `MAX_SOURCES` bounds."""
    t = targets.where("source_name is not null").groupBy("source_name").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = t.join(tokens, t.source_name == tokens.source, "left").select("source_name", "target_share", "max_repeats", "n_docs", "n_tokens").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have targets")
    out = [r.asDict() | {"n_docs": r.n_docs or 0, "n_tokens": r.n_tokens or 0, "rate": 0.0} for r in sorted(rows, key=lambda r: r.source_name)]
    live = [r for r in out if r["n_tokens"] and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0]
    whole = sum(r["target_share"] for r in live)
    if live and total_tokens is None:
        total_tokens = min(r["max_repeats"] * r["n_tokens"] * whole / r["target_share"] for r in live)
    for r in live:
        r["rate"] = min(float(r["max_repeats"]), r["target_share"] / whole * total_tokens / r["n_tokens"])
        if abs(r["rate"] - round(r["rate"])) < 1e-9:  # a cap reached exactly
            r["rate"] = float(round(r["rate"]))
    return out


def with_copies(docs: DataFrame, plan: list[dict], id_col: str = "doc_id", source_col: str = "source", seed: int = 17) -> DataFrame:
    """`docs` with n_copies, from the rate of its source; the plan holds one row a source, bounded by `MAX_SOURCES`."""
    rate = docs.sparkSession.createDataFrame([(r["source_name"], float(r["rate"])) for r in plan], "_source string, _rate double")
    joined = docs.join(F.broadcast(rate), F.col(source_col) == F.col("_source"), "left")
    whole = F.floor(F.coalesce("_rate", F.lit(0.0)))
    copies = (whole + (draw(id_col, seed) < F.coalesce("_rate", F.lit(0.0)) - whole).cast("long")).cast("int")
    return joined.withColumn("n_copies", copies).drop("_source", "_rate")


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17, total_tokens: int | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """`docs` repeated to the target shares, with copy_no from 1. No text is shuffled: rates are sent to the rows."""
    plan = rates(source_tokens(docs, source_col, text_col, tokenizer), targets, total_tokens)
    out = with_copies(docs.drop("copy_no"), plan, id_col, source_col, seed).where("n_copies > 0")
    return out.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies")))).drop("n_copies")


def mix_report(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17, total_tokens: int | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per target source: what there is, the rate, and the share that the mix really has."""
    from ticketloom.session import written

    counted = written(docs.select(F.col(id_col), F.col(source_col), token_count(F.col(text_col), tokenizer).alias("n")))
    tokens = counted.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))
    plan = rates(tokens, targets, total_tokens)
    got = with_copies(counted, plan, id_col, source_col, seed).groupBy(F.col(source_col).alias("source_name"))
    got = got.agg(F.sum("n_copies").alias("emitted_docs"), F.sum(F.col("n") * F.col("n_copies")).alias("emitted_tokens"))
    rows = [tuple(r[k] for k in ("source_name", "target_share", "max_repeats", "n_docs", "n_tokens", "rate")) for r in plan]
    base = docs.sparkSession.createDataFrame(rows, "source_name string, target_share double, max_repeats int, n_docs long, n_tokens long, rate double")
    out = base.join(got, "source_name", "left").fillna(0, ["emitted_docs", "emitted_tokens"])
    total = F.sum("emitted_tokens").over(Window.partitionBy())  # MAX_SOURCES rows at most
    return out.withColumn("actual_share", F.when(total > 0, F.col("emitted_tokens") / total).otherwise(0.0))
