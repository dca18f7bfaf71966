"""Queries on vectors, clusters and tuning runs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.functions import text
from ticketloom.operators import density, explore, tickets, tuning, vectors
from ticketloom.session import read, written

K = 5


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 6))


def _vectors(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "embeddings")


def vector_topk_l2(spark: SparkSession, root: str) -> DataFrame:
    """Every vector whose id is divisible by 50, against all."""
    v = _vectors(spark, root)
    return _rounded(vectors.nearest(v, v.where("vec_id % 50 = 0"), K, "l2")).withColumn("relevance", F.round(1 - F.col("distance"), 4))


def vector_topk_cosine(spark: SparkSession, root: str) -> DataFrame:
    v = _vectors(spark, root)
    return _rounded(vectors.nearest(v, v.where("vec_id % 50 = 0"), K, "cosine"))


def vector_dim_check(spark: SparkSession, root: str) -> DataFrame:
    return vectors.dimension_offenders(read(spark, root, "helpdesk_summaries_embeddings"), "doc_id", "embeddings", 96).select("id", "dimension")


def knn_graph(spark: SparkSession, root: str) -> DataFrame:
    v = _vectors(spark, root)
    return _rounded(vectors.nearest(v, v, 10, "euclidean", skip_self=True))


def core_distance(spark: SparkSession, root: str) -> DataFrame:
    v = _vectors(spark, root)
    return vectors.core_distances(vectors.nearest(v, v, 10, "euclidean", skip_self=True), 10).withColumn("core", F.round("core", 6))


def mutual_reachability(spark: SparkSession, root: str) -> DataFrame:
    v = _vectors(spark, root)
    graph = written(vectors.nearest(v, v, 10, "euclidean", skip_self=True))
    return vectors.mutual_reachability(graph, vectors.core_distances(graph, 10)).withColumn("weight", F.round("weight", 6))


def collection_upsert_ignore(spark: SparkSession, root: str) -> DataFrame:
    """Even ids exist; all are offered again with another label."""
    v = _vectors(spark, root)
    old = v.where("vec_id % 2 = 0").select("vec_id", "label")
    return tickets.insert_new(old, v.select("vec_id", (F.col("label") + 1000).alias("label")), "vec_id")


def color_key_profile(spark: SparkSession, root: str) -> DataFrame:
    return explore.color_keys(read(spark, root, "helpdesk_summaries_embeddings").drop("embeddings"))


def label_histogram(spark: SparkSession, root: str) -> DataFrame:
    return explore.label_histogram(read(spark, root, "helpdesk_summaries_embeddings"), "cluster_label")


def label_noise_stats(spark: SparkSession, root: str) -> DataFrame:
    return explore.noise_stats(read(spark, root, "helpdesk_summaries_embeddings"), "cluster_label")


def cluster_score(spark: SparkSession, root: str) -> DataFrame:
    return explore.cluster_score(read(spark, root, "helpdesk_summaries_embeddings").where("cluster_label is not null"), "cluster_label", "probability")


def _trim(spark: SparkSession, root: str, dims: int) -> DataFrame:
    axes = list("xyz"[:dims])
    placed = explore.coordinates(_vectors(spark, root), "embedding", dims)
    return explore.trimmed(placed, axes).select("vec_id", *axes)


def outlier_trim_2d(spark: SparkSession, root: str) -> DataFrame:
    return _trim(spark, root, 2)


def outlier_trim_3d(spark: SparkSession, root: str) -> DataFrame:
    return _trim(spark, root, 3)


def _hover(spark: SparkSession, root: str) -> DataFrame:
    docs = read(spark, root, "documents").select("doc_id", "text", "source", "components")
    return docs.join(_vectors(spark, root).select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")


def hover_table_a(spark: SparkSession, root: str) -> DataFrame:
    return explore.hover_always(_hover(spark, root), "text").drop("text")


def hover_table_b(spark: SparkSession, root: str) -> DataFrame:
    return explore.hover_long(_hover(spark, root), "text").drop("text")


_TICKET_FIELDS = ["issue_type", "status", "priority", "category", "classification", "user_category"]


def _shown(spark: SparkSession, root: str) -> DataFrame:
    """The embedded summaries with the fields that are shown beside a result; those of the ticket from its last export."""
    last = F.max_by(F.struct(*_TICKET_FIELDS), "exported_at").alias("t")
    tickets_ = read(spark, root, "tickets").groupBy("issue_id").agg(last).select("issue_id", "t.*")
    return read(spark, root, "helpdesk_summaries_embeddings").join(tickets_, "issue_id", "left")


def result_metadata(spark: SparkSession, root: str) -> DataFrame:
    return _shown(spark, root).select("doc_id", "embedded_at", explore.formatted(explore.SHOWN).alias("shown"))


def query_results(spark: SparkSession, root: str) -> DataFrame:
    """The summaries of issues whose id is divisible by 50, against all: document, metadata and relevance of each hit."""
    v = F.col("embeddings")
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    valid = _shown(spark, root).where((F.size(v) == 96) & (square > 0) & (square < float("inf")) & ~F.isnan(square))
    fields = [c for c in valid.columns if c != "issue_id"]
    one = valid.groupBy("issue_id").agg(F.max_by(F.struct(*fields), "embedded_at").alias("r")).select("issue_id", "r.*")
    one = written(one)
    hits = vectors.nearest(one, one.where("issue_id % 50 = 0"), K, "l2", "issue_id", "embeddings")
    return explore.search_results(hits, one, "issue_id", "doc_text")


def labels_joined(spark: SparkSession, root: str) -> DataFrame:
    """Documents with the label of the vector of their number; those without are noise."""
    labels = _vectors(spark, root).select(F.col("vec_id").alias("id"), "label")
    return explore.with_labels(read(spark, root, "documents").select("doc_id", "source"), labels, "doc_id", "label")


def label_names(spark: SparkSession, root: str) -> DataFrame:
    label = text.label_text_or_unknown(F.col("cluster_label"))
    return read(spark, root, "helpdesk_summaries_embeddings").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def aligned_lists(spark: SparkSession, root: str) -> DataFrame:
    """A document's words and lines as two lists, cut to the shorter one."""
    lists = read(spark, root, "documents").select("doc_id", F.split("text", " ", -1).alias("word"), F.split("text", "\n", -1).alias("line"))
    return explore.aligned(lists, ["word", "line"])


def tuning_grid(spark: SparkSession, root: str) -> DataFrame:
    return tuning.grid(spark)


def tuning_select_best(spark: SparkSession, root: str) -> DataFrame:
    return tuning.select_best(read(spark, root, "tuning_trials").where("trial_status = 'ok'"), "loss", "trial_id", 10, 75)


def tuning_losses(spark: SparkSession, root: str) -> DataFrame:
    t = read(spark, root, "tuning_trials").where("loss is not null and label_count is not null")
    return t.select("trial_id", F.round(tuning.loss(F.col("loss"), F.col("label_count")), 6).alias("penalised"))


def hdbscan_labels(spark: SparkSession, root: str) -> DataFrame:
    return density.hdbscan(_vectors(spark, root), 10)


def umap_layout(spark: SparkSession, root: str) -> DataFrame:
    return explore.coordinates(density.umap(_vectors(spark, root), density.Layout()), "v", 3).select("id", "x", "y", "z")


def _tuned(spark: SparkSession, root: str, method: str) -> DataFrame:
    v = _vectors(spark, root).cache()
    found = tuning.tune(method, lambda p: density.score_configuration(v, p))
    v.unpersist()
    return found.table(spark)


def cluster_tune_random(spark: SparkSession, root: str) -> DataFrame:
    return _tuned(spark, root, "random")


def cluster_tune_tpe(spark: SparkSession, root: str) -> DataFrame:
    return _tuned(spark, root, "bayesian")


def clustering_final_run(spark: SparkSession, root: str) -> DataFrame:
    """The vectors clustered with the best configuration of the recorded trials, with their coordinates for a plot."""
    ok = read(spark, root, "tuning_trials").where("trial_status = 'ok'")
    best = tuning.select_best(ok, "loss", "trial_id").first().asDict()
    return explore.coordinates(density.final_run(_vectors(spark, root), best, 3), "v", 3).drop("v")


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk_l2, vector_topk_cosine, vector_dim_check, knn_graph, core_distance, mutual_reachability, collection_upsert_ignore, color_key_profile, label_histogram,
        label_noise_stats, cluster_score, outlier_trim_2d, outlier_trim_3d, hover_table_a, hover_table_b, result_metadata, query_results, labels_joined, label_names, aligned_lists, clustering_final_run, tuning_grid, tuning_select_best, tuning_losses,
        hdbscan_labels, umap_layout, cluster_tune_random, cluster_tune_tpe,
    )
}

_L2 = "list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))"
_COS = "1 - list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: z[1]::double * z[2]::double)) / sqrt(list_sum(list_transform(q.embedding, lambda z: z::double * z::double)) * list_sum(list_transform(e.embedding, lambda z: z::double * z::double)))"


def _topk(distance: str, where: str, k: int) -> str:
    return f"""select query_id, id, round(distance, 6) as distance, cast(rank as integer) as rank from (
  select q.vec_id as query_id, e.vec_id as id, {distance} as distance, row_number() over (partition by q.vec_id order by {distance}, e.vec_id) as rank
  from embeddings q, embeddings e where {where}) where rank <= {k}"""


_GRAPH = _topk(f"sqrt({_L2})", "q.vec_id <> e.vec_id", 10)
_RAW = _GRAPH.replace("round(distance, 6) as distance", "distance")
_KEYS = ["issue_id", "issue_key", "doc_text", "components", "country", "token_count", "cluster_label", "probability", "embedded_at"]
_FREE = {"issue_key", "doc_text", "components", "country"}


_SHOWN_LINES = ", ".join(f"'{name}: ' || cast({column} as varchar)" for column, name in explore.SHOWN.items())
_SHOWN_SQL = f"""t as (select issue_id, {", ".join(_TICKET_FIELDS)} from tickets qualify row_number() over (partition by issue_id order by exported_at desc) = 1),
s as (select h.*, concat_ws(chr(10), {_SHOWN_LINES}) as shown from helpdesk_summaries_embeddings h left join t using (issue_id))"""


def _trim_sql(dims: int) -> str:
    axes = "xyz"[:dims]
    cols = ", ".join(f"embedding[{i}]::double as {c}" for i, c in enumerate(axes, 1))
    bounds = ", ".join(f"quantile_cont({c}, 0.025) as {c}0, quantile_cont({c}, 0.975) as {c}1" for c in axes)
    inside = " and ".join(f"{c} between {c}0 and {c}1" for c in axes)
    return f"with p as (select vec_id, {cols} from embeddings), b as (select {bounds} from p) select vec_id, {', '.join(axes)} from p, b where {inside}"


SQL = {
    "vector_topk_l2": f"select *, round(1 - distance, 4) as relevance from ({_topk(_L2, 'q.vec_id % 50 = 0', K)})",
    "vector_topk_cosine": _topk(_COS, "q.vec_id % 50 = 0", K),
    "vector_dim_check": "select doc_id as id, len(embeddings) as dimension from helpdesk_summaries_embeddings where embeddings is not null and len(embeddings) <> 96",
    "knn_graph": _GRAPH,
    "core_distance": f"select query_id as id, round(max(distance), 6) as core from ({_RAW}) group by query_id",
    "mutual_reachability": f"""
with g as ({_RAW}), c as (select query_id as id, max(distance) as core from g group by query_id)
select a, b, round(min(greatest(distance, ca.core, cb.core)), 6) as weight
from (select distinct least(query_id, id) as a, greatest(query_id, id) as b, distance from g) e join c ca on ca.id = a join c cb on cb.id = b group by a, b""",
    "collection_upsert_ignore": "select vec_id, case when vec_id % 2 = 0 then label else label + 1000 end as label from embeddings",
    "color_key_profile": "select column_name, n_distinct from ("
    + " union all ".join(f"select '{c}' as column_name, count(distinct {c}) as n_distinct, {str(c in _FREE).lower()} as free from helpdesk_summaries_embeddings" for c in _KEYS)
    + ") where n_distinct > 0 and (free or n_distinct < 50)",
    "label_histogram": "select case when coalesce(cluster_label, -1) = -1 then 'Noise' else cast(cluster_label as varchar) end as label, count(*) as n from helpdesk_summaries_embeddings group by 1",
    "label_noise_stats": "select count(distinct case when cluster_label <> -1 then cluster_label end) as n_clusters, count(*) filter (coalesce(cluster_label, -1) = -1) as n_noise, count(*) as n_rows from helpdesk_summaries_embeddings",
    "cluster_score": "select count(distinct case when cluster_label <> -1 then cluster_label end) as label_count, round(coalesce(avg(case when coalesce(probability, 0) < 0.05 then 1.0 else 0.0 end), 1.0), 6) as cost from helpdesk_summaries_embeddings where cluster_label is not null",
    "outlier_trim_2d": _trim_sql(2),
    "outlier_trim_3d": _trim_sql(3),
    "hover_table_a": "select d.doc_id, source, components, label, substr(text, 1, 100) || '...' as hover_text from documents d join embeddings e on e.vec_id = d.doc_id",
    "hover_table_b": "select d.doc_id, source, components, label, case when length(text) > 100 then substr(text, 1, 97) || '...' else text end as hover_text from documents d join embeddings e on e.vec_id = d.doc_id",
    "result_metadata": f"with {_SHOWN_SQL} select doc_id, embedded_at, shown from s",
    "query_results": f"""
with {_SHOWN_SQL}, q as (select *, list_sum(list_transform(embeddings, lambda x: x::double * x::double)) as square from s),
v as (select * from q where len(embeddings) = 96 and square > 0 and isfinite(square) qualify row_number() over (partition by issue_id order by embedded_at desc) = 1),
d as (select a.issue_id as query_id, b.issue_id as id, b.doc_text as document, b.shown, list_sum(list_transform(list_zip(a.embeddings, b.embeddings), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))) as distance
  from v a, v b where a.issue_id % 50 = 0)
select query_id, cast(row_number() over (partition by query_id order by distance, id) as integer) as rank, id, document, shown, round(1 - distance, 4) as relevance from d
qualify row_number() over (partition by query_id order by distance, id) <= {K}""",
    "labels_joined": "select doc_id, source, coalesce(label, -1) as label from documents left join (select vec_id, min(label) as label from embeddings group by vec_id) on vec_id = doc_id",
    "label_names": "select case when cluster_label is null then 'Unknown' when cluster_label = -1 then 'Noise' else cast(cluster_label as varchar) end as label, count(*) as n from helpdesk_summaries_embeddings group by 1",
    "aligned_lists": """
with l as (select doc_id, string_split(text, ' ') as w, string_split(text, chr(10)) as s from documents where text is not null)
select doc_id, cast(i - 1 as integer) as position, w[i] as word, s[i] as line from (select *, unnest(range(1, least(len(w), len(s)) + 1)) as i from l)""",
    "tuning_grid": "select n_neighbors, n_components, min_cluster_size from (select unnest(range(5, 51, 5))::integer as n_neighbors), (select unnest(range(3, 16, 2))::integer as n_components), (select unnest(range(5, 31, 5))::integer as min_cluster_size)",
    "tuning_select_best": "select * from tuning_trials where trial_status = 'ok' and loss is not null order by coalesce(label_count between 10 and 75, false) desc, loss, trial_id limit 1",
    "tuning_losses": "select trial_id, round(loss + case when label_count between 10 and 75 then 0.0 else 0.15 end, 6) as penalised from tuning_trials where loss is not null and label_count is not null",
}
