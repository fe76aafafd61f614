"""Queries: splits, scaling, projection, training, scoring, neighbours and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowdrift.operators import explain, metrics, ml, neighbours, sampling
from flowdrift.plans.registry import query
from flowdrift.plans.tables import RAW_FLOWS_SQL, flows, raw_flows, rounded, table

MODEL_COLUMNS = ["tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts", "flow_duration", "pkt_len_mean", "fwd_iat_mean", "dst_port"]


@query(
    "g1_standardize",
    """WITH s AS (SELECT avg(l_quantity) AS qm, stddev_pop(l_quantity) AS qs, avg(l_extendedprice) AS pm, stddev_pop(l_extendedprice) AS ps FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, cast(l_linenumber AS bigint) AS l_linenumber, round((l_quantity - qm) / qs, 6) AS l_quantity,
 round((l_extendedprice - pm) / ps, 6) AS l_extendedprice, 0.0::double AS constant FROM lineitem, s""",
)
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    lines = table(spark, sf_dir, "lineitem").select(*keys, "l_quantity", "l_extendedprice", F.lit(3.5).alias("constant"))
    return rounded(ml.standardize(lines, ["l_quantity", "l_extendedprice", "constant"]))


@query(
    "b12_align_to_model",
    f"""WITH {RAW_FLOWS_SQL}, s AS (SELECT avg(tot_fwd_pkts) AS fm, stddev_pop(tot_fwd_pkts) AS fs, avg(totlen_fwd_pkts) AS bm,
 stddev_pop(totlen_fwd_pkts) AS bs FROM raw_flows)
SELECT event_id, [round((tot_fwd_pkts - fm) / fs, 6), 0.0::double,
  round(CASE WHEN event_id % 9 = 0 THEN 0 ELSE (totlen_fwd_pkts - bm) / bs END, 6)] AS features FROM raw_flows, s""",
)
def align_to_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trained column is missing and another has gaps: both read as the training mean, in trained order."""
    rows = raw_flows(spark, sf_dir)
    fitted = ml.PipelineModel(stages=ml.fit_features(rows, ["tot_fwd_pkts", "flow_duration", "totlen_fwd_pkts"])[0])
    arriving = rows.select("event_id", F.when(F.col("event_id") % 9 != 0, F.col("totlen_fwd_pkts")).alias("totlen_fwd_pkts"), "tot_fwd_pkts")
    aligned = fitted.transform(ml.align_to_model(arriving, fitted))
    # adding 0.0 turns a rounded negative zero into zero
    return aligned.select("event_id", F.transform(ml.vector_to_array("features"), lambda x: F.round(x, 6) + 0.0).alias("features"))


_POSITIONS_SQL = """placed AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(cast(doc_id AS varchar)), doc_id) AS pos,
 count(*) OVER (PARTITION BY quality) AS n, row_number() OVER (ORDER BY md5(cast(doc_id AS varchar)), doc_id) AS pos_all, count(*) OVER () AS n_all FROM labels)"""


@query("g4_split", f"WITH {_POSITIONS_SQL} SELECT doc_id, pos_all <= floor(n_all * 0.8::double + 0.5) AS is_train FROM placed")
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "is_train")


@query(
    "g4_stratified_split",
    f"WITH {_POSITIONS_SQL} SELECT doc_id, cast(quality AS bigint) AS quality, pos <= floor(n * 0.8::double + 0.5) AS is_train FROM placed",
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sampling.split(table(spark, sf_dir, "labels"), "doc_id", label="quality").select("doc_id", "quality", "is_train"))


@query(
    "g5_stratified_folds",
    f"""WITH {RAW_FLOWS_SQL}, placed AS (SELECT event_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(cast(event_id AS varchar)), event_id) AS pos FROM raw_flows)
SELECT event_id, label, cast((pos - 1) % 10 AS bigint) AS fold FROM placed""",
)
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_flows(spark, sf_dir).select("event_id", "label")
    return rounded(sampling.stratified_folds(rows, "event_id", "label", 10))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with a binary label: attacks are the errors and signups."""
    attack = (F.col("label") != "Benign").cast("double")
    return flows(spark, sf_dir).select("event_id", "timestamp", *MODEL_COLUMNS, F.col("label").alias("name"), attack.alias("label"))


def multi_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.when(F.col("name") == "Benign", 0.0).when(F.col("name") == "TCPAttack", 1.0).otherwise(2.0)
    return labelled(spark, sf_dir).withColumn("label", number)


def _train_report(df: DataFrame, variant: str, task: str = "binary", use_pca: bool = False, **overrides) -> DataFrame:
    marked = sampling.split(df, "event_id")
    fitted = ml.train(marked.filter("is_train"), MODEL_COLUMNS, variant=variant, task=task, use_pca=use_pca,
                      n_classes=2 if task == "binary" else 3, **overrides)
    held_out = ml.score(marked.filter("NOT is_train"), fitted, task=task, names=["Benign", "TCPAttack", "UDPAttack"])
    return metrics.classification_report(held_out).withColumn("variant", F.lit(variant))


@query("g2_pca_components")
def pca_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    stages, vector = ml.fit_features(rows, MODEL_COLUMNS, use_pca=True)
    projected = ml.PipelineModel(stages=stages).transform(rows)
    return projected.select("event_id", ml.vector_to_array(vector).alias("components"))


@query("g3_explained_variance_table")
def explained_variance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages, _ = ml.fit_features(labelled(spark, sf_dir), MODEL_COLUMNS, use_pca=True)
    return ml.explained_variance_table(stages[-2], spark)


@query("g6_cv_accuracy")
def cv_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    stages, vector = ml.fit_features(rows, MODEL_COLUMNS)
    prepared = ml.PipelineModel(stages=stages).transform(rows).select("event_id", vector, "label")
    return ml.cv_accuracy(prepared, ml.make_estimator("dt", maxDepth=5), "event_id")


@query("g7_train_rf")
def train_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _train_report(labelled(spark, sf_dir), "rf", numTrees=10, maxDepth=6)


@query("g7_train_dt_multi")
def train_dt_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _train_report(multi_labelled(spark, sf_dir), "dt", "multi", use_pca=True, maxDepth=8)


@query("g8_train_gbt")
def train_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _train_report(labelled(spark, sf_dir), "gbt", maxIter=4, maxDepth=4)


@query("g8_train_gbt_multi")
def train_gbt_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _train_report(multi_labelled(spark, sf_dir), "gbt", "multi", maxIter=3, maxDepth=3)


@query("g9_train_svm_linear")
def train_svm_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _train_report(labelled(spark, sf_dir), "svm", kernel="linear", maxIter=10)


@query("g9_train_svm_poly")
def train_svm_poly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _train_report(labelled(spark, sf_dir), "svm", kernel="poly", degree=2, maxIter=10)


@query("g9_train_svm_rbf_multi")
def train_svm_rbf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _train_report(multi_labelled(spark, sf_dir), "svm", "multi", kernel="rbf", dims=32, maxIter=10)


@query("g10_train_mlp")
def train_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _train_report(labelled(spark, sf_dir), "mlp", maxIter=20)


@query("g10_train_mlp_multi")
def train_mlp_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _train_report(multi_labelled(spark, sf_dir), "mlp", "multi", maxIter=20)


_KNN_SQL = """near AS (SELECT t.vec_id, e.vec_id AS id, e.label,
  round(list_sum(list_transform(list_zip(t.embedding, e.embedding), lambda p: (p[1]::double - p[2]::double) ** 2)), 9) AS squared
  FROM embeddings t, embeddings e),
top AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY squared, id) <= 5),
votes AS (SELECT vec_id, label, count(*) AS n FROM top GROUP BY ALL)"""


def _knn(spark: SparkSession, sf_dir: str, **bounds: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("x", F.col("embedding").cast("array<double>"))
    return neighbours.knn(vectors, vectors, 5, "vec_id", "x", "vec_id", "label", **bounds)


@query(
    "g11_knn",
    f"WITH {_KNN_SQL} SELECT vec_id, cast(arg_max(label, (n, -label)) AS bigint) AS prediction FROM votes GROUP BY vec_id",
)
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir).select("vec_id", neighbours.knn_vote(F.col("neighbours")).alias("prediction"))


@query(
    "g11_knn_blocks",
    f"WITH {_KNN_SQL} SELECT vec_id, cast(arg_max(label, (n, -label)) AS bigint) AS prediction FROM votes GROUP BY vec_id",
)
def knn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search with small blocks."""
    near = _knn(spark, sf_dir, block_rows=200, test_rows=400)
    return near.select("vec_id", neighbours.knn_vote(F.col("neighbours")).alias("prediction"))


@query("g12_score")
def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    fitted = ml.train(rows, MODEL_COLUMNS, variant="dt", maxDepth=5)
    return ml.score(rows.drop("fwd_iat_mean"), fitted, threshold=0.5).select("event_id", "prediction", "predicted_name")


@query(
    "g13_score_trailing",
    f"""WITH {RAW_FLOWS_SQL}, chunked AS (SELECT event_id, label <> 'Benign' AS attack, epoch_us(timestamp) AS end_us,
 (row_number() OVER (ORDER BY timestamp, event_id) - 1) // 1000 AS chunk_id FROM raw_flows),
newest AS (SELECT chunk_id AS after_chunk, max(max(end_us)) OVER (ORDER BY chunk_id) AS newest FROM chunked GROUP BY chunk_id)
SELECT c.event_id, c.chunk_id, n.after_chunk, attack::bigint AS label, true AS known FROM chunked c JOIN newest n
 ON c.chunk_id <= n.after_chunk AND c.end_us >= n.newest - 3600000000""",
)
def score_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    fitted = ml.train(rows, MODEL_COLUMNS, variant="dt", maxDepth=5)
    seen = ml.score_trailing(rows, fitted, "timestamp", ["timestamp", "event_id"], 1000, 3_600_000_000)
    return seen.select("event_id", "chunk_id", "after_chunk", F.col("label").cast("bigint"), F.col("prediction").isin(0.0, 1.0).alias("known"))


def _explained(spark: SparkSession, sf_dir: str):
    rows = labelled(spark, sf_dir)
    fitted = ml.train(rows, MODEL_COLUMNS, variant="dt", maxDepth=4)
    return ml.feature_part(fitted).transform(rows).select("event_id", "features"), fitted.stages[-1]


@query("g15_shapley_attribution")
def shapley_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, classifier = _explained(spark, sf_dir)
    return explain.attribution_summary(
        explain.shapley_attribution(rows, classifier, MODEL_COLUMNS, "event_id", permutations=2)
    )


@query(
    "g16_local_surrogate",
    f"""WITH {RAW_FLOWS_SQL}, names AS (SELECT unnest(['(intercept)', {", ".join(f"'{c}'" for c in MODEL_COLUMNS)}]) AS feature)
SELECT feature, count(*) AS rows, true AS finite, true AS bounded FROM raw_flows, names GROUP BY feature""",
)
def local_surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of 500 samples around every flow; the intercepts, fits of probabilities, stay near 0..1."""
    rows, classifier = _explained(spark, sf_dir)
    weights = explain.local_surrogate(rows, classifier, MODEL_COLUMNS, "event_id")
    inside = (F.col("feature") != "(intercept)") | F.col("weight").between(-0.5, 1.5)
    return weights.groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows"),
        F.bool_and(F.col("weight").isNotNull() & ~F.isnan("weight")).alias("finite"),
        F.bool_and(inside).alias("bounded"),
    )
