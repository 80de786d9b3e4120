"""Classifiers on the feature table, and scoring with a stored one. Rows never leave Spark."""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.contracts import LABEL, check_no_leakage
from eventloom.functions.ranks import union_all
from eventloom.operators import forest
from eventloom.operators.metrics import binary_metrics, ranking_metrics
from eventloom.operators.prepare import PREPARED, Preparation, weight_column
from eventloom.sources.tables import scratch_path

# Names and settings of the two models.
LOGISTIC = "logistic_regression_baseline"
FOREST = "random_forest_model"
SEED = 42
MAX_ITERATIONS = 2000
TOLERANCE = 1e-6
TREES = 300
LEAF_ROWS = 2
SPLIT_ROWS = 5
FOREST_DEPTH = 30  # the engine's limit
PART_ROWS = 250_000
FEW_PARTS = 4  # a pass adds up the sums of so many parts in one step; of more, in two

PROBABILITY = "probability_redteam_next_window"


def logistic_regression(rows: int, tolerance: float = TOLERANCE) -> LogisticRegression:
    """L2 with unit strength against the summed (not averaged) loss of `rows` rows, on scaled inputs."""
    return LogisticRegression(
        maxIter=MAX_ITERATIONS,
        tol=tolerance,
        regParam=1.0 / rows,
        elasticNetParam=0.0,
        standardization=False,
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
    )


def random_forest(trees: int = TREES, depth: int = FOREST_DEPTH) -> RandomForestClassifier:
    return RandomForestClassifier(
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=LEAF_ROWS,
        seed=SEED,
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        maxMemoryInMB=1024,
        cacheNodeIds=True,  # else every pass sends all trees to every task and walks each row down each of them
    )


def fit(train: DataFrame, prepared: Preparation, estimator: Estimator, label: str = LABEL, path: str | None = None) -> PipelineModel:
    """Impute, scale, assemble and fit as one pipeline. `train` is read many times, so pass a written table.

    The pipeline is stored, at `path` if given, and loaded: a fitted stage holds its training summary and with it the
    session, which no task can be sent once the session has observed a metric.
    """
    check_no_leakage(prepared.columns)
    spark = train.sparkSession
    rows = train.select(
        *prepared.columns, F.col(label).cast("double").alias("label"), weight_column(train, label).alias("weight")
    )
    assembler = VectorAssembler(inputCols=[f"{PREPARED}{c}" for c in prepared.columns], outputCol="features")
    pipeline = Pipeline(stages=[prepared.transformer(), assembler, estimator])
    path = path or scratch_path(spark, "pipeline")
    is_forest = isinstance(estimator, RandomForestClassifier)
    if is_forest and (rules := _held_rules(rows, prepared, estimator)):
        _grow(rows, prepared, pipeline, rules, path)
    else:
        few = None if is_forest else FEW_PARTS
        pipeline.fit(even_parts(rows, few)).write().overwrite().save(path)
        if is_forest:
            undo_small_splits(spark, path)
    return PipelineModel.load(path)


def _held_rules(rows: DataFrame, prepared: Preparation, estimator: RandomForestClassifier) -> forest.Rules | None:
    """How to grow the forest with all rows in a task; None where they are too many, or of other classes than 0 and 1."""
    found = rows.groupBy("label").agg(F.count("*").alias("rows"), F.max("weight").alias("weight")).collect()  # a row per class
    weights = {r.label: r.weight for r in found}
    if set(weights) != {0.0, 1.0} or not forest.fits(sum(r.rows for r in found), len(prepared.columns), estimator.getMaxBins()):
        return None
    return forest.Rules(
        trees=estimator.getNumTrees(),
        depth=estimator.getMaxDepth(),
        bins=estimator.getMaxBins(),
        leaf_rows=estimator.getMinInstancesPerNode(),
        split_rows=SPLIT_ROWS,
        weights=(weights[0.0], weights[1.0]),
        seed=estimator.getSeed(),
    )


def _grow(rows: DataFrame, prepared: Preparation, pipeline: Pipeline, rules: forest.Rules, path: str) -> None:
    """Store the pipeline with a forest of single nodes, from a made-up row per class, and give it the nodes grown from all rows."""
    spark = rows.sparkSession
    nothing = spark.range(2).select(*[F.lit(0.0).alias(c) for c in prepared.columns], F.col("id").cast("double").alias("label"), F.lit(1.0).alias("weight"))
    pipeline.fit(nothing.coalesce(1)).write().overwrite().save(path)
    tasks = min(rules.trees, spark.sparkContext.defaultParallelism)
    inputs = [F.col(f"{PREPARED}{c}") for c in prepared.columns]
    nodes = forest.grow_forest(prepared.transformer().transform(rows), inputs, rules, tasks)
    split = F.struct(
        F.col("feature").alias("featureIndex"),
        F.when(F.col("feature") >= 0, F.array("threshold")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
        F.lit(-1).alias("numCategories"),
    )
    node = F.struct(
        F.col("node").alias("id"), "prediction", "impurity", F.array("negative", "positive").alias("impurityStats"), F.col("rows").alias("rawCount"),
        "gain", F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"),
    )
    kind = spark.read.parquet(f"{_forest_folder(spark, path)}/data").schema["nodeData"].dataType
    _replace_nodes(spark, path, nodes.select(F.col("tree").alias("treeID"), node.cast(kind).alias("nodeData")))


def even_parts(df: DataFrame, few: int | None = None) -> DataFrame:
    """The rows dealt out evenly, for many passes or for tasks that load a large model each; to `few` parts if none is too large."""
    rows = df.count()
    if few and rows <= few * PART_ROWS:
        return df.repartition(few)
    return df.repartition(_parts(df.sparkSession.sparkContext.defaultParallelism, rows))


def _parts(cores: int, rows: int) -> int:
    """Even parts for the many passes of a fit: as many as cores, or a multiple where a part would hold over PART_ROWS rows."""
    return cores * max(1, -(-rows // (cores * PART_ROWS)))


def _forest_folder(spark: SparkSession, path: str) -> str:
    """Where a stored pipeline keeps its forest."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/stages/*RandomForestClassif*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    if len(found) != 1:
        raise ValueError(f"{path} holds {len(found)} forests")
    return found[0].getPath().toString()


def forest_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The node table of a stored pipeline: tree, node, rows, stats (weight of each class), left, right, feature, threshold.

    Nodes of a tree are numbered from the root on; left and right are -1 at a leaf. All inputs are numbers, so a split is a
    feature at most the threshold (left) or above it.
    """
    n = "nodeData."
    return spark.read.parquet(f"{_forest_folder(spark, path)}/data").select(
        F.col("treeID").alias("tree"), F.col(f"{n}id").alias("node"), F.col(f"{n}rawCount").alias("rows"), F.col(f"{n}impurityStats").alias("stats"),
        F.col(f"{n}leftChild").alias("left"), F.col(f"{n}rightChild").alias("right"), F.col(f"{n}split.featureIndex").alias("feature"),
        F.get(f"{n}split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )


def undo_small_splits(spark: SparkSession, path: str, least: int = SPLIT_ROWS) -> None:
    """Make leaves of all nodes of a stored forest that were split with fewer than `least` rows (bagged ones count again).

    The engine has no such limit of its own. What lay below such a node stays in the table, but nothing leads there; a node
    has no more rows than the one above it, so no small split is left anywhere.
    """
    folder = _forest_folder(spark, path)
    small, leaf = F.col("nodeData.rawCount") < least, F.lit(-1)
    node = F.col("nodeData").withField("leftChild", F.when(small, leaf).otherwise(F.col("nodeData.leftChild")))
    node = node.withField("rightChild", F.when(small, leaf).otherwise(F.col("nodeData.rightChild")))
    _replace_nodes(spark, path, spark.read.parquet(f"{folder}/data").withColumn("nodeData", node))


def _replace_nodes(spark: SparkSession, path: str, nodes: DataFrame) -> None:
    """Put another node table in the place of that of a stored pipeline; it may be made from the one there."""
    folder = _forest_folder(spark, path)
    nodes.write.parquet(f"{folder}/replaced")
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}") for name in ("data", "replaced"))
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(old, True)
    files.rename(new, old)


def feature_names(model: PipelineModel) -> list[str]:
    """Inputs a fitted pipeline expects, as stored inside it."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    return [c.removeprefix(PREPARED) for c in assembler.getInputCols()]


def predict(df: DataFrame, model: PipelineModel, keep: list[str]) -> DataFrame:
    """The kept columns, the class and the probability of class 1."""
    return model.transform(df).select(
        *keep,
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("score"),
    )


def evaluate(predictions: DataFrame, label: str = LABEL) -> DataFrame:
    """(metric, value) rows of one set of predictions."""
    classes = binary_metrics(predictions, label)
    ranks = ranking_metrics(predictions, label)
    return union_all([
        classes.unpivot([], ["precision", "recall", "f1"], "metric", "value"),
        ranks.withColumnRenamed("average_precision", "pr_auc").unpivot([], ["roc_auc", "pr_auc"], "metric", "value"),
    ])


def select_best(metrics: DataFrame, split: str = "valid", metric: str = "f1") -> DataFrame:
    """The model with the highest metric; among equals the one trained first (lowest `position`)."""
    candidates = metrics.filter((F.col("split") == split) & (F.col("metric") == metric))
    return candidates.orderBy(F.desc("value"), "position").limit(1)


def score(df: DataFrame, model: PipelineModel, model_name: str, keep: list[str] | None = None) -> DataFrame:
    """Score any rows: absent inputs count as 0, null ones as the training median."""
    absent = {c: F.lit(0.0) for c in feature_names(model) if c not in df.columns}
    keep = list(df.columns) if keep is None else keep
    scored = predict(df.withColumns(absent) if absent else df, model, keep)
    return scored.withColumnRenamed("score", PROBABILITY).withColumn("model_name", F.lit(model_name))
