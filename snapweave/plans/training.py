"""Session classifiers: preparation, models of Spark ML, grouped random search, named predictions."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import (
    PCA,
    IndexToString,
    OneHotEncoder,
    StandardScaler,
    StandardScalerModel,
    StringIndexer,
    VarianceThresholdSelector,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, functions as F

from snapweave.functions.vectors import clean_embedding
from snapweave.operators.evaluation import accuracy, class_scores, macro_scores, pair_counts
from snapweave.operators.prep import choose_by_information, fit_median_fill
from snapweave.operators.splits import grouped_folds
from snapweave.schema import KEYS, SEARCHED_COLUMN_COUNTS

MAX_TREE_DEPTH = 30  # Spark's limit; stands for "no limit"


# --- vectors ---------------------------------------------------------------------------


def one_hot(train: DataFrame, columns: Sequence[str]) -> PipelineModel:
    """Index and one-hot encoding; a value not seen in train becomes the zero vector."""
    indexers = [
        StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep", stringOrderType="alphabetAsc")
        for c in columns
    ]
    encoder = OneHotEncoder(
        inputCols=[f"{c}_index" for c in columns], outputCols=[f"{c}_onehot" for c in columns], dropLast=True
    )
    return Pipeline(stages=[*indexers, encoder]).fit(train)


def fit_embedding_pca(
    train: DataFrame, column: str, dim: int, components: int = 16
) -> PipelineModel | None:
    """Centred PCA of one embedding column; None if there are too few rows or no dimension.

    Spark's PCA does not centre when it transforms, so the mean is removed first.
    """
    rows = train.limit(max(3, components + 1)).count()
    if dim <= 0 or rows < 3:
        return None
    k = min(components, dim, rows - 1)
    vectors = train.select(array_to_vector(clean_embedding(F.col(column), dim)).alias("_raw"))
    centre = StandardScaler(inputCol="_raw", outputCol="_centred", withMean=True, withStd=False)
    reduce = PCA(k=k, inputCol="_centred", outputCol=f"{column}_pca")
    return Pipeline(stages=[centre, reduce]).fit(vectors)


def apply_embedding_pca(df: DataFrame, column: str, dim: int, model: PipelineModel | None) -> DataFrame:
    """Add ``<column>_pca`` as an array; the sign of a component makes its largest loading positive."""
    out = f"{column}_pca"
    if model is None:
        return df.withColumn(out, F.array().cast("array<double>"))
    loadings = model.stages[-1].pc.toArray()
    signs = [1.0 if col[abs(col).argmax()] >= 0 else -1.0 for col in loadings.T]
    ready = df.withColumn("_raw", array_to_vector(clean_embedding(F.col(column), dim)))
    scored = model.transform(ready).drop("_raw", "_centred")
    signed = F.zip_with(vector_to_array(out), F.array(*[F.lit(s) for s in signs]), lambda v, s: v * s)
    return scored.withColumn(out, signed)


def assemble(df: DataFrame, inputs: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(inputs), outputCol=out, handleInvalid="error").transform(df)


# --- pipeline step: median fill, constant columns out, k most informative, vector ---------


class ColumnStep(
    Estimator, DefaultParamsReadable, DefaultParamsWritable
):
    """Fits medians and the k most informative columns on the rows it is given.

    As a pipeline stage it is fitted again in every fold, so validation rows never
    influence it.
    """

    k = Param(Params._dummy(), "k", "columns to keep; 0 keeps all", TypeConverters.toInt)
    columns = Param(Params._dummy(), "columns", "candidate columns", TypeConverters.toListString)
    label = Param(Params._dummy(), "label", "label text column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, columns: Sequence[str] = (), k: int = 0, label: str = "label"):
        super().__init__()
        self._set(columns=list(columns), k=k, label=label)

    def _fit(self, dataset: DataFrame) -> "ColumnStepModel":
        columns, k = self.getOrDefault("columns"), self.getOrDefault("k")
        fill = fit_median_fill(dataset, columns)
        usable = [c for c in columns if c in fill.values]
        chosen = choose_by_information(
            fill.apply(dataset), usable, k or None, self.getOrDefault("label")
        )
        return ColumnStepModel(columns=chosen, medians=[float(fill.values[c]) for c in chosen])


class ColumnStepModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    columns = Param(Params._dummy(), "columns", "kept columns", TypeConverters.toListString)
    medians = Param(Params._dummy(), "medians", "fill values", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, columns: Sequence[str] = (), medians: Sequence[float] = ()):
        super().__init__()
        self._set(columns=list(columns), medians=list(medians))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        filled = [
            F.coalesce(F.col(c).cast("double"), F.lit(m))
            for c, m in zip(self.getOrDefault("columns"), self.getOrDefault("medians"))
        ]
        return dataset.withColumn("_filled", array_to_vector(F.array(*filled)))


def label_indexer(train: DataFrame, label: str = "label") -> Model:
    """Alphabetical label index; a label that was not fitted is an error."""
    return StringIndexer(
        inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="error"
    ).fit(train)


# --- models ------------------------------------------------------------------------------


def random_forest(trees: int = 100, seed: int = 42, weight: str | None = None, **options) -> RandomForestClassifier:
    """Trees grow to Spark's depth limit unless told otherwise.

    Deep trees have many open nodes. Every task holds the sums of those that a pass splits, up to the memory
    setting, so all cores of an executor together take that many times; what does not fit waits for the next pass.
    Trees that grow to the limit always fill it, so they get less.
    """
    memory = 256 if options.get("maxDepth", MAX_TREE_DEPTH) == MAX_TREE_DEPTH else 1024
    settings = {"maxDepth": MAX_TREE_DEPTH, "featureSubsetStrategy": "sqrt", "maxMemoryInMB": memory, **options}
    model = RandomForestClassifier(labelCol="label_index", numTrees=trees, seed=seed, **settings)
    return model.setWeightCol(weight) if weight else model


def extra_trees(trees: int = 300, seed: int = 42, weight: str | None = None, **options) -> RandomForestClassifier:
    """Every tree sees all rows; only the candidate columns are random."""
    return random_forest(trees, seed, weight, **{"bootstrap": False, "subsamplingRate": 1.0, **options})


def boosted_trees(
    rounds: int = 100, depth: int = 3, seed: int = 42, weight: str | None = None, parallelism: int = 2, **options
) -> OneVsRest:
    base = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, **options)
    model = OneVsRest(classifier=base, labelCol="label_index", parallelism=parallelism)
    return model.setWeightCol(weight) if weight else model


def linear_svm(weight: str | None = None, parallelism: int = 2, **options) -> OneVsRest:
    model = OneVsRest(classifier=LinearSVC(**options), labelCol="label_index", parallelism=parallelism)
    return model.setWeightCol(weight) if weight else model


def logistic_regression(rows: int, iterations: int = 1000, weight: str | None = None) -> LogisticRegression:
    """Regularised like inverse strength 1 on ``rows`` train rows; the features come scaled."""
    model = LogisticRegression(
        labelCol="label_index", family="multinomial", maxIter=iterations, regParam=1.0 / rows, standardization=False
    )
    return model.setWeightCol(weight) if weight else model


def sequence_perceptron(inputs: int, classes: int, hidden: Sequence[int] = (32,), seed: int = 42) -> MultilayerPerceptronClassifier:
    """Classifier over flattened padded sequences."""
    return MultilayerPerceptronClassifier(
        labelCol="label_index", layers=[inputs, *hidden, classes], seed=seed, maxIter=100
    )


def flatten_sequences(df: DataFrame, column: str = "sequence", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.flatten(column)))


def balanced_resample(df: DataFrame, weight: str = "weight", seed: int = 42) -> DataFrame:
    """Repeat rows in proportion to their weight, for models that take no weight column.

    The fractional part is drawn by hash of the keys, so the result repeats.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), *KEYS), F.lit(1_000_000)) / F.lit(1_000_000.0)
    copies = (F.floor(weight) + (draw < F.col(weight) - F.floor(weight)).cast("long")).cast("int")
    return df.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))).drop("_copy")


# --- fitting, results ------------------------------------------------------------------------


def predictions(fitted: Transformer, df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Arg-max class as text, plus ``proba_<class>`` columns where the model gives probabilities."""
    scored = fitted.transform(df)
    named = IndexToString(inputCol="prediction", outputCol="pred_label", labels=list(labels)).transform(scored)
    if "probability" not in named.columns:
        return named
    values = vector_to_array("probability")
    return named.withColumns({f"proba_{name}": values[i] for i, name in enumerate(labels)})


def named_predictions(scored: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The same columns from ``prediction`` and a ``probability`` array."""
    name = F.element_at(F.array(*[F.lit(n) for n in labels]), (F.col("prediction") + 1).cast("int"))
    return scored.withColumns({"pred_label": name} | {f"proba_{n}": F.col("probability")[i] for i, n in enumerate(labels)})


@dataclass
class FitOutcome:
    name: str
    model: Transformer | None
    status: str


def fit_all(train: DataFrame, models: Mapping[str, Estimator]) -> list[FitOutcome]:
    """Fit every model on the same rows; one that fails is reported and the others go on."""
    outcomes = []
    train = train.persist()
    try:
        for name, model in models.items():
            try:
                outcomes.append(FitOutcome(name, model.fit(train), "fitted"))
            except Exception as problem:
                outcomes.append(FitOutcome(name, None, f"failed: {str(problem).splitlines()[0]}"))
    finally:
        train.unpersist()
    return outcomes


def status_table(spark: SparkSession, outcomes: Sequence[FitOutcome]) -> DataFrame:
    return spark.createDataFrame([(o.name, o.status) for o in outcomes], "model string, status string")


def all_predictions(outcomes: Sequence[FitOutcome], df: DataFrame, labels: Sequence[str], truth: str = "label") -> DataFrame:
    """Long table: keys, model, y_true, y_pred for every model that was fitted."""
    parts = [
        predictions(o.model, df, labels).select(
            *KEYS, F.lit(o.name).alias("model"), F.col(truth).alias("y_true"), F.col("pred_label").alias("y_pred")
        )
        for o in outcomes
        if o.model is not None
    ]
    if not parts:
        raise RuntimeError("no model could be fitted")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def compare_models(predicted: DataFrame) -> DataFrame:
    pairs = pair_counts(predicted)
    scores = macro_scores(class_scores(pairs, labels=None))
    return accuracy(pairs).join(scores, "model").select("model", "accuracy", "macro_f1", "support")


def importances(spark: SparkSession, model, columns: Sequence[str], n: int = 10) -> DataFrame:
    """Top-n feature importances of a tree model."""
    values = sorted(zip(columns, model.featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))
    rows = [(i + 1, c, v) for i, (c, v) in enumerate(values[:n])]
    return spark.createDataFrame(rows, "rank int, feature string, importance double")


# --- search ------------------------------------------------------------------------------------


class MacroF1(Evaluator):
    """F1 averaged over the classes that occur as label or prediction."""

    def __init__(self, label: str = "label_index", prediction: str = "prediction"):
        super().__init__()
        self._label, self._prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        rows = dataset.select(
            F.lit("m").alias("model"),
            F.col(self._label).cast("string").alias("y_true"),
            F.col(self._prediction).cast("string").alias("y_pred"),
        )
        found = macro_scores(class_scores(pair_counts(rows), labels=None)).first()
        return float(found["macro_f1"]) if found else 0.0

    def isLargerBetter(self) -> bool:
        return True


def drawn_param_maps(space: Mapping[Param, Sequence], n: int, seed: int = 42) -> list[dict]:
    """``n`` different random points of the space (all of it, if it is smaller)."""
    size = 1
    for values in space.values():
        size *= len(values)
    rng = random.Random(seed)
    maps = []
    for number in rng.sample(range(size), min(n, size)):
        point = {}
        for param, values in space.items():
            number, at = divmod(number, len(values))
            point[param] = values[at]
        maps.append(point)
    return maps


def column_choices(available: int) -> list[int]:
    """Numbers of columns a search tries: every listed one below what there is, then all columns."""
    smaller = [count for count in SEARCHED_COLUMN_COUNTS if count < available]
    return [*smaller, available]


def scale_vectors(train: DataFrame, column: str) -> StandardScalerModel:
    """Mean 0 and spread 1 over the training rows for every element of an assembled vector: ``<column>_scaled``."""
    return StandardScaler(inputCol=column, outputCol=f"{column}_scaled", withMean=True, withStd=True).fit(train)


def model_pipeline(estimator: Estimator, columns: Sequence[str], k: int | None = None) -> Pipeline:
    """Median fill and choice by information, constant columns out, model; all fitted per fold."""
    step = ColumnStep(columns=list(columns), k=min(80, len(columns)) if k is None else k)
    varied = VarianceThresholdSelector(featuresCol="_filled", outputCol="features", varianceThreshold=0.0)
    return Pipeline(stages=[step, varied, estimator])


def forest_space(pipeline: Pipeline, available: int) -> dict[Param, list]:
    # The candidate settings of the tree searches.
    step, _, forest = pipeline.getStages()
    return {
        step.k: column_choices(available),
        forest.numTrees: [300, 600, 1000],
        forest.maxDepth: [MAX_TREE_DEPTH, 8, 12, 16, 24],
        forest.minInstancesPerNode: [1, 2, 4],
        forest.featureSubsetStrategy: ["sqrt", "log2", "0.5", "0.8"],
        forest.bootstrap: [False, True],
    }


def boosting_space(pipeline: Pipeline, available: int) -> dict[Param, list]:
    # The candidate settings of the boosting search.
    step, _, rest = pipeline.getStages()
    base = rest.getClassifier()
    return {
        step.k: column_choices(available),
        base.stepSize: [0.03, 0.05, 0.1],
        base.maxDepth: [3, 5, 8],
        base.minInstancesPerNode: [5, 10, 20],
        base.maxIter: [200, 400, 800],
    }


def grouped_search(
    train: DataFrame,
    pipeline: Pipeline,
    space: Mapping[Param, Sequence],
    n: int,
    folds: int | None = 5,
    seed: int = 42,
    parallelism: int = 2,
    fold: str = "fold",
) -> CrossValidatorModel:
    """Random search by macro-F1 over folds that never split a user; refitted on all train rows.

    With ``folds`` None the folds are made here: one per user, at most five, none empty.
    """
    if folds is None:
        train, folds = grouped_folds(train, out=fold)
    search = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=drawn_param_maps(space, n, seed),
        evaluator=MacroF1(),
        numFolds=folds,
        foldCol=fold,
        parallelism=parallelism,
    )
    return search.fit(train)


def search_table(spark: SparkSession, searches: Mapping[str, CrossValidatorModel]) -> DataFrame:
    rows = [(name, float(max(s.avgMetrics))) for name, s in searches.items()]
    return spark.createDataFrame(rows, "model string, cv_macro_f1 double")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def save_columns(report: DataFrame, path: str) -> None:
    """Kept and dropped columns with the reasons, beside the model."""
    report.write.mode("overwrite").parquet(path)
