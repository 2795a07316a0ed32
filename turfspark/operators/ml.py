"""Classifier of the top three with Spark ML; any DataFrame with numeric features and a 0/1 target."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import stored
from .scoring import auc


def _doubles(df: DataFrame, features: list[str], target: str) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(f"_d_{c}") for c in features], F.col(target).cast("double").alias("_label"))


def _assembly(features: list[str]) -> list:
    """Missing feature values are the column's median."""
    doubles = [f"_d_{c}" for c in features]
    return [Imputer(inputCols=doubles, outputCols=doubles, strategy="median"), VectorAssembler(inputCols=doubles, outputCol="_features", handleInvalid="keep")]


#: So many different rows are counted instead of repeated. Spark looks at as many without sampling to find where features may be split.
DIFFERENT_ROWS = 10_000


def _counted(rows: DataFrame) -> DataFrame | None:
    """``rows`` with every different row once and its number in ``_n``, stored; none if more than ``DIFFERENT_ROWS`` differ."""
    if rows.agg(F.approx_count_distinct(F.struct(*rows.columns))).first()[0] > DIFFERENT_ROWS:
        return None
    counts = stored(rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")), "counted")
    return counts.coalesce(2) if counts.count() <= DIFFERENT_ROWS else None


def train_classifier(train: DataFrame, features: list[str], target: str = "rank", trees: int = 20, depth: int = 4, step: float = 0.1, seed: int = 1) -> PipelineModel:
    """Boosted trees; missing feature values are the column's median. Equal rows are learned once, with their number as
    weight, where few differ."""
    rows = _doubles(train, features, target)
    assembled = Pipeline(stages=_assembly(features)).fit(rows)
    boosted = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed)
    counts = _counted(rows)
    model = boosted.fit(assembled.transform(rows)) if counts is None else boosted.setWeightCol("_n").fit(assembled.transform(counts))
    return PipelineModel([*assembled.stages, model])


def score_runners(model: PipelineModel, df: DataFrame, features: list[str], name: str = "score") -> DataFrame:
    """Adds the probability of class 1."""
    rows = df.withColumns({f"_d_{c}": F.col(c).cast("double") for c in features})
    scored = model.transform(rows).withColumn(name, vector_to_array("probability")[1])
    return scored.select(*df.columns, name)


def save(model: PipelineModel, masters: dict[str, DataFrame], features: list[str], path: str) -> None:
    """The trained pipeline with the label masters and feature columns that go with it, under one path."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame(list(enumerate(features)), "i int, feature string").write.mode("overwrite").parquet(f"{path}/features")
    for column, master in masters.items():
        master.write.mode("overwrite").parquet(f"{path}/masters/{column}")
    spark.createDataFrame([(c,) for c in masters], "column string").write.mode("overwrite").parquet(f"{path}/columns")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, dict[str, DataFrame], list[str]]:
    columns = [r.column for r in spark.read.parquet(f"{path}/columns").collect()]
    features = [r.feature for r in spark.read.parquet(f"{path}/features").orderBy("i").collect()]
    return PipelineModel.load(f"{path}/model"), {c: spark.read.parquet(f"{path}/masters/{c}") for c in columns}, features


def feature_importance(model: PipelineModel, features: list[str], spark) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, values, strict=True)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def top_features(model: PipelineModel, features: list[str], spark, n: int = 20) -> DataFrame:
    return feature_importance(model, features, spark).limit(n)


#: Groups of parameters in the order of the search: features for a split, tree size, rows for a tree, regularisation.
STEPS = (
    ("features", tuple({"featureSubsetStrategy": v} for v in ("all", "0.4", "0.6", "0.8"))),
    ("size", tuple({"maxDepth": v} for v in (4, 2, 3, 5, 6))),
    ("rows", tuple({"subsamplingRate": v} for v in (1.0, 0.5, 0.7, 0.9))),
    ("leaves", tuple({"minInstancesPerNode": v} for v in (1, 5, 25, 100))),
    ("gain", tuple({"minInfoGain": v} for v in (0.0, 0.0001, 0.001))),
)
_FITS = "fit int, step string, setting map<string,string>, trees int, kept int, auc double, taken boolean"


def _by_weight(settings: dict, learned: int) -> dict:
    """``settings`` for counted rows: the least number of rows on a side of a split as a share of all ``learned`` rows."""
    least = settings.get("minInstancesPerNode", 1)
    if 2 * least > learned:  # no split leaves as many on both sides
        return settings | {"minInstancesPerNode": 1, "maxDepth": 0}
    return settings | {"minInstancesPerNode": 1, "minWeightFractionPerNode": max(settings.get("minWeightFractionPerNode", 0.0), (least - 0.5) / learned)}


def tune(
    train: DataFrame, valid: DataFrame, features: list[str], target: str = "rank", steps=STEPS, trees: int = 40, halvings: int = 1, tolerance: float = 0.001, seed: int = 1
) -> tuple[PipelineModel, DataFrame]:
    """Stepwise search with early stopping: the model with the best AUC on the validation slice, which lies after the
    training slice in time, and the table of all fits in their order.

    The first setting of every group is what the search starts from. Group after group, the others are tried beside what
    earlier groups have settled: ``halvings`` times with fewer trees (a half, before that a quarter, ...), after which the
    better half goes on, then with all. A setting is taken if its AUC is above the best so far; of equal ones, the earlier.
    Trees are added to a model until the loss on the validation slice no longer falls by ``tolerance``: ``kept`` is how
    many it has. Where few rows differ, they are counted once, and all fits but those on a part of the rows for a tree
    (``subsamplingRate``) learn from the counts; all fits of a round are measured in one pass. Where the validation
    slice is empty or has one class, every AUC is null and the start stays."""
    spark = train.sparkSession
    rows = _doubles(train, features, target).withColumn("_valid", F.lit(False)).unionByName(_doubles(valid, features, target).withColumn("_valid", F.lit(True)))
    rows = stored(rows, "learned")
    assembled = Pipeline(stages=_assembly(features)).fit(rows.filter("NOT _valid"))
    counts, found = _counted(rows), []
    once = rows.withColumn("_n", F.lit(1)) if counts is None else counts
    every, once = assembled.transform(rows), assembled.transform(once).select("_features", "_label", "_valid", "_n")
    measured = once.filter("_valid")
    learned = 0 if counts is None else counts.filter("NOT _valid").agg(F.sum("_n")).first()[0]
    gbt = GBTClassifier(featuresCol="_features", labelCol="_label", stepSize=0.1, validationTol=tolerance, seed=seed)
    if not measured.isEmpty():
        gbt.setValidationIndicatorCol("_valid")

    def grown(settings: dict, n: int):
        settings, data = settings | {"maxIter": n}, every
        if counts is not None and settings.get("subsamplingRate", 1.0) == 1.0:
            settings, data = _by_weight(settings, learned) | {"weightCol": "_n"}, once
        return gbt.fit(data, {gbt.getParam(k): v for k, v in settings.items()})

    def fit(step: str, settings: list[dict], n: int) -> list[tuple]:
        models = [grown(s, n) for s in settings]
        scored = measured
        for i, m in enumerate(models):
            scored = m.transform(scored, {m.probabilityCol: f"_p{i}", m.rawPredictionCol: "", m.predictionCol: ""})
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), vector_to_array(f"_p{i}")[1].alias("_s")) for i in range(len(models))]))
        scores = scored.select("_label", "_n", each.alias("_e")).select("_label", "_n", "_e.*")
        areas = {r._i: r.auc for r in auc(scores, "_s", "_label", by="_i", rows="_n").collect()}  # a row per fit
        out = [(areas.get(i), s, m, len(found) + i) for i, (s, m) in enumerate(zip(settings, models, strict=True))]
        found.extend([step, s, n, m.getNumTrees, a, False] for a, s, m, _ in out)
        return out

    value = lambda f: -1.0 if f[0] is None else f[0]
    start = {k: v for _, group in steps for k, v in group[0].items()}
    best = fit("start", [start], trees)[0]
    found[0][-1] = True
    for step, group in steps:
        alive = [best[1] | s for s in group if best[1] | s != best[1]]
        for rung in range(halvings, -1, -1):
            tried = fit(step, alive, max(1, trees >> rung)) if alive else []
            ranked = sorted(tried, key=value, reverse=True)
            alive = [f[1] for f in ranked[: (len(ranked) + 1) // 2]]
        if ranked and value(ranked[0]) > value(best):
            best = ranked[0]
            found[best[3]][-1] = True
    table = [(i, step, {k: str(v) for k, v in s.items()}, n, kept, a, taken) for i, (step, s, n, kept, a, taken) in enumerate(found)]
    return PipelineModel([*assembled.stages, best[2]]), spark.createDataFrame(table, _FITS)
