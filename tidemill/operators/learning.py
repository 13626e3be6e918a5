"""Classifiers on a feature panel with Spark ML: chronological split, tree ensembles, stacking on out-of-fold scores, metrics."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.plans.windows import c


def dated(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Adds is_train by a date cut that all symbols share, so nothing leaks between them."""
    days = df.select(F.unix_timestamp("ts").cast("double").alias("t"))
    cut = days.approxQuantile("t", [share], 0.001)
    return df.withColumn("is_train", F.unix_timestamp("ts") <= (cut[0] if cut else 0))


#: Rows of a task when models are fitted.
FIT_ROWS = 1 << 16


def gathered(df: DataFrame) -> DataFrame:
    """df computed once and kept, whole symbols in as many partitions as its rows ask for: boosters run hundreds of jobs over it, and each pays
    for every partition, and for everything before it that is not kept."""
    kept = df.persist()
    n = max(1, -(-kept.count() // FIT_ROWS))
    out = kept.repartition(n, "symbol").sortWithinPartitions("symbol", "ts").persist()
    out.count()
    kept.unpersist()
    return out


def fitted(pipes: dict[object, tuple[Pipeline, DataFrame]], at_once: int = 6) -> dict[object, PipelineModel]:
    """The models, several at a time as in Spark's cross-validation: they do not depend on each other, and their jobs are many and small."""
    if not pipes:
        return {}
    own = inheritable_thread_target(next(iter(pipes.values()))[1].sparkSession)
    with ThreadPool(at_once) as pool:
        return dict(zip(pipes, pool.map(own(lambda x: x[0].fit(x[1])), pipes.values(), 1), strict=True))


def learners(features: list[str], seed: int = 42, rounds: int = 20, trees: int = 40) -> dict[str, Pipeline]:
    """Scaled features and one tree ensemble each."""
    ready = [VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="keep"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]
    label = {"labelCol": "target", "featuresCol": "features", "seed": seed}
    return {
        "gbt": Pipeline(stages=[*ready, GBTClassifier(maxIter=rounds, maxDepth=4, stepSize=0.1, **label)]),
        "gbt_sub": Pipeline(stages=[*ready, GBTClassifier(maxIter=rounds, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, **label)]),
        "forest": Pipeline(stages=[*ready, RandomForestClassifier(numTrees=trees, maxDepth=8, minInstancesPerNode=5, featureSubsetStrategy="sqrt", **label)]),
    }


def score(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """Adds the probability of class 1."""
    out = model.transform(df)
    return out.withColumn(f"p_{name}", vector_to_array("probability")[1]).drop("_raw", "features", "rawPrediction", "probability", "prediction")


def folds(df: DataFrame, n: int = 5, gap: int = 20) -> DataFrame:
    """Adds fold, from 1 to n by place in time (0 before the first), of equal sizes for each symbol, and trains_from: the first fold
    whose training part holds the bar. Bars within `gap` bars before a fold do not train it."""
    w = Window.partitionBy("symbol")
    size = F.floor(F.count("*").over(w) / (n + 1))
    b = df.withColumns({"_size": size, "_place": F.row_number().over(w.orderBy("ts")) - 1 - (F.count("*").over(w) - n * size)})
    fold = F.when(c("_place") < 0, 0).otherwise(F.floor(F.try_divide("_place", "_size")) + 1)
    first = F.greatest(F.floor(F.try_divide(c("_place") + gap, c("_size"))) + 2, F.lit(1))  # the first fold that may train on the bar
    return b.withColumns({"fold": F.least(F.coalesce(fold, F.lit(0)), F.lit(n)).cast("int"), "trains_from": F.coalesce(first, F.lit(n + 1)).cast("int")}).drop("_size", "_place")


def confidence(scores: list[Column], final: Column | None = None) -> Column:
    """Agreement of the learners, and distance from one half of the final score (without one, of the mean)."""
    x = F.array(*scores)
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    spread = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / n - mean * mean + 1e-12)
    return 0.6 * (1 - F.least(F.greatest(2 * spread, F.lit(0.0)), F.lit(1.0))) + 0.4 * 2 * F.abs((mean if final is None else final) - 0.5)


def mean_score(scores: dict[str, Column], mode: str = "mean", weights: dict[str, float] | None = None) -> Column:
    """Mean of the learners' scores, the majority of their votes (a tie is 0), or the mean weighted as by learner_weights()."""
    n = float(len(scores))
    if mode == "vote":
        return F.bround(sum(F.bround(x) for x in scores.values()) / n)
    if mode == "weighted" and weights:
        total = sum(weights[k] for k in scores)
        return sum(x * (weights[k] / total) for k, x in scores.items())
    return sum(scores.values()) / n


def learner_weights(df: DataFrame, scores: list[str], label: str = "target", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, learner, roc_auc, weight): the area under each learner's curve on df, and its share of their sum."""
    long = df.select(*keys, label, F.explode(F.array(*[F.struct(F.lit(x).alias("learner"), c(x).alias("p")) for x in scores])).alias("s")).select(*keys, label, "s.*")
    auc = classification_metrics(long.where("p is not null"), "p", label, (*keys, "learner")).select(*keys, "learner", "roc_auc")
    return auc.withColumn("weight", F.try_divide("roc_auc", F.sum("roc_auc").over(Window.partitionBy(*keys))))


def signal_of(p: Column, sure: Column, long: float = 0.6, short: float = 0.4, least: float = 0.5) -> Column:
    """1 over `long`, -1 under `short`, 0 between them or under the least confidence."""
    return F.when(sure < least, 0).when(p > long, 1).when(p < short, -1).otherwise(0)


def stacked(df: DataFrame, features: list[str], n_folds: int = 5, gap: int = 20, seed: int = 42, rounds: int = 20, trees: int = 40) -> tuple[DataFrame, list[PipelineModel]]:
    """Learners fitted on the training part, a logistic model on their out-of-fold scores; adds p, confidence, signal."""
    whole = dated(gathered(df))
    train = folds(whole.where("is_train"), n_folds, gap).persist()
    scored, pipes = None, learners(features, seed, rounds, trees)
    before = {k: train.where(c("trains_from") <= k) for k in range(1, n_folds + 1)}  # each fold is scored by models of the bars before it
    before = {k: x for k, x in before.items() if x.select("target").distinct().count() > 1}
    if not before:
        raise ValueError("too few bars of both classes for the folds")
    found = fitted({(k, name): (pipe, x) for k, x in [*before.items(), (None, train)] for name, pipe in pipes.items()})
    for k in before:
        part = train.where(c("fold") == k)
        for name in pipes:
            part = score(found[k, name], part, name)
        scored = part if scored is None else scored.union(part)
    names, models = [f"p_{x}" for x in pipes], [found[None, name] for name in pipes]
    for name, model in zip(pipes, models, strict=True):
        whole = score(model, whole, name)
    meta = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), LogisticRegression(labelCol="target", featuresCol="features")]).fit(scored)
    out = meta.transform(whole).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
    out = out.withColumn("confidence", confidence([c(x) for x in names], c("p")))
    return out.withColumn("signal", signal_of(c("p"), c("confidence"))), [*models, meta]


#: Three boosters that differ in depth, in the share of rows and features of a tree, and in the rows that a leaf needs.
BOOSTERS = {
    "deep": {"maxDepth": 6, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 3},
    "leafy": {"maxDepth": 5, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 20},
    "plain": {"maxDepth": 4, "subsamplingRate": 1.0, "featureSubsetStrategy": "all", "minInstancesPerNode": 1},
}


def held_back(df: DataFrame, share: float = 0.2) -> DataFrame:
    """Adds is_valid: the latest `share` of the rows by a date that all symbols share."""
    return dated(df, 1 - share).withColumn("is_valid", ~c("is_train")).drop("is_train")


def boosters(features: list[str], task: str = "regression", rounds: int = 500, step: float = 0.05, tolerance: float = 0.01, seed: int = 42) -> dict[str, Pipeline]:
    """Scaled features and one booster each, for regression or classification. Rows with is_valid decide when a booster stops: once a
    round betters their error by less than the share `tolerance`."""
    ready = [VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="keep"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]
    kind = GBTRegressor if task == "regression" else GBTClassifier
    common = {"labelCol": "target", "featuresCol": "features", "maxIter": rounds, "stepSize": step, "seed": seed, "validationIndicatorCol": "is_valid", "validationTol": tolerance}
    return {name: Pipeline(stages=[*ready, kind(**common, **own)]) for name, own in BOOSTERS.items()}


def predicted(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """Adds p_<name>, the prediction."""
    return model.transform(df).withColumnRenamed("prediction", f"p_{name}").drop("_raw", "features")


def rounds_of(model: PipelineModel) -> int:
    return model.stages[-1].getNumTrees


def error_weights(df: DataFrame, predictions: list[str], label: str = "target") -> DataFrame:
    """(learner, mse, weight): mean squared error of each prediction on df, and its inverse over the sum of inverses."""
    long = df.where(c(label).isNotNull()).select(label, F.explode(F.array(*[F.struct(F.lit(x).alias("learner"), c(x).alias("p")) for x in predictions])).alias("s")).select(label, "s.*")
    mse = long.where("p is not null").groupBy("learner").agg(F.avg((c("p") - c(label)) * (c("p") - c(label))).alias("mse"))
    inverse = 1 / (c("mse") + 1e-8)
    return mse.withColumn("weight", inverse / F.sum(inverse).over(Window.partitionBy()))  # one row a learner


def stacked_regression(df: DataFrame, features: list[str], n_folds: int = 5, gap: int = 20, rounds: int = 500, tolerance: float = 0.01, penalty: float = 1.0, seed: int = 42) -> tuple[DataFrame, list[PipelineModel]]:
    """Boosters with early stop, fitted on the training part (by a date that all symbols share); a ridge regression on their
    out-of-fold predictions, and weights by the inverse of their out-of-fold errors. Adds p_<booster>, p (ridge), p_weighted and is_train."""
    whole = dated(gathered(df))
    train = folds(whole.where("is_train"), n_folds, gap).persist()
    scored, pipes = None, boosters(features, "regression", rounds, tolerance=tolerance, seed=seed)
    before = {k: held_back(train.where(c("trains_from") <= k).drop("is_train")) for k in range(1, n_folds + 1)}
    before = {k: x for k, x in before.items() if not x.where("not is_valid").isEmpty() and not x.where("is_valid").isEmpty()}
    if not before:
        raise ValueError("too few bars for the folds")
    found = fitted({(k, name): (pipe, x) for k, x in [*before.items(), (None, held_back(train.drop("is_train")))] for name, pipe in pipes.items()})
    for k in before:
        part = train.where(c("fold") == k)
        for name in pipes:
            part = predicted(found[k, name], part, name)
        scored = part if scored is None else scored.union(part)
    names, models = [f"p_{x}" for x in BOOSTERS], [found[None, name] for name in pipes]
    for name, model in zip(pipes, models, strict=True):
        whole = predicted(model, whole, name)
    meta = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), LinearRegression(labelCol="target", featuresCol="features", regParam=penalty, elasticNetParam=0.0)]).fit(scored)
    weight = {r["learner"]: r["weight"] for r in error_weights(scored, names).collect()}  # one row a learner
    out = meta.transform(whole).withColumnRenamed("prediction", "p").drop("features")
    return out.withColumn("p_weighted", sum(weight[x] * c(x) for x in names)), [*models, meta]


def text_scorer(labelled: DataFrame, text: str = "text", label: str = "label", width: int = 1 << 18, penalty: float = 0.001) -> PipelineModel:
    """A scorer for the third place of the ensemble: hashed counts of words, weighted by how rare they are, and a logistic regression
    on labels 0 and 1. A Spark transformer, fitted on all labelled rows; null texts have no words."""
    rows = labelled.where(c(label).isNotNull()).select(F.coalesce(c(text), F.lit("")).alias("_text"), c(label).cast("double").alias("_label"))
    stages = [RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[\p{L}']+", gaps=False), HashingTF(inputCol="_words", outputCol="_counts", numFeatures=width), IDF(inputCol="_counts", outputCol="_vector"), LogisticRegression(labelCol="_label", featuresCol="_vector", regParam=penalty, probabilityCol="_probability", rawPredictionCol="_margin", predictionCol="_class")]
    return Pipeline(stages=stages).fit(rows)


def text_scores(model: PipelineModel, df: DataFrame, text: str = "text") -> DataFrame:
    """Adds model_score, the probability of 1 less that of 0, and model_confidence, the larger of both."""
    out = model.transform(df.withColumn("_text", F.coalesce(c(text), F.lit("")))).withColumn("_p", vector_to_array("_probability"))
    return out.withColumns({"model_score": c("_p")[1] - c("_p")[0], "model_confidence": F.array_max("_p")}).drop("_text", "_words", "_counts", "_vector", "_probability", "_margin", "_class", "_p")


def classification_metrics(df: DataFrame, probability: str = "p", label: str = "target", keys: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 without cases) and the area under the curve by rank sums with ties. Ranks are taken in 1024
    stretches of the probability, behind the rows of the stretches before, so that no task sorts them all."""
    p, y = c(probability), c(label)
    yes = p >= 0.5
    by_value = df.groupBy(*keys, probability).agg(F.count("*").alias("n"), F.sum((y == 1).cast("long")).alias("ones"), F.count_if(yes & (y == 1)).alias("tp"), F.count_if(yes & (y == 0)).alias("fp"), F.count_if(~yes & (y == 1)).alias("fn"), F.count_if(~yes & (y == 0)).alias("tn"))
    by_value = by_value.withColumn("_b", F.floor(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) * 1024).cast("int"))
    stretches = by_value.groupBy(*keys, "_b").agg(F.sum("n").alias("_n"))
    below = stretches.withColumn("_below", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    w = Window.partitionBy(*keys, "_b").orderBy(probability).rowsBetween(Window.unboundedPreceding, 0)
    # mean rank of ties: rows before the value, plus half of the rows with it
    ranked = by_value.join(below, [*keys, "_b"]).withColumn("rank", c("_below") + F.sum("n").over(w) - (c("n") - 1) / 2.0)
    s = ranked.groupBy(*keys).agg(F.sum(c("rank") * c("ones")).alias("_r"), *[F.sum(x).alias(x) for x in ("ones", "n", "tp", "fp", "fn", "tn")])
    zeros = c("n") - c("ones")
    s = s.withColumns({"accuracy": (c("tp") + c("tn")) / c("n"), "precision": F.coalesce(F.try_divide("tp", c("tp") + c("fp")), F.lit(0.0)), "recall": F.coalesce(F.try_divide("tp", c("tp") + c("fn")), F.lit(0.0)), "roc_auc": F.try_divide(c("_r") - c("ones") * (c("ones") + 1) / 2, c("ones") * zeros)})
    return s.withColumn("f1", F.coalesce(F.try_divide(2 * c("precision") * c("recall"), c("precision") + c("recall")), F.lit(0.0))).select(*keys, "n", "tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1", "roc_auc")


def regression_metrics(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """A13."""
    d = c(label) - c(prediction)
    return df.agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"))


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Features by falling importance, of sum 1."""
    found = model.stages[-1].featureImportances.toArray()
    total = found.sum() or 1.0
    return sorted(((f, float(x / total)) for f, x in zip(features, found, strict=True)), key=lambda x: (-x[1], x[0]))


def probabilities(p: Column) -> Column:
    """(1 - p, p)."""
    return F.array(1 - p, p)


def save(models: list[PipelineModel], path: str) -> None:
    """The fitted models, numbered, in Spark ML's own format."""
    for i, m in enumerate(models):
        m.write().overwrite().save(f"{path}/{i:03d}")


def load(path: str, n: int) -> list[PipelineModel]:
    return [PipelineModel.load(f"{path}/{i:03d}") for i in range(n)]
