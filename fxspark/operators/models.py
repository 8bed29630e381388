"""Model fitting on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .joins import same_keys


def zscore(df: DataFrame, keys: list[str], cols: list[str], fit_on=None, suffix: str = "_z") -> DataFrame:
    """(x - mean) / population deviation per key; zero deviation counts as 1, missing results as 0.

    ``fit_on`` limits the rows the mean and deviation come from (for instance the training rows).
    """
    src = df if fit_on is None else df.filter(fit_on)
    fit = src.groupBy(*keys).agg(
        *(F.avg(c).alias(f"_m_{c}") for c in cols), *(F.stddev_pop(c).alias(f"_s_{c}") for c in cols)
    )
    joined = same_keys(df, fit, keys, "left")
    z = {
        f"{c}{suffix}": F.coalesce(
            (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}")), F.lit(0.0)
        )
        for c in cols
    }
    return joined.withColumns(z).drop(*(f"_{p}_{c}" for c in cols for p in "ms"))


def _vector(df: DataFrame, feats: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=feats, outputCol=out, handleInvalid="skip").transform(df)


CLUSTER_ROWS = 10_000  # rows of a task of a K-means step
FITS = 4  # K-means models that are fitted side by side


def clusters(df: DataFrame, key: str, feats: list[str], k_range: tuple[int, int] = (2, 10), min_silhouette: float = 0.3, seed: int = 42) -> DataFrame:
    """K-means with k chosen by silhouette; one cluster when no k reaches ``min_silhouette``.

    A fit takes up to 300 short steps over all rows, so these are dealt into as many tasks as they need, not into those of a shuffle.
    The tasks follow from the rows alone: the same rows give the same clusters on any cluster. Of equal silhouettes the smaller k wins.
    """
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import vector_to_array

    rows = cut(_vector(df, feats).select(key, "features"))
    n = rows.count()
    tasks = max(1, -(-n // CLUSTER_ROWS))
    # coalesce changes nothing unless the session holds shuffles at more partitions than asked for
    data = rows.repartition(tasks, key).coalesce(tasks).sortWithinPartitions(key, vector_to_array("features")).persist()

    def fit(k: int):
        model = KMeans(k=k, seed=seed, maxIter=300, tol=1e-4).fit(data)
        return model, ClusteringEvaluator().evaluate(model.transform(data))

    best, best_score = None, -1.0
    try:
        with ThreadPool(FITS) as pool:
            for model, score in pool.imap(inheritable_thread_target(df.sparkSession)(fit), range(k_range[0], min(k_range[1], n - 1) + 1)):
                if score > best_score:
                    best, best_score = model, score
    finally:
        data.unpersist()
    if best is None or best_score < min_silhouette:
        return rows.select(key, F.lit(0).alias("cluster"), F.lit(float(best_score)).alias("silhouette"))
    return best.transform(rows).select(key, F.col("prediction").alias("cluster"), F.lit(float(best_score)).alias("silhouette"))


def f_statistic(df: DataFrame, label: str, feats: list[str]) -> DataFrame:
    """One-way ANOVA F per feature, from one aggregate per class."""
    g = df.groupBy(label).agg(
        F.count("*").alias("n"), *(F.avg(f).alias(f"m_{f}") for f in feats), *(F.var_pop(f).alias(f"v_{f}") for f in feats)
    )
    rows = g.select(
        "n", F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("m"), F.col(f"v_{f}").alias("v")) for f in feats)))
    )
    n, m = F.col("n"), F.col("m")
    s = rows.groupBy("feature").agg(
        F.count("*").alias("k"), F.sum("n").alias("t"), F.sum(n * F.col("v")).alias("within"),
        F.sum(n * m).alias("sm"), F.sum(n * m * m).alias("smm"),
    )
    between = F.col("smm") - F.col("sm") * F.col("sm") / F.col("t")
    # one class, or as many classes as rows, has no F
    return s.select("feature", F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide("within", F.col("t") - F.col("k"))).alias("score"))


def mutual_information(df: DataFrame, label: str, feats: list[str], bins: int = 10) -> DataFrame:
    """Mutual information of the class and each feature cut at its exact quantiles."""
    from .quantiles import group_quantiles

    one = df.select(F.col(label).alias("_y"), F.lit(0).alias("_all"), *feats)
    names = {f"c{i}": i / bins for i in range(1, bins)}
    q = group_quantiles(one, ["_all"], feats, names)
    cuts = q.select(F.inline(F.array(*(
        F.struct(F.lit(f).alias("feature"), F.array(*(F.round(f"{f}_{c}", 9) for c in names)).alias("cuts")) for f in feats))))
    long = one.unpivot(["_y"], feats, "feature", "x")
    cells = long.join(F.broadcast(cuts), "feature").groupBy(
        "feature", "_y", F.size(F.filter("cuts", lambda c: c < F.col("x"))).alias("bin")
    ).agg(F.count("*").alias("n"))
    cells = cut(cells)  # one row per feature, bin and class
    by_bin = cells.groupBy("feature", "bin").agg(F.sum("n").alias("nb"))
    by_y = cells.groupBy("feature", "_y").agg(F.sum("n").alias("ny"))
    total = cells.groupBy("feature").agg(F.sum("n").alias("t"))
    joined = cells.join(by_bin, ["feature", "bin"]).join(by_y, ["feature", "_y"]).join(total, "feature")
    n, t = F.col("n").cast("double"), F.col("t").cast("double")
    return joined.groupBy("feature").agg(F.sum(n / t * F.ln(n * t / (F.col("nb") * F.col("ny").cast("double")))).alias("score"))


def forest_importance(df: DataFrame, label: str, feats: list[str], trees: int = 100, depth: int = 10, seed: int = 42) -> DataFrame:
    """Importance of each feature in a random forest for the class."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer

    data = _vector(StringIndexer(inputCol=label, outputCol="_label").fit(df).transform(df), feats)
    model = RandomForestClassifier(labelCol="_label", numTrees=trees, maxDepth=depth, seed=seed).fit(data)
    rows = [(f, float(s)) for f, s in zip(feats, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, score double")


def principal_components(df: DataFrame, feats: list[str], threshold: float = 0.95, cap: int = 8):
    """Standardised principal components up to a share of variance: (scores, variance rows).

    The sign of a component makes its largest loading positive. Loadings are features x components, a
    small matrix on the driver; scores stay distributed as columns pc1, pc2, ...
    """
    import numpy as np
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array

    v = _vector(df, feats, "_raw")
    v = StandardScaler(inputCol="_raw", outputCol="_std", withMean=True).fit(v).transform(v)
    model = PCA(k=len(feats), inputCol="_std", outputCol="_pc").fit(v)
    ev = model.explainedVariance.toArray()
    k = int(np.searchsorted(np.cumsum(ev), threshold)) + 1
    k = min(max(1, k), cap, len(feats))
    load = model.pc.toArray()[:, :k]
    sign = np.where(load[np.abs(load).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    arr = vector_to_array("_pc")
    scores = model.transform(v).select(*df.columns, *((arr[i] * float(sign[i])).alias(f"pc{i + 1}") for i in range(k)))
    rows = [(i + 1, float(ev[i]), float(ev[: i + 1].sum()), feats[int(np.abs(load[:, i]).argmax())]) for i in range(k)]
    return scores, df.sparkSession.createDataFrame(rows, "component int, explained double, cumulative double, main_feature string")


def mixture_states(df: DataFrame, feats: list[str], n_states: int = 3, seed: int = 42, max_iter: int = 500, tol: float = 1e-3) -> DataFrame:
    """Regime state, its probabilities and confidence from a Gaussian mixture over the features.

    Stands in for a hidden Markov model: the same outputs without transitions inside the fit, so labels
    differ by design.
    """
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import vector_to_array

    v = _vector(df, feats)
    model = GaussianMixture(k=n_states, seed=seed, maxIter=max_iter, tol=tol).fit(v)
    p = vector_to_array("probability")
    return model.transform(v).select(
        *df.columns, F.col("prediction").alias("state"), p.alias("state_probabilities"), F.array_max(p).alias("confidence"))


def batch_predictions(df: DataFrame, feats: list[str], target: str, name: str, version: str, keep: list[str]) -> DataFrame:
    """Predictions of a linear model with its name and version, for every row.

    Rows whose ``target`` (the next value) is known train the model; rows without it, the newest of each series, are only scored.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=feats, outputCol="_raw", handleInvalid="skip"),
        StandardScaler(inputCol="_raw", outputCol="_std", withMean=True),
        LinearRegression(featuresCol="_std", labelCol=target, predictionCol="pred_next_close", solver="normal"),
    ])
    model = pipe.fit(df.filter(F.col(target).isNotNull()))
    return model.transform(df).select(*keep, "pred_next_close", F.lit(name).alias("model_name"), F.lit(version).alias("model_version"))
