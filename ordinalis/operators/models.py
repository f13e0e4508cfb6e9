"""Out-of-fold models on Spark ML and their stacking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinalis.operators import metrics
from ordinalis.session import cut

# Ridge penalties of the five level-1 models.
ALPHAS = {"clip_img": 3.3, "tfidf": 3.0, "clip_text": 3.3, "siglip_img": 3.0, "siglip_text": 1.0}


def assemble(df: DataFrame, columns: list[str], out: str = "features", missing: float = -1.0) -> DataFrame:
    """A vector column; nulls become ``missing`` beside an indicator column of their own."""
    filled = df.select("*", *(F.coalesce(F.col(c).cast("double"), F.lit(missing)).alias(f"__v_{c}") for c in columns), *(F.col(c).isNull().cast("double").alias(f"__n_{c}") for c in columns))
    made = VectorAssembler(inputCols=[*(f"__v_{c}" for c in columns), *(f"__n_{c}" for c in columns)], outputCol=out).transform(filled)
    return made.drop(*(f"__v_{c}" for c in columns), *(f"__n_{c}" for c in columns))


def ridge(train: DataFrame, y: str, alpha: float, features: str = "features"):
    """Ridge with an unpenalised intercept, penalty ``alpha`` on the sum of squared errors, by normal equations in one pass; for at most
    4,096 features. Sparse features of any number are in ``sparse.ridge_oof``."""
    n, deviation = train.agg(F.count("*"), F.stddev_pop(F.col(y).cast("double"))).first()
    if not n:
        raise ValueError("ridge needs rows")
    return LinearRegression(featuresCol=features, labelCol=y, predictionCol="pred", elasticNetParam=0.0, standardization=False, solver="normal", regParam=alpha / n * (deviation or 1.0)).fit(train)


# What level 2 changes of the boosting parameters.
LEVEL2 = {"rate": 0.01, "leaf": 40, "depth": 4}


def gbt(train: DataFrame, y: str, features: str = "features", rounds: int = 20, depth: int = 5, rate: float = 0.1, leaf: int = 20, seed: int = 42):
    """Gradient-boosted trees."""
    return GBTRegressor(featuresCol=features, labelCol=y, predictionCol="pred", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, subsamplingRate=0.8, featureSubsetStrategy="0.6", minInstancesPerNode=leaf).fit(train)


class Classifier:
    """Boosted trees that tell two classes apart; ``pred`` is the probability of class 1."""

    def __init__(self, train: DataFrame, y: str, rounds: int = 20, depth: int = 4, rate: float = 0.1, seed: int = 42) -> None:
        made = GBTClassifier(labelCol=y, predictionCol="__label", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, subsamplingRate=0.8, featureSubsetStrategy="0.6")
        made.set(made.probabilityCol, "__p")
        made.set(made.rawPredictionCol, "__raw")
        self.model = made.fit(train)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).withColumn("pred", vector_to_array("__p")[1]).drop("__label", "__p", "__raw")


def stopped(train: DataFrame, valid: DataFrame, y: str, rounds: int = 5000, patience: int = 200, step: int = 200, **parameters):
    """(model, best round): trees up to the round with the smallest squared error on ``valid``, once ``patience`` further rounds bring no
    better one or ``rounds`` end. The trees of a run begin those of any longer one with the same seed, so a longer run only adds to it."""
    tried = min(step, rounds)
    while True:
        errors = gbt(train, y, rounds=tried, **parameters).evaluateEachIteration(valid, "squared")
        best = min(range(tried), key=errors.__getitem__) + 1
        if tried >= rounds or tried - best >= patience:
            return gbt(train, y, rounds=best, **parameters), best
        tried = min(2 * tried, rounds)


def boosted(df: DataFrame, key: str, y: str, names: list[str], n_folds: int = 5, seeds: tuple[int, ...] = (42,), rounds: int = 5000, patience: int = 200, step: int = 200, **parameters) -> dict:
    """Boosting on fixed folds, every fold stopped by its own rows: oof (key, y, fold, pred), averaged over seeds; importance (feature, gain),
    the mean over folds and seeds; best_rounds, one per fold and seed, which size a refit on all rows; kappas, one per seed."""
    frames, gains, best_rounds, kappas = [], dict.fromkeys(names, 0.0), [], []
    known = df.where(F.col(y).isNotNull())
    for seed in seeds:
        fits = []
        for f in range(n_folds):
            fits.append(stopped(known.where(F.col("fold") != f), known.where(F.col("fold") == f), y, rounds, patience, step, seed=seed, **parameters))
            best_rounds.append(fits[-1][1])
            for name, gain in importance(fits[-1][0], names):
                gains[name] += gain / (n_folds * len(seeds))
        models_of = iter([m for m, _ in fits])
        frames.append(cut(out_of_fold(df, key, y, lambda _, m=models_of: next(m), n_folds)))
        kappas.append(oof_kappa(frames[-1], y))
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    oof = whole.groupBy(key, y, "fold").agg(F.avg("pred").alias("pred"))
    return {"oof": oof, "importance": sorted(gains.items(), key=lambda x: (-x[1], x[0])), "best_rounds": best_rounds, "kappas": kappas}


def out_of_fold(df: DataFrame, key: str, y: str, fit: Callable[[DataFrame], object], n_folds: int = 5) -> DataFrame:
    """(key, y, fold, pred): every labelled row predicted by a model that never saw its fold, every unlabelled row (null ``y``) by the
    mean of all of them. ``df`` has features and fold; it is written down, as every model reads it several times."""
    rows = cut(df.select(key, F.col(y).cast("double").alias(y), "fold", "features"))
    known, parts, tests = rows.where(F.col(y).isNotNull()), [], []
    for f in range(n_folds):
        model = fit(known.where(F.col("fold") != f))
        parts.append(model.transform(known.where(F.col("fold") == f)).select(key, y, "fold", "pred"))
        tests.append(model.transform(rows.where(F.col(y).isNull())).select(key, "pred"))
    whole, test = parts[0], tests[0]
    for p, t in zip(parts[1:], tests[1:], strict=True):
        whole, test = whole.unionByName(p), test.unionByName(t)
    mean = test.groupBy(key).agg(F.avg("pred").alias("pred")).select(key, F.lit(None).cast("double").alias(y), F.lit(None).cast("int").alias("fold"), "pred")
    return whole.unionByName(mean)


def honest_labels(oof: DataFrame, y: str, score: str = "pred", n_folds: int = 5) -> DataFrame:
    """``oof`` with label: cut-points of a fold come from the other folds only; unlabelled rows use the cuts of all labelled rows."""
    oof = cut(oof)
    known = oof.where(F.col(y).isNotNull())
    label = metrics.apply_cuts(F.col(score), metrics.optimise_cuts(known, score, y))
    for f in range(n_folds):
        cuts = metrics.optimise_cuts(known.where(F.col("fold") != f), score, y)
        label = F.when(F.col("fold") == f, metrics.apply_cuts(F.col(score), cuts)).otherwise(label)
    return oof.withColumn("label", label)


def stack(level1: dict[str, DataFrame], base: DataFrame, key: str, y: str, columns: list[str], seeds: tuple[int, ...] = (1, 2), n_folds: int = 5) -> DataFrame:
    """(key, y, fold, pred): boosted trees over hand features and level-1 predictions, averaged over seeds. ``base`` has key, y, fold
    and ``columns``; each level-1 frame has key and pred."""
    wide = base
    for name, frame in level1.items():
        wide = wide.join(frame.select(key, F.col("pred").alias(f"l1_{name}")), key, "left")
    ready = cut(assemble(wide, [*columns, *(f"l1_{n}" for n in level1)]))
    whole = None
    for s in seeds:
        part = out_of_fold(ready, key, y, lambda t, s=s: gbt(t, y, seed=s, depth=LEVEL2["depth"], leaf=LEVEL2["leaf"]), n_folds)
        whole = part if whole is None else whole.unionByName(part)
    return whole.groupBy(key, y, "fold").agg(F.avg("pred").alias("pred"))


def blend(frames: dict[str, DataFrame], base: DataFrame, key: str, y: str, alpha: float = 1.0) -> DataFrame:
    """Out-of-fold ridge over the predictions of several models."""
    wide = base
    for name, frame in frames.items():
        wide = wide.join(frame.select(key, F.col("pred").alias(name)), key)
    return out_of_fold(assemble(wide, list(frames)), key, y, lambda t: ridge(t, y, alpha))


def adversarial(df: DataFrame, key: str, is_test: str, columns: list[str], n_folds: int = 5) -> DataFrame:
    """(auc) of telling test rows from training rows out of fold; near 0.5 means the splits look alike. ``df`` has fold."""
    ready = assemble(df.withColumn(is_test, F.col(is_test).cast("double")), columns)
    scored = out_of_fold(ready, key, is_test, lambda t: Classifier(t, is_test), n_folds)
    return metrics.auc(scored, is_test, "pred")


def importance(model, names: list[str], missing_columns: bool = True) -> list[tuple[str, float]]:
    """(feature, gain share), largest first."""
    values = model.featureImportances.toArray()
    n = len(names)
    whole = [(name, float(values[k] + (values[n + k] if missing_columns and len(values) > n else 0.0))) for k, name in enumerate(names)]
    return sorted(whole, key=lambda x: (-x[1], x[0]))


def project(df: DataFrame, key: str, features: str, k: int) -> DataFrame:
    """(key, projected): principal components fitted on all rows, labels unseen."""
    model = PCA(k=k, inputCol=features, outputCol="__p").fit(df)
    return model.transform(df).select(key, vector_to_array("__p").alias("projected"))


def oof_kappa(oof: DataFrame, y: str, score: str = "pred") -> float:
    """Kappa of labelled rows after cut-points learned on them."""
    known = oof.where(F.col(y).isNotNull())
    cuts = metrics.optimise_cuts(known, score, y)
    return known.select(F.col(y), metrics.apply_cuts(F.col(score), cuts).alias("__p")).agg(metrics.qwk(y, "__p").alias("q")).first()["q"] or 0.0


def alpha_grid(df: DataFrame, key: str, y: str, alphas: tuple[float, ...], n_folds: int = 5) -> list[tuple[float, float]]:
    """(alpha, kappa) of ridge at each penalty, best first; ties go to the smaller penalty."""
    scores = [(a, oof_kappa(cut(out_of_fold(df, key, y, lambda t, a=a: ridge(t, y, a), n_folds)), y)) for a in alphas]
    return sorted(scores, key=lambda s: (-s[1], s[0]))


def ablation(frame: DataFrame, key: str, y: str, sets: dict[str, list[str]], alpha: float = 3.0, n_folds: int = 5) -> list[tuple[str, int, float]]:
    """(name, number of columns, kappa) of ridge on each set of columns."""
    return [(name, len(columns), oof_kappa(cut(out_of_fold(assemble(frame, columns), key, y, lambda t: ridge(t, y, alpha), n_folds)), y)) for name, columns in sets.items()]


def ensemble(frames: list[DataFrame], key: str) -> DataFrame:
    """(key, pred): the mean of several runs' predictions; a row counts where all runs have it."""
    whole = frames[0].select(key, "pred")
    for frame in frames[1:]:
        whole = whole.unionByName(frame.select(key, "pred"))
    return whole.groupBy(key).agg(F.avg("pred").alias("pred"), F.count("pred").alias("__n")).where(F.col("__n") == len(frames)).select(key, "pred")


def full_refit(df: DataFrame, y: str, best_rounds: list[int], growth: float = 1.15, seed: int = 42, **parameters):
    """Boosted trees on all labelled rows, with the mean of the folds' best rounds stretched by ``growth``."""
    rounds = max(1, int(sum(best_rounds) / len(best_rounds) * growth))
    return gbt(df.where(F.col(y).isNotNull()), y, rounds=rounds, seed=seed, **parameters)


# The gains in honest kappa from which a candidate run is submitted.
GATES = {"A": -0.002, "B": 0.005, "C": 0.005}


def accept(gain: float, least: float = GATES["B"]) -> bool:
    """Whether a candidate's honest gain passes the gate."""
    return gain >= least


def honest_kappa(oof: DataFrame, y: str, n_folds: int = 5) -> float:
    """Kappa with every fold labelled by the cut-points of the others."""
    return honest_labels(oof, y, n_folds=n_folds).where(F.col(y).isNotNull()).agg(metrics.qwk(y, "label").alias("q")).first()["q"] or 0.0


def gate(runs: dict[str, tuple[str, DataFrame]], base: str, y: str, n_folds: int = 5) -> list[tuple[str, float, float, bool]]:
    """(run, honest kappa, gain over ``base``, accepted) of every run; each is given with the name of its gate."""
    scores = {name: honest_kappa(oof, y, n_folds) for name, (_, oof) in runs.items()}
    return [(name, scores[name], scores[name] - scores[base], accept(scores[name] - scores[base], GATES[kind])) for name, (kind, _) in runs.items()]
