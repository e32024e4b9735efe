"""Learned scorers over the feature table: a linear baseline and boosted trees, both pointwise.

MLlib has no pairwise ranking objective; the order that is served by default is shortest path first
(`driftrank.operators.metrics.with_path_score`), and these are the learned options.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import median

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftrank.operators.metrics import average_precision
from driftrank.tables import park

LONG_TAILED = ("inherited_by", "prior_breaks_in_module", "package_rank", "release_size", "package_churn")


def prepared(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Long-tailed numbers as log1p of what is above 0; everything numeric as double. What is missing stays so."""
    above = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c).cast("double"), F.lit(0.0)))
    return df.withColumns({c: F.log1p(above(c)) if c in LONG_TAILED else F.col(c).cast("double") for c in numeric})


def linear(numeric: Sequence[str], categorical: Sequence[str], label: str, steps: int = 5000) -> Pipeline:
    """Medians for missing numbers, unit scale, one column a category (unseen: none), logistic regression with balanced weights in `weight`.

    The fit goes on until it converges; `steps`, the reference's limit, is only there to end one that doesn't.
    """
    filled, coded = [f"{c}__f" for c in numeric], [f"{c}__i" for c in categorical]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=list(numeric), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="__numbers"),
        StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True),
        StringIndexer(inputCols=list(categorical), outputCols=coded, handleInvalid="keep"),
        OneHotEncoder(inputCols=coded, outputCols=[f"{c}__o" for c in categorical], handleInvalid="keep"),
        VectorAssembler(inputCols=["__scaled", *[f"{c}__o" for c in categorical]], outputCol="features"),
        LogisticRegression(labelCol=label, weightCol="weight", maxIter=steps, regParam=1e-4),
    ])


def trees(numeric: Sequence[str], categorical: Sequence[str], label: str, count: int = 20, seed: int = 0) -> Pipeline:
    coded = [f"{c}__i" for c in categorical]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=list(numeric), outputCols=[f"{c}__f" for c in numeric]),
        StringIndexer(inputCols=list(categorical), outputCols=coded, handleInvalid="keep"),
        VectorAssembler(inputCols=[*[f"{c}__f" for c in numeric], *coded], outputCol="features"),
        GBTClassifier(labelCol=label, maxIter=count, maxDepth=4, seed=seed),
    ])


def balanced(df: DataFrame, label: str) -> DataFrame:
    """weight: rows / (2 * rows of the class)."""
    n = df.agg(F.count("*").alias("__n"), F.sum(label).alias("__p"))
    joined = df.join(F.broadcast(n))  # one row
    return joined.withColumn("weight", F.when(F.col(label) == 1, F.col("__n") / (2 * F.col("__p"))).otherwise(F.col("__n") / (2 * (F.col("__n") - F.col("__p"))))).drop("__n", "__p")


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    """score: the probability of a positive, never the class."""
    return model.transform(df).withColumn("score", vector_to_array("probability")[1])


def importances(model: PipelineModel, names: Sequence[str]) -> list[tuple[str, float]]:
    """(feature, share of gain) of a tree model, largest first."""
    found = model.stages[-1].featureImportances.toArray()
    return sorted(zip(names, map(float, found)), key=lambda x: -x[1])


def tree_count(per_fold: Sequence[int], least: int = 20) -> int:
    """The median over folds, not below `least`."""
    s = sorted(per_fold)
    return max(least, s[len(s) // 2] if s else least)


def choose(settings: Sequence[dict], scores: Sequence[float], simplicity) -> dict:
    """The setting with the best score; of equals the simplest."""
    best = max(scores)
    return min((s for s, x in zip(settings, scores) if x == best), key=simplicity)


def grid(folds: DataFrame, settings: Sequence[dict], make, label: str) -> list[tuple[dict, float]]:
    """(setting, median over the folds of average precision over the floor), in the settings' order. folds: with fold and role, as
    `labels.folds` deals them; make(setting): an unfitted pipeline. Folds whose validation rows hold no positive are left out.
    """
    folds = park(folds, "folds")
    usable = [r.fold for r in folds.where("role = 'validate'").groupBy("fold").agg(F.sum(label).alias("p")).where("p > 0").orderBy("fold").collect()]  # a row a fold
    out = []
    for s in settings:
        lifts = []
        for f in usable:
            model = make(s).fit(balanced(folds.where((F.col("fold") == f) & (F.col("role") == "fit")), label))
            ap = average_precision(scored(model, folds.where((F.col("fold") == f) & (F.col("role") == "validate"))), "score", label).first()
            lifts.append(ap.pr_auc_ties / ap.floor)
        out.append((s, median(lifts) if lifts else 0.0))
    return out


def refit(rows: DataFrame, tried: Sequence[tuple[dict, float]], simplicity, make, label: str) -> tuple[dict, PipelineModel]:
    """The chosen setting and its model of all training rows."""
    best = choose([s for s, _ in tried], [x for _, x in tried], simplicity)
    return best, make(best).fit(balanced(rows, label))


def ablated(train: DataFrame, test: DataFrame, kinds: dict[str, list[str]], every: list[str], make, label: str) -> list[tuple[str, float, float]]:
    """(name, average precision, move against all features) of `all` and of each subset of `ablations`; make(features) is an unfitted pipeline."""
    train, test = park(balanced(train, label), "train"), park(test, "test")

    def value(features: list[str]) -> float:
        return average_precision(scored(make(features).fit(train), test), "score", label).first().pr_auc_ties

    whole = value(every)
    return [("all", whole, 0.0)] + [(name, x := value(kept), x - whole) for name, kept in kinds.items()]


def noise_floor(moves: Sequence[tuple[str, float, float]]) -> float:
    """The largest move of a control, which carried no gain: what smaller moves are not told apart from."""
    return max((abs(m) for name, _, m in moves if name.startswith("control:")), default=0.0)


def serving_scores(model: PipelineModel, development: DataFrame, holdout: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """key, model_version, score of every row, held out or not: what pages are served from. No label is read."""
    both = development.unionByName(holdout)
    return scored(model, both).select(*key, F.lit(version).alias("model_version"), "score")


def ablations(features: Sequence[str], groups: dict[str, Sequence[str]], controls: Sequence[str] = ()) -> dict[str, list[str]]:
    """name -> features that are left, for each group and for up to three controls that carried no gain."""
    out = {name: [f for f in features if f not in gone] for name, gone in groups.items()}
    return out | {f"control:{c}": [f for f in features if f != c] for c in list(controls)[:3]}
