"""Susceptibility and rain models on pyspark.ml, always judged on groups they have not seen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgewater.operators.sampling import balanced_folds, interleaved_folds, split_groups
from ridgewater.operators.scale import exact_quantiles
from ridgewater.operators.verify import average_precision, classifier_report, confusion, group_weights, roc_auc, score_spread
from ridgewater.session import stage

TARGETS = {"critical": 0.10, "watch": 0.20}
SEED = 42


def feature_table(df: DataFrame, windows: list[str], districts: list, day: str = "day") -> tuple[DataFrame, list[str]]:
    """Adds day_of_season (days since 1 June) and one 0/1 column per district; returns the feature names."""
    start = F.make_date(F.year(day), F.lit(6), F.lit(1))
    flags = {f"district_{d}": (F.col("district") == d).cast("double") for d in districts}
    out = df.withColumn("day_of_season", F.datediff(F.col(day), start).cast("double"))
    for name, column in flags.items():
        out = out.withColumn(name, column)
    extra = ["antecedent_5d"] if "antecedent_5d" in df.columns else []
    return out, [*windows, *extra, "day_of_season", *flags]


def trees(features: list[str], weight: str | None = None, rounds: int = 20, depth: int = 4) -> Pipeline:
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, seed=SEED, subsamplingRate=0.8)
    if weight:
        gbt = gbt.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), gbt])


def linear(features: list[str], weight: str | None = None, penalty: float = 0.001) -> Pipeline:
    """Logistic model on inputs standardised with the training rows' means and deviations."""
    model = LogisticRegression(featuresCol="scaled", labelCol="label", regParam=penalty, standardization=False, maxIter=50)
    if weight:
        model = model.setWeightCol(weight)
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"),
            StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
            model,
        ]
    )


KINDS: dict[str, Callable[..., Pipeline]] = {"trees": trees, "linear": linear}


def registry(windows: list[str], features: list[str]) -> dict[str, tuple[str, list[str]]]:
    """Model name -> (kind, inputs)."""
    return {"trees_rain_only": ("trees", windows), "trees_all": ("trees", features), "linear_all": ("linear", features)}


def balance(train: DataFrame, label: str = "label") -> DataFrame:
    """Adds class_weight: positives weigh as much in total as negatives."""
    n = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    ratio = float(n.get(0, 0)) / max(1, n.get(1, 0))
    return train.withColumn("class_weight", F.when(F.col(label) == 1, ratio).otherwise(1.0))


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds prob; the model's other columns are dropped."""
    out = model.transform(df).withColumn("prob", vector_to_array("probability")[1])
    return out.select(*df.columns, "prob")


def fit_predict(kind: str, features: list[str], train: DataFrame, test: DataFrame, weight: str | None = None, **options) -> DataFrame:
    if kind == "linear" and weight is None:
        train, weight = balance(train), "class_weight"
    return score(KINDS[kind](features, weight, **options).fit(train), test)


def out_of_fold(df: DataFrame, features: list[str], kind: str, fold: str = "fold", weight: str | None = None, **options) -> DataFrame:
    """Every row scored by a model that did not see its fold. Folds whose training side has one class are skipped."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    out = None
    for k in folds:
        train = df.filter(F.col(fold) != k)
        if train.agg(F.count_distinct("label")).first()[0] < 2:
            continue
        part = fit_predict(kind, features, train, df.filter(F.col(fold) == k), weight, **options)
        out = part if out is None else out.unionByName(part)
    return out


def grouped_report(df: DataFrame, features: list[str], group: str, kind: str = "trees", k: int = 5, **options) -> DataFrame:
    """Held-out scores with whole groups per fold: ROC AUC, average precision and the classifier report."""
    folded = stage(balanced_folds(group_weights(df, group), group, k), "folds")
    scored = stage(out_of_fold(folded, features, kind, weight="weight" if kind == "trees" else None, **options), "scored")
    auc = roc_auc(scored, "prob", "label").select("auc")
    ap = average_precision(scored, "prob", "label")
    report = classifier_report(scored, "prob", "label")
    return report.join(auc, F.lit(True)).join(ap, F.lit(True))  # three one-row tables


def leave_one_year_out(
    df: DataFrame, features: list[str], kind: str, row_id: str, year: str = "year", inner: int = 5, **options
) -> DataFrame:
    """Held-out score and flags per year; each cut comes from out-of-fold dry scores of the other years.

    Columns: row_id, year, label, prob, flag_<level>.
    """
    years = sorted(r[0] for r in df.select(year).distinct().collect())
    out = None
    for y in years:
        train, test = df.filter(F.col(year) != y), df.filter(F.col(year) == y)
        held = fit_predict(kind, features, train, test, **options)
        oof = out_of_fold(interleaved_folds(train, year, inner), features, kind, **options)
        dry = stage(oof.filter("label = 0").select("prob"), "oof")
        cuts = {r["p"]: r["quantile"] for r in exact_quantiles(dry, [], "prob", [1 - t for t in TARGETS.values()]).collect()}
        flags = [(F.col("prob") > cuts[1 - t]).alias(f"flag_{level}") for level, t in TARGETS.items()]
        part = held.select(row_id, year, "label", "prob", *flags)
        out = part if out is None else out.unionByName(part)
    return out


def search(df: DataFrame, features: list[str], fold: str, weight: str | None = None, parallelism: int = 2) -> tuple[dict, float]:
    """Best tree depth and rounds by ROC AUC on given folds (0 .. k-1)."""
    pipeline = trees(features, weight)
    gbt = pipeline.getStages()[-1]
    grid = ParamGridBuilder().addGrid(gbt.maxDepth, [2, 4]).addGrid(gbt.maxIter, [10, 20]).build()
    folds = df.select(fold).distinct().count()
    cv = CrossValidator(
        estimator=pipeline, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=folds, foldCol=fold, parallelism=parallelism
    ).fit(df)
    best = max(range(len(grid)), key=lambda i: cv.avgMetrics[i])
    return {p.name: v for p, v in grid[best].items()}, cv.avgMetrics[best]


def importance_shares(model: PipelineModel, features: list[str], k: int = 10) -> DataFrame:
    """The k most important inputs with their shares (one row per input)."""
    values = model.stages[-1].featureImportances.toArray()
    total = float(values.sum()) or 1.0
    ranked = sorted(zip(features, (float(x) / total for x in values)), key=lambda p: -p[1])[:k]
    return SparkSession.getActiveSession().createDataFrame(ranked, "feature string, share double")


def split_auc(df: DataFrame, features: list[str], group: str, kind: str, seed: int, by_row: bool = False, **options) -> float:
    """Held-out AUC of one 80/20 split, by whole groups or (for contrast) by rows."""
    if by_row:
        train, test = df.randomSplit([0.8, 0.2], seed)
    else:
        halves = split_groups(df, group, seed)
        train, test = halves.filter("NOT held_out"), halves.filter("held_out")
    return roc_auc(fit_predict(kind, features, train, test, **options), "prob", "label").first()["auc"]


def leakage_gap(df: DataFrame, features: list[str], group: str, kind: str = "linear", seed: int = SEED) -> tuple[float, float]:
    """(AUC by group, AUC by row minus AUC by group)."""
    honest = split_auc(df, features, group, kind, seed)
    return honest, split_auc(df, features, group, kind, seed, by_row=True) - honest


def split_stability(df: DataFrame, features: list[str], group: str, kind: str = "linear", seeds: int = 25) -> DataFrame:
    """Mean, spread and range of the held-out AUC over seeds."""
    aucs = [(s, split_auc(df, features, group, kind, s)) for s in range(seeds)]
    return score_spread(df.sparkSession.createDataFrame(aucs, "seed int, auc double"), "auc")


def ablation(df: DataFrame, variants: dict[str, list[str]], group: str, kind: str = "linear", k: int = 5) -> DataFrame:
    """Grouped held-out AUC per feature list."""
    folded = stage(balanced_folds(df, group, k), "folds")
    rows = []
    for name, features in variants.items():
        scored = out_of_fold(folded, features, kind)
        rows.append((name, len(features), roc_auc(scored, "prob", "label").first()["auc"]))
    return df.sparkSession.createDataFrame(rows, "variant string, n_features int, auc double")


def compare(scored: dict[str, DataFrame], rule: str, flag: str = "flag_critical", draws: int = 1000) -> DataFrame:
    """One row per method: contingency scores, AUC, and the bootstrap interval of POD against the rule.

    ``scored``: method -> row_id, label, prob and the flag; row ids match between methods.
    """
    from ridgewater.operators.verify import pod_difference_interval, verdict

    base = scored[rule].select("row_id", F.col(flag).alias("_rule"))
    out = None
    for name, df in scored.items():
        row = confusion(df, flag, "label").join(roc_auc(df, "prob", "label").select("auc"), F.lit(True))
        both = df.select("row_id", "label", F.col(flag).alias("_model")).join(base, "row_id")
        interval = pod_difference_interval(both, "_model", "_rule", "label", draws)
        row = row.join(interval, F.lit(True)).select(F.lit(name).alias("method"), "*")  # one-row tables
        out = row if out is None else out.unionByName(row)
    return out.withColumn("verdict", verdict(F.col("diff"), F.col("low"), F.col("high")))


def event_validation(events: DataFrame, backgrounds: dict[str, DataFrame], column: str, cuts: list[str], least: int = 15) -> DataFrame:
    """Event against background per accuracy cut and background kind: AUC, p value, medians and counts.

    ``events``: accuracy and the column; cuts with fewer than ``least`` events are left out.
    """
    from ridgewater.functions.text import accuracy_within

    out = None
    for cut in cuts:
        kept = events.filter(accuracy_within(F.col("accuracy"), cut)).select(F.col(column).alias("x"), F.lit(1).alias("label"))
        for kind, table in backgrounds.items():
            both = kept.unionByName(table.select(F.col(column).alias("x"), F.lit(0).alias("label"))).filter("x IS NOT NULL")
            both = stage(both, "validation")
            medians = exact_quantiles(both, ["label"], "x", [0.5]).agg(
                F.max(F.when(F.col("label") == 1, F.col("quantile"))).alias("median_event"),
                F.max(F.when(F.col("label") == 0, F.col("quantile"))).alias("median_background"),
            )
            row = roc_auc(both, "x", "label").join(medians, F.lit(True))
            row = row.filter(F.col("n_pos") >= least).select(F.lit(cut).alias("cut"), F.lit(kind).alias("background"), "*")
            out = row if out is None else out.unionByName(row)
    return out
