"""Two-level classifier on Spark ML: training, search, scoring, persistence."""

from __future__ import annotations

import json
import random
from collections import Counter
from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilflow import lookups as L
from vigilflow.functions.features import align_features, engineer
from vigilflow.functions.lookup import class_group, lookup
from vigilflow.operators import metrics, scoring
from vigilflow.operators.harmonise import class_codes
from vigilflow.operators.sampling import balance_classes, stratified_split
from vigilflow.session import cut_lineage

VECTOR = "_vector"
SMALLEST_GROUP = 100
# Search space of the forest; drawn at random, seeded.
SEARCH = {"numTrees": [20, 40, 80], "maxDepth": [6, 8, 10, 12], "subsamplingRate": [0.7, 0.85, 1.0], "minInstancesPerNode": [1, 5, 10]}


@dataclass
class FlowClassifier:
    """Scaler, level-1 model and one level-2 model per larger group."""

    features: list[str]
    scaler: dict[str, tuple[float, float]]
    level1: RandomForestClassificationModel
    groups: list[str]
    level2: dict[str, RandomForestClassificationModel] = field(default_factory=dict)
    ranks: dict[str, int] = field(default_factory=dict)
    name: str = "Hierarchical 11-class"

    def vectors(self, df: DataFrame) -> DataFrame:
        """Engineered, aligned and scaled features of raw flow rows."""
        carried = tuple(c for c in df.columns if c not in self.features)
        base = engineer(df)
        ready = scoring.scale(align_features(base, self.features, tuple(f"`{c}`" for c in carried)), self.scaler)
        return VectorAssembler(inputCols=self.features, outputCol=VECTOR).transform(ready)

    def _level1(self, df: DataFrame) -> DataFrame:
        names = F.array(*[F.lit(g) for g in self.groups])
        scored = self.level1.transform(df).drop("rawPrediction", "probability")
        return scored.withColumn("group_pred", names[F.col("prediction").cast("int")]).drop("prediction")

    def _level2(self, group: str):
        classes = sorted(L.GROUP_MEMBERS[group])
        names = F.array(*[F.lit(c) for c in classes])

        code, chances = f"_code_{group}", f"_chances_{group}"

        def score(df: DataFrame):
            scored = self.level2[group].transform(df).drop("rawPrediction")
            scored = scored.withColumnsRenamed({"prediction": code, "probability": chances})
            return scored, names[F.col(f"`{code}`").cast("int")], scoring.probability_map(F.col(f"`{chances}`"), classes)

        return score

    def transform(self, df: DataFrame) -> DataFrame:
        """Append group, class, probabilities and top features to raw flow rows."""
        routed = scoring.hierarchical(self.vectors(df), self._level1, {g: self._level2(g) for g in self.level2})
        best = scoring.top_features(self.features, self.ranks)
        return routed.withColumn("top_features", best).drop(VECTOR)

    def save(self, path: str) -> None:
        self.level1.write().overwrite().save(f"{path}/level1")
        for group, model in self.level2.items():
            model.write().overwrite().save(f"{path}/level2/{group}")
        text = json.dumps(
            {"features": self.features, "scaler": self.scaler, "groups": self.groups, "level2": sorted(self.level2),
             "ranks": self.ranks, "name": self.name}
        )
        spark = SparkSession.active()
        spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(f"{path}/config")

    @classmethod
    def load(cls, path: str) -> FlowClassifier:
        config = json.loads(SparkSession.active().read.text(f"{path}/config").first()["value"])
        read = RandomForestClassificationModel.load
        return cls(
            config["features"], {k: tuple(v) for k, v in config["scaler"].items()}, read(f"{path}/level1"), config["groups"],
            {g: read(f"{path}/level2/{g}") for g in config["level2"]}, config["ranks"], config["name"],
        )


def search_space(trials: int, seed: int) -> list[dict]:
    """Random parameter sets without repeats."""
    rng, seen = random.Random(seed), []
    while len(seen) < trials:
        params = {name: rng.choice(values) for name, values in SEARCH.items()}
        if params not in seen:
            seen.append(params)
    return seen


def macro_f1(scored: DataFrame, truth: str, pred: str) -> float:
    """Mean F1 over the classes on either side.

    One distributed count; its table (classes² rows) is small enough for the driver.
    """
    cells = [(r["truth"], r["pred"], r["n"]) for r in metrics.confusion(scored, truth, pred).collect()]
    support, predicted, hits = Counter(), Counter(), Counter()
    for real, said, n in cells:
        support[real] += n
        predicted[said] += n
        hits[real] += n if real == said else 0
    classes = support.keys() | predicted.keys()
    return sum(2 * hits[c] / (support[c] + predicted[c]) for c in classes) / max(len(classes), 1)


def _without_summary(model: RandomForestClassificationModel) -> RandomForestClassificationModel:
    """Drop the training summary of a model.

    The summary of a two-class forest holds the session, which cannot be shipped to
    tasks once the session has observed metrics.
    """
    model._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model


def fit_best(
    train: DataFrame, validation: DataFrame, label: str, trials: list[dict], seed: int
) -> tuple[RandomForestClassificationModel, list[dict]]:
    """Forest with the best macro-F1 on the validation rows, and all trials."""
    forest = RandomForestClassifier(labelCol=label, featuresCol=VECTOR, seed=seed)
    maps = [{getattr(forest, k): v for k, v in params.items()} for params in trials]
    models = {i: _without_summary(model) for i, model in forest.fitMultiple(train, maps)}
    log = [
        {**trials[i], "trial": i, "f1_macro": macro_f1(models[i].transform(validation), label, "prediction")}
        for i in sorted(models)
    ]
    best = max(log, key=lambda entry: (entry["f1_macro"], -entry["trial"]))
    return models[best["trial"]], log


def train_classifier(
    df: DataFrame,
    features: list[str],
    key: list[str],
    trials: int = 30,
    seed: int = 42,
    largest: int = 100_000,
    smallest: int = 200,
    space: list[dict] | None = None,
) -> tuple[FlowClassifier, DataFrame, list[dict]]:
    """Balance, engineer, scale, split, search and fit both levels.

    Returns the model, the untouched test rows and the trial log.  Balancing bounds
    the training set (classes * ``largest``), whatever the size of ``df``.
    """
    spark = df.sparkSession
    space = space or search_space(trials, seed)
    base = [c for c in features if c not in L.ENGINEERED_FEATURES]
    names = [*base, *L.ENGINEERED_FEATURES]
    balanced = balance_classes(df, "Label", key, largest, smallest, seed, class_bound=len(L.TARGET_CLASSES))
    engineered = engineer(cut_lineage(spark, balanced))
    split = stratified_split(engineered, "Label", [*key, "copy"], seed, class_bound=len(L.TARGET_CLASSES))
    rows = cut_lineage(spark, split)
    scaler = scoring.fit_scaler(rows, names)
    groups = sorted(L.GROUP_MEMBERS)
    ready = VectorAssembler(inputCols=names, outputCol=VECTOR).transform(
        scoring.scale(align_features(rows, names, ("Label", "split")), scaler)
    ).select("Label", "split", VECTOR)
    ready = ready.withColumn("_group", lookup(class_group("Label"), class_codes(groups)).cast("double"))
    # Every trial of every model reads these vectors, so they are stored once.
    ready = cut_lineage(spark, ready)
    train, validation = (ready.filter(F.col("split") == s) for s in ("train", "validation"))
    level1, log = fit_best(train, validation, "_group", space, seed)
    trial_log = [{"model": "level1", **entry} for entry in log]
    level2 = {}
    for group, members in L.GROUP_MEMBERS.items():
        if len(members) < 2:
            continue
        codes = class_codes(members)
        own = [
            part.filter(F.col("Label").isin(members)).withColumn("_class", lookup("Label", codes).cast("double"))
            for part in (train, validation)
        ]
        if own[0].limit(SMALLEST_GROUP).count() < SMALLEST_GROUP:
            continue
        level2[group], log = fit_best(*own, "_class", space, seed)
        trial_log += [{"model": group, **entry} for entry in log]
    importance = sorted(zip(level1.featureImportances.toArray(), names), key=lambda p: (-p[0], p[1]))
    ranks = {name: i + 1 for i, (_, name) in enumerate(importance)}
    model = FlowClassifier(names, scaler, level1, groups, level2, ranks)
    return model, rows.filter("split = 'test'").drop("split"), trial_log
