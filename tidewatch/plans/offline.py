"""Recorded traffic to the entropy regression and the base classifier."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import Profile
from tidewatch.operators import evaluate, learning, models, volumetric
from tidewatch.operators.ordering import number_rows
from tidewatch.operators.volumetric import EntropyModel
from tidewatch.sources import files


def numbered_recording(
    raw: DataFrame, names: Mapping[str, Sequence[str]] = files.LIVE_NAMES
) -> DataFrame:
    """Rows of CSV recordings with their features and their position in the file."""
    picked = files.feature_columns(raw, names)
    kept = [c for c in ("file", "split_start", "split_row", "label") if c in raw.columns]
    rows = raw.select(*kept, *[c.alias(n) for n, c in picked.items()])
    return number_rows(rows, ["file"], [F.col("split_start"), F.col("split_row")])


def train_regression(
    raw: DataFrame, p: Profile, names: Mapping[str, Sequence[str]] = files.LIVE_NAMES
) -> tuple[EntropyModel, DataFrame]:
    """Fits the entropy regression on a benign recording: model and training statistics."""
    rows = volumetric.replace_infinite(numbered_recording(raw, names), volumetric.SERIES)
    entropies = volumetric.tumbling_entropy(rows, ["file"], p.offline_rows, p.renyi_alpha)
    identity = F.concat_ws("-", "file", "w")
    model = models.fit_entropy_model(entropies, identity)
    train = entropies.filter(~learning.in_test_split(identity))
    return model, models.training_stats(models.regression_rows(train, model), rows)


def feature_dataset(
    raw: DataFrame,
    p: Profile,
    model: EntropyModel,
    names: Mapping[str, Sequence[str]] = files.LIVE_NAMES,
) -> DataFrame:
    """Labelled feature rows of labelled recordings."""
    return volumetric.offline_features(
        numbered_recording(raw, names), ["file"], p.offline_rows, model, F.col("label")
    )


def train_base_classifier(
    dataset: DataFrame, identity: Column, iterations: int = 500
) -> tuple[models.Classifier, DataFrame]:
    """Fits on 80% and returns the classifier with the scored held-out rows."""
    split = dataset.withColumn("_held_out", learning.in_test_split(identity))
    train = split.filter(~F.col("_held_out")).drop("_held_out")
    test = split.filter("_held_out").drop("_held_out")
    classifier = models.fit_classifier(train, models.BASE_LAYERS, iterations)
    return classifier, classifier.score(test)


def hold_out_quality(scored: DataFrame) -> dict[str, DataFrame]:
    """Class report, confusion, ROC area and average precision of held-out rows."""
    curve = evaluate.score_curve(scored, "probability", "label")
    return {
        "report": evaluate.class_report(scored, "label", "prediction"),
        "confusion": evaluate.confusion_metrics(scored, (), "label", "prediction"),
        "auc": evaluate.roc_auc(curve),
        "average_precision": evaluate.average_precision(curve),
    }


def check_batch(
    numbered: DataFrame,
    keys: Sequence[str],
    batch: DataFrame,
    p: Profile,
    model: EntropyModel,
    mean_train: float,
    sigma_train: float,
    rate: float = 0.01,
) -> DataFrame:
    """Two-step check of a batch: mean stability first, then entropy residuals.

    Returns the anomalous windows; none when the first step finds the batch stable.
    """
    flags = volumetric.stability_flags(numbered, keys, p.offline_rows, batch)
    unstable = volumetric.any_violation(
        flags, [f"unstable_{c}" for c in volumetric.SERIES]
    ).scalar()
    residuals = volumetric.tumbling_residuals(
        numbered, keys, p.offline_rows, model, p.renyi_alpha
    )
    flagged = volumetric.residual_anomalies(residuals, mean_train, sigma_train, rate)
    return flagged.filter(F.col("anomalous") & unstable)
