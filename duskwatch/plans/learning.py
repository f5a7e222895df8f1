"""Trained scorers over the feature vectors of the security-event view (rows-only checks)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from duskwatch.functions import features as FE
from duskwatch.functions import scoring as S
from duskwatch.functions.plan import pin
from duskwatch.operators import ml as M
from duskwatch.plans.base import Suite, sec_events
from duskwatch.plans.behaviour import _vector_inputs

SUITE = Suite()

#: Rows of a task of a forest's fit aimed at.
FIT_ROWS = 500_000


def labelled(spark, sf_dir, parts: int | None = None):
    """Event id, time, class and the 76 features (stateless blocks filled), made in ``parts`` parts if given."""
    # a filter on the class is pushed down as a copy of its thirteen cases, each of which would parse the text again
    ev = pin(_vector_inputs(sec_events(spark, sf_dir, parts)), "label", F.col("ensemble_label"))
    return FE.with_features76(ev).select("event_id", "tenant_id", "timestamp", "label", "features")


@SUITE.query("score_classifier")
def _(spark, sf_dir):
    data = labelled(spark, sf_dir)
    model = M.train_classifier(data, trees=20, depth=8)
    return M.score_classifier(model, data).select("event_id", "label", "predicted", "ensemble_score")


@SUITE.query("train_classifier")
def _(spark, sf_dir):
    data = labelled(spark, sf_dir)
    # a fit has as many tasks as its input has parts, and a small file is one: events are dealt out to all cores
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(sec_events(spark, sf_dir).count() / FIT_ROWS))
    model = M.train_classifier(labelled(spark, sf_dir, tasks))
    top = S.top_features(F.col("features"), M.importances(model))
    return data.select("event_id", F.explode(top).alias("t")).select("event_id", "t.name", "t.weight")


@SUITE.query("reconstruction_anomaly")
def _(spark, sf_dir):
    data = labelled(spark, sf_dir).withColumn("features", FE.dna128(F.col("features")))
    model = M.fit_reconstruction(data.where("label = 'benign'"))
    return M.reconstruction_anomaly(model, data).select("event_id", F.round("vae_anomaly_score", 6).alias("vae_anomaly_score"))


@SUITE.query("halfspace_anomaly")
def _(spark, sf_dir):
    data = labelled(spark, sf_dir)
    low, high = M.feature_ranges(data)
    return M.halfspace_anomaly(data, low, high).select("event_id", F.round("hst_anomaly_score", 6).alias("hst_anomaly_score"))
