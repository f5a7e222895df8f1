"""Trained scorers on pyspark.ml: classifier, reconstruction error, half-space mass."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, PCAModel, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions.plan import pin
from duskwatch.functions.scoring import bind
from duskwatch.operators.segments import MAX_ROWS_PER_KEY, segmented

# Attack classes, and the classes whose rows weigh three times as much.
ATTACK_CLASSES = [
    "benign", "dos", "ddos", "brute_force", "web_attack", "infiltration", "botnet", "port_scan", "sql_injection", "fuzzers",
    "backdoors", "exploits", "reconnaissance",
]
HEAVY_CLASSES = ["sql_injection", "infiltration", "exploits", "ddos"]


def train_classifier(
    df: DataFrame, trees: int = 100, depth: int = 12, boosted: bool = False, seed: int = 42
) -> PipelineModel:
    """Fit on (features array, label). Trees are grown level by level over the cluster by Spark ML."""
    ready = df.select(
        "label", array_to_vector("features").alias("vec"),
        F.when(F.col("label").isin(HEAVY_CLASSES), 3.0).otherwise(1.0).alias("weight"),
    )
    index = StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc")
    if boosted:
        base = GBTClassifier(maxIter=20, maxDepth=5, seed=seed, weightCol="weight", featuresCol="vec", labelCol="target")
        model = OneVsRest(classifier=base, featuresCol="vec", labelCol="target", weightCol="weight")
    else:
        model = RandomForestClassifier(
            numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight", featuresCol="vec", labelCol="target"
        )
    return Pipeline(stages=[index, model]).fit(ready)


def score_classifier(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add score (1 - P(benign), 4 dp), predicted label and the class probabilities."""
    labels = model.stages[0].labels
    out = model.stages[1].transform(df.withColumn("vec", array_to_vector("features")))
    probs = vector_to_array("probability")
    names = F.array(*[F.lit(x) for x in labels])
    by_class = F.map_from_arrays(names, probs)
    benign = by_class["benign"] if "benign" in labels else F.lit(0.0)
    return out.withColumns(
        {
            "probabilities": by_class,
            "ensemble_score": F.round(1 - F.coalesce(benign, F.lit(0.0)), 4),
            "predicted": F.get(names, F.col("prediction").cast("int")),
        }
    ).drop("vec", "rawPrediction", "probability", "prediction")


def importances(model: PipelineModel) -> list[float]:
    return [float(x) for x in model.stages[1].featureImportances.toArray()]


def clamped(features: str, limit: float = 100.0) -> Column:
    return F.transform(features, lambda x: F.least(F.greatest(x, F.lit(-limit)), F.lit(limit)))


def fit_reconstruction(benign: DataFrame, k: int = 16) -> PCAModel:
    """Principal components of benign vectors; the covariance is summed by tree aggregation."""
    return PCA(k=k, inputCol="vec", outputCol="proj").fit(benign.select(array_to_vector(clamped("features")).alias("vec")))


def reconstruction_anomaly(model: PCAModel, df: DataFrame, limit: float = 100.0) -> DataFrame:
    """Mean squared error of projecting on the components, over .5 and capped; NaN counts as 1.

    The components are orthonormal, so the squared error is |x|² minus |projection|². Entries are clamped as for the fit: null
    counts as the lower limit, NaN as the upper. A batch of rows is projected at once.
    """
    axes = model.pc.toArray()

    @F.arrow_udf("double")
    def squared_error(vectors: pa.Array) -> pa.Array:
        given = vectors.is_valid().to_numpy(zero_copy_only=False)
        x = vectors.drop_null().flatten().fill_null(-limit).to_numpy(zero_copy_only=False).reshape(-1, len(axes))
        x = np.where(np.isnan(x), limit, np.clip(x, -limit, limit))
        out = np.zeros(len(vectors))
        out[given] = ((x * x).sum(axis=1) - ((x @ axes) ** 2).sum(axis=1)) / len(axes)
        return pa.array(out, mask=~given)

    out = pin(df, "_error", squared_error(F.col("features").cast("array<double>")))
    score = F.least(F.greatest(F.col("_error"), F.lit(0.0)) / 0.5, F.lit(1.0))
    return out.withColumn("vae_anomaly_score", F.when(F.isnan("_error"), 1.0).otherwise(score)).drop("_error")


def halfspace_leaves(features: Column, low: list[float], high: list[float], trees: int = 25, height: int = 8, seed: int = 42) -> Column:
    """Leaf number per tree. Level by level a tree halves the range of a randomly drawn dimension.

    Drawing the same dimension again halves its remaining range, so a path bit is one binary digit of
    the scaled value. Each tree shifts the ranges a little, so trees cut at different places. The
    draws are literal arrays walked by lambdas, which keeps the plan small.
    """
    rng = random.Random(seed)
    dims = [i for i, (a, b) in enumerate(zip(low, high)) if b > a]
    cuts = []
    for _ in range(trees):
        shift = rng.random() * 0.5
        used: dict[int, int] = {}
        for _ in range(height):
            d = rng.choice(dims)
            used[d] = used.get(d, 0) + 1
            width = (high[d] - low[d]) * 1.5
            cuts.append((d, low[d], width, shift / 1.5, float(2 ** used[d])))
    table = F.array(
        *[
            F.struct(F.lit(d).alias("d"), F.lit(lo).alias("lo"), F.lit(w).alias("w"), F.lit(sh).alias("s"), F.lit(m).alias("m"))
            for d, lo, w, sh, m in cuts
        ]
    )

    def leaf(f: Column, t: Column) -> Column:
        def bit(acc: Column, c: Column) -> Column:
            unit = F.least(F.greatest((F.get(f, c["d"]) - c["lo"]) / c["w"] + c["s"], F.lit(0.0)), F.lit(0.999999))
            return acc * 2 + (F.floor(unit * c["m"]) % 2).cast("int")

        return F.aggregate(F.slice(table, t * height + 1, F.lit(height)), F.lit(0), bit)

    return bind(features, lambda f: F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: leaf(f, t)))


def window_numbers(df: DataFrame, size: int, max_rows: int = MAX_ROWS_PER_KEY) -> DataFrame:
    """Add ``_w``: which run of ``size`` events of its tenant, in order of time and id, a row belongs to."""
    seg = segmented(df.withColumn("_us", F.unix_micros("timestamp")), ["tenant_id"], ["_us", "event_id"], max_rows).running(sums={"_pos": F.lit(1)})
    return seg.rows.withColumn("_w", F.floor((F.col("_pos") - 1) / size)).drop("_us", "_pos")


def halfspace_anomaly(
    df: DataFrame, low: list[float], high: list[float], window: int = 1000, trees: int = 25, height: int = 8, seed: int = 42,
    cold_start: int = 500, max_rows: int = MAX_ROWS_PER_KEY,
) -> DataFrame:
    """Rarity of an event's leaves among the ``window`` events of its tenant before its own window: score first, learn later.

    A window of events meets the leaves of the one before it in one task; both hold at most ``window`` rows, so a busy tenant
    is as many groups as it has windows. The first window scores 0, a short one before is damped.
    """
    size = 2**height
    leaves = window_numbers(df, window, max_rows).withColumn("_leaves", halfspace_leaves(F.col("features"), low, high, trees, height, seed))
    key = F.coalesce("tenant_id", F.lit("")).alias("_t"), F.col("tenant_id").isNull().alias("_none")
    own = leaves.select(*key, "_w", "_leaves", "event_id", F.unix_micros("timestamp").alias("_us"))
    before = own.select(F.col("_t").alias("_t1"), F.col("_none").alias("_none1"), (F.col("_w") + 1).alias("_w1"), F.col("_leaves").alias("_past"))

    def score(now: pa.Table, past: pa.Table) -> pa.Table:
        at = lambda t, c: t[c].combine_chunks().flatten().to_numpy().reshape(-1, trees) + np.arange(trees) * size
        seen = past.num_rows
        value = np.zeros(now.num_rows)
        if now.num_rows and seen:
            mass = np.bincount(at(past, "_past").ravel(), minlength=trees * size)
            value = (1.0 / (1.0 + mass[at(now, "_leaves")] * size / seen / 8.0)).mean(axis=1) * min(seen / cold_start, 1.0)
        return pa.table({"event_id": now["event_id"], "_us": now["_us"], "_t": now["_t"], "_none": now["_none"], "hst_anomaly_score": value})

    kind = df.schema["event_id"].dataType.simpleString()
    keys = ["_t", "_none", "_w"]
    scored = own.groupBy(*keys).cogroup(before.groupBy("_t1", "_none1", "_w1")).applyInArrow(score, f"event_id {kind}, _us long, _t string, _none boolean, hst_anomaly_score double")
    # rows equal in tenant, time and id have one score
    scored = scored.groupBy("event_id", "_us", "_t", "_none").agg(F.max("hst_anomaly_score").alias("hst_anomaly_score"))
    keyed = df.withColumns({"_t": key[0], "_none": key[1], "_us": F.unix_micros("timestamp")})
    return keyed.join(scored, ["event_id", "_us", "_t", "_none"], "left").select(*df.columns, "hst_anomaly_score")


def feature_ranges(df: DataFrame) -> tuple[list[float], list[float]]:
    """Minimum and maximum per dimension: one vector aggregate, one row."""
    row = df.select(Summarizer.metrics("min", "max").summary(array_to_vector("features")).alias("s")).select("s.*").first()
    return [float(x) for x in row["min"]], [float(x) for x in row["max"]]
