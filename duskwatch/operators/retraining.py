"""Retraining from analyst verdicts: fit on the older part, compare on the newer, keep the better model.

A tenant's buffer is split by time. The new model is fitted on the first part; the F1 of the new and of
the model in use are taken on the rest. The new one is saved and becomes current unless it is clearly worse. Every attempt
leaves a version row.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.operators import ml
from duskwatch.operators.evaluation import class_metrics, time_split, weighted_metrics
from duskwatch.session import ensure_checkpoint_dir
from duskwatch.sources.current import CurrentTable

ATTACK, BENIGN = "attack", "benign"
VERSION_ROW = (
    "tenant_id string, version bigint, buffered bigint, valid bigint, train_rows bigint, holdout_rows bigint, old_f1 double, new_f1 double, "
    "decision string"
)


@dataclass
class ModelStore:
    """Saved models and version rows below ``path``. The current model of a tenant is that of its last version with decision swap."""

    spark: SparkSession
    path: str

    @property
    def rows(self) -> CurrentTable:
        return CurrentTable(self.spark, f"{self.path}/versions", VERSION_ROW, ["tenant_id", "version"], ["version"], 4)

    def versions(self) -> DataFrame:
        return self.rows.read()

    def model_path(self, tenant: str | None, version: int) -> str:
        name = hashlib.md5(f"{tenant is None}|{tenant}".encode()).hexdigest()
        return f"{self.path}/models/tenant={name}/version={version}"

    def current(self, tenant: str | None) -> PipelineModel | None:
        mine = self.versions().where(F.col("tenant_id").eqNullSafe(F.lit(tenant)) & (F.col("decision") == "swap"))
        version = mine.agg(F.max("version")).first()[0]
        return None if version is None else PipelineModel.load(self.model_path(tenant, version))


def weighted_f1(model: PipelineModel | None, rows: DataFrame) -> float:
    """Weighted F1 of attack against benign; no model scores 0."""
    if model is None:
        return 0.0
    guess = F.when(F.col("predicted") == BENIGN, BENIGN).otherwise(ATTACK)
    scored = ml.score_classifier(model, rows).select("label", guess.alias("prediction"))
    return float(weighted_metrics(class_metrics(scored)).first()["weighted_f1"] or 0.0)


def retrain(
    store: ModelStore, buffer: DataFrame, tenant: str | None, version: int, min_rows: int = 100, min_valid: int = 50, slack: float = 0.05,
    train_share: float = 0.8, trees: int = 200, depth: int = 12, max_rows: int = 2_000_000,
) -> dict:
    """One attempt for one tenant, as the version row that was not yet recorded.

    ``buffer`` holds tenant_id, id, created_at, label (true_positive is an attack, any other verdict benign) and features
    (array<double>). Rows without label or features are counted and left out. Decisions: skip_few_rows, skip_few_valid, skip_one_class,
    keep (the new model is worse by more than ``slack``), swap.
    """
    ensure_checkpoint_dir(store.spark)
    mine = buffer.where(F.col("tenant_id").eqNullSafe(F.lit(tenant)))
    usable = F.col("label").isNotNull() & F.col("features").isNotNull() & (F.size("features") > 0)
    buffered, valid = mine.agg(F.count("*"), F.count_if(usable)).first()
    row = {"tenant_id": tenant, "version": version, "buffered": buffered, "valid": valid, "train_rows": 0, "holdout_rows": 0, "old_f1": None, "new_f1": None}
    if buffered < min_rows or valid < min_valid:
        return row | {"decision": "skip_few_rows" if buffered < min_rows else "skip_few_valid"}
    labelled = mine.where(usable).select("tenant_id", "id", "created_at", F.when(F.col("label") == "true_positive", ATTACK).otherwise(BENIGN).alias("label"), "features")
    # the split is cut from a checkpoint already; this one keeps what two fits and two scores read
    parts = time_split(labelled, train_share, max_rows).checkpoint()
    train, holdout = (parts.where(F.col("part") == p).select("label", "features") for p in ("train", "holdout"))
    row |= {"train_rows": train.count(), "holdout_rows": holdout.count()}
    if train.select("label").distinct().limit(2).count() < 2:
        return row | {"decision": "skip_one_class"}
    new = ml.train_classifier(train, trees, depth)
    row |= {"old_f1": weighted_f1(store.current(tenant), holdout), "new_f1": weighted_f1(new, holdout)}
    if row["new_f1"] < row["old_f1"] - slack:
        return row | {"decision": "keep"}
    new.write().overwrite().save(store.model_path(tenant, version))
    return row | {"decision": "swap"}


def retrain_gate(store: ModelStore, buffer: DataFrame, version: int, **options) -> DataFrame:
    """An attempt for every tenant of the buffer, recorded under ``version``; gives the version rows.

    Tenants are taken one after the other: each fit uses the whole cluster. A repeated run of one version replaces its rows.
    """
    tenants = [r[0] for r in buffer.select("tenant_id").distinct().collect()]
    rows = [retrain(store, buffer, t, version, **options) for t in sorted(tenants, key=lambda t: (t is not None, t))]
    found = store.spark.createDataFrame([tuple(r[c.split()[0]] for c in VERSION_ROW.split(", ")) for r in rows], VERSION_ROW)
    store.rows.merge(found, version)
    return store.versions().where(F.col("version") == version)
