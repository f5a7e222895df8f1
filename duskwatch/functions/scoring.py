"""Scores as Column arithmetic."""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default fusion weights of the five streams.
DEFAULT_WEIGHTS = [0.55, 0.05, 0.30, 0.05, 0.05]
# Evasion band, and score by number of streams inside it.
EVASION_BAND = (0.35, 0.50)
EVASION_WARMUP = 50


def clamp01(col: Column) -> Column:
    return F.least(F.greatest(col, F.lit(0.0)), F.lit(1.0))


def clamp_scores(df, cols: Sequence[str]):
    return df.withColumns({c: clamp01(F.col(c)) for c in cols})


def stub_score(features: Column) -> Column:
    total = F.aggregate(F.slice(features, 1, 16), F.lit(0.0), lambda a, x: a + x)
    return F.least(total / 100000, F.lit(1.0))


def stub_label(score: Column) -> Column:
    return F.when(score < 0.5, "benign").otherwise("port_scan")


def meta_score(
    streams: Sequence[Column], weights: Sequence[Column | float] = tuple(DEFAULT_WEIGHTS),
    hour: Column | None = None, criticality: Column | None = None,
) -> Column:
    """Weighted sum of five streams, optional context boosts, mild amplification above 0.3."""
    if len(streams) != 5:
        raise ValueError("five stream scores are expected")
    base = None
    for s, w in zip(streams, weights):
        base = s * w if base is None else base + s * w
    if hour is not None:
        late = F.when((hour >= 22) | (hour <= 6), 0.05).otherwise(0.0)
        asset = F.lit(0.0)
        if criticality is not None:
            asset = F.when(criticality > 0.5, 0.03 * (criticality - 0.5)).otherwise(0.0)
        base = F.least(base + late + asset, F.lit(1.0))
    return clamp01(F.when(base > 0.3, F.pow(base, F.lit(0.85))).otherwise(base))


def risk_score(meta: Column, criticality: Column, stage: Column, event_count: Column) -> Column:
    base = meta * (0.5 + criticality * 0.5) + stage * 0.3
    damping = 1.0 - 1.0 / (1.0 + F.exp(-0.01 * (event_count - 500)))
    return F.least(F.greatest(base * damping * 100.0, F.lit(0.0)), F.lit(100.0))


def posture_delta(risk: Column) -> Column:
    return F.when(risk < 10.0, 0.0).otherwise(F.greatest(F.lit(-5.0), -(risk / 100.0) * 2.0))


def evasion_score(streams: Sequence[Column], events_before: Column) -> Column:
    """Streams sitting just under the decision band; silent until the warm-up has passed."""
    lo, hi = EVASION_BAND
    inside = None
    for s in streams:
        f = F.when((s >= lo) & (s <= hi), 1).otherwise(0)
        inside = f if inside is None else inside + f
    score = F.when(inside >= 3, 0.9).when(inside == 2, 0.5).otherwise(0.0)
    return F.when(events_before < EVASION_WARMUP, 0.0).otherwise(score)


def ood_score(features: Column, mean: Column | None = None, variance: float = 0.1) -> Column:
    """Mahalanobis distance under a diagonal covariance, scaled by the dimension."""
    centred = features if mean is None else F.zip_with(features, mean, lambda x, m: x - m)
    dist = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda a, x: a + x * x / variance))
    root = F.sqrt(F.size(features).cast("double"))
    return F.when(dist <= 1.5 * root, 0.0).otherwise(F.least(F.lit(1.0), (dist - 1.5 * root) / root))


def adversarial_composite(timing: Column, evasion: Column, ood: Column) -> Column:
    return F.greatest(timing, evasion, ood)


def top_features(features: Column, importances: Sequence[float], n: int = 5) -> Column:
    """Names and weights of the ``n`` features with the largest importance × |value|, to six places, equal ones by name.

    Rounding and sorting by name cost most, so they see only values that can still come among the first ``n``.
    """
    names = [
        f"{block}[{i}]"
        for block, size in (("network", 16), ("entity", 16), ("temporal", 16), ("payload", 16), ("context", 12))
        for i in range(size)
    ]
    weights = F.array(*[F.lit(float(x)) for x in importances])
    labels = F.array(*[F.lit(x) for x in names])
    weighted = F.zip_with(features, weights, lambda x, w: -(F.abs(x) * w))

    def ranked(values: Column) -> Column:
        # rounding moves a value by half a millionth at most; absent values come first, NaN last, as they sort
        bound = F.coalesce(F.get(F.sort_array(values), F.lit(n - 1)) + 2e-6, F.lit(float("nan")))
        places = F.when(values.isNotNull(), F.sequence(F.lit(0), F.greatest(F.size(values), F.lit(len(names))) - 1))
        at = lambda i: F.get(values, i)
        near = bind(bound, lambda most: F.filter(places, lambda i: at(i).isNull() | (at(i) <= most)))
        return F.sort_array(F.transform(near, lambda i: F.struct((-F.round(-at(i), 6)).alias("neg"), F.get(labels, i).alias("name"))))

    top = F.slice(bind(weighted, ranked), 1, n)
    return F.transform(top, lambda p: F.struct(p["name"].alias("name"), (-p["neg"]).alias("weight")))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use``; inside lambdas nothing else would share it."""
    return F.transform(F.array(value), use)[0]


def gap_seconds(times_us: Column) -> Column:
    later = F.slice(times_us, 2, F.greatest(F.size(times_us) - 1, F.lit(0)))
    return F.filter(F.zip_with(later, times_us, lambda b, a: (b - a) / 1e6), lambda g: g.isNotNull())


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def timing_cov(times_us: Column, min_points: int = 10, limit: float = 0.15) -> Column:
    """Regularity of the gaps between timestamps (µs): 1 at zero deviation, 0 from CoV ``limit`` up."""

    def score(gaps: Column, mean: Column) -> Column:
        var = F.aggregate(gaps, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(gaps)
        return F.when(mean == 0, 1.0).otherwise(
            bind(F.sqrt(var) / mean, lambda cov: F.when(cov < limit, F.least(F.lit(1.0), 1.0 - cov / limit)).otherwise(0.0))
        )

    scored = bind(gap_seconds(times_us), lambda gaps: bind(mean_of(gaps), lambda mean: score(gaps, mean)))
    return F.when(F.size(times_us) < min_points, 0.0).otherwise(scored)


def timing_ks(times_us: Column, min_points: int = 10, alpha: float = 0.05) -> Column:
    """Kolmogorov–Smirnov distance of the gaps from an exponential law, as a score.

    The p-value is the asymptotic series, which is close for the 9 to 29 gaps used here.
    """

    def distance(gaps: Column, mean: Column) -> Column:
        n = F.size(gaps).cast("double")
        cdf = F.transform(gaps, lambda x: 1.0 - F.exp(-x / mean))
        return F.array_max(F.transform(cdf, lambda c, i: F.greatest((i + 1) / n - c, c - i / n)))

    def p_value(scaled: Column) -> Column:
        series = F.aggregate(
            F.sequence(F.lit(1), F.lit(50)), F.lit(0.0),
            lambda a, j: a + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * scaled * scaled),
        )
        return F.when(scaled < 0.2, 1.0).otherwise(clamp01(series))

    def score(gaps: Column, mean: Column) -> Column:
        root = F.sqrt(F.size(gaps).cast("double"))
        scaled = (root + 0.12 + 0.11 / root) * distance(gaps, mean)
        judged = bind(scaled, lambda s: bind(p_value(s), lambda p: F.when(p < alpha, clamp01(1.0 - p / alpha)).otherwise(0.0)))
        return F.when(mean == 0, 1.0).otherwise(judged)

    scored = bind(F.array_sort(gap_seconds(times_us)), lambda gaps: bind(mean_of(gaps), lambda mean: score(gaps, mean)))
    return F.when(F.size(times_us) < min_points, 0.0).otherwise(scored)
