"""Isolation forest: sample, fit in parallel, score in one vectorised pass.

Growing a tree needs at most 256 rows, so the table itself is only sampled (by
hash of the row key, independent of partitioning) and scored.  The fitted model
has at most 100 x 511 nodes whatever the size of the table; it is collected and
broadcast, as a model of the ML library would be.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.expr import ident, literal, measured_columns, num, numeric, row_id
from assayer.operators.findings import as_findings
from assayer.operators.quantiles import column_moments, exact_quantiles
from assayer.session import written

# fixed values
TREES, SAMPLE, SEED = 100, 256, 42
MIN_SHARE, MIN_VALUES, FLAT = 0.7, 5, 1e-8
SCORE_LIMIT, SCORE_SIGMAS = -0.15, 3.5
EULER = 0.5772156649015329
CRITICAL_PCT, HIGH_PCT = 15.0, 5.0
HISTOGRAM_BINS = 15

_POOL = 1.3         # rows drawn, in samples of all trees together
_MARGIN = 1.25      # expected rows per tree before the cut to SAMPLE
_GRAIN = 1 << 30


def forest_features(df: DataFrame, columns: Sequence[str] | None = None,
                    extra_identifiers: Iterable[str] = ()) -> DataFrame:
    """Per numeric, non-identifier column whether it can be a feature: at least 70 %
    numeric, at least 5 numbers, not constant."""
    columns = list(columns) if columns else measured_columns(df, "forest", extra_identifiers)
    total = df.agg(F.count(F.lit(1))).scalar()
    enough = ((F.col("n") >= F.col("total_rows") * MIN_SHARE) & (F.col("n") >= MIN_VALUES)
              & (F.col("std") > FLAT))
    return (column_moments(df, columns).withColumn("total_rows", total)
            .select("column", "ordinal", F.col("n").alias("numeric_count"), "total_rows",
                    F.round("std", 4).alias("std"),
                    F.coalesce(enough, F.lit(False)).alias("is_feature")))


def forest_matrix(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(_rid, one complete double per feature): gaps take the column's median."""
    medians = exact_quantiles(df, features, {"median": 0.5})
    # one entry per column of the table
    table = medians.agg(F.map_from_entries(F.collect_list(F.struct("column", "median")))).scalar()
    base = df.select(row_id(keys).alias("_rid"), *[numeric(df, c).alias(c) for c in features])
    return base.withColumn("_m", table).select("_rid", *[
        F.expr(f"coalesce({ident(c)}, _m[{literal(c)}]) as {ident(c)}") for c in features])


def mean_depth(n):
    """Average path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype="float64")
    safe = np.maximum(n, 2.0)
    c = 2.0 * (np.log(np.maximum(safe - 1.0, 1.0)) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, c))


@dataclass(frozen=True)
class ForestModel:
    """Complete binary trees in heap layout: children of i are 2i+1 and 2i+2.  A
    leaf above the last level passes everything on to its left child."""

    features: tuple[str, ...]
    medians: tuple[float, ...]
    rows: int
    split: np.ndarray      # (trees, nodes) feature index
    at: np.ndarray         # (trees, nodes) threshold
    length: np.ndarray     # (trees, last level) path length / c(sample)
    levels: int

    def decision(self, x: np.ndarray) -> np.ndarray:
        trees, nodes = self.split.shape
        base = (np.arange(trees) * nodes)[None, :]
        split, at = self.split.ravel(), self.at.ravel()
        first_leaf = (1 << self.levels) - 1
        leaf_base = (np.arange(trees) * self.length.shape[1])[None, :]
        out = np.empty(len(x))
        for start in range(0, len(x), 2048):
            part = x[start:start + 2048]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), trees), dtype=np.int64)
            for _ in range(self.levels):
                here = node + base
                node = 2 * node + 1 + (part[rows, split[here]] >= at[here])
            depth = self.length.ravel()[node - first_leaf + leaf_base].mean(axis=1)
            out[start:start + 2048] = 0.5 - np.exp2(-depth)
        return out

    def score(self, df: DataFrame, keep: Sequence = ()) -> DataFrame:
        """keep columns, the completed features and ``score`` for every row of df."""
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf(T.DoubleType())
        def decision(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            forest = model.value
            for columns in batches:
                x = np.column_stack([c.to_numpy(dtype="float64") for c in columns])
                yield pd.Series(forest.decision(x))

        full = [F.coalesce(numeric(df, c), F.lit(m)).alias(c)
                for c, m in zip(self.features, self.medians)]
        kept = df.select(*keep, *full) if keep else df.select(*full)
        return kept.withColumn("score", decision(*[F.col(ident(c)) for c in self.features]))


def _grow(x: np.ndarray, rng: np.random.Generator, levels: int):
    """One tree over the sample x, as (split, at, length) in heap layout."""
    nodes = (1 << levels) - 1
    split, at = np.zeros(nodes, dtype=np.int64), np.full(nodes, np.inf)
    length = np.zeros(nodes + 1)
    norm = max(float(mean_depth(len(x))), 1e-12)
    todo = [(0, 0, np.arange(len(x)))]
    while todo:
        node, depth, rows = todo.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth == levels or len(rows) <= 1 or len(varying) == 0:
            value = (depth + float(mean_depth(len(rows)))) / norm
            last = node
            for _ in range(levels - depth):
                last = 2 * last + 1
            length[last - nodes] = value
            continue
        f = int(rng.choice(varying))
        cut = float(rng.uniform(low[f], high[f]))
        right = x[rows, f] >= cut
        if right.all():  # the draw hit the minimum itself
            cut = float(np.nextafter(low[f], high[f]))
            right = x[rows, f] >= cut
        split[node], at[node] = f, cut
        todo.append((2 * node + 2, depth + 1, rows[right]))
        todo.append((2 * node + 1, depth + 1, rows[~right]))
    return split, at, length


def _samples(df: DataFrame, features: Sequence[str], medians: Sequence[float], rows: int,
             keys: Sequence[str], unique_keys: bool, trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, h, w, features...): a little more than a sample of rows per tree.

    With ``unique_keys`` the pool is a filter on the hash of key and features, so the table is not
    shuffled.  Without, equal rows are counted first, on the map side, and drawn in proportion.  A drawn row goes to as many trees as it takes to fill them:
    about one in a large table, so that trees share few rows, and most of them in a small one.
    Copies of a row are dealt to trees one by one.
    """
    pool = min(1.0, _POOL * trees * sample / rows)
    each = min(float(trees), _MARGIN * trees * sample / (rows * pool))
    full = [F.coalesce(numeric(df, c), F.lit(m)).alias(f"f{i}")
            for i, (c, m) in enumerate(zip(features, medians))]
    names = [f"f{i}" for i in range(len(features))]
    base = df.select(F.xxhash64(*[F.col(ident(k)) for k in keys], *full, F.lit(seed)).alias("h"), *full)
    if unique_keys:
        drawn = base.where(F.pmod("h", F.lit(_GRAIN)) < int(pool * _GRAIN)).withColumn("w", F.lit(1))
    else:
        # of c equal rows c * pool are drawn, each with a hash of its own; no more in all than the pool
        share = F.col("c") * F.lit(pool)
        copies = F.floor(share) + F.when(F.pmod("h", F.lit(_GRAIN)) < F.floor((share - F.floor(share)) * _GRAIN), 1).otherwise(0)
        drawn = (base.groupBy("h", *names).agg(F.count(F.lit(1)).alias("c")).withColumn("k", copies).where("k > 0")
                 .select("h", *names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))).alias("j"))
                 .select(F.when(F.col("j") == 1, F.col("h")).otherwise(F.xxhash64("h", "j")).alias("h"), *names)
                 .withColumn("w", F.lit(1)))
    extra = f"if(pmod(xxhash64(h, 1), {_GRAIN}) / {_GRAIN}D < {each - math.floor(each)}D, 1, 0)"
    runs = f"""transform(sequence(1, {math.floor(each)} + {extra}),
                         j -> int(pmod(pmod(xxhash64(h, 2), {trees}) + j, {trees})))"""
    return drawn.select("h", "w", *names, F.expr(
        f"explode(if({math.floor(each)} + {extra} > 0, {runs}, cast(array() as array<int>)))").alias("tree"))


def fit_forest(df: DataFrame, keys: Sequence[str], features: Sequence[str] | None = None,
               unique_keys: bool = False, trees: int = TREES, sample: int = SAMPLE,
               seed: int = SEED, extra_identifiers: Iterable[str] = ()) -> ForestModel | None:
    """Fit; None when no column can be a feature.

    Collected: one row per column, then the nodes of the trees.
    """
    table = forest_features(df, features, extra_identifiers).where("is_feature").orderBy("ordinal")
    chosen = table.select("column", "numeric_count", "total_rows").collect()
    if not chosen:
        return None
    names, rows = [r["column"] for r in chosen], chosen[0]["total_rows"]
    # a median is needed only where there is a gap to fill
    gaps = [r["column"] for r in chosen if r["numeric_count"] < rows]
    medians = {r["column"]: r["median"]
               for r in exact_quantiles(df, gaps, {"median": 0.5}).collect()} if gaps else {}
    mids = [medians.get(c, 0.0) for c in names]
    levels = max(1, math.ceil(math.log2(min(sample, max(rows, 2)))))
    cols = [f"f{i}" for i in range(len(names))]

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        ordered = pdf.sort_values(["h", *cols], kind="stable")
        # a second hash order per tree, then the cut to the sample size
        mixed = np.random.default_rng([seed, tree, 1]).permutation(len(ordered))
        x = ordered[cols].to_numpy(dtype="float64")[mixed]
        x = np.repeat(x, ordered["w"].to_numpy()[mixed], axis=0)[:sample]
        split, at, length = _grow(x, np.random.default_rng([seed, tree]), levels)
        return pd.DataFrame({"tree": [tree], "split": [split], "at": [at], "length": [length]})

    nodes = (_samples(df, names, mids, rows, keys, unique_keys, trees, sample, seed)
             .groupBy("tree").applyInPandas(
                 grow, "tree int, split array<long>, at array<double>, length array<double>")
             .orderBy("tree").collect())
    return ForestModel(tuple(names), tuple(mids), rows,
                       np.array([n["split"] for n in nodes], dtype=np.int64),
                       np.array([n["at"] for n in nodes]), np.array([n["length"] for n in nodes]),
                       levels)


def forest_scores(df: DataFrame, keys: Sequence[str], model: ForestModel | None = None,
                  **fit) -> DataFrame:
    """(_rid, score) for every row; negative means easier to isolate than average."""
    model = model or fit_forest(df, keys, **fit)
    if model is None:
        return df.select(row_id(keys).alias("_rid"), F.lit(None).cast("double").alias("score"))
    return model.score(df, [row_id(keys).alias("_rid")]).select("_rid", "score")


@dataclass(frozen=True)
class ForestResult:
    flagged: DataFrame      # _rid, features..., score
    features: tuple[str, ...]
    rows: int
    threshold: float
    low: float
    high: float
    mean: float
    std: float


def detect(df: DataFrame, keys: Sequence[str], model: ForestModel | None = None,
           **fit) -> ForestResult | None:
    """Score once.  The threshold is at most -0.15, so only rows below that can be
    flagged: they are written while mean and deviation of all scores are observed
    in the same pass; the final filter reads the small written table."""
    model = model or fit_forest(df, keys, **fit)
    if model is None:
        return None
    seen = Observation()
    scored = model.score(df, [row_id(keys).alias("_rid")]).observe(
        seen, F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"),
        F.stddev_pop("score").alias("std"), F.min("score").alias("low"), F.max("score").alias("high"))
    candidates = written(scored.where(F.col("score") < SCORE_LIMIT), "forest")
    m = seen.get
    threshold = min(SCORE_LIMIT, m["mean"] - SCORE_SIGMAS * m["std"])
    return ForestResult(candidates.where(F.col("score") < threshold), model.features, m["n"],
                        threshold, m["low"], m["high"], m["mean"], m["std"])


def forest_rows(df: DataFrame, keys: Sequence[str], **fit) -> DataFrame:
    """Flagged rows with their score and feature values."""
    found = detect(df, keys, **fit)
    if found is None:
        return df.select(row_id(keys).alias("_rid"), F.lit(None).cast("double").alias("score"),
                         F.lit(None).cast("string").alias("values")).limit(0)
    values = F.to_json(F.struct(*[F.col(ident(c)) for c in found.features]))
    return found.flagged.select("_rid", F.round("score", 4).alias("score"), values.alias("values"))


def forest_findings(df: DataFrame, keys: Sequence[str], found: ForestResult | None = None,
                    **fit) -> DataFrame:
    """At most one finding for the whole table."""
    found = found or detect(df, keys, **fit)
    if found is None:
        empty = df.limit(0).select(F.lit(None).cast("string").alias("x"))
        return as_findings(empty, stage=7, ordinal=F.lit(1), finding_type=F.col("x"),
                           column=F.col("x"), severity=F.col("x"), message=F.col("x"),
                           count=F.lit(None), pct=F.lit(None), evidence=["x"])
    pct = F.round(F.col("anomalous_row_count") / F.lit(found.rows) * 100, 2)
    # a bounded top-10: each task keeps its own ten smallest
    ids = (found.flagged.select("_rid").orderBy("_rid").limit(10)
           .agg(F.array_sort(F.collect_list("_rid"))).scalar())
    t = (found.flagged.agg(F.count(F.lit(1)).alias("anomalous_row_count"))
         .where("anomalous_row_count > 0").withColumn("anomalous_percentage", pct)
         .withColumn("sample_anomalous_rows", ids))
    severity = (F.when(F.col("anomalous_percentage") > CRITICAL_PCT, "CRITICAL")
                .when(F.col("anomalous_percentage") > HIGH_PCT, "HIGH").otherwise("MEDIUM"))
    message = F.concat(
        F.lit("Isolation Forest identified "), F.col("anomalous_row_count").cast("string"),
        F.lit(" multivariate anomalous record(s) ("), F.col("anomalous_percentage").cast("string"),
        F.lit(f"% of total) separated beyond threshold {found.threshold:.3f} across features: "
              f"{', '.join(found.features)}."))
    return as_findings(
        t, stage=7, ordinal=F.lit(1), finding_type=F.lit("ML_ISOLATION_FOREST_ANOMALY"),
        column=F.lit(None), severity=severity, message=message, count=F.col("anomalous_row_count"),
        pct=F.col("anomalous_percentage"),
        evidence=[F.lit(", ".join(found.features)).alias("features_analyzed"),
                  F.lit(round(found.threshold, 4)).alias("separation_threshold"),
                  "anomalous_row_count", F.lit(found.rows).alias("total_rows"),
                  "anomalous_percentage", "sample_anomalous_rows",
                  F.lit(round(found.low, 4)).alias("min_decision_score"),
                  F.lit(round(found.mean, 4)).alias("mean_decision_score")])


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS,
              threshold: float | None = None) -> DataFrame:
    """Equal bins from minimum to maximum, the last one closed; empty bins included."""
    x = F.col(ident(column)).cast("double")
    span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).where("hi is not null")
    values = df.select(x.alias("x")).where("x is not null").withColumn(
        "s", span.select(F.struct("lo", "hi")).scalar())
    counts = (values.groupBy(F.expr(
        f"case when s.hi > s.lo then int(least(width_bucket(x, s.lo, s.hi, {bins}), {bins})) else {bins} end"
        " as bin")).agg(F.count(F.lit(1)).alias("count")))
    grid = span.select("lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    edge = [F.expr(f"lo + (hi - lo) * (bin - {1 - i}) / {bins}") for i in (0, 1)]
    t = grid.join(counts, "bin", "left").select(
        "bin", edge[0].alias("low"), edge[1].alias("high"), F.coalesce("count", F.lit(0)).alias("count"))
    flagged = F.lit(False) if threshold is None else F.col("high") <= threshold
    return t.select(
        "bin", F.concat(num(F.col("low"), 2), F.lit(" to "), num(F.col("high"), 2)).alias("range"),
        F.round((F.col("low") + F.col("high")) / 2, 3).alias("score_mid"), "count",
        flagged.alias("is_anomalous"))
