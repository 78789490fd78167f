"""Walk-forward training and the bar backtest of its signal."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.prefix import numbered
from tidemark.functions.ticks import DAY_NS, YEAR_NS

KEYS = ("symbol", "bar_end_ns")


@dataclass(frozen=True)
class TrainConfig:
    model: str = "ridge"
    horizon_bars: int = 1
    n_splits: int = 4
    seed: int = 42
    n_estimators: int = 50
    max_depth: int = 3

    def __post_init__(self):
        if self.model not in ("ridge", "gradient_boosting"):
            raise ValueError(f"unknown model {self.model}")
        for name, least in (("horizon_bars", 1), ("n_splits", 2), ("n_estimators", 1), ("max_depth", 1)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be {least} or more")


@dataclass
class TrainResult:
    """``folds``: errors of each fold on its training and validation rows. ``metrics``: means over the
    folds (``train_``, ``val_``), and the backtest of all validation rows as one run (``backtest_``)."""

    folds: DataFrame
    metrics: dict[str, float] = field(default_factory=dict)


def with_target(matrix: DataFrame, horizon: int) -> DataFrame:
    """Adds ``target``, the return of the mid price ``horizon`` bars ahead."""
    if "mid_price" not in matrix.columns:
        raise ValueError("the matrix needs mid_price")
    ahead = F.lead("mid_price", horizon).over(Window.partitionBy("symbol").orderBy("bar_end_ns"))
    return matrix.withColumn("target", F.when(F.col("mid_price") != 0, ahead / F.col("mid_price") - 1))


def cuts(n: int, splits: int) -> list[int]:
    return [int(x) for x in np.linspace(0, n, splits + 2)]


def walk_forward(rows: DataFrame, splits: int) -> DataFrame:
    """Adds ``i``, the place by (bar, symbol), and ``part``: fold f trains on the parts up to f and is
    tested on part f + 1."""
    placed = numbered(rows, ["bar_end_ns", "symbol"], DAY_NS, name="i").withColumn("i", F.col("i") - 1)
    c = cuts(rows.count(), splits)
    return placed.withColumn("part", sum((F.col("i") >= x).cast("long") for x in c[1:-1]))


def bar_backtest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Metrics for each group of ``signal`` and ``r``: positions are the signal's sign. With a column
    ``bar_end_ns`` the Sharpe ratio is for a year of as many rows as the group's span of bars has."""
    w = Window.partitionBy(*by).orderBy(*order)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    x = rows.withColumn("pos", F.signum("signal")).withColumn("pnl", F.col("pos") * F.col("r"))
    x = x.withColumn("dp", F.col("pos") - F.coalesce(F.lag("pos").over(w), F.col("pos"))).withColumn("e", F.product(1 + F.col("pnl")).over(up)).withColumn("n", F.row_number().over(w))
    x = x.withColumn("peak", F.greatest(F.lit(1.0), F.max("e").over(up)))
    bar = F.col("bar_end_ns") if "bar_end_ns" in rows.columns else F.lit(0)
    mean, std, years = F.avg("pnl"), F.stddev_samp("pnl"), (F.max_by(bar, "n") - F.min_by(bar, "n")) / F.lit(float(YEAR_NS))
    return x.groupBy(*by).agg(
        F.coalesce(F.when((std > 0) & (years > 0), mean / std * F.sqrt(F.count("*") / years)), F.lit(0.0)).alias("sharpe"),
        (F.max_by("e", "n") - 1).alias("total_return"), F.max((F.col("peak") - F.col("e")) / F.col("peak")).alias("max_drawdown"),
        (F.sum(F.abs("dp")) / F.count("*")).alias("turnover"), F.count_if(F.col("dp") != 0).alias("fill_count"),
        F.avg("pnl").alias("mean_pnl"), F.stddev_samp("pnl").alias("std_pnl"), F.lit(0.0).alias("avg_slippage_bps"),
    )


def train_evaluate(matrix: DataFrame, config: TrainConfig) -> TrainResult:
    """Fits each fold and scores its training rows and its test part. Rows are few (bars by symbols, not
    ticks): they are put into one sorted partition, and predictions are summed on the driver in one order,
    so that the metrics are the same in every run."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    names = [c for c in matrix.columns if c not in (*KEYS, "target")]
    rows = with_target(matrix, config.horizon_bars).dropna(subset=[*names, "target"])
    rows = walk_forward(rows, config.n_splits).coalesce(1).sortWithinPartitions("i").cache()
    n = rows.count()
    if n < config.n_splits + 2:
        raise ValueError(f"{n} rows are too few for {config.n_splits} folds")
    data = VectorAssembler(inputCols=names, outputCol="x").transform(rows)
    out = None
    try:
        for f in range(config.n_splits):
            fit, test = data.where(F.col("part") <= f), data.where(F.col("part") == f + 1)
            if config.model == "ridge":
                s = fit.agg(F.count("*").alias("n"), F.stddev_pop("target").alias("s")).first()
                scale = (s.s or 1.0) / s.n
                model = LinearRegression(featuresCol="x", labelCol="target", solver="normal", standardization=False, elasticNetParam=0.0, regParam=scale)
            else:
                model = GBTRegressor(featuresCol="x", labelCol="target", maxIter=config.n_estimators, maxDepth=config.max_depth, stepSize=0.05, subsamplingRate=0.8, seed=config.seed)
            both = model.fit(fit).transform(fit.withColumn("kind", F.lit("train")).unionByName(test.withColumn("kind", F.lit("val"))))
            p = both.select(F.lit(f).alias("fold"), "kind", "i", "bar_end_ns", F.col("target").alias("r"), F.col("prediction").alias("signal"))
            out = p if out is None else out.unionByName(p)
        got = out.toPandas().sort_values(["fold", "kind", "i"], kind="stable")
    finally:
        rows.unpersist()
    spark = matrix.sparkSession
    errors = []
    for (fold, kind), g in got.groupby(["fold", "kind"], sort=True):
        y, miss = g["r"].to_numpy(), (g["r"] - g["signal"]).to_numpy()
        total = float(((y - y.mean()) ** 2).sum())
        errors.append((int(fold), str(kind), len(g), float((miss**2).mean()), 1 - float((miss**2).sum()) / total if total > 0 else 0.0))
    folds = spark.createDataFrame(errors, "fold int, kind string, n long, mse double, r2 double")
    metrics = {f"{k}_{m}": float(np.mean([e[at] for e in errors if e[1] == k])) for k in ("train", "val") for m, at in (("mse", 3), ("r2", 4))}
    # the validation rows of all folds, in order, are one run
    one = got[got["kind"] == "val"].reset_index(drop=True)
    one = spark.createDataFrame(one.assign(place=np.arange(len(one)))[["place", "bar_end_ns", "r", "signal"]]).coalesce(1)
    backtest = bar_backtest(one, [], ["place"]).first().asDict()
    metrics |= {f"backtest_{k}": backtest[k] for k in ("total_return", "sharpe", "max_drawdown", "turnover", "fill_count", "avg_slippage_bps")}
    return TrainResult(folds, metrics)
