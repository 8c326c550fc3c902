"""Time series: preparation, decomposition, models and forecasts, one group per
series. The calendar bounds the length of a prepared series, not its row count."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lodestat.functions.columns import Columns, number, pick, present, require
from lodestat.operators import charts, profile
from lodestat.plans.ranks import running_total, with_bucket
from lodestat.plans.sizing import SMALL_DISTINCT, column_sizes

STEPS = {
    "second": "INTERVAL 1 SECOND", "minute": "INTERVAL 1 MINUTE", "hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY",
    "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTHS", "year": "INTERVAL 1 YEAR",
}
_CHUNK = 100_000


def prepare_series(
    df: DataFrame, time: str, value: str, by: Columns = None, step: str = "day", how: str = "sum", fill: float | None = 0.0,
) -> DataFrame:
    """(by..., ts, value): one row per series and calendar step.

    Rows are aggregated to the step first; steps without rows between the first
    and last one of a series get `fill`.
    """
    by = pick(df, by, [])
    aggregate = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[how]
    ts = F.date_trunc(step, F.col(time).cast("timestamp")).cast("timestamp_ntz")
    rows = (
        df.where(F.col(time).isNotNull()).groupBy(*by, ts.alias("ts"))
        .agg(aggregate(present(df, value)).cast("double").alias("value"))
    )
    ends = rows.groupBy(*by).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    calendar = ends.select(*by, F.explode(F.sequence("a", "b", F.expr(STEPS[step]))).alias("ts"))
    joined = calendar.join(rows, [*by, "ts"], "left")
    return joined if fill is None else joined.withColumn("value", F.coalesce("value", F.lit(float(fill))))


def with_position(df: DataFrame, order_by: str, by: Sequence[str]) -> DataFrame:
    """Add `i`, the 0-based place of a row in its series, and `total`, its length.

    A long series is spread over buckets of the order key.
    """
    key = number(df, order_by)
    size = column_sizes(df, {"k": key})["k"]
    rows = with_bucket(df.withColumn("_one", F.lit(1).cast("long")), key, size.splits)
    return running_total(rows, "_one", [order_by], by, before="i").drop("_one")


def decompose(df: DataFrame, column: str, order_by: str, period: int, by: Columns = None) -> DataFrame:
    """The rows with trend, seasonal and residual (classical, additive).

    The trend is a centred moving average over one period, with half weights at
    both ends if the period is even; the season is the mean of each phase, made
    to average zero. The ends of a series have no trend. Series shorter than two
    periods are left out. A series is cut into stretches with a halo of half a
    period on both sides, so one long series spreads over many tasks.
    """
    require(df, [column, order_by])
    by, half = pick(df, by, []), period // 2
    # the table's own columns wait in a struct, so that no name of theirs can clash
    rows = df.where(present(df, column).isNotNull()).select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col(order_by).alias("_order"),
        F.col(column).cast("double").alias("_x"), F.struct(*[F.col(c) for c in df.columns]).alias("_row"))
    by = [f"_by{i}" for i in range(len(by))]
    rows = with_position(rows, "_order", by).where(F.col("total") >= 2 * period)
    chunk = max(_CHUNK, 4 * period)
    home = F.floor(F.col("i") / chunk)
    near = F.array_distinct(F.array(
        home, F.floor((F.col("i") - half) / chunk), F.floor((F.col("i") + half) / chunk)))
    spread = rows.withColumn("_part", F.explode(near))
    line = Window.partitionBy(*by, "_part").orderBy("i")
    total = F.sum("_x").over(line.rowsBetween(-half, half))
    if period % 2 == 0:
        total = total - (F.lag("_x", half).over(line) + F.lead("_x", half).over(line)) / 2
    whole = (F.col("i") >= half) & (F.col("i") < F.col("total") - half)
    smooth = spread.withColumn("trend", F.when(whole, total / period)).where(F.col("_part") == home)
    smooth = smooth.withColumn("_phase", F.col("i") % period).drop("_part")
    phases = smooth.groupBy(*by, "_phase").agg(F.avg(F.col("_x") - F.col("trend")).alias("_mean"))
    level = F.avg("_mean").over(Window.partitionBy(*by))  # one row per phase of a series
    season = phases.select(*by, "_phase", (F.col("_mean") - level).alias("seasonal"))
    series = rows.select(F.approx_count_distinct(F.struct(*by)) if by else F.lit(1)).first()
    series = series[0] if series else 0
    if series * period <= SMALL_DISTINCT:
        season = F.broadcast(season)
    joined = smooth.join(season, [*by, "_phase"])
    residual = F.col("_x") - F.col("trend") - F.col("seasonal")
    return joined.withColumn("residual", residual).select(*[F.col("_row")[c].alias(c) for c in df.columns], "trend", "seasonal", "residual")


# --- models of one series --------------------------------------------------
# Small numpy helpers that run inside one group. Parameter searches evaluate all
# candidates of a round at once and halve the step around the best.


def _search(loss, start: np.ndarray, low: float, high: float, step: float, rounds: int = 1_000) -> np.ndarray:
    """Ends when the step is below 1e-5; `rounds` only guards against a loss that never settles."""
    best = start
    moves = np.array(list(product((-1.0, 0.0, 1.0), repeat=len(start))))
    while rounds and step > 1e-5:
        tries = np.clip(best + moves * step, low, high)
        losses = loss(tries)
        winner = tries[int(np.argmin(losses))]
        if np.allclose(winner, best):
            step /= 2
        best, rounds = winner, rounds - 1
    return best


def _smoothing_pass(y: np.ndarray, params: np.ndarray, m: int, trace: bool = False):
    """Additive level, trend and season over y for several parameter sets."""
    alpha, beta, gamma = params.T
    slope = float(np.mean(y[m:2 * m] - y[:m]) / m)
    flat = y[:m] - slope * np.arange(m)
    level = np.full(len(alpha), flat.mean() - slope)
    trend = np.full(len(alpha), slope)
    season = np.repeat((flat - flat.mean())[:, None], len(alpha), axis=1)
    loss, errors = np.zeros(len(alpha)), []
    for t, value in enumerate(y):
        s = season[t % m]
        error = value - (level + trend + s)
        loss += error * error
        if trace:
            errors.append(error[0])
        new = level + trend + alpha * error
        trend = trend + alpha * beta * error
        level = new
        season[t % m] = s + gamma * (1 - alpha) * error
    return loss, (level, trend, season), np.array(errors)


def smoothing(y: np.ndarray, horizon: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """(residuals, forecast) of additive exponential smoothing."""
    if len(y) < 2 * period:
        return np.full(len(y), np.nan), np.full(horizon, np.nan)
    best = _search(lambda p: _smoothing_pass(y, p, period)[0], np.array([0.3, 0.1, 0.1]), 0.0, 1.0, 0.25)
    _, (level, trend, season), errors = _smoothing_pass(y, best[None, :], period, trace=True)
    ahead = np.arange(1, horizon + 1)
    future = level[0] + trend[0] * ahead + season[(len(y) + ahead - 1) % period, 0]
    return errors, future


def _arma_errors(w: np.ndarray, params: np.ndarray, p: int, q: int) -> np.ndarray:
    """One-step errors (time by parameter set), unknown past values taken as 0."""
    errors = np.zeros((len(w), len(params)))
    for t in range(len(w)):
        guess = np.zeros(len(params))
        for j in range(min(p, t)):
            guess = guess + params[:, j] * w[t - 1 - j]
        for j in range(min(q, t)):
            guess = guess + params[:, p + j] * errors[t - 1 - j]
        errors[t] = np.clip(w[t] - guess, -1e100, 1e100)
    return errors


def arima(
    y: np.ndarray, horizon: int, order: tuple[int, int, int] = (1, 1, 1), season: int = 0,
) -> tuple[np.ndarray, np.ndarray, float]:
    """(residuals, forecast, aic) by conditional least squares.

    `season` > 0 also takes one seasonal difference. A series too short for its
    differences has no fit.
    """
    p, d, q = order
    shifts = [season] * (season > 0) + [1] * d
    w, tails = y.astype(float), []
    for shift in shifts:
        if len(w) <= shift + p + q + 1:
            return np.full(len(y), np.nan), np.full(horizon, np.nan), np.inf
        tails.append((shift, w[-shift:].copy()))
        w = w[shift:] - w[:-shift]
    mean = w.mean() if d == 0 and season == 0 else 0.0
    centred = w - mean
    params = np.zeros(p + q)
    if p + q:
        # squares of clipped errors stay finite, so a wild set only loses
        params = _search(
            lambda c: (_arma_errors(centred, c, p, q) ** 2).sum(axis=0), params, -0.99, 0.99, 0.5)
    errors = _arma_errors(centred, params[None, :], p, q)[:, 0]
    known, past = list(centred), list(errors)
    ahead = []
    for _ in range(horizon):
        value = sum(params[j] * known[-1 - j] for j in range(p)) + sum(params[p + j] * past[-1 - j] for j in range(q))
        known.append(value)
        past.append(0.0)
        ahead.append(value + mean)
    future = np.array(ahead)
    for shift, tail in reversed(tails):
        line = list(tail)
        for step in future:
            line.append(step + line[-shift])
        future = np.array(line[shift:])
    residuals = np.concatenate([np.full(len(y) - len(errors), np.nan), errors])
    variance = max(float(np.mean(errors**2)), 1e-300)
    aic = len(errors) * (np.log(2 * np.pi * variance) + 1) + 2 * (p + q + 1 + (mean != 0.0))
    return residuals, future, float(aic)


MODELS = ("exponential_smoothing", "arima", "auto_arima")
_FITTED = "part string, place int, ts timestamp_ntz, value double"


def _fit_rows(pdf: pd.DataFrame, keys: list[str], horizon: int, model: str, period: int, order, season: int) -> pd.DataFrame:
    """Residuals of the known steps and forecasts of the coming ones."""
    pdf = pdf.sort_values("ts")
    y, ts = pdf["value"].to_numpy(dtype=float), pdf["ts"]
    if model == "exponential_smoothing":
        residuals, future = smoothing(y, horizon, period)
    else:
        residuals, future, _ = arima(y, horizon, order, season)
    gap = ts.diff().median() if len(ts) > 1 else pd.Timedelta(days=1)
    months = len(ts) > 1 and (ts.dt.day == ts.dt.day.iloc[0]).all() and gap >= pd.Timedelta(days=28)
    last = ts.iloc[-1]
    coming = [last + (pd.DateOffset(months=i) if months else i * gap) for i in range(1, horizon + 1)]
    out = pd.DataFrame({
        "part": ["residual"] * len(y) + ["forecast"] * horizon,
        "place": list(range(len(y))) + list(range(1, horizon + 1)),
        "ts": list(ts) + coming,
        "value": np.concatenate([residuals, future]),
    })
    for k in keys:
        out.insert(0, k, pdf[k].iloc[0])
    return out


def _orders(spec: DataFrame, by: list[str], period: int) -> DataFrame:
    """Each series with its best order by AIC among p, q <= 2, d <= 1 and an
    optional seasonal difference. Orders are tried in parallel groups.

    Differencing keeps volumes, so fits of unequally differenced series compare
    by AIC per remaining value.
    """
    options = F.array(*[
        F.struct(F.lit(p).alias("p"), F.lit(d).alias("d"), F.lit(q).alias("q"), F.lit(s).alias("s"))
        for p, d, q, s in product(range(3), range(2), range(3), (0, period))
    ])
    tried = spec.select("*", F.inline(options))
    keys = [*by, "p", "d", "q", "s"]

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        p, d, q, s = (int(pdf[c].iloc[0]) for c in ("p", "d", "q", "s"))
        residuals, _, aic = arima(pdf["value"].to_numpy(dtype=float), 0, (p, d, q), s)
        known = residuals[~np.isnan(residuals)]
        # per value, so that shorter differenced series compare fairly
        fit = aic / len(known) if len(known) else np.inf
        out = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame(out | {"aic": [fit]})

    fields = {f.name: f.dataType.simpleString() for f in spec.schema.fields}
    schema = ", ".join([f"`{k}` {fields[k]}" for k in by] + ["p int, d int, q int, s int, aic double"])
    scored = tried.groupBy(*keys).applyInPandas(score, schema)
    best = F.min_by(F.struct("p", "d", "q", "s"), F.struct("aic", "d", "s", "p", "q")).alias("o")
    return (scored.groupBy(*by).agg(best) if by else scored.agg(best)).select(*by, "o.*")


def auto_orders(df: DataFrame, by: Columns = None, period: int = 12) -> DataFrame:
    """(by..., p, d, q, s): the order each series is modelled with."""
    by = pick(df, by, [])
    return _orders(df.select(*by, "ts", "value").where("value is not null"), by, period)


def fit_series(
    df: DataFrame, model: str = "exponential_smoothing", by: Columns = None, horizon: int = 1,
    period: int = 12, order: tuple[int, int, int] = (1, 1, 1),
) -> DataFrame:
    """(by..., part, place, ts, value) of prepared series (by..., ts, value):
    residuals per known step and forecasts per coming step."""
    if model not in MODELS:
        raise ValueError(f"Model '{model}' not supported.")
    by = pick(df, by, [])
    rows = df.select(*by, "ts", "value").where("value is not null")
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*[f"`{k}` {fields[k]}" for k in reversed(by)], _FITTED])
    if model == "auto_arima":
        best = _orders(rows, by, period)
        # one row per series
        rows = rows.join(best, by) if by else rows.withColumns(
            {c: F.lit(v) for c, v in best.first().asDict().items()})

        def fit(pdf):
            p, d, q, s = (int(pdf[c].iloc[0]) for c in ("p", "d", "q", "s"))
            return _fit_rows(pdf, by, horizon, "arima", period, (p, d, q), s)
    else:
        def fit(pdf):
            return _fit_rows(pdf, by, horizon, model, period, order, 0)

    return rows.groupBy(*by).applyInPandas(fit, schema)


def forecast(df: DataFrame, model: str = "exponential_smoothing", by: Columns = None, horizon: int = 1, **options) -> DataFrame:
    """(by..., step, ts, forecast), continuing each series in its own step."""
    by = pick(df, by, [])
    fitted = fit_series(df, model, by, horizon, **options)
    return fitted.where("part = 'forecast'").select(
        *by, F.col("place").alias("step"), "ts", F.col("value").alias("forecast"))


def residuals(df: DataFrame, model: str = "exponential_smoothing", by: Columns = None, **options) -> DataFrame:
    """(by..., ts, residual) of the known steps that have one."""
    by = pick(df, by, [])
    fitted = fit_series(df, model, by, 1, **options)
    return fitted.where("part = 'residual' and value is not null and not isnan(value)").select(*by, "ts", F.col("value").alias("residual"))


def residual_diagnostics(df: DataFrame, model: str = "exponential_smoothing", by: Columns = None, bins: int = 20, **options):
    """(profile, histogram) of all residuals."""
    left = residuals(df, model, by, **options)
    return profile.numeric_profile(left, "residual"), charts.histogram(left, "residual", bins)
