"""Time series."""

from __future__ import annotations

from lodestat.operators import series
from lodestat.registry.anomalies import DAILY
from lodestat.registry.common import rounded, table

ENTRIES = {}


def _add(name, query, sql=None):
    ENTRIES[name] = (query, sql)


def _daily(spark, folder):
    return series.prepare_series(table(spark, folder, "events"), "ts", "value", "event_type")


_add(
    "m1_prepare_series", lambda s, d: rounded(_daily(s, d), 4),
    f"SELECT event_type, ts, round(value, 4) AS value FROM {DAILY}",
)
_add("m2_exponential_smoothing", lambda s, d: series.fit_series(_daily(s, d), "exponential_smoothing", "event_type", period=7))
_add("m3_arima", lambda s, d: series.fit_series(_daily(s, d), "arima", "event_type"))
_add("m4_auto_arima_orders", lambda s, d: series.auto_orders(_daily(s, d), "event_type", period=7))
_add("m5_forecast", lambda s, d: series.forecast(_daily(s, d), "exponential_smoothing", "event_type", horizon=7, period=7))
_add("m5_forecast_auto_arima", lambda s, d: series.forecast(_daily(s, d), "auto_arima", "event_type", horizon=7, period=7))
_add("m6_residuals", lambda s, d: series.residuals(_daily(s, d), "arima", "event_type"))
_add("m6_residual_profile", lambda s, d: series.residual_diagnostics(_daily(s, d), "arima", "event_type")[0])
_add("m6_residual_histogram", lambda s, d: series.residual_diagnostics(_daily(s, d), "arima", "event_type")[1])
