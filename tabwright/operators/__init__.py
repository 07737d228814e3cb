"""The eleven table operators. Each takes a DataFrame and returns a DataFrame."""

from tabwright.operators.aggregate import aggregate
from tabwright.operators.anomaly import anomaly, anomaly_bounds
from tabwright.operators.compare import compare
from tabwright.operators.correlation import correlation
from tabwright.operators.distribution import distribution
from tabwright.operators.growth import growth
from tabwright.operators.pivot import pivot
from tabwright.operators.profile import profile
from tabwright.operators.ranking import ranking
from tabwright.operators.ratio import ratio, ratio_scalar
from tabwright.operators.timeseries import timeseries

__all__ = [
    "aggregate", "anomaly", "anomaly_bounds", "compare", "correlation", "distribution",
    "growth", "pivot", "profile", "ranking", "ratio", "ratio_scalar", "timeseries",
]
