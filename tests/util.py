"""Small fixtures."""

import datetime as dt

import numpy as np
import pandas as pd

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def walk(symbol, n, seed, start=dt.datetime(2000, 1, 3)):
    """Random walk bars, one per day."""
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    open_ = close * np.exp(rng.normal(0, 0.01, n))
    high = np.maximum(open_, close) * (1 + rng.uniform(0, 0.02, n))
    low = np.minimum(open_, close) * (1 - rng.uniform(0, 0.02, n))
    volume = rng.integers(100, 1000, n).astype(float)
    ts = [start + dt.timedelta(days=i) for i in range(n)]
    return pd.DataFrame({"symbol": symbol, "ts": ts, "open": open_, "high": high, "low": low,
                         "close": close, "volume": volume})


def bars(spark, *frames):
    rows = [tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in r)
            for f in frames for r in f.itertuples(index=False)]
    return spark.createDataFrame(rows, BARS)
