"""Analytics on bars, ledgers and payloads: DataFrame in, DataFrame out, keyed by symbol."""
