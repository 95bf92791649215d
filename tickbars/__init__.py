"""Exchange trades to OHLC candles on Spark, in batch and in streams."""
