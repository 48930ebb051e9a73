"""A Spark engine for company financial facts and the documents behind them."""
