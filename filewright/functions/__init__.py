"""Column functions: names, dates, keys, and the patterns behind them."""
