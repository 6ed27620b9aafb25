"""Scalar functions as column expressions, and the tables behind them."""
