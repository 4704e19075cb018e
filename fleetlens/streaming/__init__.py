"""Structured Streaming forms of pairing, windows and the sinks behind them."""
