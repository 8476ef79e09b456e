"""Readers and writers for the feeds. Tickers are a column or partition, never a loop."""
