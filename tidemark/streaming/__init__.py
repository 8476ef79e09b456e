"""Incremental versions of the daily aggregates for feeds that land file by file."""
