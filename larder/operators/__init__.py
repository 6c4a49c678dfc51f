"""Reusable DataFrame operators: cleaning, joins, aggregates, series, forecasts."""
