"""Whole jobs: base grain, feature sets, forecasts, evaluation."""
