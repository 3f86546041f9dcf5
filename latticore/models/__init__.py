"""Predictors over range images."""
