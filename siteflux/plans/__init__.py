"""Composed jobs: evaluation, inputs, observations, scoring, calibration, learned responses."""
