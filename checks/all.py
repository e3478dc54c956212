"""Imports every module that registers queries."""

from checks import aggs, files, jobs, joins, masks, series  # noqa: F401
