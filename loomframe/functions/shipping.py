"""Sending Python functions to executors that don't have this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ships(module: str) -> None:
    """Pickle what ``module`` defines by value."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
