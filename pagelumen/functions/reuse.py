"""Expressions that are built once a session.

A column is a description without data, and the same one serves any number of queries. Building the large ones takes
seconds, as every step is a call to the JVM.
"""

from __future__ import annotations

import functools
import weakref
from collections.abc import Callable
from typing import Any

from pyspark import SparkContext

_BUILT: weakref.WeakKeyDictionary[SparkContext, dict[tuple, Any]] = weakref.WeakKeyDictionary()


def once_a_session(build: Callable) -> Callable:
    """Keeps what a function of hashable arguments builds for as long as the session's context lives."""

    @functools.wraps(build)
    def kept(*args: Any) -> Any:
        context = SparkContext._active_spark_context
        if context is None:
            return build(*args)
        known = _BUILT.setdefault(context, {})
        key = (build.__module__, build.__qualname__, *args)
        if key not in known:
            known[key] = build(*args)
        return known[key]

    return kept
