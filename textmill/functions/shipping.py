"""Sending users' functions to the workers."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark import cloudpickle


def by_value(f: Callable) -> Callable:
    """f, whose module is pickled by value unless it is an installed one, for a module
    that only the driver has on its path can't be imported on a worker."""
    module = inspect.getmodule(f if inspect.isroutine(f) or inspect.isclass(f) else type(f))
    file = getattr(module, "__file__", None)
    if module is not None and module.__name__ != "__main__" and file and "-packages" not in file and "/lib/python" not in file:
        cloudpickle.register_pickle_by_value(module)
    return f
