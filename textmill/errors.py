"""Errors of the engine."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import PySparkException


class TextmillError(RuntimeError):
    """A Spark job of the engine failed unexpectedly; the message says in what."""


@contextmanager
def spark_job(what: str):
    """Wrap Spark's errors with what was being done, and let others pass."""
    try:
        yield
    except PySparkException as error:
        if "tokenizer must return" in str(error):
            raise TypeError("tokenizer must return an iterable of tokens") from error
        raise TextmillError(f"{what}: {error}") from error
