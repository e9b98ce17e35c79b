"""What functions take along to executors."""

from __future__ import annotations

import pickle

from pyspark import SparkContext, cloudpickle


class Cache(dict):
    """A cache of a process: travels empty. (functools caches would be looked up by import there.)"""

    def __reduce__(self):
        return Cache, ()


class Shared:
    """A broadcast of any value. Classes of this package go with it by value, as they do with functions."""

    def __init__(self, context: SparkContext, value: object) -> None:
        self._data = context.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return pickle.loads(self._data.value)
