"""Named steps that run from files to files."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.tables import load_file, load_many, save_file, suffix

STEPS: dict[str, Callable[..., DataFrame]] = {}


def step(name: str):
    """Publish ``fn(DataFrames and options) -> DataFrame`` under ``name``."""
    def add(fn):
        if name in STEPS:
            raise ValueError(f"step registered twice: {name}")
        STEPS[name] = fn
        return fn

    return add


def _load(spark: SparkSession, value):
    """A path or a list of paths becomes a table, anything else is an option.
    ``(paths, schema)`` as a dict with these keys is for text files."""
    if isinstance(value, dict) and set(value) == {"paths", "schema"}:
        return load_many(spark, value["paths"], value["schema"], ordered=False)
    several = isinstance(value, (list, tuple)) and bool(value) and all(isinstance(v, str) for v in value)
    if not several and not isinstance(value, str):
        return value
    try:  # only the names decide; a missing file raises below
        for v in value if several else [value]:
            suffix(v)
    except IOError:
        return value
    return load_many(spark, list(value)) if several else load_file(spark, value)


def run(spark: SparkSession, name: str, output: str | None = None, **inputs) -> DataFrame:
    """Load inputs by suffix, run the step, save the result; unknown argument
    names raise."""
    fn = STEPS[name]
    known = inspect.signature(fn).parameters
    unknown = set(inputs) - set(known)
    if unknown:
        raise TypeError(f"{name} has no arguments {sorted(unknown)}")
    result = fn(**{k: _load(spark, v) for k, v in inputs.items()})
    if output is not None:
        save_file(result, output)
    return result
