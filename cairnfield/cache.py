"""Memoised tables: results stored under a key of the function, its versions, arguments and inputs."""

from __future__ import annotations

import contextlib
import hashlib
import inspect
import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, Observation, SparkSession

from .tables import exists, materialize


class NotCachedError(RuntimeError):
    """The result is not in the store."""


class UnmarkedDependencyError(ValueError):
    """A dependency has no version."""


def version(number: int | str) -> Callable:
    """Mark a function with the version that enters the keys of results that depend on it."""

    def mark(f):
        f.cairn_version, f.cairn_dependencies = str(number), getattr(f, "cairn_dependencies", ())
        return f

    return mark


def _versions(f, seen: set | None = None) -> list[str]:
    seen = seen if seen is not None else set()
    if f in seen:
        return []
    seen.add(f)
    if not hasattr(f, "cairn_version"):
        raise UnmarkedDependencyError(f.__qualname__)
    out = [f"{f.__module__}.{f.__qualname__}={f.cairn_version}"]
    for g in f.cairn_dependencies:
        out += _versions(g, seen)
    return out


def _describe(x) -> str:
    if isinstance(x, DataFrame):
        return f"plan {x.semanticHash()}"
    if isinstance(x, dict):
        return "{" + ", ".join(f"{k}: {_describe(v)}" for k, v in sorted(x.items())) + "}"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(_describe, x)) + "]"
    return repr(x)


class HashMismatchError(RuntimeError):
    """A result is not what it was when its hash was stored."""


class Memory:
    """A store of DataFrame-returning functions' results below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, f, ignore: tuple[str, ...], args: tuple, kwargs: dict) -> str:
        """Where a call's result is kept: by function, versions and arguments."""
        bound = inspect.signature(f).bind(*args, **kwargs)
        bound.apply_defaults()
        named = {k: v for k, v in bound.arguments.items() if k not in ignore and not isinstance(v, SparkSession)}
        text = "\n".join([*sorted(_versions(f)), _describe(named)])
        return f"{self.folder}/{f.__name__}/{hashlib.sha256(text.encode()).hexdigest()[:32]}"

    def cache(self, dependencies: tuple = (), ignore: tuple[str, ...] = ()):
        """Decorate a versioned function. How arguments are passed does not matter, and ignored ones do not count."""

        def decorate(f):
            f.cairn_dependencies = tuple(dependencies)

            def path(*args, **kwargs) -> str:
                return self._path(f, ignore, args, kwargs)

            @wraps(f)
            def run(*args, **kwargs) -> DataFrame:
                at = path(*args, **kwargs)
                if not exists(self.spark, f"{at}/_SUCCESS"):
                    f(*args, **kwargs).write.mode("overwrite").parquet(at)
                return self.spark.read.parquet(at)

            def stored(*args, **kwargs) -> str:
                at = path(*args, **kwargs)
                if not exists(self.spark, f"{at}/_SUCCESS"):
                    raise NotCachedError(at)
                return at

            run.stored, run.path = stored, path
            return run

        return decorate

    def cache_hash(self, dependencies: tuple = (), ignore: tuple[str, ...] = ()):
        """As cache, but only the result's content hash (n, total, mix) stays: a result must be what it was before.

        The hash is observed on the one job that computes the result. A call computes it into a temporary table, compares, and gives
        that table; ``with f.checked(...) as result:`` gives the result itself, whose hash rides on the consumer's own job
        and is compared when the block ends (the job has to read all rows). The first run of a set of arguments stores the hash;
        later ones raise HashMismatchError if it differs.
        """
        from .operators.stats import fingerprint_columns

        def decorate(f):
            f.cairn_dependencies = tuple(dependencies)
            if not hasattr(f, "cairn_version"):
                f.cairn_version = "0"

            def path(*args, **kwargs) -> str:
                return self._path(f, ignore, args, kwargs)

            def stored(*args, **kwargs) -> str:
                at = path(*args, **kwargs)
                if not exists(self.spark, f"{at}/_SUCCESS"):
                    raise NotCachedError(at)
                return at

            def compare(at: str, found: dict) -> None:
                if not exists(self.spark, f"{at}/_SUCCESS"):
                    self.spark.createDataFrame([(found["n"], found["total"], found["mix"])], "n long, total string, mix long").coalesce(1).write.mode("overwrite").parquet(at)
                elif self.spark.read.parquet(at).first().asDict() != {k: found[k] for k in ("n", "total", "mix")}:
                    raise HashMismatchError(f.__qualname__)

            @contextlib.contextmanager
            def checked(*args, **kwargs):
                at, out, seen = path(*args, **kwargs), f(*args, **kwargs), Observation()
                yield out.observe(seen, *fingerprint_columns(out.columns))
                waiting = threading.Thread(target=lambda: setattr(seen, "cairn_found", seen.get), daemon=True)
                waiting.start()
                waiting.join(60)
                if waiting.is_alive():
                    raise RuntimeError(f"the result of {f.__qualname__} was not read")
                compare(at, seen.cairn_found)

            @wraps(f)
            def run(*args, **kwargs) -> DataFrame:
                with checked(*args, **kwargs) as out:
                    result = materialize(out, "hashed")
                return result

            run.stored, run.path, run.checked = stored, path, checked
            return run

        return decorate
