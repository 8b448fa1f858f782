"""Embedding providers: named in a setting, loaded once a worker, fed whole batches. Vectors of a file meet tables by a join."""

from __future__ import annotations

import hashlib
import importlib
from collections.abc import Iterator
from pathlib import PurePosixPath
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a vector file that a worker may hold.
MOST = 256 << 20


class Provider(Protocol):
    """What a provider has to do. ``images`` gets (name, bytes or None) of each image; both give a vector for each input, in order."""

    def texts(self, texts: list[str]) -> list[list[float]]: ...

    def images(self, images: list[tuple[str, bytes | None]]) -> list[list[float]]: ...


class Fake:
    """Vectors from a hash of the text, or of the image's name: for tests of what comes after."""

    def __init__(self, size: str = "64"):
        self.size = int(size)

    def _of(self, key: str) -> list[float]:
        digest = hashlib.sha256(key.encode()).digest()
        return [digest[i % 32] / 255 - 0.5 for i in range(self.size)]

    def texts(self, texts):
        return [self._of(f"text:{t}") for t in texts]

    def images(self, images):
        return [self._of(f"image:{PurePosixPath(name).name}") for name, _ in images]


class FromFile:
    """Vectors that were made elsewhere: Parquet files (key STRING, vector ARRAY of numbers) below a folder. Keys are texts, and images' names without folders.

    A column function has each worker hold the files, as Arrow arrays; ``with_texts`` and ``with_images`` join them instead.
    """

    def __init__(self, folder: str):
        import pyarrow.parquet as pq
        from pyarrow import fs

        from ..sources.files import opened

        store, path = opened(folder)
        found = [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.base_name.endswith(".parquet")]
        if sum(f.size for f in found) > MOST:
            raise ValueError(f"{folder} holds more than a worker may: join such vectors by key instead")
        self.vectors, self.known = [], {}
        for n, f in enumerate(found):
            t = pq.read_table(store.open_input_file(f.path), columns=["key", "vector"])
            self.vectors.append(t["vector"])
            self.known.update((key, (n, k)) for k, key in enumerate(t["key"].to_pylist()))

    def _of(self, key: str) -> list[float]:
        if key not in self.known:
            raise KeyError(f"no vector for {key!r}")
        n, k = self.known[key]
        return self.vectors[n][k].as_py()

    def texts(self, texts):
        return [self._of(t) for t in texts]

    def images(self, images):
        return [self._of(PurePosixPath(name).name) for name, _ in images]


_KNOWN = {"fake": Fake, "file": FromFile}
_LOADED: dict[str, Provider] = {}


def provider(spec: str) -> Provider:
    """``fake``, ``fake:128``, ``file:/folder``, or ``package.module.Class:argument`` of one's own; made once in each process."""
    if spec not in _LOADED:
        name, _, argument = spec.partition(":")
        kind = _KNOWN.get(name)
        if kind is None:
            module, _, attribute = name.rpartition(".")
            if not module:
                raise ValueError(f"unknown embedding provider: {name}")
            kind = getattr(importlib.import_module(module), attribute)
        _LOADED[spec] = kind(argument) if argument else kind()
    return _LOADED[spec]


def text_vectors(text: Column, spec: str) -> Column:
    """A vector for each text; null for null."""

    @F.arrow_udf("array<double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = provider(spec)
        for b in batches:
            yield _placed(b.is_valid().to_pylist(), lambda b=b: p.texts([x for x in b.to_pylist() if x is not None]))

    return of(text)


def image_vectors(name: Column, content: Column | None, spec: str) -> Column:
    """A vector for each image, from its name and, if given, its bytes; null where the name is null."""

    @F.arrow_udf("array<double>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        p = provider(spec)
        for names, contents in batches:
            pairs = [(n, c) for n, c in zip(names.to_pylist(), contents.to_pylist()) if n is not None]
            yield _placed(names.is_valid().to_pylist(), lambda pairs=pairs: p.images(pairs))

    return of(name, F.lit(None).cast("binary") if content is None else content)


def _placed(valid: list[bool], made) -> pa.Array:
    vectors = iter(made() if any(valid) else [])
    out = [next(vectors, None) if v else None for v in valid]
    if any(v and x is None for v, x in zip(valid, out)) or next(vectors, None) is not None:
        raise ValueError("a provider gives one vector for each input")
    return pa.array([None if x is None else [float(y) for y in x] for x in out], pa.list_(pa.float64()))


def _joined(df: DataFrame, key: Column, spec: str) -> DataFrame:
    """``df`` with ``v``, the vector that the files of a ``file:`` provider have for the key; null for null, an error for a key without one. Of several of a key the greatest counts."""
    read = df.sparkSession.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(spec.partition(":")[2])
    known = read.select(F.col("key").alias("_key"), F.transform("vector", lambda x: x.cast("double")).alias("v")).groupBy("_key").agg(F.max("v").alias("v"))
    missing = F.raise_error(F.concat(F.lit("no vector for '"), F.col("_of"), F.lit("'"))).cast("array<double>")
    met = df.withColumn("_of", key).join(known, F.col("_of") == F.col("_key"), "left")
    return met.withColumn("v", F.when(F.col("_of").isNotNull(), F.coalesce("v", missing))).drop("_of", "_key")


def with_texts(df: DataFrame, text: Column, spec: str) -> DataFrame:
    """``df`` with ``v``, the vector of a text, at any number of vectors."""
    return _joined(df, text, spec) if spec.startswith("file:") else df.withColumn("v", text_vectors(text, spec))


def with_images(df: DataFrame, name: Column, content: Column | None, spec: str) -> DataFrame:
    """``df`` with ``v``, the vector of an image, at any number of vectors."""
    return _joined(df, F.regexp_extract(name, "([^/]*)/*$", 1), spec) if spec.startswith("file:") else df.withColumn("v", image_vectors(name, content, spec))


def catalog_vectors(df: DataFrame, spec: str) -> DataFrame:
    """(question, value, v) of a catalog (question, value, prompt)."""
    return with_texts(df, F.col("prompt"), spec).select("question", "value", "v")
