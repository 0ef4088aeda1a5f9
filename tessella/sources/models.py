"""Fitted operators as JSON with a checksum: save, load, bytes."""

from __future__ import annotations

import dataclasses
import importlib
import json
import zlib
from typing import Any

from pyspark.sql import SparkSession

from tessella.errors import CorruptModel

VERSION = 1


def _plain(x: Any) -> Any:
    if dataclasses.is_dataclass(x) and not isinstance(x, type):
        return {"__class__": f"{type(x).__module__}:{type(x).__qualname__}", "fields": {k: _plain(v) for k, v in vars(x).items()}}
    if hasattr(x, "tolist"):
        return {"__array__": x.tolist()} if getattr(x, "ndim", 0) else x.tolist()
    if isinstance(x, dict):
        return {"__dict__": [[_plain(k), _plain(v)] for k, v in x.items()]}
    if isinstance(x, tuple):
        return {"__tuple__": [_plain(v) for v in x]}
    return [_plain(v) for v in x] if isinstance(x, list) else x


def _rich(x: Any) -> Any:
    if isinstance(x, list):
        return [_rich(v) for v in x]
    if not isinstance(x, dict):
        return x
    if "__array__" in x:
        import numpy as np

        return np.array(x["__array__"])
    if "__dict__" in x:
        return {_rich(k): _rich(v) for k, v in x["__dict__"]}
    if "__tuple__" in x:
        return tuple(_rich(v) for v in x["__tuple__"])
    module, _, name = x["__class__"].partition(":")
    if not module.startswith("tessella."):
        raise CorruptModel(f"{module} isn't a module of the library")
    made = object.__new__(getattr(importlib.import_module(module), name))
    made.__dict__.update({k: _rich(v) for k, v in x["fields"].items()})
    return made


def to_bytes(model: Any, pretty: bool = False) -> bytes:
    body = json.dumps(_plain(model), indent=2 if pretty else None)
    return json.dumps({"version": VERSION, "kind": type(model).__name__, "crc32": zlib.crc32(body.encode()), "body": body}).encode()


def peek(data: bytes) -> dict[str, Any]:
    """What is stored, without loading it."""
    found = json.loads(data)
    return {k: found[k] for k in ("version", "kind", "crc32")}


def from_bytes(data: bytes) -> Any:
    found = json.loads(data)
    if found.get("version") != VERSION or zlib.crc32(found["body"].encode()) != found["crc32"]:
        raise CorruptModel("the stored model's version or checksum is wrong")
    return _rich(json.loads(found["body"]))


def save_model(spark: SparkSession, model: Any, path: str) -> None:
    """One line of text in a folder of any store that Spark writes to."""
    spark.createDataFrame([(to_bytes(model).decode(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> Any:
    return from_bytes(spark.read.text(path).first()[0].encode())
