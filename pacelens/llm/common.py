"""Shared column expressions and small text helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def remainder(identifier: str, divisor: int) -> Column:
    """crc32 of an identifier's text, modulo ``divisor``; a null identifier counts as the empty text."""
    return F.crc32(F.coalesce(F.col(identifier).cast("string"), F.lit(""))) % F.lit(divisor)


def text_key(column: str = "text") -> Column:
    """128-bit identity of a text; null and empty are the same text."""
    return F.unhex(F.md5(text_of(column)))


def ship(spark: SparkSession) -> None:
    """Send this library to the executors once per context, so that tasks can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_pacelens_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    bundle = Path(tempfile.mkdtemp(prefix="pacelens-code-")) / "pacelens_code.zip"
    with zipfile.ZipFile(bundle, "w") as out:
        for module in sorted(root.rglob("*.py")):
            out.write(module, module.relative_to(root.parent))
    context.addPyFile(str(bundle))
    context._pacelens_shipped = True


def map_batches(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInArrow`` with the library at hand in every task."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


class Shared:
    """A broadcast model with a number that tells it from other models inside a worker."""

    def __init__(self, spark: SparkSession, value):
        self.broadcast, self.number = spark.sparkContext.broadcast(value), uuid.uuid4().hex

    def ready(self, build: Callable):
        """``build(model)``, made once per worker process and kept between its tasks."""
        if self.number not in _ready:
            forget()
            _ready[self.number] = build(self.broadcast.value)
        return _ready[self.number]


_ready: dict[str, object] = {}


def forget() -> None:
    """Drop what earlier stages left in this worker process and hand the memory back."""
    _ready.clear()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)
