"""K1 / K2: the columns of a table that grows, as numbered versions.

A batch with a new column, or with a wider type of an old one, gives a new
version; every run remembers the version it was written under and is read under
it, so an old file is never asked for what it does not have.  Columns that a
batch lacks read as null; a type that neither side widens to is an error.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..sources import fs

_WHOLE = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]


def nullable(kind: T.DataType) -> T.DataType:
    """A type as files give it back: nothing in it is without null."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType))
    return kind


def wider(old: T.DataType, new: T.DataType) -> T.DataType:
    """The type that holds values of both."""
    if old == new or isinstance(new, T.NullType):
        return old
    if isinstance(old, T.NullType):
        return new
    if old in _WHOLE and new in _WHOLE:
        return _WHOLE[max(_WHOLE.index(old), _WHOLE.index(new))]
    pair = {type(old), type(new)}
    if pair == {T.FloatType, T.DoubleType} or T.DoubleType in pair and pair & {T.ByteType, T.ShortType, T.IntegerType}:
        return T.DoubleType()
    if pair == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    if pair == {T.StructType}:
        return merged(old, new)
    if pair == {T.ArrayType}:
        return T.ArrayType(wider(old.elementType, new.elementType))
    raise ValueError(f"no type holds both {old.simpleString()} and {new.simpleString()}")


def merged(old: T.StructType, new: T.StructType) -> T.StructType:
    """``old`` with the columns of ``new``: old ones first, each nullable and as wide as both need."""
    more = {f.name: nullable(f.dataType) for f in new}
    out = [T.StructField(f.name, wider(nullable(f.dataType), more.pop(f.name)) if f.name in more else f.dataType) for f in old]
    return T.StructType([*out, *(T.StructField(n, t) for n, t in more.items())])


class SchemaLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._known: dict[int, T.StructType] = {}

    def latest(self) -> int:
        """The number of the newest version, -1 if there is none."""
        return max((int(n) for n in fs.names(self.spark, self.path) if n.isdigit()), default=-1)

    def version(self, n: int) -> T.StructType:
        if n not in self._known:
            self._known[n] = T.StructType.fromJson(json.loads(fs.get(self.spark, f"{self.path}/{n:06d}")))
        return self._known[n]

    def admit(self, columns: T.StructType) -> int:
        """The version that holds these columns, a new one if none does yet."""
        n = self.latest()
        old = self.version(n) if n >= 0 else T.StructType([])
        new = merged(old, columns)
        if n < 0 or new != old:
            n += 1
            fs.put(self.spark, f"{self.path}/{n:06d}", new.json())
            self._known[n] = new
        return n
