"""Small pieces shared by the training-data operators."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import cut, shared_dir, ship_package  # noqa: F401

#: Bytes that str.split() and the contracts' word pattern [^\x20\x09-\x0D]+ treat as separators.
SPACE_CLASS = r"\x20\x09-\x0D"
#: Separators of the alphanumeric words; the text is lower-cased for A-Z first, or both cases are kept.
ALNUM_SEP_ANYCASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: For bytes.translate: A-Z become a-z, every other ASCII byte outside 0-9 and a-z becomes a blank.
ALNUM_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256))
#: For bytes.translate: A-Z become a-z.
LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(m)


def crc_of(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()]


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with this package present on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


#: Items that `scan` goes through at a time.
CHUNK = 256


def let(value: Column, body) -> Column:
    """body(value), with the value evaluated once for all its uses."""
    return F.transform(F.array(value), body)[0]


def scan(items: Column, zero: Column, step, emit, kind: str) -> Column:
    """emit(state, item) of each item in order, an array of `kind`; the state starts as zero and goes on as step(state, item).

    An array that grew by one item at a time would be copied whole each time. Here a chunk of items grows by itself, so an item costs
    at most CHUNK copies however many there are.
    """
    none = F.expr(f"cast(array() AS array<{kind}>)")
    nothing = F.expr(f"cast(array() AS array<array<{kind}>>)")

    def one(acc, x):
        return F.struct(step(acc["s"], x).alias("s"), F.concat(acc["out"], F.array(emit(acc["s"], x))).alias("out"))

    def many(acc, part):
        done = F.aggregate(part, F.struct(acc["s"].alias("s"), none.alias("out")), one)
        return let(done, lambda d: F.struct(d["s"].alias("s"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    def whole(a):
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(a) - 1) / F.lit(CHUNK)).cast("int")))
        parts = F.transform(starts, lambda k: F.slice(a, k * CHUNK + 1, F.lit(CHUNK)))
        return F.flatten(F.aggregate(parts, F.struct(zero.alias("s"), nothing.alias("out")), many)["out"])

    return let(items, whole)


def running(steps: Column) -> Column:
    """The total of all steps before each one."""
    return scan(steps, F.lit(0), lambda s, x: s + x, lambda s, x: s, "int")
