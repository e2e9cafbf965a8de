"""Reading numeric CSV files (plain or gzipped) and whole text files of any charset."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidParameter, require


def csv_table(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, has_headers: bool = True, separator: str = ",") -> DataFrame:
    """All cells as doubles; a cell that is no number fails the read.

    With ``columns`` the schema is known beforehand and the file isn't read
    twice.  Files that end in .gz are decompressed (one task a file: gzip can't
    be split).
    """
    require(len(separator) == 1, "a separator is one character")
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.option("header", has_headers).option("sep", separator).option("mode", "FAILFAST")
    if columns is None:
        columns = reader.option("inferSchema", False).csv(paths).columns
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in columns])
    return reader.schema(schema).csv(paths)


#: Charsets that the JVM decodes itself; any other is decoded in Python.
_BUILTIN = {"utf-8", "utf-16", "utf-16be", "utf-16le", "us-ascii", "iso-8859-1"}


def text_files(spark: SparkSession, paths: Sequence[str], charset: str = "utf-8", errors: str = "strict") -> DataFrame:
    """(path, text) of whole files.

    ``errors`` is what becomes of undecodable bytes: ``strict`` fails,
    ``replace`` puts U+FFFD and ``ignore`` drops them.
    """
    require(errors in ("strict", "replace", "ignore"), f"no such error handling: {errors}")
    try:
        "".encode(charset)
    except LookupError as e:
        raise InvalidParameter(f"no such charset: {charset}") from e
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    if charset.lower() in _BUILTIN and errors == "replace":
        return files.select("path", F.decode("content", charset.upper()).alias("text"))

    def decode(batches):
        for batch in batches:
            texts = [bytes(b.as_buffer()).decode(charset, errors) for b in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string())], names=["path", "text"])

    return files.mapInArrow(decode, "path string, text string")
