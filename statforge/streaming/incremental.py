"""Models that go on learning from a stream.

Each micro-batch updates the model by one distributed fit.  The model is kept
as a file a batch in the shared folder: a batch that is run again after a
failure starts from the model before it, so its rows count once.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Generic, TypeVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.bayes import BernoulliNB, Ftrl, GaussianNB, MultinomialNB
from ..operators.clusters import KMeans
from ..sources.store import shared_dir

M = TypeVar("M")
_KINDS = {c.__name__: c for c in (GaussianNB, MultinomialNB, BernoulliNB, Ftrl, KMeans)}


def packed(model: object) -> str:
    """A model as JSON; dictionaries keep the types of their keys."""

    def plain(v: object) -> object:
        if isinstance(v, np.ndarray):
            return {"array": v.tolist()}
        if isinstance(v, dict):
            return {"pairs": [[k, plain(x)] for k, x in v.items()]}
        if isinstance(v, tuple):
            return {"tuple": [plain(x) for x in v]}
        return v.item() if isinstance(v, np.generic) else v

    return json.dumps({"kind": type(model).__name__, "fields": {k: plain(v) for k, v in model.__dict__.items()}})


def unpacked(text: str) -> object:
    def rich(v: object) -> object:
        if isinstance(v, dict):
            if "array" in v:
                return np.array(v["array"], float)
            if "pairs" in v:
                return {k: rich(x) for k, x in v["pairs"]}
            if "tuple" in v:
                return tuple(rich(x) for x in v["tuple"])
        return v

    got = json.loads(text)
    return _KINDS[got["kind"]](**{k: rich(v) for k, v in got["fields"].items()})


class Models(Generic[M]):
    """Versions of one model, by batch number."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/statforge-model-{name}"

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def before(self, batch: int) -> M | None:
        """The newest model from batches earlier than this one."""
        older = [v for v in self.versions() if v < batch]
        if not older:
            return None
        row = self.spark.read.text(f"{self.path}/batch={older[-1]}", wholetext=True).first()
        return unpacked(row[0])

    def latest(self) -> M | None:
        return self.before(1 << 62)

    def save(self, batch: int, model: M) -> None:
        self.spark.createDataFrame([(packed(model),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/batch={batch}")


def fit_stream(stream: DataFrame, name: str, fit: Callable[[DataFrame, M | None], M], checkpoint: str | None = None, once: bool = True) -> tuple[StreamingQuery, Models[M]]:
    """Update a model by every micro-batch; ``fit`` gets a batch and the model so far.

    With ``once`` the query ends when all rows at hand are learned from.
    """
    spark = stream.sparkSession
    models: Models[M] = Models(spark, name)

    def learn(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        kept = batch.persist()  # a fit may take several passes
        try:
            models.save(number, fit(kept, models.before(number)))
        finally:
            kept.unpersist()

    writer = stream.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint or f"{shared_dir(spark)}/statforge-stream-{name}")
    return (writer.trigger(availableNow=True) if once else writer).start(), models


def parquet_stream(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """Parquet files - a folder of them, or one file - as a stream; the schema is that of the files at hand."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return reader.parquet(path)
