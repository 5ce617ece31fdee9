"""An exactly-once sink of frozen months: a log of batches, keyed by the stream and its batch.

A batch is written to a folder of its own and then named in the log by one exclusive create. One that is delivered again is
found in the log and left alone; one that broke off before its entry is written anew. Neither reads an earlier batch, so a
batch costs the same however many came before it. Readers take the folders that the log names; of a month that two
streams brought, the first row written stays.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("panel", "month_idx")


def deduplicated(months: DataFrame, delay: str, at: str = "finalized_at") -> DataFrame:
    """A stream without months that come again within ``delay`` of event time: state is bounded by it.

    What comes again later than that is refused by the sink's readers.
    """
    return months.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(KEYS))


class MonthLog:
    """Batches of published months under one folder, on any file system that Spark reads and writes."""

    def __init__(self, spark: SparkSession, root: str, schema: str) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _claim(self, entry: str, value: dict) -> bool:
        """Create an entry of the log; False if it is there."""
        fs, path = self._path(f"log/{entry}")
        try:
            stream = fs.create(path, False)
        except Exception:
            if fs.exists(path):
                return False
            raise
        stream.write(bytearray((json.dumps(value) + "\n").encode()))
        stream.close()
        return True

    def writer(self, stream: str) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function. ``stream`` names the query: it stays the same over its restarts."""
        if not stream or set(stream) & set("/."):
            raise ValueError("a stream's name has neither slashes nor dots")

        def write(batch: DataFrame, number: int) -> None:
            entry = f"{stream}.{number}"
            fs, path = self._path(f"log/{entry}")
            if fs.exists(path):
                return
            folder, at = f"batch-{stream}.{number}-{uuid.uuid4().hex}", time.time_ns()
            names = [c.split()[0] for c in self.schema.split(", ")]
            rows = batch.dropDuplicates(list(KEYS)).select(*names, F.lit(at).alias("_at"))
            rows.write.parquet(f"{self.root}/{folder}")
            # Of two deliveries at one time, one is named; the other's folder is nobody's.
            self._claim(entry, {"folder": folder})

        return write

    def _entries(self) -> list[str]:
        fs, path = self._path("log")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in names if not n.startswith(("_", ".")) and not n.endswith(".crc"))

    def folders(self) -> list[str]:
        """The folders that the log names. An entry without its end was left by a crash, and names nothing."""
        found = []
        for name in self._entries():
            fs, path = self._path(f"log/{name}")
            stream = fs.open(path)
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if text.endswith("\n"):
                found.append(json.loads(text)["folder"])
        return found

    def read(self) -> DataFrame:
        """All published months, one row each: the first that was written."""
        folders = self.folders()
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, _at long").parquet(*[f"{self.root}/{f}" for f in folders])
        rest = [c.split()[0] for c in self.schema.split(", ") if c.split()[0] not in KEYS]
        first = rows.groupBy(*KEYS).agg(F.min_by(F.struct(*rest), "_at").alias("first"))
        return first.select(*KEYS, *[F.col(f"first.{c}").alias(c) for c in rest])
