"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that every contract here names: [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names starting with ``bases`` that no column of ``df`` has, in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name, n = base, 0
        while name.lower() in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(df: DataFrame, name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return df["`" + name.replace("`", "``") + "`"]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session, whose executors are the driver, may have none: it gets a temporary one. A cluster without a
    shared folder is refused.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def forget(df: DataFrame) -> None:
    """Delete the checkpoint of ``df``, a result of ``cut`` that nothing will read again."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, megabytes: int = 1) -> None:
    """Bound the bytes of an Arrow batch, so that Python workers hold few long texts at once.

    This is a setting of the session, as plans read it when they run; it only lowers a bound, and changes no result.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]?)i?b?\s*", spark.conf.get(key).lower()).groups()
    now = int(number) << {"k": 10, "m": 20, "g": 30, "t": 40, "p": 50}.get(unit, 0)
    if now <= 0 or now > megabytes << 20:
        spark.conf.set(key, f"{megabytes << 20}b")


def let_go() -> None:
    """Give back what earlier stages left in this Python worker: the words that BPE remembers, and freed memory."""
    if bpe := sys.modules.get("tidemark.llm.bpe"):
        bpe.tokenizer.cache_clear()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
