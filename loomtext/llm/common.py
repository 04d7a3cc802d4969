"""Helpers shared by the training-data operators: shared folder, materialised tables, word patterns."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the white-space kind: everything but the six ASCII white-space characters.
SPACES = r"[\x20\x09-\x0D]+"
_OWN = ""
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local session that names none (tests, laptops) gets a fresh local folder; on a
    cluster no other machine could read it, so a missing setting is an error there.
    """
    global _OWN
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        where = _OWN = _OWN or "file://" + tempfile.mkdtemp(prefix="loomtext-")
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage at files every executor can read, so a lost executor costs
    a re-read and not a recomputation, and Catalyst gets exact sizes.  Once the table is
    written nothing reads the shuffles behind it, so Spark removes their files.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by rows and bytes: documents can be long, and a worker holds a batch or two."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = re.match(r"(\d+)b?\Z", spark.conf.get(key))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def tasks_for(spark: SparkSession, rows: int = 0, each: int = 1_000_000) -> int:
    """Tasks for work that costs more than its bytes tell, so that small partitions are not put together."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows // each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def space_words(text: Column) -> Column:
    """Array of the words between ASCII white space; null text has none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACES}|{SPACES}\z", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def double_array(values: Iterable[float]) -> Column:
    """A literal array<double>; one constant in the plan, whatever its length."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def crc_fold(column: Column, folds: int) -> Column:
    """crc32 of the value as text, modulo ``folds``; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI or plain path, None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def file_system(uri: str):
    """A pyarrow file system and the path in it; works on executors for any scheme pyarrow knows."""
    from pyarrow import fs

    if (path := local_path(uri)) is not None:
        return fs.LocalFileSystem(), os.path.normpath(path)
    return fs.FileSystem.from_uri(uri)


_HELD: dict[str, object] = {}


def held(key: str, make: Callable[[], object]):
    """The state that a worker keeps between tasks: one at a time, named by a digest of what it is made from.

    Workers are used again by later stages, so an operator's state goes when another's comes.
    """
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Drops what this worker keeps and hands freed memory back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def digest_of(*parts: bytes) -> str:
    """A name for worker state made from these bytes."""
    h = hashlib.sha256()
    for p in parts:
        h.update(len(p).to_bytes(8, "little") + p)
    return h.hexdigest()


def fields_of(df: DataFrame, columns: list[str]) -> str:
    """The DDL of some columns, for the schema of a map."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
