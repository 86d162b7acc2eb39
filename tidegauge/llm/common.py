"""Small helpers that the operators share: tables, stored steps, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The folder that holds the package; Python workers need it on their path.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver runs from elsewhere."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Without one, a local session (tests) gets a temporary
    folder; elsewhere that would lie on each machine apart, so it is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="tidegauge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidegauge"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: What a step passes to Python at a time: long texts make batches of few rows.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "2m", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextmanager
def small_batches(spark: SparkSession):
    """Bounds the batches of the jobs that run within, for the sake of workers' memory."""
    before = {k: spark.conf.get(k) for k in BATCHES}
    for k, v in BATCHES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stored(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage and
    survives lost executors. Shuffle files of finished steps are then released."""
    spark = df.sparkSession
    path, schema = path or new_path(spark, tag), df.schema
    with small_batches(spark):
        df.write.mode("overwrite").parquet(path)
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


class Steps:
    """Tables that the steps of one operator write; each is dropped once no step needs it."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.paths = spark, tag, {}

    def store(self, name: str, df: DataFrame) -> DataFrame:
        self.paths[name] = new_path(self.spark, f"{self.tag}-{name}")
        return stored(df, name, self.paths[name])

    def drop(self, *names: str) -> None:
        for name in names:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Drop what finished steps hold, so that Spark's cleaner frees their shuffle files. What a step
    has just left is let go of a moment later, so once would leave its files for the whole next step."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.1)
        spark.sparkContext._jvm.System.gc()


_HELD: dict = {}
_AT: list = [None]


def turn_to(step: str) -> None:
    """What a worker does before a task: if its last one was of another step, it lets go of
    what it kept for that, so that a step that keeps nothing doesn't carry an earlier one's memo."""
    if _AT[0] != step:
        _AT[0] = step
        if _HELD:
            _HELD.clear()
            gc.collect()
            give_back()


def _let_go(batches):
    for _ in batches:
        pass
    turn_to("sweep")
    yield from ()


def sweep(spark: SparkSession) -> None:
    """Lets workers that idle go of what a finished step kept. A step of few tasks would wake only
    some of them, and the memo of the others would lie beside it. Executors take idle workers in
    turns, so some small tasks for each core reach all."""
    importable(spark)
    n = 4 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).mapInArrow(_let_go, "id long").write.format("noop").mode("overwrite").save()


def held(owner: tuple, make: Callable):
    """What a Python worker keeps from task to task. It keeps one operator's memo at a
    time, so that the stages of a pipeline don't add up in an executor's memory."""
    if owner not in _HELD:
        _HELD.clear()
        _HELD[owner] = make()
    return _HELD[owner]


class Memo(dict):
    """What `make` gives for strings, for the latest of them. It holds two generations of
    `size` entries: when the young one is full it becomes the old one, so that strings that
    still occur stay and others go. Long strings are made anew each time."""

    def __init__(self, make: Callable, size: int, longest: int = 64):
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, key: str):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        return self.keep(key, value)

    def keep(self, key: str, value):
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def unknown(self, keys: Iterable[str]) -> list[str]:
        """The keys that it does not hold but would."""
        return [k for k in keys if k not in self and k not in self.old and len(k) <= self.longest]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as Python strings; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)], schema=schema)


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of rows with equal keys from batches that are sorted by those keys. Callers
    bound the size of a group (blocks); one group at a time is held."""
    import numpy as np

    open_key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a].item() for c in cols)
            if key != open_key:
                if parts:
                    yield open_key, pa.Table.from_batches(parts)
                open_key, parts = key, []
            parts.append(batch.slice(a, b - a))
    if parts:
        yield open_key, pa.Table.from_batches(parts)


def give_back() -> None:
    """Return what Arrow and the C library hold free to the machine, since a worker outlives
    its task and others need the memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow by a worker that gives free memory back when a task ends, and what other
    steps left before it begins."""
    step = f"{fn.__module__}.{fn.__qualname__}"

    def run(batches):
        turn_to(step)
        yield from fn(batches)
        give_back()

    importable(df.sparkSession)
    return df.mapInArrow(run, schema)
