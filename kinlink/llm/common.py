"""What the corpus operators share: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import reachable

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The cluster names it in spark.checkpoint.dir; a temporary one is set only where it is unset and the session runs in this process alone."""
    reachable(spark)
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="kinlink-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


_WRITTEN: set[str] = set()  # staged tables of this process
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Staged:
    """Tables written to the shared folder, so that a lost executor costs no recomputation of what led to them. They last as long as the process, as results read them lazily; release() deletes them before."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = shared_dir(spark)

    def put(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.root}/staged-{uuid.uuid4().hex}"
        schema = df.schema
        _WRITTEN.add(path)
        before = self.spark.conf.get(_CLEANUP, None)
        try:
            # else shuffle files stay until the driver happens to collect its garbage
            self.spark.conf.set(_CLEANUP, "true")
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(schema).parquet(path), path

    def drop(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        _WRITTEN.discard(path)


def release(spark: SparkSession) -> None:
    """Delete all staged tables of this process. Results that were not written yet can no longer be read."""
    for path in sorted(_WRITTEN):
        Staged(spark).drop(path)


@atexit.register
def _released_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _WRITTEN:
        release(spark)


def staged(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and return it as read from there."""
    return Staged(df.sparkSession).put(df)[0]


@contextmanager
def passing(spark: SparkSession):
    """A staged() whose tables are deleted at the end of the block; nothing that reads them may be left to run by then."""
    store, paths = Staged(spark), []

    def put(df: DataFrame) -> DataFrame:
        out, path = store.put(df)
        paths.append(path)
        return out

    try:
        yield put
    finally:
        for path in paths:
            store.drop(path)


#: Rows of a few numbers each up to which a table is broadcast, so well under 100 MB; beyond, joins with it are shuffles.
MOST_BROADCAST = 1_000_000


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df, to be broadcast if it has no more than most rows. Joins give the same either way."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def slices(batches, rows: int = 512):
    """Arrow batches in slices of so many rows, so that a worker holds the texts of few rows as Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (u, v): one row (node, root) for each node of an edge; root is the smallest node of its component.

    Each round hooks every parent to the smallest grandparent seen over an edge and halves the paths, so that rounds grow with the logarithm of the longest path. Only joins and map-side combined minimums run, so a node with very many edges is no hot task; the driver sees a count of changes per round. An empty edge table gives an empty result; self-loops and repeated edges change nothing.
    """
    store = Staged(edges.sparkSession)
    both, both_at = store.put(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    state, state_at = store.put(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")))
    for _ in range(most_rounds):
        parent = state.select(F.col("node").alias("p"), F.col("root").alias("grand"))
        seen = state.join(parent, state.root == parent.p).select("node", "root", "grand")
        near = both.join(seen.select(F.col("node").alias("v"), F.col("grand").alias("g")), "v").groupBy("u").agg(F.min("g").alias("near"))
        step = seen.join(near, seen.node == near.u).select("node", "root", F.least("grand", "near").alias("to"))
        after = (
            step.select("node", "to", F.col("root").alias("was"))
            .unionByName(step.select(F.col("root").alias("node"), "to", F.lit(None).cast(state.schema["root"].dataType).alias("was")))
            .groupBy("node")
            .agg(F.min("to").alias("root"), F.min("was").alias("was"))
        )
        after, after_at = store.put(after)
        changed = after.filter(F.col("root") < F.col("was")).limit(1).count()
        store.drop(state_at)
        state, state_at = after.select("node", "root"), after_at
        if not changed:
            store.drop(both_at)
            break
    else:
        raise RuntimeError("components did not settle")
    return state
