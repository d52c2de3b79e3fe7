"""Reading tables, scratch space, connected components and word rules shared by the operators."""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.session import work_dir

#: White space between words: space and U+0009 to U+000D, nothing else.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Workspace:
    """One folder below ``spark.checkpoint.dir`` for the written tables of one run.

    Written tables cut the lineage and outlive any executor. The folder is
    deleted when the driver's JVM ends; ``drop`` deletes a table before that.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._fs().deleteOnExit(self._path(self.folder))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``df`` and read it back."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept_at = path
        return out

    def drop(self, *kept: DataFrame) -> None:
        for df in kept:
            with contextlib.suppress(AttributeError):
                self._fs().delete(self._path(df._kept_at), True)


def crc_mod(id_col: Column | str, k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(c.cast("string")), F.lit(k))


def spaced(c: Column | str) -> Column:
    """Every white-space character as one space, so that splitting needs no pattern."""
    return F.translate(c, SPACES, " " * len(SPACES))


def word_count(c: Column | str) -> Column:
    """Number of runs of characters other than SPACES; 0 for NULL."""
    return F.coalesce(F.size(F.array_remove(F.split(spaced(c), " "), "")), F.lit(0)).cast("long")


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same vertices as (a, b) do: each vertex with the first of its component, so fewer edges than vertices."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(names)))
    return names[other], names[label[other]]


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """Connected components of ``edges(a, b)`` as rows (id, component); component is the smallest id.

    Each round points every vertex at its smallest neighbour, contracts the
    edges along these pointers and writes what is left; the rounds end when no
    edge is left. A vertex and what it points at stay joined by their own
    contracted edge, and the smallest id of a component points at itself, so the
    last label is that id. Rounds are few: each at least halves what is not yet
    joined. Self loops only name their vertex. Empty edges give an empty table.
    """
    left = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    both = lambda e: e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
    labels = None
    while True:
        point = ws.keep(both(left).groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).withColumnRenamed("a", "id"), "point")
        if labels is None:
            new = point.select("id", F.col("p").alias("component"))
        else:
            hop = point.select(F.col("id").alias("component"), "p")
            new = labels.join(hop, "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        new = ws.keep(new, "labels")
        at_a = point.select(F.col("id").alias("a"), F.col("p").alias("pa"))
        at_b = point.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        rest = (
            left.join(at_a, "a").join(at_b, "b").filter("pa <> pb")
            .select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct()
        )
        rest = ws.keep(rest, "edges")
        ws.drop(point, left, *([labels] if labels is not None else []))
        labels, left = new, rest
        if left.isEmpty():
            return labels
