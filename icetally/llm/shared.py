"""Helpers of the operators: tables in the shared folder, sorted runs, connected components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    A session without one gets a temporary folder if it runs in a single process (tests), and an
    error otherwise: a folder of one machine is no place for tables that all executors read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="llm-"))
    return spark.conf.get("spark.checkpoint.dir")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors' Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    bundle = Path(tempfile.mkdtemp(prefix="llm-code-")) / "icetally_llm.zip"
    with zipfile.ZipFile(bundle, "w") as target:
        for file in [package.parent / "__init__.py", *sorted(package.glob("*.py"))]:
            target.write(file, file.relative_to(package.parent.parent))
    context.addPyFile(str(bundle))
    _shipped.add(context.applicationId)


class Scratch:
    """Written tables of one run, below a folder of their own; a lost executor costs no lineage."""

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, frame: DataFrame, name: str) -> DataFrame:
        """Store the rows and return a frame that reads them."""
        frame.write.parquet(self.path(name))
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more, to keep the disk for the next ones."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            target = jvm.org.apache.hadoop.fs.Path(self.path(name))
            target.getFileSystem(conf).delete(target, True)


def text_bytes(docs: DataFrame, *others: str) -> DataFrame:
    """``doc_id``, the text as UTF-8 bytes (null: empty), and the other columns asked for."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", text.alias("text"), *others)


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The values of the columns, row by row, so that one long text is in memory at a time."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def batched(
    records: Iterator[tuple], schema: pa.Schema, size: int = 2000
) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of at most ``size`` rows."""
    held: list[tuple] = []
    for record in records:
        held.append(record)
        if len(held) >= size:
            yield as_batch(held, schema)
            held = []
    if held:
        yield as_batch(held, schema)


def as_batch(records: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*records)
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def hash128(*columns: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds, together the identity of a value."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(7), *columns)]


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node``, ``root`` (smallest node reachable) for the ends of ``edges`` (a, b: long).

    Alternating stars: first every larger neighbour, then every smaller one, is linked to the
    smallest neighbour, until the links are stars. A node with very many links costs partial
    minima and a join that adaptive execution splits, never one list. Null ends are ignored.
    """
    clean = edges.where("a is not null and b is not null and a <> b")
    links = scratch.write(
        clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{name}-0",
    )
    before, step = None, 0
    while True:
        now = links.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == before:
            break
        before, step = now, step + 1
        # Larger neighbours go to the smallest neighbour, counting the node itself.
        both = links.select("u", "v").union(links.select(F.col("v"), F.col("u")))
        low = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{step}m")
        low = low.select(F.col("u"), F.least("u", "m").alias("m"))
        up = both.join(low, "u").where("v > u and v > m").select(F.col("v").alias("u"), "m")
        large = scratch.write(up.distinct(), f"{name}-{step}a").withColumnRenamed("m", "v")
        # Smaller neighbours, and the node itself, go to the smallest of them.
        low = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{step}n")
        down = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m"))
        kept = down.union(low.select("u", "m")).distinct().withColumnRenamed("m", "v")
        links = scratch.write(kept, f"{name}-{step}")
        scratch.drop(f"{name}-{step}m", f"{name}-{step}a", f"{name}-{step}n", f"{name}-{step - 1}")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
