"""Near-duplicate embeddings in the cells of a spherical k-means.

Equal vectors are one class. Cells are fitted on a bounded sample; every class lives in the cell
of its nearest centre and is a guest in the cells whose border it is close to. A cell's own vectors
are compared among each other and with its guests in blocked matrix products, and a pair that two
cells see is counted in one. What leaves a block are numbers of links and a spanning star of them,
so that a dense group costs its products but never all its pairs as rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icetally.llm.shared import Scratch, components, hash128
from icetally.llm.simhash import stars

THRESHOLD = 0.95
SAMPLE = 20_000
"""Classes on which the centres are fitted. All classes are indexed."""
CELL = 512
"""Classes a cell should have."""
MOST_CELLS = 2048
CHUNK = 1024
"""Vectors on one side of a blocked product; larger cells are cut into such chunks."""
BORDER = 0.5
"""Width of the border on each side, in steps of the threshold's length. A step across a border has
one end within half its length of it, and one end that is a guest is enough, so no pair is missed."""


def unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def fit_centres(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Unit centres that maximise the cosine to their members."""
    rows = unit(sample)
    centres = rows[np.random.default_rng(seed).choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        home = np.argmax(rows @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, rows)
        lengths = np.linalg.norm(sums, axis=1)
        used = lengths > 1e-9
        centres[used] = sums[used] / lengths[used, None]
    return centres


class Cells:
    """Centres by dimension; a dimension that the sample lacks is one cell."""

    def __init__(self, sample: list[np.ndarray], total: int, threshold: float, cell: int = CELL):
        self.step = np.sqrt(2 - 2 * threshold)
        self.centres: dict[int, np.ndarray] = {}
        for dim in {len(v) for v in sample}:
            own = np.array([v for v in sample if len(v) == dim], dtype=np.float64)
            expected = total * len(own) / len(sample)
            k = int(min(max(1, round(expected / cell)), MOST_CELLS, max(1, len(own) // 8)))
            self.centres[dim] = fit_centres(own, k)

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The home of each row, and a matrix of the cells where it is at home or a guest."""
        centres = self.centres.get(rows.shape[1])
        if centres is None:
            return np.zeros(len(rows), int), np.ones((len(rows), 1), bool)
        cosines = unit(rows) @ centres.T
        home = np.argmax(cosines, axis=1)
        behind = cosines[np.arange(len(rows)), home][:, None] - cosines
        apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))[home]
        return home, behind <= BORDER * self.step * apart + 1e-9


def vector_array(column) -> np.ndarray:
    """A list column of one length as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float64)


def placed(classes: DataFrame, cells: Cells) -> DataFrame:
    """A row for each cell of each class: ``cell``, ``home`` and the class, and in the home cell
    ``cells``, the list of all of them."""

    def take(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                home, there = cells.places(vector_array(own.column("vector")))
                row, cell = np.nonzero(there)
                picked = own.take(pa.array(row))
                # Only a row at home is asked where else it is.
                sizes = np.where(cell == home[row], there.sum(axis=1)[row], 0)
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                visited = np.nonzero(there)[1].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        picked.column("name"), picked.column("n"), picked.column("dim"),
                        picked.column("vector"), pa.array(cell.astype(np.int32)),
                        pa.array(home[row].astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(visited)),
                    ],
                    names=["name", "n", "dim", "vector", "cell", "home", "cells"],
                )

    vector = classes.schema["vector"].dataType.simpleString()
    return classes.select("name", "n", "dim", "vector").mapInArrow(
        take,
        f"name long, n long, dim int, vector {vector}, cell int, home int, cells array<int>",
    )


def compare(threshold: float):
    """Links of one block: counts (``a``, ``links``) and spanning links (``a``, ``b``)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def block(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        name, n = table.column("name").to_numpy(), table.column("n").to_numpy()
        home = table.column("home").to_numpy()
        rows = unit(vector_array(table.column("vector")))
        left = np.flatnonzero(side == 0)
        kind = table.column("kind")[0].as_py()
        right = left if kind == "self" else np.flatnonzero(side == 1)
        close = rows[left] @ rows[right].T >= threshold
        if kind == "self":
            np.fill_diagonal(close, False)
        i, j = np.nonzero(close)
        if kind == "guest" and len(i):
            # The guest's home sees the pair too if this row is a guest there; the smaller cell counts.
            cell = table.column("cell")[0].as_py()
            rows_hit, at = np.unique(left[i], return_inverse=True)
            visits = np.zeros((len(rows_hit), int(home.max()) + 1), bool)
            for r, cells in enumerate(table.column("cells").take(pa.array(rows_hit)).to_pylist()):
                visits[r, [c for c in cells if c < visits.shape[1]]] = True
            mine = (cell < home[right[j]]) | ~visits[at, home[right[j]]]
            i, j = i[mine], j[mine]
        if not len(i):
            return schema.empty_table()
        counts = np.zeros(len(name), dtype=np.int64)
        np.add.at(counts, left[i], n[right[j]])
        if kind != "self":
            np.add.at(counts, right[j], n[left[i]])
        low = stars(len(name), left[i], right[j], name)
        ends = np.flatnonzero(counts)
        edge = ends[low[ends] != name[ends]]
        a = np.concatenate((name[ends], name[edge]))
        b = pa.array([None] * len(ends) + low[edge].tolist(), pa.int64())
        links = np.concatenate((counts[ends], np.zeros(len(edge), np.int64)))
        return pa.table([pa.array(a), b, pa.array(links)], schema=schema)

    return block


def blocks(members: DataFrame, scratch: Scratch) -> DataFrame:
    """Every member once for each block that it takes part in."""
    own = F.col("cell") == F.col("home")
    sizes = scratch.write(
        members.groupBy("dim", "cell").agg(
            F.ceil(F.count(F.when(own, 1)) / CHUNK).cast("int").alias("homes"),
            F.ceil(F.count(F.when(~own, 1)) / CHUNK).cast("int").alias("guests"),
        ),
        "cell-sizes",
    )
    held = members.join(sizes, ["dim", "cell"]).where("homes > 0")
    chunk = F.pmod(F.xxhash64("name"), F.greatest(F.when(own, F.col("homes")).otherwise(F.col("guests")), F.lit(1))).cast("int")
    held = held.withColumn("own", own).withColumn("chunk", chunk)

    def block(kind: str, side, i, j):
        return F.struct(F.lit(kind).alias("kind"), side.cast("int").alias("side"), i.alias("i"), j.alias("j"))

    c = F.col("chunk")
    each = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    at_home = F.concat(
        F.array(block("self", F.lit(0), c, c)),
        F.transform(
            F.filter(each("homes"), lambda o: o != c),
            lambda o: block("home", F.when(c < o, 0).otherwise(1), F.least(c, o), F.greatest(c, o)),
        ),
        F.transform(each("guests"), lambda o: block("guest", F.lit(0), c, o)),
    )
    visiting = F.transform(each("homes"), lambda o: block("guest", F.lit(1), o, c))
    return held.withColumn("block", F.explode(F.when(F.col("own"), at_home).otherwise(visiting))).select(
        "dim", "cell", "home", "cells", "name", "n", "vector", "block.*"
    )


def links(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for rows of ``vec_id``, ``embedding``.

    Vectors of the same length whose cosine reaches the threshold are linked. Null and zero vectors,
    those with null, infinite or undefined components, and rows without id link with nothing;
    each of them is its own component (null without id) and is kept. Rows that share an id are one
    node, and count as several vectors. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    h1, h2 = hash128(F.col("vector"))
    usable = F.expr(
        "vector is not null and exists(vector, x -> x <> 0) and"
        " forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    given = vectors.select("vec_id", F.col("embedding").alias("vector"))
    rows = given.select(
        "vec_id",
        "vector",
        F.coalesce(usable, F.lit(False)).alias("usable"),
        F.coalesce(F.size("vector"), F.lit(0)).alias("dim"),
        h1.alias("h1"),
        h2.alias("h2"),
    )
    valid = rows.where("usable and vec_id is not null")
    key = ["dim", "h1", "h2"]
    classes = scratch.write(
        valid.groupBy(*key).agg(
            F.min("vec_id").alias("name"), F.count("*").alias("n"), F.first("vector").alias("vector")
        ),
        "classes",
    )
    total = classes.count()
    sample = classes.orderBy("h1", "h2").limit(SAMPLE).select("vector").toArrow()
    sample = [np.array(v, dtype=np.float64) for v in sample.column(0).to_pylist()]
    members = scratch.write(placed(classes, Cells(sample, total, threshold)), "members")
    found = scratch.write(
        blocks(members, scratch)
        .groupBy("dim", "cell", "kind", "i", "j")
        .applyInArrow(compare(threshold), "a long, b long, links long"),
        "links",
    )
    scratch.drop("members")
    counts = found.groupBy(F.col("a").alias("name")).agg(F.sum("links").alias("found"))
    spread = valid.groupBy("vec_id").agg(F.min("h1").alias("low"), F.max("h1").alias("high"))
    twice = spread.where("low <> high").select("vec_id")
    same = valid.join(twice, "vec_id", "left_semi").join(classes.select(*key, "name"), key)
    edges = found.select("a", "b").union(same.select("vec_id", "name"))
    roots = components(edges, scratch, "roots")
    counted = classes.drop("vector").join(counts, "name", "left")
    counted = counted.join(roots, counted["name"] == roots["node"], "left")
    by_class = scratch.write(
        counted.select(
            *key,
            (F.col("n") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"),
            F.coalesce("root", "name").alias("component_id"),
        ),
        "by-class",
    )
    linked = valid.select("vec_id", *key).join(by_class, key).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable or vec_id is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.union(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )


def op8_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
