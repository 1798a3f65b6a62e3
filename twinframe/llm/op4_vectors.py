"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Vectors of one label are assigned to the cell of their nearest centre. A vector
also visits every cell that may be home to a near one: if x lies in the cell of
c and y in that of h, then x is on c's side of the hyperplane between them, so y
is within the angle of the threshold of that side. A home vector thus meets all
its partners in its home cell; nothing is lost at the borders. In a cell, blocks
of rows are multiplied; a block pair returns counts and a spanning set of links,
never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinframe.llm.components import connected_components
from twinframe.llm.op10_simhash import spanning_links
from twinframe.llm.tables import table
from twinframe.operators.lookup import lookup
from twinframe.session import fits_broadcast, materialize

THRESHOLD = 0.98
#: Vectors per label that centres are fitted to (those of smallest hash), and rounds of the fit.
FIT_VECTORS = 8192
ROUNDS = 8
#: Vectors that a cell should hold, and the most cells of a label; beyond it cells grow and are cut into blocks.
CELL_ROWS = 1024
CELLS = 4096
#: Rows of a block and of an assignment task.
BLOCK_ROWS = 1024
PART_ROWS = 20_000
SLACK = 1e-7
PLACED = "label {label}, width int, cell int, home boolean, node long, copies long, vector array<double>"


def _unit(rows: list) -> np.ndarray:
    matrix = np.array(rows, np.float64)
    # scaled first, so that tiny or huge components neither vanish nor overflow when squared
    matrix /= np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def spherical_centres(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centres; an empty cell takes over the vector that fits its own centre worst."""
    centres = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = vectors @ centres.T
        home, best = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, vectors)
        norm = np.sqrt((sums * sums).sum(axis=1))
        lost = np.flatnonzero(norm < 1e-12)
        sums[lost] = vectors[np.argsort(best, kind="stable")[: len(lost)]]
        norm[lost] = 1.0
        centres = sums / norm[:, None]
    return centres


def _valid(vector: str):
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _cells(nodes: DataFrame, threshold: float) -> DataFrame:
    """Home and visiting rows of every cell."""
    kind = nodes.schema["label"].dataType.simpleString()
    sizes = materialize(
        nodes.groupBy("label", "width").agg(F.count("*").alias("n"))
        .withColumn("cells", F.least(F.lit(CELLS), F.ceil(F.col("n") / CELL_ROWS)).cast("int"))
        .withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int"))
    )
    chance = F.pmod(F.xxhash64("vector", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # one row more than chance gives, so that the sample of a small label is never empty
    sample = (
        nodes.join(sizes, ["label", "width"])
        .where((chance * F.col("n") <= FIT_VECTORS) | (F.col("n") <= FIT_VECTORS))
        .select("label", "width", "cells", "parts", "node", "vector")
    )

    def centre(key, rows):
        rows = rows.sort_by("node")
        k = rows.column("cells")[0].as_py()
        centres = spherical_centres(_matrix(rows.column("vector")), k)
        parts = rows.column("parts")[0].as_py()
        return pa.table({
            "label": pa.array([key[0].as_py()] * parts, rows.column("label").type),
            "width": pa.array([key[1].as_py()] * parts, pa.int32()),
            "part": pa.array(range(parts), pa.int32()), "centres": pa.array([centres.tobytes()] * parts, pa.binary()),
        })

    centres = sample.groupBy("label", "width").applyInArrow(centre, f"label {kind}, width int, part int, centres binary")
    dealt = nodes.join(sizes.select("label", "width", "parts"), ["label", "width"]).withColumn(
        "part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    )
    reach = float(np.sqrt(max(0.0, 1 - threshold * threshold))) + SLACK

    def place(key, rows, fitted):
        if not len(rows):
            vectors, at, cell, home = np.zeros((0, 0)), np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
        else:
            vectors = _matrix(rows.column("vector"))
            middle = np.frombuffer(fitted.column("centres")[0].as_py()).reshape(-1, vectors.shape[1])
            own = np.empty(len(vectors), np.int64)
            visits = []
            gram = middle @ middle.T
            for low in range(0, len(vectors), 1024):
                near = vectors[low : low + 1024] @ middle.T
                best = near.argmax(axis=1)
                own[low : low + 1024] = best
                # distance between the centres, and of the vector from the hyperplane between them
                apart = np.sqrt(np.maximum(1e-30, 2 - 2 * gram[best]))
                beyond = (near[np.arange(len(near)), best][:, None] - near) / apart
                close = (beyond <= reach) | (apart < 1e-6)
                close[np.arange(len(near)), best] = False
                i, c = np.nonzero(close)
                visits.append((low + i, c))
            at = np.concatenate([np.arange(len(vectors)), *(v[0] for v in visits)])
            cell = np.concatenate([own, *(v[1] for v in visits)])
            home = np.arange(len(at)) < len(vectors)
        picked = rows.take(pa.array(at)).combine_chunks() if len(rows) else rows
        return pa.table({
            "label": picked.column("label"), "width": picked.column("width"), "cell": pa.array(cell, pa.int32()),
            "home": pa.array(home, pa.bool_()), "node": picked.column("node"), "copies": picked.column("copies"),
            "vector": picked.column("vector"),
        })

    return (
        dealt.groupBy("label", "width", "part").cogroup(centres.groupBy("label", "width", "part"))
        .applyInArrow(place, PLACED.format(label=kind))
    )


def _block_links(placed: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links) from all block pairs: counts of a's links where b is null, else a spanning link."""
    cell = ["label", "width", "cell"]
    sizes = placed.groupBy(*cell).agg(
        F.ceil(F.count(F.when(F.col("home"), 1)) / BLOCK_ROWS).cast("int").alias("lefts"),
        F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("rights"),
    ).where("lefts > 0")
    own = F.xxhash64("node")
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    mine = F.when(
        F.col("home"), F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda j: pair(F.col("left"), j))
    ).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    meet = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: pair(i, F.col("right")))
    blocks = (
        placed.join(sizes, cell)
        .withColumn("left", F.pmod(own, F.col("lefts")).cast("int"))
        .withColumn("right", F.pmod(own, F.col("rights")).cast("int"))
        .withColumn("pair", F.explode(F.array_union(mine, meet)))
        .select(
            *cell, F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "node", "copies", "vector",
            (F.col("home") & (F.col("pair.i") == F.col("left"))).alias("is_left"),
            (F.col("pair.j") == F.col("right")).alias("is_right"),
        )
    )

    def link(rows):
        node, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
        vectors = _matrix(rows.column("vector"))
        left = np.flatnonzero(rows.column("is_left").to_numpy())
        right = np.flatnonzero(rows.column("is_right").to_numpy())
        near = (vectors[left] @ vectors[right].T >= threshold) & (node[left][:, None] != node[right][None, :])
        count = near @ copies[right]
        i, j = np.nonzero(near)
        a, b = spanning_links([(left[i], right[j])], len(node))
        some = count > 0
        return pa.table({
            "a": np.concatenate([node[left][some], node[a]]),
            "b": pa.array(np.concatenate([node[left][some], node[b]]), mask=np.arange(some.sum() + len(a)) < some.sum()),
            "links": np.concatenate([count[some], np.zeros(len(a), np.int64)]),
        })

    return blocks.groupBy(*cell, "i", "j").applyInArrow(link, "a long, b long, links long")


def vector_components(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, n_links, component) per row of ``vectors``.

    Two vectors of equal label and length link if their cosine, in double
    precision, is at least ``threshold``; the component is the smallest id
    reachable. Equal vectors are compared as one and counted by their copies;
    what is compared is the vector and not its id, so that an id in several rows
    ties none of them together: each row has the links and component of its own
    vector. A row of null id links and is counted like any other, but names no
    component; one of null ids alone is null. A null label, a null, empty or zero
    vector or a null or non-finite component links with nothing: no links, its
    own component. Other columns are not read. An empty table gives an empty table.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
        F.col(vector_col).cast("array<double>").alias("raw"),
    )
    is_usable = F.col("label").isNotNull() & _valid("raw")
    usable = rows.where(is_usable)
    # numbers are final once they are written
    groups = materialize(
        usable.groupBy("label", "raw").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id())
    )

    def unit(batches):
        for batch in batches:
            vectors_ = [list(_unit([v])[0]) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(v) for v in vectors_], pa.int32()), batch.column(2), batch.column(3),
                 pa.array(vectors_, pa.list_(pa.float64()))],
                names=["label", "width", "node", "copies", "vector"],
            )

    kind = rows.schema["label"].dataType.simpleString()
    nodes = materialize(
        groups.select("label", "raw", "node", "copies")
        .mapInArrow(unit, f"label {kind}, width int, node long, copies long, vector array<double>")
    )
    found = materialize(_block_links(_cells(nodes, threshold), threshold))
    linked = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    component = materialize(
        connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "a")
    )
    joined = groups.join(component, groups["node"] == component["a"], "left").drop("a")
    least = materialize(
        joined.where("component is not null").groupBy(F.col("component").alias("root")).agg(F.min("least").alias("smallest"))
    )
    # a component may hold most vectors: its row is looked up without a hot key
    named = (
        lookup(joined, least, "component", "root", ["smallest"], fits_broadcast(least))
        .join(linked, F.col("node") == linked["a"], "left")
        .select(
            "label", "raw", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("smallest")).alias("component"),
        )
    )
    inside = usable.join(named, ["label", "raw"]).select("id", "n_links", "component")
    outside = rows.where(~is_usable)
    return inside.unionByName(outside.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))


def op4_vectors(spark: SparkSession, folder: str) -> DataFrame:
    found = vector_components(table(spark, folder, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )
