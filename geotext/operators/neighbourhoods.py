"""Density clustering over a given neighbourhood: a table of pairs, whatever rule or distance made it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from geotext.functions.distance import distance as distance_by_name
from geotext.operators import metric
from geotext.operators.components import connected_components
from geotext.operators.metric import Space, close_parts, close_vectors, in_chunks, vectors_of
from geotext.operators.skew import attach
from geotext.session import cut


def cluster_pairs(vertices: DataFrame, pairs: DataFrame, min_neighbours: int, mode: str = "one_hop") -> DataFrame:
    """``(id, cluster_id)`` of ``vertices (id, weight)`` that ``pairs (i, j)`` make neighbours; noise left out.

    A vertex stands for ``weight`` points at one place. ``j`` is a neighbour of ``i``; pairs come once each, and in
    both directions where the rule is symmetric. A vertex is core with ``min_neighbours`` other points near it.

    ``one_hop``: cores in id order, each opening a cluster unless an earlier seed has it as neighbour. A round takes all
    cores that no earlier undecided one is near, so rounds follow the longest chain of cores in id order.
    ``dbscan``: components of cores, other vertices to the lowest cluster near. The lowest id names a cluster.
    """
    if mode not in ("one_hop", "dbscan"):
        raise ValueError(f"unknown mode {mode!r}")
    if min_neighbours < 1:
        raise ValueError("min_neighbours must be at least 1")
    pairs = cut(pairs.select("i", "j"))
    weights = vertices.select(F.col("id").alias("j"), F.col("weight").alias("_near"))
    near = attach(pairs, weights, ["j"]).groupBy("i").agg(F.sum("_near").alias("_near"))
    counted = vertices.select("id", "weight").join(near.withColumnRenamed("i", "id"), "id", "left")
    cores = cut(counted.where(F.col("weight") - 1 + F.coalesce("_near", F.lit(0)) >= min_neighbours).select("id"))
    # Pairs that start at a core: what a core makes its neighbours.
    reached = cut(attach(pairs, cores.withColumnRenamed("id", "i"), ["i"]))
    own = _seeds(cores, reached) if mode == "one_hop" else _components(cores, reached)
    labels = attach(reached, own.withColumnRenamed("id", "i"), ["i"]).select(F.col("j").alias("id"), "cluster_id")
    lowest = labels.groupBy("id").agg(F.min("cluster_id").alias("_reached"))
    joined = own.join(lowest, "id", "full_outer")
    return joined.select("id", F.coalesce("cluster_id", "_reached").alias("cluster_id"))


def _seeds(cores: DataFrame, reached: DataFrame) -> DataFrame:
    """``(id, cluster_id)`` of the seeds: first come, in rounds over what is undecided."""
    as_j = cores.withColumnRenamed("id", "j")
    links = cut(attach(reached, as_j, ["j"]))  # between cores
    undecided, found = cores, cut(cores.limit(0))
    while not undecided.isEmpty():
        ahead = attach(links.where("i < j"), undecided.withColumnRenamed("id", "i"), ["i"])
        waiting = ahead.select(F.col("j").alias("id")).distinct()
        new = cut(undecided.join(waiting, "id", "left_anti"))
        found = cut(found.unionByName(new))
        covered = attach(links, new.withColumnRenamed("id", "i"), ["i"]).select(F.col("j").alias("id")).distinct()
        undecided = cut(undecided.join(new.unionByName(covered).distinct(), "id", "left_anti"))
        links = cut(attach(attach(links, undecided.withColumnRenamed("id", "i"), ["i"]), undecided.withColumnRenamed("id", "j"), ["j"]))
    return found.withColumn("cluster_id", F.col("id"))


def _components(cores: DataFrame, reached: DataFrame) -> DataFrame:
    edges = attach(reached, cores.withColumnRenamed("id", "j"), ["j"]).select(F.col("i").alias("a"), F.col("j").alias("b"))
    roots = connected_components(edges, []).select(F.col("v").alias("id"), F.col("root").alias("cluster_id"))
    labelled = attach(cores, roots, ["id"], "left")
    return labelled.select("id", F.coalesce("cluster_id", "id").alias("cluster_id"))


def cluster_vectors(
    points: DataFrame,
    eps: float,
    min_neighbours: int,
    mode: str = "one_hop",
    distance: str = "euclidean",
    cell_rows: int | None = None,
) -> DataFrame:
    """Density clusters of vectors of any length: ``(id, cluster_id)`` of ``points (id, vec)``, noise left out.

    Copies of one vector count as neighbours of each other and are compared once. A vector without any distance (null,
    NaN, zero under cosine) is noise, its copies too.

    Pairs are listed for vectors with few neighbours only. A batch of vectors settles who has enough neighbours, as
    far as it holds them; seeds are found in batches of cores in id order, each of which takes what its seeds
    are near out of the table; and components of seeds are joined by pairs between different ones.
    """
    if mode not in ("one_hop", "dbscan"):
        raise ValueError(f"unknown mode {mode!r}")
    if min_neighbours < 1:
        raise ValueError("min_neighbours must be at least 1")
    if eps <= 0:
        raise ValueError("eps must be positive")
    points = points.select("id", F.col("vec").cast("array<double>").alias("vec")).where("vec IS NOT NULL")
    sites = cut(points.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")))
    norm = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)
    usable = (norm > 0 if distance == "cosine" else norm >= 0) & ~F.isnan(norm)
    sites = sites.where(usable & F.col("id").isNotNull())
    space = Space(distance_by_name(distance))
    marked, pairs = _marked(sites, eps, min_neighbours, space, cell_rows)
    cores = marked.where("core").select("id", "vec")
    own = _led(cores, eps, space, cell_rows)
    if mode == "dbscan":
        own = _joined(cores.join(own, "id"), eps, space, cell_rows)
    # What is no core has all its pairs listed: under one_hop seeds name it, else any core.
    naming = own.where("id = cluster_id") if mode == "one_hop" else own
    others = marked.where("NOT core").select("id")
    listed = pairs.withColumnRenamed("i", "id").join(others, "id")
    border = attach(listed, naming.withColumnRenamed("id", "j"), ["j"]).groupBy("id").agg(F.min("cluster_id").alias("cluster_id"))
    named = sites.join(own.unionByName(border), "id").select("vec", "weight", "cluster_id")
    return attach(points, named, ["vec"], count="weight").select("id", "cluster_id")


def _marked(sites: DataFrame, eps: float, min_neighbours: int, space: Space, cell_rows: int | None) -> tuple[DataFrame, DataFrame]:
    """``(id, vec, core)``, and all pairs ``(i, j)`` of sites for which a batch of sites does not hold enough neighbours."""
    few = sites.orderBy(F.xxhash64("id"), "id").limit(metric.BATCH).select("id", "weight", "vec").toPandas()
    if few.empty:
        none = sites.sparkSession.createDataFrame([], "i long, j long")
        return sites.select("id", "vec", F.lit(False).alias("core")), none
    known = sites.sparkSession.sparkContext.broadcast(
        (few["id"].to_numpy(), few["weight"].to_numpy().astype(float), vectors_of(few["vec"]))
    )

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, weights, there = known.value
        for some in in_chunks(batches):
            near = space.near(vectors_of(some["vec"]), there, eps) & (some["id"].to_numpy()[:, None] != ids[None, :])
            yield some.assign(ask=some["weight"].to_numpy() - 1 + near @ weights < min_neighbours)

    probed = sites.select("id", "weight", "vec").mapInPandas(probe, "id long, weight long, vec array<double>, ask boolean")
    probed = cut(probed)
    pairs = cut(close_vectors(probed, eps, space.distance, cell_rows, ask="ask").select("i", "j"))
    weights = probed.select(F.col("id").alias("j"), F.col("weight").alias("_near"))
    near = attach(pairs, weights, ["j"]).groupBy(F.col("i").alias("id")).agg(F.sum("_near").alias("_near"))
    enough = F.col("weight") - 1 + F.coalesce("_near", F.lit(0)) >= min_neighbours
    return cut(probed.join(near, "id", "left").select("id", "vec", (~F.col("ask") | enough).alias("core"))), pairs


def _led(cores: DataFrame, eps: float, space: Space, cell_rows: int | None) -> DataFrame:
    """``(id, cluster_id)``: the lowest seed near each core, seeds being those no earlier seed is near.

    A batch holds the lowest cores left, so its seeds come before all later ones. Batches stop once they no longer take an
    eighth of what is left: then it is thin, and its pairs are listed.
    """
    spark = cores.sparkSession
    left, n, found = cores, cores.count(), []
    while n:
        batch = left.orderBy("id").limit(metric.BATCH).toPandas()
        there = vectors_of(batch["vec"])
        seeds = _first_come(there, space, eps)
        known = spark.sparkContext.broadcast((batch["id"].to_numpy()[seeds], there[seeds]))

        def lead(batches: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            ids, there = known.value
            for some in in_chunks(batches):
                near = space.near(vectors_of(some["vec"]), there, eps)
                # A seed is near itself, whatever its distance is rounded to.
                near |= some["id"].to_numpy()[:, None] == ids[None, :]
                lowest = pd.Series(ids[near.argmax(axis=1)], index=some.index, dtype="Int64")
                yield some.assign(cluster_id=lowest.where(near.any(axis=1)))

        led = cut(left.mapInPandas(lead, "id long, vec array<double>, cluster_id long"))
        found.append(led.where("cluster_id IS NOT NULL").select("id", "cluster_id"))
        left, before = led.where("cluster_id IS NULL").select("id", "vec"), n
        n = left.count()
        if n and (before - n) * 8 < before:
            pairs = cut(close_vectors(left, eps, space.distance, cell_rows).select("i", "j"))
            seeds = _seeds(cut(left.select("id")), pairs)
            labels = attach(pairs, seeds.withColumnRenamed("id", "i"), ["i"]).select(F.col("j").alias("id"), "cluster_id")
            found.append(labels.unionByName(seeds).groupBy("id").agg(F.min("cluster_id").alias("cluster_id")))
            break
    if not found:
        return cores.select("id", F.col("id").alias("cluster_id"))
    own = found[0]
    for more in found[1:]:
        own = own.unionByName(more)
    return cut(own)


def _first_come(vectors: np.ndarray, space: Space, eps: float) -> np.ndarray:
    """Places of the vectors that no earlier one of these is near."""
    near = space.near(vectors, vectors, eps)
    free, seeds = np.ones(len(vectors), dtype=bool), []
    for k in range(len(vectors)):
        if free[k]:
            seeds.append(k)
            free &= ~near[:, k]
    return np.array(seeds, dtype=int)


def _joined(cores: DataFrame, eps: float, space: Space, cell_rows: int | None) -> DataFrame:
    """``(id, cluster_id)``: components of ``cores (id, vec, cluster_id)``, each of which is near the seed it has.

    Links of cores to the lowest seeds come first, folded in tasks. Then cores outside the largest component
    are compared with those of other components, which leaves no link out.
    """
    spark = cores.sparkSession
    cores = cut(cores)
    few = cores.where("id = cluster_id").orderBy("id").limit(metric.BATCH).select("id", "vec").toPandas()
    if few.empty:
        return cores.select("id", "cluster_id")
    known = spark.sparkContext.broadcast((few["id"].to_numpy(), vectors_of(few["vec"])))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, there = known.value
        linked = np.eye(len(ids), dtype=bool)
        for some in in_chunks(batches):
            seed = some["cluster_id"].to_numpy()
            some, at = some[np.isin(seed, ids)], np.searchsorted(ids, seed[np.isin(seed, ids)])
            if len(some):
                row, to = np.nonzero(space.near(vectors_of(some["vec"]), there, eps))
                linked[at[row], to] = linked[to, at[row]] = True
        lowest = np.arange(len(ids))
        while True:
            lower = np.array([lowest[row].min() for row in linked])
            if (lower == lowest).all():
                break
            lowest = lower
        moved = lowest < np.arange(len(ids))
        yield pd.DataFrame({"a": ids[moved], "b": ids[lowest[moved]]})

    part = _contracted(cores, cores.select("id", "vec", "cluster_id").mapInPandas(link, "a long, b long"))
    largest = part.groupBy("part").count().orderBy(F.desc("count"), "part").limit(2).collect()
    if len(largest) > 1:
        asking = part.select("id", "part", "vec", (F.col("part") != largest[0]["part"]).alias("ask"))
        met = close_parts(asking, eps, space.distance, cell_rows)
        part = _contracted(part.withColumnRenamed("part", "cluster_id"), met.select(F.col("i").alias("a"), F.col("j").alias("b")))
    # Parts are named by their lowest seed, and the lowest core of a component is a seed.
    return part.select("id", F.col("part").alias("cluster_id"))


def _contracted(cores: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, vec, part)``: the lowest label that ``edges (a, b)`` join to each core's ``cluster_id``."""
    roots = connected_components(edges, []).select(F.col("v").alias("cluster_id"), F.col("root").alias("part"))
    joined = attach(cores, roots, ["cluster_id"], "left")
    return cut(joined.select("id", "vec", F.coalesce("part", "cluster_id").alias("part")))
