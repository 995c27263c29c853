"""Lloyd's k-means with a choice of distance, all restarts in one pass over the points.

Points are ``(id, vec array<double>)``. Centroids are model-sized: they pass through the
driver between rounds, as in any distributed k-means, and reach the tasks as one broadcast a round.
Each task folds its points into one partial sum per (restart, centroid); only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from geotext.functions.distance import distance as distance_by_name
from geotext.session import cut

CENTROID_SCHEMA = "restart int, cid int, vec array<double>"

#: Parts in which each key's partial sums are folded, before the last fold.
FOLD_TASKS = 32

Model = dict[int, np.ndarray]  # restart -> centroids by cid


def _model(centroids: DataFrame) -> Model:
    """Centroids as arrays on the driver."""
    if "restart" not in centroids.columns:
        centroids = centroids.withColumn("restart", F.lit(0))
    rows = centroids.select("restart", "cid", "vec").toArrow().to_pandas().sort_values(["restart", "cid"])
    return {r: np.stack(group["vec"].to_numpy()).astype(float) for r, group in rows.groupby("restart")}


def _nearest(points: np.ndarray, centroids: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Index of and distance to the nearest centroid; ties go to the lowest index.

    A point at no distance from any centroid, such as the zero vector under cosine, gets -1 and NaN.
    """
    on_rows = distance_by_name(name).on_rows
    all_distances = np.stack([on_rows(points, c) for c in centroids], axis=1)
    lost = np.isnan(all_distances)
    cid = np.where(lost, np.inf, all_distances).argmin(axis=1)
    cid[lost.all(axis=1)] = -1
    return cid, all_distances[np.arange(len(points)), cid]


def kmeans_assign(
    points: DataFrame, centroids: DataFrame, distance: str = "euclidean", vec: str = "vec"
) -> DataFrame:
    """Add ``cid`` and ``d``: the nearest centroid of each point, and how far it is.

    Both are NULL for a point that has no distance to any centroid.
    """
    ((_, centres),) = _model(centroids).items()
    shared = points.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("cid int, d double")
    def nearest(vecs: pd.Series) -> pd.DataFrame:
        cid, d = _nearest(np.stack(vecs.to_numpy()), shared.value, distance)
        return pd.DataFrame({"cid": cid.astype("int32"), "d": d})

    found = F.col("_n")
    placed = found["d"].isNotNull() & ~F.isnan(found["d"])
    return points.withColumn("_n", nearest(F.col(vec))).select(
        *points.columns,
        F.when(placed, found["cid"]).alias("cid"),
        F.when(placed, found["d"]).alias("d"),
    )


def dispersion(assigned: DataFrame) -> DataFrame:
    """Sum of squared distances to the nearest centroid."""
    return assigned.agg(F.sum(F.col("d") * F.col("d")).alias("dispersion"))


def centroid_update(assigned: DataFrame, vec: str = "vec") -> DataFrame:
    """Mean of each cluster's members, whatever the distance: ``(cid, vec)``; points without a cluster count for none."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for cid, rows in batch.groupby("cid"):
                part = np.append(np.stack(rows[vec].to_numpy()).sum(axis=0), len(rows))
                sums[cid] = sums[cid] + part if cid in sums else part
        if sums:
            yield pd.DataFrame({"cid": list(sums), "sums": list(sums.values())})

    partial = assigned.select("cid", vec).dropna(subset=["cid"]).mapInPandas(fold, "cid int, sums array<double>")
    total = _added(partial, ["cid"])
    n = F.element_at("sums", -1)
    return total.select(
        "cid", F.transform(F.slice("sums", 1, F.size("sums") - 1), lambda x: x / n).alias("vec")
    )


def _added(partial: DataFrame, keys: list[str]) -> DataFrame:
    """Sum the arrays of each key, in two steps so that no task reads one row from every other."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *key, sums in batch[[*keys, "sums"]].itertuples(index=False):
                key = tuple(key)
                held[key] = held[key] + sums if key in held else np.array(sums)
        if held:
            yield pd.DataFrame([(*k, v) for k, v in held.items()], columns=[*keys, "sums"])

    # An exchange, not a coalesce: that would make so few tasks read the points as well.
    dealt = partial.withColumn("_part", F.pmod(F.spark_partition_id(), FOLD_TASKS)).repartition(FOLD_TASKS, *keys, "_part")
    few = dealt.drop("_part").mapInPandas(add, partial.schema)
    return few.repartition(*keys).mapInPandas(add, partial.schema)


def sample_k(points: DataFrame, k: int, restarts: int = 1, seed: int = 0, id: str = "id", vec: str = "vec") -> DataFrame:
    """Per restart, k distinct points picked by a hash of (seed, restart, id), or all if fewer.

    One scan serves every restart: a point is kept for a restart only if its hash is among
    the lowest few, and the cut-off is raised until each restart has k. The picks depend on
    the ids alone, not on the partitioning.
    """
    total = points.count()
    wanted = min(k, total)
    share = min(1.0, 4.0 * (k + 10) / max(total, 1))
    while True:
        limit = int((share - 0.5) * 2**64) if share < 1 else 2**63 - 1
        ranked = F.transform(
            F.sequence(F.lit(0), F.lit(restarts - 1)),
            lambda r: F.struct(
                r.alias("restart"), F.xxhash64(F.lit(seed), r, F.col(id)).alias("rank")
            ),
        )
        low = points.select(
            id, vec, F.inline(F.filter(ranked, lambda x: x["rank"] <= F.lit(limit)))
        )
        picked = low.groupBy("restart").agg(
            # At most a few times k entries per restart pass the cut-off.
            F.slice(F.sort_array(F.collect_list(F.struct("rank", id, vec))), 1, k).alias("picks")
        )
        picked = cut(picked)
        enough = picked.where(F.size("picks") >= wanted).count() == restarts
        if enough or share >= 1.0:
            return picked.select("restart", F.posexplode("picks").alias("cid", "p")).select(
                "restart", "cid", F.col(f"p.{id}").alias(id), F.col(f"p.{vec}").alias("vec")
            )
        share = min(1.0, share * 4)


def lloyd_round(points: DataFrame, model: Model, distance: str, vec: str = "vec") -> DataFrame:
    """One pass: ``(restart, cid, sums)``, the sums being count, dispersion, then the coordinates.

    Points that have no distance to any centroid are counted under ``cid`` -1 and nowhere else.
    """
    shared = points.sparkSession.sparkContext.broadcast(model)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        partial = {r: np.zeros((len(c) + 1, c.shape[1] + 2)) for r, c in shared.value.items()}
        for batch in batches:
            if batch.empty:
                continue
            rows = np.stack(batch[vec].to_numpy())
            for r, centres in shared.value.items():
                cid, d = _nearest(rows, centres, distance)
                member = np.zeros((len(centres) + 1, len(rows)))
                member[cid, np.arange(len(rows))] = 1  # -1 is the last row
                numbers = np.c_[np.ones(len(rows)), np.nan_to_num(d * d), rows]
                partial[r] += member @ numbers
        for r, sums in partial.items():
            cids = [*range(len(sums) - 1), -1]
            sums[-1, 1:] = 0
            yield pd.DataFrame({"restart": r, "cid": cids, "sums": list(sums)})

    partial = points.select(vec).mapInPandas(fold, "restart int, cid int, sums array<double>")
    return _added(partial, ["restart", "cid"])


@dataclass(frozen=True)
class KmeansResult:
    """The best restart, and how every restart ended."""

    restart: int
    dispersion: float  # against the centroids before the last move
    final_dispersion: float  # against the centroids after it
    without_cluster: int  # points that have no distance to any centroid
    centroids: DataFrame  # (cid, vec) of the best restart, after the last move
    restarts: DataFrame  # (restart, dispersion, rounds)


def kmeans_lloyd(
    points: DataFrame,
    k: int,
    distance: str = "euclidean",
    restarts: int = 25,
    seed: int = 13,
    max_rounds: int = 100,
    min_change: float = 1e-4,
    starts: DataFrame | None = None,
    empty: str = "keep",
    id: str = "id",
    vec: str = "vec",
) -> KmeansResult:
    """Move centroids until the dispersion changes by at most ``min_change``, or for ``max_rounds``.

    ``starts`` gives the first centroids ``(restart, cid, vec)``; else k points are drawn per
    restart. A cluster left without members keeps its centroid, or leaves the model with
    ``empty="drop"``. Points that have no distance to any centroid, such as zero vectors under cosine, have no
    cluster and no part in the dispersion. Restarts that have settled are not computed again. Every round reads
    ``points`` once: cache the table if it is costly to read.
    """
    if empty not in ("keep", "drop"):
        raise ValueError(f"unknown rule for empty clusters {empty!r}")
    if starts is None:
        starts = sample_k(points, k, restarts, seed, id, vec)
    live = _model(starts)
    done: Model = {}
    last = {r: float("inf") for r in live}
    rounds = dict.fromkeys(live, 0)
    while live:
        stats, lost = _stats(points, live, distance, vec)
        moved = {}
        for r, centres in live.items():
            count, total = stats[r][:, :1], float(stats[r][:, 1].sum())
            has = count[:, 0] > 0
            means = stats[r][has, 2:] / count[has]
            if empty == "drop":
                centres = means
            else:
                centres = centres.copy()
                centres[has] = means
            rounds[r] += 1
            settled = abs(last[r] - total) <= min_change or rounds[r] >= max_rounds
            last[r] = total
            (done if settled else moved)[r] = centres
        live = moved
    best = min(last, key=lambda r: (last[r], r))
    spark = points.sparkSession
    centroids = [(i, v.tolist()) for i, v in enumerate(done[best])]
    final, lost = _stats(points, {best: done[best]}, distance, vec)
    return KmeansResult(
        best,
        last[best],
        float(final[best][:, 1].sum()),
        lost[best],
        spark.createDataFrame(centroids, "cid int, vec array<double>"),
        spark.createDataFrame(
            [(r, last[r], rounds[r]) for r in sorted(last)],
            "restart int, dispersion double, rounds int",
        ),
    )


def _stats(points: DataFrame, model: Model, distance: str, vec: str) -> tuple[Model, dict[int, int]]:
    """Sums per restart and centroid of one pass, as large as the model, and points without a cluster."""
    stats: Model = {r: np.zeros((len(c), c.shape[1] + 2)) for r, c in model.items()}
    lost = dict.fromkeys(model, 0)
    for r, cid, sums in lloyd_round(points, model, distance, vec).toArrow().to_pandas().itertuples(index=False):
        if cid < 0:
            lost[r] = int(sums[0])
        else:
            stats[r][cid] = sums
    return stats, lost


def best_restart(restarts: DataFrame) -> DataFrame:
    """The restart with the lowest dispersion, the first one on ties."""
    return restarts.orderBy("dispersion", "restart").limit(1)
