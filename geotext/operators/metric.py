"""Pairs of close vectors of any length, by exact partitioning of a metric space.

Vectors are dealt to the nearest of some pivots. One that lies ``r`` from its own pivot has neighbours only in
cells whose pivot is nearer than ``r + 2 eps``, and nearer than ``eps`` beyond the farthest member of that cell: both
follow from the triangle inequality. It visits those cells, where it is compared with the members. Cells with too
many members are dealt again by pivots of their own; one that no pivots divide, because its vectors
lie as close as copies, becomes a square of blocks. No pair is lost and no task takes more than a block.

Where only some rows ask for their neighbours, the others stay in their own cells; few that ask are sent to all
rows instead. Blocks are compared by a matrix product, and what lies within its rounding of eps by the distance itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from geotext.functions.distance import Distance, distance as distance_by_name
from geotext.session import cut

#: Members of a cell that one task compares with as many visitors.
CELL_ROWS = 2_000
#: Pivots sent to the workers at once. Cells beyond that are divided by the next job.
PIVOTS = 4_096
#: A cell is given up as undividable if a part of it keeps this share.
SHARE_KEPT = 0.9

#: Rows that are sent to the workers at once, to meet every other row.
BATCH = 4_096
#: Rows that meet a batch at a time: with it a table of some 30 MB.
CHUNK = 1_024

#: Widens bounds beyond the rounding of distances.
SLACK = 1e-9


@dataclass(frozen=True)
class Space:
    """One distance and the metric that bounds it: cosine is bounded by the chord of unit vectors."""

    distance: Distance

    def embed(self, rows: np.ndarray) -> np.ndarray:
        if self.distance.name != "cosine":
            return rows
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(norms == 0, np.nan, rows / norms)

    def reach(self, eps: float) -> float:
        """The metric's length that no vectors closer than eps exceed."""
        return (np.sqrt(2 * eps) if self.distance.name == "cosine" else eps) * (1 + SLACK) + SLACK

    def lengths(self, rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
        if self.distance.name == "cosine":
            return np.sqrt(((rows - centre) ** 2).sum(axis=1))
        return self.distance.on_rows(rows, centre)

    def table(self, rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.stack([self.lengths(rows, c) for c in centres], axis=1)

    def near(self, rows: np.ndarray, centres: np.ndarray, eps: float) -> np.ndarray:
        """Which rows are strictly closer than eps to which centres: a table of booleans."""
        on_rows = self.distance.on_rows
        if self.distance.name not in ("euclidean", "cosine"):
            return np.stack([on_rows(rows, c) < eps for c in centres], axis=1)
        a, b = self.embed(rows), self.embed(centres)
        sizes = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]
        beyond = sizes - 2 * (a @ b.T) - (2 * eps if self.distance.name == "cosine" else eps * eps)
        found = beyond < 0
        # What a sum of so many products may be off by. NaN and infinity are unsure too.
        unsure = ~(np.abs(beyond) > (8 * rows.shape[1] + 64) * np.finfo(float).eps * (sizes + eps * eps))
        for k in np.flatnonzero(unsure.any(axis=0)).tolist():
            at = np.flatnonzero(unsure[:, k])
            found[at, k] = on_rows(rows[at], centres[k]) < eps
        return found


def vectors_of(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def in_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for start in range(0, len(pdf), CHUNK):
            yield pdf.iloc[start : start + CHUNK]


def close_vectors(
    points: DataFrame,
    eps: float,
    distance: str | Distance = "euclidean",
    cell_rows: int | None = None,
    ask: str | None = None,
) -> DataFrame:
    """All ordered pairs ``(i, j, d)`` of ``points (id, vec)``, i <> j, strictly closer than eps.

    ``ask`` names a boolean column of the rows that are to be ``i``; all are without it.

    ``id`` must be unique. Null vectors, and those at no distance from any other (zero under cosine, NaN inside),
    are in no pair. Any metric of ``functions.distance`` serves. Where eps is as wide as the data nothing
    can be pruned: every vector visits every cell.
    """
    asked = F.col(ask) if ask else F.lit(True)
    rows = points.select("id", F.col("id").alias("part"), "vec", asked.alias("ask"))
    return _close(rows, eps, distance, cell_rows, ask is not None, False)


def close_parts(points: DataFrame, eps: float, distance: str | Distance, cell_rows: int | None = None) -> DataFrame:
    """Different pairs ``(i, j)`` of parts of ``points (id, part, vec, ask)`` with rows closer than eps, ``i``'s one asking."""
    return _close(points.select("id", "part", "vec", "ask"), eps, distance, cell_rows, True, True).distinct()


def _close(rows: DataFrame, eps: float, distance, cell_rows: int | None, some: bool, parts: bool) -> DataFrame:
    """Pairs of rows of different parts, or with ``parts`` the pairs of these parts; ``some``: not all rows ask."""
    cell_rows = cell_rows or CELL_ROWS
    space = Space(distance_by_name(distance) if isinstance(distance, str) else distance)
    if eps <= 0:
        raise ValueError("eps must be positive")
    norm = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)
    usable = norm > 0 if space.distance.name == "cosine" else norm >= 0
    rows = rows.withColumn("vec", F.col("vec").cast("array<double>")).where(usable & ~F.isnan(norm))
    if some:
        rows = cut(rows)
        few = rows.where("ask").limit(BATCH + 1).select("id", "part", "vec").toPandas()
        if len(few) <= BATCH:
            return _asked(rows, few, space, eps, parts)
    rows = cut(rows.select(F.lit("").alias("cell"), "id", "part", "vec", F.lit(True).alias("home"), "ask"))
    stuck: set[str] = set()
    turn = 0
    while True:
        counts = rows.where("home").groupBy("cell").count().where(F.col("count") > cell_rows)
        # As many as cell_rows goes into the table, at most; only those that get pivots reach the driver.
        if stuck:
            counts = counts.where(~F.col("cell").isin(sorted(stuck)))
        largest = {r["cell"]: r["count"] for r in counts.orderBy(F.desc("count"), "cell").limit(PIVOTS // 2).collect()}
        if not largest:
            break
        turn += 1
        pivots = _pivots(rows, largest, cell_rows, turn, space)
        if not pivots:
            stuck.update(largest)
            continue
        rows, undivided = _divided(rows, pivots, largest, space, eps)
        stuck.update(undivided)
    return _compared(rows, space, eps, cell_rows, parts)


def _schema(parts: bool) -> str:
    return "i long, j long" if parts else "i long, j long, d double"


def _pairs(asking: pd.DataFrame, there: np.ndarray, members: pd.DataFrame, space: Space, eps: float, parts: bool) -> pd.DataFrame:
    """Close pairs of different parts; ``there`` are the vectors of those who ask."""
    own, other = asking["part"].to_numpy(), members["part"].to_numpy()
    centres = vectors_of(members["vec"])
    near = space.near(there, centres, eps) & (own[:, None] != other[None, :])
    if parts:
        i, j = np.nonzero(near)
        return pd.DataFrame({"i": own[i], "j": other[j]}).drop_duplicates()
    j, i = np.nonzero(near.T)
    at, starts = np.unique(j, return_index=True)
    groups = zip(at.tolist(), np.split(i, starts[1:]), strict=True) if len(at) else ()
    d = [space.distance.on_rows(there[some], centres[k]) for k, some in groups]
    ids, others = asking["id"].to_numpy(), members["id"].to_numpy()
    return pd.DataFrame({"i": ids[i], "j": others[j], "d": np.concatenate(d) if d else np.zeros(0)})


def _asked(rows: DataFrame, few: pd.DataFrame, space: Space, eps: float, parts: bool) -> DataFrame:
    """A batch that asks against every row."""
    if few.empty:
        return rows.sparkSession.createDataFrame([], _schema(parts))
    known = rows.sparkSession.sparkContext.broadcast((few[["id", "part"]], vectors_of(few["vec"])))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for members in in_chunks(batches):
            yield _pairs(*known.value, members, space, eps, parts)

    return rows.select("id", "part", "vec").mapInPandas(compare, _schema(parts))


def _pivots(rows: DataFrame, sizes: dict[str, int], cell_rows: int, turn: int, space: Space) -> dict[str, np.ndarray]:
    """Some members of each cell, picked by a hash of their ids: twice as many as the cells that are wanted."""
    wanted, left = {}, PIVOTS
    for cell, n in sizes.items():
        take = min(2 * -(-n // cell_rows), 256, left)
        if take < 2:
            break
        wanted[cell] = take / n
        left -= take
    spark = rows.sparkSession
    share = F.broadcast(spark.createDataFrame(list(wanted.items()), "cell string, share double"))
    drawn = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 << 30)) / (1 << 30)
    picked = rows.where("home").join(share, "cell").where(drawn < F.col("share")).select("cell", "vec").limit(2 * PIVOTS).toPandas()
    found = {}
    for cell, group in picked.groupby("cell"):
        centres = np.unique(space.embed(np.stack(group["vec"].to_numpy()).astype(float)), axis=0)
        if len(centres) > 1:
            found[cell] = centres
    return found


def _divided(rows, pivots, sizes, space: Space, eps: float) -> tuple[DataFrame, list[str]]:
    """The cells with pivots dealt anew, and names of parts that kept nearly all of their cell."""
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast(pivots)
    chosen = F.col("cell").isin(sorted(pivots))
    whole = rows.where(chosen)

    def radii(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        far: dict[str, tuple[float, int]] = {}
        for pdf in batches:
            for cell, group in pdf.groupby("cell"):
                lengths = space.table(space.embed(np.stack(group["vec"].to_numpy())), known.value[cell])
                nearest = lengths.argmin(axis=1)
                for k in np.unique(nearest).tolist():
                    at, n = far.get(f"{cell}/{k}", (0.0, 0))
                    far[f"{cell}/{k}"] = max(at, float(lengths[nearest == k, k].max())), n + int((nearest == k).sum())
        yield pd.DataFrame([(c, at, n) for c, (at, n) in far.items()], columns=["cell", "radius", "n"])

    found = whole.where("home").mapInPandas(radii, "cell string, radius double, n long")
    found = found.groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect()  # one row per pivot
    radius = spark.sparkContext.broadcast({r["cell"]: r["radius"] for r in found})
    undivided = [r["cell"] for r in found if r["n"] > SHARE_KEPT * sizes[r["cell"].rsplit("/", 1)[0]]]
    reach = space.reach(eps)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cell, group in pdf.groupby("cell"):
                lengths = space.table(space.embed(np.stack(group["vec"].to_numpy())), known.value[cell])
                nearest = lengths.argmin(axis=1)
                own = lengths.min(axis=1)
                for k in range(lengths.shape[1]):
                    name = f"{cell}/{k}"
                    if name not in radius.value:
                        continue  # a pivot that is nearest to no member
                    at = lengths[:, k]
                    near = (at <= (radius.value[name] + reach) * (1 + SLACK)) & (at <= (own + 2 * reach) * (1 + SLACK))
                    near &= group["ask"].to_numpy() | (nearest == k)
                    some = group[near]
                    if len(some):
                        yield some.assign(cell=name, home=some["home"].to_numpy() & (nearest[near] == k))

    dealt = whole.mapInPandas(deal, rows.schema)
    return cut(rows.where(~chosen).unionByName(dealt)), undivided


def _compared(rows: DataFrame, space: Space, eps: float, cell_rows: int, parts: bool) -> DataFrame:
    """Members against visitors that ask, themselves among these, in blocks of bounded size."""
    sizes = rows.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count_if("ask").alias("visitors"))
    sized = rows.join(sizes.where("homes > 0 AND visitors > 0"), "cell")
    blocks = {side: F.ceil(F.col(side) / cell_rows).cast("int") for side in ("homes", "visitors")}
    part = {side: F.pmod(F.xxhash64("id"), n).cast("int") for side, n in blocks.items()}
    every = {side: F.explode(F.sequence(F.lit(0), n - 1)) for side, n in blocks.items()}
    own, visit = [part["homes"].alias("p"), every["visitors"].alias("q")], [every["homes"].alias("p"), part["visitors"].alias("q")]
    member = sized.where("home").select("cell", *own, "id", "part", "vec", F.lit(True).alias("home"))
    visitor = sized.where("ask").select("cell", *visit, "id", "part", "vec", F.lit(False).alias("home"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        asking = pdf[~pdf["home"]]
        found = [pd.DataFrame({"i": [], "j": []} if parts else {"i": [], "j": [], "d": []})]
        if len(asking):
            there = vectors_of(asking["vec"])
            found += [_pairs(asking, there, m, space, eps, parts) for m in in_chunks([pdf[pdf["home"]]])]
        return pd.concat(found[1:] or found, ignore_index=True)

    both = member.unionByName(visitor)
    return both.groupBy("cell", "p", "q").applyInPandas(compare, _schema(parts))
