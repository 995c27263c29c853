"""Fill-in-the-middle: texts are cut at two line ranks, found by descent in an indexable skip list."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from geotext.llm.common import query, table

SEED = 7
#: Of 100 documents so many are cut, and of these so many have their suffix first.
CUT_PERCENT = 100
SUFFIX_FIRST_PERCENT = 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # fixed values of the mixing steps


def tower_heights(n: int) -> np.ndarray:
    """How many express lanes each of n units stands on: one in four climbs each time, by a mix of its place."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_MIX[0])
    x = (x ^ x >> np.uint64(30)) * np.uint64(_MIX[1])
    x = (x ^ x >> np.uint64(27)) * np.uint64(_MIX[2])
    x ^= x >> np.uint64(31)
    lowest = np.where(x == 0, np.uint64(1) << np.uint64(63), x & (~x + np.uint64(1)))
    return np.bitwise_count(lowest - np.uint64(1)) // 2


CUTS = StructType([StructField(name, LongType()) for name in ("n", "low", "high")])


class SkipList:
    """Units of text in order. A link of a lane carries the units and the code points that it passes.

    The lowest lane links unit to unit. Each lane above links the units that climb to it; the widths of its
    links are sums of the widths of the links below.
    """

    def __init__(self, widths: Sequence[int]) -> None:
        points = np.asarray(widths, np.int64)
        units = np.ones(points.size, np.int64)
        heights = tower_heights(points.size)
        self.size = int(points.size)
        #: From the lowest lane up: per link the unit it ends at, the units and the code points passed.
        self.lanes: list[tuple[np.ndarray, np.ndarray]] = [(units, points)]
        #: Place in the lane below of the link that follows the end of a lane's link.
        self.down: list[np.ndarray] = [np.zeros(0, np.int64)]
        while units.size > 4:
            ends = np.flatnonzero(heights >= len(self.lanes))  # links below that end on a climbing unit
            if ends.size == 0 or ends.size == units.size:
                break
            starts = np.concatenate([[0], ends[:-1] + 1])
            stop = int(ends[-1]) + 1
            units = np.add.reduceat(units[:stop], starts)
            points = np.add.reduceat(points[:stop], starts)
            heights = heights[ends]
            self.lanes.append((units, points))
            self.down.append(ends + 1)

    def points_before(self, rank: int) -> int:
        """Code points of the first ``rank`` units: along each lane while its next link does not pass the rank."""
        if not 0 <= rank <= self.size:
            raise IndexError(rank)
        passed = reached = at = 0  # units, code points, and the next link of the lane
        for lane in range(len(self.lanes) - 1, -1, -1):
            units, points = self.lanes[lane]
            while at < units.size and passed + units[at] <= rank:
                passed += int(units[at])
                reached += int(points[at])
                at += 1
            if lane:
                at = int(self.down[lane][at - 1]) if at else 0
        return reached


def line_widths(text: str) -> list[int]:
    """Code points of each line, its line end included; a last line without one counts, an empty one does not."""
    widths = [len(line) + 1 for line in text.split("\n")]
    widths[-1] -= 1
    return widths if widths[-1] else widths[:-1]


@F.pandas_udf(CUTS)
def _cuts(texts: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    rows = []
    for text, a, b in zip(texts, first, second, strict=True):
        units = SkipList(line_widths(text or ""))
        low, high = sorted((int(a) % (units.size + 1), int(b) % (units.size + 1)))
        rows.append((units.size, units.points_before(low), units.points_before(high)))
    return pd.DataFrame(rows, columns=["n", "low", "high"], dtype="int64")


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed and id; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    cut_percent: int = CUT_PERCENT,
    suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``, one row per row of ``docs``.

    The two cuts lie at line ranks drawn from the id, so equal ids of one text are cut alike. ``form`` is
    ``psm`` or ``spm``, or ``plain`` (the text as it is, no lengths) for texts that are empty, hold one of the
    marks, or are not drawn to be cut. Null counts as the empty text. Only id and text are read, so other
    columns, whatever their names, do not matter. Rows do not move.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(doc_id), seed)
    marked = F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE))
    plain = (whole == "") | marked | (h3 % 100 >= cut_percent)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first_percent, "spm").otherwise("psm")
    made = docs.select(
        F.col(doc_id).alias("doc_id"), whole.alias("text"), form.alias("form"), _cuts(whole, h1, h2).alias("cuts")
    )
    low, high, is_plain = F.col("cuts.low"), F.col("cuts.high"), F.col("form") == "plain"
    prefix = F.substring("text", F.lit(1), low.cast("int"))
    middle = F.substring("text", (low + 1).cast("int"), (high - low).cast("int"))
    suffix = F.substring("text", (high + 1).cast("int"), F.length("text"))
    output = (
        F.when(is_plain, F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    return made.select(
        "doc_id",
        F.col("cuts.n").alias("n"),
        "form",
        F.when(~is_plain, low).alias("prefix_chars"),
        F.when(~is_plain, high - low).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text again. A mark ends in a letter and a bracket that no text part holds after it, so each is found once."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .otherwise(F.concat(parts[2], parts[3], parts[1]))
    )


SQL = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (
  SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
    list_transform([1, 9, 17, 25], lambda k: CAST('0x' || h[k:k + 7] AS BIGINT)) AS d FROM h),
c AS (
  SELECT *, CAST(len(lines) AS BIGINT) AS n, least(d[1] % (len(lines) + 1), d[2] % (len(lines) + 1)) AS lo,
    greatest(d[1] % (len(lines) + 1), d[2] % (len(lines) + 1)) AS hi FROM r),
p AS (
  SELECT *, coalesce(array_to_string(lines[1:lo], ''), '') AS prefix, coalesce(array_to_string(lines[lo + 1:hi], ''), '') AS middle,
    coalesce(array_to_string(lines[hi + 1:], ''), '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 100
      THEN 'plain' WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""


@query("op12_skip_list_fim", SQL)
def op12_skip_list_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents", "doc_id", "text"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
