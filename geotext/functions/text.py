"""Tokens and hashed term counts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def tokenize(text) -> Column:
    """Lower-case tokens cut at single spaces.

    Leading and inner empty tokens stay, trailing ones go: ``""`` gives ``[""]`` and a
    text of spaces only gives ``[]``. Tabs and line ends are part of their token.
    """
    text = F.col(text) if isinstance(text, str) else text
    kept = F.rtrim(text)
    return (
        F.when(text == "", F.array(F.lit("")))
        .when(kept == "", F.array().cast("array<string>"))
        .otherwise(F.split(F.lower(kept), " "))
    )


def char_bigrams(text) -> Column:
    """Overlapping two-character tokens of the lower-cased text; none for a shorter text."""
    characters = F.split(F.lower(F.col(text) if isinstance(text, str) else text), "")
    following = F.slice(characters, 2, F.greatest(F.size(characters) - 1, F.lit(0)))
    # The last character has no follower: concat gives NULL there.
    pairs = F.zip_with(characters, following, lambda a, b: F.concat(a, b))
    return F.filter(pairs, lambda p: p.isNotNull())


def term_bucket(token, num_features: int) -> Column:
    return F.pmod(F.hash(token), F.lit(num_features))


def hashed_counts(tokens, num_features: int) -> Column:
    """Term counts per hash bucket as ``array<struct<bucket,tf>>``, within the row.

    The sorted bucket array is cut where its value changes, so one document costs one
    sort and no shuffle, however long it is.
    """
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    buckets = F.sort_array(F.transform(tokens, lambda t: term_bucket(t, num_features)))
    return F.transform(
        _runs(buckets),
        lambda run: F.struct(run["value"].alias("bucket"), run["length"].cast("long").alias("tf")),
    )


def _runs(ordered: Column) -> Column:
    """``array<struct<value,length>>`` for the runs of equal neighbours of a sorted array."""
    previous = F.concat(F.array(F.lit(None).cast("int")), ordered)
    # zip_with pads the shorter side with NULL: the last row marks the end of the array.
    pairs = F.zip_with(
        ordered,
        previous,
        lambda v, before: F.struct(v.alias("value"), (~v.eqNullSafe(before)).alias("starts")),
    )
    marked = F.transform(
        pairs,
        lambda z, i: F.struct(z["value"].alias("value"), i.alias("at"), z["starts"].alias("starts")),
    )
    starts = F.filter(marked, lambda z: z["starts"])
    ends = F.slice(starts, 2, F.size(starts))
    return F.filter(
        F.zip_with(
            starts,
            ends,
            lambda s, e: F.struct(s["value"].alias("value"), (e["at"] - s["at"]).alias("length")),
        ),
        lambda run: run["length"].isNotNull(),
    )
