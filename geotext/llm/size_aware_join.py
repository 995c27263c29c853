"""Documents linked by the Jaccard similarity of their word shingles, by a size-aware join.

Sets stand in one global order, rarest shingles first. Two sets similar enough share so many shingles that
the first few of both must meet: at least one in a short prefix, at least two in a prefix one longer. A small
set lists the pairs of its prefix, and small sets meet where they list the same pair. A
large set posts its prefix shingle by shingle, and is compared with the lists that it
is on. Up to which size sets are small is what costs the fewest rows, worked out from the sizes and lists.

The order is by a table of hashed counts of bounded size: it need only be the same for all, so its errors cost
time and never a link. Candidates are compared by their whole sets. Lists are first searched for links
to one of their members; what those links join needs no comparison among itself. Of other members those
pairs are compared whose parities over 256 slots differ in no more places than similar sets can. In crowded
lists that is done with a few drawn members, then with eight times as many, and so on, as most members of a large
group are joined by one of their first candidates; only what is still apart is compared with all.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geotext.llm.common import forget, query, short_shuffles, stored, table, tree_sum
from geotext.operators.components import connected_components
from geotext.operators.skew import BROADCAST_KEYS, attach

SHINGLE_WORDS = 5
PERCENT = 80

#: Slots of the hashed counts, 32 bits each.
SLOT_BITS = 22
#: Sets are never small beyond this many shingles.
LARGEST_SMALL = 64
#: Most bits of a filter over keys or names: 16 MB.
FILTER_BITS = 27
#: Members of one list that one task compares with one another.
LIST_ROWS = 4_000
POSTED = ["key", "name", "n", "left", "place"]
PARITIES = ["odd_0", "odd_1", "odd_2", "odd_3"]
#: In lists longer than this a pair is noted at the first that both are on.
LONG_LIST = 64
#: Where a list is longer than this, the long ones are first compared with drawn members: so many, then ``MORE_DRAWN`` times as many.
CROWDED, DRAWN, MORE_DRAWN = 256, 64, 8
#: Shingles counted, keys handed on, and set digests remembered at once.
COUNT_ROWS, SLICE_ROWS, KEPT_DIGESTS = 1 << 20, 200_000, 500_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _HALF) * _MIX
    x = (x ^ x >> _HALF) * _MIX
    return x ^ x >> _HALF


def shingle_set(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Different shingles as 64-bit hashes in order. A shorter text is one shingle, one without words none."""
    words = text.encode().lower().split() if text else []  # of bytes: ASCII letters and white space only
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    length = min(size, n)
    rows = n - length + 1
    total = np.full(rows, length, np.uint64)
    for k in range(length):
        total = total * _ODD + hashes[k : k + rows]
    return np.unique(mixed(total))


def digest_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if shingles.size else b""


def name_of(digest: bytes) -> int:
    """A set's name in lists of keys. Two sets of one name would both be compared with what either meets."""
    return int.from_bytes(digest[:8], "big", signed=True)


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of n shares with any set similar enough."""
    return -(-percent * n // 100)


def prefix_length(n: int, shared: int, percent: int = PERCENT) -> int:
    """So many first shingles of a set of n hold ``shared`` of those that it has in common with a similar one."""
    return min(n, n - least_overlap(n, percent) + shared)


def has_partners(n: int, percent: int = PERCENT) -> bool:
    """Whether a different set can be similar enough to one of n shingles."""
    return least_overlap(n, percent) < n or 100 * n // percent > n


def text_keys(texts: Sequence[str | None]) -> np.ndarray:
    """A whole text's hash of 64 bits, signed, by which its set is found again without working out all others."""
    return np.fromiter((xxhash.xxh64_intdigest((t or "").encode()) for t in texts), np.uint64, len(texts)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        yield batch, [shingle_set(t, size) for t in batch.column("text").to_pylist()]


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    """Each hash's place among ``slots``, a power of two."""
    return (hashes >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def _merge_counts(parts: Sequence[bytes]) -> bytes:
    total = np.frombuffer(zlib.decompress(parts[0]), "<u4").astype(np.uint64)
    for part in parts[1:]:
        total += np.frombuffer(zlib.decompress(part), "<u4")
    return zlib.compress(np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes(), 1)


def describe_sets(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n, digest, part``: each document's set, and one row per task with its hashed counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, np.int64)
        held, n_held = [], 0
        kind = None
        for batch, sets in _sets(batches, size):
            kind = batch.schema.field("doc_id").type
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([s.size for s in sets], pa.int64()),
                    pa.array([digest_of(s) for s in sets], pa.binary()),
                    pa.nulls(len(sets), pa.binary()),
                ],
                names=["doc_id", "n", "digest", "part"],
            )
            held += sets
            n_held += sum(s.size for s in sets)
            if n_held > COUNT_ROWS:
                counts += np.bincount(_slot(np.concatenate(held), counts.size), minlength=counts.size)
                held, n_held = [], 0
        if kind is None:
            return
        counts += np.bincount(_slot(np.concatenate(held), counts.size), minlength=counts.size) if held else 0
        part = zlib.compress(np.minimum(counts, 0xFFFFFFFF).astype("<u4").tobytes(), 1)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([part], pa.binary())],
            names=["doc_id", "n", "digest", "part"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, digest binary, part binary")


def parities_of(shingles: np.ndarray) -> list[int]:
    """A bit for each of 256 slots: whether it holds an odd number of shingles. Two sets differ in as many shingles at least."""
    odd = np.bincount((shingles & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).tolist()


def _fresh(digests: list[bytes], met: set[bytes], limit: int) -> list[int]:
    """Places of digests not met before. What is met is forgotten when it fills the memory, which costs repeats only."""
    new = []
    for k, digest in enumerate(digests):
        if digest not in met:
            if len(met) >= limit:
                met.clear()
            met.add(digest)
            new.append(k)
    return new


def prefixes_of(docs: DataFrame, counts: bytes, size: int, percent: int) -> DataFrame:
    """``digest, name, text_key, n, prefix, scan`` and parities, a row per different set that can have partners.

    ``prefix`` holds the shingles that come first, enough to share two. ``scan`` estimates the rows of the lists
    of those that it would post: what their slots hold beyond a slot's mean.
    """
    known = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.frombuffer(zlib.decompress(known.value), "<u4").astype(np.int64)
        usual = float(weight.mean())
        met: set[bytes] = set()
        for batch, sets in _sets(batches, size):
            of = [k for k, s in enumerate(sets) if has_partners(s.size, percent)]
            digests = [digest_of(sets[k]) for k in of]
            new = _fresh(digests, met, KEPT_DIGESTS)
            texts = text_keys(batch.column("text").take(pa.array([of[k] for k in new], pa.int64())).to_pylist()).tolist()
            rows = []
            for k, text_key in zip(new, texts, strict=True):
                s = sets[of[k]]
                rare = weight[_slot(s, weight.size)]
                first = np.lexsort((s, rare))[: prefix_length(s.size, 2, percent)]
                posted = rare[first[: prefix_length(s.size, 1, percent)]]
                scan = posted.size + float(np.maximum(posted - usual, 0).sum())
                rows.append((digests[k], name_of(digests[k]), text_key, s.size, s[first].tobytes(), scan, *parities_of(s)))
            columns = list(zip(*rows, strict=True)) or [[]] * (6 + len(PARITIES))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), *[pa.int64()] * len(PARITIES)]
            names = ["digest", "name", "text_key", "n", "prefix", "scan", *PARITIES]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    schema = "digest binary, name long, text_key long, n long, prefix binary, scan double" + "".join(f", {c} long" for c in PARITIES)
    found = docs.select("text").mapInArrow(run, schema)
    return found.dropDuplicates(["digest"])


def cheapest_size(prefixes: DataFrame, percent: int) -> int:
    """Up to which size listing pairs makes fewer rows than posting shingles and scanning their lists."""
    sizes = prefixes.where(F.col("n") <= LARGEST_SMALL).groupBy("n").agg(F.count(F.lit(1)).alias("sets"), F.sum("scan").alias("scan"))
    best, total, least = 0, 0.0, 0.0
    for n, sets, scan in sorted(map(tuple, sizes.collect())):  # at most LARGEST_SMALL rows
        length = prefix_length(n, 2, percent)
        total += sets * length * (length - 1) / 2 - scan
        if total < least:
            best, least = n, total
    return best


@lru_cache(maxsize=512)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def keys_of(prefix: np.ndarray, n: int, small: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which a set is found, and its shingles from the key's first on.

    A set up to ``small`` has a key per pair of its prefix; a larger one has a key per shingle, and so has a
    small one that may be similar to a larger one.
    """
    keys, left = [], []
    if n <= small:
        i, j = _pairs(prefix.size)
        keys.append(mixed(prefix[i] * _ODD + prefix[j]))
        left.append(n - i)
    if n > small or 100 * n >= percent * (small + 1):
        single = prefix[: prefix_length(n, 1, percent)]
        keys.append(single)
        left.append(n - np.arange(single.size))
    return np.concatenate(keys).view(np.int64), np.concatenate(left)


def _bits(values: np.ndarray, log: int) -> Iterator[np.ndarray]:
    """Two places of each value in a filter of 2^log bits."""
    for salt in (_ODD, _MIX):
        yield (mixed(values.view(np.uint64) * salt) >> np.uint64(64 - log)).astype(np.int64)


def _merge_filters(parts: Sequence[bytes]) -> bytes:
    total = np.frombuffer(zlib.decompress(parts[0]), np.uint8).copy()
    for part in parts[1:]:
        total |= np.frombuffer(zlib.decompress(part), np.uint8)
    return zlib.compress(total.tobytes(), 1)


def filter_of(values: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A test for the numbers in the one column of ``values``, of bounded size, on the workers.

    It holds all of them, and others by chance: the more of them there are, the more, which costs rows only.
    """
    name = values.columns[0]
    log = int(np.clip(np.ceil(np.log2(max(1, values.count()) * 12)), 10, FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << log, bool)
        for batch in batches:
            for places in _bits(batch.column(name).to_numpy(), log):
                held[places] = True
        part = zlib.compress(np.packbits(held, bitorder="little").tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], names=["part"])

    packed = tree_sum(values.mapInArrow(run, "part binary"), _merge_filters)
    if packed is None:
        packed = zlib.compress(bytes(1 << log - 3))
    known = values.sparkSession.sparkContext.broadcast(packed)
    opened: dict[str, np.ndarray] = {}

    def holds(some: np.ndarray) -> np.ndarray:
        if "bits" not in opened:
            opened["bits"] = np.frombuffer(zlib.decompress(known.value), np.uint8)
        found = np.ones(some.size, bool)
        for places in _bits(some, log):
            found &= (opened["bits"][places >> 3] >> (places & 7) & 1).astype(bool)
        return found

    return holds


def post(prefixes: DataFrame, small: int, percent: int, holds: Callable | None = None) -> DataFrame:
    """``key, name, n, left, place``, a row for each key of each set; only the keys where the filter says that others share them.

    ``place`` numbers a set's keys in the global order, so keys that two sets share come in one order in both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, packed = (batch.column(c).to_pylist() for c in ("name", "n", "prefix"))
            held, rows = [], 0
            for name, n, prefix in zip(names, sizes, packed, strict=True):
                keys, left = keys_of(np.frombuffer(prefix, np.uint64), n, small, percent)
                place = np.arange(keys.size)
                if holds is not None:
                    kept = holds(keys)
                    keys, left, place = keys[kept], left[kept], place[kept]
                held.append((keys, name, n, left, place))
                rows += keys.size
                if rows > SLICE_ROWS:
                    yield _posted(held)
                    held, rows = [], 0
            if held:
                yield _posted(held)

    return prefixes.select("name", "n", "prefix").mapInArrow(run, ", ".join(f"{c} long" for c in POSTED))


def _posted(held: list) -> pa.RecordBatch:
    keys, names, sizes, left, place = zip(*held, strict=True)
    repeat = [k.size for k in keys]
    columns = [np.concatenate(keys), np.repeat(names, repeat), np.repeat(sizes, repeat), np.concatenate(left), np.concatenate(place)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=POSTED)


def may_link(a: str, b: str, percent: int) -> Column:
    """What sizes, and what is left of both sets from a shared shingle on, allow: the overlap must still be possible."""
    n_a, n_b = F.col(a + "n"), F.col(b + "n")
    most = F.least(F.col(a + "left"), F.col(b + "left"))
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & ((100 + percent) * most >= percent * (n_a + n_b))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs ``a, b`` of names those whose whole sets are similar enough."""

    @F.pandas_udf("boolean")
    def similar(left, right):  # noqa: ANN001, ANN202
        import pandas as pd

        found = []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            union = np.unique(np.concatenate([x, y])).size
            found.append(100 * (x.size + y.size - union) >= percent * union)
        return pd.Series(found, dtype=bool)

    one = attach(pairs, sets.select(F.col("name").alias("b"), F.col("shingles").alias("set_b")), ["b"])
    both = attach(one, sets.select(F.col("name").alias("a"), F.col("shingles").alias("set_a")), ["a"])
    return both.where(similar("set_a", "set_b")).select("a", "b")


def sets_of(docs: DataFrame, holds: Callable, size: int, percent: int) -> DataFrame:
    """``name, shingles``: the whole sets of those texts whose keys the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            kept = np.flatnonzero(holds(text_keys(texts)))
            sets = [s for s in (shingle_set(texts[k], size) for k in kept) if has_partners(s.size, percent)]
            digests = [digest_of(s) for s in sets]
            new = _fresh(digests, met, KEPT_DIGESTS)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([digests[k] for k in new], pa.binary()),
                    pa.array([name_of(digests[k]) for k in new], pa.int64()),
                    pa.array([sets[k].tobytes() for k in new], pa.binary()),
                ],
                names=["digest", "name", "shingles"],
            )

    found = docs.select("text").mapInArrow(run, "digest binary, name long, shingles binary")
    return found.dropDuplicates(["digest"]).select("name", "shingles")


def _among(sets: DataFrame, holds: Callable) -> DataFrame:
    """Those of the sets whose names the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(holds(batch.column("name").to_numpy())))

    return sets.mapInArrow(run, sets.schema)


class _Links:
    """Links found so far. The sets they were verified by are stored, and so are all pairs that were candidates.

    Only the first pairs meet all of the sets; later ones are few, and the sets of others are not moved for them.
    """

    def __init__(self, docs: DataFrame, prefixes: DataFrame, size: int, percent: int):
        self.docs, self.prefixes, self.size, self.percent = docs, prefixes, size, percent
        self.links = self.pairs = self.sets = None
        self.held: list[Callable] = []

    def fetch(self, names: DataFrame) -> None:
        """The whole sets of ``name``, but for those that are there."""
        keys = self.prefixes.select("name", "text_key")
        wanted = stored(attach(names, keys, ["name"], rows=1).select("text_key"))
        holds, before = filter_of(wanted), tuple(self.held)
        forget(wanted)

        def missing(some: np.ndarray) -> np.ndarray:
            found = holds(some)
            for other in before:
                found &= ~other(some)
            return found

        more = stored(sets_of(self.docs, missing, self.size, self.percent))
        self.sets = more if self.sets is None else self.sets.unionByName(more)
        self.held.append(holds)

    def verify(self, pairs: DataFrame, fetch: bool = True) -> None:
        """Add what links there are among ``pairs``."""
        pairs = stored(pairs if self.pairs is None else pairs.join(self.pairs, ["a", "b"], "left_anti"))
        if self.pairs is not None and pairs.isEmpty():
            return
        if fetch:
            self.fetch(_names(pairs))
        sets = self.sets
        if self.pairs is not None:
            names = stored(_names(pairs))
            sets = _among(sets, filter_of(names))
            forget(names)
        links = stored(verified(pairs, sets, self.percent))
        self.links = links if self.links is None else self.links.unionByName(links)
        self.pairs = pairs if self.pairs is None else self.pairs.unionByName(pairs)

    def roots(self) -> DataFrame:
        return connected_components(self.links, []).withColumnsRenamed({"v": "name"})


def links_of(docs: DataFrame, counts: bytes, size: int, percent: int, small: int | None = None) -> DataFrame:
    """``a, b``: names of different sets that are similar enough, so many that they join what all such pairs join."""
    prefixes = stored(prefixes_of(docs, counts, size, percent))
    small = cheapest_size(prefixes, percent) if small is None else small
    shared = stored(post(prefixes, small, percent).groupBy("key").count().where("count > 1").select("key"))
    holds = filter_of(shared)
    forget(shared)
    posted = stored(post(prefixes, small, percent, holds))
    known = stored(prefixes.select("name", "text_key", *PARITIES))
    forget(prefixes)
    first = F.min(F.struct("name", "n", "left"))
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("members"), first.alias("first")).where("members > 1")
    entries = stored(attach(posted, lists, ["key"], count="members"))
    forget(posted)

    found = _Links(docs, known, size, percent)
    found.verify(_star(entries, percent))
    roots = found.roots()
    rest = _apart(entries, roots, known)
    forget(entries)
    if rest is not None:
        found.verify(_across(_drawn(rest, roots, found, percent), percent))
    return found.links


def _drawn(rest: DataFrame, roots: DataFrame, found: _Links, percent: int) -> DataFrame:
    """``rest`` with the roots of now, when the members of long lists were compared with ever more drawn ones.

    Long lists that hold one component by then are left out. Short ones stay whole.
    """
    largest = _largest(rest)
    if largest <= CROWDED:
        return rest
    long = rest.where(F.col("size") > LONG_LIST)
    found.fetch(long.select("name").distinct())
    drawn = DRAWN
    now, made = roots, None
    while drawn < largest:
        found.verify(_across(long, percent, drawn), fetch=False)
        now = found.roots()
        long = _divided(_rooted(long, now))
        if made is not None:
            forget(made)
        made = long
        largest = _largest(long)
        drawn *= MORE_DRAWN
    short = _moved(rest.where(F.col("size") <= LONG_LIST), roots, now)
    return short.unionByName(long.select(short.columns))


def _moved(rest: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """``rest`` with each root, and each list's head, that is joined to a lower one since ``before`` replaced by that.

    Those are few beside the rows, which are not dealt out again for them.
    """
    own = before.select("name", F.col("root").alias("own"))
    joined = attach(now, own, ["name"], "left", rows=1).where(F.coalesce("own", "name") == F.col("name"))
    joined = stored(joined.where("root <> name").select("name", F.col("root").alias("now")))
    few = joined.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    for column in ("root", "head"):
        lower = joined.withColumnRenamed("name", column)
        rest = rest.join(F.broadcast(lower), column, "left") if few else attach(rest, lower, [column], "left")
        rest = rest.withColumn(column, F.coalesce("now", column)).drop("now")
    return rest


def _largest(rest: DataFrame) -> int:
    return rest.agg(F.max("size")).first()[0] or 0


def _star(entries: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of a list's ``first`` and its other members, the lower name first."""
    sides = {"a_": "first.", "b_": ""}
    both = entries.select(*[F.col(at + c).alias(to + c) for to, at in sides.items() for c in ("name", "n", "left")])
    both = both.where((F.col("a_name") != F.col("b_name")) & may_link("a_", "b_", percent))
    return both.select(F.least("a_name", "b_name").alias("a"), F.greatest("a_name", "b_name").alias("b")).distinct()


def _names(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("name")).distinct().union(pairs.select("b").distinct()).distinct()


def _apart(entries: DataFrame, roots: DataFrame, prefixes: DataFrame) -> DataFrame | None:
    """Members of lists that hold more than one component.

    Each has its ``root``, the list's commonest, its ``head``, its parities, and the keys ``before`` of other long lists.
    """
    own = attach(entries.drop("first", "members"), prefixes.select("name", *PARITIES), ["name"])
    rest = _divided(_rooted(own, roots))
    if rest.isEmpty():
        forget(rest)
        return None
    # What a set posted before, of long lists: two that share one of these meet there.
    long = rest.where(F.col("size") > LONG_LIST)
    posted = long.groupBy("name").agg(F.collect_list(F.struct("place", "key")).alias("posted"))
    before = F.filter("posted", lambda p: p["place"] < F.col("place"))
    long = attach(long, posted, ["name"]).withColumn("before", F.transform(before, lambda p: p["key"])).drop("posted")
    short = rest.where(F.col("size") <= LONG_LIST).withColumn("before", F.array().cast("array<bigint>"))
    found = stored(short.unionByName(long))
    forget(rest)
    return found


def _rooted(own: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of lists with their ``root`` of now."""
    known = attach(own.drop("root", "head", "size"), roots, ["name"], "left")
    return stored(known.withColumn("root", F.coalesce("root", "name")))


def _divided(own: DataFrame) -> DataFrame:
    """Whole lists of more than one component, with their ``size`` and commonest root, the ``head``. ``own`` is stored and goes."""
    parts = own.groupBy("key", "root").agg(F.count(F.lit(1)).alias("part"))
    whole = parts.groupBy("key").agg(
        F.max_by("root", F.struct("part", "root")).alias("head"), F.count(F.lit(1)).alias("parts"), F.sum("part").alias("size")
    )
    found = stored(attach(own, whole.where("parts > 1").drop("parts"), ["key"], count="size"))
    forget(own)
    return found


def _across(rest: DataFrame, percent: int, drawn: int | None = None) -> DataFrame:
    """Candidate pairs across components. A long list is a square of smaller ones, so that no task has it whole.

    With ``drawn``, only those with one of about so many members of each list, the same in lists of one length.
    """
    parts = F.ceil(F.col("size") / LIST_ROWS).cast("int")
    part = F.pmod(F.xxhash64("name"), parts).cast("int")
    every = F.explode(F.sequence(F.lit(0), parts - 1))
    columns = ["name", "n", "left", "root", "before", *PARITIES]
    # What is joined already is compared with the others, never with itself.
    a = rest.where("root <> head").select("key", part.alias("p"), every.alias("q"), *[F.col(c).alias("a_" + c) for c in columns])
    b = rest.select("key", part.alias("q"), every.alias("p"), "size", (F.col("root") == F.col("head")).alias("b_head"), *[F.col(c).alias("b_" + c) for c in columns])
    if drawn is None:
        once = F.col("b_head") | (F.col("a_name") < F.col("b_name"))
    else:
        b = b.where(_lot("b_name") * F.col("size") < drawn)
        once = F.lit(True)
    differ = sum(F.bit_count(F.col("a_" + c).bitwiseXOR(F.col("b_" + c))) for c in PARITIES)
    close = (100 + percent) * differ <= (100 - percent) * (F.col("a_n") + F.col("b_n"))
    met = a.join(b.drop("size"), ["key", "p", "q"]).where((F.col("a_root") != F.col("b_root")) & once & may_link("a_", "b_", percent) & close & ~F.arrays_overlap("a_before", "b_before"))
    low, high = F.least("a_name", "b_name"), F.greatest("a_name", "b_name")
    met = met.select(low.alias("a"), high.alias("b"))
    return met.distinct()


def _lot(name: str) -> Column:
    """A number from 0 to 1 for each name, the same in all lists."""
    return F.pmod(F.xxhash64(name, F.lit("drawn")), F.lit(1 << 30)) / (1 << 30)


def jaccard_components(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    small: int | None = None,
) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per row of ``docs``.

    Two documents link when their sets' intersection is ``percent`` of their union or more; the component's id
    is the smallest document id that can be reached. Documents without words (null, empty, white space)
    link with nothing, not with each other: their component is their own id. A null id counts only where a
    component has no other. Rows with one id stay apart unless their texts link. Only id and text are read.
    ``small`` sets the size up to which sets list pairs; by default the cheapest is taken. Any gives the same rows.

    Sets are known by 64-bit hashes of shingles and 128-bit digests.
    """
    if not 50 <= percent < 100 or size < 1:
        raise ValueError("percent must be from 50 to 99 and shingles have a word at least")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    with short_shuffles(docs.sparkSession):
        return _components(docs, size, percent, small)


def _components(docs: DataFrame, size: int, percent: int, small: int | None) -> DataFrame:
    described = stored(describe_sets(docs, size))
    counts = tree_sum(described.where("part IS NOT NULL"), _merge_counts)
    rows = stored(described.where("part IS NULL").select("doc_id", "n", "digest"))
    forget(described)
    named = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    alone = rows.where("n = 0").withColumn("component_id", F.col("doc_id")).select(named)
    if counts is None:
        return alone
    whole = rows.where("n > 0")
    classes = stored(whole.groupBy("digest").agg(F.min("doc_id").alias("lowest"), F.count(F.lit(1)).alias("copies")))
    roots = connected_components(links_of(docs, counts, size, percent, small), [])
    name = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")  # as name_of
    joined = attach(classes.withColumn("name", name), roots.withColumnRenamed("v", "name"), ["name"], "left")
    joined = stored(joined.withColumn("root", F.coalesce("root", "name")))
    lowest = joined.groupBy("root").agg(F.min("lowest").alias("component_id"), F.count(F.lit(1)).alias("sets"))
    found = attach(joined, lowest, ["root"], count="sets").select("digest", "component_id", "copies")
    return attach(whole, found, ["digest"], count="copies").select(named).unionByName(alone)


@query("op13_size_aware_join")
def op13_size_aware_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))
