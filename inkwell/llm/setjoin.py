"""N-gram Jaccard join: size-aware, heavy-light.

A document's set holds the distinct shingles of its words. Equal sets are one
class, and classes are joined. Small (light) sets are joined by enumerating
their subsets of the one size that a partner of a given size must share, so a
common key is a link. Large (heavy) sets scan inverted lists: each set is listed
under the rarest shingles that it cannot do without, and what meets in a list is
verified on the whole sets. The boundary is the size at which enumeration gets
dearer than listing and verifying.

Within a list the first set is a pivot. Each set is first verified against one
pivot, of those that sizes and parity bitmaps don't rule out. Lists whose
members end up in one component need no more. In the others each set is
verified against two more sets drawn by hash. At last every pair of sets from
different components that share a list is held against sizes, places in the
lists and parity bitmaps, and what these don't rule out is verified. Pairs of
long lists are compared inside tasks, block by block: first by bitmaps, which
gives clusters of sets that close pairs join, then by the whole sets of each
cluster, where only links that join something become rows. So no link between
components is lost, and a group's rows grow with its members, not with their pairs.

Shingles are 64-bit hashes, classes 128-bit hashes of the sorted shingles.

Defined results: a null text, or one without words, has an empty set, no link
and its own id as component. A null id counts as no id: its component is the
smallest id reachable, or null. Repeated rows give repeated rows. Extra columns
are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import combinations, pairwise
from math import comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.llm.common import cut

#: The contract's shingle width and similarity in hundredths.
WORDS, PERCENT = 4, 85
#: Counters of the frequency sketch, 8 bytes each, and bits of the filter of needed classes: fixed sizes, whatever the input.
SKETCH, FILTER_BITS = 1 << 18, 1 << 25
BLOCK = 1 << 15
#: Least bits of a set's parity bitmap, in which two sets differ in no more bits than they differ in shingles.
PARITY_BITS = 1024
#: Members up to which the pairs of a list are rows; sets of a block of a longer list; pairs that a task compares at once.
SHORT, SIDE, AT_ONCE = 16, 512, 1 << 16
#: Sets drawn by hash from a list of several components, with which each of its sets is verified.
DRAWS = 2
#: Buckets of list keys that are counted; keys of a bucket with over 1 / HOT of all entries are counted by partial sums, others by a window.
KEY_BUCKETS, HOT, LEAST_HOT = 1 << 14, 4096, 2000
#: What listing a shingle costs, and what verifying a set costs for each shingle, in enumerated subsets.
LIST_COST, VERIFY_COST = 2.0, 0.5
_P = np.uint64(0x9E3779B97F4A7C15)


def least_overlap(a: int, b: int, percent: int = PERCENT) -> int:
    """The smallest intersection at which sets of these sizes link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def partners(n: int, percent: int = PERCENT) -> range:
    """The sizes a linked set of another class can have."""
    return range(max(1, -(-percent * n // 100)), 100 * n // percent + 1)


def subsets(n: int, percent: int = PERCENT) -> int:
    """How many keys a light set of this size has."""
    return sum(comb(n, c) for m in partners(n, percent) if (c := least_overlap(n, m, percent)) < n or m != n)


def boundary(percent: int = PERCENT, most: int = 64) -> int:
    """The largest size up to which enumerating subsets is cheaper than listing and verifying."""
    b = 1
    for n in range(1, most + 1):
        listed = n - least_overlap(n, partners(n, percent).start, percent) + 1
        if subsets(n, percent) > LIST_COST * listed + VERIFY_COST * n * listed:
            break
        b = n
    return b


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """A linked pair shares one of the first so many shingles of either set, in any one order."""
    return n - -(-percent * n // 100) + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random 64-bit number for each byte, the same for a and A; which bytes are white space.
with np.errstate(over="ignore"):
    _BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _P)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, np.int8)
_SPACE[[9, 10, 11, 12, 13, 32]] = 1
_POWERS = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def _powers(n: int, sign: int) -> np.ndarray:
    """The first n powers of the multiplier, or of its inverse, modulo 2 to the power 64."""
    if len(_POWERS[sign]) < n:
        factor = np.uint64(pow(int(_P), sign, 1 << 64))
        _POWERS[sign] = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(max(n, 1 << 18) - 1, factor))])
    return _POWERS[sign][:n]


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of UTF-8 text, A to Z as a to z."""
    b = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[b], prepend=np.int8(1), append=np.int8(1)))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTES[b] * _powers(len(b), 1), out=sums[1:])
    return starts, _mix((sums[ends] - sums[starts]) * _powers(len(b) + 1, -1)[starts])


def shingle_sets(texts: list[str | None], width: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text's words; texts are hashed in blocks of about 256 KB."""
    out: list[np.ndarray] = []
    block: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        block.append((t or "").encode())
        size += len(block[-1]) + 1
        if size > 1 << 18 or i + 1 == len(texts):
            out += _block_sets(block, width)
            block, size = [], 0
    return out


def _block_sets(block: list[bytes], width: int) -> list[np.ndarray]:
    starts, h = _word_hashes(b"\n".join(block))
    # Each text's words are consecutive; shingles that cross texts are left out by the bounds.
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in block)])).tolist()
    n = max(0, len(h) - width + 1)
    whole = np.full(n, width, np.uint64)
    for i in range(width):
        whole = whole * _P + h[i : n + i]
    whole = _mix(whole)
    out = []
    for a, b in pairwise(bounds):
        if b - a >= width:
            s = np.sort(whole[a : b - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                one = one * _P + x
            out.append(_mix(one))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    return shingle_sets([text], width)[0]


def signature(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def parity(s: np.ndarray) -> np.ndarray:
    """As many bits as shingles, rounded up to a power of two, so that large sets can be told apart too."""
    bits = max(PARITY_BITS, 1 << (len(s) - 1).bit_length() if len(s) else 0)
    odd = np.bincount(((s >> np.uint64(24)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _texts(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of the batches, whose first columns are doc_id and text, with the rows' sets."""
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            part = whole.slice(at, 512)
            yield part, shingle_sets(part.column(1).to_pylist(), words)
    pa.default_memory_pool().release_unused()


_BLOCKS = pa.schema([("block", pa.int32()), ("data", pa.binary())])


def _gathered(rows: DataFrame, fill: Callable, size: int, start: type, total: type, merge: Callable) -> np.ndarray:
    """An array of a fixed size that every task fills; the tasks' arrays are merged block by block on the executors, and come to the driver as a few MB at most."""

    def each(batches):
        out = np.zeros(size, start)
        fill(batches, out)
        some = [i for i in range(-(-size // BLOCK)) if out[i * BLOCK : (i + 1) * BLOCK].any()]
        yield pa.RecordBatch.from_pydict({"block": some, "data": [out[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in some]}, schema=_BLOCKS)

    def add(batches):
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                new = np.frombuffer(data, start).astype(total)
                got[block] = merge(got[block], new) if block in got else new
        yield pa.RecordBatch.from_pydict({"block": list(got), "data": [x.tobytes() for x in got.values()]}, schema=_BLOCKS)

    out = np.zeros(size, total)
    got = rows.mapInArrow(each, "block int, data binary").repartition("block").mapInArrow(add, "block int, data binary").toArrow()
    for block, data in zip(got.column("block").to_pylist(), got.column("data").to_pylist(), strict=True):
        out[block * BLOCK : block * BLOCK + len(data) // out.itemsize] = np.frombuffer(data, total)
    return out


def ranks(rows: DataFrame, words: int = WORDS) -> np.ndarray:
    """A coarse frequency rank for each hash bucket of shingles, 0 for all that isn't clearly common."""

    def fill(batches, out):
        for _, found in _texts(batches, words):
            if found:
                out += np.bincount((np.concatenate(found) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH).astype(np.uint32)

    counts = _gathered(rows, fill, SKETCH, np.uint32, np.int64, np.add)
    usual = max(1.0, float(np.median(counts)))
    noise = usual + 6 * usual**0.5 + 1
    return np.where(counts <= noise, 0, np.ceil(4 * np.log2(np.maximum(counts, 1) / noise)) + 1).astype(np.int16)


def _listed(s: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """The first n shingles in the one order of all sets: the rarest by rank, then by hash."""
    return s[np.lexsort((s, rank[(s % np.uint64(SKETCH)).astype(np.int64)]))[:n]]


def _light_keys(s: np.ndarray, percent: int) -> Iterator[tuple[int, bool]]:
    """(key, whether this is the smaller side) of each subset that a partner of some size must share."""
    n = len(s)
    values = s.tolist()
    for m in partners(n, percent):
        c, a, b = least_overlap(n, m, percent), min(n, m), max(n, m)
        if m == n and c == n:
            continue
        for part in combinations(values, c):
            key = xxhash.xxh64_intdigest(np.array([a, b, *part], np.uint64).tobytes())
            key -= (key >> 63) << 64
            if n <= m:
                yield key, True
            if n >= m:
                yield key, False


def band(n: int, percent: int = PERCENT) -> int:
    """Linked sets are in the same size band or in neighbouring ones."""
    return int(log(n) / log(100 / percent) + 1e-9)


def sets(rows: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """uid, the tag and, of each row (doc_id, text, tag), the set's size, band, class, parity bitmap and keys.

    Only the first row of a class in its task (``first``) has a bitmap and keys.
    """
    shared = rows.sparkSession.sparkContext.broadcast(ranks(rows.select("doc_id", "text"), words))
    light = boundary(percent)
    # A light set of which every partner is light needs no list.
    alone = percent * light // 100
    longs = pa.list_(pa.int64())

    def run(batches):
        seen: set[bytes] = set()
        for part, found in _texts(batches, words):
            listed, small, large = [], [], []
            sigs = [signature(s) for s in found]
            first = []
            for sig, s in zip(sigs, found, strict=True):
                first.append(len(s) > 0 and sig not in seen)
                seen.add(sig)
            kept = [s if f else s[:0] for s, f in zip(found, first, strict=True)]
            for s in kept:
                n = len(s)
                listed.append(_listed(s, shared.value, prefix_length(n, percent)).view(np.int64) if n > alone else [])
                keys = list(_light_keys(s, percent)) if 0 < n <= light else []
                small.append([k for k, first in keys if first])
                large.append([k for k, first in keys if not first])
            sizes = [len(s) for s in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(sizes, pa.int64()), pa.array([band(n, percent) if n else 0 for n in sizes], pa.int32()), pa.array(sigs, pa.binary()),
                    pa.array([parity(s) if len(s) else [] for s in kept], longs), pa.array(listed, longs), pa.array(small, longs), pa.array(large, longs), part.column(2), pa.array(first),
                ],
                ["doc_id", "n_shingles", "band", "sig", "parity", "listed", "small", "large", "tag", "first"],
            )

    table = rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, band int, sig binary, parity array<bigint>, listed array<bigint>, small array<bigint>, large array<bigint>, tag binary, first boolean")
    # The checkpoint fixes the numbers.
    return cut(table.withColumn("uid", F.monotonically_increasing_id()))


def _light_links(reps: DataFrame) -> DataFrame:
    """a, b: links of light sets. A smaller and a larger side with a common key link; each goes to the least of the other side."""
    side = lambda c, first: reps.select("gid", F.lit(first).alias("first"), F.explode(c).alias("key"))
    sides = cut(side("small", True).union(side("large", False)))
    least = lambda first: F.min(F.when(F.col("first") == first, F.col("gid")))
    met = sides.join(sides.groupBy("key").agg(least(True).alias("s"), least(False).alias("l")), "key").withColumn("other", F.when(F.col("first"), F.col("l")).otherwise(F.col("s")))
    return met.where("other != gid").select(F.least("gid", "other").alias("a"), F.greatest("gid", "other").alias("b")).distinct()


def _close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sizes and parity bitmaps don't rule out."""
    side = lambda x: classes.select(F.col("gid").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("parity").alias(f"p_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    # Sizes that can link differ by one power of two at most; the halves of the longer bitmap are then added modulo 2.
    half = lambda p: F.zip_with(F.slice(p, F.lit(1), (F.size(p) / 2).cast("int")), F.slice(p, (F.size(p) / 2 + 1).cast("int"), (F.size(p) / 2).cast("int")), lambda x, y: x.bitwiseXOR(y))
    fold = lambda p, q: F.when(F.size(p) > F.size(q), half(F.col(p))).otherwise(F.col(p))
    differ = F.aggregate(F.zip_with(fold("p_a", "p_b"), fold("p_b", "p_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    overlap = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent))
    return both.where(differ <= F.col("n_a") + F.col("n_b") - 2 * overlap).select("a", "b")


def _own_key(sig: bytes, doc_id: int | None) -> int:
    return xxhash.xxh64_intdigest(sig + (b"" if doc_id is None else int(doc_id).to_bytes(8, "little", signed=True)))


def _items(needed: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """sig, items: the whole sets of the needed classes (sig, doc_id), made anew from the texts.

    A filter of a fixed size keeps most other rows from leaving their task; a join decides.
    """

    def fill(batches, out):
        for b in batches:
            for sig, doc_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bit = _own_key(sig, doc_id) % FILTER_BITS
                out[bit >> 3] |= 1 << (bit & 7)

    shared = rows.sparkSession.sparkContext.broadcast(_gathered(needed.select("sig", "doc_id"), fill, FILTER_BITS >> 3, np.uint8, np.uint8, np.bitwise_or))

    def make(batches):
        bits = shared.value
        for part, found in _texts(batches, words):
            keep, sigs = [], []
            for i, (doc_id, s) in enumerate(zip(part.column(0).to_pylist(), found, strict=True)):
                if len(s):
                    sig = signature(s)
                    bit = _own_key(sig, doc_id) % FILTER_BITS
                    if bits[bit >> 3] >> (bit & 7) & 1:
                        keep.append(i)
                        sigs.append(sig)
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array([found[i].tobytes() for i in keep], pa.binary())], ["sig", "items"])

    return rows.mapInArrow(make, "sig binary, items binary")


def _verify(pairs: DataFrame, classes: DataFrame, rows: DataFrame, percent: int, words: int) -> DataFrame:
    """a, b: the pairs that link, by the whole sets.

    Second sets go to the place of their first set; a first set with many pairs
    is sent to several places. The sets are joined once, with all that is asked of them.
    """
    own = classes.select("gid", "sig", "doc_id")
    places = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).cast("int").alias("places"))
    first = places.select(F.col("a").alias("gid"), "a", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.lit(False).alias("second"))
    second = pairs.join(places, "a").select(F.col("b").alias("gid"), "a", F.pmod(F.xxhash64("b"), F.col("places")).cast("int").alias("place"), F.lit(True).alias("second"))
    asked = cut(first.union(second).join(own, "gid"))
    items = _items(asked.select("sig", "doc_id").distinct(), rows, words)

    def run(batches):
        held = np.empty(0, np.uint64)
        for part in batches:
            found = ([], [])
            for gid, a, second, items in zip(*(part.column(i).to_pylist() for i in range(3)), part.column(3), strict=True):
                s = np.frombuffer(items.as_buffer(), np.uint64)
                if not second:
                    held = s.copy()
                    continue
                at = np.searchsorted(held, s)
                at[at == len(held)] = 0
                both = int((held[at] == s).sum())
                if 100 * both >= percent * (len(held) + len(s) - both):
                    found[0].append(a)
                    found[1].append(gid)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["a", "b"])

    met = items.join(asked.select("sig", "gid", "a", "place", "second"), "sig").repartition("a", "place").sortWithinPartitions("a", "place", "second")
    return cut(met.select("gid", "a", "second", "items").mapInArrow(run, "a bigint, b bigint").distinct())


def _lists(table: DataFrame, reps: DataFrame) -> DataFrame:
    """key, band, gid, n, at, pivot: who stands where in which list of two sets or more; ``at`` is the key's place among the set's own.

    A set stands in the lists of its band and the next one, so that linked sets
    meet. The least set of a list is its pivot.
    """
    entries = reps.select("gid", "band", F.col("n_shingles").cast("int").alias("n"), F.posexplode("listed").alias("at", "key"))
    bucket = F.pmod(F.xxhash64("key"), F.lit(KEY_BUCKETS)).cast("int")
    counts = cut(table.select(F.explode("listed").alias("key")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")))
    limit = max(LEAST_HOT, (counts.agg(F.sum("n")).first()[0] or 0) // HOT)
    # At most HOT of them.
    hot = [r["bucket"] for r in counts.where(F.col("n") > limit).select("bucket").collect()]
    often = bucket.isin(hot) if hot else F.lit(False)
    banded = lambda e: e.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    in_key, in_band = W.partitionBy("key"), W.partitionBy("key", "band")
    some = banded(entries.where(~often).withColumn("holders", F.count("*").over(in_key)).where("holders > 1"))
    some = some.select("key", "band", "gid", "n", "at", F.min("gid").over(in_band).alias("pivot"), F.count("*").over(in_band).alias("holders")).where("holders > 1").drop("holders")
    if hot:
        most = banded(entries.where(often))
        some = some.union(most.join(most.groupBy("key", "band").agg(F.min("gid").alias("pivot"), F.count("*").alias("holders")).where("holders > 1"), ["key", "band"]).select(some.columns))
    return cut(some)


_MEMBERS = "key", "band", "gid", "n", "at", "comp"


def _plausible(x: str, y: str, percent: int) -> str:
    """Whether sizes and places let the first key that sets x and y have in common be this list's."""
    return (
        f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)"
        f" and {100 + percent} * least({x}.n - {x}.at, {y}.n - {y}.at) >= {percent} * ({x}.n + {y}.n)"
    )


def _roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each of n nodes the least one reachable by the edges (p, q)."""
    at = np.arange(n)
    while True:
        new = at.copy()
        np.minimum.at(new, p, at[q])
        np.minimum.at(new, q, at[p])
        new = new[new]
        if (new == at).all():
            return at
        at = new


def _in_blocks(members: DataFrame, classes: DataFrame, percent: int, pairs: bool = True) -> DataFrame:
    """a, b: the pairs of long lists (members, holders) from different components that sizes, places and parity bitmaps don't rule out.

    A list is dealt in blocks by hash; each pair of blocks has a place of its own.
    Without ``pairs`` what is returned only joins the sets that such pairs join:
    each set of a place that has one, with the first of those it is joined with.
    """
    own = F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int")
    placed = members.withColumn("blocks", F.ceil(F.col("holders") / SIDE).cast("int")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = placed.select(*_MEMBERS, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(classes.select("gid", "parity"), "gid")
    order = ("key", "band", "i", "j")

    def compare(parts: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        gid, n, at, comp, own, i, j = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in (2, 3, 4, 5, 6, 7, 8))
        maps = [x for p in parts for x in np.split(p.column(9).flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(np.diff(p.column(9).offsets.to_numpy()))[:-1])]
        # The halves of a longer bitmap are added modulo 2 until all are as long as the shortest.
        words = min(map(len, maps))
        bits = np.array([np.bitwise_xor.reduce(x.reshape(-1, words), 0) for x in maps])
        n, at = n.astype(np.int64), at.astype(np.int64)
        both = i[0] == j[0]
        first, second = (np.arange(len(gid)),) * 2 if both else (np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0]))
        step = max(1, AT_ONCE // max(1, len(second)))
        root = np.arange(len(gid))
        for start in range(0, len(first), step):
            x, y = first[start : start + step, None], second[None, :]
            may = (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & ((100 + percent) * np.minimum(n[x] - at[x], n[y] - at[y]) >= percent * (n[x] + n[y]))
            if both:
                may &= x < y
            p, q = np.nonzero(may)
            p, q = first[start + p], second[q]
            for k in range(0, len(p), AT_ONCE):
                u, v = p[k : k + AT_ONCE], q[k : k + AT_ONCE]
                total = n[u] + n[v]
                near = np.bitwise_count(bits[u] ^ bits[v]).sum(1, dtype=np.int64) <= total - 2 * -(-percent * total // (100 + percent))
                if pairs:
                    yield gid[u[near]], gid[v[near]]
                else:
                    root = _roots(len(gid), np.concatenate([np.arange(len(gid)), u[near]]), np.concatenate([root, v[near]]))
        if not pairs:
            joined = np.flatnonzero(root != np.arange(len(gid)))
            yield gid[root[joined]], gid[joined]

    def run(batches):
        held: list[pa.RecordBatch] = []
        name = None
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def passed():
            a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for whole in batches:
            ids = np.stack([whole.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1, 7, 8)])
            edges = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1).tolist(), whole.num_rows]
            for lo, hi in pairwise(edges):
                if lo == hi:
                    continue
                if held and name != tuple(ids[:, lo].tolist()):
                    found += compare(held)
                    held = []
                    if sum(len(f[0]) for f in found) > AT_ONCE:
                        yield passed()
                        found = []
                name = tuple(ids[:, lo].tolist())
                held.append(whole.slice(lo, hi - lo))
        if held:
            found += compare(held)
        if found:
            yield passed()

    return dealt.select(*_MEMBERS, "own", "i", "j", "parity").repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a bigint, b bigint").distinct()


def _in_clusters(clusters: DataFrame, comp: DataFrame, classes: DataFrame, rows: DataFrame, percent: int, words: int) -> DataFrame:
    """a, b: links that join all components (comp) that links within clusters (gid, cluster) join, by the whole sets.

    Every pair of a cluster from different components is compared inside a task,
    a pair of blocks at a place; it becomes a row only if it joins what nothing
    has joined at its place so far, so a place makes fewer rows than it has sets.
    """
    named = cut(clusters.join(comp, "gid", "left").withColumn("comp", F.coalesce("comp", "gid")))
    sizes = named.groupBy("cluster").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("blocks"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("cluster", "blocks")
    placed = named.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    order = ("cluster", "i", "j")
    asked = cut(placed.select("cluster", "gid", "comp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(classes.select("gid", "sig", "doc_id"), "gid"))
    items = _items(asked.select("sig", "doc_id").distinct(), rows, words)

    def compare(gid, top, own, i, j, held) -> Iterator[tuple[int, int]]:
        sizes = np.array([len(s) for s in held])
        _, items = np.unique(np.concatenate(held), return_inverse=True)
        parts = np.split(items, np.cumsum(sizes)[:-1])
        first, second = (np.arange(len(gid)),) * 2 if i == j else (np.flatnonzero(own == i), np.flatnonzero(own == j))
        if not len(first) or not len(second):
            return
        there = np.concatenate([parts[y] for y in second])
        starts = np.concatenate([[0], np.cumsum(sizes[second])[:-1]])
        mark = np.zeros(len(items), np.int32)
        for x in first.tolist():
            if (top[second] == top[x]).all():
                continue
            mark[parts[x]] = 1
            both = np.add.reduceat(mark[there], starts)
            mark[parts[x]] = 0
            met = second[100 * both >= percent * (sizes[x] + sizes[second] - both)]
            while len(met := met[top[met] != top[x]]):
                yield gid[x], gid[met[0]]
                top[top == top[met[0]]] = top[x]

    def run(batches):
        name, held = None, []

        def links():
            gid, top, own = (np.array([h[k] for h in held]) for k in range(3))
            # Rows of a class come once for each of its texts that the filter let pass.
            _, once = np.unique(gid, return_index=True)
            found = list(compare(gid[once], top[once], own[once], *name[1:], [held[k][3] for k in once.tolist()]))
            a, b = np.array(found, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for part in batches:
            for *place, gid, top, own, items in zip(*(part.column(c).to_pylist() for c in range(6)), part.column(6), strict=True):
                if held and name != tuple(place):
                    yield links()
                    held = []
                name = tuple(place)
                held.append((gid, top, own, np.frombuffer(items.as_buffer(), np.uint64).copy()))
        if held:
            yield links()

    met = items.join(asked.select("sig", "gid", "comp", "own", *order), "sig").select(*order, "gid", "comp", "own", "items")
    return cut(met.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a bigint, b bigint").distinct())


def _members(lists: DataFrame, comp: DataFrame | None, draws: int = 0) -> DataFrame:
    """The members of lists of several components, with the number of holders and, the same for the whole list, ``draws`` of them that are drawn by hash.

    Without components each set is one of its own.
    """
    named = lists.withColumn("comp", F.col("gid")) if comp is None else lists.join(comp, "gid", "left").withColumn("comp", F.coalesce("comp", "gid"))
    named = cut(named.select(*_MEMBERS))
    drawn = [F.min(F.struct(F.xxhash64("gid", F.lit(i)).alias("h"), "gid", "comp")) for i in range(draws)]
    mixed = named.groupBy("key", "band").agg(F.count("*").alias("holders"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), *(d.alias(f"drawn{i}") for i, d in enumerate(drawn)))
    mixed = mixed.where("lo != hi").select("key", "band", "holders", *(f"drawn{i}" for i in range(draws)))
    return cut(named.join(mixed, ["key", "band"]).select(*_MEMBERS, "holders", *(f"drawn{i}" for i in range(draws))))


def _drawn(members: DataFrame, draws: int) -> DataFrame:
    """a, b: each set of a list with those drawn of its list that are of other components."""
    pairs = members.select("gid", "comp", F.explode(F.array(*(f"drawn{i}" for i in range(draws)))).alias("o")).where("comp != o.comp")
    return pairs.select(F.least("gid", "o.gid").alias("a"), F.greatest("gid", "o.gid").alias("b")).distinct()


def _mixed(members: DataFrame, merged: DataFrame | None) -> DataFrame:
    """The members of lists of several components by now; merged says which components (comp) have become one (top) since."""
    members = members.select(*_MEMBERS, "holders")
    if merged is None:
        return members
    # Components only grow together, so lists of one component stay so.
    now = members.join(merged, "comp", "left").withColumn("comp", F.coalesce("top", "comp")).select(*_MEMBERS, "holders")
    mixed = now.groupBy("key", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key", "band")
    return cut(now.join(mixed, ["key", "band"]).select(*_MEMBERS, "holders"))


def _in_short(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b: the close pairs of sets that share a short list but no component."""
    short = members.where(F.col("holders") <= SHORT)
    met = short.alias("x").join(short.alias("y"), F.expr(f"x.key = y.key and x.band = y.band and x.comp < y.comp and {_plausible('x', 'y', percent)}"))
    return _close(met.select(F.least("x.gid", "y.gid").alias("a"), F.greatest("x.gid", "y.gid").alias("b")).distinct(), classes, percent)


def _in_long(members: DataFrame, comp: DataFrame, classes: DataFrame, rows: DataFrame, percent: int, words: int) -> DataFrame | None:
    """a, b: links that join all components that links within long lists join; None if no pair is close.

    Sets that close pairs join are a cluster. Close pairs can be as many as the
    square of a group, so they don't leave their tasks.
    """
    close = cut(_in_blocks(members.where(F.col("holders") > SHORT), classes, percent, pairs=False))
    return None if close.isEmpty() else _in_clusters(cut(components(close)).toDF("gid", "cluster"), comp, classes, rows, percent, words)


def every_link(reps: DataFrame, lists: DataFrame, classes: DataFrame, rows: DataFrame, percent: int, words: int) -> DataFrame:
    """a, b: all links of distinct classes: the light pairs with a common key, and every close pair of a list, verified."""
    ordered = lambda pairs: pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    side = lambda c: reps.select("gid", F.explode(c).alias("key"))
    light = cut(ordered(_paired(side("small"), side("large"), ["key"])))
    members = _members(lists, None)
    close = _in_short(members, classes, percent).union(_in_blocks(members.where(F.col("holders") > SHORT), classes, percent)).distinct()
    heavy = cut(close.join(light, ["a", "b"], "left_anti"))
    return light.union(_verify(heavy, classes, rows, percent, words))


def _paired(left: DataFrame, right: DataFrame, on: list[str], size: int = 256) -> DataFrame:
    """x, y: every pair of a left and a right gid of equal keys; a key of many rows is dealt in blocks, each pair of blocks to a place of its own."""
    blocks = lambda side, n: side.groupBy(*on).agg(F.ceil(F.count("*") / size).cast("int").alias(n))
    counts = blocks(left, "n_x").join(blocks(right, "n_y"), on)
    own = lambda n: F.pmod(F.xxhash64("gid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = left.join(counts, on).select(*on, F.col("gid").alias("x"), own("n_x").alias("i"), "n_y").select(*on, "x", "i", every("n_y").alias("j"))
    y = right.join(counts, on).select(*on, F.col("gid").alias("y"), own("n_y").alias("j"), "n_x").select(*on, "y", "j", every("n_x").alias("i"))
    return x.join(y, [*on, "i", "j"]).where("x != y").select("x", "y")


def link_counts(links: DataFrame) -> DataFrame:
    """gid, n_links: how many other classes each class links to, from all links."""
    return links.select(F.explode(F.array("a", "b")).alias("gid")).groupBy("gid").agg(F.count("*").alias("n_links"))


def _stars(edges: DataFrame) -> bool:
    """Whether each node of the edges (u, v) has one v, or is one."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    return ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or (ups = 1 and least = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """gid, comp: the least node reachable from each node of the links (a, b), by alternating stars to and from the least neighbour."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while not _stars(edges):
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        far = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = far.groupBy("u").agg(F.min("v").alias("m"))
        near = far.join(least, "u")
        edges = cut(near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).where("u != v").distinct())
    return edges.select(F.col("u").alias("gid"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("gid"), F.col("v").alias("comp"))).distinct()


def _joined(comp: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """gid, comp of all nodes of the components so far and of the further links (a, b); and comp, top of the components that became one."""
    root = lambda x: F.coalesce(f"comp_{x}", x).alias(x)
    between = cut(links.join(comp.toDF("a", "comp_a"), "a", "left").join(comp.toDF("b", "comp_b"), "b", "left").select(root("a"), root("b")).where("a != b").distinct())
    if between.isEmpty():
        return comp, None
    upper = cut(components(between).toDF("comp", "top"))
    below = comp.join(upper, "comp", "left").select("gid", F.coalesce("top", "comp").alias("comp"))
    return cut(below.union(upper.toDF("gid", "comp").join(comp.select("gid"), "gid", "left_anti"))), upper


def classify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS, every: bool = False, tag_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Membership and links.

    Membership has a row per row of df: doc_id, n_shingles, class_id and component
    (a class id; both null for an empty set), component_id, and tag, the binary
    column that ``tag_col`` names, by which a caller can find the row again. Links are pairs (a, b) of class ids that were
    verified; they join all classes of a component. With ``every`` they are all
    links of distinct classes, whose number grows with the square of a group.
    """
    tag = F.col(tag_col) if tag_col else F.lit(None)
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = sets(df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), tag.cast("binary").alias("tag")), percent, words)
    groups = cut(table.where("n_shingles > 0").groupBy("sig").agg(F.min("uid").alias("gid"), F.min("doc_id").alias("least_id")))
    # Of the first rows of a class the least is its representative. The others are few, so they are what is left out.
    firsts = table.where("first")
    others = cut(firsts.select("sig", "uid").join(groups.select("sig", "gid"), "sig").where("uid != gid").select("uid"))
    reps = firsts.join(others, "uid", "left_anti").withColumnRenamed("uid", "gid")
    classes = cut(reps.select("gid", "n_shingles", "sig", "parity", "doc_id"))
    light = cut(_light_links(reps))

    lists = _lists(table, reps)
    stars = _close(lists.where("gid != pivot").select(F.col("pivot").alias("a"), F.col("gid").alias("b")).distinct(), classes, percent)
    # One check a set comes first: it joins the most part of each group.
    checked = cut(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = _verify(checked, classes, rows, percent, words)
    links = links.union(light)
    comp = cut(components(links))
    # Lists that are not in one component by then: first each set with a few others, then every pair from different components.
    members = _members(lists, comp, DRAWS)
    pairs = cut(_close(_drawn(members, DRAWS), classes, percent).join(checked, ["a", "b"], "left_anti"))
    merged = None
    if not pairs.isEmpty():
        more = _verify(pairs, classes, rows, percent, words)
        links = links.union(more)
        comp, merged = _joined(comp, more)
        checked = checked.union(pairs)
    members = _mixed(members, merged)
    found = []
    pairs = cut(_in_short(members, classes, percent).join(checked, ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        found.append(_verify(pairs, classes, rows, percent, words))
        comp = _joined(comp, found[0])[0]
    if (more := _in_long(members, comp, classes, rows, percent, words)) is not None:
        found.append(more)
        comp = _joined(comp, more)[0]
    for more in found:
        links = links.union(more)
    named_groups = groups.join(comp, "gid", "left").withColumn("comp", F.coalesce("comp", "gid"))
    least = named_groups.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    by_sig = named_groups.join(least, "comp").select("sig", "gid", F.col("comp").alias("component"), "component_id")
    # Empty sets get keys of their own and match nothing.
    key = F.when(F.col("n_shingles") > 0, F.col("sig")).otherwise(F.concat(F.lit("none-"), F.xxhash64("doc_id").cast("string")).cast("binary"))
    members = table.select("doc_id", "n_shingles", "tag", key.alias("sig")).join(by_sig, "sig", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return members.select("doc_id", "n_shingles", F.col("gid").alias("class_id"), "component", own, "tag"), every_link(reps, lists, classes, rows, percent, words) if every else links
