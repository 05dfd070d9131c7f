"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor when the smallest of its inner s-mers is its
first or its last one. That depends on the k-mer alone, so the same passage has
the same anchors in any text. A fingerprint keeps all distinct anchors with their
first positions, at one density for every length; two fingerprints are compared
by the anchors that both have at one common displacement.

Defined results: a null text is an empty one; an empty text's fingerprint is
``0:`` and its likeness is 1 to another empty one and 0 to any other. A text of
fewer than k code points is one anchor; one without any closed syncmer has the
k-mer of the smallest s-mer. Repeated rows give repeated, equal
results; rows with equal ids are ordered by text, and a null id comes last.
"""

from __future__ import annotations

from base64 import b64decode, b64encode
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, S = 16, 8
#: The displacement within which positions agree.
DRIFT = 64
#: Characters of results that a task holds before it passes them on.
HELD = 1 << 22
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _windows(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive codes: a polynomial over doubling widths, mixed at the end."""
    have, width, power, out, done = codes, 1, _MUL, None, 0
    m = len(codes) - n + 1
    with np.errstate(over="ignore"):
        while width <= n:
            if n & width:
                part = have[done : done + m]
                out = part if out is None else out * power + part
                done += width
            if 2 * width <= n:
                have = have[:-width] * power + have[width:]
            width, power = 2 * width, power * power
    return _mix(out)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n consecutive values."""
    width, m = 1, len(x) - n + 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:m], x[n - width : n - width + m])


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first positions of the closed syncmers, in the order of the hashes."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(codes):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(codes) < k:
        return _windows(codes, len(codes)), np.zeros(1, np.int64)
    inner = _windows(codes, s)
    least = _least(inner, k - s + 1)
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[k - s :] == least))
    if not len(at):
        at = np.array([int(least.argmin())])
    # The k-mer's hash comes from its two halves' s-mers, as k is twice s.
    hashes, first = np.unique(_mix(inner[at] * _MUL + inner[at + k - s]), return_index=True)
    return hashes, at[first]


#: Hashes and first positions, in the order of the hashes.
Sketch = tuple[np.ndarray, np.ndarray]
_ANCHOR = np.dtype([("hash", "<u8"), ("position", "<u4")])


def sketch(text: str) -> Sketch:
    """All anchors of the text."""
    return anchors(text)


def write(sk: Sketch) -> str:
    """The fingerprint: ``number of anchors:`` and, in base64, 8 bytes of hash and 4 of position for each, little-endian."""
    out = np.empty(len(sk[0]), _ANCHOR)
    out["hash"], out["position"] = sk
    return f"{len(out)}:" + b64encode(out.tobytes()).decode()


def parse(fp: str) -> Sketch:
    got = np.frombuffer(b64decode(fp.partition(":")[2]), _ANCHOR)
    return got["hash"].astype(np.uint64), got["position"].astype(np.int64)


def likeness(a: Sketch, b: Sketch, drift: int = DRIFT) -> float:
    """Share of the anchors of either text that both have at one displacement."""
    (x, at_x), (y, at_y) = a, b
    if np.array_equal(x, y) and np.array_equal(at_x, at_y):
        return 1.0
    if not len(x) or not len(y):
        return 0.0
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    # Neighbouring steps share a counter, so that a displacement near a step's end is counted whole.
    near = (at_y[j] - at_x[i]) // drift
    most = np.unique(np.concatenate([near, near + 1]), return_counts=True)[1].max()
    return int(most) / (len(x) + len(y) - len(both))


def edited(text: str, following: str) -> str:
    """The text whose last half is replaced by as much of the beginning of the following text."""
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


def in_order(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """bucket, guest, doc_id, text: buckets of consecutive ids, the largest id first, each with the next one's first row as a guest.

    Every text is moved once. The cut points and each bucket's first id come
    from scans of the ids alone, and there are as many as buckets.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [(i + 1) / buckets for i in range(buckets)], 20 * buckets)).first()[0]
    cuts = np.unique(np.array(cuts or [], np.int64))
    null = len(cuts) + 1

    def homes(ids: pa.Array) -> np.ndarray:
        own = len(cuts) - np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False))
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), null, own).astype(np.int32)

    def tops(batches):
        best: dict[int, int | None] = {}
        for b in batches:
            ids = b.column(0)
            for home, i in zip(homes(ids).tolist(), ids.to_pylist(), strict=True):
                if home not in best or (i is not None and i > best[home]):
                    best[home] = i
        yield pa.RecordBatch.from_pydict({"bucket": list(best), "head": list(best.values())}, schema=pa.schema([("bucket", pa.int32()), ("head", pa.int64())]))

    found = rows.select("doc_id").mapInArrow(tops, "bucket int, head bigint").groupBy("bucket").agg(F.max("head").alias("head")).collect()
    heads = sorted((r["bucket"], r["head"]) for r in found)
    # The row after the last one is the first one.
    guest_of = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}

    def deal(batches):
        for b in batches:
            ids = b.column(0)
            extra = [i for i, x in enumerate(ids.to_pylist()) if x in guest_of]
            at = pa.array([*range(b.num_rows), *extra], pa.int64())
            to = np.concatenate([homes(ids), np.array([guest_of[ids[i].as_py()] for i in extra], np.int32)])
            flags = np.arange(len(at)) >= b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(flags), ids.take(at), b.column(1).take(at)], ["bucket", "guest", "doc_id", "text"])

    dealt = rows.mapInArrow(deal, "bucket int, guest boolean, doc_id bigint, text string")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text")


def compare_edits(ordered: DataFrame) -> DataFrame:
    """The columns of the query, one row per row of ``in_order`` that is no guest."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def rows(batches) -> Iterator[tuple]:
        before = None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                for bucket, guest, doc_id, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    own = None
                    if before is not None and before[0] == bucket:
                        _, last_id, last_text, last = before
                        new = edited(last_text, text)
                        own, changed = sketch(text), sketch(new)
                        yield last_id, len(last_text), sha256(new.encode()).hexdigest(), write(last), write(changed), likeness(last, changed), likeness(last, own)
                    before = None if guest else (bucket, doc_id, text, own or sketch(text))

    def run(batches):
        held, size = [], 0
        for r in rows(batches):
            held.append(r)
            size += len(r[3]) + len(r[4])
            if len(held) == 1024 or size > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    return ordered.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every whole text."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                part = whole.slice(at, 64)
                made = [write(sketch(t or "")) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    return df.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, "doc_id bigint, fingerprint string")
