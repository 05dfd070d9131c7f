"""Identity resolution and deduplication (J1-J5, J13, J15, U5, U7, A15, W4, W8, F-STR5, F-STR11)."""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from inkwell.functions import text as T
from inkwell.lineage import cut


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """F-STR5: twice the matching blocks over both lengths, as difflib finds them; no built-in does."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _common(masks: dict[str, int], n: int, b: str) -> int:
    """Length of the longest common subsequence, all cells of a row of its table at once as bits of one number."""
    row = full = (1 << n) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def target_hash(targets: DataFrame, by: list[str]) -> DataFrame:
    """F-STR11: ``target_hash`` of each group's (name, description, output_format, required, pos), in the order of names. A group is one paper's or topic's short list of targets."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    one = F.to_json(F.struct(low("description").alias("description"), low("name").alias("name"), F.col("output_format"), F.col("required")))
    items = F.array_sort(F.collect_list(F.struct(low("name").alias("n"), F.col("pos"), one.alias("j"))))
    return targets.groupBy(*by).agg(F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: x["j"]), ","), F.lit("]")), 256)).alias("target_hash"))


def provider_key(paper_id: Column) -> Column:
    """The registry's key of a provider's id."""
    return F.when(paper_id.startswith("arxiv:"), paper_id).when(paper_id.rlike(r"^[0-9].*\."), F.concat(F.lit("arxiv:"), paper_id)).otherwise(F.concat(F.lit("semantic_scholar:"), paper_id))


def resolve_exact(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """Incoming (paper_id, doi, ...) with entry_id and method: the DOI's entry, else the provider key's.

    registry: entry_id, doi, provider_key. Of several entries of one DOI the last registered counts, as in an index.
    """
    by_doi = registry.where("doi is not null").groupBy("doi").agg(F.max("entry_id").alias("_by_doi"))
    by_key = registry.where("provider_key is not null").groupBy("provider_key").agg(F.max("entry_id").alias("_by_key"))
    found = incoming.withColumn("provider_key", provider_key(F.col("paper_id"))).join(by_doi, "doi", "left").join(by_key, "provider_key", "left")
    method = F.when(F.col("_by_doi").isNotNull(), "doi").when(F.col("_by_key").isNotNull(), F.substring_index("provider_key", ":", 1))
    return found.select(*incoming.columns, F.coalesce("_by_doi", "_by_key").alias("entry_id"), method.alias("method"))


def fuzzy_titles(left: DataFrame, right: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(l, r, similarity): for each left row its most similar right row, if the trigrams' Jaccard reaches the threshold.

    Exact: equal titles meet by an equi-join of distinct titles. The trigrams of
    the others are dealt by hash into one part more than linked titles of their
    size can differ in, so a linked pair has a part in common, and a common part
    of some twenty trigrams is rare otherwise. left: l, title; right: r, title.
    """
    # One row for each distinct title: copies multiply no pair.
    lk = left.select("l", T.title_key(F.col("title")).alias("k")).where("k != ''")
    rk = right.select("r", T.title_key(F.col("title")).alias("k")).where("k != ''").groupBy("k").agg(F.min("r").alias("r"))
    sets = cut(lk.select("k").union(rk.select("k")).distinct().withColumn("h", F.transform(T.trigrams(F.col("k")), lambda g: F.xxhash64(g))).withColumn("n", F.size("h")))
    # Sizes of linked titles are in one band or in neighbouring ones; each title stands in its own and the next.
    band = F.floor(F.log(F.col("n")) / math.log(1 / threshold) + 1e-9).cast("int")
    most = F.pow(F.lit(1 / threshold), F.col("band") + 1)
    parts = (F.floor(2 * most * (1 - threshold) / (1 + threshold) + 1e-9) + 1).cast("int")
    placed = sets.withColumn("band", F.explode(F.array(band, band + 1))).withColumn("parts", parts)
    own = lambda i: F.filter("h", lambda x: F.pmod(x, F.col("parts")) == i)
    key = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.xxhash64(F.col("band"), i, F.aggregate(own(i), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))))
    keyed = cut(placed.select("k", "n", F.explode(key).alias("key")))
    side = lambda keys, x: keyed.join(keys.select("k").distinct(), "k", "left_semi").select(F.col("k").alias(f"{x}k"), F.col("n").alias(f"{x}n"), "key")
    near = (F.col("an") >= F.lit(threshold) * F.col("bn")) & (F.col("bn") >= F.lit(threshold) * F.col("an")) & (F.col("ak") != F.col("bk"))
    pairs = side(lk, "a").join(side(rk, "b"), "key").where(near).select("ak", "bk").distinct()
    scored = pairs.withColumn("similarity", T.title_similarity(F.col("ak"), F.col("bk"))).where(F.col("similarity") >= threshold)
    equal = lk.select("k").distinct().join(rk.select("k"), "k").select(F.col("k").alias("ak"), F.col("k").alias("bk"), F.lit(1.0).alias("similarity"))
    best = equal.unionByName(scored).join(rk.select(F.col("k").alias("bk"), "r"), "bk").groupBy("ak").agg(F.max(F.struct("similarity", (-F.col("r")).alias("m"))).alias("x"))
    return lk.join(best, lk["k"] == best["ak"]).select("l", (-F.col("x.m")).alias("r"), F.col("x.similarity").alias("similarity"))


def action(found: DataFrame, entry: str, old_hash: str, new_hash: str, known_topic: str) -> Column:
    """What to do with a paper, in this order of tests."""
    return F.when(F.col(entry).isNull(), "full_process").when(F.col(old_hash) != F.col(new_hash), "backfill").when(F.col(known_topic), "skip").otherwise("map_only")


#: Most titles and characters of a block on either side of a comparison, left titles compared at once, bits that are unpacked at once.
BLOCK, BLOCK_LETTERS, STRIPE, UNPACKED = 8192, 1 << 25, 256, 1 << 22
#: Buckets of characters that are counted, fewest and most bits of a title's bitmap.
LETTERS, BITS = 32, (512, 1 << 15)
#: Length of a right title from which difflib takes no match from characters of more than a hundredth of it, one aside.
POPULAR = 200
#: Most tasks of a comparison in blocks.
MOST_TASKS = 4096


def _codes(titles: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The titles' characters one after another, and whose each is."""
    codes = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return codes, np.repeat(np.arange(len(titles), dtype=np.uint64), [len(t) for t in titles])


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and their lengths."""
    at = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(sorted_keys)))


def _letters(titles: list[str]) -> np.ndarray:
    """(title, bucket): how often a title has the characters of each bucket."""
    codes, row = _codes(titles)
    return np.bincount((row * LETTERS + codes % LETTERS).astype(np.int64), minlength=len(titles) * LETTERS).astype(np.int32).reshape(-1, LETTERS)


def _bitmaps(titles: list[str], bits: int, size: int) -> np.ndarray:
    """For each title the parity of its substrings of two or three characters in each of a number of bits, packed; the same substring's second, third place count as others."""
    out = np.zeros((len(titles), bits // 8), np.uint8)
    step = max(1, UNPACKED // bits)
    for i in range(0, len(titles), step):
        codes, row = _codes(part := titles[i : i + step])
        # A number for each substring; where two have the same, they count as one.
        gram = codes[: len(codes) - size + 1]
        for k in range(1, size):
            gram = gram * 0x9E3779B97F4A7C15 + codes[k : len(codes) - size + 1 + k]
        gram = (gram ^ gram >> 32) * 0xD6E8FEB86659FD93 >> 22
        begins, ends = row[: len(gram)], row[size - 1 :]
        keys = np.sort((begins << 42 | gram)[begins == ends])
        at, n = _runs(keys)
        nth = np.arange(len(keys), dtype=np.uint64) - np.repeat(at, n).astype(np.uint64)
        h = ((keys & (1 << 42) - 1) + nth * 0xD6E8FEB86659FD93) * 0x9E3779B97F4A7C15
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 >> (65 - bits.bit_length())
        odd = np.bincount(((keys >> 42) * bits + h).astype(np.int64), minlength=len(part) * bits) & 1
        out[i : i + step] = np.packbits(odd.astype(np.uint8).reshape(-1, bits), axis=1)
    return out


def _gaps(titles: list[str]) -> np.ndarray:
    """Most gaps that difflib can leave between matches with each as the right title: a long title's matches have a rare character each, but for the first."""
    size = np.array([len(t) for t in titles])
    codes, row = _codes(titles)
    keys = np.sort(row << 21 | codes)
    at, n = _runs(keys)
    of = (keys[at] >> 21).astype(np.int64)
    rare = np.bincount(of, np.where(n <= size[of] // 100 + 1, n, 0), len(titles)).astype(np.int64)
    return np.where(size < POPULAR, size, rare)


def _reaches(a: str, b: str, threshold: float) -> bool:
    """Whether difflib's ratio reaches the threshold: its matches are looked for until they are enough, or what is left isn't."""
    from difflib import SequenceMatcher

    matcher, total = SequenceMatcher(None, a, b), len(a) + len(b)
    enough = lambda matched: 2.0 * matched / total >= threshold
    matched, left, open_ = 0, min(len(a), len(b)), [(0, len(a), 0, len(b))]
    while open_ and not enough(matched) and enough(matched + left):
        i, j, k, m = open_.pop()
        left -= min(j - i, m - k)
        x, y, n = matcher.find_longest_match(i, j, k, m)
        if n:
            matched += n
            sides = [s for s in ((i, x, k, y), (x + n, j, y + n, m)) if s[0] < s[1] and s[2] < s[3]]
            left += sum(min(s[1] - s[0], s[3] - s[2]) for s in sides)
            open_ += sorted(sides, key=lambda s: s[1] - s[0])
    return enough(matched)


def _reaching(threshold: float):
    """Of a block of left titles those that reach the threshold with one of a block of right titles.

    At most (1 - t) (|a| + |b|) characters are unmatched. That bounds in how many
    characters both differ and, as each gap between matches changes two bigrams
    or four trigrams more at most, in how many of these. Trigrams tell titles apart
    better, but short bitmaps of short titles hold bigrams, whose bound is lower.
    Bitmaps a and b differ in |a| + |b| - 2 ab bits, so a product of matrices
    compares a stripe of left titles with all right ones of like length.
    """

    def found(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ks, qs = set(left["k"]), sorted(right["q"], key=len)
        cut_at = bisect_left(qs, POPULAR, key=len)
        out = reached(sorted(ks, key=len), qs[:cut_at])
        out |= reached(sorted(ks - out, key=len), qs[cut_at:])
        return pd.DataFrame({"k": pd.Series(sorted(out), dtype="str")})

    def reached(ks: list[str], qs: list[str]) -> set[str]:
        """Right titles of either side of the length at which difflib's rule changes."""
        if not ks or not qs:
            return set()
        size = 3 if len(qs[0]) >= POPULAR else 2
        bits = min(BITS[1] // 4, max(BITS[0], 1 << (len(qs[-1]) - 1).bit_length()))
        fine = [_bitmaps(x, 4 * bits, 3) for x in (ks, qs)]
        # Parity of four bits each: a quarter of the product's work, and it leaves few.
        a, b = (np.bitwise_xor.reduce(x.reshape(len(x), 4, -1), axis=1) for x in fine) if size == 3 else (_bitmaps(x, bits, size) for x in (ks, qs))
        wa, wb = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (a, b))
        fine = [x.view(np.uint64) for x in fine]
        la, lb = _letters(ks), _letters(qs)
        na, nb, gaps = np.array([len(k) for k in ks]), np.array([len(q) for q in qs]), _gaps(qs)
        unpacked = lambda x: np.unpackbits(x, axis=1).astype(np.float32)
        unmatched = lambda n, at: np.floor((1 - threshold) * (n + nb[at]) + 1e-6).astype(np.int64)
        allowed = lambda lost, at, size: lost + 2 * (size - 1) * np.minimum(lost, gaps[at])
        window = lambda n, m: np.searchsorted(nb, [threshold * n / (2 - threshold) - 1e-6, (2 - threshold) * m / threshold + 1e-6]).tolist()
        step = max(1, UNPACKED // bits)
        out = set()
        for s in range(0, len(ks), STRIPE):
            stripe = slice(s, s + STRIPE)
            low, high = window(na[stripe][0], na[stripe][-1])
            x = unpacked(a[stripe]) if low < high else None
            for c in range(low, high, step):
                at = slice(c, min(c + step, high))
                # Bits that both need at least, by the longest of the stripe; each title's own bound follows.
                both = x @ unpacked(b[at]).T
                both -= ((wb[at] - allowed(unmatched(na[stripe][-1], at), at, size)) / 2).astype(np.float32)
                near = both >= (wa[stripe] / 2).astype(np.float32)[:, None]
                for i in (np.flatnonzero(near.any(1)) + s).tolist():
                    if i in out:
                        continue
                    k, n = ks[i], len(ks[i])
                    may = np.flatnonzero(near[i - s]) + c
                    lo, hi = window(n, n)
                    may = may[(may >= lo) & (may < hi)]
                    lost = unmatched(n, may)
                    differ = np.bitwise_count(fine[1][may] ^ fine[0][i]).sum(1, dtype=np.int64)
                    like = (differ <= allowed(lost, may, 3)) & (np.abs(lb[may] - la[i]).sum(1) <= lost)
                    may, differ = may[like], differ[like]
                    masks: dict[str, int] = {}
                    for p, ch in enumerate(k if len(may) else ""):
                        masks[ch] = masks.get(ch, 0) | 1 << p
                    for j in may[np.argsort(differ, kind="stable")].tolist():
                        if _common(masks, n, qs[j]) >= threshold * (n + len(qs[j])) / 2 - 1e-9 and _reaches(k, qs[j], threshold):
                            out.add(i)
                            break
        return {ks[i] for i in out}

    return found


def dedup_against(batch: DataFrame, index: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Batch rows whose DOI and title the index doesn't have; rows of the batch aren't compared with each other.

    batch and index: pos, doi, title. Titles match from a difflib ratio on. The
    batch's distinct titles are the queries, held against the index's titles of
    like length in blocks; within a task bitmaps of bigrams and counts of
    characters rule nearly all pairs out, then a common subsequence does, and
    only the matching titles are rows.
    """
    left = batch.join(index.where("doi is not null").select("doi").distinct(), "doi", "left_anti")
    lk = cut(left.select("pos", T.title_key_unicode(F.col("title")).alias("k")).where("k != ''"))
    rk = cut(index.select(T.title_key_unicode(F.col("title")).alias("q")).where("q != ''").distinct())
    same = lk.join(rk, lk["k"] == rk["q"], "left_semi").select("pos", "k")
    # A ratio of t means at least t (|a| + |b|) / 2 equal characters, so lengths are in one band or in neighbouring ones.
    wide = (2 - threshold) / threshold
    band = lambda c: F.floor(F.log(F.length(c)) / math.log(wide) + 1e-9).cast("int")
    asked = lk.join(same.select("k").distinct(), "k", "left_anti").select("k").distinct().withColumn("own", band("k"))
    known = rk.withColumn("band", band("q"))
    # Long titles' blocks have fewer, by the longest that a band may have.
    n_blocks = F.ceil(F.count("*") / F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(BLOCK_LETTERS / F.pow(F.lit(wide), F.col("band") + 1))))).cast("int")
    blocks = known.groupBy("band").agg(n_blocks.alias("blocks"))
    looked = asked.withColumn("band", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)))
    rounds = looked.groupBy("band").agg(n_blocks.alias("rounds"))
    # As many rows as bands of length.
    sizes = cut(blocks.join(rounds, "band"))
    # Few bytes are much work here: as many tasks as pairs of blocks, which a stated number keeps from being merged by size.
    tasks = max(1, min(MOST_TASKS, sizes.agg(F.sum(F.col("blocks").cast("long") * F.col("rounds"))).first()[0] or 0))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    ls = looked.join(F.broadcast(sizes), "band").select("k", "band", own("k", "rounds").alias("x"), every("blocks").alias("y"))
    rs = known.join(F.broadcast(sizes), "band").select("q", "band", own("q", "blocks").alias("y"), every("rounds").alias("x"))
    on = ["band", "x", "y"]
    near = ls.repartition(tasks, *on).groupBy(*on).cogroup(rs.repartition(tasks, *on).groupBy(*on)).applyInPandas(_reaching(threshold), "k string").distinct()
    matched = same.select("pos").union(lk.join(near, "k", "left_semi").select("pos"))
    return left.join(matched.distinct(), "pos", "left_anti")


def components(keys: DataFrame) -> DataFrame:
    """(pos, component) for bipartite (pos, key) rows: the least row reachable through common keys.

    Min-label propagation over rows and keys, never over pairs of rows; each round also jumps to the label's own label.
    """
    edges = cut(keys.select("pos", "key").distinct())
    labels = cut(edges.select("pos").distinct().withColumn("component", F.col("pos")))
    while True:
        by_key = edges.join(labels, "pos").groupBy("key").agg(F.min("component").alias("m"))
        heard = edges.join(by_key, "key").groupBy("pos").agg(F.min("m").alias("m"))
        stepped = labels.join(heard, "pos").select("pos", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        # A label's own label: pointer jumping halves long chains.
        own = stepped.select(F.col("pos").alias("component"), F.col("component").alias("jump"))
        new = cut(stepped.join(own, "component", "left").select("pos", F.least("component", F.coalesce("jump", "component")).alias("component"), "old"))
        if not new.where("component != old").limit(1).count():
            return new.select("pos", "component")
        labels = new.select("pos", "component")


def paper_keys(papers: DataFrame) -> DataFrame:
    """(pos, key): the identifiers by which rows of several sources are the same paper."""
    norm = lambda c: F.lower(F.trim(F.col(c)))
    kinds = F.array(
        F.when(F.col("doi") != "", F.concat(F.lit("doi:"), norm("doi"))), F.when(F.col("arxiv_id") != "", F.concat(F.lit("arxiv:"), norm("arxiv_id"))),
        F.when(F.col("paper_id") != "", F.concat(F.lit("pid:"), F.col("paper_id"))), F.when(T.title_key_loose(F.col("title")) != "", F.concat(F.lit("title:"), T.title_key_loose(F.col("title")))),
    )
    return papers.select("pos", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("key"))


def merge_groups(papers: DataFrame, labels: DataFrame, complete: Column) -> DataFrame:
    """One row a component: the most complete row, the first of equals; most citations; gaps filled from the first row that has a value."""
    rows = papers.join(labels, "pos").withColumn("_c", complete)
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("pos", c)))[c]
    base = F.max(F.struct("_c", (-F.col("pos")).alias("m"), F.struct(*papers.columns).alias("row")))["row"]
    fill = ("doi", "arxiv_id", "abstract", "venue")
    got = rows.groupBy("component").agg(base.alias("base"), F.count("*").alias("source_count"), F.max(F.coalesce("citation_count", F.lit(0))).alias("most"), F.max("pdf_available").alias("pdf"), *(first(c).alias(f"first_{c}") for c in fill))
    keep = [F.coalesce(F.col("base")[c], F.col(f"first_{c}")).alias(c) if c in fill else F.col("most").alias(c) if c == "citation_count" else F.col("pdf").alias(c) if c == "pdf_available" else F.col("base")[c].alias(c) for c in papers.columns]
    return got.select("component", *keep, "source_count")


def first_wins(papers: DataFrame) -> DataFrame:
    """Rows in order of pos; one stays unless its DOI (or id), or its lower-case title, is that of a row that stayed.

    Not a closure: a row that went hides nothing. Each round a row stays that is
    the first undecided one of both its keys, and the rows that share a key with
    it go; a round is two partial aggregates and joins, whatever the keys' sizes.
    A missing title is an empty one.
    """
    ident, name = F.concat(F.lit("i:"), F.coalesce("doi", "paper_id", F.lit(""))), F.concat(F.lit("t:"), F.lower(F.trim(F.coalesce("title", F.lit("")))))
    open_rows = cut(papers.select("pos", ident.alias("i"), name.alias("t")).groupBy("i", "t").agg(F.min("pos").alias("pos")))
    kept = None
    while True:
        first = lambda k: open_rows.groupBy(k).agg(F.min("pos").alias(f"first_{k}"))  # noqa: B023, E731
        stay = cut(open_rows.join(first("i"), "i").join(first("t"), "t").where("pos = first_i and pos = first_t").select("i", "t", "pos"))
        kept = stay.select("pos") if kept is None else kept.union(stay.select("pos"))
        open_rows = cut(open_rows.join(stay.select("i"), "i", "left_anti").join(stay.select("t"), "t", "left_anti"))
        if not open_rows.limit(1).count():
            return papers.join(kept, "pos", "left_semi")


def discovery_filter(batch: DataFrame, registry: DataFrame) -> DataFrame:
    """(pos, is_new, reason). Rows that the registry knows are filtered; a later row of the batch can match an earlier one.

    A batch row that matches becomes no entry of its own, so a row is a
    duplicate exactly where it shares a DOI or a title with a row that was
    registered before it: ``first_wins`` with the registry in front.
    batch: pos, paper_id, doi, title; registry: doi, title.
    """
    known = batch.join(registry.where("doi is not null").select("doi", F.lit(True).alias("_d")).distinct(), "doi", "left")
    titles = registry.select(T.title_key(F.col("title")).alias("_k"), F.lit(True).alias("_t")).distinct()
    known = known.withColumn("_k", T.title_key(F.col("title"))).join(titles, "_k", "left")
    reason = F.when(F.col("_d"), "doi").when(F.col("_t") & (F.col("_k") != ""), "title")
    judged = cut(known.select(*batch.columns, reason.alias("reason")))
    fresh = judged.where("reason is null").select("pos", "paper_id", "doi", F.col("title"))
    kept = first_wins(fresh.withColumn("title", F.when(T.title_key(F.col("title")) == "", F.concat(F.lit("\x00"), F.col("pos").cast("string"))).otherwise(T.title_key(F.col("title"))))).select("pos", F.lit(True).alias("kept"))
    return judged.join(kept, "pos", "left").select("pos", F.coalesce("kept", F.lit(False)).alias("is_new"), F.when(F.col("kept"), None).otherwise(F.coalesce("reason", F.lit("batch"))).alias("reason"))


def cache_or_compute(wanted: DataFrame, cache: DataFrame, key: str, as_of: str, days: int, compute) -> DataFrame:
    """Fresh cached rows and, for the other keys, what ``compute(keys)`` gives."""
    fresh = cache.where(F.col("computed_at") >= F.date_sub(F.lit(as_of).cast("date"), days))
    hits = wanted.select(key).distinct().join(fresh, key)
    misses = wanted.select(key).distinct().join(fresh.select(key), key, "left_anti")
    return hits.select(cache.columns).unionByName(compute(misses).select(cache.columns))


def supplement(main: DataFrame, extra: DataFrame, wanted_rate: float) -> DataFrame:
    """Where too few rows have a PDF, the extra rows whose id and title are new are appended."""
    rate = main.agg(F.coalesce(F.avg(F.col("pdf_available").cast("int")), F.lit(0.0))).first()[0]
    if rate >= wanted_rate:
        return main
    name = lambda df: df.withColumn("_k", T.title_key(F.col("title")))
    new = name(extra).join(main.select("paper_id"), "paper_id", "left_anti").join(name(main).select("_k"), "_k", "left_anti")
    return main.unionByName(new.select(main.columns))


def diverse_sample(rows: DataFrame, most: int, share: float = 0.2) -> DataFrame:
    """The best by quality up to int(most (1 - share)), then rows with a topic not seen yet, then the next best.

    rows: pos, quality, topics. A row brings an unseen topic exactly if it is
    the topic's best row and not among the head, so those rows follow in order.
    """
    head = int(most * (1 - share))
    order = [F.col("quality").desc(), F.col("pos")]
    best = cut(rows.select("pos", "quality").orderBy(*order).limit(most).withColumn("place", F.row_number().over(W.orderBy(*order))))  # at most ``most`` rows
    taken = best.where(F.col("place") <= head).select("pos")
    first = rows.select("pos", "quality", F.explode("topics").alias("topic")).groupBy("topic").agg(F.max(F.struct("quality", (-F.col("pos")).alias("m"))).alias("x"))
    firsts = first.select((-F.col("x.m")).alias("pos"), F.col("x.quality").alias("quality")).distinct()
    taken = cut(taken.union(firsts.join(taken, "pos", "left_anti").orderBy(*order).limit(most - head).select("pos")))
    rest = best.join(taken, "pos", "left_anti").orderBy("place").limit(max(0, most - taken.count())).select("pos")
    return rows.join(taken.union(rest), "pos", "left_semi")
