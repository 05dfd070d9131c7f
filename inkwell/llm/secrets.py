"""Secret scan with corpus-wide ownership frequency.

Regular expressions propose credentials in every whole text. Each candidate
value is hashed, and the hashes are counted over the whole corpus by distinct
repositories and distinct owners. A value that many owners or very many
repositories hold is a copied example; one that a single owner holds, and that
doesn't look like a placeholder, looks live. Only built-in functions are used.

Defined results: a null text is an empty one and has no spans. Repeated rows
give repeated, equal results and count once. A null owner is an owner of its
own; a row with a null id counts by its text. Extra columns are left out, so
their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import cut
from inkwell.llm.spans import joined, matches, span_array

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: (kind, pattern); the first three are the base kinds, in the order of the result.
KINDS = (
    ("assign", ASSIGN),
    ("access", r"AKIA[A-Z0-9]+"),
    # The maximal runs of 16 characters or more: those of [0-9a-f]+ that pass the check of length.
    ("hex", r"[0-9a-f]{16,}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    ("prefixed", r"(?:gh[pousr]_[A-Za-z0-9]{30,}+|xox[abprs]-[A-Za-z0-9-]{20,}+|sk_live_[A-Za-z0-9]{16,}+)"),
)
BASE = 3
#: A value that at least so many owners, or repositories, hold is an example; a value of fewer distinct characters is a placeholder.
COPIED_OWNERS, COPIED_REPOS, LEAST_CHARS = 3, 20, 6


def _keep(kind: str):
    if kind == "assign":
        return lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 1)) >= 12
    if kind == "access":
        return lambda hit: F.length(hit) >= 18
    return lambda hit: F.lit(True)


def _value(span: Column) -> Column:
    return F.when(span["kind"] == "assign", F.regexp_extract(span["hit"], ASSIGN, 1)).otherwise(span["hit"])


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, owner, key (null without a candidate) and spans with hashed values."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", *(matches(F.col("text"), p).alias(f"m_{k}") for k, p in KINDS))
    rows = rows.select(
        "doc_id", "owner", "text",
        F.array_sort(F.concat(*(span_array(F.col("text"), F.col(f"m_{k}"), p, k, n, _keep(k)) for n, (k, p) in enumerate(KINDS)))).alias("hits"),
    )
    held = F.transform(
        "hits",
        lambda s: F.struct(
            s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"), s["kind"].alias("kind"),
            F.sha2(_value(s), 256).alias("value"),
            (F.size(F.array_distinct(F.split(_value(s), ""))) < LEAST_CHARS).alias("placeholder"),
        ),
    )
    key = F.sha2(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("owner", F.lit("")), "text"), 256)
    return rows.select("doc_id", "owner", F.when(F.size("hits") > 0, key).alias("key"), held.alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """value, n_repos, n_owners: every candidate hash by distinct repositories and owners.

    The rows of a common value are spread over (value, owner, repository) before
    they are counted, and each later count starts from partial sums.
    """
    one = found.where(F.col("key").isNotNull()).select(
        F.coalesce(F.col("doc_id").cast("string"), F.col("key")).alias("repo"), F.coalesce("owner", F.lit("\x00")).alias("owner"), F.explode(F.array_distinct(F.transform("spans", lambda s: s["value"]))).alias("value")
    )
    by_owner = one.distinct().groupBy("value", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """doc_id, spans array<struct<start, end, kind, verdict, n_repos, n_owners>>, one row per input row.

    verdict: ``example`` where the value is a placeholder or at least
    ``copied_owners`` owners or ``copied_repos`` repositories hold it, ``shared``
    where more than one owner does, else ``live``.
    """
    found = cut(find(df, id_col, text_col, owner_col))
    one = found.where(F.col("key").isNotNull()).select("key", F.explode("spans").alias("s")).select("key", "s.*").distinct()
    judged = one.join(ownership(found), "value").withColumn(
        "verdict", F.when(F.col("placeholder") | (F.col("n_owners") >= copied_owners) | (F.col("n_repos") >= copied_repos), "example").when(F.col("n_owners") > 1, "shared").otherwise("live")
    )
    by_key = judged.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "end", "kind", "verdict", "n_repos", "n_owners"))).alias("spans"))
    # Rows without a candidate get keys of their own, which match nothing and are spread evenly.
    left = found.select("doc_id", F.coalesce("key", F.concat(F.lit("none-"), F.xxhash64("doc_id").cast("string"))).alias("key"))
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string,verdict:string,n_repos:bigint,n_owners:bigint>>")
    return left.join(by_key, "key", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of the query, from those of ``scan``; span_counts has repositories:owners of each span's value."""
    base = F.filter("spans", lambda s: s["kind_no"] < BASE)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    verdict = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    return scanned.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k, _ in KINDS[:BASE]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        verdict("live").alias("n_live"), verdict("shared").alias("n_shared"), verdict("example").alias("n_example"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["n_repos"], s["n_owners"])), ",").alias("span_counts"),
    )
