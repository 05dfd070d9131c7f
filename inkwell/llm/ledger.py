"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document. The ledger keeps the measurements and
one bit for each rule that fails; policies are versioned masks over those bits,
and ablations come from bitwise sums of the ledger without reading a text
again. Only built-in functions are used.

Defined results: a null or empty text has no words, fails ``few_words`` and no
rule that divides by a count. Repeated rows give repeated, equal results. Extra
columns are left out, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import SPACE, WORD, settled

WINDOW = 8


def _repeated(words: Column) -> Column:
    """Number of words inside windows of eight words that occur twice or more in the text."""
    n = F.size(words)
    keys = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(WINDOW))))
    return F.when(n > WINDOW, keys)


def _covered(keys: Column) -> Column:
    """Words that the repeated windows cover; keys holds a hash for each window, in order."""
    at = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

    def starts(s: Column) -> Column:
        twice = F.filter(
            F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), (F.coalesce(F.get(s, j - 1)["k"] == x["k"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False))).alias("twice"))),
            lambda x: x["twice"],
        )
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def total(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")))["n"]

    # One-element arrays bind each step's result to a variable.
    return F.transform(F.transform(F.array(at), starts), total)[0]


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements of each text."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), F.length("text").alias("n_chars"), F.regexp_count("text", F.lit(SPACE)).alias("n_spaces"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_bangs"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
    )
    rows = rows.select("*", _repeated(F.col("words")).alias("keys"))
    return settled(rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), (F.col("n_chars") - F.col("n_spaces")).cast("long").alias("word_chars"), "n_symbols",
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("keys").isNotNull() & (F.size(F.array_distinct("keys")) < F.size("keys")), _covered(F.col("keys"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"), "n_upper", "n_bangs",
    ))


def _c(name: str) -> Column:
    return F.col(name)


def rules() -> tuple[tuple[str, Column], ...]:
    """The rules, in the order of their bits; a rule is never removed or moved, only left out of a policy."""
    return (
        ("few_words", _c("n_words") < 20),
        ("repeated_words", 100 * _c("n_repeat_words") > 30 * _c("n_words")),
        ("symbols", 10 * _c("n_symbols") > 5 * _c("n_words")),
        ("short_words", 10 * _c("word_chars") < 20 * _c("n_words")),
        ("long_words", _c("word_chars") > 20 * _c("n_words")),
        ("duplicate_lines", 100 * _c("n_dup_lines") > 50 * _c("n_lines")),
        ("capitals", 100 * _c("n_upper") > 60 * _c("word_chars")),
        ("bangs", 100 * _c("n_bangs") > 50 * _c("n_words")),
        ("few_distinct", (_c("n_words") >= 50) & (100 * _c("n_distinct_words") < 5 * _c("n_words"))),
    )


NAMES = ("few_words", "repeated_words", "symbols", "short_words", "long_words", "duplicate_lines", "capitals", "bangs", "few_distinct")
#: Versioned policies: the rules that reject a document. A published version is never edited.
POLICIES = {1: ("few_words", "repeated_words"), 2: NAMES}
BASE_POLICY, CURRENT_POLICY = 1, 2


def mask(version: int) -> int:
    return sum(1 << NAMES.index(r) for r in POLICIES[version])


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and ``failed``, whose bit i is set where rule i fails."""
    measured = measure(df, id_col, text_col)
    bits = F.lit(0).cast("long")
    for i, (name, fails) in enumerate(rules()):
        assert NAMES[i] == name
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("failed", bits)


def apply_policy(led: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy fails."""
    return led.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(version)).cast("long")) == 0)


def ablations(led: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    """rule, n_failed, n_only, kept_without: what each rule of a policy rejects, and what stays if it is left out.

    The ledger is first reduced to one row for each pattern of bits, of which
    there are at most two to the number of rules.
    """
    full = F.lit(mask(version)).cast("long")
    bits = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << NAMES.index(r)).cast("long").alias("bit")) for r in POLICIES[version]))
    by_rule = led.groupBy("failed").agg(F.count("*").alias("n")).select(F.col("failed").bitwiseAND(full).alias("failed"), "n", F.explode(bits).alias("b")).select("failed", "n", "b.*")
    count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    hit, only = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed") == F.col("bit")
    return by_rule.groupBy("rule").agg(count(hit).alias("n_failed"), count(only).alias("n_only"), count(only | (F.col("failed") == 0)).alias("kept_without"))


def with_ablations(led: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    """The ledger with sole_rule, the one rule of the policy that fails if it is only one, and kept_without, how many documents stay without that rule."""
    alone = F.col("failed").bitwiseAND(F.lit(mask(version)).cast("long"))
    sole = F.lit(None).cast("string")
    for r in POLICIES[version]:
        sole = F.when(alone == (1 << NAMES.index(r)), r).otherwise(sole)
    # As many rows as rules.
    counts = F.broadcast(ablations(led, version).select(F.col("rule").alias("sole_rule"), "kept_without"))
    return led.withColumn("sole_rule", sole).join(counts, "sole_rule", "left")
