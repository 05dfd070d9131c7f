"""Quality classifier: a sparse ensemble of rules.

Statistics of the whole text are Spark column expressions. Shallow trees are
grown on a bounded sample of labelled rows; every path from a root is one
conjunctive rule. A logistic regression with an L1 penalty weighs the rules and
drops most, and those that remain are compiled into one column expression.

The sample is bounded by ``most_rows`` (20,000) labelled rows, those of the
smallest hash of the id; more labels than that change nothing but which rows
are drawn. Scoring reads every row.

Defined results: a null text is an empty one and gets a score like any other.
Where an id has several different labels, each label counts, and repeated equal
ones count once; of several documents with one id the one of the least
statistics is learnt from. Null labels and labels without a document don't count. Without two classes the score is the share of
label 1, or 0.5 without any label. Extra columns are left out by ``score``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import SPACE, WORD, settled

MOST_ROWS, TREES, DEPTH, BINS, PENALTY, STEPS, SEED = 20_000, 24, 3, 24, 0.004, 300, 7
THRESHOLD = 0.3


def _counts(text: Column) -> dict[str, Column]:
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("double")
    return {
        "words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        "c_chars": F.length(text).cast("double"),
        "c_spaces": count(SPACE),
        "c_upper": count(r"\p{Lu}"),
        "c_digits": count("[0-9]"),
        "c_symbols": count(r"[#*$%&|<>]"),
        "c_bangs": count("!"),
        "c_stops": count(r"[.,;:?]"),
        "c_tags": count(r"[@{}\[\]()/\\_=+]"),
        "c_lines": count("\n"),
        "c_short": count(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,3}(?![^\x20\x09-\x0D])"),
        "c_again": count(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)\x20\1(?![^\x20\x09-\x0D])"),
    }


#: Statistics in the order of the model's columns; shares are of words or of the characters in them.
STATISTICS = ("log_words", "word_length", "upper", "digits", "symbols", "bangs", "stops", "tags", "line_words", "short", "again", "distinct", "lone")


def statistics(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep and the statistics of each whole text."""
    rows = df.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = rows.select(*keep, *(c.alias(n) for n, c in _counts(F.col("_text")).items()))
    n, chars = F.size("words").cast("double"), F.col("c_chars") - F.col("c_spaces")
    per_word = lambda c: F.when(n > 0, c / n).otherwise(0.0)
    per_char = lambda c: F.when(chars > 0, c / chars).otherwise(0.0)
    made = {
        "log_words": F.log1p(n), "word_length": per_word(chars), "upper": per_char(F.col("c_upper")), "digits": per_char(F.col("c_digits")), "symbols": per_word(F.col("c_symbols")),
        "bangs": per_word(F.col("c_bangs")), "stops": per_word(F.col("c_stops")), "tags": per_char(F.col("c_tags")), "line_words": n / (F.col("c_lines") + 1), "short": per_word(F.col("c_short")),
        "again": per_word(F.col("c_again")), "distinct": per_word(F.size(F.array_distinct("words")).cast("double")), "lone": F.when(n > 0, F.log1p(F.length(F.array_max("words")).cast("double"))).otherwise(0.0),
    }
    return settled(rows.select(*keep, *(made[k].alias(k) for k in STATISTICS)))


#: A condition is (statistic, threshold, whether above); a rule holds where all its conditions do.
Condition = tuple[int, float, bool]


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[tuple[float, tuple[Condition, ...]], ...]

    def column(self) -> Column:
        """The score as one expression over the statistics."""
        total = F.lit(self.bias)
        for weight, conditions in self.rules:
            test = F.lit(True)
            for i, at, above in conditions:
                c = F.col(STATISTICS[i])
                test = test & (c > at if above else c <= at)
            total = total + F.when(test, F.lit(weight)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for weight, conditions in self.rules:
            total += weight * _holds(x, conditions)
        return 1 / (1 + np.exp(-total))


def _holds(x: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for i, at, above in conditions:
        out &= x[:, i] > at if above else x[:, i] <= at
    return out


def _grow(binned: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, columns: np.ndarray, depth: int, path: tuple, rules: list) -> None:
    """Split where the squared error falls most, and note the path to each child."""
    if not depth or len(rows) < 20:
        return
    r = residual[rows]
    best = (1e-9, -1, 0)
    for j in columns:
        if not len(edges[j]):
            continue
        n = np.bincount(binned[rows, j], minlength=len(edges[j]) + 1)
        s = np.bincount(binned[rows, j], r, minlength=len(edges[j]) + 1)
        nl, sl = np.cumsum(n)[:-1], np.cumsum(s)[:-1]
        nr, sr = len(rows) - nl, r.sum() - sl
        ok = (nl >= 5) & (nr >= 5)
        gain = np.where(ok, sl**2 / np.maximum(nl, 1) + sr**2 / np.maximum(nr, 1) - r.sum() ** 2 / len(rows), 0)
        if gain.max() > best[0]:
            best = (gain.max(), int(j), int(gain.argmax()))
    if best[1] < 0:
        return
    _, j, cut = best
    for above in (False, True):
        own = rows[(binned[rows, j] > cut) == above]
        longer = (*path, (j, float(edges[j][cut]), above))
        rules.append(longer)
        _grow(binned, edges, residual, own, columns, depth - 1, longer, rules)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, seed: int = SEED) -> list[tuple[Condition, ...]]:
    """The distinct paths of boosted shallow trees, each grown on half of the rows and columns."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    found: dict[tuple, None] = {}
    for _ in range(trees):
        rows = np.sort(rng.permutation(len(y))[: max(1, len(y) // 2)])
        columns = np.sort(rng.permutation(x.shape[1])[: max(1, (x.shape[1] + 1) // 2)])
        rules: list[tuple] = []
        residual = y - 1 / (1 + np.exp(-margin))
        _grow(binned, edges, residual, rows, columns, depth, (), rules)
        for r in rules:
            found.setdefault(tuple(sorted(r)), None)
        parents = {r[:-1] for r in rules}
        for leaf in (r for r in rules if r not in parents):
            held = _holds(x, leaf)
            if held.any():
                margin[held] += 0.3 * np.clip(residual[held].mean() / max(0.02, np.mean(y[held]) * (1 - np.mean(y[held]))), -4, 4)
    return list(found)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Weights of the rules by accelerated proximal gradient; the bias has no penalty."""
    n, m = z.shape
    scale = np.maximum(z.std(0), 0.05)
    a = z / scale
    w, b = np.zeros(m), float(np.log(y.mean() / (1 - y.mean())))
    # A bound of the curvature from the power method on the Gram matrix.
    v = np.ones(m) / np.sqrt(max(m, 1))
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    step = 1 / (0.25 * (np.linalg.norm(a @ v) ** 2 / n + 1) + 1e-9)
    w1, b1, t = w, b, 1.0
    for _ in range(steps):
        err = 1 / (1 + np.exp(-(a @ w1 + b1))) - y
        g = w1 - step * (a.T @ err) / n
        new = np.sign(g) * np.maximum(np.abs(g) - step * penalty, 0)
        new_b = b1 - step * err.mean()
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w1, b1 = new + (t - 1) / t1 * (new - w), new_b + (t - 1) / t1 * (new_b - b)
        w, b, t = new, new_b, t1
    return b, w / scale


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> RuleModel:
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return RuleModel(float(np.log(share / (1 - share))), ())
    rules = tree_rules(x, y)
    held = np.stack([_holds(x, r) for r in rules], 1) if rules else np.zeros((len(y), 0))
    bias, weights = lasso_logistic(held.astype(float), y, penalty)
    return RuleModel(round(float(bias), 6), tuple((round(float(w), 6), r) for w, r in zip(weights, rules, strict=True) if abs(w) > 1e-4))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS, penalty: float = PENALTY) -> RuleModel:
    """The model of the labelled rows that aren't held out."""
    own = labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("_y")).distinct()
    # At most most_rows narrow rows: their size is bounded by the parameter.
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(most_rows)
    drawn = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # One row a label, so at most most_rows of them.
    one = statistics(drawn, keep=("doc_id", "_y")).groupBy("doc_id", "_y").agg(F.min(F.struct(*STATISTICS)).alias("s")).select("doc_id", "_y", "s.*")
    rows = one.toPandas().sort_values(["doc_id", "_y"])
    return fit_rules(rows[list(STATISTICS)].to_numpy(float), rows["_y"].to_numpy(float), penalty)


def score(docs: DataFrame, model: RuleModel, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns to keep, the score and the statistics of every row."""
    return statistics(docs, text_col, keep).withColumn("score", model.column())
