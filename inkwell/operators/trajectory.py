"""Session trajectories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from inkwell.functions import text as T


def action_grams(turns: DataFrame, n: int = 3) -> DataFrame:
    """(conv_id, turn, gram): n consecutive actions of a trajectory."""
    w = W.partitionBy("conv_id").orderBy("turn")
    parts = [F.lead("action", i).over(w) for i in range(n)]
    return turns.select("conv_id", "turn", F.concat_ws(" > ", *parts).alias("gram"), parts[-1].alias("_last")).where("_last is not null").drop("_last")


def top_grams(turns: DataFrame, k: int = 5) -> DataFrame:
    """The most frequent sequences of three actions; ties by name."""
    return action_grams(turns).groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "gram").limit(k)


def top_terms(turns: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent words of more than three letters in what users asked; ties by name."""
    words = turns.where("action = 'user'").select(F.explode(T.words(F.col("text"))).alias("term")).where(F.length("term") > 3)
    return words.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "term").limit(k)


def summary(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, answered, n_actions, tokens) of each trajectory."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max((F.col("action") == "assistant").cast("int")).alias("answered"), F.count_distinct("action").alias("n_actions"), F.sum("tokens").alias("tokens"))


def quality(answered: Column, n_turns: Column, n_papers: Column, alignment: Column) -> Column:
    """0.4 for an answer, up to 0.2 each for a reasonable number of turns and of papers, 0.2 for the alignment."""
    turns = F.when(n_turns.between(3, 15), 0.2).when(n_turns > 0, 0.1).otherwise(0.0)
    papers = F.when(n_papers >= 3, 0.2).when(n_papers >= 1, 0.1).otherwise(0.0)
    return F.round(F.when(answered, 0.4).otherwise(0.0) + turns + papers + 0.2 * alignment, 4)


def lcs_lengths(a: list, b: list) -> int:
    """Length of the longest common subsequence, one row of the table at a time."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@F.pandas_udf(DoubleType())
def alignment(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence over the longer length, 0 if both are empty; a table fill that no expression states."""
    return pd.Series([lcs_lengths(list(x), list(y)) / max(len(x), len(y), 1) for x, y in zip(a, b, strict=True)], dtype="float64")


def worthwhile(scored: DataFrame, seeds: DataFrame | None = None, least_turns: int = 3, least: float = 0.5) -> DataFrame:
    """P10: answered trajectories of enough turns and quality, and the expert seeds."""
    kept = scored.where((F.col("n_turns") >= least_turns) & (F.col("answered") == 1) & (F.col("score") >= least))
    return kept if seeds is None else kept.unionByName(seeds)


def statistics(scored: DataFrame) -> DataFrame:
    """One row of counts, means and score bands."""
    s = F.col("score")
    return scored.agg(
        F.count("*").alias("n"), F.sum("answered").alias("with_answer"), F.round(F.avg("score"), 6).alias("avg_score"), F.round(F.avg("n_turns"), 6).alias("avg_turns"), F.sum("tokens").alias("tokens"),
        F.count_if(s >= 0.8).alias("high"), F.count_if((s >= 0.5) & (s < 0.8)).alias("medium"), F.count_if(s < 0.5).alias("low"),
    )


def tips(insights: DataFrame, rules: list[tuple[str, str, float, str]], least: float = 0.7) -> DataFrame:
    """(tip, confidence) of the rules (column, SQL condition, confidence, text) that hold and are sure enough."""
    made = F.array(*(F.when(F.expr(cond), F.struct(F.lit(text).alias("tip"), F.lit(conf).alias("confidence"))) for _, cond, conf, text in rules if conf >= least))
    return insights.select(F.explode(F.filter(made, lambda x: x.isNotNull())).alias("x")).select("x.*")
