"""Readers (S9-S19, N33): captured payloads, registries, corpora, trajectories and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources import files

#: Fixed shapes of the stored tables (S14). Keys are checked by the operators that write them.
TABLES = {
    "nodes": "node_id string, node_type string, properties map<string,string>, version int, created_at timestamp, updated_at timestamp",
    "edges": "edge_id string, edge_type string, source_id string, target_id string, properties map<string,string>, version int",
    "time_series": "series_id string, period date, metric_name string, value double, metadata map<string,string>",
    "subscriptions": "subscription_id string, user_id string, config string, active boolean, created_at timestamp, cursor date, backfill_days int",
    "monitoring_runs": "run_id string, subscription_id string, status string, started_at timestamp, finished_at timestamp, n_seen int, n_new int",
    "monitoring_papers": "run_id string, paper_id string, title string, is_new boolean, source string, score double",
    "influence": "paper_id string, citation_count int, velocity double, pagerank double, hub double, authority double, computed_at date",
    "coupling": "a string, b string, shared_references array<string>, strength double, computed_at date",
}
#: Rows of a provider's captured answers.
PAPER = "paper_id string, title string, abstract string, published date, year int, citation_count int, venue string, doi string, pdf_url string"
FEEDBACK = "array<struct<id:string,paper_id:string,topic_slug:string,rating:string,reasons:array<string>,free_text:string,timestamp:timestamp>>"
TRAJECTORY = "trajectory_id string, question string, answer string, quality_score double, turns array<struct<turn_number:int,reasoning:string,action:struct<tool:string,arguments:map<string,string>>,observation:string,observation_tokens:int>>, created_at timestamp, _bad string"


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table with its fixed shape."""
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def captured(spark: SparkSession, path: str, mapper) -> DataFrame:
    """Payloads captured as text lines, through a provider's mapper."""
    return mapper(spark.read.text(path))


def search(spark: SparkSession, path: str, fields: tuple[str, ...] | None = None, start: str | None = None, end: str | None = None, min_citations: int | None = None, most: int | None = None) -> DataFrame:
    """Captured rows of a provider (JSON lines), as its search would give them.

    Dates, citations and the field list are filters and columns of the scan, so
    they are applied while reading; the limit is one over all files, latest first.
    """
    rows = spark.read.schema(PAPER).json(path)
    if start is not None:
        rows = rows.where(F.col("published") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("published") <= F.lit(end).cast("date"))
    if min_citations is not None:
        rows = rows.where(F.col("citation_count") >= min_citations)
    if most is not None:
        rows = rows.orderBy(F.col("published").desc_nulls_last(), "paper_id").limit(most)
    return rows.select(*(fields or rows.columns))


def references(edges: DataFrame, ids: DataFrame, direction: str = "references") -> DataFrame:
    """Citation edges of many seeds by one semi-join."""
    end = "source_id" if direction == "references" else "target_id"
    return edges.join(ids.select(F.col("node_id").alias(end)), end, "left_semi")


def first_answer(*answers: DataFrame) -> DataFrame:
    """The first provider's rows that aren't empty, else the last's."""
    for df in answers[:-1]:
        if df.limit(1).count():
            return df
    return answers[-1]


def venue_scores(path: str, default: float = 15) -> dict[str, float]:
    """Lower-case names and integer scores of a YAML mapping; the default alone on any error. A configuration file of the driver."""
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            return {str(k).lower().strip(): float(int(v)) for k, v in (yaml.safe_load(f).get("venues") or {}).items()}
    except Exception:
        return {"": default}


#: The ratings of feedback.
RATINGS = ("thumbs_up", "thumbs_down", "neutral")


def _sound(spark: SparkSession, path: str, whole: bool = True) -> DataFrame | None:
    """The file as one text, or None where there is none or it is no JSON."""
    if not files.exists(spark, path):
        return None
    raw = spark.read.text(path, wholetext=whole)
    return None if raw.where(F.try_parse_json("value").isNull()).limit(1).count() else raw


def registry(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Entries of a registry's JSON, one document (or one a line if not whole). A file that is no JSON gives none and is renamed to ``.json.backup``; no file gives none."""
    raw = _sound(spark, path, whole)
    if raw is None:
        files.rename(spark, path, path.removesuffix(".json") + ".json.backup") if files.exists(spark, path) else None
        raw = spark.createDataFrame([], "value string")
    shape = "struct<entries:map<string,struct<paper_id:string,title_normalized:string,identifiers:map<string,string>,topic_affiliations:array<string>,extraction_target_hash:string,processed_at:timestamp>>>"
    return raw.select(F.explode(F.map_values(F.from_json("value", shape)["entries"])).alias("e")).select("e.*")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(paper_id, content, metadata) of folders that hold content.md and metadata.json; both sides are read in parallel."""
    paper = lambda df: df.withColumn("paper_id", F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]+$", 1))
    text = paper(spark.read.text(f"{folder}/*/content.md", wholetext=True)).select("paper_id", F.col("value").alias("content"))
    meta = paper(spark.read.text(f"{folder}/*/metadata.json", wholetext=True)).select("paper_id", F.col("value").alias("metadata"))
    return text.join(meta, "paper_id", "left")


def feedback(spark: SparkSession, path: str, at: str = "unknown") -> DataFrame:
    """Entries of a JSON array. A file that is no JSON, or has an entry without id or with an unknown rating, gives none and is copied to ``.backup_<at>.json``."""
    raw = _sound(spark, path)
    if raw is not None:
        entries = raw.select(F.explode(F.from_json("value", FEEDBACK)).alias("e")).select("e.*")
        good = F.col("id").isNotNull() & F.col("paper_id").isNotNull() & F.coalesce(F.col("rating").isin(*RATINGS), F.lit(False))
        if not entries.where(~good).limit(1).count():
            return entries
    if files.exists(spark, path):
        files.copy(spark, path, f"{path.removesuffix('.json')}.backup_{at}.json")
    return spark.createDataFrame([], "value string").select(F.explode(F.from_json("value", FEEDBACK)).alias("e")).select("e.*")


def trajectories(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON object a file; invalid files are skipped."""
    raw = spark.read.schema(TRAJECTORY).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(folder)
    return raw.where("_bad is null and trajectory_id is not null").drop("_bad")


def reports(spark: SparkSession, folder: str, day: str | None = None) -> DataFrame:
    """(report_id, text) of markdown briefs, of one day if given."""
    pattern = f"{folder}/*{day}*.md" if day else f"{folder}/*.md"
    return spark.read.text(pattern, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("report_id"), F.col("value").alias("text"))


def best_extraction(attempts: DataFrame, least: float) -> DataFrame:
    """For each document the first backend that is good enough, else the best. attempts: doc, backend, place, quality."""
    enough = F.min(F.when(F.col("quality") >= least, F.struct("place", "backend", "quality")))
    best = F.max(F.struct("quality", (-F.col("place")).alias("p"), "backend"))
    return attempts.groupBy("doc").agg(enough.alias("e"), best.alias("b")).select("doc", F.coalesce("e.backend", "b.backend").alias("backend"), F.coalesce("e.quality", "b.quality").alias("quality"))

