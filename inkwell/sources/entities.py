"""The engine's entities, derived from the benchmark tables.

Each entity is one SQL text that Spark and DuckDB both read, so a query and its
oracle start from the same rows. ``AS_OF`` stands for now; nothing reads a clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-30"
AS_OF_YEAR = 2024

_PUBLISHED = "case when doc_id % 13 = 0 then null else 2024 - doc_id % 12 end"

#: entity -> (base tables, SQL)
ENTITIES: dict[str, tuple[tuple[str, ...], str]] = {
    "papers": (
        ("documents",),
        f"""select doc_id as pos, 'p' || cast(doc_id as varchar(20)) as paper_id, split_part(text, chr(10), 1) as title,
          case when doc_id % 17 = 0 then null else text end as abstract, case when doc_id % 11 = 0 then null else source end as venue,
          cast({_PUBLISHED} as int) as year,
          case when doc_id % 13 = 0 or doc_id % 4 = 0 then null else make_date(cast(2024 - doc_id % 12 as int), cast(1 + doc_id % 12 as int), cast(1 + doc_id % 28 as int)) end as publication_date,
          cast(case when doc_id % 10 = 0 then 0 else n_chars % 1000 end as int) as citation_count, cast(case when doc_id % 3 = 0 then null else doc_id % 15 end as int) as influential,
          case when doc_id % 5 = 0 then null when doc_id % 2 = 0 then '10.1/' || substr(md5(text), 1, 10) else '10.1/' || upper(substr(md5(text), 1, 10)) end as doi,
          case when doc_id % 7 = 0 then '24' || cast(doc_id % 100 as varchar(9)) || '.' || substr(md5(text), 1, 5) else null end as arxiv_id,
          cast(doc_id % 4 as int) as n_authors, doc_id % 2 = 0 as pdf_available, cast(doc_id % 50 as int) as upvotes,
          case doc_id % 4 when 0 then 'arxiv' when 1 then 'semantic_scholar' when 2 then 'openalex' else 'huggingface' end as discovery_source, 't' || cast(doc_id % 7 as varchar(9)) as topic,
          cast(doc_id % 101 as int) / 100.0e0 as relevance, cast(n_chars as int) as n_chars from documents""",
    ),
    "cites": (
        ("documents",),
        """select 'c' || cast(doc_id as varchar(20)) as edge_id, doc_id as source_id, cast(floor(doc_id / 2.0e0) as bigint) as target_id, 'cites' as edge_type from documents where doc_id >= 1
          union all select 'd' || cast(doc_id as varchar(20)), doc_id, cast(floor(doc_id / 3.0e0) as bigint), case when doc_id % 5 = 0 then 'mentions' else 'cites' end from documents where doc_id >= 1""",
    ),
    "nodes": (
        ("documents",),
        """select doc_id as node_id, case when doc_id % 9 = 8 then 'author' else 'paper' end as node_type, cast(n_chars % 1000 as int) as citation_count, cast(2024 - doc_id % 12 as int) as year,
          '{"citation_count": ' || cast(n_chars % 1000 as varchar(9)) || ', "lang": "' || lang || '"}' as properties, doc_id % 97 as created_at from documents""",
    ),
    "points": (
        ("events",),
        "select event_type as series_id, 'value' as metric_name, cast(ts as date) as period, avg(value) as value from events group by event_type, cast(ts as date)",
    ),
    "feedback": (
        ("events",),
        """select paper_id, topic, rating, event_id, ts, k from (
          select event_id % 500 as paper_id, case when user_id % 7 = 0 then null else 't' || cast(user_id % 7 as varchar(9)) end as topic,
            case event_type when 'purchase' then 'thumbs_up' when 'error' then 'thumbs_down' else 'neutral' end as rating, event_id, ts, event_id % 8 as k,
            row_number() over (partition by event_id % 500 order by ts desc, event_id desc) as place from events) x where place = 1""",
    ),
    "turns": (
        ("conversations",),
        "select conv_id, cast(turn as int) as turn, role as action, length(text) as tokens, text from conversations",
    ),
    "costs": (
        ("events",),
        "select event_id, event_type as provider, cast(ts as date) as day, cast(floor(coalesce(value, 0) * 1000) as bigint) as tokens from events",
    ),
    "refs": (("lineitem",), "select distinct l_orderkey as source_id, l_partkey as target_id from lineitem"),
}


def sql_of(name: str) -> str:
    """The entity's SQL, for Spark and DuckDB alike."""
    return ENTITIES[name][1]


def ctes(*names: str) -> str:
    """``with`` clause that defines the entities in an oracle."""
    return "with " + ", ".join(f"{n} as ({sql_of(n)})" for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bases, text = ENTITIES[name]
    # The views are bound by argument, so concurrent queries over other folders don't meet.
    return spark.sql(_bound(text, bases[0]), base=table(spark, sf_dir, bases[0]))


def _bound(text: str, base: str) -> str:
    """The SQL with its base table as a parameter of ``spark.sql``; other braces are doubled."""
    return text.replace("{", "{{").replace("}", "}}").replace(f"from {base}", "from {base}")
