"""Row mappers of the providers (S2-S7, S18, N8-N12, N22, N28, F-ARR1) and query parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_inverted_index(index: Column) -> Column:
    """F-ARR1: the text of a map from words to positions."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")


def inverted_index(rows: DataFrame, key: str, text: str) -> DataFrame:
    """F-ARR1 backwards: key and index, the map from the words between spaces to their positions; rows without text have none."""
    places = rows.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, " ", -1)).alias("place", "word"))
    by_word = places.groupBy(key, "word").agg(F.array_sort(F.collect_list("place")).alias("places"))
    return by_word.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("index"))


class _Parser:
    """Recursive descent over AND, OR, NOT, quotes and parentheses; words side by side are joined by AND."""

    def __init__(self, query: str, columns: list[Column]):
        self.tokens = re.findall(r'"[^"]*"|[()]|[^\s()"]+', query)
        self.at, self.columns = 0, columns

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def either(self) -> Column:
        left = self.both()
        while self.peek() == "OR":
            self.take()
            left = left | self.both()
        return left

    def both(self) -> Column:
        left = self.one()
        while self.peek() not in (None, ")", "OR"):
            if self.peek() == "AND":
                self.take()
            left = left & self.one()
        return left

    def one(self) -> Column:
        token = self.take() if self.peek() is not None else ""
        if token == "NOT":
            return ~self.one()
        if token == "(":
            inner = self.either()
            if self.peek() == ")":
                self.take()
            return inner
        term = token.strip('"').lower()
        test = F.lit(False)
        for c in self.columns:
            test = test | F.lower(F.coalesce(c, F.lit(""))).contains(term)
        return test


def boolean_query(query: str, *columns: Column) -> Column:
    """S3: a boolean query as one predicate: a term holds where any column contains it."""
    return _Parser(query, list(columns)).either()


def query_terms(query: str) -> list[str]:
    """Quoted phrases first, then the other words, each of more than two letters; operators go, whatever their case."""
    # The split leaves what is quoted at the odd places.
    pieces = re.split(r'"([^"]+)"', query.lower())
    words = re.split(r"[\s,()]+", re.sub(r"\b(?:and|or|not)\b", " ", " ".join(pieces[::2])))
    return [t for t in (x.strip() for x in [*pieces[1::2], *words]) if len(t) > 2]


def all_terms(terms: list[str], text: Column) -> Column:
    """Every term is in the text, whatever the case."""
    test = F.lit(True)
    for t in terms:
        test = test & F.lower(text).contains(t)
    return test


#: What a work of the open index looks like; only these fields are parsed.
WORK = "struct<id:string,title:string,publication_year:int,publication_date:string,cited_by_count:int,is_retracted:boolean,doi:string,abstract_inverted_index:map<string,array<int>>,authorships:array<struct<author:struct<display_name:string,id:string>>>,primary_location:struct<source:struct<display_name:string>>,open_access:struct<is_oa:boolean,oa_url:string>>"


def map_works(raw: DataFrame, column: str = "value") -> DataFrame:
    """Works as JSON to paper rows; a work without id or title gives none."""
    w = raw.select(F.from_json(column, WORK).alias("w")).select("w.*")
    return w.where("id is not null and title is not null").select(
        F.substring_index("id", "/", -1).alias("paper_id"), "title", from_inverted_index(F.col("abstract_inverted_index")).alias("abstract"), F.col("publication_year").alias("year"),
        F.to_date("publication_date").alias("publication_date"), F.coalesce("cited_by_count", F.lit(0)).alias("citation_count"), F.regexp_replace("doi", "^https://doi.org/", "").alias("doi"),
        F.transform("authorships", lambda a: a["author"]["display_name"]).alias("authors"), F.col("primary_location.source.display_name").alias("venue"), F.coalesce("open_access.is_oa", F.lit(False)).alias("pdf_available"),
        F.coalesce("is_retracted", F.lit(False)).alias("is_retracted"),
    )


def works_filter(min_citations: int | None = None, start: str | None = None, end: str | None = None, open_only: bool = False) -> Column:
    """Strictly more citations than given, not retracted, with an abstract."""
    test = ~F.col("is_retracted") & F.coalesce(F.col("abstract") != "", F.lit(False))
    if min_citations is not None:
        test &= F.col("citation_count") > min_citations
    if start is not None:
        test &= F.col("publication_date") >= F.lit(start).cast("date")
    if end is not None:
        test &= F.col("publication_date") <= F.lit(end).cast("date")
    return test & F.col("pdf_available") if open_only else test


def map_atom(entries: DataFrame) -> DataFrame:
    """Feed entries (id, title, summary, published, links array<struct<href, title>>) to paper rows."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s*\n\s*", " "))
    pdf = F.get(F.filter("links", lambda x: x["title"] == "pdf"), F.lit(0))["href"]
    return entries.select(F.substring_index("id", "/abs/", -1).alias("paper_id"), flat("title").alias("title"), flat("summary").alias("abstract"), F.to_date(F.substring("published", 1, 10)).alias("publication_date"), F.substring("published", 1, 4).cast("int").alias("year"), pdf.alias("pdf_url"), pdf.isNotNull().alias("pdf_available"))


DAILY = "struct<paper:struct<id:string,title:string,summary:string,publishedAt:string,upvotes:int,authors:array<struct<name:string>>>>"


def map_daily(raw: DataFrame, column: str = "value") -> DataFrame:
    """Daily papers as JSON; rows without id or title are skipped, and upvotes stand in for citations."""
    p = raw.select(F.from_json(column, DAILY).alias("d")).select("d.paper.*")
    return p.where("id != '' and title != ''").select(
        F.col("id").alias("paper_id"), "title", F.col("summary").alias("abstract"), F.to_date(F.expr("try_to_timestamp(replace(publishedAt, 'Z', '+00:00'))")).alias("publication_date"), F.coalesce("upvotes", F.lit(0)).alias("citation_count"), F.transform("authors", lambda a: a["name"]).alias("authors")
    )


def map_citations(raw: DataFrame) -> DataFrame:
    """Rows without id or title go; a missing url is made from the id."""
    return raw.where("coalesce(paper_id, '') != '' and coalesce(title, '') != ''").withColumn("url", F.coalesce("url", F.concat(F.lit("https://www.semanticscholar.org/paper/"), "paper_id"))).withColumn("pdf_available", F.col("pdf_url").isNotNull())


def map_audit(papers: DataFrame, run_id: str, source: str) -> DataFrame:
    """Audit rows of a run."""
    return papers.select(F.lit(run_id).alias("run_id"), "paper_id", F.substring("title", 1, 200).alias("title"), F.coalesce("is_new", F.lit(False)).alias("is_new"), F.lit(source).alias("source"))


def poll_hours(hours: Column, most: int = 720) -> Column:
    """N12."""
    return F.least(hours, F.lit(most))


FOCUS = {"methodology": "methodology", "application": "application", "comparison": "comparison", "related": "related"}


def decomposition(raw: DataFrame, key: str, column: str) -> DataFrame:
    """(key, query, focus) of a JSON array of objects; blank queries go, an unknown focus is ``related``."""
    items = F.from_json(F.regexp_extract(column, r"(?s)\[.*\]", 0), "array<struct<query:string,focus:string>>")
    focus = F.when(F.lower("x.focus").isin(*FOCUS), F.lower("x.focus")).otherwise("related")
    return raw.select(key, F.explode(items).alias("x")).where("trim(x.query) != ''").select(key, F.trim("x.query").alias("query"), focus.alias("focus"))


def key_learnings(reports: DataFrame, top: int = 3) -> DataFrame:
    """(report_id, place, title, summary) of the first entries of each markdown report."""
    from inkwell.functions.text import clean_title, short_summary

    parts = F.split(F.concat(F.lit("\n"), "text"), r"\n###? +", -1)
    each = reports.select("report_id", F.posexplode(parts).alias("place", "part")).where("place > 0")
    title = clean_title(F.substring_index("part", "\n", 1))
    body = F.regexp_replace("part", r"^[^\n]*\n?", "")
    out = each.select("report_id", "place", title.alias("title"), short_summary(body, 200).alias("summary")).where("title != ''")
    return out.where(F.col("place") <= top)


def paper_summary(entries: DataFrame, column: str = "metadata_snapshot") -> DataFrame:
    """Title and quality of a JSON snapshot; a quality that is no number is 0."""
    return entries.select("paper_id", F.get_json_object(column, "$.title").alias("title"), F.coalesce(F.expr(f"try_cast(get_json_object({column}, '$.quality') as double)"), F.lit(0.0)).alias("quality"))


def table_markdown(rows: Column) -> Column:
    """Header, separator and rows; nulls are empty."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(rows[0], lambda c: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(rows[0]), rule), F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")
