"""Scoring formulas as column expressions. Every date formula takes its own ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the formulas.
LEGACY_WEIGHTS = {"citation": 0.40, "venue": 0.30, "recency": 0.20, "completeness": 0.10}
SIX_WEIGHTS = {"citation": 0.25, "venue": 0.20, "recency": 0.20, "engagement": 0.15, "completeness": 0.10, "author": 0.10}
RANKING_WEIGHTS = {"citation": 0.3, "recency": 0.3, "sources": 0.2, "pdf": 0.2}
FILTER_WEIGHTS = {"citation": 0.30, "recency": 0.20, "relevance": 0.50}


def _top(x: Column) -> Column:
    return F.least(F.lit(1.0), x)


def _bonus(influential: Column) -> Column:
    return F.when(influential > 0, F.least(F.lit(0.1), influential * 0.01)).otherwise(0.0)


def citation_log10(count: Column, influential: Column | None = None) -> Column:
    """log10(c + 1) / 3, with a bonus for influential citations; 0 without citations."""
    base = F.log10(count + 1) / 3.0
    return F.when(count > 0, _top(base + _bonus(influential) if influential is not None else base)).otherwise(0.0)


def citation_log10_plain(count: Column) -> Column:
    """log10(c) / 3, so a single citation scores 0."""
    return F.when(count > 0, _top(F.log10(count.cast("double")) / 3.0)).otherwise(0.0)


def citation_log1p(count: Column) -> Column:
    """log(c + 1) / 10 without a bonus."""
    return _top(F.log1p(F.coalesce(count, F.lit(0)).cast("double")) / 10.0)


def citation_log1p_bonus(count: Column, influential: Column) -> Column:
    """log(c + 1) / 10 and the bonus, which is 0.05 where the influential count is unknown."""
    c = F.coalesce(count, F.lit(0))
    return F.when(c > 0, _top(F.log1p(c.cast("double")) / 10.0 + F.when(influential.isNull(), 0.05).otherwise(_bonus(influential)))).otherwise(0.0)


def recency_steps(published: Column, as_of: Column) -> Column:
    """F-DATE1."""
    age = F.datediff(as_of, published)
    return F.when(age.isNull() | (age < 0), 0.5).when(age < 365, 1.0).when(age < 730, 0.75).when(age < 1825, 0.5).otherwise(0.25)


def recency_decay(year: Column, as_of_year: int) -> Column:
    """F-DATE2: 1 / (1 + 0.2 years), 0.1 at least; a year to come counts as this one."""
    age = F.greatest(F.lit(0), F.lit(as_of_year) - year)
    return F.when(year.isNull(), 0.5).otherwise(F.greatest(F.lit(0.1), 1.0 / (1 + 0.2 * age)))


def recency_ten_years(year: Column, as_of_year: int) -> Column:
    """F-DATE3: falls to 0 over ten years; unknown and future years are neutral."""
    age = F.lit(as_of_year) - year
    return F.when(age.isNull() | (age < 0), 0.5).otherwise(F.greatest(F.lit(0.0), 1.0 - age / 10.0))


def recency_five_years(published: Column, year: Column, as_of: Column) -> Column:
    """F-DATE4: 1 up to a year of age, 0 from five on; a bare year counts as its 15 June."""
    day = F.coalesce(published, F.make_date(year, F.lit(6), F.lit(15)))
    age = F.datediff(as_of, day)
    return F.when(age.isNull(), 0.5).when(age <= 365, 1.0).when(age >= 1825, 0.0).otherwise(1.0 - (age - 365) / 1460.0)


def engagement(upvotes: Column, unknown: float = 0.5) -> Column:
    """F-MATH9: log(u + 1) / 7; ``unknown`` without upvotes."""
    return F.when(F.coalesce(upvotes, F.lit(0)) <= 0, unknown).otherwise(_top(F.log1p(upvotes.cast("double")) / 7.0))


def flags(**weighted: tuple[float, Column]) -> Column:
    """F-MATH8: the weights of the conditions that hold."""
    out = F.lit(0.0)
    for weight, holds in weighted.values():
        out = out + F.when(F.coalesce(holds, F.lit(False)), weight).otherwise(0.0)
    return out


def completeness_legacy(abstract: Column, n_authors: Column, doi: Column) -> Column:
    return flags(abstract=(0.5, F.length(F.trim(abstract)) > 0), authors=(0.3, n_authors > 0), doi=(0.2, doi != ""))


def completeness_five(abstract: Column, n_authors: Column, venue: Column, pdf: Column, doi: Column, strict: bool = False) -> Column:
    """Five weighted fields; ``strict`` wants an abstract of more than 50 characters instead of 50 after trimming."""
    long = F.length(abstract) > 50 if strict else F.length(F.trim(abstract)) >= 50
    return flags(abstract=(0.3, long), authors=(0.2, n_authors > 0), venue=(0.2, venue != ""), pdf=(0.2, pdf), doi=(0.1, doi != ""))


def completeness_rank(doi: Column, abstract: Column, n_authors: Column, venue: Column, pdf: Column, citations: Column) -> Column:
    """Points of the row that a merged group starts from."""
    return flags(doi=(3.0, doi != ""), abstract=(2.0, abstract != ""), authors=(1.0, n_authors > 0), venue=(1.0, venue != ""), pdf=(2.0, pdf), citations=(1.0, citations > 0)).cast("int")


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + w * parts[name]
    return out


def tier(score: Column, top: float = 1.0) -> Column:
    """F-MATH7."""
    return F.when(score >= 0.8 * top, "excellent").when(score >= 0.6 * top, "good").when(score >= 0.4 * top, "fair").otherwise("low")


def final_score(quality: Column, relevance: Column) -> Column:
    """O5."""
    return F.coalesce(0.4 * quality + 0.6 * relevance, quality)


def cosine(a: Column, b: Column) -> Column:
    """F-VEC1: 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, t: s + t)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def citation_velocity(citations: Column, published: Column, year: Column, as_of_year: int) -> Column:
    """Citations for each year since publication, one at least; 0 without a date."""
    y = F.coalesce(F.year(published), year)
    return F.when(y.isNull(), 0.0).otherwise(citations / F.greatest(F.lit(1), F.lit(as_of_year) - y))


def llm_cost(tokens_in: Column, tokens_out: Column, model: Column, prices: dict[str, tuple[float, float]], default: tuple[float, float]) -> Column:
    """F-MATH10: dollars, from prices for a million tokens."""
    price_in, price_out = F.lit(default[0]), F.lit(default[1])
    for name, (i, o) in prices.items():
        price_in, price_out = F.when(model == name, i).otherwise(price_in), F.when(model == name, o).otherwise(price_out)
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def venue_first(venue: Column, known: dict[str, float], default: float) -> Column:
    """Trap 12, first way: the first known name that the venue contains."""
    v = F.lower(F.trim(F.coalesce(venue, F.lit(""))))
    out = F.lit(default)
    for name, points in reversed(known.items()):
        out = F.when(v.contains(name), points).otherwise(out)
    return F.when(v == "", default).otherwise(out)


def venue_either(key: Column, known: dict[str, float], default: float) -> Column:
    """Second way: equal, else the first name that contains the venue's key or is contained in it."""
    out = F.lit(default)
    for name, points in reversed(known.items()):
        out = F.when(key.contains(name) | F.lit(name).contains(key), points).otherwise(out)
    for name, points in known.items():
        out = F.when(key == name, points).otherwise(out)
    return out


def venue_longest(key: Column, known: dict[str, float], default: float) -> Column:
    """Third way (F-STR13): equal, else the longest known name that the key contains."""
    out = F.lit(default)
    for name, points in sorted(known.items(), key=lambda x: len(x[0])):
        out = F.when(key.contains(name), points).otherwise(out)
    return F.when(key == "", default).otherwise(out)
