"""String functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that the keyword index leaves out.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "were", "will", "with")
#: Words that venue names are compared without.
VENUE_WORDS = ("proceedings", "conference", "journal", "international", "workshop", "symposium", "transactions", "annual", "of", "the", "on", "for", "and", "in")
#: Section kinds in order, and the headers that name them.
SECTIONS = (
    ("abstract", "abstract|summary"),
    ("introduction", "introduction|background|overview"),
    ("methods", "methods?|methodology|approach|experimental setup"),
    ("results", "results?|findings|experiments?"),
    ("discussion", "discussion|analysis"),
    ("conclusion", "conclusions?|summary|future work"),
    ("references", "references?|bibliography|citations?"),
)
#: Patterns of title keys, by ASCII and by any script, and the signs that the loose key drops.
NOT_ASCII_KEY, NOT_UNICODE_KEY, SPACES, LOOSE_SIGNS = r"[^a-z0-9\s]", r"[^\p{L}\p{N}_\s]", r"\s+", ".,;:!?()-\"'"
#: Replacements that make a slug, in order, its length and the name of an empty one.
SLUG = ((r"\s+and\s+", "-"), (r"\s+or\s+", "-"), (r"\s+", "-"), (r"[^a-z0-9-]", ""), (r"-+", "-"), (r"^-+|-+$", ""))
SLUG_LENGTH, NO_SLUG = 64, "unknown-topic"
#: Control characters that untrusted text loses.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
#: Markdown links, leading numbers and named emojis of a report's title; markdown marks and closing signs of its summary.
LINK, LEADING_NUMBER, NAMED_EMOJI = r"\[([^\]]+)\]\([^)]+\)", r"^[0-9]+\.\s*", r":[a-z_]+:"
MARKS, CLOSING = (r"\*\*([^*]+)\*\*", r"\*([^*]+)\*", r"`([^`]+)`"), r"[.,;:]+$"
#: Headers, list items, code blocks and table rules of markdown.
HEADERS, LIST_ITEMS, CODE_BLOCKS, TABLE_RULES = r"(?m)^#{1,6}\s+", r"(?m)^\s*[\-\*\+]\s+", r"```[\w]*\n", r"\|[\s\-:\|]+\|"
#: Lines that look like code.
INDENTED, CODE_SIGNS = r"^(?:    |\t)", r"[{};]|def |class |import "


def title_key(title: Column) -> Column:
    """F-STR1: lower case, ASCII letters and digits and single spaces only."""
    kept = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), NOT_ASCII_KEY, "")
    return F.trim(F.regexp_replace(kept, SPACES, " "))


def title_key_unicode(title: Column) -> Column:
    """F-STR2: as F-STR1, but letters and digits of any script and underscores stay."""
    kept = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), NOT_UNICODE_KEY, "")
    return F.trim(F.regexp_replace(kept, SPACES, " "))


def title_key_loose(title: Column) -> Column:
    """F-STR3: spaces are squeezed before punctuation goes, so a double space can remain."""
    squeezed = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), SPACES, " "))
    return F.translate(squeezed, LOOSE_SIGNS, "")


def trigrams(key: Column) -> Column:
    """Distinct three-character substrings; a shorter string is its own only item."""
    # The array of characters is bound to a variable, so that each substring is put together without a walk from the start.
    many = F.transform(F.array(F.split(key, "")), lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(c) - 2), lambda i: F.concat(F.element_at(c, i), F.element_at(c, i + 1), F.element_at(c, i + 2)))))
    return F.when(F.length(key) < 3, F.array(key)).otherwise(many[0])


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 where both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(0.0)


def title_similarity(a: Column, b: Column) -> Column:
    """F-STR4: 0 if either is empty, 1 if equal, else the trigrams' Jaccard similarity."""
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(jaccard(trigrams(a), trigrams(b)))


def slug(query: Column, most: int = SLUG_LENGTH) -> Column:
    """F-STR6: a name for folders, of lower-case letters, digits and hyphens."""
    s = F.lower(F.coalesce(query, F.lit("")))
    for pattern, new in SLUG:
        s = F.regexp_replace(s, pattern, new)
    s = F.regexp_replace(F.substring(s, 1, most), r"-+$", "")
    return F.when(s == "", NO_SLUG).otherwise(s)


def words(text: Column) -> Column:
    """Words between white space, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def word_overlap(query: Column, text: Column) -> Column:
    """F-STR7: Jaccard similarity of the distinct words."""
    q, t = F.array_distinct(words(query)), F.array_distinct(words(text))
    return F.when((F.size(q) == 0) | (F.size(t) == 0), 0.0).otherwise(jaccard(q, t))


def index_tokens(text: Column) -> Column:
    """F-STR8: tokens of the keyword index, in order and with repeats."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda w: (w != "") & ~w.isin(*STOPWORDS))


def token_estimate(text: Column) -> Column:
    """F-STR9: a quarter of the characters or the number of words, whichever is more."""
    t = F.coalesce(text, F.lit(""))
    return F.greatest(F.floor(F.length(t) / 4), F.size(words(t)).cast("long"))


def edge_key(a: Column, b: Column) -> Column:
    """F-STR10: first 32 hexadecimal digits of the pair's digest."""
    return F.substring(F.sha2(F.concat_ws("|", a, b), 256), 1, 32)


def venue_key(venue: Column) -> Column:
    """F-STR12: lower case without digits, signs and the usual words."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(venue, F.lit(""))), r"[0-9]+", ""), r"[^\p{L}\p{N}_\s\-']", " ")
    return F.array_join(F.filter(F.split(s, r"\s+"), lambda w: (w != "") & ~w.isin(*VENUE_WORDS)), " ")


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    from unicodedata import normalize

    return text.map(lambda t: normalize("NFC", t))


def composed(text: Column) -> Column:
    """The text in Unicode's composed form. Text below U+0300 is composed as it is; only other text goes to Python."""
    plain = ~text.rlike(r"[^\x{0}-\x{2FF}]")
    return F.when(plain, text).otherwise(_nfc(text))


def clean_untrusted(text: Column, most: int, suffix: str = "...") -> Column:
    """F-STR14: composed (NFC), control characters go, long text is cut."""
    s = F.regexp_replace(composed(F.coalesce(text, F.lit(""))), CONTROL, "")
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - len(suffix)), F.lit(suffix))).otherwise(s)


def clean_title(title: Column) -> Column:
    """F-STR15: a report's title without links, leading numbers and named emojis."""
    s = F.regexp_replace(F.coalesce(title, F.lit("")), LINK, "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(s, LEADING_NUMBER, ""), NAMED_EMOJI, ""))


def short_summary(text: Column, most: int) -> Column:
    """F-STR15: without markdown marks; a long one is cut at the last space past its half, closing signs go, dots follow."""
    s = F.coalesce(text, F.lit(""))
    for pattern in MARKS:
        s = F.regexp_replace(s, pattern, "$1")
    s = F.trim(F.regexp_replace(s, SPACES, " "))
    head = F.substring(s, 1, most)
    # Place of the last space from 0, or -1.
    space = F.when(F.instr(head, " ") > 0, F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1).otherwise(-1)
    cut = F.when(space > most // 2, F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.regexp_replace(cut, CLOSING, ""), F.lit("...")))


def section_kind(header: Column) -> Column:
    """F-STR16: the first kind whose headers match, else ``other``."""
    out = F.lit("other")
    for kind, names in reversed(SECTIONS):
        out = F.when(F.lower(F.trim(header)).rlike(f"^(?:{names})$"), kind).otherwise(out)
    return out


def author_names(authors: Column) -> Column:
    """F-STR17: the names of an array of author structs; an author without a name is written out as JSON."""
    return F.coalesce(F.transform(authors, lambda a: F.coalesce(a["name"], F.to_json(a))), F.array().cast("array<string>"))


def author_names_of_json(authors: Column) -> Column:
    """F-STR17: the names in a JSON value: an array of objects or strings, or one string; anything else, or nothing, has none."""
    items = F.from_json(authors, "array<string>")
    name = lambda a: F.coalesce(F.get_json_object(a, "$.name"), a)
    none = F.array().cast("array<string>")
    one = F.get(F.from_json(F.concat(F.lit("["), authors, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(authors.rlike(r"^\s*\["), F.coalesce(F.transform(items, name), none)).when(authors.rlike(r'^\s*"') & (F.length(one) > 0), F.array(one)).otherwise(none)


def extraction_quality(text: Column, pages: Column) -> Column:
    """F-TXT1: density, structure, code and tables of an extracted text; 0 below 100 characters."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    per_page = n / pages
    density = F.when(pages <= 0, 0.5).when(per_page.between(500, 2000), 1.0).when(per_page < 100, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(per_page - 1250) / 2500))
    marks = (F.regexp_count(t, F.lit(HEADERS)) + F.regexp_count(t, F.lit(LIST_ITEMS))) / F.greatest(F.lit(1.0), n / 1000)
    structure = F.when(marks.between(5, 15), 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(marks - 10) / 20))
    code, tables = F.regexp_count(t, F.lit(CODE_BLOCKS)), F.regexp_count(t, F.lit(TABLE_RULES))
    found = lambda k, per: F.when(k == 0, 0.5).otherwise(F.least(F.lit(1.0), 0.5 + k / per))
    return F.when(n < 100, 0.0).otherwise(0.40 * density + 0.30 * structure + 0.15 * found(code, 5) + 0.15 * found(tables, 3))


def code_like(text: Column) -> Column:
    """F-TXT2: lines count once for an indent and once for a sign of code; more than half of several lines must."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\n$", ""), "\n", -1)
    hits = F.aggregate(lines, F.lit(0), lambda n, x: n + x.rlike(INDENTED).cast("int") + x.rlike(CODE_SIGNS).cast("int"))
    return (hits > F.size(lines) * 0.5) & (F.size(lines) > 1)
