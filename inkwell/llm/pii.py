"""Personal data: patterns propose, checksums confirm, context words adjust the score.

Base kinds are email, ip, card and phone; their spans stay whatever their
score. IBANs that pass mod-97 are added where their score reaches a threshold.
Every search is linear in the length of the text.

Defined results: a null or empty text has no spans. Repeated rows give repeated,
equal results. Extra columns are left out by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")
#: Score of a proposal, of one that a checksum confirms, what a context word adds, and the least score of an added kind.
PROPOSED, CONFIRMED, CONTEXT, LEAST = 0.5, 0.8, 0.15, 0.6
#: Code points on either side in which context words count.
NEAR = 40
ROWS = 512

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts at the first digit of a run: where that fails, later starts in the run fail too.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NOT_DIGIT = re.compile("[^0-9]+")
#: Words that make a kind likelier, in the languages of the corpus.
_NEAR_WORDS = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|telefon|anruf|llame|appel",
    "iban": "iban|bank|account|konto|compte|cuenta",
}
_NEAR_RE = {k: re.compile(rf"(?i)\b(?:{v})") for k, v in _NEAR_WORDS.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the first four characters go last, letters count from 10, and the remainder is 1."""
    rest = 0
    for c in iban[4:] + iban[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the pattern: the run of local characters before an @, and the domain behind it."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            low = m.end()
            yield start, low
        at = text.find("@", at + 1)


def propose(text: str) -> Iterator[tuple[str, int, int, float]]:
    """(kind, start, end, score) of every span, the kinds in order, before the context is looked at."""
    if "@" in text:
        yield from (("email", a, b, PROPOSED) for a, b in emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end(), PROPOSED
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end(), CONFIRMED
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end(), PROPOSED
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield "iban", m.start(), m.end(), CONFIRMED


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind as listed, then start."""
    out = []
    for kind, start, end, score in propose(text):
        near = f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}"
        score = min(1.0, score + CONTEXT * bool(_NEAR_RE[kind].search(near)))
        if kind in BASE or score >= LEAST:
            out.append((kind, start, end, round(score, 2)))
    return out


def mask(text: str, found: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the union by that of the first."""
    out, at = [], 0
    for kind, start, end, _ in sorted(found, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _texts(batches, column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            part = whole.slice(at, ROWS)
            yield part, part.column(column).to_pylist()


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end, score>> of every whole text."""

    def run(batches):
        for part, texts in _texts(batches, 1):
            got = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans(t or "")] for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, _SPANS)], ["doc_id", "spans"])

    return df.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:int,end:int,score:double>>")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the spans of its text replaced by their kinds; a null text stays null."""
    at = df.columns.index(text_col)

    def run(batches):
        for part, texts in _texts(batches, at):
            new = [t if t is None or not (s := spans(t)) else mask(t, s) for t in texts]
            columns = [pa.array(new, pa.string()) if i == at else part.column(i) for i in range(part.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return df.mapInArrow(run, df.schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query, from those of ``find``."""
    from pyspark.sql import functions as F

    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.coalesce(F.round(F.aggregate("spans", F.lit(0.0), lambda a, s: a + s["score"]), 2), F.lit(0.0)).alias("score_sum"),
    )
