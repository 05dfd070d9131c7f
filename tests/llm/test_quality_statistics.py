"""The classifier's statistics against plain Python, and its odd labels."""

from __future__ import annotations

import math
import re
from unicodedata import category

import numpy as np
from pyspark.sql import functions as F

from inkwell.llm import quality_model
from tests.llm import brute


def statistics(text):
    text = text or ""
    words = brute.WORD.findall(text)
    n, chars = len(words), sum(map(len, words))
    per_word, per_char = (lambda k: k / n if n else 0.0), (lambda k: k / chars if chars else 0.0)
    again, i = 0, 0
    # Words side by side with one space between, each word used once.
    runs = list(brute.WORD.finditer(text))
    while i + 1 < len(runs):
        a, b = runs[i], runs[i + 1]
        if a[0] == b[0] and text[a.end() : b.start()] == " ":
            again, i = again + 1, i + 2
        else:
            i += 1
    return {
        "log_words": math.log1p(n), "word_length": per_word(chars), "upper": per_char(sum(category(c) == "Lu" for c in text)),
        "digits": per_char(len(re.findall("[0-9]", text))), "symbols": per_word(len(re.findall(r"[#*$%&|<>]", text))), "bangs": per_word(text.count("!")), "stops": per_word(len(re.findall("[.,;:?]", text))),
        "tags": per_char(len(re.findall(r"[@{}\[\]()/\\_=+]", text))), "line_words": n / (text.count("\n") + 1), "short": per_word(sum(len(w) <= 3 for w in words)), "again": per_word(again),
        "distinct": per_word(len(set(words))), "lone": math.log1p(len(max(words, key=lambda w: w.encode()))) if words else 0.0,
    }


def test_statistics(spark):
    texts = brute.TEXTS + ["a a a a b  b b\nb b. b b", "Über ÄÖ É ß x", "!!! wow! #tag {x} [y] a/b\\c_d=e+f", "ab ab\tab ab ab", " end end ", "x"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in quality_model.statistics(brute.documents(spark, rows)).collect()}
    for i, t in enumerate(texts):
        want = statistics(t)
        for name in quality_model.STATISTICS:
            assert math.isclose(got[i][name], want[name], rel_tol=1e-9, abs_tol=1e-12), (name, t and t[:60], got[i][name], want[name])


def test_odd_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_model.fit(docs, labels)
    # Repeated and null labels, null ids and repeated documents change nothing.
    odd = labels.unionByName(labels).unionByName(labels.limit(5).withColumn("quality", F.lit(None).cast(labels.schema["quality"].dataType)))
    odd = odd.unionByName(labels.limit(5).withColumn("doc_id", F.lit(None).cast(labels.schema["doc_id"].dataType)))
    assert quality_model.fit(docs.unionByName(docs), odd) == model
    # An id of two labels is learnt from twice, in the same way whatever the order of the rows.
    both = labels.unionByName(labels.where("doc_id % 7 = 0").withColumn("quality", 1 - F.col("quality")))
    a, b = (quality_model.fit(d, x) for d, x in ((docs, both), (docs.repartition(5), both.orderBy(F.rand(3)))))
    assert a == b and a != model


def test_a_bounded_sample_is_the_same_in_every_run(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    a, b = quality_model.fit(docs, labels, most_rows=150), quality_model.fit(docs.repartition(7), labels.repartition(3), most_rows=150)
    assert a == b and np.isfinite(a.bias)
