"""What stays in an executor's memory beside the stage at hand: Python processes that no step needs, and tables of idle workers."""

import pyarrow as pa

from corpus_pipeline import tokenizer_path
from inkwell.llm import bpe, mixing


def test_targets_start_no_python_workers(spark):
    sized = spark.createDataFrame([("b", 4), (None, 7), ("a", 5), ("a", 1)], "source string, size long")
    for most_on_driver in (50_000, 0):
        table, small = mixing.targets(sized, driver_sources=most_on_driver)
        assert small is (most_on_driver > 0)
        assert "PythonRDD" not in table._jdf.queryExecution().toRdd().toDebugString()
        assert sorted((tuple(r) for r in table.collect()), key=str) == [("a", 6, 17 / 6), ("b", 4, 17 / 3), (None, 7, 8.5)]
        assert [t for _, t in table.dtypes] == ["string", "bigint", "double"]


def test_targets_of_no_rows(spark):
    table, small = mixing.targets(spark.createDataFrame([], "source string, size long"))
    assert small and table.collect() == [] and table.columns == ["source", "source_size", "target"]


def test_idle_worker_keeps_no_words():
    with open(tokenizer_path(), encoding="utf-8") as f:
        text = f.read()

    class Shared:
        value = (-1, text)

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["some words, some more", None, "naïve <|endoftext|> words"]})
    first = [x.tolist() for _, ids in bpe._rows(iter([batch]), Shared) for x in ids]
    c = bpe.codec(Shared)
    assert not c.chunks and not c.words and not c.pairs.known and not c.chunks.held.nbytes
    assert [x.tolist() for _, ids in bpe._rows(iter([batch]), Shared) for x in ids] == first and any(first)
