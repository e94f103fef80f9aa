"""What a Python worker holds: bounded batches, bounded scoring and the models of one operator alone."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from granula.llm import bpe, common, langid
from granula.llm.queries import tokenizer_path


class _Model:
    value = np.random.default_rng(1).normal(-8, 2, (langid.BUCKETS, 4)).astype(np.float32)


def _score(texts):
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    return pa.Table.from_batches(langid._score(["a", "b", "c", "d"], _Model)([batch]))


TEXTS = {"many": [f"some words of text {i} and then some more " * 20 for i in range(2500)], "long": ["one text that is very long, ärger " * 40_000], "hard": ["", None, "12 ?!"]}


@pytest.mark.parametrize("texts", TEXTS)
def test_scoring_is_bounded(texts):
    langid._fold()
    tracemalloc.start()
    _score(TEXTS[texts])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 48e6, most


@pytest.mark.parametrize("texts", TEXTS)
def test_scores_do_not_depend_on_parts(texts, monkeypatch):
    found = _score(TEXTS[texts])
    monkeypatch.setattr(langid, "_PART", 1 << 20)
    monkeypatch.setattr(langid, "_TOGETHER", 1 << 21)
    assert found.equals(_score(TEXTS[texts]))


def test_models_of_one_operator():
    batch = pa.record_batch([pa.array([1]), pa.array(["a text"])], ["doc_id", "text"])
    others = {"langid": lambda: langid._score([*"abcd"], _Model)([batch]), "count": lambda: langid._count([pa.record_batch([pa.array(["a"]), pa.array(["x"])], ["text", "lang"])]), "chunks": lambda: common.chunks([batch])}
    for other in others.values():
        first = list(bpe._encode(tokenizer_path())([batch]))
        kept = bpe.load(tokenizer_path())
        assert list(bpe._encode(tokenizer_path())([batch])) == first
        assert bpe.load(tokenizer_path()) is kept  # from task to task
        list(other())
        assert bpe.load.cache_info().currsize == 0


def test_batches_are_bounded(spark):
    docs = spark.createDataFrame([(i, "word " * 4_000, "en", "s") for i in range(1500)], "doc_id long, text string, lang string, source string").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.unset(key)
            with common.scratch(spark):
                stage(spark, docs.limit(20), None)
            got = docs.mapInArrow(sizes, "rows long, bytes long").collect()
            assert sum(r.rows for r in got) == 1500
            assert max(r.bytes for r in got) < 2 * corpus_pipeline.BATCH_BYTES, name
        spark.conf.set(key, "1m")
        corpus_pipeline.STAGES[-1][1](spark, docs, None)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)
