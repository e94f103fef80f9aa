"""Long texts and repeated ids: language ID's parts, line dedup's intervals, top-k query rows, quotes."""

import random
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from granula.llm import langid, lines, topk, toxicity


@pytest.mark.parametrize("part", [1, 2, 3, 7])
def test_parts_of_a_text_have_the_grams_of_the_whole(monkeypatch, part):
    r = random.Random(part)
    for _ in range(60):
        text = "".join(r.choice("ab é,\n  ") for _ in range(r.randrange(0, 40)))
        whole = np.sort(np.concatenate([*langid._parts(text), np.zeros(0, np.int32)]))
        with monkeypatch.context() as m:
            m.setattr(langid, "_PART", part)
            cut = np.sort(np.concatenate([*langid._parts(text), np.zeros(0, np.int32)]))
        assert (whole == cut).all() and len(whole) == len(cut), text


def test_grams_across_the_production_cut():
    text = "ab" * (1 << 19) + "xyz q"
    got = np.concatenate(list(langid._parts(text)))
    # 1-grams: all letters; 2-grams: neighbours and word edges; 3-grams: one for each letter.
    letters = len(text) - 1
    assert len(got) == letters + (letters + 2) + letters


def test_a_long_copy_loses_its_lines(spark):
    long = [f"line {i % 997} {i}" for i in range(20_000)]
    rows = [(1, "\n".join(long)), (2, "\n".join(long)), (3, "\n".join(["own"] + long[50:90] + ["own too"] + long[:3]))]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in lines.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][:2] == (20_000, 0) and got[1][2] == rows[0][1]
    assert got[2] == (20_000, 20_000, "")
    assert got[3] == (45, 40, "\n".join(["own", "own too"] + long[:3]))


def test_query_rows_of_one_id_equal_the_sql(spark, monkeypatch):
    r = random.Random(8)
    v = lambda: [round(r.uniform(-1, 1), 2) for _ in range(4)]
    rows = [(i, v()) for i in range(1, 130)] + [(50, v()) for _ in range(9)] + [(50, [0.5, 0.25, 0.0, 0.0])] * 8 + [(7, [0.5, 0.25, 0.0, 0.0])] * 3
    embeddings = pd.DataFrame({"vec_id": [x[0] for x in rows], "embedding": [x[1] for x in rows]})  # noqa: F841  read by the SQL
    want = sorted(duckdb.sql(topk.ORACLE).fetchall())
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for most in (topk.QUERIES, 4):
        monkeypatch.setattr(topk, "QUERIES", most)
        assert sorted(tuple(x) for x in topk.every_50th(d).select("query_id", "rank", "vec_id", "score").collect()) == want


def test_quotation_marks_are_walked_once():
    scorer = toxicity.Scorer(toxicity.Model(("badword",), (1,), (1.0,)))
    r = random.Random(5)

    def naive(text):
        total = 0.0
        for m in toxicity._WORD.finditer(text):
            if w := scorer._hit(m.group()):
                line = text.rfind("\n", 0, m.start()) + 1
                total += w * (toxicity.QUOTED if len(toxicity._OPEN.findall(text[line : m.start()])) % 2 else 1)
        return total

    for _ in range(40):
        text = "".join(r.choice(["badword ", '"', "plain ", "\n", "badwurd "]) for _ in range(60))
        assert scorer.weigh(text) == pytest.approx(naive(text))
    began = time.perf_counter()
    scorer.weigh('badword " ' * 500_000)
    assert time.perf_counter() - began < 5 * 4  # seconds; linear takes about two


def test_long_and_short_words_are_learned(spark):
    long = "x" * 60
    rows = [(i, f"plain {long} zq" if i % 2 else "plain text") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert set(toxicity.fit(docs, labels, F.lit(True)).terms) == {long, "zq"}
