"""Exact dedup under projections, the filtering stages and the whole pipeline against plain readings."""

import hashlib
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granula.llm import bpe, exact, jaccard, langid, mixing
from granula.llm.common import by_ids, scratch, shared_dir, without_ids
from granula.llm.queries import tokenizer_path

#: Also columns named like the operators' own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, row string, words int, kept boolean, sha string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = {
    "en": "the house and the garden of this town with that river were seen by many people who walked along",
    "de": "das haus und der garten von dieser stadt mit dem fluss wurden von vielen leuten gesehen die dort",
    "fr": "la maison et le jardin de cette ville avec une rivière ont été vus par beaucoup de gens qui marchaient",
}


def _rows():
    out = []
    for i in range(150):
        lang = [*TEXT][i % 3]
        words = TEXT[lang].split()
        text = " ".join(f"{words[(i * 7 + j * (1 + i % 5)) % len(words)]}{'' if j % 3 else chr(97 + (i * j) % 26)}" for j in range(20 + i % 40))
        out.append((i, text, lang))
    copies = [(200 + i, out[i][1] if i % 2 else "\n".join(out[i][1].split(" ")), "en") for i in range(25)]
    near = [(300 + i, out[30][1].replace("house", "house", 1) + f" end{i}", None) for i in range(12)]
    odd = [(400, None, "en"), (401, "", "en"), (402, " \n", None), (403, "12 ?!", "de"), (404, out[5][1], "de"), (404, out[5][1], "de"), (405, out[6][1] + " x", "de"), (405, out[7][1] + " y", "de"), (None, out[1][1], "fr"), (406, "x" * 9000, "en")]
    rows = [(i, t, x, ["s1", None, "s0", ""][(i or 0) % 4], 1, 2, "r", 3, True, "z") for i, t, x in out + copies + near + odd]
    return rows + [rows[3], rows[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(5)


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute_exact(rows):
    """One row of each group of equal texts: most code points, then smallest doc_id."""
    best = {}
    for r in rows:
        if r["doc_id"] is not None:
            k, v = norm(r["text"]), (-len(r["text"] or ""), r["doc_id"])
            best[k] = min(best.get(k, v), v)
    return sorted((i, k) for k, (_, i) in best.items())


@pytest.mark.parametrize("condition", ["true", "false", "doc_id < 100", "doc_id is null"])
def test_exact_dedup_keeps_its_rows_under_any_projection(docs, condition):
    n = docs.where("doc_id is not null").count()
    got = exact.dedup(docs, F.expr(condition))
    full = {(r.doc_id, r.text_sha256): r for r in got.collect()}
    want = brute_exact(docs.collect())
    assert sorted((r.doc_id) for r in full.values() if r.kept) == sorted(i for i, _ in want)
    assert got.count() == n
    for c in got.columns:
        assert got.select(c).toArrow().num_rows == n, c
    assert got.where("not kept").count() == sum(not r.kept for r in got.collect())


def test_a_side_that_lost_its_columns_is_an_error():
    import pyarrow as pa

    with pytest.raises(ValueError, match="sha"):
        exact._look_up(pa.table({"n_chars": [1], "doc_id": [1], "rows": [1]}), pa.table({"x": []}))


def test_exact_keep_one(docs):
    got = exact.keep_one(docs)
    assert got.columns == docs.columns and got.schema == docs.schema
    assert sorted((r.doc_id, norm(r.text)) for r in got.collect()) == brute_exact(docs.collect())
    assert got.count() == len(brute_exact(docs.collect()))
    assert exact.keep_one(docs.limit(0)).count() == 0


def test_rows_are_split_by_ids(docs):
    some = docs.where("doc_id % 3 = 0").select("doc_id")
    safe, other = by_ids(docs, some)
    assert {r.doc_id for r in other.collect()} >= {r.doc_id for r in some.collect()}
    assert safe.count() + other.count() == docs.where("doc_id is not null").count()
    left = without_ids(docs, some)
    assert Counter(map(str, left.collect())) == Counter(map(str, docs.where("doc_id % 3 != 0").collect()))
    assert without_ids(docs, some.limit(0)).count() == docs.where("doc_id is not null").count()


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_jaccard(rows):
    sets = [(r["doc_id"], shingles(r["text"])) for r in rows if r["doc_id"] is not None]
    root = {i: i for i, _ in sets}
    for _ in range(len(root)):
        before = dict(root)
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    return {i for i in root if root[i] == i}


def brute_language(rows):
    """Naive Bayes over the same features, feature by feature in Python integers and floats."""
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    salt = [0x9E3779B97F4A7C15 * (2 * i + 1) & mask for i in range(4)]

    def features(text):
        letters = re.sub(r" +", " ", "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in f" {text or ''} "))
        for n in (1, 2, 3):
            for a in range(len(letters) - n + 1):
                gram = [0 if c == " " else ord(c) for c in letters[a : a + n]]
                if any(gram) and not (n == 3 and not gram[1]):
                    yield mix(sum(g * salt[i] for i, g in enumerate(gram)) + salt[3] * (n - 1) & mask) % langid.BUCKETS

    import zlib

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    counts = defaultdict(Counter)
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and r["doc_id"] is not None and not held(r["doc_id"]):
            counts[r["lang"]].update(features(r["text"]))
    total = {x: sum(c.values()) + langid.SMOOTHING * langid.BUCKETS for x, c in counts.items()}
    out = []
    for r in rows:
        found = list(features(r["text"]))
        if not found:
            out.append((r["doc_id"], "und", 0.0))
            continue
        logs = {x: sum(float(np.float32(np.log((counts[x][f] + langid.SMOOTHING) / total[x]))) for f in found) for x in sorted(counts)}
        top = max(logs.values())
        out.append((r["doc_id"], min(x for x in logs if logs[x] == top), 1 / sum(np.exp(v - top) for v in logs.values())))
    return out


def test_language_id_against_brute_force(docs):
    rows = docs.collect()
    want = sorted(((i if i is not None else -1), p, round(s, 4)) for i, p, s in brute_language(rows))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.lang_pred, round(r.score, 4)) for r in langid.identify(docs).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=2e-3)


def test_a_mix_holds_every_row_as_often_as_it_is_taken(docs):
    plain = exact.keep_one(docs)
    times = Counter()  # 405 has two texts
    for r in mixing.mix(plain).collect():
        times[r.doc_id] += r.taken // r.size if r.size else 1
    got = mixing.materialise(plain)
    assert got.schema == docs.schema
    assert Counter(r.doc_id for r in got.collect()) == +times
    clash = plain.withColumn("_times", F.lit(1)).withColumn("key", F.lit("a")).withColumn("point", F.lit(2)).withColumn("times", F.lit(9))
    assert mixing.materialise(clash).count() == sum(times.values())
    twice = plain.union(plain.where("doc_id < 40"))
    assert mixing.materialise(twice).count() > 0
    assert mixing.materialise(docs.limit(0)).count() == 0


def test_the_pipeline_against_brute_force(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    rows = [r.asDict() for r in docs.collect()]
    known = [r for r, (_, p, s) in zip(rows, brute_language(rows), strict=True) if r["doc_id"] is not None and p != "und" and s >= 0.5]
    left = []
    for i, k in brute_exact(known):
        left.append(next(r for r in known if r["doc_id"] == i and norm(r["text"]) == k))
    roots = brute_jaccard(left)
    left = [r for r in left if r["doc_id"] in roots]
    mixed = mixing.mix(spark.createDataFrame([tuple(r.values()) for r in left], SCHEMA)).collect()  # the mix has SQL of its own
    times = {(r.doc_id, r.size): r.taken // r.size if r.size else 1 for r in mixed}
    lib = Tokenizer.from_file(tokenizer_path())
    lib.no_truncation()
    lib.no_padding()
    want = []
    for r in left:
        e = lib.encode(r["text"], add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, e)), lib.decode(e, skip_special_tokens=False))]
        want += [(r["doc_id"], len(e), *sha)] * times[r["doc_id"], len(WORD.findall(r["text"]))]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_the_pipeline_of_an_empty_table(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_and_leave_nothing_behind(spark, docs):
    import os

    count = lambda: sum(len(f) for _, _, f in os.walk(f"{shared_dir(spark)}/granula"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = count()
        with scratch(spark):
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            out.collect()
        assert count() == before


def test_jaccard_keep_one(docs):
    got = jaccard.keep_one(docs)
    assert {r.doc_id for r in got.collect()} == brute_jaccard(docs.collect())


def test_texts_are_encoded_one_by_one(spark):
    text = unicodedata.normalize("NFD", "été à l'œuvre ") + "z" * 3000 + " end"
    d = spark.createDataFrame([(1, text, 5), (1, text, 6), (2, None, 7)], "doc_id long, text string, ids int")
    got = bpe.digests(d, tokenizer_path()).collect()
    assert len(got) == 3 and got[0] == got[1] and got[2].n_tokens == 0
    assert bpe.digests(d.limit(0), tokenizer_path()).count() == 0
