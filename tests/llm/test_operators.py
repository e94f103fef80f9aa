"""The corpus operators against brute force, on hard small tables."""

import hashlib
import re

import duckdb
import pytest

from granula.llm import bpe, exact, jaccard, langid, lines, mixing, preference, substring, topk, toxicity
from granula.llm.queries import ORACLE_SQL, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, taken string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, salt=0):
    return [f"w{(i * 7919 + salt * 104729) % 5003}" for i in range(n)]


def rows():
    base, other = words(120), words(400, 3)
    edit = base[:60] + ["changed"] + base[61:]
    texts = [
        " ".join(base), " ".join(base), "  " + "\n".join(base), " ".join(edit), " ".join(base[:118]), " ".join(other), " ".join(words(30, 9) + other[100:150] + words(30, 8)),
        "", None, " \t\n", "one", "one two three", "ONE two THREE", "the " * 200, "the " * 150, "a\nb\nc\nd\ne", "x\na\nb\nc\nd\ny", "été à la été 12 <|endoftext|> d'Σ", "x" * 30000,
        " ".join(words(5000, 5)), "a b c d e", "a b c d e f", "A b c d e",
    ]
    out = [(i, t, ["en", "fr", None][i % 3], ["s1", None, "s0", ""][i % 4], len(t or ""), 1, "x") for i, t in enumerate(texts)]
    return out + [(100 + i, " ".join(base[: 119 - i % 3] + [f"e{i}"]), "en", "s1", 1, 1, "x") for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def oracle(name, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        con.register(t, df.toArrow())
    cur = con.sql(ORACLE_SQL[name])
    return cur.columns, sorted(map(str, cur.fetchall()))


@pytest.mark.parametrize(
    ("name", "run"),
    [
        ("op2_mixing", mixing.mix),
        ("op4_ngram_jaccard", lambda d: jaccard.jaccard_join(d)[0].select("doc_id", "n_shingles", "component_id")),
        ("op5_substring_dedup", substring.digests),
        ("op6_line_dedup", lines.digests),
        ("op7_exact_dedup", lambda d: exact.dedup(d, exact.history_half())),
    ],
)
def test_against_sql(docs, empty, name, run):
    cols, want = oracle(name, documents=docs)
    assert sorted(str(tuple(r)) for r in run(docs).select(cols).collect()) == want
    assert run(empty).count() == 0


def test_rows_without_id_and_repeated_rows(spark, docs):
    more = docs.union(docs.where("doc_id in (0, 10, 15)")).union(spark.createDataFrame([(None, "a b c d e", "en", "s", 1, 1, "x")], SCHEMA))
    n = docs.count()
    assert jaccard.jaccard_join(more)[0].select("doc_id").distinct().count() == n
    assert {r.component_id for r in jaccard.jaccard_join(more)[0].where("doc_id in (0, 1, 2)").collect()} == {0}
    assert exact.dedup(more, exact.history_half()).where("doc_id = 10").first().group_size == 2
    assert substring.digests(more).where("doc_id = 0").first().n_removed == 0
    assert lines.digests(more).select("doc_id").distinct().count() == n
    assert mixing.mix(more).count() == n + 3


@pytest.mark.parametrize("block", [256, 8])
def test_all_links_between_near_copies(docs, empty, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    cols, want = oracle("op4_ngram_jaccard_links", documents=docs)
    assert sorted(str(tuple(r)) for r in jaccard.link_counts(docs).select(cols).collect()) == want
    assert jaccard.link_counts(empty).count() == 0
    low = {i: WORD.findall((t or "").lower()) for i, t, *_ in rows()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in low.items() if w}
    reps = [i for i in sets if all(sets[j] != sets[i] for j in sets if j < i)]
    links = [(a, b) for a in reps for b in reps if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert sorted(map(tuple, jaccard.all_links(docs).collect())) == sorted(links)


def test_line_runs_count_by_words_too(spark):
    import random

    r = random.Random(6)
    long, pair = " ".join(words(60)), ["a b c d e", "f g h i j"]
    texts = [long, f"new\n{long}\nend", "\n".join(pair + ["", "x"]), "\n".join(["y", *pair, "", "z"]), "f g h i j", None, "", f"{long}\n{long}"]
    texts += ["\n".join(r.choice(["p q", "", "r", "s t u v", "w"]) for _ in range(r.randrange(1, 14))) for _ in range(40)]
    for min_words in (1, 5, 10):
        seen, want = set(), {}
        for i, t in enumerate(texts):  # all runs of all lengths, in order
            l = (t or "").split("\n")
            gone = set()
            for a in range(len(l)):
                runs = {tuple(l[a:b]) for b in range(a + 1, len(l) + 1) if b - a >= 4 or len(WORD.findall(" ".join(l[a:b]))) >= min_words}
                gone |= {a + k for x in runs & seen for k in range(len(x))}
                seen |= runs
            want[i] = (len(gone), "\n".join(x for k, x in enumerate(l) if k not in gone))
        d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert {x.doc_id: (x.n_removed, x.kept) for x in lines.remove(d, min_words=min_words).collect()} == want
    assert lines.remove(d.limit(0), min_words=5).count() == 0


def test_history_line_does_not_matter(docs):
    from pyspark.sql import functions as F

    got = [sorted(map(str, exact.dedup(docs, c).collect())) for c in (F.lit(True), F.lit(False), F.col("doc_id") < 10)]
    assert got[0] == got[1] == got[2]


def test_perfect_hash_is_minimal_and_perfect():
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 2**63, (5000, 4)).astype(np.uint64)
    assert sorted(exact.PerfectHash(keys).slots(keys)) == list(range(5000))
    assert list(exact.PerfectHash(keys[:0]).slots(keys[:3])) == [-1] * 3


def test_bpe_equals_library(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    lib.no_truncation()
    lib.no_padding()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, tokenizer_path()).collect()}
    for i, text, *_ in rows():
        e = lib.encode(text or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, e)), lib.decode(e, skip_special_tokens=False))]
        assert got[i] == (len(e), *sha), text
    ids = {r.doc_id: (r.ids, r.decoded) for r in bpe.tokens(docs, tokenizer_path()).collect()}
    assert ids[17][1] == lib.decode(ids[17][0], skip_special_tokens=False)


def test_transducer_needs_no_more_than_its_lookahead():
    import random

    t, r = bpe.load(tokenizer_path()), random.Random(4)
    for _ in range(30):
        symbols = [t.symbol[b] for b in "".join(r.choice(["th", "in", "er", "a", "on", "é", "ha"]) for _ in range(1500)).encode()]
        assert list(t.stream(symbols)) == t._merge(symbols[:])


def test_language_id(spark, docs, empty):
    text = {"en": "the house and the garden of this town with that river", "de": "das haus und der garten von dieser stadt mit dem fluss", "fr": "la maison et le jardin de cette ville avec une rivière"}
    rows_ = [(i, " ".join(w for k, w in enumerate((text[x] * 3).split()) if (i + k) % 4), x) for i, x in enumerate([*text] * 40)]
    d = spark.createDataFrame([*rows_, (500, None, "en"), (501, "12 ?!", "de"), (502, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(d).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows_ if got[i].held_out)
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3
    assert langid.identify(empty).count() == 0 and langid.keep_known(d).count() == len(rows_)


def test_toxicity(spark, empty):
    good = [f"calm words number {i} about the river and stones" for i in range(200)]
    bad = [f"you are an {['idiot', 'moron', 'clown'][i % 3]} and a moron number {i}" for i in range(80)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(900, "what an idiiot and m0ron"), (901, 'they quoted the word "idiot" in class'), (902, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i >= 200)) for i in range(280)] + [(3, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(d, labels).collect()}
    assert all(got[i].predicted == int(i >= 200) for i in range(280) if got[i].held_out)
    assert got[900].predicted == 1 and got[901].score < got[200].score and got[902].predicted == 0
    assert toxicity.judge(empty, labels).count() == 0 and toxicity.judge(d, labels.limit(0)).where("predicted = 1").count() == 0


def test_toxicity_keeps_all_terms_and_their_misspellings(spark):
    import itertools

    from pyspark.sql import functions as F

    many = ["".join(x) for x in itertools.product("bcdfghjklm", "aeiou", "npqrstvwxz")] + ["zz" + "".join(x) for x in itertools.product("abcde", repeat=2)]
    clean = [f"an idiom and a {w} about the river" for w in ("idioc", "idiol", "idios")] * 10
    bad = ["what an idiot " + " ".join(many)] * 10
    d = spark.createDataFrame(list(enumerate(clean + bad + ["such an idiiot", "such an idiom"])), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 30)) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels, F.lit(True))
    assert set(model.terms) >= {*many, "idiot"} and len(many) > 500
    assert model.exceptions >= {"idiom", "idioc", "idiol", "idios"}
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    assert got[40] > model.base == got[41] == got[0]  # few documents, so a low weight, but a hit


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
    return new


def test_automaton_equals_edit_distance():
    import random

    r, terms = random.Random(2), ["abcab", "abba", "cabcabcabca", "bbbbbb", "ab"]
    m = toxicity.Matcher(terms)
    for _ in range(3000):
        w = "".join(r.choice("abc") for _ in range(r.randrange(1, 13)))
        near = [(e, i) for i, t in enumerate(terms) if (e := edit_distance(w, t)) <= toxicity.edits(t)]
        assert m.match(w) == (min(near)[::-1] if near else None), w


@pytest.mark.parametrize("queries, first", [(1 << 16, 2048), (6, 4), (6, 40)])
def test_topk(spark, monkeypatch, queries, first):
    import random

    monkeypatch.setattr(topk, "QUERIES", queries)
    monkeypatch.setattr(topk, "FIRST", first)
    r = random.Random(1)
    rows_ = [(i, [r.choice([0.0, 0.1, -0.3, r.uniform(-1, 1)]) for _ in range(6)]) for i in range(700)] + [(700, None), (701, [float("nan")] * 6), (702, [None] * 6), (None, [0.1] * 6)]
    e = spark.createDataFrame(rows_, "vec_id long, embedding array<double>")
    cols, want = oracle("op8_topk_search", embeddings=e)
    assert sorted(str(tuple(x)) for x in topk.every_50th(e).select(cols).collect()) == want
    assert topk.every_50th(e.limit(0)).count() == 0 and topk.every_50th(e.where("vec_id < 3")).count() == 2


def test_preference(spark):
    t = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", None), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "q"), (3, 0, "user", "q"), (3, 1, "assistant", "a"), (4, 0, "user", "alone"), (6, 0, None, None), (7, 0, None, None), (None, 0, "user", "x"), (8, None, "user", "x")]
    c = spark.createDataFrame(t, "conv_id long, turn long, role string, text string")
    cols, want = oracle("op9_preference", conversations=c)
    got = preference.formatted(c)
    assert sorted(str(tuple(r)) for r in got.select(cols).collect()) == want
    assert [(r.pair_id, r.n_prompt, r.chosen_mask) for r in got.orderBy("pair_id").collect()] == [(0, 1, "1,0"), (1, 1, ""), (3, 1, "")]
    assert preference.formatted(c.limit(0)).count() == 0


def test_pipeline_against_brute_force(spark, docs):
    """The first three stages keep what a plain reading keeps."""
    kept = jaccard.keep_one(exact.keep_one(docs))
    assert kept.columns == docs.columns
    texts = {r.doc_id: r.text or "" for r in exact.keep_one(docs).collect()}
    low = {i: WORD.findall(t.lower()) for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()) for i, w in low.items()}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in root if root[i] == i)
