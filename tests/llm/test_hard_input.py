"""Very long texts, ties, repeated rows, empty tables and columns with clashing names."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from granula.llm import bpe, common, exact, jaccard, langid, lines, mixing, preference, substring, topk, toxicity
from granula.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that the operators use inside.
CLASH = "key, rank, size, row, th, i, line, n, p, w, r, sha, keep_id, block, taken, bit, score, held_out".split(", ")


def clashing(df):
    return df.select("*", *(F.lit(f"{c}!").alias(c) for c in CLASH if c not in df.columns))


def line_texts():
    r = random.Random(11)
    texts = ["\n".join(r.choice("abcde") for _ in range(r.randrange(1, 30))) for _ in range(30)]
    return texts + [texts[3], texts[3] + "\nq\n" + texts[4], "x\n" * 90 + "y", "x\n" * 70, None, ""]


def naive_deepest(texts, least):
    """Per suffix the longest length least * 2**k of a prefix that an earlier suffix shares, from a sorted
    list of all suffixes."""
    split = [(t or "").split("\n") for t in texts]
    order = sorted((s[i:], d, i) for d, s in enumerate(split) if len(s) >= least for i in range(len(s)))
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    out = {}
    for at, (s, d, i) in enumerate(order):
        best = 0
        for step in (-1, 1):
            k, low = at + step, math.inf
            while 0 <= k < len(order):
                low = min(low, common(order[k - step][0], order[k][0]))
                if low <= best:
                    break
                if order[k][1:] < (d, i):
                    best = low
                    break
                k += step
        if best >= least:
            out[d, i] = least * 2 ** int(math.log2(best // least))
    return out


@pytest.mark.parametrize("least", [4, 3, 1])
def test_line_intervals_against_a_sorted_list_of_suffixes(spark, monkeypatch, least):
    monkeypatch.setattr(lines, "MIN_HOT", 5)
    texts = line_texts()
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.i): r.m for r in lines.repeated(d, least).groupBy("doc_id", "i").agg(F.max("m").alias("m")).collect()}
    assert got == naive_deepest(texts, least)


def test_lines_of_hard_tables(spark):
    texts = line_texts()
    d = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    plain = {r.doc_id: (r.n_removed, r.kept) for r in lines.remove(d).collect()}
    assert len(plain) == len(texts) and plain[30][1] == ""
    twice = lines.remove(d.union(d.where("doc_id in (3, 32)"))).collect()
    assert len(twice) == len(texts) + 2 and {(r.doc_id, r.kept) for r in twice} == {(i, v[1]) for i, v in plain.items()}
    assert lines.remove(d.limit(0)).count() == 0


def test_one_row_per_row_in_substring_dedup(spark):
    r = random.Random(5)
    long = [f"w{r.randrange(99999)}" for _ in range(32)]
    texts = [(1, " ".join(long)), (2, " ".join(long)), (2, " ".join(long)), (3, " ".join([*long[:31], "z"])), (4, " ".join([*long[:31], "y"])), (4, " ".join([*long[:31], "x"])), (5, None), (None, " ".join(long)), (6, " ".join(f"v{k}" for k in range(60_000)))]
    d = clashing(spark.createDataFrame(texts, "doc_id long, text string"))
    got = sorted((x.doc_id, x.n_words, x.n_removed) for x in substring.digests(d).collect())
    assert got == [(1, 32, 0), (2, 32, 32), (2, 32, 32), (3, 32, 31), (4, 32, 31), (4, 32, 31), (5, 0, 0), (6, 60_000, 0)]


def naive_removal(texts):
    """(doc_id, n_removed, sha of the kept words) of each (doc_id, text), by all windows' words."""
    first, split = {}, [(i, WORD.findall(t or "")) for i, t in texts]
    for i, w in split:
        for p in range(len(w) - 12):
            key = tuple(w[p : p + 13])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for q in range(p, p + 13)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((i, len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("bits", [64, 14, 10])
def test_names_that_meet_by_chance_remove_nothing(spark, bits):
    r = random.Random(3)
    texts = []
    for i in range(120):
        words = [r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(r.randrange(0, 60))]
        if i % 3 == 2:
            old = texts[r.randrange(len(texts))][1].split()
            cut = r.randrange(0, max(1, len(old)))
            words[3:3] = old[cut : cut + 30] + ["x"] * r.randrange(0, 30)
        texts.append((i, " ".join(words)))
    texts += [(40, texts[7][1]), (40, texts[90][1] + " y"), (90, texts[40][1]), (11, texts[11][1])]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    got = sorted((x.doc_id, x.n_removed, x.kept_sha256) for x in substring.digests(d, bits).collect())
    assert got == naive_removal(texts)


def test_mixing_of_long_texts_and_equal_keys(spark):
    rows = [(1, "a " * 100_000, "s"), (1, "a " * 100_000, "s"), (2, "b", "s"), (2, "b", "s"), (3, None, None), (4, "", "t"), (None, "x", "s")]
    d = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = mixing.mix(d).collect()
    assert sorted((r.doc_id, r.size) for r in got) == [(1, 100_000), (1, 100_000), (2, 1), (2, 1), (3, 0), (4, 0)]
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert sorted(map(str, mixing.mix(d).collect())) == sorted(map(str, got))


def test_exact_and_jaccard_of_hard_tables(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, long), (2, long + " end"), (2, long + " end"), (3, "\n".join(long.split())), (4, None), (5, ""), (None, long)]
    d = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact.dedup(d, exact.history_half()).collect()}
    assert got == {(1, 1, 2), (3, 1, 2), (2, 2, 2), (4, 4, 2), (5, 4, 2)}
    found = jaccard.jaccard_join(d)[0].collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
    assert exact.keep_one(d).columns == d.columns and jaccard.keep_one(d).columns == d.columns


def test_hot_keys_and_lists_in_blocks_change_nothing(spark, monkeypatch):
    """Groups of over two rows count as hot, lists meet in blocks of two sets; against brute force."""
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 2)
    shared = "one two three four five six seven eight nine ten"
    rows = [(i, f"{shared} {' '.join(f'w{i // 4}x{j}' for j in range(9))} e{i % 3}") for i in range(36)] + [(100 + i, "a b c d e f g") for i in range(7)] + [(200 + i, "") for i in range(4)]
    rows += [(300 + o, " ".join(f"s{j}" for j in range(o, o + 30))) for o in (0, 1, 2, 6, 7, 8, 12, 13, 14)]  # lists that several components share
    table = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := x.split()) else set() for i, x in rows}
    near = {u: [v for v in sets if sets[u] & sets[v] and 4 * len(sets[u] & sets[v]) >= 3 * len(sets[u] | sets[v])] for u in sets}
    root, before = {i: i for i in sets}, None
    while root != before:
        before, root = root, {u: min([root[u], *(root[v] for v in near[u])]) for u in sets}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(table)[0].collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}
    assert {r.doc_id: r.n_links for r in jaccard.link_counts(table).collect()} == {u: len(set(near[u]) - {u}) for u in sets}
    want = {}
    for i, x in rows:
        want.setdefault(x, []).append(i)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.dedup(table, exact.history_half()).collect()}
    assert got == {i: (min(want[x]), len(want[x])) for i, x in rows}


def test_bpe_of_hard_tables(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    lib.no_truncation()
    lib.no_padding()
    texts = ["ab" * 40_000, "été " * 5_000, "ab" * 40_000, "\u0000 \x1c a b", None]
    d = clashing(spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    want = []
    for i, t in enumerate(texts):
        e = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i % 3, len(e), hashlib.sha256(lib.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe.digests(d, tokenizer_path()).collect()) == sorted(want)


def test_language_of_long_texts_and_ties(spark):
    rows = [(i, "aaa bbb", ["x", "y"][i % 2]) for i in range(12)] + [(50, "é" * 300_000 + " aaa", None), (51, "aaa bbb", None), (51, "aaa bbb", None)]
    d = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = langid.predict(d, (["x", "y"], langid.np.full((langid.BUCKETS, 2), -1.0, langid.np.float32))).collect()
    assert len(got) == 15 and all(r.lang_pred == "x" and abs(r.score - 0.5) < 1e-6 for r in got)
    assert langid.keep_known(d).columns == d.columns


def test_topk_of_hard_tables(spark):
    d = clashing(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0])], "vec_id long, embedding array<double>"))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.every_50th(d).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 327680), (0, 2, 1, 327680), (0, 3, 2, 196608)]
    big = spark.createDataFrame([(0, [1e12, 1.0]), (1, [1e12, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="2\\*\\*53"):
        topk.every_50th(big)


def test_preference_of_hard_tables(spark):
    turns = [(0, t, "user", f"t{t}") for t in range(400)] + [(1, t, "user", f"t{t}" if t < 399 else "other") for t in range(400)]
    c = clashing(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = preference.formatted(c).collect()
    assert len(got) == 1 and got[0].n_prompt == 399


def brute_toxicity(model, text):
    """A document's score: every word against every term by plain edit distance."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    def near(word):
        hits = [(e, k) for k, t in enumerate(model.terms) if abs(len(t) - len(word)) <= 2 and (e := distance(word, t)) <= model.allowed[k]]
        return min(hits) if hits else None

    text, total = text.lower(), 0.0
    found = list(toxicity._WORD.finditer(text))
    words = [m[0] for m in found]
    for at, m in enumerate(found):
        got = near(m[0]) or (None if m[0].isalpha() else near(m[0].translate(toxicity._ALIKE)))
        if got is None or got[0] and m[0] in model.exceptions:
            continue
        w = (toxicity.NEAR if got[0] else toxicity.EXACT) * model.sure[got[1]] ** 4
        line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
        if len(toxicity._OPEN.findall(line)) % 2 or set(words[max(0, at - 3) : at]) & toxicity.SAYING:
            w *= toxicity.QUOTED
        elif set(words[max(0, at - toxicity.WINDOW) : at]) & toxicity.ADDRESS:
            w *= toxicity.ADDRESSED
        total += w
    return model.base + (1 - model.base) * (1 - math.exp(-total))


def test_toxicity_against_brute_force(spark):
    r = random.Random(8)
    calm = "the river and stones of this calm town were seen by many who said words about idols and morons".split()
    bad = ["idiot", "moron", "clownish", "scoundrelly"]
    texts = []
    for i in range(240):
        words = [r.choice(calm[:-2]) for _ in range(20)]
        if i % 4 == 0:
            for _ in range(3):
                w = list(r.choice(bad))
                if i > 160:
                    w[r.randrange(len(w))] = r.choice("abcx01")
                words[r.randrange(len(words))] = "".join(w)
        texts.append(r.choice(["{}", 'he wrote "{}', "you {}", "{}\nyour"]).format(" ".join(words)))
    texts += ["idol " * 3, "x" * 200_000 + " idiot", " ".join(["moron"] * 30_000), texts[0], None, ""]
    d = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels, F.lit(True))
    assert len(model.terms) >= 3
    got = {x.doc_id: x.score for x in toxicity.score(d, model).collect()}
    for i, t in enumerate(texts):
        if i != 242:  # thirty thousand equal words: by the formula
            assert got[i] == pytest.approx(brute_toxicity(model, t or "")), t
    assert got[242] == pytest.approx(1.0) and len(got) == len(texts)
    assert toxicity.judge(d.union(d.limit(3)), labels).count() == len(texts) + 3
