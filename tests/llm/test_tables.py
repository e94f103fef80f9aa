"""Vector codes, quality rules and closed itemsets against brute force, and on hard input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from granula.llm import baskets, codes, quality

VEC = "vec_id long, embedding array<float>, label int"


# Vector codes.


def naive_codes(rows):
    """The contract's rounds in plain integers, row by row."""
    kept = sorted(((i is None, i or 0, [math.floor(1024 * x) for x in v]), i, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    vs = [k[0][2] for k in kept]
    w = len(vs[0]) // 4
    parts = [[v[p * w : p * w + w] for v in vs] for p in range(4)]
    books = [part[:256] for part in parts]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda: [[min(range(len(books[p])), key=lambda e: (dist(x, books[p][e]), e)) for x in parts[p]] for p in range(4)]
    for _ in range(4):
        at = near()
        for p in range(4):
            groups = {}
            for x, e in zip(parts[p], at[p], strict=True):
                groups.setdefault(e, []).append(x)
            books[p] = [[math.floor(sum(c) / len(g)) for c in zip(*g, strict=True)] if (g := groups.get(e)) else b for e, b in enumerate(books[p])]
    at = near()
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error = [sum(dist(parts[p][r], books[p][at[p][r]]) for p in range(4)) for r in range(len(vs))]
    label = Counter()
    for (_, _, lab), e in zip(kept, error, strict=True):
        label[lab] += e
    return sorted(((i is None, i or 0, "".join(f"{at[p][r]:02x}" for p in range(4)), error[r], label[lab], sha) for r, (_, i, lab) in enumerate(kept)))


def found_codes(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.compress(df).collect())


def vectors(n, dims, seed):
    r = random.Random(seed)
    f = lambda x: float(np.float32(x))
    return [(i, [f(r.gauss(r.choice((-0.2, 0.1, 0.3)), 0.05)) for _ in range(dims)], r.choice((None, 0, 1, 1, 1))) for i in range(n)]


def test_codes_equal_brute_force_with_ties_repeats_and_nulls(spark):
    rows = vectors(300, 8, 3)
    rows += [(5, rows[9][1], 2), (5, rows[9][1], 2), (7, rows[11][1], None), (None, rows[12][1], 1), (900, None, 1), (901, [None] * 8, 1), (902, [math.nan] + [0.0] * 7, 1), (903, [math.inf] + [0.0] * 7, None)]
    d = spark.createDataFrame(rows, VEC)
    clash = d.select("*", *(F.lit("x").alias(c) for c in ("v", "was", "code", "error", "n", "part", "entry", "pos", "value", "label_error")))
    assert found_codes(clash.repartition(7)) == naive_codes(rows)


def test_codes_of_few_rows_and_of_large_components(spark):
    few = [(3, [1.5, -2.0, 0.0, 7.0], 0), (1, [1.5, -2.0, 0.0, 7.0], 0), (2, [-9.0, 1.0, 1.0, 1.0], None)]
    assert found_codes(spark.createDataFrame(few, VEC)) == naive_codes(few)
    big = [(i, [float((i * 7919) % 113) * 5_000.0, float(i) * -9_000.0, 1.0, 0.5], i % 2) for i in range(40)]
    assert found_codes(spark.createDataFrame(big, VEC)) == naive_codes(big)
    assert found_codes(spark.createDataFrame([(1, [], 1), (2, [], 1)], VEC))[0][2] == "00000000"
    assert found_codes(spark.createDataFrame([], VEC)) == [] == found_codes(spark.createDataFrame([(1, None, 1)], VEC))
    for bad in ([(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)], [(1, [1.0] * 5, 0)], [(1, [1e30] * 4, 0)]):
        with pytest.raises(ValueError):
            codes.compress(spark.createDataFrame(bad, VEC))


def test_codes_move_only_what_changed(spark, monkeypatch):
    """After the first round the parts that stay are in no shuffled sum."""
    state, books = codes.fit(codes.integers(spark.createDataFrame(vectors(600, 8, 5), VEC)), rounds=3)
    moved = state.where("not (was <=> code)").count()
    assert 0 < moved < 600
    got = codes.Codebooks(books.entries, 1000)
    same = got.assign(state).where("was = code").count()
    assert same > 300


# Closed itemsets.


def naive_itemsets(lines, least_support=12):
    b = {}
    for sale, item, flag in lines:
        if flag != "returned" and sale is not None and item is not None:
            b.setdefault(sale, set()).add(item)
    total, sup = len(b), Counter()
    ok = lambda n: n >= least_support and n * 10_000 >= total
    level = {frozenset([i]): n for i, n in Counter(i for s in b.values() for i in s).items() if ok(n)}
    while level:
        sup.update(level)
        items = sorted({i for s in level for i in s})
        level = {s: n for s in {x | {i} for x in level for i in items if i not in x} if ok(n := sum(s <= y for y in b.values()))}
    out = []
    for s, n in sup.items():
        if any(s < t and n == m for t, m in sup.items()):
            continue
        rules = [(c, sup[s - {c}], sup[frozenset([c])]) for c in sorted(s)] if len(s) > 1 else []
        rules = [(c, a, k) for c, a, k in rules if 100 * n >= 30 * a and n * total > a * k]
        sha = hashlib.sha256(";".join(f"{c}:{a}:{k}" for c, a, k in rules).encode()).hexdigest()
        out.append((",".join(map(str, sorted(s))), len(s), n, len(rules), min(((a, c) for c, a, _ in rules), default=(0, None))[1], sha))
    return sorted(out)


def found_itemsets(df):
    return sorted(tuple(r) for r in baskets.itemsets(df).select("items", "n_items", "support", "n_rules", "best_item", "rules_sha256").collect())


LINES = "sale_id long, item_id long, flag string"


def shop(seed, sales, every=()):
    """Bundles that go together, an item that hangs on another one, random ones, and long baskets."""
    r = random.Random(seed)
    out = []
    for s in range(sales):
        items = set(every) | {r.randrange(1, 30) for _ in range(r.randrange(1, 5))}
        if r.random() < 0.3:
            items |= {101, 102, 103}
        if r.random() < 0.2:
            items |= {104, 102}
        if s % 25 == 0:
            items |= set(range(1, 30)) | set(range(200, 300))
        if 7 in items:
            items.add(1007)
        out += [(s, i, r.choice(("kept", "swapped", None))) for i in items]
    return out + out[:9] + [(1, None, "kept"), (None, 3, "kept"), (2, 5, "returned"), (10_000, 5, "returned")]


@pytest.mark.parametrize("every", [(), (41, 42)])
def test_itemsets_equal_brute_force(spark, every):
    lines = shop(4, 260, every)
    d = spark.createDataFrame(lines, LINES).withColumns({c: F.lit("x") for c in ("y", "n", "s", "cid", "sup", "items", "size", "support")})
    want = naive_itemsets(lines)
    assert any(x[1] > 2 for x in want) and any(x[3] for x in want)
    assert found_itemsets(d) == want


def test_itemsets_with_hot_keys_salted(spark, monkeypatch):
    lines = shop(9, 200)
    plain = baskets.spread
    monkeypatch.setattr(baskets, "spread", lambda rows, found, keys, size, by, total: salted(plain, rows, found, keys, size, by))
    assert found_itemsets(spark.createDataFrame(lines, LINES)) == naive_itemsets(lines)


def salted(plain, rows, found, keys, size, by):
    """spread with every key hot: sizes are scaled up for the choice and set back."""
    big = found.withColumn(size, F.col(size) + 1_000_000)
    got = plain(rows, big, keys, size, by, 0)
    return got.withColumn(size, F.col(size) - 1_000_000)


def test_itemsets_of_nothing(spark):
    assert found_itemsets(spark.createDataFrame([], LINES)) == []
    assert found_itemsets(spark.createDataFrame([(1, 1, "kept"), (2, 2, "returned"), (None, None, None)], LINES)) == []


def test_long_baskets_are_set_apart(spark):
    sizes = spark.createDataFrame([(i, 3) for i in range(100)] + [(100 + i, 5000 + i) for i in range(11)], "sale_id long, size long")
    assert baskets.cut_of(sizes, 12) < 5000 <= baskets.cut_of(sizes, 11) + 5000
    assert baskets.cut_of(sizes.limit(0), 12) == 0


# Quality.


def naive_statistics(text):
    words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    n = len(words) or 1
    five = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return {
        "chars": len(text or ""), "words": len(words), "word_chars": sum(map(len, words)) / n, "longest_word": max(map(len, words), default=0),
        "distinct_words": len(set(words)) / n, "top_word": max(Counter(words).values(), default=0) / n,
        "echoed_words": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, "repeated_fives": (len(five) - len(set(five))) / len(five) if five else 0,
        "digit_words": sum(any(c in "0123456789" for c in w) for w in words) / n, "words_a_line": len(words) / ((text or "").count("\n") + 1) if words else 0,
        "commas_a_word": (text or "").count(",") / n if words else 0, "short_words": sum(len(w) == 1 for w in words) / n,
    }


def test_statistics_equal_plain_counts(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice(["a", "Bé", "the", "1x", "x,", "##", "ω"]) + r.choice(["", "", "\n", "\t "]) for _ in range(r.randrange(0, 60))) for _ in range(60)]
    texts += [None, "", "   ", "é", "a a a a a a a a", "word " * 300_000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in quality.describe(d).collect():
        for name, want in naive_statistics(texts[row.doc_id]).items():
            assert row[name] == pytest.approx(want, abs=1e-9), (name, texts[row.doc_id][:40])


def test_rules_are_what_the_forest_says_and_are_learned_from_training_rows_only(spark):
    r = random.Random(6)
    good = lambda: " ".join(r.choice(["one", "two", "three", "four", "and"]) for _ in range(30)) + "."
    bad = lambda: " ".join("###" for _ in range(30))
    rows = [(i, good() if i % 3 else bad()) for i in range(240)] + [(1000, None), (1001, ""), (None, bad()), (3, bad())]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("score", "label", "features", "words", "chars")})
    held = {i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2}
    # Labels of held-out rows are turned round: they must not matter.
    labels = [(i, int(bool(i % 3)) if i not in held else int(not i % 3), None) for i in range(240)] + [(5, None, 1), (None, 1, 1), (77_777, 1, 0)]
    got = quality.judge(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    for x in got:
        if x.doc_id is not None and x.doc_id < 240 and x.doc_id != 3:
            assert x.predicted == int(bool(x.doc_id % 3)) and x.held_out == (x.doc_id in held)
        assert 0 <= x.score <= 1


def test_rule_conditions():
    rule = (("chars", 1.0, 5.0), ("words", -math.inf, 2.0))
    assert str(quality.holds(rule)).count("chars") == 2 and str(quality.holds(rule)).count("words") == 1


def test_quality_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [x.score for x in quality.judge(docs, none).collect()] == [0.5, 0.5]
    ones = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    assert {x.predicted for x in quality.judge(docs, ones).collect()} == {1}
    assert quality.judge(docs.limit(0), ones).collect() == []
