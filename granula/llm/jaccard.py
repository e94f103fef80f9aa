"""N-gram Jaccard self-join: rare-first prefix filtering, verified once per pair (PPJoin+ style).

A document's set is its distinct 5-word shingles (words lower-cased in A-Z); with fewer words, the
whole word sequence as one shingle; without words, empty. Two documents link when their sets'
Jaccard similarity is at least 3/4. Sets are held as 64-bit shingle hashes.

1. One pass over the texts: each document's set size and set key, and a fixed-size table of shingle
   counts over all documents (the frequency order; any total order gives exact results, and this
   one puts shared passages last).
2. Each distinct set sends the first n - ceil(3n/4) + 1 shingles in that order (its prefix) to
   inverted lists. Lists with one set go. In each other list the set that has the fewest rarer
   shingles (of near copies: the least altered) is the pivot, and all others are paired with it
   alone if the length and positional filters let them.
3. Pairs are made distinct, pass a filter by parity signatures of whole sets (2 to 4 bits a shingle)
   and the suffix filter and are verified on whole sets, once.
4. Members of a list of over two that the links so far leave in another component than its pivot's are paired
   with the members of other components in that list, and verified likewise. Pairs already in one
   component can't change the components, and a group of n near copies costs about n pairs, not n * n.

So the links of `jaccard_join` are only some: enough for the components. `all_links` and `link_counts`
have all of them: in place of 2 and 4 each list pairs all its members, block against block of at most
BLOCK_SETS sets, and a pair is verified once, however many lists it meets in. A group of n near copies
then costs n * n / 2 pairs.

Lists are keyed by 48 bits of a shingle's hash, beside which a posting holds its position (up to
65535; from there on filters are loose). Equal keys of different shingles only add pairs to verify.

Defined cases: null or empty text has n_shingles 0 and links with nothing; identical rows and equal
texts share a component; a row without doc_id is ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.llm.common import U64, chunks, components, durable, id_bits, join_hot, mix, only_bits, partitions, pow2, range_hash, texts, with_bit, without_ids

N = 5
SLOTS, BLOCKS = 1 << 20, 64
#: Bits of the smallest signature.
SIGNATURE = 1024
#: Pairs that are broadcast (16 bytes each); more are shuffled.
BROADCAST_PAIRS = 100_000
#: Bits of a posting's position, below those of its shingle.
POS_BITS = 16
MAX_POS = (1 << POS_BITS) - 1
#: Sets of a list that one block of `all_links` holds.
BLOCK_SETS = 256
#: Sets of one task remembered to send equal ones once; more only saves shuffle.
SEEN = 100_000


def shingle_sets(chunk, n: int = N) -> Iterator[tuple[int, np.ndarray]]:
    """(document's index, its sorted distinct shingle hashes) of each document of a chunk."""
    words, first = chunk.hashes(), chunk.first
    at = np.arange(max(0, len(words) - n + 1))
    grams = mix(range_hash(words, at, at + n)) if len(at) else np.zeros(0, U64)
    for d in range(len(chunk.ids)):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= n:
            yield d, np.unique(grams[a : b - n + 1])
        elif b > a:
            yield d, mix(range_hash(words[a:b], np.zeros(1, int), np.full(1, b - a)) + U64(b - a))
        else:
            yield d, np.zeros(0, U64)


def _key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True)


def _parity(s: np.ndarray) -> np.ndarray:
    """For each of 2 to 4 bits a shingle (a power of two) whether an odd number of shingles falls on
    it, as 64-bit words. A signature of twice the bits folds to one of these by xor of its halves."""
    size = max(SIGNATURE, pow2(2 * len(s)))
    odd = np.bincount((s >> U64(20)) & U64(size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _prefix(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


_FIRST = ["doc_id", "n", "k", "sig", "block", "counts"]


def _first_pass(batches):
    counts = np.zeros(SLOTS, np.int64)
    for chunk in chunks(batches, lower=True):
        ids, sizes, keys, signs = [], [], [], []
        for d, s in shingle_sets(chunk):
            np.add.at(counts, s & U64(SLOTS - 1), 1)
            ids.append(int(chunk.ids[d]))
            sizes.append(len(s))
            keys.append(_key(s))
            signs.append(_parity(s))
        sig = pa.array(signs, pa.list_(pa.int64()))
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), sig, pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())], _FIRST)
    step = SLOTS // BLOCKS
    blocks = counts.reshape(BLOCKS, step)
    parts = [b.astype(np.min_scalar_type(int(b.max()))).tobytes() for b in blocks]  # the width tells the type
    none = pa.nulls(BLOCKS, pa.int64())
    yield pa.record_batch([none, none, none, pa.nulls(BLOCKS, pa.list_(pa.int64())), pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], _FIRST)


def _add_counts(batches):
    """Sums the count blocks that reach this task; holds one array per block."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = np.frombuffer(part, f"u{len(part) * BLOCKS // SLOTS}").astype(np.int64)
            sums[block] = sums[block] + got if block in sums else got
    yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "counts"])


def _frequencies(rows: DataFrame) -> np.ndarray:
    """The count table: SLOTS numbers, whatever the input."""
    blocks = rows.where("block is not null").select("block", "counts").repartition(BLOCKS, "block").mapInArrow(_add_counts, "block int, counts binary")
    out = np.zeros(SLOTS, np.int64)
    for row in blocks.toLocalIterator():
        out[row.block * (SLOTS // BLOCKS) :][: SLOTS // BLOCKS] = np.frombuffer(row.counts, np.int64)
    return np.minimum(out, 2**32 - 1).astype(np.uint32)


def _postings(counts):
    def run(batches):
        seen: OrderedDict[int, None] = OrderedDict()
        freq = counts.value
        for chunk in chunks(batches, lower=True):
            x, k = [], []
            for _, s in shingle_sets(chunk):
                if not len(s):
                    continue
                key = _key(s)
                if key in seen:
                    seen.move_to_end(key)
                    continue
                seen[key] = None
                if len(seen) > SEEN:
                    seen.popitem(last=False)
                p = _prefix(len(s))
                rare = s[np.argsort(freq[s & U64(SLOTS - 1)], kind="stable")[:p]]
                x.append(rare & ~U64(MAX_POS) | np.minimum(np.arange(p, dtype=U64), U64(MAX_POS)))
                k.append(np.full(p, key, np.int64))
            if x:
                yield pa.record_batch([np.concatenate(x).view(np.int64), np.concatenate(k)], ["x", "k"])

    return run


def _may_link(a: str, b: str) -> F.Column:
    """Length and positional filter on two postings (n, pos, shared) of one list: the sets share at
    most what follows this shingle in both, and of what precedes it only what has a list."""
    na, nb, pa_, pb, sa, sb = (F.col(f"{x}{y}") for y in ("n", "pos", "shared") for x in (a, b))
    need = F.ceil(F.lit(3) * (na + nb) / F.lit(7))
    most = F.least(na - pa_, nb - pb) + F.least(sa, sb)
    return (100 * F.least(na, nb) >= 75 * F.greatest(na, nb)) & (most >= need)


def _sets(bits):
    def run(batches):
        for chunk in chunks(only_bits(batches, bits.value), lower=True):
            got = {_key(s): s.tobytes() for _, s in shingle_sets(chunk) if len(s)}
            yield pa.record_batch([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.binary())], ["k", "s"])

    return run


def _check(batches):
    """Pairs whose sets' similarity is at least 3/4."""
    grid = (np.arange(1, 16, dtype=U64)) << U64(60)
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
            need = -(-3 * (len(x) + len(y)) // 7)
            # Suffix filter: parts cut at the same symbols can share no more than the smaller holds.
            cx, cy = (np.diff(np.searchsorted(v, grid), prepend=0, append=len(v)) for v in (x, y))
            if np.minimum(cx, cy).sum() < need:
                continue
            at = np.searchsorted(x, y)
            at[at == len(x)] = 0
            keep[i] = (x[at] == y).sum() >= need
        yield batch.select([0, 1]).filter(pa.array(keep))


def _verify(pairs: DataFrame, classes: DataFrame, source: DataFrame) -> DataFrame:
    """Links among pairs (a, b) of set keys, with the classes' first documents (u, v)."""
    spark = source.sparkSession
    # Signature filter: each differing shingle turns one bit, so the turned bits are at most so many.
    sides = [classes.select(F.col("k").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "ab"]
    # The lengths of two sets that may link are so near that one signature is at most twice the other.
    fold = "if(size({0}) > size({1}), zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (x, y) -> x ^ y), {0})"
    bits = f"zip_with({fold.format('sa', 'sb')}, {fold.format('sb', 'sa')}, (x, y) -> bit_count(x ^ y))"
    turned = F.expr(f"aggregate({bits}, 0, (s, x) -> s + x) <= na + nb - 2 * ceil(3 * (na + nb) / 7)")
    few = F.broadcast if pairs.count() <= BROADCAST_PAIRS else lambda x: x
    signed = few(pairs).join(sides[0], "a").select("a", "b", "na", "sa")
    pairs = durable(signed.join(sides[1], "b").where(turned).select("a", "b"))
    ids = durable(pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct().join(classes, "k").select("k", "rep"))
    bits = spark.sparkContext.broadcast(id_bits(ids, "rep"))
    # The id set also lets other documents through; copies fold before they are sent.
    sets = with_bit(source, bits).mapInArrow(_sets(bits), "k long, s binary").groupBy("k").agg(F.first("s").alias("s"))
    both = (
        pairs.join(sets.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
        .join(sets.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a")
        .select("a", "b", "sa", "sb")
    )
    links = both.mapInArrow(_check, "a long, b long").distinct()
    reps = classes.select("k", "rep")
    return durable(
        links.join(reps.select(F.col("k").alias("a"), F.col("rep").alias("u")), "a").join(reps.select(F.col("k").alias("b"), F.col("rep").alias("v")), "b").select("a", "b", "u", "v")
    )


def _lists(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(source, members, classes, lists): phase 1, and the inverted lists of phase 2 with their pivots."""
    spark, source = docs.sparkSession, texts(docs)
    parts = partitions(docs)
    rows = durable(source.mapInArrow(_first_pass, "doc_id long, n long, k long, sig array<long>, block int, counts binary"))
    members = rows.where("block is null").select("doc_id", "n", "k", "sig")
    classes = durable(members.where("n > 0").groupBy("k").agg(F.min(F.struct("doc_id", "n", "sig")).alias("c"), F.count("*").alias("size")).select("k", F.col("c.doc_id").alias("rep"), "c.n", "c.sig", "size"))
    members = members.drop("sig")
    counts = spark.sparkContext.broadcast(_frequencies(rows))
    by_list, in_list = F.expr(f"shiftright(x, {POS_BITS})"), "over (partition by h)"
    unpacked = [by_list.alias("h"), F.expr(f"cast(x & {MAX_POS} as int)").alias("pos")]
    postings = source.mapInArrow(_postings(counts), "x long, k long").repartition(parts, by_list).select("x", "k", unpacked[0])
    kept = postings.selectExpr("*", f"min(k) {in_list} as least", f"max(k) {in_list} as most").where("least != most").select("h", "x", "k").distinct()
    # A shingle without a list is in no other prefix; so of the rarer ones only those with one count.
    kept = kept.select("x", "k").join(classes.select("k", "n"), "k")
    kept = kept.selectExpr("x", "k", "n", f"if(x & {MAX_POS} = {MAX_POS}, n, row_number() over (partition by k order by x & {MAX_POS}, x) - 1) as shared")
    kept = kept.selectExpr("x", "k", "shiftleft(n, 32) | shared as y").repartition(parts, by_list)
    kept = kept.select(unpacked[0], "k", F.expr("cast(shiftright(y, 32) as int)").alias("n"), unpacked[1], F.expr("cast(y & 4294967295 as int)").alias("shared"))
    lists = durable(
        kept.selectExpr("*", f"min(struct(pos, k, n, shared)) {in_list} as p", f"count(*) {in_list} as m").selectExpr("h", "m", "k", "n", "pos", "shared", "p.k as pk", "p.n as pn", "p.pos as ppos", "p.shared as pshared")
    )
    return source, members, classes, lists


#: The up to four lists before, in which two sets may have met already.
_PREV = "collect_list(h) over (partition by k order by pos, h rows between 4 preceding and 1 preceding) as prev"


def _all_links(source: DataFrame, classes: DataFrame, lists: DataFrame) -> DataFrame:
    """All links (a, b, u, v) between different sets."""
    blocks = f"cast(ceil(m / {BLOCK_SETS}) as int)"
    rows = durable(lists.selectExpr("h", "k", "n", "pos", "shared", f"{blocks} as blocks", f"cast(pmod(xxhash64(k), {blocks}) as int) as block", _PREV))
    one = rows.selectExpr("h", *(f"{x} as o{x}" for x in ("k", "n", "pos", "shared", "prev")), "block as b1", "explode(sequence(block, blocks - 1)) as b2")
    two = rows.selectExpr("h", "k", "n", "pos", "shared", "prev", "explode(sequence(0, block)) as b1", "block as b2")
    pairs = (
        one.join(two, ["h", "b1", "b2"])
        .where("b1 < b2 or ok < k")
        .where(~F.arrays_overlap("prev", "oprev"))  # else they meet in that list
        .where(_may_link("", "o"))
        .select(F.least("k", "ok").alias("a"), F.greatest("k", "ok").alias("b"))
        .distinct()
    )
    return _verify(durable(pairs), classes, source)


def all_links(docs: DataFrame) -> DataFrame:
    """All links (u, v), u < v, between class ids (a class: documents with equal sets)."""
    source, _, classes, lists = _lists(docs)
    return _all_links(source, classes, lists).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def link_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_links), one row for each row of docs: the number of documents it links with, of equal
    sets too. Rows of one doc_id count once per set."""
    source, members, classes, lists = _lists(docs)
    links = _all_links(source, classes, lists)
    sizes = members.where("n > 0").select("k", "doc_id").distinct().groupBy("k").agg(F.count("*").alias("size"))
    both = links.select("a", "b").union(links.select("b", "a"))
    far = both.join(sizes.withColumnRenamed("k", "b"), "b").groupBy(F.col("a").alias("k")).agg(F.sum("size").alias("far"))
    per = sizes.join(far, "k", "left").select("k", (F.col("size") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    per = durable(per.join(classes.select("k", "size"), "k"))
    linked = join_hot(members.where("n > 0"), per, "k", "size").select("doc_id", F.col("n_links").cast("long").alias("n_links"))
    return linked.union(members.where("n = 0").select("doc_id", F.lit(0).cast("long")))


def _rooted(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(k, rep, size, root) of each class: its first document, its rows and its component."""
    found = classes.select("k", "rep", "size").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    return durable(found.select("k", "rep", "size", F.coalesce("root", "rep").alias("root")))


def jaccard_join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (doc_id, n_shingles, class_id, component_id), one row for each row
    of docs; links (u, v) between class ids (a class: documents with equal sets): not all, but those
    that hold the components together."""
    source, members, classes, lists = _lists(docs)
    first = durable(lists.where("k != pk").where(_may_link("", "p")).select(F.least("k", "pk").alias("a"), F.greatest("k", "pk").alias("b")).distinct())
    links = _verify(first, classes, source)
    comp = _rooted(classes, components(links))

    # What is left: members outside their pivot's component, against other components in the list.
    # In a list of two the pivot has met the other. Lists are summed up in parts: members of a long one don't meet in a task.
    listed = lists.where("m > 2").select("h", "m", "k", "n", "pos", "shared", (F.col("k") == F.col("pk")).alias("pivot"))
    parts = listed.select("h", "m", "k", "pivot").join(comp.select("k", F.col("root").alias("c")), "k").groupBy("h", "m", "c").agg(F.max("pivot").alias("pivot"), F.count("*").alias("size"))
    mixed = parts.groupBy("h", "m").agg(F.max(F.struct("pivot", "c", "size")).alias("p")).where("p.size < m")
    in_block = f"cast(pmod(xxhash64(k), ceil(m / {BLOCK_SETS})) as int)"
    blocks = "cast(ceil({} / %d) as int)" % BLOCK_SETS
    mixed = durable(mixed.selectExpr("h", "p.c as pc", f"{blocks.format('m')} as blocks", f"{blocks.format('(m - p.size)')} as odd_blocks"))
    few = F.broadcast if mixed.count() <= BROADCAST_PAIRS else lambda x: x
    spread = mixed.selectExpr("h", "pc", "blocks", "odd_blocks", "explode(sequence(0, blocks - 1)) as block")
    # Lists with one component hold no pair in question; so the shingles before are those of these.
    rest = listed.withColumn("block", F.expr(in_block)).join(few(spread), ["h", "block"]).join(comp.select("k", F.col("root").alias("c")), "k")
    tagged = durable(rest.selectExpr("*", _PREV))
    odd_block = F.expr("cast(pmod(xxhash64(k, 1), odd_blocks) as int)").alias("b1")
    odd = tagged.where("c != pc").select("h", *(F.col(x).alias(f"o{x}") for x in ("k", "n", "pos", "shared", "prev", "c")), odd_block, F.expr("explode(sequence(0, blocks - 1))").alias("b2"))
    others = tagged.where("not pivot").select("h", "k", "n", "pos", "shared", "prev", "c", "pc", F.col("block").alias("b2"), F.expr("explode(sequence(0, odd_blocks - 1))").alias("b1"))
    more = (
        odd.join(others, ["h", "b1", "b2"])
        .where(F.col("c") != F.col("oc"))
        .where(~F.arrays_overlap("prev", "oprev"))  # else they meet in that list
        .where(((F.col("c") == F.col("pc")) | (F.col("k") > F.col("ok"))) & _may_link("", "o"))
        .select(F.least("k", "ok").alias("a"), F.greatest("k", "ok").alias("b"))
        .distinct()
    )
    more = durable(more.join(first, ["a", "b"], "left_anti"))
    if more.limit(1).count():
        links = durable(links.union(_verify(more, classes, source)))
        comp = _rooted(classes, components(links))
    names = ["doc_id", "n_shingles", "class_id", "component_id"]
    out = join_hot(members.where("n > 0"), comp, "k", "size").select("doc_id", "n", "rep", "root").toDF(*names)
    out = out.union(members.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id")))
    return out, links.select("u", "v")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those that have a smaller doc_id in their component; docs' columns.
    Rows of one doc_id stay or go together; a row without doc_id goes."""
    found, _ = jaccard_join(docs)
    return without_ids(docs, found.where("component_id != doc_id").select("doc_id"))
