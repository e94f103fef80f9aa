"""Substring dedup by recompression: removes words of long passages that an earlier document holds.

A window is 13 consecutive words of one document. Every word covered by a window whose word sequence
also starts in a document with a smaller doc_id goes.

Recompression alternately names maximal runs of one symbol and pairs of symbols. Which pairs merge
is decided by a side (left or right) that every symbol gets from its name, so equal substrings get
the same symbols in their interior, and differ only in what is popped at their ends. Names are
64-bit fingerprints of the contents, which makes them the same on all executors. A window's name is
what it pops at its ends in each round and the high-level symbols between; equal windows have equal
names. One Spark round brings equal names together (as packed blocks, sorted by name ranges, each
name once per block of documents) and tells every document which of its windows have an earlier
owner, and where.

Names have 64 bits, so that different windows share one now and then (w windows: w * w / 2**65 pairs,
millions at 100 TB). So every repeat is verified: windows that follow each other in both documents
form a span, and the SHA-256 of the span's words is held against that of the owner's words. A span
that differs is judged window by window: all windows of the corpus with its names meet by their words.

Defined cases: null text has no words; a row without doc_id is ignored; rows with the same doc_id
are one document to each other (neither removes the other's words); an empty table gives an empty
result; texts of under 13 words stay whole; each row gets one row, repeated ones too. Rows of one doc_id
with different texts are judged each on its own words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.llm.common import ID_BITS, U64, chunks, durable, fold_bits, id_bits, mix, only_bits, partitions, range_hash, texts, with_bit

WINDOW, ROUNDS = 13, 2
#: Name ranges: at least 256, so that a name's first byte need not be sent.
RANGES = 256
#: More would leave about a name in each of a chunk's blocks.
MAX_RANGES = 1 << 14
#: Name ranges for each range of documents.
PER_DOC_RANGE = 4
#: Claims on one document that are checked together.
PART_CLAIMS = 10_000
_TAGS = [U64(0xA24BAED4963EE407 + 0x9FB21C651E98DF24 * i & (1 << 64) - 1) for i in range(8)]


def _absorb(name, where, symbol, times, tag):
    """Adds (symbol, times) to the names where a mask holds."""
    name[where] = mix(name[where] * _TAGS[7] + symbol[where] * _TAGS[6] + times[where].astype(U64) * _TAGS[5] + _TAGS[tag])


def window_names(words: np.ndarray, first: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(names, starts) of all windows of `width` words inside documents; first: documents' bounds."""
    lengths = np.diff(first)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    start = np.flatnonzero(np.arange(len(words)) + width <= np.repeat(first[1:], lengths))
    name = np.zeros(len(start), U64)
    if not len(start):
        return name, start
    symbol, a, b = words, start.copy(), start + width - 1
    for level in range(ROUNDS):
        # Runs: pop the runs at both ends, as far as they are in the window.
        head = np.ones(len(symbol), bool)
        head[1:] = (symbol[1:] != symbol[:-1]) | (doc[1:] != doc[:-1])
        run = np.cumsum(head) - 1
        rs = np.flatnonzero(head)
        length = np.diff(rs, append=len(symbol))
        live = a <= b
        a_, b_ = np.where(live, a, 0), np.where(live, b, 0)
        ra, rb = run[a_], run[b_]
        one = live & (ra == rb)
        _absorb(name, one, symbol[a_], b_ - a_ + 1, 0)
        more = live & (ra != rb)
        _absorb(name, more, symbol[a_], rs[ra] + length[ra] - a_, 1)
        _absorb(name, more, symbol[b_], b_ - rs[rb] + 1, 2)
        a, b = np.where(more, ra + 1, 1), np.where(more, rb - 1, 0)
        symbol, doc = symbol[rs], doc[rs]
        symbol = np.where(length > 1, mix(symbol * _TAGS[4] + length.astype(U64)), symbol)
        # Pairs: a left symbol merges with a right one behind it; pop the ends that may merge outwards.
        left = (mix(symbol ^ _TAGS[level]) >> U64(63)).astype(bool)
        live = a <= b
        pop = live & ~left[np.where(live, a, 0)]
        _absorb(name, pop, symbol[np.where(pop, a, 0)], np.ones(len(a), int), 3)
        a = a + pop
        live = a <= b
        pop = live & left[np.where(live, b, 0)]
        _absorb(name, pop, symbol[np.where(pop, b, 0)], np.ones(len(a), int), 4)
        b = b - pop
        second = np.zeros(len(symbol), bool)
        second[1:] = left[:-1] & ~left[1:] & (doc[1:] == doc[:-1])
        to = np.cumsum(~second) - 1
        keep = np.flatnonzero(~second)
        paired = np.zeros(len(symbol), bool)
        paired[:-1] = second[1:]
        nxt = np.append(symbol[1:], U64(0))
        symbol, doc = np.where(paired, mix(symbol * _TAGS[3] + mix(nxt + _TAGS[2])), symbol)[keep], doc[keep]
        live = a <= b
        a, b = np.where(live, to[np.where(live, a, 0)], 1), np.where(live, to[np.where(live, b, 0)], 0)
    rest = range_hash(symbol, a, np.where(a <= b, b + 1, a))
    return mix(name + mix(rest + (b - a + 1).astype(U64) * _TAGS[1])), start


def _pack(name, doc, pos, ids) -> bytes:
    """A block of (name, doc, position), in the order of doc and position."""
    order = np.lexsort((pos, doc))
    name, doc, pos = name[order], doc[order], pos[order]
    docs, at = np.unique(doc, return_index=True)
    step = np.diff(pos, prepend=0)
    step[at] = pos[at]
    wide = len(step) > 0 and int(step.max()) >= 1 << 16
    low = name.view(np.uint8).reshape(-1, 8)[:, :7]
    step = step.astype("<u4" if wide else "<u2").view(np.uint8).reshape(len(pos), -1)
    head = np.array([len(name), len(docs), wide], "<i8")
    return head.tobytes() + ids[docs].astype("<i8").tobytes() + np.diff(at, append=len(pos)).astype("<i4").tobytes() + low.tobytes() + step.T.tobytes()


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m, wide = np.frombuffer(block, "<i8", 3)
    o = 24
    ids = np.frombuffer(block, "<i8", m, o)
    counts = np.frombuffer(block, "<i4", m, o := o + 8 * m)
    low = np.frombuffer(block, np.uint8, 7 * n, o := o + 4 * m).reshape(n, 7)
    width = 4 if wide else 2
    step = np.frombuffer(block, np.uint8, width * n, o + 7 * n).reshape(width, n)
    step = np.ascontiguousarray(step.T).view("<u4" if wide else "<u2").ravel().astype(np.int64)
    name = np.zeros((n, 8), np.uint8)
    name[:, :7] = low
    total = np.cumsum(step)
    at = np.cumsum(counts) - counts
    pos = total - np.repeat(total[at] - step[at], counts) if n else step
    return name.view(U64).ravel(), np.repeat(ids, counts), pos


def _spans(doc, owner, pos, at, n):
    """(doc, owner, pos, at, n) with touching runs of windows of one owner and shift joined: the n windows
    that start at pos in doc have the names of those that start at `at` in owner."""
    order = np.lexsort((pos, at - pos, owner, doc))
    doc, owner, pos, at, n = (x[order].astype(np.int64) for x in (doc, owner, pos, at, n))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1]) | ((at - pos)[1:] != (at - pos)[:-1])
    lift = np.cumsum(new) << 32
    end = np.maximum.accumulate(pos + n + lift) - lift
    new[1:] |= pos[1:] > end[:-1]
    cuts = np.flatnonzero(new)
    last = np.append(cuts[1:], len(doc)) - 1
    return doc[cuts], owner[cuts], pos[cuts], at[cuts], end[last] - pos[cuts]


_WIDTHS = ("<i8", "<i8", "<i4", "<i4", "<i4")


def _pack_spans(*columns) -> bytes:
    return b"".join(c.astype(t).tobytes() for c, t in zip(columns, _WIDTHS, strict=True))


def _unpack_spans(block: bytes) -> list[np.ndarray]:
    m, o, out = len(block) // 28, 0, []
    for t in _WIDTHS:
        out.append(np.frombuffer(block, t, m, o).astype(np.int64))
        o += m * int(t[2])
    return out


def _first_owners(ids: np.ndarray, pos: np.ndarray, cuts: np.ndarray):
    """For each occurrence, in groups that begin at cuts: the group's smallest document and where it
    first has the name."""
    sizes = np.diff(cuts, append=len(ids))
    owner = np.repeat(np.minimum.reduceat(ids, cuts), sizes)
    at = np.minimum.reduceat(np.where(ids == owner, pos, np.iinfo(np.int64).max), cuts)
    return owner, np.repeat(at, sizes)


def _covered_blocks(ids, owner, pos, at, doc_ranges: int):
    """Covered windows as one packed block of spans for each range of documents."""
    if not len(ids):
        return
    columns = _spans(ids, owner, pos, at, np.ones(len(ids), np.int64))
    part = (mix(columns[0].view(U64)) % U64(doc_ranges)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    for i, a in enumerate(cuts):
        take = order[a : cuts[i + 1] if i + 1 < len(cuts) else len(order)]
        yield int(part[take[0]]), _pack_spans(*(c[take] for c in columns))


_ROWS = "kind int, key int, doc_id long, n_words long, sha string, block binary"


def _rows(kind, key, doc, n, sha, block):
    return pa.record_batch(
        [pa.array(kind, pa.int32()), pa.array(key, pa.int32()), pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(block, pa.binary())],
        ["kind", "key", "doc_id", "n_words", "sha", "block"],
    )


def _name_all(ranges: int, bits: int):
    """Per chunk: its documents (kind 0), its names by range (1), windows covered within it (2)."""
    shift = U64(64 - ranges.bit_length() + 1)

    def run(batches):
        for chunk in chunks(batches, size=2 << 20):
            m = len(chunk.ids)
            sha = [hashlib.sha256(b" ".join(chunk.raw(d).split())).hexdigest() for d in range(m)]
            yield _rows([0] * m, chunk.ids % ranges, chunk.ids, np.diff(chunk.first), sha, [None] * m)
            name, start = window_names(chunk.hashes(), chunk.first)
            name &= ~U64(0) << U64(64 - bits)
            doc = np.searchsorted(chunk.first, start, "right") - 1
            order = np.argsort(name)
            name, start, doc = name[order], start[order], doc[order]
            pos = start - chunk.first[doc]
            cuts = np.flatnonzero(np.diff(name, prepend=~name[:1]) != 0) if len(name) else np.zeros(0, int)
            if not len(cuts):
                continue
            owner, at = _first_owners(chunk.ids[doc], pos, cuts)
            late = chunk.ids[doc] > owner
            out = [(2, ranges + key, block) for key, block in _covered_blocks(chunk.ids[doc[late]], owner[late], pos[late], at[late], ranges // PER_DOC_RANGE)]
            name, doc, pos = name[~late], doc[~late], pos[~late]
            edges = np.searchsorted(name >> shift, np.arange(ranges + 1, dtype=U64))
            for r in np.flatnonzero(np.diff(edges)):
                s = slice(edges[r], edges[r + 1])
                out.append((1, int(r), _pack(name[s], doc[s], pos[s], chunk.ids)))
            k, none = [x[0] for x in out], [None] * len(out)
            yield _rows(k, [x[1] for x in out], none, none, none, [x[2] for x in out])

    return run


def _meet(table: pa.Table, doc_ranges: int) -> pa.Table:
    """All of one name range: windows that a document with a smaller id owns; the rest passes."""
    kinds = table.column("kind").to_numpy()
    other = table.filter(pa.array(kinds != 1))
    blocks = [_unpack(x.as_buffer().to_pybytes()) for x in table.filter(pa.array(kinds == 1)).column("block")]
    if blocks:
        name, ids, pos = (np.concatenate(x) for x in zip(*blocks, strict=True))
        del blocks
        order = np.argsort(name)
        name, ids, pos = name[order], ids[order], pos[order]
        cuts = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        owner, at = _first_owners(ids, pos, cuts)
        late = ids > owner
        if late.any():
            out = list(_covered_blocks(ids[late], owner[late], pos[late], at[late], doc_ranges))
            none = [None] * len(out)
            more = _rows([2] * len(out), [x[0] for x in out], none, none, none, [x[1] for x in out])
            other = pa.concat_tables([other.cast(more.schema), pa.Table.from_batches([more])])
    return other


def _by_document(table: pa.Table) -> pa.Table:
    """Of one range of documents: the covered spans of each document."""
    parts = [_unpack_spans(x.as_buffer().to_pybytes()) for x in table.column("block")]
    columns = _spans(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    docs, at = np.unique(columns[0], return_index=True)
    ends = np.append(at[1:], len(columns[0]))
    blocks = [_pack_spans(*(c[a:b] for c in columns)) for a, b in zip(at, ends, strict=True)]
    return pa.table({"doc_id": pa.array(docs, pa.int64()), "spans": pa.array(blocks, pa.binary())})


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _digest(words: list[bytes], start: int, n: int) -> bytes:
    """Of the words that n windows from start on cover."""
    return hashlib.sha256(b" ".join(words[start : start + n + WINDOW - 1])).digest()


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [name for name, _ in fields])


_CLAIM = [("owner", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("digest", pa.binary())]
_CLAIM_DDL = "owner long, at int, n int, digest binary"


def _claims(batches):
    """Of rows (doc_id, text, spans): what must stand at `at` in owner if the spans are right."""
    for batch in batches:
        out = set()
        for text, block in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = _words(text)
            _, owner, pos, at, n = _unpack_spans(block.as_buffer().to_pybytes())
            out.update((o, a, k, _digest(words, p, k)) for o, p, a, k in zip(owner.tolist(), pos.tolist(), at.tolist(), n.tolist(), strict=True))
        yield _batch(list(out), _CLAIM)


def _held(batches):
    """Of rows (doc_id, text, claims): the claims that the text bears out."""
    for batch in batches:
        out = []
        for i, text, claims in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            words, known = _words(text), {}
            for c in claims:
                key = c["at"], c["n"]
                if key not in known:
                    known[key] = _digest(words, *key)
                if known[key] == c["digest"]:
                    out.append((i, *key, c["digest"]))
        yield _batch(out, _CLAIM)


def _unsure(batches):
    """Of rows (doc_id, text, spans, claims): the windows of the spans that made these claims."""
    for batch in batches:
        out = set()
        for i, text, block, claims in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            words, claims = _words(text), {(c["owner"], c["at"], c["n"], c["digest"]) for c in claims}
            sha = hashlib.sha256(b" ".join(words)).hexdigest()
            _, owner, pos, at, n = _unpack_spans(block)
            for o, p, a, k in zip(owner.tolist(), pos.tolist(), at.tolist(), n.tolist(), strict=True):
                if (o, a, k, _digest(words, p, k)) in claims:
                    out.update((i, sha, w, b" ".join(words[w : w + WINDOW]).decode()) for w in range(p, min(p + k, len(words) - WINDOW + 1)))
        yield _batch(list(out), [("doc_id", pa.int64()), ("sha", pa.string()), ("pos", pa.int64()), ("window", pa.string())])


def _windows(bits):
    """All windows (doc_id, window) whose word sequence may be in a bit set of such."""

    def run(batches):
        table = np.frombuffer(bits.value, np.uint32)
        for chunk in chunks(batches, size=2 << 20):
            name, start = window_names(chunk.hashes(), chunk.first)
            bit = (name % U64(ID_BITS)).astype(np.int64)
            hit = start[((table[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1).astype(bool)]
            doc = np.searchsorted(chunk.first, hit, "right") - 1
            raw = lambda w: chunk.buf[chunk.starts[w] : chunk.ends[w]].tobytes()
            out = {(int(chunk.ids[d]), b" ".join(raw(k) for k in range(w, w + WINDOW)).decode()) for d, w in zip(doc, hit.tolist(), strict=True)}
            yield _batch(list(out), [("doc_id", pa.int64()), ("window", pa.string())])

    return run


def _names_of(batches):
    """Names of windows given as text."""
    for batch in batches:
        both = pa.record_batch([pa.array(np.arange(batch.num_rows), pa.int64()), batch.column(0)], ["doc_id", "text"])
        for chunk in chunks(iter([both])):
            name, _ = window_names(chunk.hashes(), chunk.first)
            yield pa.record_batch([pa.array((name % U64(ID_BITS)).astype(np.int64), pa.int64())], ["b"])


def _remove(batches):
    """Rows (doc_id, text, spans, wrong) without their covered words."""
    for batch in batches:
        out = []
        for i, text, block, wrong in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            words = _words(text)
            sha = hashlib.sha256(b" ".join(words)).hexdigest()
            _, _, pos, _, n = _unpack_spans(block)
            late = np.zeros(len(words) + 1, np.int64)  # how many spans have a window that starts here
            np.add.at(late, np.minimum(pos, len(words)), 1)
            np.add.at(late, np.minimum(pos + n, len(words)), -1)
            late = np.cumsum(late[:-1]) > 0
            late[max(0, len(words) - WINDOW + 1) :] = False
            late[[w["pos"] for w in wrong or () if w["sha"] == sha]] = False
            starts = np.flatnonzero(late)
            edge = np.zeros(len(words) + 1, np.int64)
            edge[starts] += 1
            edge[starts + WINDOW] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            out.append((i, len(words), sha, int(gone.sum()), kept.decode()))
        yield _batch(out, [("doc_id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _only(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """(doc_id, text) of the documents among ids, and some more."""
    bits = docs.sparkSession.sparkContext.broadcast(id_bits(ids, column))

    def run(batches):
        return (b.select([0, 1]) for b in only_bits(batches, bits.value))

    return with_bit(docs, bits).mapInArrow(run, "doc_id long, text string")


def _false_claims(late: DataFrame, source: DataFrame) -> DataFrame:
    """Claims of `late` (doc_id, text, spans) that no text of their owner bears out.

    Copies make the same claims, which fold before they are sent; an owner's claims are dealt in
    parts of about PART_CLAIMS, each with the text."""
    claims = durable(late.mapInArrow(_claims, _CLAIM_DDL).distinct())
    parts = claims.groupBy("owner").agg(F.ceil(F.count("*") / PART_CLAIMS).alias("parts"))
    dealt = claims.join(parts, "owner").groupBy("owner", F.pmod(F.xxhash64("at", "n", "digest"), "parts").alias("part"))
    dealt = dealt.agg(F.collect_list(F.struct("at", "n", "digest")).alias("claims")).withColumnRenamed("owner", "doc_id")
    held = _only(source, claims, "owner").join(dealt, "doc_id").select("doc_id", "text", "claims").mapInArrow(_held, _CLAIM_DDL)
    return durable(claims.join(held, ["owner", "at", "n", "digest"], "left_anti"))


def _wrong(late: DataFrame, false: DataFrame, source: DataFrame) -> DataFrame:
    """(doc_id, wrong): the windows of spans with a false claim that no earlier document has, judged
    on their words: all windows of all documents that may equal one of them are gathered by words."""
    spans = late.mapInArrow(_spans_of, "doc_id long, owner long, at int, n int").distinct()
    of = spans.join(false, ["owner", "at", "n"]).groupBy("doc_id").agg(F.collect_set(F.struct("owner", "at", "n", "digest")).alias("claims"))
    unsure = durable(late.join(of, "doc_id").select("doc_id", "text", "spans", "claims").mapInArrow(_unsure, "doc_id long, sha string, pos long, window string").distinct())
    words = unsure.select("window").distinct().mapInArrow(_names_of, "b long")
    bits = source.sparkSession.sparkContext.broadcast(fold_bits(words))
    first = source.mapInArrow(_windows(bits), "doc_id long, window string").groupBy("window").agg(F.min("doc_id").alias("first"))
    return unsure.join(first, "window").where("first >= doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("sha", "pos")).alias("wrong"))


def _spans_of(batches):
    for batch in batches:
        for i, block in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            _, owner, _, at, n = _unpack_spans(block.as_buffer().to_pybytes())
            yield pa.record_batch([pa.array(np.full(len(n), i)), owner, at.astype(np.int32), n.astype(np.int32)], ["doc_id", "owner", "at", "n"])


def remove_repeats(docs: DataFrame, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(all, changed): all (doc_id, n_words, sha), sha being that of the whole words joined by a
    space; changed (doc_id, n_words, sha, n_removed, kept) for the documents that lose words.

    bits: of a name, 8 to 64; with fewer the result is the same and more windows meet in vain."""
    source = texts(docs)
    ranges = RANGES
    while ranges < partitions(docs) and ranges < MAX_RANGES:
        ranges *= 2
    rows = source.mapInArrow(_name_all(ranges, bits), _ROWS)
    doc_ranges = ranges // PER_DOC_RANGE
    rows = durable(rows.groupBy("key").applyInArrow(lambda table: _meet(table, doc_ranges), _ROWS))
    covered = rows.where("kind = 2").select(F.pmod("key", F.lit(doc_ranges)).alias("key"), "block")
    covered = durable(covered.groupBy("key").applyInArrow(_by_document, "doc_id long, spans binary"))
    late = _only(source, covered, "doc_id").join(covered, "doc_id").select("doc_id", "text", "spans")
    false = _false_claims(late, source)
    if false.limit(1).count():
        late = late.join(durable(_wrong(late, false, source)), "doc_id", "left")
    else:
        late = late.withColumn("wrong", F.lit(None).cast("array<struct<sha:string,pos:bigint>>"))
    changed = late.mapInArrow(_remove, "doc_id long, n_words long, sha string, n_removed long, kept string")
    return rows.where("kind = 0").select("doc_id", "n_words", "sha"), changed


def digests(docs: DataFrame, bits: int = 64) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    whole, changed = remove_repeats(docs, bits)
    few = changed.select("doc_id", "sha", "n_removed", F.sha2("kept", 256).alias("cut")).distinct()
    return whole.join(few, ["doc_id", "sha"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("cut", "sha").alias("kept_sha256")
    )
