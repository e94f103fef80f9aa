"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Encoding reads symbols one by one and emits a token once no later input can change it. How much
lookahead that takes is computed from the merge list: a later symbol changes something only through
a chain of merges, each of a higher rank than the one before, whose right part begins with the left
part of the one before; the longest such chain, in symbols, is the sufficient lookahead. Tokens that
end at least that far before the end of what has been read are final, so the transducer holds a
bounded buffer however long a word is. Decoding feeds the tokens' bytes to an incremental
byte-to-text state machine, which holds at most the bytes of one unfinished character.

The tokenizer file's own steps come first: its added tokens are cut out of the raw text; then NFC,
white space runs to a space, lower case, its split pattern, bytes to printable symbols, and a word
end on the last symbol of each piece. The results of pieces are kept in a bounded cache; those pieces
of some texts that it lacks are merged together, one merge in each of them at a time.

Code points that the installed Unicode tables don't know yet count as neither letters nor digits.

Defined cases: null text is empty text: 0 tokens, the hash of nothing; a text of white space alone
likewise; other columns are not read; repeated rows each get their result.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.llm.common import keep_only, release

#: Pieces in a worker's cache; it starts anew when it is full, or holds 8 times as many tokens.
CACHE = 150_000
#: Pieces that are merged together.
TOGETHER = 4_096
#: Symbols read beyond the lookahead before tokens are emitted.
STEP = 512
#: White space of the tokenizers library's patterns (Unicode White_Space).
_WHITE = "\t-\r \x85\xa0  -     　"
#: Rank of a pair that no merge joins.
_NONE = 1 << 40


@lru_cache(1)
def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself if printable in Latin-1, else from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


def lookahead(merges: list[tuple[str, str]], length) -> int:
    """Symbols of sufficient lookahead of a merge list in rank order.

    For each merge (u, v) the longest chain that ends in it: |u| plus the longest chain of an
    earlier merge whose left part is a prefix of v.
    """
    best: dict[str, int] = {}
    most = 0
    for u, v in merges:
        n = len(v)
        f = length(u) + max((best.get(v[:k], 0) for k in range(1, n + 1)), default=0)
        if f > best.get(u, 0):
            best[u] = f
        most = max(most, f)
    return most


class Transducer:
    """The tokenizer of a file of the tokenizers library: BPE with word ends, split by a pattern."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.vocab = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        steps = spec["normalizer"]["normalizers"]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or level["use_regex"] or level["add_prefix_space"]:
            raise ValueError(f"{path}: its steps are not the ones built here")
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", _WHITE), regex.V0)
        self.specials = regex.compile("|".join(f"({regex.escape(s)})" for s in self.added)) if self.added else None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank, made = {}, {}
        for r, (u, v) in enumerate(merges):
            w = u + v
            if any(x in made and made[x] > r for x in (u, v)):
                raise ValueError("a merge uses a token that a later one makes")
            made.setdefault(w, r)
            self.rank.setdefault(self.vocab[u] << 20 | self.vocab[v], (r, self.vocab[w]))
        end = len(self.end)
        self.length = lambda t: len(t) - (end if end and t.endswith(self.end) else 0)
        self.ahead = lookahead(merges, self.length)
        self.size = {i: self.length(t) for t, i in self.vocab.items()}
        symbols = byte_symbols()
        self.symbol = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + self.end] for s in symbols]
        self.ends = np.array(self.symbol + self.last)
        pairs = sorted(self.rank.items())
        self.keys = np.array([k for k, _ in pairs])
        self.ranks, self.joined = np.array([v for _, v in pairs]).T.copy()
        every = range(max(self.text_of) + 1)
        self.numbers = np.array([b"%d" % i for i in every], object)
        self.texts = np.array([self.text_of.get(i, "").encode() for i in every], object)
        self._forget()

    def _merge(self, ids: list[int]) -> list[int]:
        """Lowest rank first, leftmost of equal ones."""
        rank, none = self.rank, (_NONE, 0)
        pairs = [rank.get(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while pairs:
            low = min(pairs)
            if low is none:
                break
            i = pairs.index(low)
            ids[i : i + 2] = [low[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank.get(ids[i - 1] << 20 | ids[i], none)
            if i < len(pairs):
                pairs[i] = rank.get(ids[i] << 20 | ids[i + 1], none)
        return ids

    def _forget(self) -> None:
        """Empties the cache: the place of each piece, and where the tokens of a place begin."""
        self.place: dict[str, int] = {}
        self.begin, self.tokens = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs and what they are merged to."""
        key = left << 20 | right
        i = np.searchsorted(self.keys, key)
        i[i == len(self.keys)] = 0
        return np.where(self.keys[i] == key, self.ranks[i], _NONE), self.joined[i]

    def merge_all(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each piece, as _merge gives them, and how many; a round makes the next merge of every piece."""
        data = [p.encode() for p in pieces]
        n = np.array([len(d) for d in data])
        ids = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
        ids[n.cumsum() - 1] += 256
        ids, of = self.ends[ids], np.repeat(np.arange(len(n)), n)
        rank, to = np.full(len(ids), _NONE), np.zeros(len(ids), np.int64)  # of a token and the next one of its piece
        at = np.flatnonzero(of[:-1] == of[1:])
        rank[at], to[at] = self._ranks(ids[at], ids[at + 1])
        done = []
        while len(ids):
            first = np.flatnonzero(np.diff(of, prepend=-1))
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(first, append=len(of)))
            over = low == _NONE
            done.append((of[over], ids[over]))
            at = np.flatnonzero((rank == low) & ~over)
            at = at[np.flatnonzero(np.diff(of[at], prepend=-1))]
            ids[at] = to[at]
            over[at + 1] = True
            new = at - np.cumsum(over)[at]
            ids, of, rank, to = ids[~over], of[~over], rank[~over], to[~over]
            rank[new] = _NONE
            at = np.concatenate([new, new - 1])
            at = at[(at >= 0) & (at + 1 < len(ids))]
            at = at[of[at] == of[at + 1]]
            rank[at], to[at] = self._ranks(ids[at], ids[at + 1])
        of, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(of, kind="stable")], np.bincount(of)

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """Tokens of one piece's symbols, each emitted once it is final."""
        held: list[int] = []
        for s in symbols:
            held.append(s)
            if len(held) >= 2 * self.ahead + STEP:
                at, limit = 0, len(held) - self.ahead
                for t in self._merge(held[:]):
                    if at + self.size[t] > limit:
                        break
                    at += self.size[t]
                    yield t
                held = held[at:]
        yield from self._merge(held)

    def _piece(self, piece: str) -> Iterator[int]:
        data = piece.encode()
        n, symbol = len(data) - 1, self.symbol
        if n < 2 * self.ahead + STEP:  # it ends within the buffer: everything waits for the end
            return iter(self._merge([*map(symbol.__getitem__, data[:-1]), self.last[data[-1]]]))
        return self.stream(self.last[b] if i == n else symbol[b] for i, b in enumerate(data))

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # noqa: RUF001  lower() would look at what follows
        return self.pieces.findall(text.lower())

    def _pieces(self, text: str) -> list[str]:
        """Pieces of any text; an added token is a piece with a space before it, which no other has."""
        if self.specials is None or "<" not in text:
            return self._plain(text)
        got, at = [], 0
        for m in self.specials.finditer(text):
            got += [*self._plain(text[at : m.start()]), f" {m[0]}"]
            at = m.end()
        return got + self._plain(text[at:])

    def _learn(self, pieces: set[str]) -> None:
        """Puts pieces into the cache."""
        new = [p for p in pieces if p not in self.place]
        if len(self.place) + len(new) > CACHE or len(self.tokens) > 8 * CACHE:
            self._forget()
            new = list(pieces)
        short = [p for p in new if p[0] != " " and len(p) <= 64]
        got = [self.merge_all(short[i : i + TOGETHER]) for i in range(0, len(short), TOGETHER)]
        rest = [p for p in new if p[0] == " " or len(p) > 64]
        for p in rest:
            ids = np.fromiter([self.added[p[1:]]] if p[0] == " " else self._piece(p), np.int32)
            got.append((ids, np.array([len(ids)])))
        if new:
            self.place.update(zip(short + rest, range(len(self.place), len(self.place) + len(new)), strict=True))
            tokens, n = (np.concatenate(x) for x in zip(*got, strict=True))
            self.tokens = np.concatenate([self.tokens, tokens.astype(np.int32)])
            self.begin = np.concatenate([self.begin, self.begin[-1] + n.cumsum()])

    def _parts(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, np.ndarray]]:
        self._learn({p for _, pieces in held for p in pieces})
        place = self.place.__getitem__
        for i, pieces in held:
            at = np.fromiter(map(place, pieces), np.int64, len(pieces))
            a, n = self.begin[at], self.begin[at + 1] - self.begin[at]
            yield i, self.tokens[np.repeat(a - n.cumsum() + n, n) + np.arange(n.sum())]

    def encode(self, texts: Iterable[str], step: int = 1 << 18) -> Iterator[tuple[int, np.ndarray]]:
        """(place of the text, tokens) for a part of a text at a time; a text without tokens comes once.

        About step code points, of one text or more, are held.
        """
        held, size = [], 0
        for i, text in enumerate(texts):
            for part in _between_spaces(text, step) if text else [""]:
                held.append((i, self._pieces(part)))
                size += len(part)
                if size >= step:
                    yield from self._parts(held)
                    held, size = [], 0
        yield from self._parts(held)

    def shown(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Numbers of tokens, and their symbols in UTF-8, joined by spaces."""
        return b" ".join(self.numbers[ids].tolist()), b" ".join(self.texts[ids].tolist())


_SPACE = regex.compile(f"[{_WHITE}]")


def _between_spaces(text: str, step: int) -> Iterator[str]:
    """text in parts of about step code points, cut at white space: a long text is not held in pieces."""
    a = 0
    while a < len(text):
        m = _SPACE.search(text, min(a + step, len(text)))
        b = m.start() if m else len(text)
        yield text[a:b]
        a = b if b > a else b + 1


class TextMachine:
    """Incremental bytes to text: what is fed comes out as far as its characters are whole."""

    def __init__(self):
        self._machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes, end: bool = False) -> str:
        return self._machine.decode(data, end)


def decode(transducer: Transducer, ids: Iterable[int]) -> Iterator[str]:
    """Text as the tokenizer file's decoder gives it: it has none, so its tokens joined by spaces."""
    machine, first = TextMachine(), True
    for i in ids:
        yield machine.feed((b"" if first else b" ") + transducer.text_of[i].encode())
        first = False
    yield machine.feed(b"", True)


@lru_cache(2)
def load(path: str) -> Transducer:
    return Transducer(path)


def _encode(path: str):
    def run(batches):
        keep_only("bpe", load.cache_clear)
        t = load(path)
        for batch in batches:
            ids, counts, left, right = batch.column(0), [], [], []
            for _, parts in groupby(t.encode(x.as_py() or "" for x in batch.column(1)), itemgetter(0)):
                n, one, two, machine = 0, hashlib.sha256(), hashlib.sha256(), TextMachine()
                for _, part in parts:
                    if len(part):
                        gap = b" " if n else b""
                        numbers, symbols = t.shown(part)
                        one.update(gap + numbers)
                        two.update(machine.feed(gap + symbols).encode())
                        n += len(part)
                two.update(machine.feed(b"", True).encode())
                counts.append(n)
                left.append(one.hexdigest())
                right.append(two.hexdigest())
            yield pa.record_batch([ids, pa.array(counts, pa.int64()), pa.array(left), pa.array(right)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        release()

    return run


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encode(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, ids and the text decoded from them."""

    def run(batches):
        keep_only("bpe", load.cache_clear)
        t = load(path)
        for batch in batches:
            encoded = t.encode(x.as_py() or "" for x in batch.column(1))
            ids = [[i for _, part in parts for i in part.tolist()] for _, parts in groupby(encoded, itemgetter(0))]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(["".join(decode(t, i)) for i in ids])], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
