"""BPE: pieces that are new are merged together, each once."""

import hashlib
import random

import pyarrow as pa
import pytest

from granula.llm import bpe
from granula.llm.queries import tokenizer_path

PARTS = ["th", "in", "er", "a", "on", "é", "ha", "ción", "ß", "Σ", "İ", "'s", "'", ".", "###", "7", "́", "中", "<|endoftext|>", "\x1c", " "]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    lib.no_truncation()
    lib.no_padding()
    return lib


def made(texts):
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    (out,) = bpe._encode(tokenizer_path())([batch])
    return [tuple(r.values())[1:] for r in out.to_pylist()]


def test_a_piece_is_merged_once_whatever_stands_beside_it(library, monkeypatch):
    r = random.Random(5)
    words = ["".join(r.choices(["th", "in", "er", "on", "ha", "sh", "nd"], k=6)) for _ in range(500)]
    texts = [" ".join(w + end for w in words) for end in ("", ".", ",", "###", "&&&", "!")]
    calls, merge = [], bpe.Transducer._merge
    monkeypatch.setattr(bpe.Transducer, "_merge", lambda self, ids: calls.append(1) or merge(self, ids))
    bpe.load.cache_clear()
    got = made(texts)
    bpe.load.cache_clear()
    assert [x[0] for x in got] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(calls) < len(words)


def test_pieces_merged_together_are_as_merged_alone():
    t, r = bpe.load(tokenizer_path()), random.Random(6)
    pieces = ["a", "aaaa", "aaaaa", "the", "é", "b" * 64, *("".join(r.choices(["th", "in", "er", "a", "on", "é", "ha", "aa"], k=r.randint(1, 20))) for _ in range(3000))]
    tokens, n = t.merge_all(pieces)
    at = 0
    for p, k in zip(pieces, n.tolist(), strict=True):
        data = p.encode()
        assert tokens[at : at + k].tolist() == t._merge([*(t.symbol[b] for b in data[:-1]), t.last[data[-1]]]), p
        at += k
    assert at == len(tokens)


@pytest.mark.parametrize("cache", [1, 50, bpe.CACHE])
def test_texts_of_a_batch_do_not_meet(library, monkeypatch, cache):
    monkeypatch.setattr(bpe, "CACHE", cache)
    bpe.load.cache_clear()
    r = random.Random(cache)
    texts = ["", None, " \n", "x" * 70, "the", "", *("".join(r.choices([*PARTS, " ", " "], k=r.choice([3, 40, 400]))) for _ in range(300)), " ".join(f"w{i}" for i in range(60_000)), "in " + "ab" * 3000, None]
    for text, got in zip(texts, made(texts), strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        shown = " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)
        assert got == (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in shown)), text
    assert len(made([])) == 0
    bpe.load.cache_clear()
