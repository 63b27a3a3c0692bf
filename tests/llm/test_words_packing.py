import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pressloom.llm import packing, words

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["<|endoftext|> a", "a~b ~ c", "x\x1cy \x85z", "I'll don't 's", "Σας ΟΔΟΣ", "é a", "a b", "", "  ", "<|start", "É1 23!! x", "Ab,c\td\n"]


def test_word_hash_is_place_independent_and_survives_cutting():
    h, b = words.word_hashes([b"aa bb Aa", b"", b" bb cc"])
    assert b.tolist() == [0, 3, 3, 5] and h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3
    long = b"word next " * 200_000
    h, b = words.word_hashes([long])
    assert len(h) == 400_000 and len(set(h.tolist())) == 2


def test_encoder_equals_tokenizer():
    plain = Tokenizer.from_file(PATH)
    for text, got in zip(ODD, packing.WordEncoder(PATH, 2).encode(ODD)):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids + [2], text


@pytest.mark.parametrize("seed", range(5))
def test_pack_covers_every_id_once_without_padding(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 300, 900, 4096, 9000]) for _ in range(rng.randint(0, 300))]
    packed = packing.pack(lengths)
    at = dict.fromkeys(range(len(lengths)), 0)
    for d, start, n in sorted(p for s in packed for p in s):
        assert at[d] == start and n > 0
        at[d] += n
    assert list(at.values()) == lengths
    used = [sum(p[2] for p in s) for s in packed]
    assert all(u <= 4096 and u & (u - 1) == 0 for u in used)


def test_pack_documents(make):
    texts = ["one two three", None, "", "long word " * 3000, "one two three"] + ODD
    docs = make([*enumerate(texts), (None, "no id")])
    rows = packing.pack_documents(docs, PATH).collect()
    plain = Tokenizer.from_file(PATH)
    for i, text in enumerate(texts):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == i)
        assert [o[0] for o in own] == np.cumsum([0] + [o[1] for o in own[:-1]]).tolist() and sum(o[1] for o in own) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c and t == len(ids) for s, n, c, t in own)
    assert sum(r.doc_id is None for r in rows) == 1
    for s in {r.sequence_id for r in rows}:
        own = sorted((r.offset, r.length) for r in rows if r.sequence_id == s)
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own[:-1]]).tolist()
    assert packing.pack_documents(make([]), PATH).count() == 0
