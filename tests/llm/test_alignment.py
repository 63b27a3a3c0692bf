import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pressloom.llm import alignment
from pressloom.llm.perfect_hash import PerfectHash, Shard, build, buckets, shards_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["two  spaces", " lead", "trail ", "\n\ttabs\nand  \n lines", "naïve café — “quotes”", "日本語のテキスト と spaces", "emoji 😀😀 end", "<|endoftext|> and <s> </s>",
       "a▁b ▁ c", "\x00 nul\x00 \x00a", "don't we'll I'm", "x" * 300, "ｆｕｌｌ ﬁ width", "  nbsp a", "é á b", "   ", "　a b", "<0x41> a"]


def brute(texts):
    """By the rule, on whole texts, with sets of byte offsets."""
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = alignment.byte_letters()
    found, counts = [], Counter()
    for text in texts:
        data = b" " + (text or "").encode()
        a, b = (t.encode(data.decode(), add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        a_parts = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
        b_parts = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_parts) != data or b"".join(b_parts) != data:
            found.append(None)
            continue
        a_ends, b_ends = np.cumsum([len(p) for p in a_parts]), np.cumsum([len(p) for p in b_parts])
        both = sorted(set(a_ends.tolist()) & set(b_ends.tolist()))
        groups, links, at = [], [], 0
        for end in both:
            own = [[(ids[k], int(ends[k]) - len(parts[k]), int(ends[k])) for k in range(np.searchsorted(ends, at, "right"), np.searchsorted(ends, end, "right"))]
                   for ids, parts, ends in ((a, a_parts, a_ends), (b, b_parts, b_ends))]
            groups.append("|".join(",".join(str(i) for i, _, _ in side) for side in own))
            links += [(i, j) for i, s, e in own[0] for j, u, v in own[1] if s < v and u < e]
            at = end
        counts.update(links)
        found.append((len(a), len(b), groups, links))
    best = Counter()
    for (i, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else
            (f[0], f[1], len(f[2]), len(f[3]), sum(counts[x] == best[x[1]] for x in f[3]), sum(counts[x] for x in f[3]),
             hashlib.sha256(";".join(f[2]).encode()).hexdigest()) for f in found]


def rows_of(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.mark.parametrize("settings", [{}, {"CACHE_BYTES": 2000, "FLUSH_PAIRS": 50, "SHARD": 100, "ARITY": 2}])
@pytest.mark.parametrize("limit", [alignment.BROADCAST_BYTES, 0])
def test_alignment_equals_brute_force(spark, make, monkeypatch, settings, limit):
    for name, value in settings.items():
        monkeypatch.setattr(alignment, name, value)
    rng = random.Random(4)
    words = ["the", "river", "unbelievable", "Häuser", "x1y2", "3.14", "l'été", "日本", "don't", "\n", "  ", "-", "(a)"]
    texts = [*ODD, None, "", ODD[0], *(rng.choice([" ", ""]).join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)), "long word " * 2000]
    docs = make([*enumerate(texts), (None, "the river")])
    result = alignment.align(docs.repartition(6), A, B, broadcast_bytes=limit)
    assert result.columns == ["doc_id", *alignment.COUNTS, "groups_sha256"]
    assert rows_of(result) == dict(zip([*range(len(texts)), None], brute([*texts, "the river"])))
    assert alignment.align(make([]), A, B, broadcast_bytes=limit).count() == 0


def test_counts_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = docs.filter(F.length("text") < 2000)
    texts = {r.doc_id: r.text for r in kept.collect()}
    want = dict(zip(texts, brute(list(texts.values()))))
    assert rows_of(alignment.align(kept, A, B)) == want == rows_of(alignment.align(kept, A, B, broadcast_bytes=0))


def test_tree_over_many_branches(spark):
    """Partial rows of 40 tasks in 3 shards are summed over 9 branches in three levels."""
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 47, 300)
    rows = [(int(b), int(k), int(n), task) for task in range(40) for k, b, n in zip(keys, buckets(keys), rng.integers(1, 9, 300))]
    partial = spark.createDataFrame(rows, "bucket long, pair long, n long, task int")
    functions = alignment.hashed(partial.select("bucket", "pair").distinct(), 3)
    old, alignment.ARITY = alignment.ARITY, 3
    try:
        counts = {r.shard: np.frombuffer(r.counts, np.int64) for r in alignment.dense_counts(partial, functions, 3, 9).collect()}
    finally:
        alignment.ARITY = old
    got = {int(k): int(n) for r in functions.collect() for k, n in zip(np.frombuffer(r["keys"], np.uint64), counts[r.shard])}
    want = Counter()
    for _, k, n, _ in rows:
        want[k] += n
    assert got == want and len(counts) == 3


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 20_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 47, n)).astype(np.uint64)
    other = rng.integers(1 << 48, 1 << 60, 500).astype(np.uint64)
    one = build(keys)
    assert len(one.keys) == len(keys) and set(one.keys.tolist()) == set(keys.tolist())
    assert len(one.words) * 64 <= 6 * len(keys) + 64 * 20
    own = shards_of(buckets(keys), 7)
    function = PerfectHash([build(keys[own == s]) for s in range(7)])
    slots = function.members(keys)
    assert sorted(slots.tolist()) == list(range(len(keys))) and (function.members(other) == -1).all()
    assert PerfectHash([Shard(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]).members(other).max() == -1


def test_pieces_encode_as_the_whole_text():
    pair = alignment.Pair(A, B)
    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    rng = random.Random(8)
    alphabet = ["a", "Zebra", " ", "  ", "\n", "é", "日", "1", ".", "'s", "\t", " ", "ing", "<s>", "-", "<|endoftext|>", "zq"]
    assert pair.cuts
    for _ in range(500):
        text = " " + "".join(rng.choices(alphabet, k=rng.randint(1, 40)))
        parts = [p.decode() for p in pair.pieces(text.encode())]
        ids = whole.encode(text, add_special_tokens=False).ids
        assert [i for p in parts for i in pair.a(p)] == ids == pair.a(text)
        assert [i for p in parts for i in pair.b.encode(p[1:])] == pair.b.encode(text[1:])
