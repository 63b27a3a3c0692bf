import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pressloom.llm import decontaminate, html_text, language, quality, token_counts, words
from pressloom.llm.crf import Chain

GOOD = "the old house stood by the river and nobody went there any more after dark."
BAD = "BUY!! NOW!! $$$ CHEAP!! ### DEAL!!"


def test_chain_marginals_and_viterbi_equal_enumeration():
    rng = np.random.default_rng(1)
    chain = Chain(0)
    chain.transition = rng.normal(size=(2, 2))
    e = rng.normal(size=6)
    paths = [[(n >> i) & 1 for i in range(6)] for n in range(64)]
    scores = np.array([sum(e[i] * p[i] for i in range(6)) + sum(chain.transition[a, b] for a, b in zip(p, p[1:])) for p in paths])
    share = np.exp(scores - scores.max())
    want = (share[:, None] * np.array(paths)).sum(0) / share.sum()
    assert np.allclose(chain.marginals([e])[0], want) and chain.best(e) == paths[int(scores.argmax())]


def test_quality(spark, make):
    texts = [(GOOD + "\n") * (1 + i % 4) if i % 2 else (BAD + "\n") * (1 + i % 5) for i in range(120)] + [None, "", GOOD * 5000]
    docs = make([*enumerate(texts), (None, BAD)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    rows = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert all(rows[i].predicted == i % 2 for i in range(120)) and rows[122].predicted == 1 and rows[None].predicted == 0
    assert 0 <= rows[120].score == rows[121].score <= 1 and sum(r.held_out for r in rows.values()) > 20
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(1, 120, 2))
    empty = quality.score(docs, quality.train(docs, labels.limit(0)))
    assert {r.score for r in empty.collect()} == {0.5} and quality.score(make([]), model).count() == 0


def test_html(spark):
    page = """<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies</p></div><article><h1>Title &amp; more</h1><p><b>First   para<br>graph.<p>Second &eacute;&#8217;s<!-- no -->
    one.</p><div class="ad">Buy this thing now</div></article><aside class=sidebar><p>Other stories of today</p></aside>
    <section class="comments"><p>I do not agree with this at all.</p></section><form><label>Mail</label></form><footer>&copy; us</footer>"""
    rows = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 1), (3, "u", "", 1), (None, "u", page, 1), (5, "u", "<p>broken <a <!-- x", 1)],
                                 "page_id long, url string, html string, text int")
    model = html_text.train(rows)
    got = {r.page_id: r for r in html_text.extract(rows, model).collect()}
    want = "Title & more\nFirst para graph.\nSecond é’s one."
    assert got[1].text == want == got[None].text and got[1].n_chars == len(want) and got[2].text == got[3].text == "" and 5 in got
    assert html_text.extract(rows.limit(0), model).count() == 0
    rng = random.Random(99)
    right = total = 0
    for _ in range(60):  # laid-out pages that were not trained on
        laid, main = html_text.labelled_page(rng, [GOOD, "some other words in a line", "short text"])
        found = html_text.blocks(laid)
        labels = model.chain.best(model.emission(found))
        right += sum((b.text in main) == bool(y) for b, y in zip(found, labels))
        total += len(found)
    assert right / total > 0.95


def test_language(spark, make):
    rng = random.Random(1)
    sets = {"aa": ["tho", "wen", "ing"], "bb": ["été", "oui", "çon"], "cc": ["ñar", "ción", "que"]}
    texts = [(i, " ".join(rng.choice(sets[lang]) for _ in range(rng.choice((4, 30, 200)))), lang) for i in range(300) for lang in [rng.choice(list(sets))]]
    docs = spark.createDataFrame(texts + [(900, None, "aa"), (901, "12 !", None), (902, "", "bb"), (None, "tho wen ing", None)], "doc_id long, text string, lang string")
    net = language.train(docs)
    rows = {r.doc_id: r for r in language.predict(docs, net).collect()}
    held = [(rows[i].lang_pred, lang) for i, _, lang in texts if rows[i].held_out]
    assert len(held) > 30 and sum(a == b for a, b in held) / len(held) > 0.95
    assert [rows[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and rows[None].lang_pred == "aa"
    text = bytes(range(97, 123)) * 40
    assert b"".join(w[: language.WINDOW - language.SPAN + 1].tobytes() for w in language.windows_of(text))[: len(text)] == text[: len(text)]
    assert language.predict(docs.limit(0), net).count() == 0


def plain_alignment(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_plain_smith_waterman():
    rng = np.random.default_rng(4)
    for _ in range(100):
        a, b = rng.integers(0, 5, rng.integers(1, 15)), rng.integers(0, 5, rng.integers(1, 40))
        score, first, end = decontaminate.align(a, b)
        assert score == plain_alignment(a, b) == plain_alignment(a, b[first:end])


def test_decontamination(spark, make):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(2000)]
    items = [" ".join(rng.choice(vocab) for _ in range(30)) for _ in range(5)]
    other = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    changed = items[1].split()
    changed[4], changed[12], changed[20] = "x", "y", "z"
    texts = [other(50) + " " + items[0].upper() + " " + other(9), other(20) + " " + " ".join(changed), other(200), None, "", other(30) + " " + " ".join(items[2].split()[:5])]
    texts += [f"{other(5)} {items[3]}."] * 40
    bench = spark.createDataFrame([*enumerate(items), (5, None), (6, ""), (7, items[0])], "item_id long, text string")
    docs = make([*enumerate(texts), (None, items[0])])
    for block in (20_000, 2):
        got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs, bench, block_items=block).collect()}
        assert got == {(0, 0), (0, 7), (1, 1), (None, 0), (None, 7)} | {(i, 3) for i in range(6, 46)}
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {2, 3, 4, 5}
    assert decontaminate.find(make([]), bench).count() == 0 and decontaminate.find(docs, bench.limit(0)).count() == 0


def test_decontamination_of_edited_copies_beside_a_large_group(spark, make):
    rng = random.Random(8)
    vocab = [f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuv"]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    item = prose(14)
    edited = [[w + "x" if rng.random() < 0.2 else w for w in item] for _ in range(200)]
    texts = [" ".join(prose(20) + item + prose(20)) for _ in range(150)]
    texts += [" ".join(prose(20) + e + prose(20)) for e in edited] + [" ".join(prose(54)) for _ in range(100)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    code = lambda ws: words.word_hashes([" ".join(ws).encode()], words.LETTERS)[0]
    grams = lambda ws: {tuple(ws[i : i + 3]) for i in range(len(ws) - 2)}
    want = {i for i, t in enumerate(texts) if len(grams(item) & grams(t.split())) > 1
            and decontaminate.align(code(item), code(t.split()))[0] >= len(item)}
    assert len(want) > 300
    assert {r.doc_id for r in decontaminate.find(make(texts), bench).collect()} == want  # as if the item were rare
    for _ in range(300):  # what is left out before alignment could not have reached the least similarity
        a, b = (np.array([rng.randint(0, 9) for _ in range(n)]) for n in (rng.randint(1, 12), rng.randint(1, 40)))
        for least in (0.3, 0.5, 0.9):
            assert decontaminate._may_reach(a, b, least) or decontaminate.align(a, b)[0] < 2 * least * len(a)


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_token_counts(spark, make):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    rng = random.Random(1)
    alphabet = ["a", "b ", " c", "  ", "\n", "\n\n", "don't", " é", "1 2", " x", "'s", " The", "...", "word word", " "]
    texts, edits, after = [None, ""], [], {}
    for i in range(60):
        texts.append("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 2000))))
    for i, t in enumerate(texts):
        s = t or ""
        for seq in range(i % 4):
            at, remove, insert = rng.randint(0, len(s) + 3), rng.choice([0, 1, 5, 400]), "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 2, 900])))
            edits.append((i, seq, at, remove, insert))
            at = min(at, len(s))
            s = s[:at] + insert + s[at + remove :]
        after[i] = s
    frame = spark.createDataFrame(edits + [(None, 0, 0, 1, "x"), (999, 0, 0, 1, "x"), (1, 9, None, None, None)],
                                  "doc_id long, seq int, at long, remove long, insert string")
    rows = {r.doc_id: r for r in token_counts.count(make([*enumerate(texts), (None, "no id")]), frame, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert rows[i].tokens_before == len(plain(t or "")) and rows[i].tokens_after == len(plain(after[i])) and rows[i].chars_after == len(after[i])
    assert rows[None].tokens_after == 2 and rows[None].n_edits == 0 and len(rows) == len(texts) + 1
    assert token_counts.count(make([]), frame, RANKS, public_tokenizers.PATTERN).count() == 0
