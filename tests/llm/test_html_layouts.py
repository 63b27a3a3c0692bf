"""Layouts beyond the test pages: furniture within the article, hidden blocks, long attributes, names never seen."""

import random

import pytest

from pressloom.llm import html_text

FIRST = "The old house stood by the river and nobody went there any more after dark."
LAST = "Many years later the town built a new bridge over the water."
OTHER = "Buy this thing now while it is cheap, only today in our shop."


@pytest.fixture(scope="module")
def model(spark):
    return html_text.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def page(body):
    return f"<html><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Some title here</h1><p>{FIRST}</p>{body}</article><footer>&copy; us</footer></body></html>"


CASES = {
    "plain": f"<p>{LAST}</p>",
    "attribute of 30000 characters": f'<p title="{"a" * 30_000}>b">{LAST}</p>',
    "advert at the end": f'<p>{LAST}</p><div class="ad"><p>{OTHER}</p></div>',
    "advert between": f'<div class="advert"><p>{OTHER}</p></div><p>{LAST}</p>',
    "related between": f'<aside class="related"><p>{OTHER}</p></aside><p>{LAST}</p>',
    "bare aside": f"<aside><p>{OTHER}</p></aside><p>{LAST}</p>",
    "comments between": f'<section class="comments"><p>{OTHER}</p></section><p>{LAST}</p>',
    "comments at the end": f'<p>{LAST}</p><section class="comments"><p>{OTHER}</p></section>',
    "hidden": f"<div hidden><p>{OTHER}</p></div><p>{LAST}</p>",
    "display none": f'<div style="display:none"><p>{OTHER}</p></div><p>{LAST}</p>',
    "hidden paragraph": f"<p>{LAST}</p><p hidden>{OTHER}</p>",
    "form": f"<form><p>{OTHER}</p></form><p>{LAST}</p>",
}


@pytest.mark.parametrize("name", CASES)
def test_furniture_of_an_article_is_left_out(model, name):
    assert model.main_text(page(CASES[name])) == f"Some title here\n{FIRST}\n{LAST}"


def test_an_open_quote_ends_with_its_tag(model):
    assert OTHER not in model.main_text(page(f'<p>{LAST}</p><p title="x>{LAST}</p><div hidden>{OTHER}</div>'))


def test_layouts_without_a_name_seen_in_training(model, monkeypatch):
    """Tags, places and shapes alone: no class or id name of these pages stands in a training page."""
    rng = random.Random(5)
    tags = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "notice": "dialog", "ad": "ins", "form": "form", "talk": "aside"}
    monkeypatch.setattr(html_text, "FURNITURE", {k: f"{t}:qwx{i}zz" for i, (k, t) in enumerate(tags.items())})
    monkeypatch.setattr(html_text, "ARTICLES", ["article:qwyzz", "main:qwuzz", "article"])
    right = total = 0
    for _ in range(200):
        laid, main = html_text.labelled_page(rng, [FIRST, LAST, "some other words in a line", "short text"])
        found = html_text.blocks(laid)
        labels = model.chain.best(model.emission(found))
        right += sum((b.text in main) == bool(y) for b, y in zip(found, labels))
        total += len(found)
    assert right / total > 0.95, right / total


def test_long_pages_are_read_whole(model):
    got = model.main_text(page("".join(f"<p>{LAST} {i}</p>" for i in range(5000))))
    assert got.count("\n") == 5001 and got.endswith(f"{LAST} 4999")
