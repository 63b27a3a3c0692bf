"""Main text of web pages by a linear-chain conditional random field over leaf blocks of the DOM.

A page is read into leaf blocks: runs of text between the edges of block-level elements, each with the open elements
above it. The field labels the blocks of a page in order, from the tags and the class, id and role words of a
block's ancestors, its length, link share, punctuation and place; Viterbi decoding picks the main blocks. It is
trained on labelled pages that are laid out here from common page furniture (menus, headers, sidebars, notices,
adverts, forms, comments, related links), around articles and within them, shown and hidden, under usual names and
under none. They are filled with texts of a bounded sample: the first ``SAMPLE_CHARS`` characters of ``SAMPLE_PAGES``
pages. Pages are read whole when their text is extracted.

Scripts, styles and comments are no blocks. Character references are decoded, white space in a block becomes one
space, blocks are trimmed and joined by a line feed; nothing else is dropped or capped.

Cases: null or empty html gives an empty text; broken markup (open tags, stray end tags, unclosed comments or
quotes) is read as far as it goes; rows that repeat give the same text; a page of any length is read whole; a null
page_id or url stays null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .crf import Chain

SAMPLE_PAGES, SAMPLE_CHARS = 200, 20_000
TRAIN_PAGES = 500

# fixed values: HTML elements by how they are read
HIDDEN = frozenset("script style noscript template iframe object svg math textarea select title head canvas audio video datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""html body address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr label legend li main menu nav ol p pre search section summary table tbody td tfoot
th thead tr ul""".split())
CONTAINERS = frozenset("body article aside div dialog fieldset footer form header ins main menu nav section td".split())
CLOSES_P = BLOCK - frozenset("body html button caption dd dt label legend li summary tbody td tfoot th thead tr".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>""", re.S)
NAME = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDE = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none""", re.I)


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order."""
    found: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    links: list[int] = []
    in_link, at = False, 0

    def text(raw: str) -> None:
        if raw:
            plain = html.unescape(raw) if "&" in raw else raw
            parts.append(plain)
            if in_link:
                links.append(len(plain.strip()))

    def flush() -> None:
        if parts:
            if joined := " ".join("".join(parts).split()):
                found.append(Block(tuple(stack), joined, sum(links)))
            parts.clear()
            links.clear()

    def close(names: set[str], fence: set[str] | frozenset = frozenset()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in fence:
                return

    while m := TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                in_link = False
            elif name in BLOCK:
                flush()
                close({name})
            continue
        attributes = m[3] or ""
        if name in HIDDEN and name != "head":
            end = re.compile(f"</{name}\\s*[^>]*>", re.I).search(page, at)
            at = end.end() if end else (len(page) if name in ("script", "style") else at)
        elif name in ("br", "wbr"):
            parts.append(" " if name == "br" else "")
        elif name == "a":
            in_link = True
        elif name in BLOCK:
            flush()
            if name in CLOSES_P:
                close({"p"}, {"button", "td", "th", "li", "div", "article", "section"})
            if name in SIBLINGS:
                close(SIBLINGS[name], FENCES.get(name, {"table"}))
            if name not in VOID:
                words = " ".join(filter(None, (a or b or c for a, b, c in NAME.findall(attributes))))
                stack.append((name, "HIDDEN" if HIDE.search(attributes) else words))
    text(page[at:])
    flush()
    return found


def path_features(path: tuple) -> set[str]:
    out = set()
    for depth, (tag, names) in enumerate(path):
        if tag not in ("html", "body"):
            out.add(f"t:{tag}")
        for w in WORD.findall(names):
            w = w.lower()
            if len(w) > 1:
                out.add(f"c:{w}")
                out.add(f"s:{w[:4]}")
        if depth == len(path) - 1:
            out.add(f"leaf:{tag}")
    # the innermost container says more than those around it
    tag, names = next(((t, n) for t, n in reversed(path) if t in CONTAINERS), ("", ""))
    out.add(f"near:{tag}")
    for w in WORD.findall(names):
        out.add(f"nearc:{w.lower()}")
    if any(n == "HIDDEN" for _, n in path):
        out.add("unseen")
    return out


def text_features(b: Block, at: int, number: int) -> list[str]:
    n = len(b.text)
    out = [f"long:{min(n.bit_length(), 9)}", f"linked:{4 * b.linked // max(1, n)}"]
    if b.text[-1] in ".!?\"')":
        out.append("stop")
    if "\xa9" in b.text[:40]:
        out.append("copyright")
    if at == 0:
        out.append("first")
    if at == number - 1:
        out.append("last")
    return out


class Extractor:
    def __init__(self, chain: Chain, rows: dict[str, int]):
        self.chain, self.rows, self.paths = chain, rows, {}

    def emission(self, page: list[Block]) -> np.ndarray:
        weights, rows, out = self.chain.weights, self.rows, []
        if len(self.paths) > 50_000:
            self.paths = {}
        for i, b in enumerate(page):
            base = self.paths.get(b.path)
            if base is None:
                base = self.paths[b.path] = sum(weights[rows[f]] for f in path_features(b.path) if f in rows) + self.chain.bias
            out.append(base + sum(weights[rows[f]] for f in text_features(b, i, len(page)) if f in rows))
        return np.array(out)

    def main_text(self, page: str | None) -> str:
        found = blocks(page or "")
        if not found:
            return ""
        labels = self.chain.best(self.emission(found))
        return "\n".join(b.text for b, good in zip(found, labels) if good)


# Page furniture of the labelled pages: tag and names of the container.
ARTICLES = """article|article:post|article:entry hentry|main|main:content|div:content|div:main-content|div:post-content|div:entry-content|
div:article-body|div:story body|section:story|section:article|div:text|div:page-body|div:post|div:main|td|div|section|body""".replace("\n", "").split("|")
FURNITURE = {
    "menu": """nav|nav:main-nav|div:nav|div:navbar|div:navigation|div:menu|ul:menu|div:main-menu|div:topnav|div:breadcrumb|div:breadcrumbs|
ol:breadcrumb|div:pagination|div:pager|div:toc links|menu""",
    "head": "header|header:site-header|div:header|div:masthead|div:top-bar|div:page-header|div:branding logo|div:banner",
    "foot": "footer|footer:site-footer|div:footer|div:page-footer|div:bottom|div:copyright|div:legal|div:colophon|div:credits",
    "side": """aside|aside:sidebar|div:sidebar|div:side|div:rail|div:widget|div:related|div:related-posts|section:recommended|div:more-stories|
div:trending|div:popular|div:tags|div:author-bio|div:share|div:social-share|ul:social""",
    "notice": """div:cookie-notice|div:cookie|div:consent|div:gdpr|div:notice|div:alert|div:popup|div:modal|div:overlay|div:warning|div:message|
dialog|div:paywall|div:subscribe|div:toolbar|div:privacy""",
    "ad": """div:ad|div:ads|div:advert|div:advertisement|div:adbox|div:sponsor|div:sponsored|div:promo|div:promoted|aside:ad|section:ads|
div:banner-ad|ins:adsbygoogle|div:commercial""",
    "form": "form|form:search|form:newsletter|form:login|div:newsletter|div:search|div:signup|fieldset|form:contact|div:login",
    "talk": """section:comments|div:comments|div:comment-list|ol:commentlist|div:discussion|div:disqus_thread|section:responses|
div:comment|div:replies|ul:comments|div:respond|article:comment|div:reader-comments""",
}


HIDINGS = (" hidden", ' style="display:none"', ' style="color:red; display: none"', ' hidden="hidden"')
# Containers that tell by their tag alone what they hold.
TELLING = frozenset("nav menu header footer aside form fieldset dialog ins".split())


def _open(spec: str, rng: random.Random, strange: float = 0.0, hide: float = 0.0) -> tuple[str, str]:
    """Start and end tag of a container; a share of them has names of no meaning, or none where the tag tells, or is hidden."""
    tag, _, names = spec.partition(":")
    if rng.random() < strange:
        names = "" if tag in TELLING and rng.random() < 0.5 else "".join(rng.choices("bdfgkmprtvz", k=1) + rng.choices("aeiou", k=1) + rng.choices("bdfgkmprtvz0123456789", k=4))
    elif rng.random() < 0.3:
        names = f"{names} {rng.choice(('box', 'row', 'col', 'wrap', 'inner', 'clearfix', 'x1', 'block', 'container'))}".strip()
    if tag == "body":
        return "", ""
    at = rng.choice(("class", "class", "id"))
    hidden = rng.choice(HIDINGS) if rng.random() < hide else ""
    return (f'<{tag} {at}="{names}"{hidden}>' if names else f"<{tag}{hidden}>"), f"</{tag}>"


def labelled_page(rng: random.Random, texts: Sequence[str]) -> tuple[str, set[str]]:
    """A page laid out at random and the texts of its main blocks."""
    main: set[str] = set()
    used = 0

    def fill(limit: int | None = None, good: bool = False) -> str:
        nonlocal used
        used += 1
        words = rng.choice(texts).split()
        words = words[: limit or len(words)] + [f"{used}"]
        if good:
            main.add(" ".join(words))
        return html.escape(" ".join(words), quote=False)

    def furniture(kind: str, inside: bool = False) -> str:
        spec = rng.choice(FURNITURE[kind].replace("\n", "").split("|"))
        # a plain container without a name cannot be told from the article that it stands in
        strange = 0.4 if spec.partition(":")[0] in TELLING else 0.0 if inside else 0.1
        start, end = _open(spec, rng, strange, 0.05)
        few = rng.randint(1, 6)
        if kind == "menu" or kind in ("foot", "side", "head") and rng.random() < 0.5:
            body = "<ul>" + "".join(f'<li><a href="/{i}">{fill(rng.randint(1, 3))}</a></li>' for i in range(few)) + "</ul>"
        elif kind == "form":
            body = "".join(f"<label>{fill(3)}</label><input>" for _ in range(few // 2 + 1)) + f"<button>{fill(2)}</button>"
            body = f"<p>{fill()}</p>{body if rng.random() < 0.5 else ''}" if rng.random() < 0.3 else body
        elif kind == "talk":
            tag = rng.choice(("p", "li", "div", "article"))
            body = f"<h3>{fill(2)}</h3>" + "".join(f"<{tag}>{fill(rng.choice((8, 30, None)))}</{tag}>" for _ in range(few))
        else:
            tag = rng.choice(("p", "div", "span", "h3", ""))
            body = "".join(f"<{tag}>{fill(rng.choice((3, 10, None)))}</{tag}>" if tag else fill(12) for _ in range(few if tag else 1))
        return f"{start}{body}{end}"

    def unseen() -> str:
        """A hidden block that looks like a part of the article."""
        tag = rng.choice(("div", "p", "section", "span", "div"))
        tag = "div" if tag == "span" else tag
        return f"<{tag}{rng.choice(HIDINGS)}>" + (f"<p>{fill()}</p>" if tag != "p" else fill()) + f"</{tag}>"

    def article() -> str:
        start, end = _open(rng.choice(ARTICLES), rng, 0.1)
        title = f"<h1>{fill(12, True)}</h1>"
        body = [f"<header>{title}</header>" if start.startswith("<article") and rng.random() < 0.3 else title]
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            if kind < 0.78:
                body.append(f"<p>{fill(rng.choice((1, 3, 12, 40, None, None)), True)}" + rng.choice(("</p>", "</p>", "</p>", "<br>")))
            elif kind < 0.84:
                body.append(f"<h2>{fill(6, True)}</h2>")
            elif kind < 0.89:
                body.append(f"<blockquote><p>{fill(None, True)}</p></blockquote>")
            elif kind < 0.93:
                body.append("<ul>" + "".join(f"<li>{fill(rng.choice((4, 15)), True)}</li>" for _ in range(3)) + "</ul>")
            else:
                body.append("<table><tr>" + "".join(f"<td>{fill(3, True)}</td>" for _ in range(4)) + "</tr></table>")
            if rng.random() < 0.25:
                body.append(furniture(rng.choice(("ad", "ad", "side", "side", "notice", "form", "talk", "talk")), True))
            elif rng.random() < 0.05:
                body.append(unseen())
        if rng.random() < 0.4:
            body.append(furniture(rng.choice(("ad", "talk", "talk", "side")), True))
        return f"{start}{''.join(body)}{end}"

    before = [furniture(rng.choice(("menu", "menu", "head", "head", "notice", "ad", "form", "side"))) for _ in range(rng.randint(0, 4))]
    after = [furniture(rng.choice(("talk", "side", "side", "ad", "form", "menu"))) for _ in range(rng.randint(0, 3))]
    after += [furniture("foot")] if rng.random() < 0.8 else []
    wrap = rng.choice(("", "", '<div class="wrapper">', '<div id="page">'))
    body = wrap + "".join(before) + article() + "".join(after) + ("</div>" if wrap else "")
    return f"<!DOCTYPE html><html><head><title>{fill(4)}</title></head><body>{body}</body></html>", main


def train(pages: DataFrame, key: str = "page_id", content: str = "html", sample_pages: int = SAMPLE_PAGES,
          train_pages: int = TRAIN_PAGES, seed: int = 0, sample_chars: int = SAMPLE_CHARS) -> Extractor:
    """Fit on ``train_pages`` laid-out pages, filled with block texts from the first ``sample_chars`` characters of
    ``sample_pages`` pages (least hash first)."""
    chosen = pages.select(F.col(key), F.substring(content, 1, sample_chars).alias("_html")).orderBy(
        F.xxhash64(key), F.xxhash64("_html")).limit(sample_pages)
    texts = sorted({b.text for r in chosen.toLocalIterator() for b in blocks(r["_html"] or "")}) or ["a text of some words."]
    rng = random.Random(seed)
    laid = [labelled_page(rng, texts) for _ in range(train_pages)]
    read = [(blocks(page), main) for page, main in laid]
    listed = [[path_features(b.path) | set(text_features(b, i, len(found))) for i, b in enumerate(found)] for found, _ in read]
    rows = {f: i for i, f in enumerate(sorted({f for page in listed for own in page for f in own}))}
    chains = []
    for (found, main), features in zip(read, listed):
        x = np.zeros((len(found), len(rows)), np.float32)
        for i, own in enumerate(features):
            x[i, [rows[f] for f in own]] = 1
        chains.append((x, np.array([b.text in main for b in found], float)))
    return Extractor(Chain(len(rows)).fit(chains, steps=200), rows)


def extract(pages: DataFrame, model: Extractor, key: str = "page_id", content: str = "html") -> DataFrame:
    """One row per page: key, url, text, n_chars. Nothing is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [model.main_text(h) for h in batch.column("_html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_key"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["_key", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).alias("_key"), "url", F.col(content).alias("_html"))
    out = T.StructType([T.StructField("_key", pages.schema[key].dataType), T.StructField("url", T.StringType()),
                        T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(run, out).withColumnRenamed("_key", key)
