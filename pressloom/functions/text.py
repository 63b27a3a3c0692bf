"""Text columns: HTML paragraphs, cleaning, tokens and list parsing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from ..schema import STOP_WORDS
from . import entities
from .binding import let

HIDDEN_HTML = r"(?is)<!--.*?-->|<(script|style)(\s[^>]*)?>.*?</(script|style)\s*>"
PARAGRAPH_OPEN = r"(?i)<p(?:\s[^>]*)?>"
# A paragraph ends at its closing tag or where block content or the end of its container begins.
PARAGRAPH_BODY = (
    r"(?is)^(.*?)(?:</p\s*>|</?(?:address|article|aside|blockquote|body|center|dd|div|dl|dt|fieldset"
    r"|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|pre|section|table|td|th|tr|ul)(?:[\s/][^>]*)?>|\z)"
)
# The same two as they are run: all alternatives begin with one character, which is sought first.
_HIDDEN = r"(?is)<(?:!--.*?-->|(?:script|style)(?:\s[^>]*)?>.*?</(?:script|style)\s*>)"
_FROM_END = (
    r"(?is)<(?:/p\s*>|/?(?:address|article|aside|blockquote|body|center|dd|div|dl|dt|fieldset"
    r"|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|pre|section|table|td|th|tr|ul)(?:[\s/][^>]*)?>).*"
)
TOKEN = r"[\p{L}\p{N}_]{2,}"


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def inner_texts(html: Column) -> Column:
    """Pieces of an array with markup removed, references decoded (no-break spaces to spaces) and ends trimmed; the white
    space around inner tags stays."""
    bare = entities.unescape_all(F.transform(html, lambda piece: F.regexp_replace(piece, r"<[^>]*>", "")))
    return F.transform(bare, lambda t: strip(F.replace(t, F.lit("\u00a0"), F.lit(" "))))


def inner_text(html: Column) -> Column:
    return F.when(html.isNotNull(), inner_texts(F.array(html))[0])


def html_paragraphs(html: Column) -> Column:
    """All ``<p>`` texts of a page in order, closed or not, before any filter."""
    def bodies(pieces: Column) -> Column:
        opened = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
        return F.transform(opened, lambda piece: F.regexp_replace(piece, _FROM_END, ""))
    pieces = F.split(F.regexp_replace(html, _HIDDEN, ""), PARAGRAPH_OPEN)
    return let(let(pieces, bodies), inner_texts)


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def valid_paragraphs(paragraphs: Column) -> Column:
    """Lower-cased paragraphs without addresses, credits and single words; null when none is left."""
    kept = F.filter(
        F.transform(paragraphs, lambda p: F.lower(p)),
        lambda p: ~F.contains(p, F.lit("@"))
        & p.rlike(r"\S\s+\S")
        & ~F.contains(p, F.lit("credit:")),
    )
    return F.nullif(kept, F.array().cast("array<string>"))


def article_paragraphs(html: Column) -> Column:
    return valid_paragraphs(html_paragraphs(html))


def text_paragraphs(text: Column) -> Column:
    """Paragraphs of plain text, one per line."""
    return F.transform(F.split(text, "\n"), lambda line: strip(line))


def full_text(paragraphs: Column, sep: str = " ") -> Column:
    """Paragraphs as one text. ``sep=''`` glues the last and first words as old exports do."""
    return F.array_join(paragraphs, sep)


def paragraph_word_count(paragraphs: Column) -> Column:
    """Words over all paragraphs, filtered or not; null instead of zero."""
    total = F.aggregate(paragraphs, F.lit(0), lambda n, p: n + count_words(p))
    return F.nullif(total, F.lit(0))


def clean_text(text: Column) -> Column:
    """Lower case, everything but letters, digits and ``_`` as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Runs of two or more word characters, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def term_counts(words: Column) -> Column:
    """Distinct words of an array with how often they stand there, as structs (term, n), within the row: the words are
    sorted and the runs of equal ones measured."""
    def runs(ordered: Column) -> Column:
        size = F.size(ordered)
        at = F.transform(ordered, lambda w, i: F.when((i == 0) | (w != F.get(ordered, i - 1)), i))
        def measured(starts: Column) -> Column:
            ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(size))
            return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(ordered, a).alias("term"), (b - a).cast("long").alias("n")))
        found = let(F.filter(at, lambda i: i.isNotNull()), measured)
        none = F.when(ordered.isNotNull(), F.array().cast("array<struct<term:string,n:bigint>>"))
        return F.when(size > 0, found).otherwise(none)
    # the words are named once: a second mention outside the binding would make them again
    return let(F.sort_array(words), runs)


def without(words: Column, stop_words: Iterable[str]) -> Column:
    """Drop stop words from an array; the list is small, fixed and part of the plan."""
    stop = sorted(set(stop_words))
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def topic_tokens(text: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Topic-model tokens: punctuation and digits deleted (not spaced), stop words dropped."""
    bare = F.regexp_replace(F.lower(text), r"""[!-/:-@\[-`{-~0-9]""", "")
    return without(word_list(bare), stop_words)


def topic_list_tokens(paragraphs: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Token form for paragraph lists: purely alphabetic tokens only."""
    words = F.filter(word_list(F.lower(full_text(paragraphs))), lambda w: w.rlike(r"^\p{L}+$"))
    return without(words, stop_words)


def title_and_body(title: Column, paragraphs: Column) -> Column:
    """Title and paragraphs as one document; null when either is missing."""
    return F.when(title.isNotNull() & paragraphs.isNotNull(), F.concat_ws(" ", title, paragraphs))


def keyword_terms(literal: Column) -> Column:
    """Words of a keyword tag printed as ``[('word', 0.5), ...]``, scores dropped."""
    return F.regexp_extract_all(literal, F.lit(r"""\(\s*(?:'|")(.*?)(?:'|")\s*,\s*[^()]*(?:\([^()]*\))?\s*\)"""), F.lit(1))


def keyword_literal(keywords: Column) -> Column:
    """Keyword structs printed in the tag form."""
    pairs = F.transform(keywords, lambda k: F.concat(F.lit("('"), k["term"], F.lit("', "), k["score"].cast("string"), F.lit(")")))
    return F.concat(F.lit("["), F.array_join(pairs, ", "), F.lit("]"))


def parse_list(text: Column) -> Column:
    """A printed list as an array; text that is no list becomes its only element."""
    parsed = F.when(text.rlike(r"(?s)^\s*\[.*\]\s*$"), F.from_json(text, "array<string>"))
    return F.when(text.isNotNull(), F.coalesce(parsed, F.array(text)))


def cut(text: Column, limit: int = 512, keep: int = 511) -> Column:
    """Model input limit: texts above ``limit`` characters are cut to ``keep``."""
    return F.when(F.length(text) > limit, F.substring(text, 1, keep)).otherwise(text)
