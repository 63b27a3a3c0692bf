"""Licence scan: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

A text is lower-cased (A-Z) and taken as words of digits, Latin letters and everything beyond ASCII; the rules are
written over these words joined by one space, so line breaks, comment marks and punctuation never matter. One pass of an
Aho-Corasick automaton finds the keywords that a text holds, and only rules whose keyword is there are searched. A
detection is the run of words that a rule matches; it is suppressed where a detection of a stronger priority, or a longer
one of the same priority, covers all its words (of equal runs the earlier rule stays). Detections that only overlap both
stay. Base phrases are rules as well; all their places are listed, suppressed or not.

Cases: null and empty text is no words and no spans; texts of any length are searched whole; a null key is kept; repeated
rows give one row each; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .license_rules import CONFIDENCE, Rule, rules
from .words import texts_of

WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
SPAN = "label string, rule int, confidence double, base boolean, kept boolean, first_word long, last_word long"


def plain(text: bytes) -> bytes:
    """The words of a text, each between two spaces."""
    words = text.translate(WORD_BYTES).split()
    return b" " + b" ".join(words) + b" " if words else b""


def kept(found: Sequence[tuple[int, int, int, int]]) -> list[bool]:
    """Which of the (first, last, priority, rule) detections no other one suppresses.

    Within a priority a sweep by start and falling end knows the farthest end so far. Against the stronger ones, the
    farthest end of all that start no later is looked up.
    """
    order = sorted(range(len(found)), key=lambda i: (found[i][2], found[i][0], -found[i][1], found[i][3]))
    stay = [True] * len(found)
    stronger: list[tuple[list[int], list[int]]] = []  # per priority: starts, farthest end up to each
    starts, ends, level = [], [], None
    for i in order:
        first, last, priority, _ = found[i]
        if priority != level:
            if starts:
                stronger.append((starts, ends))
            starts, ends, level = [], [], priority
        covered = bool(ends) and ends[-1] >= last
        for s, e in stronger:
            at = bisect_right(s, first)
            covered = covered or (at > 0 and e[at - 1] >= last)
        stay[i] = not covered
        starts.append(first)
        ends.append(max(last, ends[-1]) if ends else last)
    return stay


class Scanner:
    """Compiled rules and the automaton of their keywords."""

    def __init__(self, table: Sequence[Rule]):
        import ahocorasick

        self.table = table
        self.patterns = [re.compile(rb"(?<= )(?:" + r.pattern.encode() + rb")(?= )", re.S) for r in table]
        gated: dict[str, list[int]] = {}
        for i, rule in enumerate(table):
            gated.setdefault(rule.keyword.encode().decode("latin-1"), []).append(i)
        self.keywords = ahocorasick.Automaton()
        for keyword, members in gated.items():
            self.keywords.add_word(keyword, members)
        self.keywords.make_automaton()

    def gate(self, text: bytes) -> list[int]:
        """Rules whose keyword stands in the text."""
        members = {id(m): m for _, m in self.keywords.iter(text.decode("latin-1"))}
        return sorted(i for m in members.values() for i in m)

    def spans(self, text: bytes, chosen: Sequence[int] | None = None) -> list[dict]:
        """All detections in a ``plain`` text, in order of rule and place."""
        chosen = self.gate(text) if chosen is None else chosen
        hits = [(m.start(), m.end(), i) for i in chosen for m in self.patterns[i].finditer(text)]
        if not hits:
            return []
        blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        first = (np.searchsorted(blanks, [h[0] for h in hits]) - 1).tolist()
        last = (np.searchsorted(blanks, [h[1] for h in hits]) - 1).tolist()
        stay = kept([(a, b, self.table[i].priority, i) for a, b, (_, _, i) in zip(first, last, hits)])
        return [{"label": (r := self.table[i]).label, "rule": i, "confidence": CONFIDENCE[r.priority], "base": r.base, "kept": k,
                 "first_word": a, "last_word": b} for a, b, k, (_, _, i) in zip(first, last, stay, hits)]


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def _scanner(table: tuple[Rule, ...]) -> Scanner:
    """Compiled once per Python worker."""
    if table not in _scanners:
        _scanners[table] = Scanner(table)
    return _scanners[table]


def scan(docs: DataFrame, table: Sequence[Rule] | None = None, key: str = "doc_id", content: str = "text") -> DataFrame:
    """(key, n_words, spans) per row of ``docs``; a span is a detection with its rule's number and its first and last word."""
    chosen = tuple(rules() if table is None else table)
    rows = docs.select(F.col(key).alias("_key"), F.col(content).alias("_text"))
    out = T.StructType([T.StructField("_key", docs.schema[key].dataType), T.StructField("n_words", T.LongType()),
                        T.StructField("spans", T.ArrayType(T.StructType.fromDDL(SPAN)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(chosen)
        kind = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.int32()), ("confidence", pa.float64()), ("base", pa.bool_()),
                                   ("kept", pa.bool_()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
        for batch in batches:
            numbers, found = [], []
            for text in texts_of(batch.column("_text")):
                text = plain(text)
                numbers.append(max(0, text.count(b" ") - 1))
                found.append(scanner.spans(text))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(numbers, pa.int64()), pa.array(found, kind)], names=out.names)

    return rows.mapInArrow(run, out).withColumnRenamed("_key", key)


def _joined(spans: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, labels and score of scanned rows: base labels always, other labels where not suppressed."""
    base = F.filter("spans", lambda s: s["base"])
    shown = F.filter("spans", lambda s: s["base"] | s["kept"])
    firsts = F.transform(base, lambda s: s["first_word"])
    return found.select(
        key, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"), _joined(base).alias("base_labels"), _joined(shown).alias("labels"),
        F.coalesce(F.array_max(F.transform(shown, lambda s: s["confidence"])), F.lit(0.0)).alias("score"),
        F.size(F.filter("spans", lambda s: s["kept"])).cast("long").alias("n_kept"))
