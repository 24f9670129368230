"""License notices in texts: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

A text is folded to lower-case words with one space between them. A rule is tried only where one of its keywords is among the text's
words, so most texts cost a few look-ups. Its matches are intervals of words. Rules come in classes; a detection goes when its interval
lies within that of one of an earlier class, or within a longer one (or, if equal, one of an earlier rule) of its own class. So
`licensed under cc by nc sa 4.0` is one detection and not also a CC BY one. Fixed base phrases are counted at all their places and
are never suppressed.

Odd cases: null texts are empty and have no words; repeated rows are scanned each; an empty table gives an empty result; very long texts
are read whole, as one text in memory; detections with equal intervals and rules can't occur twice; further columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pullwise.llm.license_rules import KINDS, Rule, rules

# fixed values: base phrases and their labels, and how sure one is
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
BASE_CONFIDENCE = 0.95
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

SPANS = "array<struct<start:bigint,end:bigint,label:string,kind:string,confidence:double>>"
FOUND = f"doc_id long, n_words long, base {SPANS}, spans {SPANS}"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def surviving(found: list[tuple[int, int, int]], classes: list[int]) -> list[tuple[int, int, int]]:
    """The intervals (start, end, rule) that no earlier or longer one contains; classes: each rule's class."""
    kept: list[tuple[int, int, int]] = []
    by_class: dict[int, list[tuple[int, int, int]]] = {}
    for s, e, r in found:
        by_class.setdefault(classes[r], []).append((s, e, r))
    starts = reach = None
    for c in sorted(by_class):
        own, far = [], -1
        for s, e, r in sorted(by_class[c], key=lambda d: (d[0], -d[1], d[2])):
            if e <= far:                                            # within one of its class that starts no later
                continue
            far = e
            at = int(np.searchsorted(starts, s, side="right")) - 1 if starts is not None else -1
            if at < 0 or reach[at] < e:
                own.append((s, e, r))
        kept = sorted(kept + own)
        if kept:
            starts, reach = np.array([s for s, _, _ in kept]), np.maximum.accumulate(np.array([e for _, e, _ in kept]))
    return kept


class Scanner:
    def __init__(self, ordered: list[Rule]) -> None:
        self.rules = ordered
        order = list(KINDS)
        self.classes = [order.index(r.kind) for r in ordered]
        self.by_keyword: dict[bytes, list[int]] = {}
        for i, r in enumerate(ordered):
            for k in r.keywords:
                self.by_keyword.setdefault(k, []).append(i)

    def scan(self, text: str | None):
        """(number of words, base places, surviving detections)."""
        words = words_of(text)
        line, seen = b" " + b" ".join(words) + b" ", set(words)
        base, found = [], []
        for n, (phrase, _) in enumerate(BASE):
            needle, at = f" {phrase} ".encode(), -1
            while (at := line.find(needle, at + 1)) >= 0:
                base.append((at + 1, at + len(needle) - 1, n))
        tried = sorted({i for k in self.by_keyword.keys() & seen for i in self.by_keyword[k]})
        for i in tried:
            r = self.rules[i]
            if not r.also or r.also & seen:
                found += [(m.start(), m.end(), i) for m in r.pattern.finditer(line)]
        if not base and not found:
            return len(words), [], []
        spaces = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)

        def placed(spans):
            s, e = (np.searchsorted(spaces, [x[k] for x in spans]) for k in (0, 1))
            return [(a - 1, b, x[2]) for a, b, x in zip(s.tolist(), e.tolist(), spans)]

        return len(words), sorted(placed(base)) if base else [], surviving(placed(found), self.classes) if found else []


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(rules())
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("kind", pa.string()), ("confidence", pa.float64())]))
    for b in batches:
        n, base, spans = [], [], []
        for text in b.column(1):
            count, places, found = scanner.scan(text.as_py())
            n.append(count)
            base.append([(s, e, BASE[r][1], "base", BASE_CONFIDENCE) for s, e, r in places])
            spans.append([(s, e, scanner.rules[r].label, scanner.rules[r].kind, scanner.rules[r].confidence) for s, e, r in found])
        rows = [pa.array([[dict(zip(("start", "end", "label", "kind", "confidence"), s)) for s in x] for x in y], span) for y in (base, spans)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *rows], ["doc_id", "n_words", "base", "spans"])


def licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, base, spans): the base phrases' places and the detections that survive, in words from 0, end exclusive."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scan, FOUND)


def summary(found: DataFrame) -> DataFrame:
    """A row per document: words, base places, and labels. score: the highest confidence of a detection or base place, 0 without any."""
    def labels(*columns: str):
        return F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(c, lambda s: s["label"]) for c in columns]))), ",")

    starts = F.transform("base", lambda s: s["start"])
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        labels("base").alias("base_labels"), labels("base", "spans").alias("labels"),
                        F.coalesce(F.array_max(F.transform(F.concat("base", "spans"), lambda s: s["confidence"])), F.lit(0.0)).alias("score"))
