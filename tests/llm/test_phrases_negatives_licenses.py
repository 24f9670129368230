"""Phrase collocations, hard negatives and license scans against brute force on small fixtures."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pullwise.llm import collocations, hard_negatives, license_scan
from pullwise.llm.license_rules import KINDS, rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None) for i, (t, lang) in enumerate(rows)], SCHEMA)


# ---- 12 ----

def phrases(rows, least, most=3, covered=50, top=2000):
    counts = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for k in range(1, most + 1):
                for i in range(len(ws) - k + 1):
                    counts[lang if lang is not None else "und"][tuple(ws[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in candidates.items():
            if any(len(h) > len(g) and 100 * b >= covered * a and any(h[i:i + len(g)] == g for i in range(len(h))) for h, b in candidates.items()):
                continue
            score, k = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def prose(rng, n, size):
    marks = ["", "", "", "", ".", ",", "\n", ";", "!"]
    return " ".join(f"{rng.choice(['W', 'w', 'é'])}{int(size * rng.random() ** 3)}{rng.choice(marks)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    rows = [(prose(rng, rng.choice([3, 60, 400]), 25), rng.choice(["en", "en", "en", "fr", None, "und"])) for _ in range(60)]
    rows += [(None, "en"), ("", "en"), (" \t\n.,", "en"), ("one", None), ("a b " * 400, "de"), ("x" * 3000 + " y z", "de"), (rows[0][0], "en"), (rows[0][0], "en")]
    return rows + [("of the " + " of the ".join(f"n{i}" for i in range(800)), "en")]             # one pair before very many words


def test_phrases_agree_with_brute_force(spark, texts):
    got = collocations.collocations(frame(spark, texts))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == phrases(texts, 10)


def test_small_groups_split_prefixes_and_give_partial_totals(spark, texts, monkeypatch):
    monkeypatch.setattr(collocations, "SHARE", 8)               # pairs become prefixes early
    got = collocations.collocations(frame(spark, texts), budget=50)
    assert sorted(map(tuple, got.collect())) == phrases(texts, 10)


def test_other_lengths_and_thresholds(spark, texts):
    for most, least, covered, top in ((2, 3, 50, 10 ** 6), (4, 5, 80, 7)):
        got = collocations.collocations(frame(spark, texts), top=top, max_words=most, min_count=least, covered=covered, budget=200)
        assert sorted(map(tuple, got.collect())) == phrases(texts, least, most, covered, top or 10 ** 9)


def test_words_that_share_a_hash_are_counted_again(spark, monkeypatch):
    data = [("aa bb. aa bb. cc dd. cc dd. cc dd.", "en")] * 4

    def crowded(part):
        hashes, starts = hash_run(part)
        return hashes & np.uint64(1), starts
    hash_run = collocations._hash_run
    assert len(set((collocations.tokens(["aa bb cc dd"])[1] & np.uint64(1)).tolist())) == 2
    monkeypatch.setattr(collocations, "_hash_run", crowded)
    # in workers the patch doesn't hold, so the loop is tried on the other hash alone
    _, fast, starts, _ = collocations.tokens(["aa bb cc dd aa"])
    _, slow, starts2, _ = collocations.tokens(["aa bb cc dd aa"], 1)
    assert len(set(fast.tolist())) <= 2 and len(set(slow.tolist())) == 4 and slow[0] == slow[4] and (starts == starts2).all()
    assert collocations.tokens(["aa"], 1)[1][0] != collocations.tokens(["aa"], 2)[1][0]
    monkeypatch.undo()
    found, how = collocations._vocabulary_of(frame(spark, data).select("lang", "text"))
    assert how == 0 and {r["word"]: r["n"] for r in found.filter("second is null").collect()} == {"aa": 8, "bb": 8, "cc": 12, "dd": 12}


def test_large_counts_are_scored_exactly(spark):
    big = spark.createDataFrame([(10 ** 12 + 7, 10 ** 12 + 9, 10 ** 12 + 11)], "a long, l long, r long")
    row = big.select(*[collocations._exact(c).alias(f"_{c}") for c in "alr"]).selectExpr("(_a * _a * 1000000bd) div (_l * _r) as s").first()
    assert row.s == 1000000 * (10 ** 12 + 7) ** 2 // ((10 ** 12 + 9) * (10 ** 12 + 11))


def test_empty_tables_and_clashing_columns(spark, texts):
    assert collocations.collocations(frame(spark, texts).limit(0)).count() == 0
    more = frame(spark, texts[:20]).withColumns({c: F.lit(1) for c in ("first", "words", "n", "a", "word", "rank", "score", "phrase")})
    assert sorted(map(tuple, collocations.collocations(more).collect())) == phrases(texts[:20], 10)


def test_a_long_text_is_read_in_runs(monkeypatch):
    text = "Ab cd, " * 3000
    whole = collocations.tokens([text])
    monkeypatch.setattr(collocations, "RUN", 100)
    parts = collocations.tokens([text])
    assert all((a == b).all() for a, b in zip(whole, parts)) and len(whole[1]) == 6000 and whole[3][-1] > whole[3][0]


# ---- 11 ----

VECTORS = "vec_id long, embedding array<float>, label int, no string, rank int, w int"


def negatives(rows, every=50, positives=5, k=3):
    kept = [(v, lab, [math.floor(256 * float(np.float32(x))) for x in e]) for v, e, lab in rows
            if v is not None and lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, (v, lab, x) in enumerate(kept):
        if v % every:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), u, m) for j, (u, m, y) in enumerate(kept) if j != i]
        for p, u, _ in sorted(s for s in scored if s[2] == lab)[:positives]:
            window = sorted(s for s in scored if s[2] != lab and 50 * -p <= 100 * -s[0] <= 95 * -p)[:k]
            out += [(v, u, r + 1, n, -p, -s) for r, (s, n, _) in enumerate(window)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(v, e, lab, "x", 1, 2) for v, e, lab in rows], VECTORS)


def made(seed, n, d, spread, labels=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(labels, d)) * spread
    return [(int(i), [float(x) for x in rng.normal(size=d) * 0.3 + centre[i % labels] * (rng.random() < 0.7)], int(i % labels)) for i in range(n)]


@pytest.mark.parametrize("n, d, spread, every", [(300, 8, 0.5, 10), (500, 40, 0.2, 50), (400, 70, 0.0, 20), (200, 3, 2.0, 7)])
def test_negatives_agree_with_brute_force(spark, n, d, spread, every):
    rows = made(n, n, d, spread)
    got = hard_negatives.hard_negatives(hard_negatives.quantised(vectors(spark, rows)), F.col("vec_id") % every == 0)
    assert sorted(map(tuple, got.collect())) == negatives(rows, every)


def test_odd_rows_ties_and_repeats(spark):
    rows = made(1, 120, 6, 0.4)
    same = [0.5] * 6
    rows += [(1000 + i, same, i % 2) for i in range(40)]                                        # ties
    rows += [rows[0], rows[0], rows[50], (None, same, 1), (200, None, 1), (250, same, None), (300, [0.1, None] * 3, 1), (350, [float("nan")] * 6, 1),
             (400, [float("inf")] * 6, 1), (450, [0.0] * 6, 0), (2000, [0.5, 0.25], 0), (2050, [], 1), (2100, [-0.5] * 6, 9)]
    got = hard_negatives.hard_negatives(hard_negatives.quantised(vectors(spark, rows)), F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == negatives(rows)


def test_scores_beyond_doubles(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in (rng.random(4) * 2 ** 20)], i % 2) for i in range(60)]
    got = hard_negatives.hard_negatives(hard_negatives.quantised(vectors(spark, rows)), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == negatives(rows, 10)


def test_no_rows_and_no_anchors(spark):
    rows = vectors(spark, made(1, 30, 4, 0.5))
    for some in (rows.limit(0), rows.filter("vec_id % 50 != 0"), rows.filter("vec_id = 0"), rows.filter("label = 0")):
        assert hard_negatives.hard_negatives(hard_negatives.quantised(some), F.col("vec_id") % 50 == 0).count() == 0


def test_the_index_leaves_out_light_dimensions():
    rng = np.random.default_rng(0)
    y = np.floor(rng.normal(size=(4000, 64)) * 256 * 0.8 ** np.arange(64)).astype(np.int64)
    x = y[:8].copy()
    low = (np.sqrt((x.astype(float) ** 2).sum(axis=1)) * np.sqrt((y.astype(float) ** 2).sum(axis=1)).max() * 0.5).astype(np.int64)
    q = hard_negatives._Queries([(np.arange(8), np.zeros(8, dtype=np.int64), [[{"w": 0, "low": int(t), "high": hard_negatives.MOST}] for t in low], x)], 3, True, 64)
    edges = [0, 16, 32, 48, 64]
    tails = hard_negatives._tail_norms(y, edges)
    listed = (tails[:, :-1] * hard_negatives._tail_norms(x, edges).max(axis=0)[:-1] >= low.min()).sum(axis=1)
    assert listed.max() <= 2 and (listed == 0).any()
    q.meet(np.arange(100, 4100), np.arange(4000), np.zeros(4000, dtype=np.int64), y)
    i, _, score, ids = q.best
    for a in range(8):
        want = sorted((-int(s), j) for j, s in enumerate(y @ x[a]) if s >= low[a])[:3]
        assert [(-s, v) for s, v in zip(score[i == a].tolist(), ids[i == a].tolist())] == want


# ---- 13 ----

LICENSES = [None, "", " .,;", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "see Under the MIT  License, under the\nmit-license",
            "Licensed under CC BY-NC-SA 4.0", "SPDX-License-Identifier: GPL-2.0-or-later", "All rights reserved. Alle Rechte vorbehalten.", "the mit licensed",
            "GNU Lesser General Public License v2.1 and the GNU General Public License", "https://www.apache.org/licenses/LICENSE-2.0.html",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "über CC BY-NC café", "cc by nc cc by nc",
            "word " * 20000 + "released under the BSD 3-Clause License", "This is released to the public domain (CC0 1.0).", "common public good of software"]


def brute(text):
    """Every rule on every text, and all pairs of detections compared."""
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    base = [(i, label) for i in range(len(ws)) for phrase, label in license_scan.BASE if ws[i:i + len(phrase.split())] == phrase.split()]
    line, found = (" " + " ".join(ws) + " ").encode(), []
    for r, rule in enumerate(rules()):
        for m in rule.pattern.finditer(line):
            start = line[:m.start()].count(b" ") - 1
            found.append((list(KINDS).index(rule.kind), start, start + m.group().count(b" ") + 1, r, rule))
    kept = [d for d in found if not any(e is not d and e[1] <= d[1] and d[2] <= e[2] and (
        e[0] < d[0] or (e[0] == d[0] and (e[2] - e[1] > d[2] - d[1] or e[3] < d[3]))) for e in found)]
    labels = {label for _, label in base} | {d[4].label for d in kept}
    return (len(ws), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None), ",".join(sorted({x for _, x in base})),
            ",".join(sorted(labels)), max([d[4].confidence for d in kept] + [license_scan.BASE_CONFIDENCE] * bool(base), default=0.0))


def test_licenses_agree_with_brute_force(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan.summary(license_scan.licenses(frame(spark, [(t, "en") for t in LICENSES]))).collect()}
    assert got == {i: brute(t) for i, t in enumerate(LICENSES)}
    assert [got[i][5] for i in (3, 4, 5, 6, 7, 8)] == ["cc-by-nc", "apache-2", "mit", "cc-by-nc,cc-by-nc-sa", "gpl-2", "all-rights-reserved"]
    assert got[15][5] == "bsd-3" and got[1] == (0, 0, None, None, "", "", 0.0)


def test_every_rule_can_fire_through_its_keywords():
    scanner = license_scan.Scanner(rules())
    assert len(scanner.rules) > 300
    from pullwise.llm.license_rules import FAMILIES
    for label, name, keywords, url, ident in FAMILIES:
        plain = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", name.split("|")[0] if "(" not in name.split("|")[0] else name)
        assert any(k.encode() in scanner.by_keyword for k in keywords.split()), label
        assert plain
        if not re.search(r"[(\[?]", ident):
            _, _, found = scanner.scan(f"SPDX-License-Identifier: {ident}")
            assert [scanner.rules[r].label for _, _, r in found] == [label]
        if url and not re.search(r"[(\[?]", url):
            _, _, found = scanner.scan(f"see https://{url} for it")
            assert label in [scanner.rules[r].label for _, _, r in found]


def test_licenses_of_odd_tables(spark):
    docs = frame(spark, [("All rights reserved", "en")] * 3)
    assert license_scan.licenses(docs.limit(0)).count() == 0
    more = docs.withColumns({c: F.lit("x") for c in ("base", "spans", "n_words", "labels", "score")})
    assert [r["labels"] for r in license_scan.summary(license_scan.licenses(more)).collect()] == ["all-rights-reserved"] * 3


def test_suppression_matches_pairwise_comparison():
    rng = random.Random(2)
    for _ in range(300):
        found = sorted({(s := rng.randrange(30), s + rng.randrange(1, 8), rng.randrange(6)) for _ in range(rng.randrange(1, 25))})
        classes = [0, 0, 1, 1, 2, 2]
        kept = [d for d in found if not any(e != d and e[0] <= d[0] and d[1] <= e[1] and (
            classes[e[2]] < classes[d[2]] or (classes[e[2]] == classes[d[2]] and (e[1] - e[0] > d[1] - d[0] or e[2] < d[2]))) for e in found)]
        assert sorted(license_scan.surviving(found, classes)) == kept
