"""The pipeline's stages, one after another, against brute force on a small corpus."""

import collections
import hashlib
import random

import corpus_pipeline
from tests.llm.test_core import SCHEMA, brute_components, brute_runs, prose, repeats, shingles, water_filling, words

MORE = SCHEMA + ", _position int, _epoch int, _gone string, `a b` int"


def corpus():
    rng = random.Random(11)
    line = lambda: " ".join(prose(rng, rng.randrange(6, 14), 5000))
    text = lambda n: "\n".join(line() for _ in range(n))
    passage = "\n".join(line() for _ in range(8))
    rows = [(text(rng.randrange(8, 25)), rng.choice(["a", "b", None])) for _ in range(60)]
    rows += [(text(4) + "\n" + passage + "\n" + text(5), "b") for _ in range(5)]
    rows += [(rows[3][0], "a"), (rows[4][0] + " and more", "b"), (rows[4][0] + " and still more", "a"), (rows[4][0].replace("w1", "W1", 1), "b")]
    rows += [(text(20).replace(" ", "#$ "), "junk") for _ in range(40)] + [("too short", "a"), ("x y z " * 60, "a"), (None, "a"), ("", None), (" \n ", "b")]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, rows[k][0], "en", rows[k][1], len(rows[k][0]) if rows[k][0] is not None else None, 1, 2, "x", 3) for i, k in enumerate(order)]


def test_stages_agree_with_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, MORE)
    stages = dict(corpus_pipeline.STAGES)
    text = {r[0]: r[1] for r in rows}
    source = {r[0]: r[3] for r in rows}

    kept = stages["quality"](spark, docs, "")
    want = {i for i, t in text.items() if source[i] != "junk" and len(words(t)) >= 50 and 100 * repeats(words(t)) <= 50 * len(words(t))}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want and len(want) > 60

    lined = stages["lines"](spark, kept, "")
    gone = brute_runs({i: text[i] for i in sorted(want)}, 50)
    left = {i: "\n".join(x for j, x in enumerate(text[i].split("\n")) if j not in gone[i]) for i in want}
    left = {i: t for i, t in left.items() if words(t)}
    assert {r.doc_id: r.text for r in lined.collect()} == left and sum(map(bool, gone.values())) >= 6 and lined.columns == docs.columns

    single = stages["near_duplicates"](spark, lined, "")
    ids = sorted(left)
    of = brute_components([shingles(left[i]) for i in ids])
    alone = {ids[k]: left[ids[k]] for k in range(len(ids)) if of[k] == k}
    assert {r.doc_id: r.text for r in single.collect()} == alone and single.columns == docs.columns

    mixed = stages["mixture"](spark, single, "")
    size = {i: len(words(t)) for i, t in alone.items()}
    by = collections.Counter()
    for i in alone:
        by[source[i]] += size[i]
    order = sorted(by, key=lambda s: (s is None, s))
    target = water_filling(by, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(by.values()))
    copies = collections.Counter()
    for s in order:
        at = 0
        for _ in range(2):
            for i in sorted((i for i in alone if source[i] == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
                copies[i] += 2 * at + size[i] <= 2 * round(target[s])
                at += size[i]
    out = mixed.collect()
    assert mixed.columns == docs.columns and collections.Counter(r.doc_id for r in out) == +copies and all(r.text == alone[r.doc_id] for r in out)

    packed = stages["packed"](spark, mixed, "").collect()
    pieces = collections.defaultdict(list)
    for r in packed:
        pieces[r.sequence_id].append((r.offset, r.length))
    for p in pieces.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 2048
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == +copies


def test_run_applies_the_stages_to_the_table(spark, tmp_path):
    docs = spark.createDataFrame([r[:5] for r in corpus()], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 60 and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
