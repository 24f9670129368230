"""The pipeline's operators against brute force on small fixtures."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from pullwise.llm import host_quality, jaccard, line_dedup, mixing, packing
from pullwise.llm.graph import components

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", (sources[i] if sources else f"s{i % 3}"), len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


ODD = [None, "", "   \n\t ", "one", "one two three", "Straße ünï 日本語  x", "a" * 70000, "x " * 30000, "same line\n" * 500]


# ---- 9 ----

def repeats(ws):
    at = collections.defaultdict(list)
    for i in range(len(ws) - 2):
        at[tuple(ws[i:i + 3])].append(i)
    return len({j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)})


def test_quality_signals(spark):
    rng = random.Random(1)
    texts = ODD + [" ".join(prose(rng, rng.randrange(0, 200), 12)) for _ in range(40)] + ["a b c d\nx\n\nx\nx y\n#*$ %&|<>"]
    got = {r.doc_id: r for r in host_quality.judge(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ws, t = words(t), t or ""
        lines = [x for x in t.split("\n") if words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(ws), sum(map(len, ws)), sum(t.count(c) for c in "#*$%&|<>"))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == repeats(ws), i
        assert r.base_failed == (len(ws) < 50 or 100 * repeats(ws) > 50 * len(ws))
        assert not (r.kept and r.base_failed)


def test_a_bad_host_goes_and_a_small_one_is_not_condemned(spark):
    rng = random.Random(2)
    good = lambda: " ".join(prose(rng, 80, 4000))
    bad = lambda: " ".join(w + "#$" for w in prose(rng, 80, 4000))
    texts = [good() for _ in range(120)] + [bad() for _ in range(59)] + [good()] + [bad()]
    sources = ["a"] * 60 + ["b"] * 60 + ["junk"] * 60 + ["small"]
    got = {r.doc_id: r for r in host_quality.judge(frame(spark, texts, sources)).collect()}
    assert all(got[i].kept for i in range(120))
    assert not any(got[i].kept for i in range(120, 180)) and got[179].host_rejected and not got[179].base_failed
    kept = host_quality.keep_documents(frame(spark, texts, sources))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


# ---- 2 ----

def brute_runs(docs, least):
    """Lines to delete: those in a run of least words or more that stands at an earlier place too."""
    lines = {k: [(i, x) for i, x in enumerate(t.split("\n")) if words(x)] for k, t in docs.items() if t}
    seen, gone = {}, collections.defaultdict(set)
    spans = []
    for k, ls in lines.items():
        for a in range(len(ls)):
            n = 0
            for b in range(a, len(ls)):
                n += len(words(ls[b][1]))
                if n >= least:
                    spans.append(((k, ls[a][0]), tuple(x for _, x in ls[a:b + 1]), ls[b][0]))
                    if n >= 3 * least:
                        break
    for place, content, last in sorted(spans):
        if content in seen and seen[content] < place:
            gone[place[0]].update(range(place[1], last + 1))
        seen.setdefault(content, place)
    return gone


def test_line_dedup(spark):
    rng = random.Random(3)
    pool = [" ".join(prose(rng, rng.choice([1, 3, 8, 12]))) for _ in range(60)]
    passage = [" ".join(prose(rng, 9)) for _ in range(4)]
    texts = list(ODD)
    for _ in range(40):
        ls = [rng.choice(pool) for _ in range(rng.randrange(1, 12))]
        if rng.random() < 0.5:
            k = rng.randrange(len(ls) + 1)
            ls[k:k] = passage
        if rng.random() < 0.3:
            ls.insert(0, "")
        texts.append("\n".join(ls))
    texts += [texts[20], texts[21] + "\nand one more"]
    docs = frame(spark, texts)
    gone = brute_runs(dict(enumerate(texts)), 20)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs, 20).collect()}
    assert len(got) == len(texts) and sum(map(bool, gone.values())) > 10
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].text is None
            continue
        assert got[i].text == "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[i]), i
        assert got[i].n_chars == len(got[i].text)
    dropped = {r.doc_id for r in line_dedup.dedup_lines(docs, 20, drop_emptied=True).collect()}
    assert len(texts) - 2 not in dropped and len(texts) - 1 in dropped


# ---- 7 ----

def shingles(t, k=5):
    ws = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


def brute_components(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(i) for i in range(len(sets))]


def copies(rng, n_base, most):
    out = []
    for _ in range(n_base):
        base = prose(rng, rng.choice([3, 6, 9, 14, 30, 60, 150, 400]), 3000)
        out.append(" ".join(base))
        for _ in range(rng.randrange(most)):
            w = list(out[-1].split()) if rng.random() < 0.5 else list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 25))):
                k = rng.randrange(len(w))
                w[k:k + 1] = rng.choice([[], [f"e{rng.randrange(99)}"], [w[k].upper(), "in"]])
            out.append(" ".join(w))
    return out


def test_jaccard_components(spark):
    rng = random.Random(4)
    texts = ODD + copies(rng, 40, 8) + ["one two THREE", "x " * 29990]
    want = brute_components([shingles(t) for t in texts])
    got = {r.doc_id: r for r in jaccard.component_ids(jaccard.near_duplicates(frame(spark, texts).repartition(5))).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(shingles(t)) for t in texts]
    assert [got[i].component_id for i in range(len(texts))] == want
    kept = jaccard.keep_one(frame(spark, texts))
    assert {r.doc_id for r in kept.collect()} == {i for i, c in enumerate(want) if c == i}


@pytest.mark.parametrize("size", [1, 2, 4, 5, 6, 7, 8, 9, 11, 14, 17, 23, 31, 45, 60, 100, 170, 333])
def test_signatures_meet_at_the_threshold(size):
    """Pairs that just link share a signature, whatever the scheme and level."""
    rng = np.random.default_rng(size)
    for trial in range(120):
        smaller = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        most = size * 5 // 4
        other = int(rng.integers(size, most + 1))
        both = -(-4 * (size + other) // 9)
        if both > size:
            continue
        larger = np.concatenate([smaller[:both], rng.integers(0, 1 << 63, other - both, dtype=np.uint64)])
        a, b = (jaccard.signatures(np.unique(x)) for x in (smaller, larger))
        assert len(np.intersect1d(a, b)), (size, other, trial)


def test_sets_of_any_size_have_a_scheme():
    for size in (4281007, 4281008, 5500000, 90000000):
        i = jaccard.scheme(size)
        assert jaccard._TOPS[i - 1] < size <= jaccard._TOPS[i] < jaccard._TOPS[i + 1]
    assert jaccard._TOPS == jaccard.bands(jaccard._TOPS[-2])
    rng = np.random.default_rng(1)
    items = np.unique(rng.integers(0, 1 << 64, 4400000, dtype=np.uint64))
    assert len(np.intersect1d(jaccard.signatures(items), jaccard.signatures(items[450000:])))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (100, 60), (61, 60)] + [(7, 7)]
    got = {r.v: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 50 for i in (50, 60, 61, 100))


# ---- 5 ----

def water_filling(sizes, weights, total):
    target, free, left = {}, dict(weights), total
    while free:
        level = left / sum(free.values())
        over = [k for k in free if free[k] * level > 2 * sizes[k]]
        if not over:
            return target | {k: w * level for k, w in free.items()}
        for k in over:
            target[k] = 2 * sizes[k]
            left -= target[k]
            del free[k]
    return target


def test_mixing_targets(spark):
    rng = random.Random(5)
    texts = ODD + [" ".join(prose(rng, rng.randrange(1, 300))) for _ in range(150)]
    sources = [rng.choice(["b", "a", None, "Z", "é", "zz", "日"]) for _ in texts]
    sources[10:14] = ["tiny"] * 4
    rows = mixing.taken_words(frame(spark, texts, sources)).collect()
    assert rows_of(rows) == rows_of(mixing.taken_words(frame(spark, texts, sources).repartition(3)).collect())
    by, taken = collections.Counter(), collections.Counter()
    for r in rows:
        assert r.size == len(words(texts[r.doc_id])) and 0 <= r.taken <= 2 * r.size
        by[sources[r.doc_id]] += r.size
        taken[sources[r.doc_id]] += r.taken
    order = sorted(by, key=lambda s: (s is None, s))
    want = water_filling(by, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(by.values()))
    for r in rows:
        s = sources[r.doc_id]
        assert r.source_size == by[s] and r.target == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 1 + max(q.size for q in rows if sources[q.doc_id] == s) / 2 and r.taken % max(r.size, 1) == 0


def rows_of(rows):
    return sorted((r.doc_id, r.taken, r.first_position if r.first_position is not None else -1) for r in rows)


def test_mixture_is_in_training_order_and_whole(spark):
    rng = random.Random(6)
    texts = [" ".join(prose(rng, rng.randrange(1, 90))) for _ in range(90)]
    out = mixing.mix(frame(spark, texts)).collect()
    assert [r._position for r in out] == sorted(r._position for r in out)
    taken = {r.doc_id: r.taken for r in mixing.taken_words(frame(spark, texts)).collect()}
    got = collections.Counter()
    for r in out:
        got[r.doc_id] += len(words(r.text))
        assert texts[r.doc_id] == r.text and r.n_chars == len(r.text)
    assert got == +collections.Counter(taken)


# ---- 4 ----

def test_plan_covers_every_piece_once():
    rng = random.Random(7)
    for top, n in ((64, 3000), (2048, 5000), (2048, 1)):
        counts = collections.Counter(rng.choice([rng.randrange(1, top + 1), rng.randrange(1, top // 6 + 2)]) for _ in range(n))
        runs, sequences = packing.plan(dict(counts), top, 12)
        held, ranks = collections.defaultdict(list), collections.Counter()
        for length, rank, many, first, offset in sorted(runs.tolist()):
            assert rank == ranks[length]
            ranks[length] += many
            for k in range(many):
                held[first + k].append((offset, length))
        assert ranks == counts and len(held) == sequences
        for places in held.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= top
        least = -(-sum(k * v for k, v in counts.items()) // top)
        assert sequences <= least * 1.03 + 3


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(8)
    texts = ODD + ["<|endoftext|> in a text", " lead", "trail ", "a  b", "it's\n\n x \n y", "a\t b", "  x y 12 34's", "𝔘𝔫 ‍👩"]
    texts += ["".join(rng.choice([" ", "  ", "\n", "a", "é", "1", "'s", ".", "日", "\t", "　", "Zx"]) for _ in range(60)) for _ in range(300)]
    rows = packing.pack(frame(spark, texts)).collect()
    digest = {(r.doc_id, r.piece): r for r in packing.place(packing.pieces(frame(spark, texts))).collect()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        assert digest[r.doc_id, r.piece].ids_crc32 == zlib.crc32(bytes(r.ids))
    for i, t in enumerate(texts):
        parts = sorted(by[i], key=lambda r: r.piece)
        ids = np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in parts]).tolist()
        assert ids == exact.encode(t or "", add_special_tokens=False).ids + [0], t
        assert [r.start for r in parts] == np.cumsum([0] + [r.length for r in parts])[:-1].tolist()
        assert all(r.length == 2048 for r in parts[1:])
    places = collections.defaultdict(list)
    for r in digest.values():
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        ends = np.cumsum([n for _, n in sorted(p)])
        assert [o for o, _ in sorted(p)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_spaces_within_runs_of_white_space():
    import public_tokenizers
    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    cache = packing.WordCache("byte_bpe_50k")
    rng = random.Random(10)
    whites = [chr(c) for c in (*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    texts = ["a \xa0 \xa0 b", "\xa0 ", "a\n \n b", "a \xa0b", "\xa0 \xa0 "]
    texts += ["".join(rng.choice([" ", " ", " ", "\xa0", "\xa0", "a", "é1", "'s", rng.choice(whites)]) for _ in range(12)) for _ in range(5000)]
    for t in texts:
        assert np.frombuffer(cache.encode(t), "<u4").tolist() == exact.encode(t, add_special_tokens=False).ids, ascii(t)
    assert np.frombuffer(cache.encode(texts[0]), "<u4").tolist() == [64, 11504, 275]


# ---- all ----

def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", size long, n_words long, class string, at int, runs int")
    for f in (host_quality.judge, host_quality.keep_documents, line_dedup.dedup_lines, jaccard.keep_one, mixing.mix, mixing.taken_words,
              packing.pack, lambda d: packing.place(packing.pieces(d)), lambda d: jaccard.component_ids(jaccard.near_duplicates(d))):
        assert f(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c", None, None, None, 1, 2, "c", 3, 4)] * 3 + [(1, None, "en", "s", 3, 1, 2, "c", 3, 4)] * 2,
                                empty.schema)
    for f in (host_quality.judge, line_dedup.dedup_lines, jaccard.keep_one, mixing.taken_words, packing.pack):
        assert f(odd).count() == 5, f


def test_word_hashes_do_not_depend_on_runs():
    from pullwise.llm.common import word_hashes
    rng = random.Random(9)
    texts = ODD + ["".join(rng.choice("ab \n\té日") for _ in range(rng.randrange(400))) for _ in range(60)] + ["x" * 9000 + " y"]
    want, counts = word_hashes(texts)
    assert counts.tolist() == [len(words(t)) for t in texts]
    by = {}
    for w, h in zip([w for t in texts for w in words(t)], want.tolist()):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
    for run in (1, 7, 1000):
        got, n = word_hashes(texts, run=run)
        assert (got == want).all() and (n == counts).all()
    assert word_hashes([])[1].tolist() == [] and word_hashes([None, ""])[1].tolist() == [0, 0]
