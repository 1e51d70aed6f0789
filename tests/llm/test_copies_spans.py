import random
import re
from collections import defaultdict

import pytest

from clonewright.llm import formatting, neardup, spans
from clonewright.llm.neardup import NearDuplicates, Signer, choose_bands, miss_chance

VALUES = "field string, def_id long, value string, digest string, n long"


def values(spark, rows):
    return spark.createDataFrame([(f, i, v, "clash", 1) for f, i, v in rows], VALUES).select("field", "def_id", "value")


def words(text):
    return re.findall("[a-z0-9_]+", text.lower())


def test_collapse_matches_brute_force(spark):
    draw = random.Random(3)
    base = [[draw.choice("abcdefg") + str(draw.randrange(5)) for _ in range(draw.randrange(6, 12))] for _ in range(12)]
    rows = []
    for i in range(80):
        w = list(draw.choice(base))
        draw.shuffle(w)
        rows.append((draw.choice("xy"), i, draw.choice([" ", ", ", "\r\n", " ;-- "]).join(draw.choice([x, x.upper()]) for x in w)))
    rows += [("x", 5, rows[5][2])] * 3 + [("x", 900, None), ("x", 901, ""), ("x", 902, "!? ."), ("x", 903, "word " * 5000), ("x", 904, "WORD\n" * 5000)]
    groups = defaultdict(set)
    for f, i, v in rows:
        if v is not None and len(words(v)) >= 8:
            groups[f, tuple(sorted(words(v)))].add(i)
    want = {(f, i, min(g)) for (f, _), g in groups.items() if len(g) > 1 for i in g}
    out = formatting.collapse(values(spark, [r for r in rows if r[2] is not None]))
    assert {tuple(r) for r in out.collect()} == want
    counted = formatting.copies(values(spark, [r for r in rows if r[2] is not None])).collect()
    assert sorted(map(tuple, counted)) == sorted((f, min(g), len(g)) for (f, _), g in groups.items())


def test_collapse_of_nothing(spark):
    assert formatting.collapse(values(spark, [])).count() == 0


def edited(draw, w):
    w = list(w)
    for _ in range(draw.randrange(0, 5)):
        at = draw.randrange(len(w))
        what = draw.randrange(3)
        if what == 0:
            w[at] = f"new{draw.randrange(99)}"
        elif what == 1:
            w.insert(at, f"in{draw.randrange(99)}")
        elif len(w) > 12:
            del w[at]
    return w


def jaccard(a, b, run):
    x, y = ({tuple(w[i : i + run]) for i in range(len(w) - run + 1)} for w in (words(a), words(b)))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize(("run", "threshold", "least"), [(3, 0.6, 20), (5, 0.8, 5)])
def test_near_duplicates_match_brute_force(spark, run, threshold, least):
    draw = random.Random(run)
    base = [[f"w{draw.randrange(400)}" for _ in range(draw.randrange(18, 60))] for _ in range(25)]
    rows = [("x", i, " ".join(edited(draw, draw.choice(base)))) for i in range(120)]
    rows += [("x", 200, rows[0][2]), ("x", 201, rows[0][2].upper()), ("x", 201, rows[0][2].upper()), ("y", 300, rows[0][2]), ("y", 301, "short"), ("y", 302, ""), ("x", 303, "long " * 20000)]
    usable = [r for r in rows if len(words(r[2])) >= max(run, least)]
    want = {(f, min(i, j), max(i, j)) for y, (f, i, a) in enumerate(usable) for g, j, b in usable[:y] if f == g and i != j and jaccard(a, b, run) >= threshold}
    near = NearDuplicates(values(spark, rows), run, threshold, least, recall=0.9999)
    assert {tuple(r) for r in near.record_pairs().collect()} == want
    got = {(r.field, r.def_id): (r.cluster, r.n_links) for r in near.clusters().collect()}
    links = defaultdict(set)
    for f, i, j in want:
        links[f, i].add(j)
        links[f, j].add(i)
    assert set(got) == {(f, i) for f, i, _ in usable} and all(got[k][1] == len(links[k]) for k in got)
    assert all(got[f, i][0] == got[f, j][0] for f, i, j in want) and all(got[k][0] <= k[1] for k in got)


def test_near_duplicates_of_nothing(spark):
    near = NearDuplicates(values(spark, []))
    assert near.record_pairs().count() == near.clusters().count() == 0


def test_band_choice():
    b = choose_bands(0.6, 0.995, 4)
    assert miss_chance(0.6, b, 4) <= 0.005 < miss_chance(0.6, b - 1, 4)


def test_signature_does_not_depend_on_the_batch():
    texts = ["a b c d e f", "a b c", "q w e r t y u", "a b c d e f"]
    one = Signer(3, 2, 6)
    keys, sketch, sizes = one.sign(texts)
    for k, t in enumerate(texts):
        own = one.sign([t])
        assert (own[0][0] == keys[k]).all() and own[1][0] == sketch[k] and own[2][0] == sizes[k]
    assert list(sizes) == [4, 1, 5, 4] and (keys[0] == keys[3]).all() and not (keys[0] == keys[2]).any()


def brute_spans(rows, span):
    distinct = defaultdict(set)
    for f, i, v in rows:
        distinct[f, i].add(v)
    where = defaultdict(set)
    for f, i, v in rows:
        for k in range(len(v) - span + 1):
            where[f, v[k : k + span]].add(i)
    out = {}
    for f, i, v in rows:
        hit = [k for k in range(len(v) - span + 1) if len(where[f, v[k : k + span]]) > 1]
        if hit:
            covered = {c for k in hit for c in range(k, k + span)}
            out[f, i] = (len(v), len(covered), sum(c - 1 not in covered for c in covered))
    return out


@pytest.mark.parametrize(("hot", "seed"), [(2000, 1), (2000, 2), (1, 3)])
def test_shared_spans_match_brute_force(spark, hot, seed):
    draw = random.Random(seed)
    text = lambda n: "".join(draw.choice("abé \U0001f600\n") for _ in range(n))
    stock = [text(n) for n in (24, 23, 25, 60, 30)]
    rows = [(draw.choice("xy"), i, text(draw.randrange(40)) + draw.choice(stock) + text(draw.randrange(40)) + draw.choice(stock)) for i in range(40)]
    rows += [("x", 100, stock[3]), ("x", 101, stock[3]), ("x", 102, "a" * 300), ("x", 103, "a" * 50 + "b"), ("x", 104, ""), ("x", 105, "solo " * 60), ("x", 101, stock[3])]
    got = {(r.field, r.def_id): (r.n_chars, r.n_shared, r.n_spans) for r in spans.shared_spans(values(spark, rows), 24, 12, hot).collect()}
    assert got == brute_spans(rows, 24)


def test_shared_spans_of_nothing(spark):
    assert spans.shared_spans(values(spark, [])).count() == 0


def test_texts_longer_than_a_batch(spark):
    draw = random.Random(8)
    shared = "".join(draw.choice("abcdefgh") for _ in range(300))
    filler = lambda n: "".join(draw.choices("ijklmnop", k=n))
    half = spans._BATCH_CHARS // 2
    long = filler(half - 150) + shared + filler(half)
    got = {r.def_id: (r.n_shared, r.n_spans) for r in spans.shared_spans(values(spark, [("x", 1, long), ("x", 2, "z" + shared)])).collect()}
    assert got == {1: (300, 1), 2: (300, 1)}


def test_winnowing_picks_equal_parts():
    w = spans.Winnower(24, 12)
    draw = random.Random(1)
    shared = "".join(draw.choice("abc") for _ in range(24))
    a, b = "xyz" * 5 + shared + "q" * 9, "m" * 31 + shared
    number, prints, lo, hi = w.picks([a, b])
    at = {n: {int(p) for p, l, h in zip(prints[number == n], lo[number == n], hi[number == n], strict=True) if l <= t.find(shared) <= h} for n, t in enumerate((a, b))}
    assert at[0] and at[0] == at[1]
    assert neardup.Signer
