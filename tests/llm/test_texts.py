import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonewright.llm import leaks, levels, packing, sourcefiles, terms

DOCS = "doc_id long, text string, lang string, n long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1) for i, t in rows], DOCS)


def test_leaks_match_brute_force(spark):
    draw = random.Random(4)
    text = lambda n: " ".join(draw.choice(["the", "a", "cat", "sat", "Mat", "x_y"]) for _ in range(n))
    items = [(i, text(draw.randrange(10, 40))) for i in range(12)] + [(50, None), (51, ""), (52, "a " * 12), (0, None), (None, "x")]
    rows = [(i, text(draw.randrange(0, 60))) for i in range(30)]
    rows += [(i + 100, text(7) + "\r\n" + " ,-- ".join(leaks.words(items[i][1])[3:17]).upper() + "! " + text(5)) for i in range(12)]
    rows += [(200, None), (201, ""), (202, items[0][1]), (202, items[0][1]), (203, "cat " * 30000), (None, items[1][1])]

    def runs(t):
        w = leaks.words(t)
        return {tuple(w[k : k + 13]) for k in range(len(w) - 12)}

    want = {(d, i) for d, t in rows if d is not None for i, s in items if i is not None and runs(t) & runs(s)}
    found = leaks.leaked(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got = found.collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    texts = dict(rows)
    for r in got:
        w = leaks.words(texts[r.doc_id])[r.first_word : r.first_word + r.n_words]
        assert r.n_words >= 13 and any(" ".join(w) in " ".join(leaks.words(s)) for i, s in items if i == r.item_id)
    clean = leaks.without_leaks(docs(spark, rows), found)
    assert {r.doc_id for r in clean.where("doc_id is not null").collect()} == {d for d, _ in rows if d is not None} - {d for d, _ in want}


def test_leaks_of_nothing_and_too_much(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks.leaked(docs(spark, [(1, "a " * 20)]), none).count() == 0
    assert leaks.leaked(docs(spark, []), spark.createDataFrame([(1, "a " * 20)], "item_id long, text string")).count() == 0


def test_leaks_beyond_the_broadcast_and_hot_runs(spark):
    draw = random.Random(9)
    text = lambda n: " ".join(draw.choice(["the", "a", "cat", "sat", "mat"]) for _ in range(n))
    same = text(13)
    items = [(i, same + " " + text(draw.randrange(0, 30))) for i in range(40)] + [(70, "la " * 60), (71, None), (72, "")]
    rows = [(i, text(20) + " " + same + "\n" + text(9)) for i in range(20)] + [(60, "la " * 45), (61, "cat " * 30000), (62, None), (63, ""), (63, same)]
    passages = spark.createDataFrame(items, "item_id long, text string")
    wide = {tuple(r) for r in leaks.leaked(docs(spark, rows), passages).collect()}
    joined = leaks.leaked(docs(spark, rows), passages, most_characters=0)
    assert wide == {tuple(r) for r in joined.collect()} and {(r[0], r[1]) for r in wide} >= {(d, i) for d in range(20) for i in range(40)}
    assert leaks.leaked(docs(spark, rows), passages.where("item_id > 90"), most_characters=-1).count() == 0


def test_leaked_spans_are_cut_out(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, f"Before, {passage.upper()}! After."), (2, passage), (3, "nothing here"), (4, None), (5, f"{passage}; {passage} end"), (6, "")]
    found = leaks.leaked(docs(spark, rows), spark.createDataFrame([(1, passage), (2, "zero " + passage)], "item_id long, text string"))
    got = {r.doc_id: (r.text, r.n_removed) for r in leaks.without_spans(docs(spark, rows), found).collect()}
    assert got == {1: ("Before, ! After.", 13), 2: ("", 13), 3: ("nothing here", 0), 5: (";  end", 26), 6: ("", 0)}


def test_terms_match_brute_force(spark):
    draw = random.Random(6)
    rows = [(i, [" ".join(draw.choice(["a", "b", "B", "_v0", "x1", "1x"]) for _ in range(draw.randrange(4))) for _ in range(3)]) for i in range(40)]
    rows += [(90, ["only", "é once", None]), (91, [None, "", "!"]), (92, [])]
    table = terms.TermTable(spark.createDataFrame([(i, ls, "z") for i, ls in rows], "id long, lines array<string>, term string"))
    counts = {i: Counter(t for x in ls if x for t in re.findall("[A-Za-z_][A-Za-z0-9_]*", x)) for i, ls in rows}
    d, col = Counter(t for c in counts.values() for t in c), Counter()
    for c in counts.values():
        col.update(c)
    total, n = sum(col.values()), len(rows)
    scored = {(r.id, r.term): r for r in table.scored().collect()}
    assert set(scored) == {(i, t) for i, c in counts.items() for t in c}
    best = {}
    for (i, t), r in scored.items():
        tf, row = counts[i][t], sum(counts[i].values())
        e = row * col[t] / total
        spread = math.sqrt((1 - row / total) * (1 - col[t] / total))
        assert r.residual == pytest.approx((tf - e) / math.sqrt(e)) and r.adjusted == pytest.approx((tf - e) / math.sqrt(e) / spread)
        rarity = round(tf * math.log(n / d[t]), 6)
        assert r.rarity == pytest.approx(rarity)
        best[i] = min(best.get(i, (1e9, "")), (-rarity, t))
    got = {r.id: r.term for r in terms.best_terms(table.scored(), "rarity").collect()}
    assert got == {i: t for i, (_, t) in best.items()} and 91 not in got
    empty = terms.TermTable(spark.createDataFrame([], "id long, lines array<string>"))
    assert terms.best_terms(empty.scored(), "rarity").count() == 0


def test_packing_is_whole_and_fits(spark):
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choice(["cat", "dog", "house"]) for _ in range(int(draw.expovariate(1 / 40))))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "word " * 700), (903, "<|endoftext|>"), (None, "x")]
    limits = spark.createDataFrame([(1, 64), (2, 200), (3, 0), (4, None), (None, 5), (1, 64)], "limit_id int, capacity int")
    sizes = {r.doc_id: r.n_tokens for r in packing.token_counts(docs(spark, rows)).collect()}
    assert sizes[900] == sizes[901] == 0 and sizes[903] > 1
    placed = packing.pack(docs(spark, rows), limits).collect()
    assert {r.limit_id for r in placed} == {1, 2}
    for limit, cap in ((1, 64), (2, 200)):
        own = [r for r in placed if r.limit_id == limit]
        boxes, parts = Counter(), {}
        for r in own:
            boxes[r.container_id] += r.n_tokens
            parts.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
        assert max(boxes.values()) <= cap and set(parts) == {i for i, n in sizes.items() if n}
        for i, p in parts.items():
            p.sort()
            assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False)) and p[-1][0] + p[-1][1] == sizes[i]
            assert len(p) == -(-sizes[i] // cap)
        least = -(-sum(boxes.values()) // cap)
        assert len(boxes) <= least * 1.05 + 2 and sorted(boxes) == list(range(len(boxes)))
    assert {r.limit_id: r.n_containers for r in packing.fill(packing.pack(docs(spark, rows), limits)).collect()}[1] == len({r.container_id for r in placed if r.limit_id == 1})
    beside = {r.limit_id: r for r in packing.fill_beside_buckets(packing.packing(docs(spark, rows), limits)).collect()}
    assert all(r.bucket_containers >= r.n_containers and r.bucket_filled <= r.filled for r in beside.values()) and set(beside) == {1, 2}
    assert packing.pack(docs(spark, []), limits).count() == 0
    assert packing.pack(docs(spark, rows), limits.where("false")).count() == 0


def test_length_buckets_are_optimal():
    from itertools import combinations

    draw = random.Random(1)
    for _ in range(60):
        lengths = np.array(sorted(draw.sample(range(1, draw.choice([12, 40, 400])), 8)))
        counts = np.array([draw.randrange(1, 9) for _ in lengths])

        def padding(bounds, lengths=lengths, counts=counts):
            at = np.searchsorted(bounds, lengths)
            return int(((np.array(bounds)[at] - lengths) * counts).sum())

        for k in (1, 2, 3, 8):
            got = packing.length_buckets(lengths, counts, k)
            want = min(padding([*c, lengths[-1]]) for c in combinations(lengths[:-1], min(k, 8) - 1))
            assert padding(got) == want and len(got) <= k


def test_fill_plan_places_every_item_once():
    draw = random.Random(3)
    for _ in range(30):
        capacity = draw.randrange(10, 60)
        bounds = sorted(draw.sample(range(1, capacity + 1), 5))
        counts = [draw.randrange(0, 50) for _ in bounds]
        boxes = Counter()
        seen = Counter()
        for b, lo, hi, first, each in packing.fill_plan(bounds, counts, capacity):
            for item in range(lo, hi):
                boxes[first + (item - lo) // each] += bounds[b]
                seen[b] += 1
        assert all(seen[b] == n for b, n in enumerate(counts)) and max(boxes.values(), default=0) <= capacity


def test_syllables_and_grades():
    known = {"cat": 1, "table": 2, "reading": 2, "idea": 3, "make": 1, "makes": 1, "wanted": 2, "jumped": 1, "university": 5, "the": 1, "people": 2, "statement": 2, "rhythm": 1}
    wrong = {w: levels.syllables(w) for w, n in known.items() if levels.syllables(w) != n}
    assert len(wrong) <= 1, wrong
    easy = levels.grades("The cat sat. The dog ran. We see a red hat.")
    hard = levels.grades("Heteroscedasticity necessitates multivariate parameterization, notwithstanding computational approximations of asymptotic representativeness.")
    assert all(hard[g] > easy[g] for g in levels.GRADES[:5]) and easy["language"] == "en" and easy["lix"] is None
    assert levels.grades(None) is None and levels.grades("") is None and levels.grades("123 ---") is None
    flat = levels.grades("one two three four five.")
    assert flat["n_words"] == 5 and flat["n_sentences"] == 1 and flat["ari"] == pytest.approx(4.71 * 19 / 5 + 0.5 * 5 - 21.43)


def test_hyphenation_of_languages():
    parts = {"window": "win-dow", "children": "chil-dren", "table": "ta-ble", "statement": "state-ment", "reading": "rea-ding", "sentence": "sen-tence"}
    assert {w: "-".join(levels.hyphenated(w)) for w in parts} == parts
    french = {"résultat": 3, "mesure": 2, "tableau": 2, "théâtre": 2, "qui": 1, "français": 2, "réel": 2}
    german = {"Bericht": 2, "Messung": 2, "verändert": 3, "heute": 2, "Spiel": 1, "Häuser": 2, "Theater": 3}
    spanish = {"tabla": 2, "necesita": 4, "después": 2, "quizás": 2, "país": 2, "guerra": 2, "ciudad": 2, "muestra": 2}
    for lang, known in (("fr", french), ("de", german), ("es", spanish)):
        assert {w: levels.syllables(w, lang) for w in known} == known
        assert all("".join(levels.hyphenated(w, lang)) == w for w in known)


def test_languages_have_their_own_estimates():
    texts = {"fr": "Le résultat est dans le tableau. La mesure et la valeur.", "de": "Der Bericht ist nicht auf dem Tisch. Das Ergebnis und die Messung.", "es": "El informe y los datos. La tabla es una muestra en el campo."}
    for lang, text in texts.items():
        g = levels.grades(text)
        assert g["language"] == lang and g["fog"] is None and None not in (g["ease"], g["lix"], g["rix"])
    assert levels.grades("\u00fcber")["n_words"] == 1 and levels.grades("\u4f60\u597d")["n_words"] == 1


def test_prose_of_notebooks():
    text = "# %% [markdown]\n# Title\nSome words.\n```\ncode here\n```\n# %% [code] In[1]\nx = 1\n# %% [output] result Out[1]\nnoise\r\n# %% [markdown]\r\nMore."
    assert levels.prose(text).split() == ["Some", "words.", "More."] and levels.prose("plain text") == "plain text"


def test_level_borders_are_optimal():
    from itertools import combinations_with_replacement

    draw = random.Random(5)
    hist = [(s, draw.randrange(1, 4), draw.randrange(1, 5)) for s in range(8) for _ in range(2)]

    def error(borders):
        return sum(n * abs(1 + sum(s >= b for b in borders) - level) for s, level, n in hist)

    got = levels.level_borders(hist, 3)
    assert got == sorted(got) and error(got) == min(error(c) for c in combinations_with_replacement(range(10), 2))


def test_reading_levels(spark):
    easy, hard = "The cat sat. The dog ran. ", "Representativeness necessitates multivariate parameterization notwithstanding heteroscedasticity. "
    rows = [(i, (easy if i % 2 else hard) * (1 + i % 3)) for i in range(40)] + [(90, None), (91, ""), (92, "12 34"), (93, easy * 5000), (None, easy)]
    labels = [(i, "r", 1 if i % 2 else 6, 0) for i in range(20)] + [(0, "r", 6, 0), (1, "s", None, 0), (None, "r", 3, 0)]
    rated = spark.createDataFrame(labels, "doc_id long, rater string, level_no int, rated_at long")
    got = {r.doc_id: r.level for r in levels.reading_levels(docs(spark, rows), rated).collect()}
    assert got[1] == got[39] == got[93] == 1 and got[0] == got[38] == 6 and got[90] is got[91] is got[92] is None and None not in got
    assert levels.reading_levels(docs(spark, rows), rated.where("false")).where("level is not null").count() == 41
    assert levels.reading_levels(docs(spark, []), rated).count() == 0
    seen = {}
    for r in levels.level_profile(levels.reading_levels(docs(spark, rows), rated)).collect():
        seen[r.level] = seen.get(r.level, 0) + r.n_docs
    assert seen[None] == 3 and sum(seen.values()) == 44


def test_levels_hold_on_documents_left_out(spark, tmp_path):
    from clonewright.llm import queries

    draw = random.Random(3)
    short, long = ["cat", "dog", "sun", "red", "big"], ["representativeness", "multicollinearity", "approximation", "necessitates", "differentiability"]
    rows, labels = [], []
    for i in range(300):
        level = 1 + i % 6
        words = [draw.choice(long if draw.random() < (level - 1) / 6 else short) for _ in range(120)]
        rows.append((i, " ".join(" ".join(words[k : k + 4 + level]) + "." for k in range(0, 120, 4 + level))))
        labels.append((i, "r", min(6, max(1, level + draw.choice([0, 0, 0, 1, -1]))), 0))
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, rater string, level_no int, rated_at long").write.parquet(str(tmp_path / "level_labels.parquet"))
    got = queries.p10_held_out(spark, str(tmp_path)).first()
    assert got.n > 100 and got.within_one > 0.9 and got.mean_error < 0.8


HAND = "import a\n\ndef first(x):\n    return [x * 2 for y in range(10) if y]\n\ndef second(value):\n    total = value + 1\n    return total\n"
NUMBERED = "".join(f"def make_row{k:03d}(x):\n    return x.field_{k} + {k}\n" for k in range(7, 12))


@pytest.mark.parametrize(
    ("path", "content", "want"),
    [
        ("r/a.py", HAND, []),
        ("r/generators/gen_a.py", HAND, []),
        ("r/vendors/b/vendor_a.py", HAND, []),
        ("r/a.py", "# Helpers for generated code; please do not edit the limits.\n" + HAND, []),
        ("r/a.py", HAND + 'NOTE = "# Code generated by x. DO NOT EDIT."\n', []),
        ("r/a.py", None, []),
        ("r/a_pb2.py", None, []),
        ("r/a.py", "", []),
        ("r/a.py", "# Code generated by x-gen. DO NOT EDIT.\n" + HAND, ["generated-note"]),
        ("r/a.py", "import a\n" * 3 + "# @generated by x\n" + HAND, ["generated-note"]),
        ("r/a.py", HAND + "// machine written by the x step, regenerate instead of patching\n", ["generated-note"]),
        ("r/a.py", "# Licence\n" * 40 + "# @generated by x\n" + HAND, ["generated-note"]),
        ("r/a.py", HAND + "\ndef third(x):\n    # Code generated by hand, and proud of it\n    return x.y\n", []),
        ("r/_generated/a.py", HAND, ["generated-layout"]),
        ("r/a_pb2.py", HAND, ["generated-layout"]),
        ("r/a.py", NUMBERED, ["generated-series"]),
        ("r/a.py", "# Vendored: thing==1.2\n" + HAND, ["vendored-note"]),
        ("r/third_party/thing-1.2/a.py", HAND, ["vendored-layout"]),
        ("r/third_party/a.py", HAND, []),
        ("r/a.min.ts", HAND, ["minified-layout"]),
        ("r/a.ts", "function f(a,b){" + "const c=a.some(b)+1;return c.other(a,b,c);" * 20 + "}", ["minified"]),
        ("r/a.ts", "const T = [" + ", ".join(f"0x{k:02x}" for k in range(250)) + "];\n", ["data"]),
        ("r/a.py", 'BLOB = "' + "QUJD" * 300 + '"\n', ["data"]),
        ("r/a.py", "# " + "long words here " * 80 + "\n" + HAND, []),
    ],
)
def test_file_reasons(path, content, want):
    assert sourcefiles.reasons(path, content) == want


def test_marked_files_and_shared_subtrees(spark):
    more = "def longer(items):\n    return sorted(items, key=lambda item: (item.size, item.name))\n"
    lib = {"lib.py": HAND + more, "sub/more.py": HAND.replace("first", "third").replace("second", "fourth") + more}
    other = HAND.replace("x * 2", "x + 3 - y").replace("total", "everything_so_far")
    rows = [(f"{repo}/{at}/{name}", repo, text if repo == "r1" else text.replace("total", "sum_") + "\n\n# moved\n", 1) for repo, at in (("r1", "x/copied-1.0"), ("r2", "y/z/copied-2.1")) for name, text in lib.items()]
    rows += [("r1/own.py", "r1", HAND, 1), ("r1/old.py", "r1", "# @generated by x\n" + HAND, 1), ("r1/old.py", "r1", HAND, 2), ("r3/null.py", "r3", None, 1), (None, "r3", HAND, 1)]
    rows += [("r4/own.py", "r4", other, 1), ("r5/own.py", "r5", HAND.replace("x * 2", "7 - x").replace("total", "nothing_yet"), 1), ("r6/named.py", "r6", HAND + more, 1)]
    rows += [("r3/twice.py", "r3", "# @generated by x\n", 1)] * 2
    df = spark.createDataFrame(rows, "file string, repo string, content string, at long").withColumn("scanned_at", F.timestamp_seconds("at")).drop("at")
    got = {r.file: r.reasons for r in sourcefiles.not_handwritten(df).collect()}
    assert got == {r[0]: ["shared-subtree"] for r in rows[:4]} | {"r3/twice.py": ["generated-note"]}
    defs = spark.createDataFrame([(1, "r1/own.py", "x"), (2, "r3/twice.py", "x"), (3, None, "x")], "def_id long, file string, reasons string")
    assert [r.def_id for r in sourcefiles.handwritten_definitions(defs, sourcefiles.not_handwritten(df)).orderBy("def_id").collect()] == [1, 3]
    assert sourcefiles.not_handwritten(df.where("false")).count() == 0
