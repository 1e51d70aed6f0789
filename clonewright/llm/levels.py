"""Reading level of documents from classic readability formulas."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonewright.plans.partitions import spread
from clonewright.plans.scratch import materialise

CELL = re.compile(r"^# %% \[(\w+)\].*$", re.M)
SENTENCE_END = re.compile(r"[.!?]+(?:\s|$)")
PROSE_WORD = re.compile(r"[^\W\d_]+(?:['\u2019][^\W\d_]+)*")
# Frequent words by which a document's language is told.
FUNCTION_WORDS = {
    "en": frozenset("the of and to in is that this with for it are was on by as each which an not".split()),
    "fr": frozenset("le la les des du et un une est que dans pour qui sur au aux avec ce cette pas plus".split()),
    "de": frozenset("der die das und ist ein eine den dem des mit von zu nicht auf im sich oft dann auch".split()),
    "es": frozenset("el la los las del y un una es que en por con para se su al como lo no".split()),
}


def language(words: list[str]) -> str:
    """The language whose frequent words a text has most of; English where none is ahead of it."""
    counts = {lang: sum(w in known for w in words) for lang, known in FUNCTION_WORDS.items()}
    return max(counts, key=lambda lang: (counts[lang], lang == "en"))


# Spelling rules of hyphenation. Vowels that make one syllable, where English vowel groups divide all the
# same, endings that make none, and what may begin a syllable beside any single consonant.
VOWELS = re.compile(r"[aeiouy]+")
SPLIT_GROUPS = re.compile(r"(?<!t)(?<!s)(?<!c)i[ao](?!u)|[^aeiou]ia|io(?=[^nu])|(?<![pl])eo(?!u)|ua(?!r)|uo|[^q]ui(?=ng)|ying|ea(?=t[eo])")
SILENT_END = re.compile(r"(?:[^aeiouy]e|[^aeioulr]es|[^aeioutd]ed)$")
SILENT_MID = re.compile(r"[^aeiouy]e(?=(?:ly|ment|ful|less|ness)s?$)")
LE_END = re.compile(r"[^aeiouyl]le[sd]?$")
NUCLEI = {
    "fr": re.compile(r"(?:(?<=q)u)?(?:é|ï|ü|[aeiouyàâäèêëîôöùûœæ]+)"),
    "de": re.compile(r"ei|ai|au|eu|äu|ie|aa|ee|oo|[aeiouyäöüéà]"),
    "es": re.compile(r"(?:(?<=q)u|(?<=g)u(?=[eiéí]))?(?:[iuü]?[aeoáéó](?:[iuy](?![aeoáéíóú]))?|[íú]|[iuü]{1,2}|y$)"),
}
SILENT_FR = re.compile(r"[^aeiouyàâäéèêëîïôöùûüœæ](?:e|es)$")
ONSETS = frozenset("bl br ch cl cr dr dw fl fr gl gr gn kl kn kr ll ph pl pr qu rr sc sch schl schm schn schr schw sh sk sl sm sn sp spl spr st str sw th thr tr tw wh wr zw".split())


def _nuclei(w: str, lang: str) -> list[tuple[int, int]]:
    """(start, end) of the vowels of each syllable of a word in lower case."""
    if lang != "en":
        found = [m.span() for m in NUCLEI[lang].finditer(w)]
        return found[:-1] if lang == "fr" and len(found) > 1 and SILENT_FR.search(w) else found
    cuts = {max(i for i in range(*m.span()) if w[i] in "aeiouy") for m in SPLIT_GROUPS.finditer(w)}
    found = []
    for m in VOWELS.finditer(w):
        edges = [m.start(), *sorted(c for c in cuts if m.start() < c < m.end()), m.end()]
        found += list(zip(edges, edges[1:], strict=False))
    if found and SILENT_END.search(w) and not LE_END.search(w):
        found.pop()
    silent = SILENT_MID.search(w)
    return [n for n in found if not silent or n[0] != silent.end() - 1]


def hyphenated(word: str, lang: str = "en") -> list[str]:
    """The syllables of a word: each vowel nucleus with the consonants that may begin a syllable before it; at least one."""
    w = word.lower()
    nuclei = _nuclei(w, lang)
    cuts = [0]
    for (_, before), (start, _) in zip(nuclei, nuclei[1:], strict=False):
        cut = start
        for k in range(before, start):
            if start - k == 1 or w[k:start] in ONSETS:
                cut = k
                break
        cuts.append(cut)
    return [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)], strict=True)]


def syllables(word: str, lang: str = "en") -> int:
    """How many parts hyphenation gives."""
    return max(1, len(_nuclei(word.lower(), lang)))


def prose(text: str) -> str:
    """The text of the markdown cells of a flattened notebook, or all of it if it has no cells.

    Headings, fenced code and lines without a letter are left out.
    """
    parts = CELL.split(text.replace("\r\n", "\n").replace("\r", "\n"))
    kept = [parts[0]] + [parts[i + 1] for i in range(1, len(parts) - 1, 2) if parts[i] == "markdown"]
    lines = []
    fenced = False
    for line in "\n".join(kept).split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        elif not fenced and not line.lstrip().startswith("#"):
            lines.append(line)
    return "\n".join(lines)


GRADES = ("flesch_kincaid", "fog", "smog", "coleman_liau", "ari", "ease", "lix", "rix")


class Counter:
    """Syllable counts with a memory for words, emptied when it grows beyond ``most``."""

    def __init__(self, most: int = 200_000):
        self.known: dict[tuple[str, str], int] = {}
        self.most = most

    def __call__(self, word: str, lang: str) -> int:
        n = self.known.get((word, lang))
        if n is None:
            if len(self.known) >= self.most:
                self.known.clear()
            n = self.known[word, lang] = syllables(word, lang)
        return n


# Published coefficients. Reading ease of Flesch as fitted to French (Kandel and Moles), German (Amstad) and
# Spanish (Fernandez Huerta): constant, weight of words a sentence, weight of syllables a word.
EASE = {"fr": (207.0, 1.015, 73.6), "de": (180.0, 1.0, 58.5), "es": (206.84, 1.02, 60.0)}
# School grade at the middle of each band of reading ease, and the least LIX and RIX of grades 2 to 13.
EASE_GRADES = ((15, 17.0), (40, 14.5), (55, 11.0), (65, 8.5), (75, 7.0), (85, 6.0), (95, 5.0))
LIX_LEAST = (10, 15, 20, 24, 28, 32, 36, 40, 44, 48, 52, 56)
RIX_LEAST = (0.2, 0.5, 0.8, 1.3, 1.8, 2.4, 3.0, 3.7, 4.5, 5.3, 6.2, 7.2)


def grades(text: str | None, count=syllables) -> dict | None:
    """Counts, language and grade estimates of the prose of ``text``; None where it has no word.

    English has the Flesch-Kincaid grade, the Gunning fog index, SMOG (scaled to
    30 sentences), the Coleman-Liau index and the automated readability index.
    Those are fitted to English; French, German and Spanish have the reading
    ease fitted to them, as a grade, and LIX and RIX, which count long words.
    Estimates of the other kind are None.
    """
    body = prose(text or "")
    words = PROSE_WORD.findall(body)
    if not words:
        return None
    lang = language([w.lower() for w in words])
    sentences = sum(1 for s in SENTENCE_END.split(body) if PROSE_WORD.search(s))
    per = [count(w, lang) for w in words]
    n, syl = len(words), sum(per)
    letters = sum(map(len, words))
    per_sentence = n / sentences
    found: dict = {"n_words": n, "n_sentences": sentences, "language": lang} | dict.fromkeys(GRADES)
    if lang == "en":
        hard = sum(x >= 3 for x in per)
        return found | {
            "flesch_kincaid": 0.39 * per_sentence + 11.8 * syl / n - 15.59,
            "fog": 0.4 * (per_sentence + 100 * hard / n),
            "smog": 1.0430 * (hard * 30 / sentences) ** 0.5 + 3.1291,
            "coleman_liau": 0.0588 * (100 * letters / n) - 0.296 * (100 * sentences / n) - 15.8,
            "ari": 4.71 * letters / n + 0.5 * per_sentence - 21.43,
        }
    long = sum(len(w) > 6 for w in words)
    constant, of_sentence, of_word = EASE[lang]
    ease = constant - of_sentence * per_sentence - of_word * syl / n
    return found | {
        "ease": float(np.interp(ease, *zip(*EASE_GRADES, strict=True))),
        "lix": float(1 + bisect_right(LIX_LEAST, per_sentence + 100 * long / n)),
        "rix": float(1 + bisect_right(RIX_LEAST, long / sentences)),
    }


_SCHEMA = "doc_id long, language string, n_words int, n_sentences int, " + ", ".join(f"{g} double" for g in GRADES) + ", grade double"


def _grade_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = Counter()
    names = ["doc_id", "language", "n_words", "n_sentences", *GRADES, "grade"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * (len(GRADES) + 1)]
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            g = grades(text.as_py(), count)
            if g is None:
                rows.append((doc, None, 0, 0, *[None] * (len(GRADES) + 1)))
            else:
                known = [g[x] for x in GRADES if g[x] is not None]
                rows.append((doc, g["language"], g["n_words"], g["n_sentences"], *[g[x] for x in GRADES], median(known)))
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def reading_grades(documents: DataFrame) -> DataFrame:
    """(doc_id, language, n_words, n_sentences, estimates, grade): ``grade`` is the median of those that there are. One scan, no shuffle.

    Documents without prose, and null texts, have 0 words and null grades.
    """
    return spread(documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text")).mapInArrow(_grade_stage, _SCHEMA)


def level_borders(histogram: list[tuple[int, int, int]], levels: int) -> list[int]:
    """Rising borders in steps of a grade histogram (step, level, n) with the least sum of absolute level errors.

    A document of step s has level 1 + the number of borders <= s. Dynamic
    programming over steps and levels; ties take the lower border.
    """
    steps = sorted({s for s, _, _ in histogram})
    place = {s: i for i, s in enumerate(steps)}
    cost = [[0] * len(steps) for _ in range(levels)]
    for s, level, n in histogram:
        for k in range(levels):
            cost[k][place[s]] += n * abs(k + 1 - level)
    best: list[list[float]] = [[0.0] * (len(steps) + 1) for _ in range(levels)]
    cut = [[0] * (len(steps) + 1) for _ in range(levels)]
    for k in range(levels):
        for j in range(len(steps) + 1):
            if k == 0:
                best[0][j] = sum(cost[0][:j])
                continue
            total, found, where = 0.0, float("inf"), j
            for i in range(j, -1, -1):
                if i < j:
                    total += cost[k][i]
                if best[k - 1][i] + total <= found:
                    found, where = best[k - 1][i] + total, i
            best[k][j], cut[k][j] = found, where
    borders, j = [], len(steps)
    for k in range(levels - 1, 0, -1):
        j = cut[k][j]
        borders.append(steps[j] if j < len(steps) else steps[-1] + 1)
    return borders[::-1]


def reading_levels(documents: DataFrame, labels: DataFrame, levels: int = 6, step: float = 0.25) -> DataFrame:
    """``reading_grades`` with ``level`` 1 (easiest) to ``levels``.

    The borders between levels are fitted to all labels: each labelled
    document's median label against its grade, counted in a histogram of grade
    steps between -20 and 60, so the driver gets at most 320 * levels counts.
    Null and doubled labels do not count. Without labels the borders are evenly
    spread over grades 0 to 18. Documents without prose have a null level.
    """
    graded = materialise(reading_grades(documents))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("level_no").isNotNull()).select("doc_id", "rater", "level_no").distinct()
    truth = known.groupBy("doc_id").agg(F.percentile("level_no", F.lit(0.5)).alias("level"))
    bin_of = F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(60.0), F.col("grade"))) / step).cast("int")
    histogram = (
        graded.where(F.col("grade").isNotNull())
        .join(truth, "doc_id")
        .groupBy(bin_of.alias("s"), F.floor(F.col("level") + 0.5).cast("int").alias("l"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    if histogram:
        borders = [b * step for b in level_borders([(r.s, r.l, r.n) for r in histogram], levels)]
    else:
        borders = [18.0 * k / levels for k in range(1, levels)]
    clipped = F.greatest(F.lit(-20.0), F.least(F.lit(60.0), F.col("grade")))
    level = F.lit(1)
    for b in borders:
        level = level + (clipped >= b).cast("int")
    return graded.withColumn("level", F.when(F.col("grade").isNotNull(), level))


def level_profile(levelled: DataFrame) -> DataFrame:
    """(language, level, n_docs, n_words, mean_grade): the corpus by language and reading level; both are null for documents without prose."""
    return levelled.groupBy("language", "level").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_words"), F.round(F.avg("grade"), 6).alias("mean_grade")
    )


def agreement(spark: SparkSession, levelled: DataFrame, labels: DataFrame) -> DataFrame:
    """(n, exact, within_one, mean_error) of levels against each document's median label."""
    truth = labels.dropna(subset=["doc_id", "level_no"]).select("doc_id", "rater", "level_no").distinct()
    truth = truth.groupBy("doc_id").agg(F.percentile("level_no", F.lit(0.5)).alias("truth"))
    error = F.abs(F.col("level") - F.floor(F.col("truth") + 0.5))
    return levelled.where(F.col("level").isNotNull()).join(truth, "doc_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((error == 0).cast("int")).alias("exact"),
        F.avg((error <= 1).cast("int")).alias("within_one"),
        F.avg(error).alias("mean_error"),
    )
