"""Quality rules: counts held against plain Python, estimates against numpy."""

import collections
import random
import re

import numpy as np
import pytest

from tipwatch.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = collections.Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in range(i, i + 5)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)]


def test_counts(spark, make, prose):
    draw = random.Random(1)
    texts = [None, "", " \n\t", "one", "a b c d e a b c d e", "x " * 3000, "a\x0bb\x0cc\rd \u00a0e\u2003f", "l\nl\n\n\nl\n k", "é#*$%&|<>"]
    for i in range(60):
        words = prose(draw.randrange(1, 120), i, 12 if i % 3 else 4000).split()
        texts.append("".join(w + draw.choice([" ", " ", "\n", "  ", "## ", "\t"]) for w in words))
    docs = make(texts).withColumnRenamed("lang", "n_words").withColumnRenamed("source", "base_failed").repartition(4)
    for row in quality.text_statistics(docs).collect():
        want = plain_counts(texts[row.doc_id - 1])
        assert [row[c] for c in quality.COUNTS] == want, texts[row.doc_id - 1]
        assert row.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


@pytest.fixture(scope="module")
def corpus(make, prose):
    draw, rows = random.Random(4), []
    for i in range(504):  # the small sources of each language make a pool large enough to be judged
        source = "src0" if i % 3 else f"src{i % 9}"
        text = prose(draw.randrange(12, 150), i)
        if i % 21 == 0:  # long enough: the prior words keep odd short texts
            text = " | ".join(prose(60, i).split()) + " |"
        rows.append((text, "en" if i % 2 else None, source if i % 40 else None))
    rows += [("", "en", "src0"), (None, None, None), ("a " * 40, "en", "src0")]
    return rows


def test_outliers_are_those_of_plain_estimates(spark, make, corpus):
    found = quality.quality_rules(make(corpus).repartition(5)).collect()
    rows = {r.doc_id: r for r in found}
    assert len(found) == len(corpus)
    junk = {i for i, (t, _, _) in enumerate(corpus, 1) if t and " | " in t}
    assert all(not rows[i].kept for i in junk)
    clean = [i for i, (t, _, _) in enumerate(corpus, 1) if t and i not in junk and not rows[i].base_failed]
    assert all(rows[i].kept for i in clean) and len(clean) > 350
    assert not any(r.kept for r in found if r.base_failed) and all(r.distance is None for r in found if r.base_failed)

    # numpy's own concentration steps for the largest group, from the same start
    def vector(r):
        w, c = r.n_words + quality.PRIOR_WORDS, r.word_chars + quality.PRIOR_CHARS
        text = corpus[r.doc_id - 1][0]
        lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
        return [np.log(c / w), (r.n_symbols / w) ** 0.5, (r.n_dup_lines / (lines + 2)) ** 0.5, (r.n_repeat_words / w) ** 0.5]

    group = [r for r in found if not r.base_failed and (r.lang, r.source) == ("en", "src0")]
    assert len(group) >= quality.LEAST_ROWS
    x = np.floor(np.array([vector(r) for r in group]) * quality.UNIT + 0.5) / quality.UNIT
    floors = np.diag(np.square(quality.FLOORS))
    centre = np.median(x, axis=0)
    spread = np.diag(np.square(1.4826 * np.median(np.abs(x - centre), axis=0))) + floors

    def far():
        off = x - centre
        return np.einsum("ij,jk,ik->i", off, np.linalg.inv(spread), off)

    step = lambda d: np.floor(np.log1p(d) * 256)
    for _ in range(quality.STEPS):
        near = x[step(far()) <= np.quantile(step(far()), quality.CORE)]
        centre, spread = near.mean(axis=0), np.cov(near.T, bias=True) + floors
    for last in (False, True):
        scale = max(1.0, np.expm1((np.median(step(far())) + 0.5) / 256) / quality.CHI_MEDIAN)
        if not last:
            near = x[far() <= quality.CHI_975 * scale]
            centre, spread = near.mean(axis=0), np.cov(near.T, bias=True) + floors
    assert np.allclose([r.distance for r in group], far() / scale, rtol=0.02, atol=1e-6)


def test_small_groups_share_an_estimate_and_empty_tables(spark, make, prose):
    few = make([(prose(30, i), "en", f"s{i}") for i in range(5)] + [(" | ".join(prose(30, 9).split()), "en", "s9")])
    assert all(r.kept and r.distance is None for r in quality.quality_rules(few).collect())
    pooled = make([(prose(40, i), "en", f"s{i}") for i in range(80)] + [(" | ".join(prose(40, 99).split()), "en", "s99")])
    assert [r.doc_id for r in quality.quality_rules(pooled).filter("not kept").collect()] == [81]
    assert quality.quality_rules(few.limit(0)).count() == 0
    twice = pooled.unionByName(pooled)
    assert quality.quality_rules(twice).filter("not kept").count() == 2


def test_null_sources_and_languages_have_names_of_their_own(spark, make, prose):
    """Rows of a null source keep their estimate when small sources of the language, or of a null one, come in."""
    rows = [(prose(20 + i % 40, i), "en", None) for i in range(60)]
    small = [(" # ".join(prose(3, 500 + 7 * i + k) for k in range(5 + i % 9)), "en", f"s{i % 6}") for i in range(60)]
    nowhere = [(prose(90 + i % 30, 900 + i), None, None) for i in range(60)]
    others = [(" | ".join(prose(2, 3000 + 7 * i + k) for k in range(6 + i % 9)), None, f"s{i % 6}") for i in range(60)]

    def distances(rows):
        counted = quality.written(quality.text_statistics(make(rows)).drop("text"), "statistics")
        return [r.distance for r in quality.outliers(counted, steps=1).sort("doc_id").collect()]

    together = distances(rows + nowhere + small + others)
    assert together[:120] == pytest.approx(distances(rows + nowhere))


def test_words_are_hashed_once_and_windows_sorted_without_a_comparator(make):
    """Five words a window hashed again and again, and an order by a lambda, took most of the time."""
    plan = quality.text_statistics(make(["a b c d e f a b c d e f"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort(" not in plan and plan.count("xxhash64(") == 4
    assert all(call.count("lambda") <= 2 for call in re.findall(r"xxhash64\(([^()]*)\)", plan))


def test_repeated_windows_at_the_ends_and_on_top_of_each_other(make):
    run, other = "p q r s t", "u v w x y"
    texts = [f"{run} {run}", f"{run} z {run} {other} {run}", f"{run} p q r s", "k " * 4, "k " * 5, "k " * 6, f"{run} {other}", f"{other} {run} {other} 1"]
    rows = {r.doc_id: r.n_repeat_words for r in quality.text_statistics(make(texts)).collect()}
    assert [rows[i] for i in range(1, len(texts) + 1)] == [plain_counts(t)[4] for t in texts]
