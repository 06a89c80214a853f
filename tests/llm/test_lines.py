"""Repeated runs of lines, held against all alignments of all texts."""

import random

from pyspark.sql import functions as F

from tipwatch.llm import lines


def deduped(docs):
    return {(r.doc_id, r.before): r for r in lines.run_dedup(docs.withColumn("before", F.col("text"))).collect()}


def numbers(docs):
    """{(key, text): lines that went}, straight from the operator."""
    gone = lines.repeated_lines(docs)
    rows = docs.select("doc_id", "text", lines._identity(F.col("doc_id"), F.col("text")).alias("_doc")).distinct().join(gone, "_doc", "left").collect()
    return {(r.doc_id, r.text): set(r._gone or []) for r in rows}


def test_chunks_shift_with_their_lines(spark, make, prose):
    """The same lines choose the same chunks behind other lines, and three lines in a row have one."""
    shared = [prose(5, 300 + k) for k in range(40)]
    texts = ["\n".join([prose(4, 7000 + 10 * i + k) for k in range(i)] + shared) for i in range(6)]
    starts = [[s - i for s in r._starts if s - i > 0] for i, r in enumerate(lines.chunked(make(texts)).orderBy("doc_id").collect())]
    assert all(s == starts[0] for s in starts[1:]) or all(set(s[1:]) <= set(starts[0]) for s in starts)
    assert all(b - a <= 2 for s in starts for a, b in zip(s, s[1:], strict=False))
    short = {r.text: r._starts for r in lines.chunked(make(["a\nb", "a", "", None])).collect()}
    assert short == {"a\nb": [0], "a": [], "": [], None: []}


def test_planted_runs_against_all_alignments(make, plain_runs, prose):
    """Runs of two to eight lines between differing neighbours, at any place of texts of any order."""
    draw, texts, planted = random.Random(4), [], {n: 0 for n in range(2, 9)}
    runs = {n: [[prose(6, 50_000 + 1000 * n + 10 * v + k) for k in range(n)] for v in range(12)] for n in planted}
    for n, some in runs.items():
        for run in some:
            for _ in range(2):
                around = [prose(6, draw.randrange(10**6)) for _ in range(draw.randrange(2, 7))]
                at = draw.randrange(len(around) + 1)
                texts.append("\n".join(around[:at] + run + around[at:]))
    draw.shuffle(texts)
    docs = make(texts).repartition(4)
    may, did = plain_runs(list(enumerate(texts, 1))), numbers(docs)
    assert all(did[k] <= may[k] for k in may)
    lines_to_go = sum(map(len, may.values()))
    assert lines_to_go == sum(12 * n for n in planted)
    assert sum(map(len, did.values())) >= 0.9 * lines_to_go
    for k, gone in may.items():  # all but runs of two lines go whole
        if len(gone) > 2:
            assert did[k] == gone
    found = sum(bool(did[k]) for k, gone in may.items() if gone)
    assert found >= 0.9 * sum(map(bool, may.values()))


def test_mixed_texts_against_all_alignments(spark, make, plain_runs, prose):
    draw = random.Random(7)
    pool = [prose(3, s) for s in range(12)] + ["", "", " "]
    texts = ["\n".join(draw.choices(pool, k=draw.randrange(1, 9))) for _ in range(60)]
    texts += ["x\n\n\n\ny\nz", "a\nx\n\n\n\ny\nz", "\n\n\n", "q\n\n\n\n", "one", "one", "", None, texts[0], texts[0]]
    docs = make(texts).repartition(5)
    may, did = plain_runs(list(enumerate(texts, 1))), numbers(docs)
    assert all(did[k] <= may[k] for k in may)
    assert sum(map(len, did.values())) >= 0.5 * sum(map(len, may.values()))  # most runs here have two lines only
    got = deduped(docs)
    for i, text in enumerate(texts, 1):
        r = got[i, text]
        rows = [] if text is None else text.split("\n")
        gone = did[i, text]
        assert r.text == (text if not gone else "\n".join(x for k, x in enumerate(rows) if k not in gone))
        assert (r.n_lines, r.n_removed_lines) == (len(rows), len(gone))
        assert r.n_removed_chunks <= r.n_chunks and (r.n_removed_chunks > 0) <= (len(gone) > 1)


def test_headings_and_stitched_lines_stay(make):
    """One heading between blank lines is no run, and two runs of different texts do not add up."""
    texts = ["alpha one\n\nShared heading\n\nbeta two", "gamma three\n\nShared heading\n\ndelta four", "A a\nB b", "B b\nC c", "A a\nB b\nC c", "A a\n\nB b\n\nD", "x\nA a\n\nB b\n\ny"]
    got = {k: r for (k, _), r in deduped(make(texts)).items()}
    assert got[2].text == texts[1] and got[4].text == texts[3]
    assert got[5].n_removed_lines in (0, 2) and got[5].text.count("\n") != 0 or got[5].text in ("C c", "A a")
    assert got[7].text == "x\ny"  # two lines of a run are not blank, whatever stands between


def test_repeats_within_a_text(make):
    block = "\n".join(f"line {i} of it" for i in range(5))
    texts = ["\n".join([block, "between", block, block]), "same\nsame\nsame\nsame", "same\nsame\nsame", "p\nq\np\nq"]
    got = {k: r for (k, _), r in deduped(make(texts)).items()}
    assert got[1].text == block + "\nbetween"
    assert got[2].text == "same\nsame" and got[3].n_removed_lines in (2, 3) and got[4].text == "p\nq"


def test_nulls_repeats_clashes_and_empty_tables(spark, make):
    block = "a b c\nd e f\ng h i\nj k l\nm n o"
    docs = make([block, None, block, "z"]).withColumnRenamed("n_chars", "n_chunks").withColumnRenamed("lang", "part").withColumnRenamed("source", "_from")
    null_key = docs.filter("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))
    again = docs.filter("doc_id in (1, 2, 4)")
    other = docs.filter("doc_id = 4").withColumn("text", F.lit(block + "\nmore\nlines"))  # another text of a key that is there
    out = lines.run_dedup(docs.unionByName(null_key).unionByName(again).unionByName(other))
    assert set(out.columns) == {"doc_id", "text", "part", "_from", "n_chunks", "n_lines", "n_removed_chunks", "n_removed_lines"}
    rows = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed_lines) for r in out.collect()), key=str)
    want = [(1, block, 5, 0)] * 2 + [(2, None, 0, 0)] * 2 + [(3, "", 5, 5), (None, "", 5, 5), (4, "z", 1, 0), (4, "z", 1, 0), (4, "more\nlines", 7, 5)]
    assert rows == sorted(want, key=str)
    assert lines.run_dedup(docs.limit(0)).count() == 0


def test_a_very_long_text_and_a_hot_passage(spark, make, prose):
    passage = "\n".join(prose(9, 40 + k) for k in range(6))
    long = "\n".join(f"row {i} {i * 7919 % 100003}" for i in range(60_000))
    texts = [long, "head\n" + long + "\ntail"] + [prose(5, 9000 + i) + "\n" + passage + "\n" + prose(5, 20000 + i) for i in range(400)]
    got = {k: r for (k, _), r in deduped(make(texts).repartition(6)).items()}
    assert got[2].text == "head\ntail" and got[1].n_removed_lines == 0
    assert got[3].n_removed_lines == 0 and all(got[k].n_removed_lines == 6 for k in range(4, 403))
