import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Texts (or (text, lang, source)) to a documents table with ids from 1."""

    def build(rows, **extra):
        out = []
        for i, row in enumerate(rows):
            text, lang, source = row if isinstance(row, tuple) else (row, "en", "src0")
            out.append((i + 1, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(out, DOCS)

    return build


@pytest.fixture(scope="session")
def prose():
    """Invented sentences: prose(n_words, seed)."""

    def build(n, seed=0, vocabulary=4000):
        draw = random.Random(seed)
        return " ".join("".join(chr(97 + int(c)) for c in str(draw.randrange(vocabulary) * 7919 % 100003)) for _ in range(n))

    return build


@pytest.fixture(scope="session")
def plain_runs():
    """All lines of (key, text) rows that a run of two or more lines that are not blank, standing anywhere earlier as it
    is, could take out; every alignment of every two texts is tried. {(key, text): numbers}"""

    def runs(rows):
        order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
        split = [(row, row[1].split("\n") if row[1] is not None else []) for row in order]
        out = {}
        for n, (row, late) in enumerate(split):
            gone = set()
            for m in range(n + 1):
                early = split[m][1]
                for shift in range(1 if m == n else 1 - len(early), len(late)):
                    at = max(0, shift)
                    while at < len(late) and at - shift < len(early):
                        end = at
                        while end < len(late) and end - shift < len(early) and late[end] == early[end - shift] and (m < n or end - at < shift):
                            end += 1
                        if sum(bool(x.strip()) for x in late[at:end]) >= 2:
                            gone |= set(range(at, end))
                        at = max(end, at + 1)
            out[row] = gone
        return out

    return runs
