"""The compression classifier: accuracy on rows it did not learn from, and the odd cases."""

import random
import zlib

import pytest

from tipwatch.llm import compression


@pytest.fixture(scope="module")
def corpus(make, spark, prose):
    draw = random.Random(2)
    texts, labels = [], []
    for i in range(240):
        good = draw.random() < 0.7
        text = prose(draw.randrange(30, 200), i)
        if not good:
            kind = draw.randrange(3)
            text = [" ".join(w + draw.choice(["***", "###", "%%%"]) for w in text.split()), "!! ".join(text.upper().split()), (text.split()[0] + " ") * 80][kind]
        texts.append(text)
        labels.append((i + 1, int(good)))
    return make([*texts, None, "", texts[0]]), spark.createDataFrame([*labels, (None, 1), (241, None), (5000, 0)], "doc_id long, quality int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    rows = {r.doc_id: r for r in compression.classified(docs.withColumnRenamed("lang", "score"), labels).collect()}
    assert len(rows) == 243
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    truth = {r.doc_id: r.quality for r in labels.dropna().collect() if r.doc_id in rows}
    out = [i for i in truth if rows[i].held_out]
    assert sum(rows[i].predicted == truth[i] for i in out) >= 0.9 * len(out)
    assert rows[241].score == rows[242].score  # null and empty
    assert rows[243].score == rows[1].score


def test_labels_of_held_out_rows_do_not_matter(corpus):
    from pyspark.sql import functions as F

    docs, labels = corpus
    turned = labels.withColumn("quality", F.when(compression.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert compression.fit(docs, turned) == compression.fit(docs, labels)


def test_one_class_and_empty_tables(corpus, make):
    docs, labels = corpus
    assert all(r.score > 0.5 for r in compression.classified(docs, labels.filter("quality = 1")).collect())
    assert all(r.score == 0.5 for r in compression.classified(docs, labels.limit(0)).collect())
    assert compression.classified(docs.limit(0), labels).count() == 0
