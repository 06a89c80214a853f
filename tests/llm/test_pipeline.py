"""The corpus pipeline over a small corpus, each stage held against what it must and must not take out."""

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tipwatch.llm import decontaminate, signature


@pytest.fixture(scope="module")
def stages(spark, make, prose, tmp_path_factory):
    """Documents (with planted cases), a folder with the benchmark, and the result of every stage."""
    folder = str(tmp_path_factory.mktemp("sf"))
    item = prose(40, 777)
    sentences = lambda seed: "\n".join(prose(9, seed * 100 + k) for k in range(8))
    texts = [sentences(i) for i in range(80)]
    texts += [texts[3], texts[3], "\n".join(reversed(texts[4].split("\n")))]  # copies; the same lines in another order
    words = texts[5].replace("\n", " ").split()
    texts += [" ".join(words[:30] + ["other"] + words[31:]), " ".join(words)]  # near copies on one line
    texts += [prose(30, 901) + " " + item + " " + prose(20, 902), " ".join(["junk ***"] * 60), "few words", None, ""]
    docs = make(texts).withColumn("extra", __import__("pyspark").sql.functions.lit(1))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out, docs = {"documents": spark.read.parquet(f"{folder}/documents.parquet")}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return folder, item, {n: {r.doc_id: r for r in d.collect()} for n, d in out.items()}, out


def test_stages_in_order_give_documents(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "jaccard_join", "decontamination", "bpe"]
    assert all(set(stages[3][n].columns) == set(corpus_pipeline.COLUMNS) for n in names[:-1])


def test_every_stage_takes_out_its_own(spark, stages, plain_runs):
    _, item, rows, frames = stages
    clean = set(range(1, 81))
    assert clean <= set(rows["quality_rules"]) and not {87, 88, 89, 90} & set(rows["quality_rules"])
    # lines: nothing but runs that stand earlier as they are goes, copies go whole
    before = {r.doc_id: r.text for r in frames["quality_rules"].collect()}
    may = plain_runs(list(before.items()))
    for key, text in before.items():
        lines_before, left = text.split("\n"), rows["line_dedup"][key].text.split("\n") if key in rows["line_dedup"] else []
        gone = may[key, text]
        sure = [x for i, x in enumerate(lines_before) if i not in gone]
        assert len(left) >= len([x for x in sure if x.strip()]) and (gone or left == lines_before)
        assert not gone or len(lines_before) - len(left) >= 0.9 * len(gone)
    assert set(before) - set(rows["line_dedup"]) == {81, 82}
    assert all(r.n_chars == len(r.text) for r in rows["line_dedup"].values())
    # one of each class stays
    classes = {r.doc_id: r.component_id for r in signature.classes(frames["line_dedup"]).collect()}
    assert set(rows["jaccard_join"]) == {k for k, c in classes.items() if k == c}
    assert not {84, 85} & set(rows["jaccard_join"]) or 6 not in rows["jaccard_join"]
    # the benchmark's passage goes, nothing else
    assert set(rows["jaccard_join"]) - set(rows["decontamination"]) == {86}
    hit = decontaminate.found_in(pa.array([rows["jaccard_join"][86].text]), decontaminate.Pieces([(0, item)]))
    assert len(hit["row"]) >= 1


def test_ids_are_those_of_the_library(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    _, _, rows, _ = stages
    assert set(rows["bpe"]) == set(rows["decontamination"])
    for key, row in rows["bpe"].items():
        text = rows["decontamination"][key].text
        assert row.ids == library.encode(text, add_special_tokens=False).ids
        assert row.n_tokens == len(row.ids) and row.text == text


def test_run_and_empty_table(spark, stages, tmp_path):
    folder, _, rows, frames = stages
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, folder).collect()} == {k: r.ids for k, r in rows["bpe"].items()}
    frames["documents"].limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
