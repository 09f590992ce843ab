import pytest
from common import DATA, edge_rows
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tidemark.llm import neardup, registry
from tidemark.llm.storage import written


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], DATA), "stage"))
    return out


def ids(df) -> set[int]:
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "line dedup", "near dedup", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert all(s.schema == stages[0].schema for s in stages[:-1])


def test_decisions_take_effect(spark, stages):
    docs, clean, good, lined, single, packed = stages
    bad = ids(registry.QUERIES["op1_toxicity"](spark, DATA).filter("predicted = 1"))
    assert ids(docs) - ids(clean) == bad and bad
    assert ids(good) < ids(clean) and ids(lined) == ids(good)
    assert all(r.n_chars == len(r.text) for r in lined.collect())
    classes = {r.class_id for r in neardup.classes(lined).collect()}
    assert ids(single) == classes == ids(packed)


def test_clean_documents_stay(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1 and toxic = 0")
    wanted = ids(labels) & ids(stages[0])
    assert len(wanted - ids(stages[2])) <= 0.03 * len(wanted)


def test_run_gives_the_stages_rows(spark, stages):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(key, stages[-1].collect()))


def test_edge_rows_pass_through(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(i, t, None, None, None) for i, t in edge_rows()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(1, 8)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert "sequence_id" in corpus_pipeline.run(spark, folder).columns
    # with all labels alike both filters keep everything: what goes are copies, which are blank texts here
    clean = tmp_path / "clean"
    spark.read.parquet(f"{folder}/documents.parquet").write.parquet(f"{clean}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 8)], "doc_id long, quality int, toxic int").write.parquet(f"{clean}/labels.parquet")
    got = corpus_pipeline.run(spark, str(clean)).filter("start = 0").collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "4", "4", "5", "6", "7", "None", "None"]
    empty = tmp_path / "empty"
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").filter(F.lit(False)).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_every_operator_is_registered_once():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries()
