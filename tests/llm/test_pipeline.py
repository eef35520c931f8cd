"""Every stage of the corpus pipeline against a plain version of it, each on its own input."""

import cases
import corpus_pipeline
import pytest
from test_copies import exact_loop, near_loop
from test_texts import ITEMS, hits_loop, labelled_rows, words

from flowcast.llm import toxicity


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rows = [(10_000 + i, t) for i, t, _, _ in labelled_rows()] + [r for r in cases.texts() if r[1] != "other text under the same id"] + [(60, "before " + " ".join(words(ITEMS[0][1])) + " after")]
    cases.written(spark, rows, folder)
    spark.createDataFrame([(10_000 + i, q, x) for i, _, q, x in labelled_rows()], "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    spark.createDataFrame(ITEMS[:2], "item_id long, text string").write.parquet(f"file://{folder}/benchmark.parquet")
    docs, out = spark.read.parquet(f"file://{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, f"file://{folder}").write.parquet(f"file://{folder}/{name}")
        before, docs = docs, spark.read.parquet(f"file://{folder}/{name}")
        out.append((name, before, docs))
    return folder, {name: (before, after) for name, before, after in out}


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_columns_stay(run):
    for name, (before, after) in run[1].items():
        assert name == "packing" or before.columns == after.columns


def test_toxic_documents_go_and_clean_ones_stay(run):
    before, after = map(pairs, run[1]["toxicity"])
    gone = [text for doc_id, text in before if (doc_id, text) not in after]
    assert gone and all(any(w in text.lower() for w in ("blockhead", "numbskull", "dimwit")) for text in gone)
    assert len(before) - len(after) == len(gone)
    assert not any(w in (text or "").lower() for _, text in after for w in ("blockhead", "numbskull", "dimwit"))
    assert toxicity.THRESHOLD == 0.3


def test_one_of_equal_texts_stays(run):
    before, after = map(pairs, run[1]["exact_dedup"])
    assert len(after) == exact_loop(before)[1] == exact_loop(after)[1]
    assert {r[0] for r in after} == {w[1] for w in exact_loop(before)[0]}


def test_one_of_near_copies_stays(run):
    before, after = map(pairs, run[1]["near_duplicates"])
    loop = near_loop(before)
    assert len(after) == len({c for _, n, c in loop if n}) + sum(1 for _, n, _ in loop if not n)
    assert {d for d, _ in after} == {c if n else d for d, n, c in loop}


def test_contaminated_documents_go(run):
    before, after = map(pairs, run[1]["decontamination"])
    items = ITEMS[:2]
    assert after == [r for r in before if not hits_loop([r], items)[0][5]]
    assert 60 in {d for d, _ in before} and 60 not in {d for d, _ in after}


def test_what_is_left_is_packed(run, spark):
    before, after = run[1]["packing"]
    assert after.where("piece = 0").count() == before.count()
    assert corpus_pipeline.run(spark, f"file://{run[0]}").count() == after.count()


@pytest.mark.parametrize("name", ["exact_dedup", "near_duplicates", "decontamination"])
def test_rows_that_go_do_not_depend_on_the_splits_of_a_scan(run, spark, name):
    before, after = run[1][name]
    folder = f"file://{run[0]}"
    path = f"{folder}/{name}-in-files"
    before.repartition(5).write.parquet(path)
    sizes = {"spark.sql.files.maxPartitionBytes": "1000000000", "spark.sql.files.openCostInBytes": "64", "spark.sql.files.minPartitionNum": "1"}
    for key, value in sizes.items():
        spark.conf.set(key, value)
    try:
        kept = dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(path), folder)
        spark.conf.set("spark.sql.files.minPartitionNum", "30")  # as if more executors were alive from here on
        assert sorted((t or "" for _, t in pairs(kept))) == sorted(t or "" for _, t in pairs(after))
        assert kept.columns == before.columns
    finally:
        for key in sizes:
            spark.conf.unset(key)
