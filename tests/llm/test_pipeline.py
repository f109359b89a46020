import brute
import corpus_pipeline as pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of every stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        after = spark.read.parquet(str(folder / name))
        out[name] = ({r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in after.collect()}, after.columns)
        docs = after
    return out


def test_columns(stages):
    for name in list(stages)[:-1]:
        assert stages[name][2] == list(pipeline.COLUMNS)
    assert stages["sharding"][2] == [*pipeline.COLUMNS, "slot", "shard"]


def test_quality_rules(stages):
    before, after, _ = stages["quality_rules"]
    assert all(not brute.quality(before[k].text)[5] for k in after)
    assert all(set(r.text.split("\n")) <= set(before[k].text.split("\n")) and r.n_chars == len(r.text) for k, r in after.items())


def test_one_of_each_group_stays(stages):
    before, after, _ = stages["ngram_join"]
    rows = [(k, r.text) for k, r in before.items()]
    assert set(after) == {c for _, _, c in brute.components(rows, 5, 80)}


def test_benchmark_goes(stages, spark):
    before, after, _ = stages["decontaminate"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = brute.contaminated([(k, r.text) for k, r in before.items()], items, 10)
    assert set(after) == {k for k, _, hit, _ in found if not hit}


def test_clean_documents_stay_in_the_mix(stages, spark):
    before, after, _ = stages["mixing"]
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0").collect()}
    assert len(clean & set(after)) >= 0.97 * len(clean & set(before))


def test_run_is_the_stages(stages, spark):
    got = {r.doc_id: (r.text, r.slot, r.shard) for r in pipeline.run(spark, SF).collect()}
    assert got == {k: (r.text, r.slot, r.shard) for k, r in stages["sharding"][1].items()}


def test_rows_of_one_id_are_told_apart(spark):
    """Lists, not dicts: the second row of an id is unique, the first copies another; some have no id or no word."""
    first, second = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta"))
    rows = [(3, first), (5, first), (5, second), (7, "other words that stand alone here"), (None, second), (None, None),
            (None, "only here is this text to be found"), (8, " "), (8, ""), (9, first + " more"), (5, second)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(pipeline.STAGES)["ngram_join"]
    got = sorted(((r.doc_id, r.text) for r in stage(spark, docs, SF).collect()), key=str)
    assert got == sorted([(3, first), (5, second), rows[3], rows[5], rows[6], rows[7], rows[8]], key=str)
    assert stage(spark, docs.limit(0), SF).collect() == []
