"""The corpus pipeline, stage by stage, against what each stage may and must do."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from covarium.llm import secretscan
from tests.llm.test_operators import SF, brute_components, empty


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append((name, docs))
    return out


def test_names_and_columns(spark, stages):
    assert [n for n, _ in stages] == ["quality", "near_duplicates", "decontamination", "secrets", "mixing"]
    want = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(df.columns == want for _, df in stages[:-1])


def test_decisions(spark, stages):
    ids = [{r[0] for r in df.select("doc_id").collect()} for _, df in stages]
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(labels[i][0] == 1 for i in ids[0] if i in labels)
    clean = [i for i, label in labels.items() if label == (1, 0)]
    assert sum(i in ids[0] for i in clean) >= 0.97 * len(clean)
    before = [(r["doc_id"], r["text"]) for r in stages[0][1].collect()]
    assert ids[1] == {i for i, (_, c) in brute_components(before).items() if i == c}
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r["doc_id"]: r["text"] for r in stages[1][1].collect()}
    leaks = {i for i, t in kept.items() if any(b in t for b in bench)}
    assert leaks and not leaks & ids[2] and len(ids[1] - ids[2]) <= len(leaks) + 2
    assert ids[3] == ids[2] and ids[4] <= ids[3]
    assert secretscan.scan(stages[3][1]).where("exists(spans, x -> x.kind <> 'assign')").count() == 0


def test_stages_on_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), SF).collect() == []


def test_stages_on_nulls(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "src1", 0), (3, "The words of a plain text are here, and more.", None, None, None), (None, "The words of another text are here, as well.", "en", None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).collect()


def test_stages_on_repeats_long_texts_and_clashing_columns(spark):
    plain = "The words of a plain text are here, and a few more of them follow."
    long = " ".join(f"word{i % 5003}" for i in range(150_000))
    rows = [(1, plain, "en", "src1", 9), (1, plain, "en", "src1", 9), (2, long, "en", "src2", 9), (None, plain + " And so on.", None, "src1", None), (3, long + " end", "en", "src2", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("x") for c in ("n", "id", "key", "tokens", "epoch", "good", "kept", "spans", "_key", "_host", "component_id")})
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "mixing" or out.columns == list(corpus_pipeline.COLUMNS)
        seen[name] = sorted((r["doc_id"] or 0) for r in out.collect())
    assert seen["near_duplicates"] == [0, 1, 1, 2] and seen["decontamination"] == seen["secrets"] == [0, 1, 1, 2, 3]
    again = corpus_pipeline.redacted(spark, docs, SF).where("doc_id = 2").first()
    assert again["text"] == long and again["n_chars"] == len(long)
