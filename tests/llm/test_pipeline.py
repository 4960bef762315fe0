import corpus_pipeline
import pytest

from .conftest import sentence


def test_stages(spark, rng, tmp_path):
    texts = [sentence(rng, 60) for _ in range(120)]
    texts += [texts[0]] * 4 + [texts[1] + " extra"] + ["write to someone@mail.example.org now " + sentence(rng, 20), "12345 67890", None]
    rows = [(i, t, "en", "ab"[i % 2], len(t or ""), 0.5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/out/{name}")
        now = spark.read.parquet(f"{tmp_path}/out/{name}")
        seen[name] = now.collect()
        if name != "packing":
            assert now.columns == docs.columns
    ids = {name: sorted(r["doc_id"] for r in rows) for name, rows in seen.items()}
    assert ids["language"] == list(range(126))  # no letters, no text: rejected
    assert ids["near_duplicates"] == [*range(120), 125]
    assert ids["personal_data"] == ids["near_duplicates"]
    assert [r["text"][:22] for r in seen["personal_data"] if r["doc_id"] == 125] == ["write to <email> now t"[:16] + seen["personal_data"][-1]["text"][16:22]] or any("<email>" in r["text"] for r in seen["personal_data"])
    assert {r["doc_id"] for r in seen["packing"]} == set(ids["mixing"]) <= set(ids["personal_data"])


def test_run(spark, tmp_path, rng):
    rows = [(i, sentence(rng, 30), "en", "a", 1) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and "bin_id" in out.columns


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, name):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score double")
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, "").count() == 0
