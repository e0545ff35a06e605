import oracle_check
import pytest
from conftest import SF

import __spark_entry__
import corpus_pipeline
from pairlab.llm import queries
from tests.llm.test_near_text import brute_kept


def test_registered():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert names["pipeline"] is corpus_pipeline.run
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    con = oracle_check.connect(SF)
    text, _, _, ok = oracle_check.compare(spark, con, name, queries.QUERIES[name], queries.SQL[name], SF)
    assert ok, text


def test_stages(spark, frame, odd):
    """Each stage's decision takes effect on what the one before kept."""
    from pairlab.llm import decontaminate, language_id, line_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "near_dedup", "decontamination", "packing"
    ]
    before = docs.persist()
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).persist()
        if name == "packing":
            texts = {r.doc_id: r.n for r in after.groupBy("doc_id").sum("length").toDF("doc_id", "n").collect()}
            assert texts.keys() == {r.doc_id for r in before.select("doc_id").collect()}
            full = after.groupBy("sequence_id").sum("length").toDF("s", "n")
            assert full.where("n > 4096").count() == 0
            break
        assert after.columns == columns
        ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
        if name == "language_id":
            kept = language_id.identify(before).where("NOT rejected")
        elif name == "line_dedup":
            kept = before
            want = {r.doc_id: r.text for r in line_dedup.remove_shared_lines(before).collect()}
            assert {r.doc_id: r.text for r in after.collect()} == want
            assert all(r.n_chars == len(r.text) for r in after.collect())
        elif name == "near_dedup":
            assert ids(after) == brute_kept([(r.doc_id, r.text, "") for r in before.collect()])
            before = after
            continue
        else:
            items = spark.read.parquet(f"{SF}/benchmark.parquet")
            kept = decontaminate.contamination(before, items).where("NOT contaminated")
        assert ids(after) == ids(kept)
        before = after


def test_odd_documents(spark, frame, odd, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    spark.createDataFrame([(1, "ten words that no document here has in it at all")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (odd, []):
        frame(rows).select(*columns).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        got = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert bool(got) == bool(rows)
