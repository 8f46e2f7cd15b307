from collections import Counter

import corpus_pipeline
from helioframe.llm import queries
from tests.llm import brute


def test_stages(spark, sf, tmp_path):
    docs = queries.table(spark, sf, "documents")
    verdicts = {r.doc_id: r for r in queries.op9_quality(spark, sf).collect()}
    columns, kept = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing",
                                                      "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        assert name == "sharding" or docs.columns == columns
    assert {r.doc_id for r in kept["quality"]} == {k for k, r in verdicts.items() if r.kept}
    rows = sorted((r.doc_id, r.text) for r in kept["quality"])
    near = {rows[i][0] for i, (_, c) in enumerate(brute.near(rows)) if c == i}
    assert sorted(r.doc_id for r in kept["near_duplicates"]) == sorted(near)
    items = [tuple(r) for r in queries.table(spark, sf, "benchmark").select("item_id", "text").collect()]
    bad = {r[0] for r in brute.contamination([(r.doc_id, r.text) for r in kept["near_duplicates"]], items) if r[-1]}
    assert sorted(r.doc_id for r in kept["decontamination"]) == sorted(near - bad)
    copies = Counter(r.doc_id for r in kept["mixing"])
    assert set(copies) <= near - bad and max(copies.values()) <= 2
    shards = Counter(r.shard for r in kept["sharding"])
    assert sum(shards.values()) == len(kept["mixing"]) and max(shards.values()) - min(shards.values()) <= 1


def test_run_gives_the_last_stage(spark, sf):
    assert {"shard", "slot", "text"} <= set(corpus_pipeline.run(spark, sf).columns)


def test_repeated_rows_leave_one(docs_of):
    docs = docs_of([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (3, None)])
    from helioframe.llm.near_duplicates import one_of_each
    assert sorted(r.doc_id for r in one_of_each(docs).collect()) == [1, 3]


def test_null_and_repeated_ids_decide_for_no_other_row(spark, docs_of, tmp_path):
    item = " ".join(f"item{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, item), (None, "clean text one"), (None, "clean text two"), (4, item), (4, "clean text three"),
            (5, "clean text four")]
    docs = docs_of(rows)
    kept = corpus_pipeline.clean(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(r.text for r in kept.collect()) == sorted(t for _, t in rows if t != item)

    near = [" ".join(f"{k}w{i}" for i in range(60)) for k in range(3)]
    rows = [(None, near[0]), (None, near[0] + " more"), (None, "a lone text without an id or a partner"),
            (3, near[1]), (5, near[1] + " more"), (5, "another text that has no partner at all"),
            (None, near[2]), (7, near[2] + " more")]
    found = sorted((repr(r.doc_id), r.text) for r in corpus_pipeline.distinct(spark, docs_of(rows), "").collect())
    assert len(found) == 5 and sum(t.startswith("0w") for _, t in found) == 1
    assert {t for _, t in found if not t.startswith("0w")} == {rows[k][1] for k in (2, 3, 5, 7)}
