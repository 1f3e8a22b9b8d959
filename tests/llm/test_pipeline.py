"""The pipeline against a brute-force version, and its registration."""

import corpus_pipeline
from marketlab.llm import piece_lattice, quality_rules, secret_scan, source_mix
from tests.llm.test_operators import brute_classes


def test_pipeline(spark, docs, tmp_path):
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(0, 90)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    out = corpus_pipeline.run(spark, path)
    assert out.columns == [*docs.columns, "ids"] and [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules"

    chain = quality_rules.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    kept = {r["doc_id"] for r in quality_rules.judge(docs, chain).collect() if r["kept"]}
    rows = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] in kept}
    classes = brute_classes([(i, r["text"]) for i, r in rows.items()])
    left = spark.createDataFrame([tuple(r) for i, r in rows.items() if classes[i][1] == i], docs.schema)
    want = source_mix.apply_mix(secret_scan.redact(left))
    pieces = piece_lattice.Pieces.load()
    assert sorted((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()) == sorted((r["doc_id"], r["text"]) for r in want.collect())
    assert all(r["text"] == r["decoded"] for r in piece_lattice.decode(out, pieces).collect())


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
