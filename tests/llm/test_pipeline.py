"""The corpus pipeline over a small table: each stage's decisions take effect, and clean documents stay."""

import corpus_pipeline
from tests.llm.test_operators import prose


def test_stages(spark, tmp_path):
    clean = [(i, prose(120, 700 + i), "en", f"s{i % 3}", 0) for i in range(20)]
    junk = [(100, "XX!! YY!! " * 60, "en", "s0", 0), (101, "###$$$ *** " * 60, "en", "s0", 0), (102, "", "en", "s0", 0), (103, None, None, None, None)]
    copy = [(200, clean[0][1], "en", "s1", 0)]
    near = [(201, clean[1][1].replace(" ", " ", 1) + " end", "en", "s1", 0)]
    spark.createDataFrame(clean + junk + copy + near, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if k < 4:
            assert docs.columns == columns
    good = {r[0] for r in clean}
    assert ids[0] == good | {200, 201}
    assert ids[1] == good | {201}
    assert ids[2] == good
    assert ids[3] < good and ids[3] == ids[4]
    assert all(r["round_trip"] for r in docs.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids[4])
