"""The decontamination stage on passages of one benchmark item."""

import corpus_pipeline


def test_a_passage_of_one_item_takes_its_document(spark, tmp_path):
    items = [(f"i{k}", " ".join(f"q{k}w{j}" for j in range(20))) for k in range(3)] + [("short", "only five words stand here"), (None, "a null item of eight words counts for nothing")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    fill = " ".join(f"x{j}" for j in range(30))
    passage = " ".join(items[0][1].split()[4:12])
    texts = [
        fill, f"{fill} {items[0][1]} {fill}", f"{fill} {passage.upper()}, {fill}", f"{items[1][1]} {fill} {items[2][1]}", f"{fill} only five words stand here",
        f"{fill} {' '.join(passage.split()[:7])} {fill}", "only five words stand", items[4][1], None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in made.collect()) == [0, 5, 6, 7, 8, 9]
