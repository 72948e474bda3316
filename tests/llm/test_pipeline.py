"""The pipeline against plain versions of its stages."""

import corpus_pipeline
from tests.llm import brute


def test_pipeline(spark, sf_dir):
    import public_tokenizers
    import sentencepiece

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().sort_values("doc_id")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").toPandas()
    rows = list(zip(docs["doc_id"].tolist(), docs["text"].tolist(), strict=True))
    rows = [(d, text) for d, t in rows for _, kept, text in [brute.judge(t)] if kept]
    rows = [(d, text) for (d, t), lines in zip(rows, brute.dedup_lines([t for _, t in rows]), strict=True) if brute.words(text := "\n".join(lines)) or text == (t or "")]
    _, of = brute.near([t for _, t in rows])
    rows = [r for i, r in enumerate(rows) if of[i] == i]
    hit = brute.contaminated([t for _, t in rows], list(zip(items["item_id"], items["text"], strict=True)))
    rows = [r for r, found in zip(rows, hit, strict=True) if len(found) < 2]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    made = corpus_pipeline.run(spark, sf_dir).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["decoded"], r["ids"]) for r in made] == [(d, t, library.encode(t)) for d, t in rows]
    assert 0 < len(rows) < len(docs)
