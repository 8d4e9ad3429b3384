"""The pipeline on a small corpus: each stage's decisions take effect and clean documents stay."""

import random

import corpus_pipeline
from sourceweave.llm import feistel, piece_lattice


def text(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."


def test_pipeline(spark, tmp_path):
    item = text("item", 30)
    texts = {1: text(1), 2: text(2), 3: text(2), 4: "too short", 5: f"{text(5, 20)} {item}", 6: f"{text(6)} call 4111111111111111", 7: None, 8: "spam ham " * 40,
             9: text(1).replace(" ", "  ", 3)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(out) == [1, 2, 6]
    assert out[1].text == texts[1] and "4111111111111111" not in out[6].text and feistel.reveal(out[6].text) == texts[6]
    raw = piece_lattice.vocabulary()[1]
    assert all(b"".join(raw[x] for x in r.ids)[1:].decode() == r.text and r.n_tokens == len(r.ids) for r in out.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "pseudonyms", "encode"]


def test_stages_return_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        if name != "decontaminate":
            assert stage(spark, empty, "").count() == 0
        if name not in ("decontaminate", "encode"):
            assert stage(spark, empty, "").columns == list(corpus_pipeline.COLUMNS)
