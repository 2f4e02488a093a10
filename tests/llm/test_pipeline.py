import random

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_neardup import components_by_hand
from tests.llm.test_text_ops import dedup_by_hand


def test_stages_against_brute_force(spark, tmp_path, docs):
    rng = random.Random(3)
    syllables = ["ka", "lo", "mi", "ren", "tis", "vor", "an", "el"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    common = "this licence line is long enough and stands in many documents"
    texts, labels = {}, []
    for i in range(160):
        body = [" ".join(word() for _ in range(12)) for _ in range(6)]
        toxic = i % 5 == 0
        if toxic:
            body = [f"{b} idiot moron" for b in body]
        if i % 7 == 1:
            body.append(common)
        texts[i] = "\n".join(body)
        labels.append((i, int(toxic), 1))
    texts[200] = texts[1]
    texts[201] = texts[2] + " more"
    texts |= {300: None, 301: "", 302: common}
    docs(texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    read = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "packing"]

    one = stage["toxicity"](spark, read, sf)
    assert one.columns == read.columns
    kept = {r["doc_id"]: r["text"] for r in one.collect()}
    assert set(texts) - set(kept) == {i for i in range(160) if i % 5 == 0} and all(kept[i] == texts[i] for i in kept)

    two = stage["line_dedup"](spark, docs(kept), sf)
    by_hand = {i: t for i, (t, n, d) in dedup_by_hand(kept, 40, 5).items() if not d or t.strip()}
    got = {r["doc_id"]: r["text"] for r in two.collect()}
    assert two.columns == read.columns and {i: t or "" for i, t in got.items()} == by_hand

    three = stage["near_dedup"](spark, docs(got), sf)
    stay = {i for i, (_, c) in components_by_hand(got, 5, 80).items() if c == i}
    assert three.columns == read.columns and {r["doc_id"] for r in three.collect()} == stay

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in pieces} == stay
    for i in stay:
        mine = sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["start"])
        assert np.frombuffer(b"".join(r["ids"] for r in mine), "<u4").tolist() == [*library.encode(got[i] or "", add_special_tokens=False).ids, 1]


def test_empty_table(spark, tmp_path, docs):
    docs({}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).where(F.lit(True)).count() == 0
