import tracemalloc

import numpy as np

from lexspark.llm import textmodel, toxicity, training


def table_of(spark, texts: list[str]):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("bad" in t.split()), 0) for i, t in enumerate(texts)], "doc_id long, toxic int, quality int")
    return docs, labels


def test_driver_does_not_hold_the_features_of_the_sample(spark):
    rng = np.random.default_rng(1)
    words = np.array(["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (20_000, 9))])
    docs, labels = table_of(spark, [" ".join([*rng.choice(words, 4000), *(["bad"] if i % 3 == 0 else [])]) for i in range(150)])
    toxicity.fit(docs.limit(5), labels)  # what is imported and kept once
    tracemalloc.start()
    try:
        y, rows, _ = training.sample(docs, labels, "toxic", toxicity._features)
        w, _ = textmodel.fit_logistic(rows, y.astype(float), epochs=2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(rows.slots) > 1_500_000 and y.sum() > 20 and (w != 0).any()
    assert peak < 60e6, f"{peak / 1e6:.0f} MB for {len(rows.slots)} features"


def test_fit_on_files_in_parts_equals_fit_in_memory(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join([*rng.choice(["she", "men", "one", "two", "three", "bad", "good", "house"], rng.integers(0, 6)), f"own{i}"]) for i in range(600)] + [""]
    docs, labels = table_of(spark, texts)
    got = toxicity.fit(docs, labels)
    monkeypatch.setattr(textmodel, "PART", 40)
    parts = toxicity.fit(docs, labels)

    kept = {r.doc_id for r in docs.where(~training.held_out("doc_id")).collect()}
    order = [r.doc_id for r in docs.selectExpr("doc_id", "xxhash64(doc_id) h").orderBy("h").collect() if r.doc_id in kept]
    f = textmodel.WordFeatures()
    own = [f(texts[i]) for i in order]
    pairs = toxicity.counterfactuals([" ".join(textmodel.words_of(texts[i])) for i in order])
    rows = textmodel.Rows([s for s, _ in own], [v for _, v in own])
    w, b = textmodel.fit_logistic(rows, np.array([float("bad" in texts[i].split()) for i in order]), pairs)
    assert (got.weights == w.astype(np.float32)).all() and got.bias == b and (w[textmodel.rare(rows, 8)] == 0).all()
    assert (parts.weights == got.weights).all() and parts.bias == got.bias
