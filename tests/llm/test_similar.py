"""The near-dedup stage of the pipeline against brute-force Jaccard over all pairs."""

import numpy as np
import pandas as pd

import corpus_pipeline
from lexspark.llm import similar
from lexspark.llm.common import table

from .test_ops import edge_docs, empty
from .test_pipeline import brute_jaccard


def kept_of(spark, docs):
    return sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())


def test_stage_links_what_reaches_the_similarity(spark):
    rng = np.random.default_rng(8)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 5000, n)]
    base, texts = [word(n) for n in (60, 200, 400)], []
    license_ = word(40)
    for b in base:
        for changes in (0, 1, 1, 2, 3, 5, 8):  # a changed word costs five shingles
            w = b[:]
            for k in rng.integers(0, len(w), changes):
                w[k] = f"n{rng.integers(0, 10**6)}"
            texts.append(" ".join(w))
    texts += [" ".join(word(150) + license_) for _ in range(20)]  # a passage in many texts is no link
    texts += ["", None, "a b c", "A B c", "a b d"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = brute_jaccard(texts)
    assert kept_of(spark, docs) == np.flatnonzero(want == np.arange(len(texts))).tolist() and 0 < len(set(want[:21])) < 21


def test_stage_on_the_small_table(spark, sf):
    d = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id").reset_index(drop=True)
    want = brute_jaccard(list(d.text))
    assert kept_of(spark, table(spark, sf, "documents")) == d.doc_id[want == np.arange(len(d))].tolist()


def test_stage_edges(spark):
    docs = edge_docs(spark)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns and got.count() == len(set(brute_jaccard([r.text for r in docs.collect()])))
    assert corpus_pipeline.drop_near_duplicates(spark, empty(spark), "").count() == 0


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(9)
    ruled_out = 0
    for n in (1, 5, 40, 300, 3000):
        for share in (0.3, 0.6, 0.85, 0.9, 1.0):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[: int(share * len(a))], rng.integers(0, 2**63, n - int(share * n), dtype=np.uint64)]))
            link = 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
            maybe = bool(similar._may_reach([similar.sketch(a)], [similar.sketch(b)])[0])
            assert maybe or not link
            ruled_out += not maybe
    assert ruled_out >= 6 and similar.sketch(np.zeros(300, np.uint64)) == b"" and similar._may_reach([b""], [b"x"]).all()


def test_texts_are_read_again_without_a_shuffle(spark, monkeypatch):
    """Texts of candidates pass a map of wanted rows; neither a join nor a sort holds them."""
    plans = {}
    real = similar.stored
    monkeypatch.setattr(similar, "stored", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().toString()) and real(df, name))
    w = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(i, " ".join([*w[:-1], f"x{i % 3}"]), "en", "s", 1) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    assert kept_of(spark, docs) == [0]
    assert "MapInArrow" in plans["similar-sets"] and "Exchange" not in plans["similar-sets"]


def test_the_map_of_wanted_rows(spark):
    keys = np.concatenate([np.random.default_rng(11).integers(-(2**63), 2**63, 500), [0, -1, 63, 64, 2**63 - 1, -(2**63)]])
    got = similar._wanted(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    low = keys & (1 << similar.MAP_BITS) - 1
    assert len(got) * 64 == 1 << similar.MAP_BITS and (got[low >> 6] >> (low & 63) & 1).all() and np.bitwise_count(got.view(np.uint64)).sum() == len(set(low.tolist()))
    assert not similar._wanted(spark.createDataFrame([], "key long")).any()


def test_fingerprints_meet_through_the_trees(spark):
    """The SimHash step of the stage: classes are connected as by all pairs of fingerprints within the radius."""
    rng = np.random.default_rng(10)
    fps = rng.integers(0, 2**63, 60, dtype=np.uint64)
    for bits in (1, 4, 7, 8, 12):
        flip = [sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in range(40)]
        fps = np.concatenate([fps, fps[rng.integers(0, 60, 40)] ^ np.array(flip, np.uint64)])
    fps = np.concatenate([fps, fps[:3], np.array([0, 0], np.uint64)])
    for radius in (3, similar.RADIUS):
        lab = np.arange(len(fps))
        for i, j in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius), strict=True):
            lab[lab == max(lab[i], lab[j])] = min(lab[i], lab[j])
        names = [i.to_bytes(2, "big") for i in range(len(fps))]
        rows = list(zip(names, fps.view(np.int64).tolist(), strict=True))
        got = np.arange(len(fps))
        for r in similar.simhash_pairs(spark.createDataFrame(rows, "cls binary, fp long").repartition(3), radius).collect():
            i, j = int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")
            got[got == max(got[i], got[j])] = min(got[i], got[j])
        assert got.tolist() == lab.tolist() and 60 < len(set(lab.tolist())) < 240


def test_the_stage_asks_the_fingerprints(spark, monkeypatch):
    """Copies but for one word are candidates by their fingerprints; no pair is lost where no fingerprint is near."""
    w = [f"w{i}" for i in range(400)]
    texts = [" ".join(w), " ".join([*w[:200], "x", *w[201:]]), "a b c d e f", "u v"]
    seen = []
    real = similar.simhash_pairs
    monkeypatch.setattr(similar, "simhash_pairs", lambda classes: seen.append(real(classes)) or seen[-1])
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert kept_of(spark, docs) == [0, 2, 3] and seen[0].count() == 1


def test_workers_give_memory_back():
    import psutil

    own = psutil.Process().memory_info

    def batches():
        held = [bytes(3000) for _ in range(40_000)]
        keep, full = held[::400], own().rss
        del held
        yield full, keep

    ((full, _),) = similar._lean(batches())
    for i, _ in enumerate(similar._lean(iter([0, 1]))):
        assert i or own().rss < full - (60 << 20)
