"""The pipeline against a brute-force version on a small table."""

import numpy as np
import pandas as pd
import sentencepiece

import corpus_pipeline
from lexspark.llm import pieces, secrets, toxicity
from lexspark.llm.common import table

from .test_ops import RULES, WORD, brute_copies, edge_docs, empty


def brute_jaccard(texts):
    """The least row of each group linked at Jaccard >= 0.8 of five-word shingle sets, over all pairs."""
    sets = []
    for t in texts:
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(t or "")]
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    lab = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if lab[i] != lab[j] and 5 * len(a & b) >= 4 * len(a | b):
                lab = [min(lab[i], lab[j]) if x in (lab[i], lab[j]) else x for x in lab]
    return np.array(lab)


def test_pipeline(spark, sf):
    d = pd.read_parquet(f"{sf}/documents.parquet")
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    d = d[[model.score(t) < toxicity.THRESHOLD for t in d.text]].sort_values("doc_id").reset_index(drop=True)
    d = d[brute_jaccard(d.text) == np.arange(len(d))].reset_index(drop=True)
    found = [(i, m.start(), m.end(), m[g], d.source[i]) for i in range(len(d)) for _, p, g, least in RULES for m in p.finditer(d.text[i]) if len(m[g]) >= least]
    seen = pd.DataFrame(found, columns=["i", "a", "b", "v", "o"]).groupby("v")
    owners, places = seen.o.nunique().to_dict(), seen.i.nunique().to_dict()
    texts = list(d.text)
    for i in range(len(d)):
        at, out, t = 0, "", d.text[i]
        for a, b in sorted({(a, b) for k, a, b, v, _ in found if k == i and owners[v] <= secrets.MOST_OWNERS and places[v] <= secrets.MOST_REPOSITORIES and len(set(v)) >= secrets.LEAST_CHARACTERS and not __import__("re").search(secrets.PLACEHOLDER, v)}):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        texts[i] = out + t[at:] if at else t
    copies = brute_copies([(int(i), x, len(t.encode().split())) for i, x, t in zip(d.doc_id, d.source, texts, strict=True)])
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = [(int(i), sp.encode(t, add_bos=True, add_eos=True)) for i, t, n in zip(d.doc_id, texts, copies, strict=True) for _ in range(n)]
    got = [(r.doc_id, r.token_ids) for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(got) == sorted(want)


def test_stages_keep_columns(spark, sf):
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_edge_tables_through_every_stage(spark, sf):
    """Nulls, empty and long texts, ties, repeated rows and clashing names, and an empty table."""
    for docs in (edge_docs(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).columns == ["doc_id", "source", "n_tokens", "token_ids"]


def test_drop_toxic_without_labels(spark, tmp_path):
    empty(spark, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = edge_docs(spark)
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).columns == docs.columns
