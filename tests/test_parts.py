"""Kernels over large batches: bounded parts, and the same results as row by row."""

from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import types as T

from lexspark.operators import encode as E
from lexspark.operators.vocab import Vocab
from lexspark.plans import queries as Q

VOCAB = Vocab.new([b" there", b"the", b"re", b" the", b"xthe", b"x", b" x", b" xy", b" cat", b"D the"], capcode=2, reserve=1)
ODD = [None, "", "xthere xthere", "The Cat x1 THERE", "é€😀", "x" * 7, None, " "]


class Captured:
    """A DataFrame that hands back the function given to mapInArrow."""

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return run


def plain(texts):
    e = E.Encoder(VOCAB)
    size = {i: len(t) for i, t in VOCAB.reverse.items()}
    for k, t in enumerate(texts):
        ids = e.text(t or "")[0]
        for p, (i, (a, n)) in enumerate(zip(ids, E.places(ids, size, VOCAB.delete_id), strict=True)):
            yield k, p, i, a, n


def test_spans_hold_parts_of_a_batch(spark):
    texts = ODD * 40 + ["xthere The cat " * 60] * 1000
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    out = list(E.spans(Captured(), "text", SimpleNamespace(value=VOCAB), ["doc_id"])(iter([batch, batch.slice(0, 8)])))
    assert max(b.num_rows for b in out) <= 300_000  # before: all tokens of the batch, as lists of numbers
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [*plain(texts), *plain(texts[:8])]


def test_coverage_is_the_sum_of_spans(spark):
    n, covered = Counter(), Counter()
    for _, _, i, _, size in plain(ODD * 5):
        n[i] += 1
        covered[i] += size
    df = spark.createDataFrame([(t,) for t in ODD * 5], "text string").repartition(3)
    rows = E.coverage(df, "text", E.share(spark, VOCAB)).groupBy("id").sum("n", "bytes").collect()
    assert {r.id: tuple(r)[1:] for r in rows} == {i: (n[i], covered[i]) for i in n} and len(rows) == len(n)


def test_worst_tokens_mine_once(spark, sf, monkeypatch):
    made = []
    monkeypatch.setattr(Q, "vocabulary", lambda *a: made.append(a) or VOCAB)
    got = [tuple(r) for r in Q.worst_tokens(spark, sf).collect()]
    used = {r.id: r.bytes_covered for r in Q.token_coverage(spark, sf).collect()}
    assert len(made) == 2  # one for each query
    info = VOCAB.tables(spark)[3].where("type = 0").collect()
    assert got == sorted(((r.id, bytes(r.token).hex().upper(), used.get(r.id, 0)) for r in info), key=lambda r: (r[2], r[0]))[:100]


def test_step_tables_are_as_wide_as_the_bytes_in_tokens(monkeypatch):
    e = E.Encoder(VOCAB)
    data = e.model("xthere xthere The Cat other there " * 300)
    assert len(e.trie.dense) <= 128 * len(e.trie.token)  # before: 512 columns, most of them never read
    ids = e.encode(data)
    monkeypatch.setattr(E, "DENSE", 0)  # the hash table of large vocabularies
    plain_table = E.Encoder(VOCAB)
    assert plain_table.trie.dense is None and plain_table.encode(data) == ids


def test_windows_meet(monkeypatch):
    e = E.Encoder(VOCAB)
    texts = [e.model(t or "") for t in ODD * 30]
    whole = e.encode_many(texts)
    monkeypatch.setattr(E, "WINDOW", 5)
    assert all((a == b).all() for a, b in zip(whole, e.encode_many(texts), strict=True))


def test_decoding_keeps_nulls_and_skips_unknown_ids(spark):
    ids = [None, [], [VOCAB.token_to_id(b" there"), 1 << 20, None]]
    odd = spark.createDataFrame([(x,) for x in ids], "ids array<int>").select(Q.D.detokenize_udf(E.share(spark, VOCAB))("ids"))
    assert [r[0] for r in odd.collect()] == [None, "", " there"]  # before: an error at a null id


def test_detokenize_has_one_python_step_and_parts(spark, sf, monkeypatch):
    monkeypatch.setattr(Q, "vocabulary", lambda *a: VOCAB)
    plan = Q.detokenize(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan  # before: two steps, and the ids went through the JVM
    df = spark.createDataFrame([(k, t) for k, t in enumerate(ODD * 3)], "doc_id long, text string").repartition(2)
    assert {tuple(r) for r in Q.D.round_trip(df, "text", E.share(spark, VOCAB)).collect()} == set(enumerate(ODD * 3))


def test_counts_are_those_of_the_ids(spark):
    v = E.share(spark, VOCAB)
    df = spark.createDataFrame([(t,) for t in ODD * 3], "text string")
    rows = df.select(E.tokenize(df.text, v)["n_tokens"].alias("a"), E.count_tokens(df.text, v).alias("b"), E.tokenize(df.text, v)["tokens"].alias("ids")).collect()
    assert all(r.a == r.b == (None if r.ids is None else len(r.ids)) for r in rows)


def test_packed_ids_by_kernel_and_by_expression(spark, sf):
    v = E.share(spark, VOCAB)
    df = spark.createDataFrame([(t,) for t in ODD], "text string")
    for width in (2, 3, 4):
        rows = df.select(E.serialize_col(E.tokenize(df.text, v)["tokens"], width).alias("a"), E.tokenize_serialized(df.text, v, width).alias("b")).collect()
        assert all(r.a == r.b for r in rows)
    ids = spark.createDataFrame([([0, 255, 256, 65535, 65536, 2**24 - 2],)], "ids array<int>")
    assert bytes(ids.select(E.serialize_col(ids.ids, 3)).first()[0]) == E.serialize([0, 255, 256, 65535, 65536, 2**24 - 2], 3)
    plan = Q.serialize_u16(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "transform(" not in plan  # before: each id a row of strings in the JVM
