"""Every query with SQL against DuckDB, and the others against brute force."""

import glob
import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

from lexspark.functions.capcode import encode2
from lexspark.operators import candidates, setops, train
from lexspark.operators.encode import Encoder, register
from lexspark.operators.filters import Filter
from lexspark.plans.queries import QUERIES, SQL, vocabulary


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect(config={"memory_limit": "4GB"})
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(p: pd.DataFrame) -> list:
    return sorted(tuple(map(repr, r)) for r in p[sorted(p.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, spark, sf, duck):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours.astype(object)) == rows(theirs.astype(object)) or [tuple(map(str, r)) for r in sorted(ours[sorted(ours.columns)].astype(str).itertuples(index=False, name=None))] == [
        tuple(map(str, r)) for r in sorted(theirs[sorted(theirs.columns)].astype(str).itertuples(index=False, name=None))
    ]


def test_tokenize_counts(spark, sf):
    e = Encoder(vocabulary(spark, sf))
    got = {r.doc_id: r.n_tokens for r in QUERIES["tokenize_counts"](spark, sf).collect()}
    d = pd.read_parquet(f"{sf}/documents.parquet")
    assert all(got[i] == len(e.text(t)[0]) for i, t in zip(d.doc_id[:60], d.text[:60], strict=True)) and len(got) == len(d)


@pytest.mark.parametrize("mode", ["clean", "balanced", "consistent", "strict"])
def test_mining_modes(mode, spark, sf):
    keep, want = Filter(mode, 2), Counter()
    for t in pd.read_parquet(f"{sf}/benchmark.parquet").text:
        s = encode2(t)
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                b = s[i:j].encode()
                if len(b) > 16:
                    break
                if len(b) >= 2 and keep(b, s[j : j + 1].encode()):
                    want[b] += 1
    got = {bytes.fromhex(r.token): r.n for r in QUERIES[f"candidates_{mode}"](spark, sf).collect()}
    assert got == {k: n for k, n in want.items() if n >= 2}


def test_coverage_adds_up(spark, sf):
    used = QUERIES["token_coverage"](spark, sf).collect()
    d = pd.read_parquet(f"{sf}/documents.parquet")
    e = Encoder(vocabulary(spark, sf))
    assert sum(r.n for r in used) == sum(len(e.text(t)[0]) for t in d.text)


def test_training_is_reproducible(spark):
    docs = spark.createDataFrame([("the cat and the dog and the bird " * 3,), ("another thing and the other thing",)], "text string")
    found = [bytes(r.token) for r in candidates.mine(docs, high=6, min_occur=2).orderBy("token").collect()]
    a, b = (train.train(docs, found, 300, reserve=1, max_rounds=6, keep_trying=1) for _ in range(2))
    assert a.vocab.reverse == b.vocab.reverse and len(a.vocab) <= 300 and a.tokens == b.tokens
    assert a.tokens < sum(len(t) for t in ("the cat and the dog and the bird " * 3, "another thing and the other thing"))


def test_set_operations(spark):
    a = spark.createDataFrame([(bytearray(x),) for x in (b"ab", b"D cd", b"x<s>", b"q")], "token binary")
    b = spark.createDataFrame([(bytearray(x),) for x in (b"ab", b"zz")], "token binary")
    assert setops.union(a, b).count() == 5
    assert {(bytes(r.token), r.only_in) for r in setops.difference(a, b).collect()} == {(b"D cd", "a"), (b"x<s>", "a"), (b"q", "a"), (b"zz", "b")}
    assert {bytes(r.token) for r in setops.drop_marked_twins(a).collect()} == {b"ab", b"cd", b"x<s>", b"q"}
    special = spark.createDataFrame([(bytearray(b"<s>"),)], "token binary")
    assert {bytes(r.token) for r in setops.without_special(a, special).collect()} == {b"ab", b"D cd", b"q"}
    assert setops.add_missing(a, b, 1).count() == 5 and setops.fingerprint(a).first() == setops.fingerprint(a.repartition(3)).first()


def test_sql_functions(spark, sf):
    register(spark, vocabulary(spark, sf), "lx_")
    r = spark.sql("select lx_detokenize(lx_tokenize('The Cat sat')) s, size(lx_tokenize('The Cat sat')) n, lx_token_count('The Cat sat') c").first()
    assert r.s == "The Cat sat" and r.n == r.c
    assert spark.sql("select * from lx_token_spans('The Cat')").count() > 0 and spark.table("lx_vocab_meta").count() == 1
