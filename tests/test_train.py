"""Training reaches the size it was asked for."""

from lexspark.operators import candidates, train
from lexspark.operators.encode import Encoder
from lexspark.operators.vocab import Vocab


def test_a_round_limit_does_not_leave_candidates(spark):
    docs = spark.createDataFrame([("the cat and the dog and the bird saw one another in the garden " * 2,), ("another thing and the other thing of the gardener",)], "text string")
    found = [bytes(r.token) for r in candidates.mine(docs, high=8, min_occur=2).collect()]
    out = train.train(docs, found, 290, reserve=1, max_rounds=2, keep_trying=1)
    assert len(found) > 100 and len(out.vocab) <= 290 and out.tokens > 0 and any(n > 0 for n in out.history[-1])


def test_a_resumed_run_equals_an_unbroken_one(spark, tmp_path):
    docs = spark.createDataFrame([("the cat and the dog and the bird saw one another in the garden " * 2,), ("another thing and the other thing of the gardener",)], "text string")
    found = [bytes(r.token) for r in candidates.mine(docs, high=8, min_occur=2).collect()]
    run = lambda folder: train.train(docs, found, 60, max_rounds=1, keep_trying=1, folder=folder, every=2)
    whole = run(None)
    first = run(str(tmp_path / "a"))
    again = run(str(tmp_path / "a"))  # goes on from the newest table
    assert first.vocab.reverse == whole.vocab.reverse == again.vocab.reverse and len(whole.vocab) <= 60
    assert {e.token for e in whole.vocab.entries if len(e.token) == 1} >= {bytes([b]) for b in set(b"the cat") - set(b"".join(found))}


def test_scores_by_brute_force(spark):
    texts = ["the cat saw the other cat", "a cat, the dog"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    vocab = Vocab.new([b"the", b" the", b"cat", b" cat", b" ", b"t", b"h", b"e", b"a"], charset=0)
    (total,), (covered,), (lost,) = train.score_trials(train.strips(docs), [vocab])
    ids = [Encoder(vocab).text(t) for t in texts]
    assert total == sum(len(i) + m for i, m in ids) and lost == set(b"sawordg,") - set(b"a")
    assert covered[b" cat"] == 4 * sum(i.count(vocab.token_to_id(b" cat")) for i, _ in ids)
