"""Round trips of the file formats and the data sources."""

import json

import pytest

from lexspark.functions.display import from_text, read_token, to_text, write_token
from lexspark.operators import corpus
from lexspark.operators.encode import Encoder
from lexspark.operators.vocab import Vocab
from lexspark.sources import token_file, vocab_file, yaml_file

V = Vocab.new([b"the", b" the", b"ing", b"\xffa", b'q"\n', b" a"], [b"<s>"], capcode=2, reserve=8, unk=True, scores={b"the": 0.5, b"ing": 0.1})


def same(a: Vocab, b: Vocab) -> bool:
    text = "The inG <s> the thing"
    return a.reverse == b.reverse and a.unk == b.unk and Encoder(a).text(text) == Encoder(b).text(text)


def test_vocab_file(tmp_path, spark):
    v = V.delete_tokens(b"ing")
    back = vocab_file.loads(vocab_file.dumps(v))
    assert same(v, back) and vocab_file.dumps(back) == vocab_file.dumps(v) and [t for t, _, _ in back.deleted] == [b"ing"]
    p = str(tmp_path / "v.vocab")
    vocab_file.save(v, p)
    assert same(vocab_file.load(spark, p), v)
    h = vocab_file.headers(spark, p).first()
    assert (h["capcode"], h["charset"], h["vocab_size"], h["unk_id"]) == (2, 1, len(v), v.unk)
    spark.dataSource.register(vocab_file.VocabSource)
    assert spark.read.format("lexvocab").load(p).count() == len(v)
    with pytest.raises(ValueError):
        vocab_file.loads(vocab_file.dumps(v) + b"x")


def test_golden_file():
    v = Vocab.new([" ", "a", "b", "ab"], charset=0)
    data = vocab_file.dumps(v)
    assert data[:8] == bytes([0, 0, 0, 5, 0, 0, 0, 0]) and data[8:11] == b"\xff\xff\xff" and data[11] == 4
    assert Encoder(vocab_file.loads(data)).encode(b"ab a z") == ([3, 0, 1, 0], 1)


@pytest.mark.parametrize("scores,special", [(None, []), ([1.0, 2.0, 3.0], []), ([1.0, 2.0, 3.0], [b"<s>"])])
def test_token_file(scores, special, tmp_path, spark):
    t = token_file.TokenFile(2, 1, 1, 2, 0, [b"ab", b"a", b"abc"], scores, special)
    back = token_file.loads(token_file.dumps(t))
    assert back.tokens == [b"a", b"ab", b"abc"] and back.special == special and (back.scores is None) == (scores is None)
    (tmp_path / "120_3.tok").write_bytes(token_file.dumps(t))
    (tmp_path / "99_3.tok").write_bytes(token_file.dumps(t))
    assert token_file.best_result(spark, str(tmp_path)).endswith("/99_3.tok") and token_file.result_score("99_3.tok") == 99
    assert token_file.read(spark, str(tmp_path / "99_3.tok")).count() == 3 + len(special)


def test_token_file_round_trip():
    assert token_file.to_vocab(token_file.loads(token_file.dumps(token_file.of_vocab(V))), unk=True).reverse == V.reset_ids().reverse


def test_yaml():
    assert same(yaml_file.loads(yaml_file.dumps(V)), V) and same(yaml_file.loads(yaml_file.dumps(V, by_score=True)), V)
    doc = 'charset: "utf-8"\ncapcode: 0\nunk: true\ntokens:\n  - token:   "ab"   # c\n    id: 5\n  - token: "XHexEncode{ff}"\nspecial:\n  - token: "<S>"\ndelete:\n  - token: "zz"\n'
    v = yaml_file.loads(doc)
    assert v.token_to_id(b"ab") == 5 and v.token_to_id(b"\xff") is not None and v.counts()["special"] == 1
    w = yaml_file.modify(v, "delete:\n  - id: 5\n")
    assert w.token_to_id(b"ab") is None


def test_token_strings():
    for b in (b"a", b'"\\\n', b"\xff", "é".encode(), b"\x01"):
        assert read_token(yaml_file._scalar(write_token(b))) == b
    assert from_text("é", 2) == b"\xe9\x00" and to_text(b"\xe9\x00", 2) == "é"


def test_import():
    v = yaml_file.import_json_vocab(json.dumps({"a": 0, "Ġb": 1, "Ċ": 2}))
    assert v.reverse == {0: b"a", 1: b" b", 2: b"\n"}
    w = yaml_file.import_json_vocab(json.dumps({"<0x0A>": 3, "▁b": 4}), "pieces")
    assert w.reverse == {3: b"\n", 4: b" b"}


def test_corpus_readers(tmp_path, spark):
    (tmp_path / "a.jsonl").write_text('{"text": "one"}\n{"other": 1}\n')
    spark.createDataFrame([("x", None), (None, "y")], "content string, body string").write.parquet(str(tmp_path / "b.parquet"))
    assert sorted(r.text for r in corpus.read_any(spark, str(tmp_path)).collect()) == ["one", "x", "y"]
    (tmp_path / "s.json").write_text('{"special": ["<a>", "<b>"]}')
    assert corpus.read_special(spark, str(tmp_path / "s.json")) == ["<a>", "<b>"]
