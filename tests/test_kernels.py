"""Golden cases and properties of the byte-level kernels."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexspark.functions import capcode as cap
from lexspark.functions import charclass as cc
from lexspark.functions.normalize import normalize_text, to_model, to_model_once
from lexspark.operators.decode import StreamDecoder, decode
from lexspark.operators.encode import Encoder, deserialize, serialize
from lexspark.operators.filters import Filter
from lexspark.operators.vocab import Patch, Vocab, describe, order_key, policy_bytes
from lexspark.schema import NORM_FLAGS, norm_flags, norm_names

TINY = Vocab.new([" ", "a", "b", "ab"], charset=0)


def test_golden():
    e = Encoder(TINY)
    assert e.encode(b"ab a z") == ([3, 0, 1, 0], 1)
    assert decode([3, 0, 1, 0], TINY) == b"ab a "
    assert serialize(e.encode(b"ab")[0], 2) == b"\x03\x00" and deserialize(b"\x03\x00", 2) == [3]
    assert TINY.token_to_id(b"ab") == 3 and TINY.id_to_token(3) == b"ab"
    d = StreamDecoder(TINY)
    assert d.decode([3, 0, 1]) == b"ab a" and d.decode([0]) == b" " and d.flush() == b""


@pytest.mark.parametrize("text,coded", [("hello", "D hello"), (" hello", " hello"), ("Hello", "DC hello"), (" Hello", "C hello"), (" HELLO", "W hello"), ("HELlo", "DC hDC eDC llo"), ("x1", "D xD 1"), ("", ""), ("don't", "D don't")])
def test_capcode_examples(text, coded):
    assert cap.encode2(text) == coded and cap.Decoder2().decode(coded) == text


plain = st.text(st.characters(codec="utf-8", exclude_categories=("Lt", "Lm", "Lo", "Cs"), max_codepoint=0x24F, exclude_characters="ıİŉǰſ\x7fŁ"), max_size=60)


@settings(max_examples=200, deadline=None)
@given(plain)
def test_capcode_round_trip(s):
    s = unicodedata.normalize("NFD", "".join(c for c in s if c.lower().upper() == c.upper() and len(c.upper()) == 1 and len(c.lower()) == 1 and (c.isupper() is False or c.lower().upper() == c)))
    assert cap.Decoder2().decode(cap.encode2(s)) == s
    assert cap.Decoder1().decode(cap.encode1(s)) == s


TOKENS = [b"D the", b"the", b" the", b" th", b"er", b"there", b" there", b"C h", b"W ", b"ing", b" a", b". ", b"D ", b"ab"]
FULL = {level: Vocab.new(TOKENS, capcode=level, reserve=1) for level in (0, 1, 2)}


@settings(max_examples=150, deadline=None)
@given(st.text("theraing THE.é \n1b", max_size=80), st.integers(1, 7))
def test_encode_decode(s, step):
    for v in FULL.values():
        ids, missing = Encoder(v).text(s)
        assert missing == 0 and decode(ids, v).decode() == s
        d = StreamDecoder(v)
        assert b"".join(d.decode(ids[i : i + step]) for i in range(0, len(ids), step)) + d.flush() == s.encode()


@given(st.lists(st.integers(0, 2**24 - 2), max_size=40))
def test_serialize(ids):
    assert deserialize(serialize(ids, 3), 3) == ids and deserialize(serialize(ids, 4), 4) == ids


def test_forward_delete_counts_both_tokens():
    v = Vocab.new([b" there", b"the", b"re", b" the", b"xthe", b"x", b" x", b" xy"], capcode=2, reserve=1)
    e = Encoder(v)
    ids, _ = e.text("xthere xthere")
    assert decode(ids, v) == b"xthere xthere"


def test_unk_and_missing():
    v = Vocab.new(["a", "b"], charset=0, unk=True)
    assert v.unk == 2 and Encoder(v).encode(b"azb") == ([0, 2, 1], 1)
    assert Encoder(v.disable_unk()).encode(b"azb") == ([0, 1], 1)
    full = Vocab.new([bytes([i]) for i in range(256)], unk=True)
    assert full.unk is None  # every byte has a token


def test_whole_word_rule():
    v = Vocab.new([b" the", b" cat", b" ", b"t", b"h", b"e", b" a", b" b", b" c", b" d"], capcode=0, reserve=8)
    assert v.begin[32] == 12
    assert decode(Encoder(v).encode(b" the cat the")[0], v) == b" the cat the"
    assert Encoder(v).encode(b" the cat")[0] == [v.token_to_id(b" the"), v.token_to_id(b" cat")]


def test_order_and_ids():
    v = Vocab.new([b"bb", b"a", b"aaa", b"b", b"\xff"], charset=0)
    assert [e.token for e in v.entries] == sorted([b"bb", b"a", b"aaa", b"b", b"\xff"], key=order_key) and [e.id for e in v.entries] == [0, 1, 2, 3, 4]
    w = v.delete_tokens(b"a").add_tokens(b"cc")
    assert w.token_to_id(b"bb") == v.token_to_id(b"bb") and w.token_to_id(b"cc") == 0  # the gap is filled
    assert w.reset_ids().reverse == {i: t for i, t in enumerate(sorted(w.reverse.values(), key=order_key))}


def test_edits():
    v = Vocab.new([b"ab", b"abc", b"<x>y", b"a"], charset=0, scores={b"ab": 3.0, b"abc": 1.0, b"<x>y": 2.0})
    s = v.add_special_tokens(b"<x>")
    assert s.token_to_id(b"<x>y") is None and s.counts()["special"] == 1 and (b"<x>y", v.token_to_id(b"<x>y"), 2.0) in s.deleted
    small = v.resize(3)
    assert small.token_to_id(b"abc") is None and len(small) == 3
    assert small.resize(4).token_to_id(b"abc") is not None and not small.resize(4).deleted
    assert v.delete_ids(v.token_to_id(b"ab")).token_to_id(b"ab") is None
    assert v.modify(Patch(ids={b"abc": 77})).token_to_id(b"abc") == 77


def test_duplicates_share_ids():
    v = Vocab.new([b"the", b"x"], capcode=2, reserve=1)
    dup = [e for e in v.entries if e.dup and e.token == b"D the"]
    assert dup and dup[0].id == v.token_to_id(b"the") and v.reverse[dup[0].id] == b"the"


def test_flags():
    assert describe(b" the", 0)[0] == 4 | 32 | 1 | 128 and describe(b" the", 0)[1] == 1
    assert describe(b"the", 0)[0] == 2 | 1 | 128
    assert describe(b" the cat", 0)[1] == 2 and describe(b" the cat", 0)[3] == 2
    assert describe(b"D", 2)[0] & 16 and describe(b"D", 2)[0] & 8


def test_policies():
    assert len(policy_bytes(1, 0)) == 256 and len(policy_bytes(1, 2)) == 233 and 127 in policy_bytes(8, 1)


def test_normalize_order():
    assert normalize_text("  A  “b”\r\n", norm_flags("collapse newlines quotemarks trim leadingspace lowercase")) == ' a "b"'
    assert normalize_text("É", NORM_FLAGS["accents"]) == "E" and normalize_text("é", 1) == "é"
    assert norm_names(norm_flags("nfd unixlines")) == "NFD UnixLines"
    assert to_model_once(b"D x", 0, 2) == b"D x" and to_model(b"X", 0, 2) == b"DW x" and to_model(b"Xy", 0, 2) == b"DC xy"


def test_incomplete_tail():
    for c in ("é", "€", "😀"):
        b = c.encode()
        assert [cc.incomplete_tail(b[:k]) for k in range(1, len(b))] == list(range(1, len(b))) and cc.incomplete_tail(b) == 0
    assert cc.incomplete_tail_utf16("😀".encode("utf-16-le")[:2]) == 2 and cc.size_in_bytes("10MB") == 10_000_000


@pytest.mark.parametrize("mode,good,bad", [
    ("clean", [b" hello", b"a\n\n", b"the cat"], [b"a  b", b"hello "]),
    ("balanced", [b" hello", b"the"], [b"a  b", b"hello "]),
    ("consistent", [b" hello", b" it's", b"12", b"()", b"the"], [b"a1", b" a(", b"1a", b"hello "]),
    ("strict", [b" hello", b"12", b"()", b"the"], [b"a1", b" a.b", b"1a", b" hello "]),
])
def test_filters(mode, good, bad):
    f = Filter(mode, capcode=2)
    assert [t for t in good if not f(t, b"x")] == [t for t in good if mode in ("balanced",) and False]
    assert not [t for t in bad if f(t, b".")]


def test_filter_options():
    with pytest.raises(ValueError):
        Filter("strict", capcode=0)
    with pytest.raises(ValueError):
        Filter("clean", capcode=2, words=2)
    assert not Filter("consistent", 2, words=2)(b" the cat sat on", b".")


def test_fingerprint():
    a, b = Vocab.new(["a", "b", "ab"], charset=0), Vocab.new(["ab", "b", "a"], charset=0)
    assert a.fingerprint() == b.fingerprint() != a.add_tokens(b"ba").fingerprint() and a.add_tokens(b"ba").delete_tokens(b"ba").fingerprint() == a.fingerprint()


def test_bad_bytes():
    assert cc.runes(b"\xff" * 3000 + "é".encode())[-2:] == [(cc.BAD, 1), ("é", 2)]


class PlainEncoder:
    """The rules of the encoder one place after another, with nothing but slices and a dictionary."""

    def __init__(self, v):
        self.v, self.at = v, {e.token: e for e in v.entries}

    def longest(self, b):
        return next(((self.at[b[:n]], n) for n in range(min(len(b), self.v.max_len), 0, -1) if b[:n] in self.at), (None, 0))

    def encode(self, b):
        v, out, missing, i = self.v, [], 0, 0
        cls = lambda k: v.begin[b[k] if k < len(b) else 0]
        while i < len(b):
            e, n = self.longest(b[i:])
            lent = 0
            if e is None:
                out += [] if v.unk is None else [v.unk]
                i, missing = i + 1, missing + 1
                continue
            while e is not None:
                best = None
                if i + n < len(b) and not (e.flag & 32 and cls(i + n) == 12):
                    tries = [(e, n)]
                    for k, size in ((e.alt, e.alt_len), (e.alt2, e.alt2_len)):
                        tries += [] if k is None else [(v.entries[k], size - lent)]
                    for rescue in (0, 1):
                        for no, (x, size) in enumerate(tries):
                            y, more = self.longest(b[i + size :])
                            if y is None:
                                continue
                            if rescue:
                                if v.delete_id is None or not y.flag & 2 or cls(i + size + more) != 1 or y.n_words:
                                    continue
                                z, with_space = self.longest(b" " + b[i + size : i + size + v.max_len - 1])
                                if z is None or with_space <= more + 1:
                                    continue
                                y, more = z, with_space - 1
                            nb, w1 = cls(i + size + more), x.n_words - lent
                            score = size + more + (x.flag >> 7) + (y.flag >> 7) + max(0, w1 - 1) + max(0, y.n_words - 1) + (nb >> 2 & 1) + 100 * (w1 + y.n_words + (nb >> 3))
                            score -= 100 * (x.flag >> 3 & 1 & y.flag >> 4) + 3 * (y.flag & 1 & nb)
                            score += -103 * (x.flag & 1) - 1 if rescue else (y.flag >> 2 & 1) - 103 * (x.flag & 1 & y.flag >> 1)
                            if no:
                                score -= 100 if size + more < n else 10000 if size + more == n else 0
                            if best is None or score > best[0]:
                                best = score, x, size, y, more, rescue
                if best is None:
                    out.append(e.id)
                    i, e = i + n, None
                else:
                    _, x, size, e, n, lent = best
                    out += [x.id, v.delete_id] if lent else [x.id]
                    i += size
        return out, missing


def test_encoder_against_plain_rules():
    import random

    rng = random.Random(3)
    words = ["the", "there", "other", "he", "re", "then", "Cat", "x1", "a-b", "it's", "é", "42", "  ", "\n", ", ", "THE"]
    texts = ["".join(rng.choice([" ", " ", ""]) + rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    for level in (0, 1, 2):
        b = [to_model(t.encode(), 0, level) for t in texts]
        grams = sorted({x[i : i + n] for x in b for i in range(len(x)) for n in (1, 2, 3, 4, 5, 7, 9)})
        for size, unk in ((60, True), (400, False)):
            v = Vocab.new(rng.sample(grams, min(size, len(grams))), capcode=level, unk=unk, reserve=8 * (size > 100))
            fast, plain = Encoder(v), PlainEncoder(v)
            assert [fast.encode(x) for x in b] == [plain.encode(x) for x in b]


#: What each mode says of a token before a look-ahead, from the rules alone.
RULES = [
    ("clean", b"a  b", b"c", False), ("clean", b"a\n\nb", b"c", True), ("clean", b"ab ", b"c", False), ("clean", b", ", b"a", False), ("clean", b", ", b"", True), ("clean", b"ab\n", b"c", True),
    ("balanced", b"a  b", b"", False), ("balanced", b"the cat", b"s", False), ("balanced", b"the cat", b" ", True), ("balanced", b"a.C", b"x", True), ("balanced", b"aC", b"x", False),
    ("consistent", b" the cat", b" ", True), ("consistent", b" the ca", b"t", False), ("consistent", b" it's", b"", True), ("consistent", b" 12.", b"", True), ("consistent", b"12a", b"", False), ("consistent", b"(a", b"", False), ("consistent", b"><", b"", False),
    ("strict", b" the cat", b".", True), ("strict", b" the.", b"", False), ("strict", b"()", b"", True), ("strict", b"12", b"", True), ("strict", b"a1", b"", False), ("strict", b" it's", b" ", True), ("strict", b"><", b"", False),
]


@pytest.mark.parametrize("mode,token,ahead,ok", RULES)
def test_filter_rules(mode, token, ahead, ok):
    assert Filter(mode, 2)(token, ahead) is ok
