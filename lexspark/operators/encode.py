"""The ungreedy encoder: kernel, DataFrame functions and the SQL registration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import UserDefinedTableFunction

from .. import schema as S
from ..functions.normalize import to_model
from .vocab import Vocab

_NO = -1_000_000
#: The value that stands for the end of a text in a buffer of bytes, the places that are decided at once (their arrays
#: fit a core's cache), and the most steps, also those that no token takes, that are kept in one plain table.
END, WINDOW, DENSE = 256, 1 << 14, 1 << 24
#: Bytes of text whose tokens a task holds at once where it works on each token; a single longer text is held whole.
PART = 1 << 18


class Trie:
    """All prefixes of the tokens as a hash table (state, byte) -> state that is asked for whole arrays at once."""

    def __init__(self, tokens: list[bytes]):
        states: dict[bytes, int] = {b"": 0}
        keys: list[int] = []
        for t in tokens:  # by length, so that shorter prefixes come first or are made here
            at = 0
            for n in range(1, len(t) + 1):
                to = states.get(t[:n])
                if to is None:
                    to = states[t[:n]] = len(states)
                    keys.append(at << 9 | t[n - 1])
                at = to
        self.token = np.full(len(states), -1, np.int64)
        for k, t in enumerate(tokens):
            self.token[states[t]] = k
        self.space = states.get(b" ", -1)
        self.bits = max(8, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.to = np.zeros(1 << self.bits, np.int64)
        key, to = np.array(keys, np.int64), np.arange(1, len(keys) + 1)
        slot = self._slot(key)
        while len(key):  # linear probing, all keys at once: of those that want a place, one gets it
            free = self.keys[slot] == -1
            self.keys[slot[free]], self.to[slot[free]] = key[free], to[free]
            left = self.keys[slot] != key
            key, to, slot = key[left], to[left], (slot[left] + 1) & ((1 << self.bits) - 1)
        keyed, after = np.array(keys, np.int64), np.arange(1, len(keys) + 1)
        self.first = np.full(END + 1, -1, np.int64)
        root = keyed < 512
        self.first[keyed[root]] = after[root]
        inner, after = keyed[~root], after[~root]
        used = np.unique(inner & 511)
        self.code = np.zeros(END + 1, np.int64)  # a narrow number for each byte behind the first of a token; 0: no token goes on
        self.code[used] = np.arange(1, len(used) + 1)
        self.shift, self.dense = int(len(used)).bit_length(), None
        if len(states) << self.shift <= DENSE:
            self.dense = np.full(len(states) << self.shift, -1, np.int32)
            self.dense[inner >> 9 << self.shift | self.code[inner & 511]] = after
        else:
            self.code, self.shift = np.arange(END + 1), 9
        pairs = np.repeat(self.first, END + 1).astype(np.int64)
        self.second = np.full(len(pairs), -1, np.int32)
        at = np.flatnonzero(pairs >= 0)
        self.second[at] = self.step(pairs[at], self.code[at % (END + 1)])

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states after one more byte, given by its code; -1 where no token goes on."""
        key = state << self.shift | code
        if self.dense is not None:
            return self.dense[key]
        slot = self._slot(key)
        got = self.keys[slot]
        out = np.where(got == key, self.to[slot], -1)
        left = np.flatnonzero((got != key) & (got != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot[left]]
            hit = got == key[left]
            out[left[hit]] = self.to[slot[left[hit]]]
            left = left[~hit & (got != -1)]
        return out

    def longest(self, codes: np.ndarray, at: np.ndarray, state: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(entries or -1, lengths) of the longest tokens that go on from states of `depth` bytes at the places `at`."""
        entry, length = np.full(len(at), -1, np.int64), np.zeros(len(at), np.int64)
        live = np.flatnonzero(state >= 0)
        at, state = at[live], state[live].astype(np.int64)
        while len(live):
            k = self.token[state]
            hit = np.flatnonzero(k >= 0)
            to = live[hit]
            entry[to], length[to] = k[hit], depth
            state = self.step(state, codes[at])
            go = np.flatnonzero(state >= 0)
            live, at, state, depth = live[go], at[go] + 1, state[go].astype(np.int64), depth + 1
        return entry, length

    def everywhere(self, data: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The same from the root at the first n places; the first two bytes are looked up in plain tables."""
        one = self.first[data[:n]]
        entry = np.where(one >= 0, self.token[one], -1)
        length = (entry >= 0).astype(np.int64)
        two = self.second[data[:n] * (END + 1) + data[1 : n + 1]]
        live = np.flatnonzero(two >= 0)
        k, m = self.longest(codes, live + 2, two[live], 2)
        hit = np.flatnonzero(k >= 0)
        entry[live[hit]], length[live[hit]] = k[hit], m[hit]
        return entry, length


class Encoder:
    """A compiled vocabulary: exact and longest-prefix lookup, and the six-branch encoder.

    What is emitted at a place depends on the place and on whether its token borrowed a space, on nothing
    before. So the decisions of all places of a window are computed as arrays: first what the token of each place is
    worth as a second one, then the best first one. What is left of the sequential part is a walk along the next
    places. Windows are a fixed number of bytes, whatever the texts are.
    """

    def __init__(self, vocab: Vocab):
        self.vocab = vocab
        e = vocab.entries
        self.index = {x.token: i for i, x in enumerate(e)}
        self.trie = Trie([x.token for x in e])
        col = lambda f, kind=np.int64: np.array([f(x) for x in e], kind)
        self.ids = col(lambda x: x.id)
        self.size = col(lambda x: len(x.token))
        self.flag = col(lambda x: x.flag & 255)
        begin = np.frombuffer(vocab.begin + vocab.begin[:1], np.uint8).astype(np.int64)  # the end counts as a zero byte
        self.letter = begin == S.BYTE_LETTER
        words = col(lambda x: x.n_words)
        worth = (self.flag >> 7) + np.maximum(0, words - 1) + 100 * words
        #: Of second tokens, and last of none: the score as one; the same after a borrowed space, which earns nothing
        #: there and has no length; whether such a space may come before.
        none = lambda a, x: np.append(a, x)
        self.tail = none(self.size + worth + ((self.flag >> 2) & 1), 4 * _NO)
        self.bare = none(self.size - 1 + worth, 4 * _NO)
        self.middle = none(((self.flag & S.BEGINS_LETTER) > 0) & (words == 0), False)
        self.flags, self.sizes = none(self.flag, 0), none(self.size, 0)
        #: what the byte after the second token adds, without and with a letter at the end of that token
        self.next = np.concatenate([((begin >> 2) & 1) + 100 * (begin >> 3) - 3 * (f & begin) for f in (0, 1)])
        f1, f2 = np.arange(256)[:, None], np.arange(256)[None, :]
        #: what two flags in a row cost: without, and with a space that the second token borrows
        marks = 100 * ((f1 >> 3) & (f2 >> 4) & 1)
        self.cost = [(103 * (f1 & (f2 >> 1) & 1) + marks).ravel(), (103 * (f1 & 1) + marks + 1).ravel()]
        #: Of each token, without and with a borrowed space, the first tokens to try: (entries or -1, lengths, scores, flags << 8).
        self.tries = []
        for b in (0, 1):
            lead = self.size - b + (self.flag >> 7) + np.maximum(0, words - b - 1) + 100 * (words - b)
            self.tries.append([(first, size - b, lead[first] + (size - self.size[first]), self.flag[first] << 8) for first, size in (
                (np.arange(len(e)), self.size), (col(lambda x: -1 if x.alt is None else x.alt), col(lambda x: x.alt_len)), (col(lambda x: -1 if x.alt2 is None else x.alt2), col(lambda x: x.alt2_len)),
            )] if e else [])
        #: After a token nothing is tried at the end of a text, nor at a space if the token is a whole word.
        self.halt = np.where(begin == S.BYTE_SPACE, 1, 0)
        self.halt[END] = 2
        self.bound = np.where(self.flag & S.WHOLE_WORD, 1, 2)
        self.marks = vocab.delete_id is not None

    def find(self, token: bytes) -> int | None:
        return self.index.get(token)

    def longest(self, data: bytes, i: int) -> tuple[int, int] | None:
        """(entry, length) of the longest entry that data has at i."""
        for n in range(min(self.vocab.max_len, len(data) - i), 0, -1):
            k = self.index.get(data[i : i + n])
            if k is not None:
                return k, n
        return None

    def _seconds(self, data: np.ndarray, codes: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, ...]:
        """(scores, flags, ends, scores after a borrowed space, flags, ends) of the longest tokens of all places as second ones."""
        flag, place = self.flags[entry], np.arange(len(entry))
        end = place + self.sizes[entry]
        score = self.tail[entry] + self.next[(flag & 1) * (END + 1) + data[end]]
        score_b, flag_b, end_b = np.full(len(entry), 4 * _NO), np.zeros(len(entry), np.int64), place
        if self.marks and self.trie.space >= 0:
            r = np.flatnonzero(self.middle[entry] & self.letter[data[end]])
            spaced, n = self.trie.longest(codes, r, np.full(len(r), self.trie.space), 1)
            ok = np.flatnonzero((spaced >= 0) & (r + n > end[r] + 1))
            r, spaced, n = r[ok], spaced[ok], n[ok] - 1
            end_b = place.copy()
            flag_b[r], end_b[r] = self.flag[spaced], r + n
            score_b[r] = self.bare[spaced] + self.next[(flag_b[r] & 1) * (END + 1) + data[r + n]]
        return score, flag, end, score_b, flag_b, end_b

    def _decide(self, data: np.ndarray, seconds: tuple[np.ndarray, ...], i: np.ndarray, k: np.ndarray, borrowed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entries to emit, next places, whether the next token borrows a space) of the places i, whose tokens are k."""
        score, flag, end, score_b, flag_b, end_b = seconds
        out, to, lent = k.copy(), i + self.size[k] - borrowed, np.zeros(len(i), bool)
        at_ = np.flatnonzero(self.halt[data[to]] < self.bound[k])
        i, k, reach = i[at_], k[at_], to[at_]
        best, best_b = (np.full(len(i), _NO) for _ in range(2))
        plain, rescue = [k.copy(), reach.copy()], [k.copy(), reach.copy()]
        for no, (firsts, sizes, leads, shifted) in enumerate(self.tries[borrowed]):
            if no:
                first = firsts[k]
                which = np.flatnonzero(first >= 0)
                first, k_ = first[which], k[which]
                at = i[which] + sizes[k_]
            else:
                which, first, k_, at = None, k, k, reach
            lead, f1 = leads[k_], shifted[k_]
            for ends, s, cost, f2, top, chosen in ((end, score, self.cost[0], flag, best, plain), (end_b, score_b, self.cost[1], flag_b, best_b, rescue)):
                s = s[at]
                r = None
                if ends is end_b:
                    r = np.flatnonzero(s > _NO)
                    if not len(r):
                        continue
                pick = lambda a: a if r is None else a[r]  # noqa: B023, E731
                a = pick(at)
                s = pick(s) + pick(lead) - cost[pick(f1) | f2[a]]
                if no:
                    w = pick(which)
                    more = ends[a] - reach[w]
                    s -= 100 * (more < 0) + 10000 * (more == 0)
                    up = np.flatnonzero(s > top[w])
                    w = w[up]
                    top[w], chosen[0][w], chosen[1][w] = s[up], pick(first)[up], a[up]
                elif r is None:
                    np.maximum(top, s, out=top)
                else:
                    top[r] = s
        lends = best_b > best  # on equal scores the branches without an extra token come first
        go = np.flatnonzero((best > _NO) | lends)
        at_ = at_[go]
        out[at_], to[at_] = (np.where(lends, x, y)[go] for x, y in zip(rescue, plain, strict=True))
        lent[at_] = lends[go]
        return out, to, lent

    def _window(self, data: np.ndarray, n: int, start: int, borrowed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, bool]:
        """(places, entries or -1, whether the mark of a borrowed space follows, next place, whether it borrows) of the
        walk from `start` over the first n places of data; further places are looked ahead at."""
        m = self.vocab.max_len
        codes = self.trie.code[data]
        entry, _ = self.trie.everywhere(data, codes, n + m)
        seconds = self._seconds(data, codes, entry)
        at = np.flatnonzero(entry[:n] >= 0)
        out, to, lent = np.full(n, -1), np.arange(1, n + 1), np.zeros(n, bool)
        out[at], to[at], lent[at] = self._decide(data, seconds, at, entry[at], 0)
        place, outs, tos, lents, n_states = [np.arange(n)], [out], [to], [lent], n
        lender = np.full(n + m + 1, -1)  # the state of a place whose token borrows a space
        new = np.unique(np.concatenate([to[lent], [start] if borrowed else np.zeros(0, np.int64)]).astype(np.int64))
        while len(new := new[(new < n) & (lender[np.minimum(new, n)] < 0)]):
            lender[new] = n_states + np.arange(len(new))
            k, _ = self.trie.longest(codes, new, np.full(len(new), self.trie.space), 1)
            o, t, b = self._decide(data, seconds, new, k, 1)
            place.append(new), outs.append(o), tos.append(t), lents.append(b)
            n_states += len(new)
            new = np.unique(t[b])
        place, out, to, lent = (np.concatenate(x) for x in (place, outs, tos, lents))
        done = len(to)
        jump = np.append(np.where(lent, lender[np.minimum(to, n + m)], to), done)
        jump[:-1][to >= n] = done
        p = np.array([lender[start] if borrowed else start])
        while p[-1] < done:  # twice as many steps of the walk each time
            p = np.concatenate([p, jump[p]])
            jump = jump[jump]
        p = p[p < done]
        return place[p], out[p], lent[p], int(to[p[-1]]), bool(lent[p[-1]])

    def encode_many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, ends of each text in them, bytes without a token per text, and per byte value)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        total, ahead = int(sizes.sum()) + len(texts), 2 * self.vocab.max_len + 2
        data = np.full(total + ahead, END, np.uint16)
        starts = np.cumsum(sizes + 1) - sizes - 1
        for a, t in zip(starts.tolist(), texts, strict=True):
            data[a : a + len(t)] = np.frombuffer(t, np.uint8)
        unk, mark = -1 if self.vocab.unk is None else self.vocab.unk, self.vocab.delete_id
        ids, per_text, missing, lost = [], np.zeros(len(texts) + 1, np.int64), np.zeros(len(texts), np.int64), np.zeros(256, np.int64)
        at, borrowed, text = 0, False, 0
        while at < total:
            n = min(WINDOW, total - at)
            part = data[at : at + n + ahead].astype(np.int64)
            place, entry, lent, after, borrowed = self._window(part, n, 0, borrowed)
            byte = part[place]
            ends = byte == END
            of = text + np.cumsum(ends) - ends
            bad = (entry < 0) & ~ends
            first = np.where(entry >= 0, self.ids[entry], np.where(bad, unk, -1))
            each = np.stack([first, np.where(lent, mark if mark is not None else -1, -1)], axis=1)
            keep = each >= 0
            ids.append(each[keep].astype(np.int32))
            per_text[1:] += np.bincount(of, keep.sum(axis=1), minlength=len(texts))[: len(texts)].astype(np.int64)
            missing += np.bincount(of[bad], minlength=len(texts))[: len(texts)]
            lost += np.bincount(byte[bad], minlength=256)[:256]
            text, at = text + int(ends.sum()), at + after
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.cumsum(per_text), missing, lost

    def encode(self, data: bytes) -> tuple[list[int], int]:
        """(ids, bytes without a token)."""
        ids, _, missing, _ = self.encode_many([data])
        return ids.tolist(), int(missing[0])

    def model(self, text: str | bytes) -> bytes:
        """Normalised and capcoded."""
        raw = text.encode("utf-8", "surrogateescape") if isinstance(text, str) else bytes(text)
        return to_model(raw, self.vocab.norm, self.vocab.capcode)

    def text(self, text: str | bytes) -> tuple[list[int], int]:
        """Normalise, capcode and encode."""
        return self.encode(self.model(text))

    def texts(self, column: pa.Array, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, ends, missing) of an Arrow column of texts, in parts of about `most` bytes; null as empty."""
        part, size = [], 0
        for x in column:
            part.append(b"" if not x.is_valid else self.model(x.as_py()))
            size += len(part[-1])
            if size >= most:
                yield self.encode_many(part)[:3]
                part, size = [], 0
        if part:
            yield self.encode_many(part)[:3]


def serialize(ids: list[int] | np.ndarray, width: int) -> bytes:
    """Little-endian ids of 2, 3 or 4 bytes."""
    a = np.asarray(ids, dtype="<u4")
    if width == 3:
        return a.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    if width not in (2, 4):
        raise ValueError("an id has 2, 3 or 4 bytes")
    return a.astype("<u2").tobytes() if width == 2 else a.tobytes()


def deserialize(data: bytes, width: int) -> list[int]:
    if width == 3:
        b = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.uint32)
        return (b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16).tolist()
    return np.frombuffer(data[: len(data) // width * width], "<u2" if width == 2 else "<u4").tolist()


# ---- DataFrame functions -----------------------------------------------------------------------------

_encoders: dict[int, tuple[Vocab, Encoder]] = {}


def encoder_of(shared: Broadcast) -> Encoder:
    """The encoder of a broadcast vocabulary; compiled once in each Python worker."""
    vocab = shared.value
    known = _encoders.get(id(vocab))
    if known is None or known[0] is not vocab:
        if len(_encoders) > 8:
            _encoders.clear()
        known = _encoders[id(vocab)] = (vocab, Encoder(vocab))
    return known[1]


def share(spark: SparkSession, vocab: Vocab) -> Broadcast:
    return spark.sparkContext.broadcast(vocab)


def tokenize(text: Column, shared: Broadcast) -> Column:
    """struct<tokens, n_tokens, missing> of a text or binary column; null: null."""

    @F.arrow_udf(S.TOKENIZED)
    def run(col: pa.Array) -> pa.Array:
        parts = list(encoder_of(shared).texts(col))
        counts = np.concatenate([np.diff(e) for _, e, _ in parts]) if parts else np.zeros(0, np.int64)
        missing = np.concatenate([m for _, _, m in parts]) if parts else np.zeros(0, np.int64)
        ids = pa.array(np.concatenate([i for i, _, _ in parts]) if parts else np.zeros(0, np.int32), pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), ids)
        return pa.StructArray.from_arrays([lists, pa.array(counts, pa.int32()), pa.array(missing, pa.int32())], names=["tokens", "n_tokens", "missing"], mask=col.is_null())

    return run(text)


def count_tokens(text: Column, shared: Broadcast) -> Column:
    """Number of ids that tokenize() gives."""

    @F.arrow_udf("int")
    def run(col: pa.Array) -> pa.Array:
        counts = np.concatenate([np.zeros(0, np.int64), *(np.diff(e) for _, e, _ in encoder_of(shared).texts(col))])
        return pa.array(counts.astype(np.int32), mask=np.asarray(col.is_null()))

    return run(text)


def tokenize_serialized(text: Column, shared: Broadcast, width: int | None = None) -> Column:
    """Ids as packed bytes; width None: 2 bytes if all ids fit, else 3."""

    @F.arrow_udf("binary")
    def run(col: pa.Array) -> pa.Array:
        e = encoder_of(shared)
        w = width or e.vocab.id_bytes
        out = [serialize(ids[a:b], w) for ids, ends, _ in e.texts(col, PART) for a, b in zip(ends, ends[1:], strict=False)]
        return pa.array([x if ok else None for x, ok in zip(out, col.is_valid().to_pylist(), strict=True)], pa.binary())

    return run(text)


def serialize_col(ids: Column, width: int) -> Column:
    """Packed bytes of an id column, as an expression without Python."""
    swapped = lambda x: sum((F.shiftleft(F.shiftright(x, 8 * k).bitwiseAND(F.lit(255)).cast("long"), 8 * (width - 1 - k)) for k in range(1, width)), F.shiftleft(x.bitwiseAND(F.lit(255)).cast("long"), 8 * (width - 1)))
    return F.unhex(F.array_join(F.transform(ids, lambda x: F.lpad(F.hex(swapped(x)), 2 * width, "0")), ""))


def deserialize_col(data: Column, width: int) -> Column:
    """Ids of packed bytes, as an expression without Python."""
    n = F.floor(F.length(data) / width).cast("int")
    byte = lambda i, k: F.conv(F.hex(F.substring(data, i * width + k + 1, F.lit(1))), 16, 10).cast("int")
    one = lambda i: sum((byte(i, k) * (1 << (8 * k)) for k in range(1, width)), byte(i, 0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<int>"))


def spans(df: DataFrame, text: str, shared: Broadcast, carry: list[str]) -> DataFrame:
    """One row per token: the carried columns, pos, id, start and len in the normalised bytes; no shuffle."""
    schema = T.StructType([*[df.schema[c] for c in carry], *T.StructType.fromDDL("pos int, id int, start int, len int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(shared)
        size = sizes_of(e.vocab)
        for batch in batches:
            done = 0
            for ids, ends, _ in e.texts(batch.column(len(carry)), PART):
                start, length = lengths(ids, ends, size, e.vocab.delete_id)
                row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                take = pa.array(row + done)
                done += len(ends) - 1
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in range(len(carry))], *[pa.array(v.astype(np.int32)) for v in (np.arange(len(ids)) - ends[row], ids, start, length)]], names=schema.names)

    return df.select(*carry, text).mapInArrow(run, schema)


def coverage(df: DataFrame, text: str, shared: Broadcast) -> DataFrame:
    """(id, n, bytes): how often each id occurs in a task and what it covers of the normalised bytes. A task gives one
    row per id, not per token; the sums over tasks are those of spans()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(shared)
        size = sizes_of(e.vocab)
        n, covered = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for batch in batches:
            for ids, ends, _ in e.texts(batch.column(0), PART):
                n += np.bincount(ids, minlength=len(size))
                covered += np.bincount(ids, lengths(ids, ends, size, e.vocab.delete_id)[1], len(size)).astype(np.int64)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(covered[used])], names=["id", "n", "bytes"])

    return df.select(text).mapInArrow(run, "id int, n long, bytes long")


def sizes_of(vocab: Vocab) -> np.ndarray:
    """Bytes of the token of each id; 1 for the unknown one."""
    size = np.ones(vocab.highest_id + 1, np.int64)
    for i, t in vocab.reverse.items():
        size[i] = len(t)
    return size


def lengths(ids: np.ndarray, ends: np.ndarray, size: np.ndarray, delete_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the ids of several texts, each counted from its text's start; as places()."""
    n = size[ids]
    if delete_id is not None:
        marks = ids == delete_id
        gap = np.zeros(len(ids), np.int64)
        gap[1:] = marks[:-1]
        gap[ends[:-1][ends[:-1] < len(ids)]] = 0  # a text does not lend to the next
        n = np.where(marks, 0, np.maximum(0, n - gap))
    before = np.concatenate([[0], np.cumsum(n)])
    return before[:-1] - np.repeat(before[ends[:-1]], np.diff(ends)), n


def places(ids: list[int], size: dict[int, int], delete_id: int | None) -> Iterator[tuple[int, int]]:
    """(start, length) of each id in the normalised bytes: a borrowed space has no length."""
    at = gap = 0
    for i in ids:
        n = 0 if i == delete_id else max(0, size.get(i, 1) - gap)
        gap = int(i == delete_id)
        yield at, n
        at += n


def spans_udtf(vocab: Vocab) -> UserDefinedTableFunction:
    """token_spans(text) for SQL: rows (pos, id, start, len)."""

    class TokenSpans:
        def __init__(self):
            self.encoder = Encoder(vocab)
            self.size = {i: len(t) for i, t in vocab.reverse.items()}

        def eval(self, text: str):
            ids = self.encoder.text(text or "")[0]
            for p, (i, (start, n)) in enumerate(zip(ids, places(ids, self.size, vocab.delete_id), strict=True)):
                yield p, i, start, n

    return F.udtf(TokenSpans, returnType="pos int, id int, start int, len int")


def register(spark: SparkSession, vocab: Vocab, prefix: str = "") -> None:
    """SQL functions of a vocabulary: tokenize, token_count, detokenize, token_spans, candidate_ok(token, look-ahead,
    mode), capcode_encode, capcode_decode, nfd; and the views vocab_meta, vocab_tokens, vocab_deleted, vocab_info."""
    from ..functions import normalize as N
    from .decode import detokenize_udf
    from .filters import Filter

    shared = share(spark, vocab)

    @F.pandas_udf("array<int>")
    def ids(col: pd.Series) -> pd.Series:
        e = encoder_of(shared)
        return col.map(lambda x: None if x is None else e.text(x)[0])

    @F.pandas_udf("int")
    def count(col: pd.Series) -> pd.Series:
        e = encoder_of(shared)
        return pd.Series([None if x is None else len(e.text(x)[0]) for x in col], dtype="Int32")

    @F.pandas_udf("boolean")
    def candidate_ok(token: pd.Series, ahead: pd.Series, mode: pd.Series) -> pd.Series:
        rules = {m: Filter(m, vocab.capcode) for m in mode.dropna().unique()}
        return pd.Series([None if t is None or m is None else rules[m](bytes(t), bytes(a or b"")) for t, a, m in zip(token, ahead, mode, strict=True)], dtype=object)

    for name, f in {"tokenize": ids, "token_count": count, "detokenize": detokenize_udf(shared), "candidate_ok": candidate_ok, "capcode_encode": N.capcode_encode, "capcode_decode": N.capcode_decode, "nfd": N.nfd}.items():
        spark.udf.register(prefix + name, f)
    spark.udtf.register(prefix + "token_spans", spans_udtf(vocab))
    for name, df in zip(("vocab_meta", "vocab_tokens", "vocab_deleted", "vocab_info"), vocab.tables(spark), strict=True):
        df.createOrReplaceTempView(prefix + name)
