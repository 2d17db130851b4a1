"""Vocabularies: building, editing and describing them.

A vocabulary is small (at most 2^24 tokens of 40 bytes; usually 10^3 to 10^5), so it is built on the driver,
shipped to tasks as one broadcast, and shown as tables. Every edit builds a new vocabulary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from .. import schema as S
from ..functions import capcode as cap
from ..functions.charclass import can_have_unk, is_alnum, is_letter, is_mark, is_number, is_space, runes
from ..functions.normalize import to_model


@dataclass
class Entry:
    """One dictionary entry. dup: the same token with a delete mark and a space in front, sharing its id."""

    token: bytes
    id: int
    score: float = 0.0
    flag: int = 0
    n_words: int = 0
    alt: int | None = None
    alt_len: int = 0
    alt2: int | None = None
    alt2_len: int = 0
    dup: bool = False


@dataclass
class Patch:
    """An edit: applied in the order of the fields of Vocab.modify."""

    add: list[bytes] = field(default_factory=list)
    add_special: list[bytes] = field(default_factory=list)
    delete: list[bytes] = field(default_factory=list)
    delete_ids: list[int] = field(default_factory=list)
    ids: dict[bytes, int] = field(default_factory=dict)
    scores: dict[bytes, float] = field(default_factory=dict)
    encoded: list[bytes] = field(default_factory=list)  # added as they are, without normalisation
    encoded_special: list[bytes] = field(default_factory=list)
    size: int | None = None
    reset_ids: bool = False
    unk: bool | None = None
    unk_id: int | None = None
    reserve: int = 0


def order_key(token: bytes) -> tuple[int, bytes]:
    """Dictionary order: by length, then by unsigned bytes."""
    return len(token), token


def policy_bytes(reserve: int, capcode: int, norm: int = 0) -> set[int]:
    """Single bytes that a reserve policy asks for."""
    gone = {b for b in range(65, 91) if chr(b) not in "CWD"} if capcode == 2 else set()
    ascii_ = ({9, 10, 13, *range(32, 127)} | ({127} if capcode == 1 else set())) - gone
    out: set[int] = set()
    if reserve & 1:
        out |= set(range(256)) - gone
    if reserve & 2:
        out |= set(range(128)) - gone
    if reserve & 4:
        out |= ascii_ | set(range(0x80, 0xC0)) | set(range(0xC2, 0xF5))
    if reserve & 8:
        out |= ascii_
    if reserve & 16:
        extra = "£€©®™°%¢¥—–•‘’“”áéíóúýàèìòùâêîôûäëïöüñãõçåæœ"
        extra += "" if capcode == 2 or norm & S.NORM_FLAGS["lowercase"] else extra[16:].upper()
        out |= ascii_ | set(to_model(extra.encode(), norm, 0))
    return out


@dataclass
class Vocab:
    capcode: int = 0
    charset: int = 1
    norm: int = 0
    level: int = 5
    reserve: int = 0
    unk: int | None = None
    delete_id: int | None = None
    max_len: int = 0
    begin: bytes = bytes(256)
    entries: list[Entry] = field(default_factory=list)
    deleted: list[tuple[bytes, int | None, float]] = field(default_factory=list)
    version: int = 0

    # -- building ---------------------------------------------------------------------------------

    @classmethod
    def new(cls, tokens: Iterable[bytes | str] = (), special: Iterable[bytes | str] = (), *, capcode: int = 0, charset: int = 1, normalization: str | int = 0,
            reserve: int = 0, unk: bool = False, encoded: bool = True, special_encoded: bool = False,
            scores: dict[bytes, float] | None = None, ids: dict[bytes, int] | None = None, level: int = 5) -> Vocab:
        """A vocabulary of the given tokens. encoded: they are already normalised and capcoded."""
        norm = S.norm_flags(normalization)
        if capcode == 2 and norm & S.NORM_FLAGS["lowercase"]:
            raise ValueError("lowercase and capcode 2 exclude each other")
        raw = [_bytes(t) for t in tokens]
        base = cls(capcode=capcode, charset=charset, norm=norm, level=level)
        patch = Patch(reserve=reserve, unk=unk or None, scores=scores or {}, ids=ids or {})
        (patch.encoded if encoded else patch.add).extend(raw)
        (patch.encoded_special if special_encoded else patch.add_special).extend(_bytes(t) for t in special)
        return base.modify(patch)

    def modify(self, patch: Patch) -> Vocab:
        """The edited vocabulary.

        Order: ids to delete, tokens to delete (as given or normalised), special tokens (regular tokens that
        contain one go), tokens that stay, tokens to add, resize, ids. Ids that stay are kept; new tokens
        fill the gaps in dictionary order.
        """
        enc = lambda t: to_model(t, self.norm, self.capcode)
        plain = [e for e in self.entries if not e.dup]
        gone = {f for t in patch.delete for f in (t, enc(t))} | {e.token for e in plain if e.id in set(patch.delete_ids)}
        score = {e.token: e.score for e in plain} | {t: s for t, _, s in self.deleted} | patch.scores
        ids = ({} if patch.reset_ids else {e.token: e.id for e in plain}) | patch.ids
        specials = [e.token for e in plain if e.flag & S.SPECIAL and e.token not in gone]
        for t in [*map(enc, patch.add_special), *patch.encoded_special]:
            if 0 < len(t) <= S.MAX_TOKEN and t not in gone and t not in specials:
                specials.append(t)
        taken = set(specials)
        hides = lambda t: any(s in t for s in specials)
        reserve = self.reserve | patch.reserve
        others = bool(reserve & S.RESERVE["exclude-other"])
        single = policy_bytes(patch.reserve if not self.entries else reserve, self.capcode, self.norm)
        regular: set[bytes] = set()
        dropped: list[bytes] = [t for t, _, _ in self.deleted]
        for t in [*(e.token for e in plain if not e.flag & S.SPECIAL), *patch.encoded]:
            if not 0 < len(t) <= S.MAX_TOKEN or t in taken:
                continue
            if t in gone or hides(t):
                dropped.append(t)
            elif len(t) > 1:
                regular.add(t)
            elif not others:
                single.add(t[0])
        for t in map(enc, patch.add):
            if 0 < len(t) <= S.MAX_TOKEN and t not in gone and t not in taken and not hides(t):
                if len(t) > 1:
                    regular.add(t)
                else:
                    single.add(t[0])
        single -= {t[0] for t in gone if len(t) == 1}
        fixed = len(single) + len(specials)
        if patch.size is not None:
            room = max(0, patch.size - fixed - (self.unk is not None or bool(patch.unk)))
            if len(regular) > room:  # worst scores first, ties in dictionary order
                worst = sorted((t for t in regular if score.get(t, 0) > 0 or t not in score), key=lambda t: (score.get(t, 0), order_key(t)))[: len(regular) - room]
                regular -= set(worst)
                dropped += worst
            elif len(regular) < room:
                back = sorted({t for t in dropped if t not in gone and t not in regular and not hides(t) and len(t) > 1}, key=lambda t: (-score.get(t, 0), order_key(t)))
                regular |= set(back[: room - len(regular)])
        tokens = sorted({bytes([b]) for b in single} | regular | taken, key=order_key)
        used = {ids[t] for t in tokens if t in ids}
        unk = self._unk(patch, len(tokens), used, len(single))
        if unk is not None:
            used.add(unk)
        free = (i for i in range(S.NONE) if i not in used)
        entries = [Entry(t, ids[t] if t in ids else next(free), score.get(t, 0.0), S.SPECIAL if t in taken else 0) for t in tokens]
        if max((e.id for e in entries), default=0) >= S.NONE - 1:
            raise ValueError("token id out of range")
        lost = {t: None for t in dropped if t not in regular}
        had = {e.token: e.id for e in plain} | {t: i for t, i, _ in self.deleted}
        deleted = [(t, had.get(t), score.get(t, 0.0)) for t in sorted(lost, key=order_key)]
        out = replace(self, reserve=reserve, unk=unk, deleted=deleted, version=self.version + 1)
        out.entries = entries
        out._finish()
        return out

    def _unk(self, patch: Patch, total: int, used: set[int], single: int) -> int | None:
        want = self.unk is not None if patch.unk is None else patch.unk
        if not want or not can_have_unk(single, self.capcode):
            return None
        if patch.unk_id is not None and patch.unk_id not in used:
            return patch.unk_id
        if self.unk is not None and not patch.reset_ids and self.unk not in used:
            return self.unk
        return total if total not in used else next(i for i in range(S.NONE) if i not in used)

    def _finish(self) -> None:
        """Duplicates for forward delete, flags, alternatives, byte classes."""
        mark = {2: b"D ", 1: b"\x7f "}.get(self.capcode)
        known = {e.token for e in self.entries}
        if mark:
            more = []
            for e in self.entries:
                t = mark + e.token
                if is_alnum(runes(e.token)[0][0], self.capcode) and len(t) <= S.MAX_TOKEN and t not in known:
                    more.append(Entry(t, e.id, e.score, e.flag & S.SPECIAL, dup=True))
            self.entries = self.entries + more
        self.entries.sort(key=lambda e: order_key(e.token))
        at = {e.token: i for i, e in enumerate(self.entries)}
        self.max_len = max(map(len, at), default=0)
        votes = [[0, 0, 0, 0] for _ in range(256)]
        for e in self.entries:
            if not e.flag & S.SPECIAL:
                e.flag, e.n_words, vote, least = describe(e.token, self.capcode)
                votes[e.token[0]][vote] += 1
                found = alternatives(e.token, least, at, self.capcode)
                (e.alt, e.alt_len), (e.alt2, e.alt2_len) = found
        self.begin = bytes(begin_class(v) for v in votes)
        d = at.get({2: b"D", 1: b"\x7f"}.get(self.capcode, b""))
        self.delete_id = self.entries[d].id if d is not None else None

    # -- views ------------------------------------------------------------------------------------

    def __len__(self) -> int:
        return sum(not e.dup for e in self.entries) + (self.unk is not None)

    @property
    def reverse(self) -> dict[int, bytes]:
        """id -> token; of a token and its duplicate, the plain one."""
        return {e.id: e.token for e in self.entries if not e.dup}

    @property
    def highest_id(self) -> int:
        return max([*self.reverse, self.unk if self.unk is not None else 0], default=0)

    @property
    def id_bytes(self) -> int:
        """Bytes of a serialised id: 2 if all ids fit, else 3."""
        return 2 if self.highest_id < 65536 else 3

    def fingerprint(self) -> int:
        """A number that is equal for vocabularies that give every id the same meaning, however they were made."""
        h = hashlib.blake2b(repr((self.capcode, self.charset, self.norm, self.unk)).encode(), digest_size=7)
        for i, t in sorted(self.reverse.items()):
            h.update(b"%d:%d:" % (i, len(t)) + t)
        return int.from_bytes(h.digest(), "big")

    def id_to_token(self, i: int) -> bytes | None:
        return self.reverse.get(i)

    def token_to_id(self, token: bytes) -> int | None:
        return next((e.id for e in self.entries if e.token == token and not e.dup), None)

    def info(self) -> list[tuple]:
        """(id, token, decoded token, type, score) by id; duplicates are left out. type as in INFO_TYPES; a
        special token of one byte counts as a single byte."""
        rows = [(e.id, e.token, cap.decode_bytes(e.token, self.capcode), 1 if len(e.token) == 1 else 2 if e.flag & S.SPECIAL else 0, e.score) for e in self.entries if not e.dup]
        if self.unk is not None:
            rows.append((self.unk, b"", b"", 3, 0.0))
        return sorted(rows)

    def counts(self) -> dict[str, int]:
        plain = [e for e in self.entries if not e.dup]
        return {"size": len(self), "special": sum(bool(e.flag & S.SPECIAL) for e in plain), "single_byte": sum(len(e.token) == 1 for e in plain), "deleted": len(self.deleted), "max_token_length": self.max_len}

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(vocab_meta, vocab_tokens, vocab_deleted, vocab_info)."""
        meta = [(self.capcode, self.charset, self.norm, self.level, self.reserve, self.unk, len(self), self.highest_id + 1, self.delete_id, self.max_len, bytearray(self.begin))]
        id_of = lambda k: None if k is None else self.entries[k].id
        tokens = [(i, bytearray(e.token), e.id, float(e.score), e.flag, e.n_words, e.alt, e.alt_len, id_of(e.alt), e.alt2, e.alt2_len, id_of(e.alt2), e.dup) for i, e in enumerate(self.entries)]
        return (
            spark.createDataFrame(meta, S.VOCAB_META), spark.createDataFrame(tokens, S.VOCAB_TOKENS),
            spark.createDataFrame([(bytearray(t), i, float(s)) for t, i, s in self.deleted], S.VOCAB_DELETED),
            spark.createDataFrame([(i, bytearray(t), bytearray(d), k, float(s)) for i, t, d, k, s in self.info()], S.VOCAB_INFO),
        )

    # -- edits ------------------------------------------------------------------------------------

    def add_tokens(self, *tokens: bytes | str) -> Vocab:
        return self.modify(Patch(add=[_bytes(t) for t in tokens]))

    def add_special_tokens(self, *tokens: bytes | str) -> Vocab:
        return self.modify(Patch(add_special=[_bytes(t) for t in tokens]))

    def delete_tokens(self, *tokens: bytes | str) -> Vocab:
        return self.modify(Patch(delete=[_bytes(t) for t in tokens]))

    def delete_ids(self, *ids: int) -> Vocab:
        return self.modify(Patch(delete_ids=list(ids)))

    def resize(self, size: int) -> Vocab:
        return self.modify(Patch(size=size))

    def reset_ids(self) -> Vocab:
        return self.modify(Patch(reset_ids=True))

    def enable_unk(self) -> Vocab:
        return self.modify(Patch(unk=True))

    def disable_unk(self) -> Vocab:
        return self.modify(Patch(unk=False))


def _bytes(t: bytes | str) -> bytes:
    return t.encode() if isinstance(t, str) else bytes(t)


def describe(token: bytes, capcode: int) -> tuple[int, int, int, int]:
    """(flag, number of word starts, vote for the first byte's class, least length of an alternative).

    Votes: 0 space, 1 letter, 2 number, 3 other.
    """
    rs = [r for r, _ in runes(token)]
    first, second, last = rs[0], rs[1] if len(rs) > 1 else "", rs[-1]
    letter = lambda r: bool(r) and is_letter(r, capcode)
    word = lambda r: bool(r) and is_alnum(r, capcode)
    flag, vote = 0, 3
    if first == " ":
        flag, vote = S.BEGINS_SPACE, 0
    elif letter(first):
        flag, vote = S.BEGINS_LETTER, 1
    elif is_mark(first, capcode):
        flag = S.BEGINS_MARK | (S.BEGINS_SPACE if first in "CW" else 0)
    elif is_number(first):
        vote = 2
    words = sum(a == " " and word(b) for a, b in zip(rs, rs[1:], strict=False))
    starts = first == " " and word(second)
    letters = numbers = punct = False
    if len(token) == 1:
        punct = True
    else:
        letters = (first == " " or letter(first)) and letter(second)
        numbers = not letters and (first == " " or is_number(first)) and bool(second) and is_number(second)
        punct = not letters and not numbers and not word(first) and not word(second)
        for r in rs[2:]:
            if letter(r):
                numbers = punct = False
            elif is_number(r):
                letters = punct = False
            elif r != " ":
                letters = numbers = False
    if starts and letters and letter(last) and words == 1:
        flag |= S.WHOLE_WORD
    if is_mark(last, capcode):
        flag |= S.ENDS_MARK
    if letter(last):
        flag |= S.ENDS_LETTER
    if letters or numbers or punct:
        flag |= S.UNIFORM
    return flag, words, vote, 2 if starts and words > 1 else 1


def split_priority(left: str, right: str, capcode: int) -> int:
    """How good a place between two runes is to cut a token."""
    letter = lambda r: is_letter(r, capcode) or r == "_"
    if capcode == 0 and ((not letter(left) and letter(right)) or (not is_number(left) and is_number(right))):
        return 9
    if (letter(left) and not letter(right)) or (is_number(left) and not is_number(right)):
        return 9
    if is_space(left) != is_space(right):
        return 7 if is_space(left) else 8
    return 9 if is_mark(right, capcode) else 1


def alternatives(token: bytes, least: int, at: dict[bytes, int], capcode: int) -> list[tuple[int | None, int]]:
    """The two best shorter tokens a token starts with: by priority of the cut, then by length."""
    found = []
    for n in range(len(token) - 1, least - 1, -1):
        k = at.get(token[:n])
        if k is not None:
            left = runes(token[:n])[-1][0]
            rest = runes(token[n:])
            right, after = rest[0][0], rest[1][0] if len(rest) > 1 else ""
            p = 10 if right == " " and after and is_alnum(after, capcode) else split_priority(left, right, capcode)
            found.append((p, n, k))
    found = sorted(found, reverse=True)[:2]
    return [(k, n) for _, n, k in found] + [(None, 0)] * (2 - len(found))


def begin_class(votes: list[int]) -> int:
    """Class of a first byte by strict majority of more than two votes."""
    best = max(votes)
    if best <= 2 or votes.count(best) > 1:
        return 0
    return {1: S.BYTE_LETTER, 0: S.BYTE_SPACE, 3: S.BYTE_OTHER}.get(votes.index(best), 0)
