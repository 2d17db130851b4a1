"""The YAML form of vocabularies and of edits. Reads the block style that the form uses; no library needed."""

from __future__ import annotations

import json
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.display import read_token, unescape, write_token
from ..functions.normalize import to_model
from ..operators.vocab import Patch, Vocab, order_key

_POLICY = {"include-256-bytes": 1, "include-128-bytes": 2, "include-utf8-bytes": 4, "include-ascii-bytes": 8, "include-extended-bytes": 16, "exclude-other-bytes": 32}


def _scalar(s: str):
    s = s.strip()
    if s[:1] == '"':
        end = next(i for i in range(1, len(s)) if s[i] == '"' and (len(s[1:i]) - len(s[1:i].rstrip("\\"))) % 2 == 0)
        return unescape(s[1:end])
    if s[:1] == "'":
        return s[1 : s.rindex("'")].replace("''", "'")
    s = s.split(" #")[0].strip()
    if s.lower() in ("true", "false"):
        return s.lower() == "true"
    for kind in (int, float):
        try:
            return kind(s)
        except ValueError:
            pass
    return s


def parse(text: str) -> dict:
    """Top-level scalars, and lists of maps."""
    out: dict = {}
    items: list | None = None
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare[0] == "#":
            continue
        if "\t" in line[: len(line) - len(line.lstrip())]:
            raise ValueError("YAML is indented with spaces")
        if bare.startswith("- "):
            if items is None:
                raise ValueError("a list item outside a list")
            items.append({})
            bare = bare[2:].strip()
        elif line[0] != " ":
            key, _, value = bare.partition(":")
            if value.strip() and value.strip()[0] != "#":
                out[key], items = _scalar(value), None
            else:
                items = out[key] = []
            continue
        key, _, value = bare.partition(":")
        if items:
            items[-1][key.strip()] = _scalar(value)
    return out


def patch_of(doc: dict, base: Vocab) -> Patch:
    """The edit that a document describes, for a vocabulary with base's normalisation."""
    p = Patch(unk=doc.get("unk"), unk_id=doc.get("unk-id"), reset_ids=bool(doc.get("reset-token-ids")))
    p.reserve = sum(bit for key, bit in _POLICY.items() if doc.get(key))
    if "training-param" in doc:
        p.reserve |= int(doc["training-param"]) >> 3
    for kind in ("tokens", "special"):
        for item in doc.get(kind) or []:
            t = read_token(str(item["token"]))
            done = bool(item.get("encoded"))
            key = t if done else to_model(t, base.norm, base.capcode)
            lists = (p.encoded_special if done else p.add_special) if kind == "special" else (p.encoded if done else p.add)
            lists.append(t)
            if "id" in item:
                p.ids[key] = int(item["id"])
            if "score" in item:
                p.scores[key] = float(item["score"])
    for item in doc.get("delete") or []:
        if "token" in item:
            p.delete.append(read_token(str(item["token"])))
        if "id" in item:
            p.delete_ids.append(int(item["id"]))
    return p


def loads(text: str) -> Vocab:
    """A new vocabulary from YAML."""
    doc = parse(text)
    charset = {"none": 0, "utf-8": 1, "utf8": 1, "utf-16": 2, "utf16": 2}[str(doc.get("charset", "utf-8")).lower()]
    base = Vocab(capcode=int(doc.get("capcode", 0)), charset=charset, norm=S.norm_flags(str(doc.get("normalization", ""))), level=int(doc.get("training-param", 5)) & 7)
    return base.modify(patch_of(doc, base))


def modify(v: Vocab, text: str) -> Vocab:
    """A vocabulary edited by YAML."""
    return v.modify(patch_of(parse(text), v))


def _float(x: float) -> str:
    """The shortest decimal that reads back to the same 32-bit number."""
    f = struct.unpack("<f", struct.pack("<f", x))[0]
    return next(s for n in range(1, 18) if struct.pack("<f", float(s := f"{f:.{n}g}")) == struct.pack("<f", f))


def dumps(v: Vocab, by_score: bool = False) -> str:
    """YAML of a vocabulary, in dictionary order or by falling score; special tokens last."""
    head = [f'charset: "{S.CHARSETS[v.charset]}"', f"capcode: {v.capcode}", f'normalization: "{S.norm_names(v.norm).lower()}"', f"training-param: {v.reserve << 3 | v.level}"]
    head += [f"{k}: true" for k, bit in _POLICY.items() if v.reserve & bit]
    if v.unk is not None:
        head += ["unk: true", f"unk-id: {v.unk}"]
    plain = [e for e in v.entries if not e.dup]
    plain.sort(key=(lambda e: (-e.score, order_key(e.token))) if by_score else (lambda e: order_key(e.token)))

    def section(name: str, special: bool) -> list[str]:
        rows = [e for e in plain if bool(e.flag & S.SPECIAL) == special]
        out = [f"{name}:"] if rows else []
        for e in rows:
            out += [f"  - token:   {write_token(e.token)}", f"    id:      {e.id}", f"    score:   {_float(e.score)}", "    encoded: true"]
        return out

    return "\n".join([*head, *section("tokens", False), *section("special", True)]) + "\n"


def import_json_vocab(text: str, kind: str = "byte-level") -> Vocab:
    """A vocabulary from {"token": id} JSON of other tokenizers.

    byte-level: characters stand for bytes (the printable byte alphabet); pieces: U+2581 stands for a space and
    <0xHH> for a byte. Their ids are kept.
    """
    pairs = json.loads(text)
    if kind == "byte-level":
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        table = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        back = lambda t: bytes(table[c] for c in t) if all(c in table for c in t) else t.encode()
    else:
        back = lambda t: bytes.fromhex(t[3:5]) if len(t) == 6 and t.startswith("<0x") else t.replace("▁", " ").encode()
    ids: dict[bytes, int] = {}
    for t, i in sorted(pairs.items(), key=lambda x: x[1]):
        b = back(t)
        if 0 < len(b) <= S.MAX_TOKEN:
            ids.setdefault(b, i)
    return Vocab.new(list(ids), ids=ids)


def write_text(info: DataFrame, path: str) -> None:
    """One token per line in the hex-or-text form, in dictionary order, through Spark's text writer."""
    from ..functions.display import hex_form_col

    info.where(F.length("token") > 0).orderBy(F.length("token"), "token").select(hex_form_col(F.col("token")).alias("value")).write.text(path)


def read_yaml(spark: SparkSession, path: str) -> Vocab:
    return loads(spark.read.text(path, wholetext=True).first()[0])
