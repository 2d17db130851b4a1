"""Command line: mine, train, export, merge, compare, bench.

    python -m lexspark.cli mine   --input DIR --output candidates.tok --mode clean --capcode 2 --min-occur 10
    python -m lexspark.cli train  --input DIR --tokens candidates.tok --size 32000 --output trained.tok [--folder ROUNDS]
    python -m lexspark.cli export --tokens trained.tok (--vocab v.vocab | --yaml v.yaml | --add-special "<s>" ...)
    python -m lexspark.cli merge  a.tok b.tok --output c.tok
    python -m lexspark.cli compare a.tok b.tok
    python -m lexspark.cli bench  --vocab v.vocab --input DIR
"""

from __future__ import annotations

import argparse
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.charclass import size_in_bytes
from .functions.display import write_token
from .operators import candidates, corpus, encode, train
from .operators.vocab import order_key
from .schema import norm_flags
from .sources import token_file, vocab_file, yaml_file


def _docs(spark: SparkSession, args):
    df = corpus.read_any(spark, args.input)
    return corpus.size_cap(df, size_in_bytes(args.max), "path") if args.max else df


def _read(path: str) -> token_file.TokenFile:
    return token_file.loads(Path(path).read_bytes())


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexspark")
    sub = p.add_subparsers(dest="what", required=True)
    add = {n: sub.add_parser(n) for n in ("mine", "train", "export", "merge", "compare", "bench")}
    for n in ("mine", "train", "bench"):
        add[n].add_argument("--input", required=True)
        add[n].add_argument("--max", default="")
    for n in ("mine", "train", "merge"):
        add[n].add_argument("--output", required=True)
    m = add["mine"]
    m.add_argument("--mode", default="clean")
    m.add_argument("--capcode", type=int, default=2)
    m.add_argument("--norm", default="nfd")
    m.add_argument("--min-occur", type=int)
    m.add_argument("--max-length", type=int, default=40)
    m.add_argument("--words", type=int, default=0)
    m.add_argument("--only-latin", action="store_true")
    m.add_argument("--only-valid", action="store_true")
    t = add["train"]
    t.add_argument("--tokens", required=True)
    t.add_argument("--size", type=int, required=True)
    t.add_argument("--seed", type=int, default=1)
    t.add_argument("--keep-trying", type=int)
    t.add_argument("--folder")
    t.add_argument("--special")
    e = add["export"]
    e.add_argument("--tokens", required=True)
    e.add_argument("--vocab")
    e.add_argument("--yaml")
    e.add_argument("--by-score", action="store_true")
    e.add_argument("--unk", action="store_true")
    e.add_argument("--resize", type=int)
    e.add_argument("--add-special", nargs="*", default=[])
    for n in ("merge", "compare"):
        add[n].add_argument("files", nargs=2)
    add["bench"].add_argument("--vocab", required=True)
    a = p.parse_args(argv)

    if a.what in ("merge", "compare"):
        x, y = map(_read, a.files)
        if a.what == "merge":
            x.tokens, x.scores = sorted({*x.tokens, *y.tokens}, key=order_key), None
            Path(a.output).write_bytes(token_file.dumps(x))
        else:
            for name, only in ((a.files[0], {*x.tokens} - {*y.tokens}), (a.files[1], {*y.tokens} - {*x.tokens})):
                print(f"only in {name}: {len(only)}")
                print("\n".join("  " + write_token(k) for k in sorted(only, key=order_key)))
        return 0
    if a.what == "export":
        v = token_file.to_vocab(_read(a.tokens), unk=a.unk)
        v = v.add_special_tokens(*a.add_special) if a.add_special else v
        v = v.resize(a.resize) if a.resize else v
        if a.vocab:
            vocab_file.save(v, a.vocab)
        if a.yaml:
            Path(a.yaml).write_text(yaml_file.dumps(v, a.by_score))
        print(v.counts())
        return 0
    spark = SparkSession.builder.appName("lexspark").getOrCreate()
    docs = _docs(spark, a)
    if a.what == "mine":
        norm = norm_flags(a.norm)
        found = candidates.mine(docs, high=a.max_length, mode=a.mode, capcode=a.capcode, norm=norm, words=a.words, min_occur=a.min_occur, only_latin=a.only_latin, only_valid=a.only_valid)
        tokens = sorted({bytes(r.token) for r in found.select("token").collect()} | set(candidates.extra_tokens(a.capcode, norm)), key=order_key)
        level = {"unfiltered": 0, "clean": 1, "balanced": 2, "consistent": 3, "strict": 4}[a.mode]
        Path(a.output).write_bytes(token_file.dumps(token_file.TokenFile(a.capcode, 1, norm, level, 0, tokens)))
    elif a.what == "train":
        c = _read(a.tokens)
        special = tuple(s.encode() for s in corpus.read_special(spark, a.special)) if a.special else ()
        done = train.train(docs, c.tokens, a.size, capcode=c.capcode, norm=c.norm, reserve=c.reserve or 8, special=special, seed=a.seed, keep_trying=a.keep_trying, folder=a.folder)
        Path(a.output).write_bytes(token_file.dumps(token_file.of_vocab(done.vocab)))
        print(f"{done.tokens} tokens, {done.bytes_per_token:.3f} bytes per token, {len(done.vocab)} in the vocabulary")
    else:
        v = encode.share(spark, vocab_file.load(spark, a.vocab))
        began = time.time()
        r = docs.select(F.octet_length("text").alias("b"), encode.count_tokens(F.col("text"), v).alias("n")).agg(F.sum("b"), F.sum("n")).first()
        took = time.time() - began
        print(f"{r[1]} tokens, {took:.2f} s, {(r[0] or 0) / 2**20 / took:.2f} MB/s")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
