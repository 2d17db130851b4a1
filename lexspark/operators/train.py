"""Distillation: from many candidates to the vocabulary that needs the fewest tokens."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import to_model
from .encode import Encoder
from .vocab import Vocab, order_key

TRIALS = 10


@dataclass
class Trained:
    vocab: Vocab
    tokens: int  # of the whole corpus
    corpus_bytes: int
    history: list[tuple[int, int, int]] = field(default_factory=list)  # (round, candidates, best tokens)

    @property
    def bytes_per_token(self) -> float:
        return self.corpus_bytes / max(1, self.tokens)


def divider(candidates: int, size: int, fast: bool) -> int:
    """The share of a trial that goes each round is 1/divider: large steps far from the goal, small ones near it."""
    ratio = candidates / max(1, size)
    steps = ((20, 2), (10, 4), (5, 8), (3, 16), (2, 32)) if fast else ((20, 4), (10, 10), (5, 20), (3, 40), (2, 80))
    return next((d for r, d in steps if ratio > r), 48 if fast else 160)


def strips(docs: DataFrame, text: str = "text", norm: int = 0, capcode: int = 0, size: int = 1 << 20) -> DataFrame:
    """strips(bytes, n): normalised documents, cut only between documents. Partitions are the unit of work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([to_model((x.as_py() or "").encode(), norm, capcode) for x in batch.column(0)], pa.binary())], names=["bytes"])

    return docs.select(text).mapInArrow(run, "bytes binary")


def score_trials(corpus: DataFrame, trials: list[Vocab]) -> tuple[list[int], list[dict[bytes, int]], list[set[int]]]:
    """For each trial: number of tokens (a byte without a token counts as one), bytes covered by each token,
    and the bytes without a token. One pass over the corpus for all trials; sums are combined by task, and
    what reaches the driver is bounded by the sizes of the trials."""
    shared = corpus.sparkSession.sparkContext.broadcast(trials)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [Encoder(v) for v in shared.value]
        tokens = [0] * len(encoders)
        used = [np.zeros(int(e.ids.max(initial=0)) + 2, np.int64) for e in encoders]
        lost = [np.zeros(256, np.int64) for _ in encoders]
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 256):
                for k, e in enumerate(encoders):
                    ids, _, missing, gone = e.encode_many(texts[at : at + 256])
                    tokens[k] += len(ids) + (int(missing.sum()) if e.vocab.unk is None else 0)
                    got = np.bincount(ids, minlength=len(used[k]))
                    used[k] = got + np.pad(used[k], (0, len(got) - len(used[k])))
                    lost[k] += gone
        rows = [(k, -1, n) for k, n in enumerate(tokens)]
        rows += [(k, int(i), int(u[i])) for k, u in enumerate(used) for i in np.flatnonzero(u)]
        rows += [(k, -2 - int(i), int(m[i])) for k, m in enumerate(lost) for i in np.flatnonzero(m)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], names=["trial", "id", "n"])

    got = corpus.mapInArrow(run, "trial int, id int, n long").groupBy("trial", "id").agg(F.sum("n").alias("n")).collect()
    totals, covered, lost = [0] * len(trials), [{} for _ in trials], [set() for _ in trials]
    back = [v.reverse for v in trials]
    for k, i, n in got:
        if i == -1:
            totals[k] = n
        elif i < -1:
            lost[k].add(-2 - i)
        elif i in back[k]:
            covered[k][back[k][i]] = n * len(back[k][i])
    return totals, covered, lost


def _newest(spark: SparkSession, folder: str) -> tuple[int, set[bytes], set[bytes]] | None:
    """(round, candidates, single bytes) of the newest finished table in a training folder."""
    try:
        rows = spark.read.option("basePath", folder).parquet(f"{folder}/round=*")
    except AnalysisException:
        return None
    last = rows.agg({"round": "max"}).first()[0]
    if last is None:
        return None
    kept = {bytes(r.token) for r in rows.where(F.col("round") == last).select("token").collect()}
    return int(last), {t for t in kept if len(t) > 1}, {t for t in kept if len(t) == 1}


def train(docs: DataFrame, candidates: list[bytes], size: int, *, text: str = "text", capcode: int = 0, norm: int = 0, special: tuple[bytes, ...] = (), reserve: int = 0,
          seed: int = 1, fast: bool = True, keep_trying: int | None = None, max_rounds: int | None = None, sample: float = 1.0, folder: str | None = None, every: int = 10) -> Trained:
    """Distil `candidates` to `size` tokens.

    A round shuffles the candidates (by the seed), cuts up to TRIALS disjoint vocabularies, encodes the
    corpus (or, while there are many candidates, a hash sample of it) with all of them in one pass, and
    removes the worst tokens of each. Once `size` candidates are left, rounds try the best vocabulary with
    a few tokens exchanged until `keep_trying` of them in a row bring nothing (by default the reference's 1000, or 275
    if `fast`). max_rounds bounds these exchanges only: the candidates are always reduced to `size`. The driver holds the candidate list and
    the sums of a round; the corpus stays in its partitions. The same seed gives the same vocabulary.
    folder: where every `every` rounds the candidates and single bytes that are left are written as a table; a run
    that finds such tables there goes on from the newest one and gives what an unbroken run gives.
    """
    keep_trying = (275 if fast else 1000) if keep_trying is None else keep_trying
    corpus = strips(docs, text, norm, capcode).persist()
    total_bytes = corpus.agg(F.sum(F.length("bytes"))).first()[0] or 0
    rng = random.Random(seed)
    single = {c for c in candidates if len(c) == 1}
    left = sorted({c for c in candidates if len(c) > 1}, key=order_key)
    base = dict(capcode=capcode, normalization=norm, reserve=reserve, special=special, special_encoded=True)
    history: list[tuple[int, int, int]] = []
    best: tuple[int, list[bytes], dict[bytes, int]] | None = None
    tried: set[int] = set()

    def make(tokens: list[bytes]) -> Vocab:
        return Vocab.new([*tokens, *single], **base)

    def part(many: bool) -> DataFrame:
        return corpus.where(F.pmod(F.xxhash64("bytes", F.lit(seed)), F.lit(1000)) < int(sample * 1000)) if many and sample < 1 else corpus

    rounds = 0
    if folder and (saved := _newest(docs.sparkSession, folder)):
        rounds, kept, single = saved
        left = [t for t in left if t in kept]
    room = max(0, size - len(Vocab.new(single, **base)))
    while len(left) > room:
        if not room:  # the single bytes and special tokens fill the vocabulary
            left = []
            break
        rounds += 1
        shuffled = left[:]
        random.Random(f"{seed}:{rounds}").shuffle(shuffled)  # by the round, so a resumed run draws as an unbroken one
        cuts = [shuffled[i : i + room] for i in range(0, len(shuffled), max(1, room))][:TRIALS]
        totals, covered, lost = score_trials(part(len(left) > 2 * room), [make(c) for c in cuts])
        for m in lost:
            single |= {bytes([b]) for b in m}
        room = max(0, size - len(Vocab.new(single, **base)))  # bytes that turned out to be needed take room
        k = max(2, room // divider(len(left), room, fast))
        gone: set[bytes] = set()
        for cut, cover in zip(cuts, covered, strict=True):
            worst = sorted(cut, key=lambda t: (cover.get(t, 0), order_key(t)))
            gone |= {t for t in worst if cover.get(t, 0) == 0} | set(worst[:k])
        gone = set(sorted(gone, key=order_key)[: len(left) - room])
        left = [t for t in left if t not in gone]
        history.append((rounds, len(left), min(totals)))
        if folder and rounds % every == 0:
            docs.sparkSession.createDataFrame([(bytearray(t),) for t in [*left, *sorted(single)]], "token binary").write.mode("overwrite").parquet(f"{folder}/round={rounds}")
    spare = sorted({c for c in candidates if len(c) > 1} - set(left), key=order_key)
    bad = 0
    trial = [left]
    while bad < keep_trying and (best is None or max_rounds is None or rounds < max_rounds):
        rounds += 1
        trial = [t for t in trial if (h := hash(tuple(t))) not in tried and not tried.add(h)]
        if not trial:
            break
        totals, covered, _ = score_trials(corpus, [make(t) for t in trial])
        k = min(range(len(trial)), key=lambda i: (totals[i], i))
        if best is None or totals[k] < best[0]:
            best, bad = (totals[k], trial[k], covered[k]), 0
        else:
            bad += 1
        history.append((rounds, len(trial), best[0]))
        worst = sorted(best[1], key=lambda t: (best[2].get(t, 0), order_key(t)))
        trial = []
        for _ in range(4):
            n = min(len(spare), max(1, room // 50), len(worst))
            pick = rng.sample(spare, n) if n else []
            trial.append(sorted(set(worst[n:]) | set(pick), key=order_key))
    corpus.unpersist()
    total, tokens, cover = best or (0, left, {})
    scores = {t: n / max(1, total_bytes) for t, n in cover.items()}
    return Trained(Vocab.new([*tokens, *single], scores=scores, level=0, **base), total, total_bytes, history)
