"""The stateful decoder as a Structured Streaming operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.decode import StreamDecoder
from ..operators.vocab import Vocab

STATE = "rest binary, in_char boolean, in_word boolean, del boolean, ignore boolean, vocab long, last long"
OUTPUT = "stream_id string, seq long, text binary"


class DecodeProcessor(StatefulProcessor):
    """Per stream: the bytes of an unfinished character, the capcode state, the vocabulary's fingerprint and the last seq.

    Rows of a batch are put in the order of `seq`. A row with is_last flushes and clears the state. A state
    that was written under another vocabulary is an error: ids may mean something else. So is a row that is not
    later than the last one of its stream: what it belongs to is decoded already.
    """

    def __init__(self, vocab: Vocab):
        self.vocab = vocab  # travels with the processor: its runner has no broadcasts
        self.mark = vocab.fingerprint()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("decoder", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        vocab = self.vocab
        known = self.state.get() if self.state.exists() else None
        if known is not None and known[5] != self.mark:
            raise ValueError("the vocabulary was modified while a stream was open")
        decoder = StreamDecoder(vocab, bytes(known[0]), tuple(known[1:5])) if known is not None else StreamDecoder(vocab)
        last = known[6] if known is not None else None
        out = []
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        ended = False
        for seq, tokens, is_last in zip(batch["seq"], batch["tokens"], batch["is_last"], strict=True):
            if last is not None and seq <= last:
                raise ValueError(f"row {seq} of stream {key[0]} came after row {last}")
            text = decoder.decode([int(t) for t in tokens] if tokens is not None else [])
            if is_last:
                text += decoder.flush()
                decoder = StreamDecoder(vocab)
            ended, last = bool(is_last), None if is_last else int(seq)
            out.append((key[0], int(seq), text))
        if ended:
            self.state.clear()
        else:
            self.state.update((decoder.rest, *decoder.capcode.state, self.mark, last))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text"])

    def close(self) -> None:
        pass


def decode_stream(tokens: DataFrame, shared: Broadcast) -> DataFrame:
    """(stream_id, seq, text) of a streaming or batch DataFrame (stream_id string, seq long, tokens array<int>,
    is_last boolean). Needs the RocksDB state store provider."""
    return tokens.groupBy("stream_id").transformWithStateInPandas(DecodeProcessor(shared.value), outputStructType=OUTPUT, outputMode="append", timeMode="none")


def decode_batch(tokens: DataFrame, shared: Broadcast) -> DataFrame:
    """The same over a finished table, one task row per stream; for comparisons and backfills."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        decoder, out = StreamDecoder(shared.value), []
        for seq, ids, is_last in rows.sort_values("seq", kind="stable")[["seq", "tokens", "is_last"]].itertuples(index=False):
            text = decoder.decode([int(t) for t in ids] if ids is not None else [])
            if is_last:
                text += decoder.flush()
            out.append((key[0], int(seq), text))
        return pd.DataFrame(out, columns=["stream_id", "seq", "text"])

    return tokens.groupBy("stream_id").applyInPandas(run, OUTPUT)
