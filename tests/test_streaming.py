"""The stateful decoder over a stream equals the one-shot decoder."""

import random

from lexspark.operators.encode import Encoder, share
from lexspark.operators.vocab import Vocab
from lexspark.streaming.decoder import decode_batch, decode_stream

TEXTS = {"a": "Hello WORLD, naïve café €5 " * 4, "b": "x", "c": ""}
SCHEMA = "stream_id string, seq long, tokens array<int>, is_last boolean"


def _rows(vocab):
    rng, rows = random.Random(3), []
    for k, t in TEXTS.items():
        ids, seq = Encoder(vocab).text(t)[0], 0
        while ids:
            n = rng.randint(1, 5)
            rows.append((k, seq, ids[:n], False))
            ids, seq = ids[n:], seq + 1
        rows.append((k, seq, [], True))
    return rows


def test_stream(spark, tmp_path):
    vocab = Vocab.new([b"D the", b"or", b"C h"], capcode=2, reserve=1)
    rows = _rows(vocab)
    for i in range(2):  # two micro-batches
        part = [r for r in rows if (r[1] >= 6) == bool(i)]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    shared = share(spark, vocab)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = decode_stream(stream, shared).writeStream.format("memory").queryName("decoded").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    for got in (spark.table("decoded").collect(), decode_batch(spark.createDataFrame(rows, SCHEMA), shared).collect()):
        for k, t in TEXTS.items():
            parts = sorted((r.seq, bytes(r.text)) for r in got if r.stream_id == k)
            assert b"".join(p for _, p in parts).decode() == t
