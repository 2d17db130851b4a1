"""Named queries over the test tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import charclass as cc
from ..functions import normalize as N
from ..operators import candidates as C
from ..operators import corpus as P
from ..operators import decode as D
from ..operators import encode as E
from ..operators import setops as U
from ..operators import train as T
from ..operators.vocab import Vocab
from ..streaming.decoder import decode_batch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Least count of a benchmark n-gram in the vocabularies of these queries, and most tokens of one.
LEAST, MOST = 5, 2000
BROADCAST_TOKENS = 1 << 24  # ids are 24 bits, so a vocabulary has a bounded size


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


# ---- normalisation -----------------------------------------------------------------------------------


def _norm(name: str, expr, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return docs(spark, sf_dir).select("doc_id", expr(F.col("text")).alias("text"))

    QUERIES[name], SQL[name] = run, f"SELECT doc_id, {sql} AS text FROM documents"


_norm("norm_newlines", N.newlines, "replace(text, chr(13) || chr(10), chr(10))")
_norm("norm_quotes", N.quotemarks, "translate(text, '‘’“”', '''''\"\"')")
_norm("norm_collapse", N.collapse, "regexp_replace(text, ' {2,}', ' ', 'g')")
_norm("norm_trim", N.trim, r"regexp_replace(text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')")
_norm("norm_leading_space", N.leading_space, "CASE WHEN text <> '' AND NOT starts_with(text, ' ') THEN ' ' || text ELSE text END")
_norm("norm_lower", F.lower, "lower(text)")
_norm("norm_nfd_accents", N.accents, "strip_accents(text)")
_norm("norm_pipeline", lambda c: N.normalize(c, 128 | 8 | 16 | 32 | 64 | 2), "text")
SQL["norm_pipeline"] = r"""WITH n AS (SELECT doc_id, regexp_replace(regexp_replace(translate(replace(text, chr(13) || chr(10), chr(10)), '‘’“”', '''''""'), ' {2,}', ' ', 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS t FROM documents)
SELECT doc_id, lower(CASE WHEN t <> '' AND NOT starts_with(t, ' ') THEN ' ' || t ELSE t END) AS text FROM n"""
_norm("latin_only", cc.strip_non_latin_col, r"regexp_replace(text, '[^\P{L}\p{Latin}]|\x{FFFD}', '', 'g')")


@query("SELECT doc_id, text FROM documents")
def capcode_roundtrip(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", N.capcode_decode(N.capcode_encode("text")).alias("text"))


@query(r"SELECT doc_id, regexp_matches(text, '[\p{L}\p{M}]') AS has_letter, NOT regexp_matches(text, '[^\P{L}\p{Latin}]') AS only_latin FROM documents")
def letter_classes(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", cc.has_letter_col(F.col("text")).alias("has_letter"), cc.only_latin_col(F.col("text")).alias("only_latin"))


# ---- mining ------------------------------------------------------------------------------------------

_GRAMS = """g AS (SELECT substr(h, 2 * i - 1, 2 * n) AS token, count(*) AS n FROM (SELECT hex(encode(text)) AS h, octet_length(encode(text)) AS size FROM benchmark) t,
  unnest(range(1, size + 1)) AS a(i), unnest(range(2, 9)) AS b(n) WHERE i + n - 1 <= size GROUP BY 1)"""


def grams(spark: SparkSession, sf_dir: str, least: int = LEAST) -> DataFrame:
    return C.mine(table(spark, sf_dir, "benchmark"), high=8, min_occur=least)


@query("SELECT b AS byte, count(*) AS n FROM (SELECT ('0x' || substr(h, 2 * i - 1, 2))::INTEGER AS b FROM (SELECT hex(encode(text)) AS h FROM conversations) t, unnest(range(1, length(h) // 2 + 1)) AS a(i)) GROUP BY 1")
def byte_histogram(spark, sf_dir):
    return C.byte_histogram(table(spark, sf_dir, "conversations"))


@query(f"WITH {_GRAMS} SELECT token, n FROM g WHERE n >= {LEAST}")
def ngram_counts_min_occur(spark, sf_dir):
    return grams(spark, sf_dir).select(F.hex("token").alias("token"), "n")


@query(f"WITH {_GRAMS} SELECT token, n FROM g WHERE n >= 2")
def ngram_counts_native(spark, sf_dir):
    return C.mine_native(table(spark, sf_dir, "benchmark"), high=8, min_occur=2).select(F.hex("token").alias("token"), "n")


@query(f"WITH {_GRAMS} SELECT token, n FROM g ORDER BY n DESC, length(token), token LIMIT 500")
def ngram_topk(spark, sf_dir):
    return grams(spark, sf_dir, 1).orderBy(F.desc("n"), F.length("token"), "token").limit(500).select(F.hex("token").alias("token"), "n")


def _mode(mode: str) -> None:
    def run(spark, sf_dir):
        return C.mine(table(spark, sf_dir, "benchmark"), high=16, mode=mode, capcode=2, min_occur=2).select(F.hex("token").alias("token"), "n")

    QUERIES[f"candidates_{mode}"] = run


for _m in ("clean", "balanced", "consistent", "strict"):
    _mode(_m)


@query(f"WITH {_GRAMS} SELECT sum(n)::BIGINT AS windows, max(length(token) // 2)::INTEGER AS longest, count(*)::BIGINT AS distinct_tokens FROM g")
def candidate_census(spark, sf_dir):
    g = grams(spark, sf_dir, 1)
    return g.agg(F.sum("n").alias("windows"), F.max(F.length("token")).alias("longest"), F.count("*").alias("distinct_tokens"))


# ---- vocabularies ------------------------------------------------------------------------------------


def tokens_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grams(spark, sf_dir).select("token", "n")


def dense_ids(tokens: DataFrame) -> DataFrame:
    """Ids 0.. in dictionary order: ranks within a length plus the number of shorter tokens (40 rows at most)."""
    t = tokens.withColumn("size", F.length("token"))
    before = t.groupBy("size").agg(F.count("*").alias("c")).withColumn("offset", F.coalesce(F.sum("c").over(W.orderBy("size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("size", "offset")
    return t.withColumn("rank", F.row_number().over(W.partitionBy("size").orderBy("token"))).join(F.broadcast(before), "size").withColumn("id", F.col("offset") + F.col("rank") - 1).drop("offset", "rank", "size")


@query(f"WITH {_GRAMS} SELECT token, (row_number() OVER (ORDER BY length(token), token) - 1)::BIGINT AS id FROM g WHERE n >= {LEAST}")
def vocab_build_ids(spark, sf_dir):
    return dense_ids(tokens_of(spark, sf_dir)).select(F.hex("token").alias("token"), "id")


@query(f"WITH {_GRAMS}, v AS (SELECT token FROM g WHERE n >= {LEAST}) SELECT a.token, b.token AS alternative FROM v a JOIN v b ON length(b.token) < length(a.token) AND starts_with(a.token, b.token)")
def token_prefix_alternatives(spark, sf_dir):
    v = tokens_of(spark, sf_dir).select("token")
    cut = v.where(F.length("token") > 2).select("token", F.explode(F.sequence(F.lit(2), F.length("token") - 1)).alias("n")).select("token", F.substring(F.col("token"), F.lit(1), F.col("n")).alias("alternative"))
    return cut.join(v.withColumnRenamed("token", "alternative"), "alternative").select(F.hex("token").alias("token"), F.hex("alternative").alias("alternative"))


@query(rf"""WITH {_GRAMS}, v AS (SELECT token, decode(from_hex(token)) AS t FROM g WHERE n >= {LEAST} AND regexp_full_match(token, '([0-7][0-9A-F])+'))
SELECT substr(token, 1, 2) AS byte, count(*) FILTER (WHERE starts_with(t, ' ')) AS spaces, count(*) FILTER (WHERE regexp_matches(t, '^\p{{L}}')) AS letters,
  count(*) FILTER (WHERE regexp_matches(t, '^\p{{N}}')) AS numbers FROM v GROUP BY 1""")
def token_begin_class(spark, sf_dir):
    v = tokens_of(spark, sf_dir).select(F.hex("token").alias("hex"), F.col("token").cast("string").alias("t")).where(F.col("hex").rlike("^([0-7][0-9A-F])+$"))
    n = lambda c: F.count_if(c)
    return v.groupBy(F.substring("hex", 1, 2).alias("byte")).agg(n(F.col("t").startswith(" ")).alias("spaces"), n(F.col("t").rlike(r"^\p{L}")).alias("letters"), n(F.col("t").rlike(r"^\p{N}")).alias("numbers"))


@query(f"WITH {_GRAMS} SELECT token, n FROM g WHERE n >= {LEAST} ORDER BY n DESC, length(token), token LIMIT 300")
def vocab_resize_down(spark, sf_dir):
    v = tokens_of(spark, sf_dir)
    keep = v.orderBy(F.desc("n"), F.length("token"), "token").limit(300)
    return keep.select(F.hex("token").alias("token"), "n")


@query(f"""WITH {_GRAMS}, v AS (SELECT *, row_number() OVER (ORDER BY n DESC, length(token), token) AS r FROM g WHERE n >= {LEAST})
SELECT token, n, r > 300 AS resurrected FROM v WHERE r <= 400""")
def vocab_resurrect(spark, sf_dir):
    v = tokens_of(spark, sf_dir)
    order = (F.desc("n"), F.length("token"), "token")
    keep = v.orderBy(*order).limit(300)
    back = v.join(keep.select("token"), "token", "left_anti").orderBy(*order).limit(100)
    return keep.withColumn("resurrected", F.lit(False)).unionByName(back.withColumn("resurrected", F.lit(True))).select(F.hex("token").alias("token"), "n", "resurrected")


_OTHER = f"""c AS (SELECT substr(h, 2 * i - 1, 2 * n) AS token FROM (SELECT hex(encode(text)) AS h, octet_length(encode(text)) AS size FROM conversations) t,
  unnest(range(1, size + 1)) AS a(i), unnest(range(2, 5)) AS b(n) WHERE i + n - 1 <= size GROUP BY 1 HAVING count(*) >= {LEAST})"""


@query(f"WITH {_GRAMS}, {_OTHER} SELECT token FROM g WHERE n >= {LEAST} UNION SELECT token FROM c")
def tokens_union(spark, sf_dir):
    other = C.mine(table(spark, sf_dir, "conversations"), high=4, min_occur=LEAST)
    return U.union(tokens_of(spark, sf_dir), other).select(F.hex("token").alias("token"))


@query(f"""WITH {_GRAMS}, {_OTHER}, a AS (SELECT token FROM g WHERE n >= {LEAST})
SELECT token, 'a' AS only_in FROM (SELECT token FROM a EXCEPT SELECT token FROM c) UNION ALL SELECT token, 'b' FROM (SELECT token FROM c EXCEPT SELECT token FROM a)""")
def tokens_difference(spark, sf_dir):
    other = C.mine(table(spark, sf_dir, "conversations"), high=4, min_occur=LEAST)
    return U.difference(tokens_of(spark, sf_dir), other).select(F.hex("token").alias("token"), "only_in")


_SPECIAL = [" th", "er", "on"]


@query(f"WITH {_GRAMS} SELECT token FROM g WHERE n >= {LEAST} AND NOT regexp_matches(token, '^([0-9A-F][0-9A-F])*(207468|6572|6F6E)')")
def special_anti_join(spark, sf_dir):
    special = spark.createDataFrame([(bytearray(s.encode()),) for s in _SPECIAL], "token binary")
    return U.without_special(tokens_of(spark, sf_dir), special).select(F.hex("token").alias("token"))


def vocabulary(spark: SparkSession, sf_dir: str, capcode: int = 2) -> Vocab:
    """All bytes, and the most frequent n-grams of `benchmark` in its encoded form (MOST at most)."""
    g = C.mine(table(spark, sf_dir, "benchmark"), high=12, mode="clean" if capcode else "unfiltered", capcode=capcode, min_occur=3)
    top = g.orderBy(F.desc(F.col("n") * F.length("token")), F.length("token"), "token").limit(MOST).collect()
    return Vocab.new([bytes(r["token"]) for r in top], capcode=capcode, reserve=1, scores={bytes(r["token"]): float(r["n"]) for r in top})


@query()
def vocab_info(spark, sf_dir):
    return vocabulary(spark, sf_dir).tables(spark)[3]


@query()
def vocab_tokens(spark, sf_dir):
    return vocabulary(spark, sf_dir).tables(spark)[1]


# ---- encoding and decoding ---------------------------------------------------------------------------


@query()
def tokenize_counts(spark, sf_dir):
    v = E.share(spark, vocabulary(spark, sf_dir))
    t = table(spark, sf_dir, "documents").select("doc_id", "lang", F.octet_length("text").alias("bytes"), E.tokenize(F.col("text"), v).alias("t"))
    return t.select("doc_id", "lang", "bytes", "t.n_tokens", "t.missing")


@query()
def chars_per_token(spark, sf_dir):
    v = E.share(spark, vocabulary(spark, sf_dir))
    t = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("chars"), E.count_tokens(F.col("text"), v).alias("n"))
    return t.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"), F.sum("n").alias("tokens"), (F.sum("chars") / F.sum("n")).alias("chars_per_token"))


@query("SELECT doc_id, text FROM documents")
def detokenize(spark, sf_dir):
    v = E.share(spark, vocabulary(spark, sf_dir))
    return D.round_trip(docs(spark, sf_dir), "text", v)


@query("SELECT item_id, hex(encode(text)) AS hex FROM benchmark")
def detokenize_join(spark, sf_dir):
    vocab = vocabulary(spark, sf_dir, capcode=0)
    v = E.share(spark, vocab)
    ids = table(spark, sf_dir, "benchmark").select("item_id", E.tokenize(F.col("text"), v)["tokens"].alias("ids"))
    return D.detokenize_join(ids, "ids", "item_id", vocab.tables(spark)[3])


@query(r"SELECT doc_id, regexp_replace(hex(encode(text)), '(..)', '\1' || '00', 'g') AS u16 FROM documents")
def serialize_u16(spark, sf_dir):
    v = E.share(spark, Vocab.new([bytes([b]) for b in range(256)]))
    return docs(spark, sf_dir).select("doc_id", F.hex(E.tokenize_serialized(F.col("text"), v, 2)).alias("u16"))


@query("""SELECT item_id, count(*)::INTEGER AS n, sum(('0x' || substr(h, 2 * i - 1, 2))::INTEGER)::BIGINT AS total
FROM (SELECT item_id, hex(encode(text)) AS h FROM benchmark) x, unnest(range(1, length(h) // 2 + 1)) AS a(i) GROUP BY item_id""")
def deserialize_u24(spark, sf_dir):
    v = E.share(spark, Vocab.new([bytes([b]) for b in range(256)]))
    packed = table(spark, sf_dir, "benchmark").select("item_id", E.tokenize_serialized(F.col("text"), v, 3).alias("b"))
    ids = packed.select("item_id", E.deserialize_col(F.col("b"), 3).alias("ids"))
    return ids.where(F.size("ids") > 0).select("item_id", F.size("ids").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"""WITH RECURSIVE {_GRAMS}, v AS (SELECT token FROM g WHERE n >= {LEAST} UNION SELECT DISTINCT substr(h, 2 * i - 1, 2) FROM (SELECT hex(encode(text)) AS h FROM benchmark) t, unnest(range(1, length(h) // 2 + 1)) AS a(i)),
m AS (SELECT item_id, i, max(length(v.token)) AS l FROM (SELECT item_id, hex(encode(text)) AS h FROM benchmark) t, unnest(range(1, length(h) // 2 + 1)) AS a(i), unnest(range(1, 9)) AS b(n) JOIN v ON v.token = substr(h, 2 * i - 1, 2 * n) GROUP BY 1, 2),
r AS (SELECT item_id, 1::BIGINT AS i FROM benchmark UNION ALL SELECT r.item_id, r.i + m.l // 2 FROM r JOIN m ON m.item_id = r.item_id AND m.i = r.i)
SELECT r.item_id, count(m.l)::BIGINT AS n_tokens FROM r LEFT JOIN m ON m.item_id = r.item_id AND m.i = r.i GROUP BY 1""")
def greedy_longest_match(spark, sf_dir):
    """Longest-prefix lookup as a join: every position meets its prefixes, the longest one found stays; the walk
    over positions is a kernel. Prefixes are at most 8 bytes, so the join grows with the text only."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.encode("text", "utf-8").alias("b"))
    v = tokens_of(spark, sf_dir).select("token")
    at = b.where(F.length("b") > 0).select("item_id", "b", F.explode(F.sequence(F.lit(1), F.length("b"))).alias("i"))
    probe = at.select("item_id", "i", F.explode(F.transform(F.sequence(F.lit(2), F.lit(8)), lambda n: F.substring(F.col("b"), F.col("i"), n))).alias("p"))
    hit = probe.join(v, F.col("p") == F.col("token")).groupBy("item_id", "i").agg(F.max(F.length("token")).alias("l"))
    steps = hit.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "l"))).alias("m"))
    rows = b.join(steps, "item_id", "left").select("item_id", F.length("b").alias("size"), F.coalesce("m", F.create_map().cast("map<int,int>")).alias("m"))
    walk = F.aggregate(
        F.sequence(F.lit(1), F.greatest("size", F.lit(1))), F.struct(F.lit(1).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.when((i == a["at"]) & (i <= F.col("size")), F.struct((i + F.coalesce(F.element_at("m", i), F.lit(1))).cast("int").alias("at"), (a["n"] + 1).alias("n"))).otherwise(a),
        lambda a: a["n"],
    )
    return rows.select("item_id", walk.alias("n_tokens"))


@query()
def token_coverage(spark, sf_dir):
    return _coverage(spark, sf_dir, vocabulary(spark, sf_dir))


def _coverage(spark: SparkSession, sf_dir: str, vocab: Vocab) -> DataFrame:
    rows = E.coverage(docs(spark, sf_dir), "text", E.share(spark, vocab))
    return rows.groupBy("id").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes_covered"))


@query()
def worst_tokens(spark, sf_dir):
    vocab = vocabulary(spark, sf_dir)
    used = _coverage(spark, sf_dir, vocab)
    info = vocab.tables(spark)[3].where((F.col("type") == 0))
    return info.join(used, "id", "left").select("id", F.hex("token").alias("token"), F.coalesce("bytes_covered", F.lit(0)).alias("bytes_covered")).orderBy("bytes_covered", "id").limit(100)


@query("SELECT conv_id::VARCHAR AS stream_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def stream_decode(spark, sf_dir):
    v = E.share(spark, vocabulary(spark, sf_dir))
    turns = table(spark, sf_dir, "conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last")).withColumnRenamed("conv_id", "c")
    t = turns.join(last, F.col("conv_id") == F.col("c")).select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"), E.tokenize(F.col("text"), v)["tokens"].alias("tokens"), (F.col("turn") == F.col("last")).alias("is_last"))
    out = decode_batch(t, v)
    return out.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.decode("text", "utf-8").alias("s")))), lambda x: x["s"]), "").alias("text"))


@query()
def conversation_tokens(spark, sf_dir):
    v = E.share(spark, vocabulary(spark, sf_dir))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", E.count_tokens(F.col("text"), v).alias("n_tokens"))


@query()
def train_small(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark")
    found = C.mine(bench, high=10, mode="clean", capcode=2, min_occur=4).orderBy(F.desc("n"), F.length("token"), "token").limit(1500).collect()
    out = T.train(bench, [bytes(r["token"]) for r in found], 500, capcode=2, reserve=1, keep_trying=20)  # the operator's own 275 take minutes of job starts here
    return out.vocab.tables(spark)[3]


# ---- corpus preparation ------------------------------------------------------------------------------


@query("SELECT source, min(doc_id) AS doc_id, arg_min(text, doc_id) AS text FROM documents GROUP BY source")
def first_doc_per_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return P.first_per_key(d, "source", "doc_id")


@query("SELECT doc_id, CASE WHEN len(l) > 20 THEN array_to_string(list_slice(l, len(l) // 2 - 9, len(l) // 2 + 10), chr(10)) ELSE text END AS text FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)")
def middle_lines(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", P.middle_lines(F.col("text"), 20).alias("text"))


@query("SELECT doc_id, size FROM (SELECT doc_id, octet_length(encode(text)) AS size, sum(octet_length(encode(text)) + 1) OVER (ORDER BY doc_id) AS r FROM documents) WHERE r <= 1000000")
def size_capped_extract(spark, sf_dir):
    d = docs(spark, sf_dir)
    return P.size_cap(d, 1_000_000, "doc_id").select("doc_id", F.octet_length("text").cast("long").alias("size"))


@query("SELECT quality, round(corr(n_chars, octet_length(encode(text))), 6) AS r, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY quality")
def doc_metric_corr(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.octet_length("text").alias("size"))
    return d.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality").agg(F.round(F.corr("n_chars", "size"), 6).alias("r"), F.count("*").alias("n"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM a""")
def html_text_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.html_text(F.col("html")).alias("text"))


@query("SELECT lang, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS bytes, max(octet_length(encode(text)))::INTEGER AS longest FROM documents GROUP BY lang")
def corpus_report(spark, sf_dir):
    n = F.octet_length("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(n).alias("bytes"), F.max(n).alias("longest"))
