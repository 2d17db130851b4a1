"""Secret scans with corpus-wide ownership frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored, table

#: kind -> (pattern, group of the value, least length of the value), in the order of ties.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"([0-9a-f]{24,})", 1, 24),  # runs are maximal, so shorter runs cannot hide a longer one
}
#: A value seen with more owners than this, or in more repositories, is a widely copied example.
MOST_OWNERS, MOST_REPOSITORIES = 1, 100
#: A live-looking value has at least so many distinct characters and none of these marks.
LEAST_CHARACTERS = 6
PLACEHOLDER = r"(?i)example|sample|changeme|placeholder|dummy|xxxx|your[_-]?|12345678"


def spans_of(text: Column, kind: str) -> Column:
    """array<struct<start, kind_no, end, value>> of one kind: leftmost, non-overlapping, in code points.

    Splitting at the pattern gives the texts between the matches; the lengths of both add up to positions.
    """
    pattern, group, least = KINDS[kind]
    no = list(KINDS).index(kind)
    p, n = F.lit(pattern), F.lit(group)
    between, whole, value = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, n)
    parts = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("b"), whole.alias("w"), value.alias("v"))
    kind_of = "array<struct<start:int,kind_no:int,end:int,value:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind_of).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["b"])
        end = begin + F.length(x["w"])
        one = F.array(F.struct(begin.alias("start"), F.lit(no).alias("kind_no"), end.alias("end"), x["v"].alias("value")))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(parts, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(kind_of))


def live(value: Column) -> Column:
    return (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_CHARACTERS) & ~value.rlike(PLACEHOLDER)


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(found, owned): the base spans of every row, and the spans of owner-specific live-looking values.

    found: id, key (hash of text and owner), found (array of base spans with the SHA-256 of the value).
    owned: id, key, owned (array of spans), copied (number of spans whose value is a widely copied example).
    The frequency of a value is the number of distinct owners and repositories that hold it anywhere in
    the corpus: more than MOST_OWNERS owners or more than MOST_REPOSITORIES repositories make it a widely copied
    example, whoever owns them. Values are carried as hashes. Copies are aggregated before the shuffle. Null and
    empty texts have no spans; a null owner or repository counts as one owner or repository. Repeated rows count
    once and get equal results; other columns are not looked at.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    every = F.concat(*[spans_of(t, k) for k in KINDS])
    some = t.rlike("|".join(p for p, _, _ in KINDS.values()))
    hashed = F.transform(every, lambda s: F.struct(s["start"], s["kind_no"], s["end"], F.sha2(s["value"], 256).alias("hash"), live(s["value"]).alias("live")))
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int,hash:string,live:boolean>>")
    found = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text, owner, repository).alias("key"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"),
        F.when(some, F.sort_array(hashed)).otherwise(none).alias("found"),
    )
    found = stored(found, "secrets")
    each = found.where(F.size("found") > 0).select("id", "key", "owner", "repository", F.inline("found")).distinct()
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    owners = each.groupBy("hash", name("owner").alias("who")).agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias("n_owners"))
    repositories = each.groupBy("hash", name("repository").alias("what")).agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias("n_repositories"))
    often = owners.join(repositories, "hash")
    often = often.select("hash", ((F.col("n_owners") > MOST_OWNERS) | (F.col("n_repositories") > MOST_REPOSITORIES)).alias("wide"))
    judged = each.join(often, "hash").withColumn("owned", F.col("live") & ~F.col("wide"))
    owned = judged.groupBy("id", "key").agg(
        F.sort_array(F.collect_set(F.when(F.col("owned"), F.struct("start", F.lit(len(KINDS)).alias("kind_no"), "end")))).alias("owned"),
        F.sum(F.col("wide").cast("int")).alias("copied"),
    )
    return found, owned


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in [*KINDS, "owned"]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source", mask: str = "[SECRET]") -> DataFrame:
    """docs with every owner-specific live-looking credential replaced by `mask`; widely copied examples stay.

    Only rows that hold such a credential take part in a join; the others pass by. All rows and columns stay.
    Null and empty texts stay as they are; overlapping spans are masked once; repeated rows are masked alike;
    temporary columns avoid the names in docs.
    """
    _, owned = scan(docs, id_col, text, owner, id_col)
    spans, k, key, i = fresh(docs, "__lx_spans"), fresh(docs, "__lx_id"), fresh(docs, "__lx_key"), fresh(docs, "__lx_key2")
    marks = owned.where(F.size("owned") > 0).select(F.col("id").alias(k), F.col("key").alias(key), F.col("owned").alias(spans)).distinct()
    rows = docs.withColumn(i, F.xxhash64(text, owner, id_col)).join(marks, F.col(id_col).eqNullSafe(F.col(k)) & (F.col(i) == F.col(key)), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        ahead = s["start"] >= acc["at"]
        more = F.when(ahead, F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    new = F.aggregate(F.col(spans), start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.lit(2**31 - 1))))
    return rows.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(new)).select(*docs.columns)


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    found, owned = scan(table(spark, sf_dir, "documents"))
    right = owned.select(F.col("id").alias("id_"), F.col("key").alias("key_"), "owned", "copied")
    rows = found.join(right, F.col("id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")), "left")
    base = F.transform("found", lambda s: F.struct(s["start"], s["kind_no"], s["end"]))
    count = lambda no: F.size(F.filter("found", lambda s: s["kind_no"] == no)).cast("long")
    return rows.select(
        F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.sort_array(F.concat(base, F.coalesce("owned", F.array().cast("array<struct<start:int,kind_no:int,end:int>>"))))).alias("spans"),
        F.coalesce(F.size("owned"), F.lit(0)).cast("long").alias("n_owned"), F.coalesce("copied", F.lit(0)).cast("long").alias("n_copied"),
    )


def _sql() -> str:
    """The same in DuckDB: positions from the lengths of the texts between matches."""
    parts = []
    for no, (pattern, group, least) in enumerate(KINDS.values()):
        p = pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, source, {no} AS no, {least} AS least, string_split_regex(t, '{p}') AS p, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS v FROM t")
    name = "['assign', 'access', 'hex', 'owned'][no + 1] || ':' || a || ':' || b, ',' ORDER BY a, no, b"
    return f"""WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), x AS ({' UNION ALL '.join(parts)}),
s AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM x WHERE len(m) > 0),
f AS (SELECT doc_id, source, no, v[i] AS v, (list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0))::BIGINT AS a, length(m[i]) AS l FROM s WHERE length(v[i]) >= least),
o AS (SELECT v, count(DISTINCT coalesce('=' || source, '')) > {MOST_OWNERS} OR count(DISTINCT coalesce('=' || doc_id, '')) > {MOST_REPOSITORIES} AS wide FROM f GROUP BY v),
j AS (SELECT DISTINCT doc_id, no, a, a + l AS b, wide, NOT wide AND len(list_distinct(string_split(f.v, ''))) >= {LEAST_CHARACTERS} AND NOT regexp_matches(f.v, '{PLACEHOLDER}') AS owned FROM f JOIN o ON f.v = o.v),
u AS (SELECT doc_id, no, a, b FROM j UNION ALL SELECT DISTINCT doc_id, 3, a, b FROM j WHERE owned),
g AS (SELECT doc_id, count(*) FILTER (WHERE no = 0) AS n0, count(*) FILTER (WHERE no = 1) AS n1, count(*) FILTER (WHERE no = 2) AS n2, count(*) FILTER (WHERE no = 3) AS n3, string_agg({name}) AS spans, string_agg({name}) FILTER (WHERE no < 3) AS base FROM u GROUP BY doc_id),
c AS (SELECT doc_id, count(*) FILTER (WHERE wide) AS n FROM j GROUP BY doc_id)
SELECT t.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n3, 0)::BIGINT AS n_owned, coalesce(c.n, 0)::BIGINT AS n_copied FROM t LEFT JOIN g ON g.doc_id = t.doc_id LEFT JOIN c ON c.doc_id = t.doc_id"""


OP6_SQL = _sql()
