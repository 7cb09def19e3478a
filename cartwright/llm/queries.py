"""The registered queries of this package and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwright.llm import (
    bisector_clusters,
    bpe_transducer,
    fuse_dedup,
    language_id,
    mixture,
    ngram_join,
    projection_forest,
    quality_knn,
    rule_ledger,
    secret_scan,
    term_ranking,
    token_counts,
    warc,
)
from cartwright.llm.words import id_and_text, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def splitting_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@query
def op1_bpe_transducer(spark: SparkSession, folder: str) -> DataFrame:
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    docs = id_and_text(table(spark, folder, "documents"))
    trip = bpe_transducer.round_trip("text", ranks, splitting_pattern())
    decoded = docs.select("doc_id", trip.alias("trip")).select("doc_id", "trip.*")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(table(spark, folder, "documents"))

    def number(kind: str) -> Column:
        place = secret_scan.KINDS.index(kind)
        return F.size(F.filter("base", lambda s: s["kind"] == place)).cast("long")

    return found.select(
        "doc_id",
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


@query
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = remainder("doc_id", 4) == 2
    network = language_id.fit(docs.where(~held_out))
    return docs.select(
        "doc_id", held_out.alias("held_out"), language_id.predictions(network, "text").alias("p")
    ).select("doc_id", "held_out", "p.*")


@query
def op4_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix(table(spark, folder, "documents")).taken()


@query
def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.linked(table(spark, folder, "documents"))


ORACLES["op5_ngram_join"] = r"""
with recursive read as (
    select row_number() over () as r, doc_id,
        regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') as w
    from documents
), shingles as (
    select distinct r, array_to_string(list_slice(w, i, i + 4), ' ') as g
    from (select r, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i
          from read where len(w) > 0)
), sizes as (
    select r, count(*) as n from shingles group by r
), links as (
    select x, y
    from (select a.r as x, b.r as y, count(*) as c
          from shingles a join shingles b on a.g = b.g and a.r <> b.r group by a.r, b.r)
    join sizes sx on sx.r = x join sizes sy on sy.r = y
    where 100 * c >= 75 * (sx.n + sy.n - c)
), reach as (
    select r, r as other from read
    union
    select reach.r, y from reach join links on other = x
)
select read.doc_id, coalesce(n, 0) as n_shingles, component_id
from read
join (select reach.r, min(doc_id) as component_id
      from reach join read on other = read.r group by reach.r) c on c.r = read.r
left join sizes on sizes.r = read.r
"""


#: Documents scored below this are rejected.
QUALITY_THRESHOLD = 0.3


@query
def op6_quality_knn(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").where(remainder("doc_id", 5) != 0)
    model = quality_knn.fit(docs, labels)
    return docs.select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        quality_knn.score(model, "text").alias("score"),
    ).withColumn("predicted", (F.col("score") >= QUALITY_THRESHOLD).cast("int"))


#: Documents of more tokens than this don't fit into one training sequence.
TOKEN_LIMIT = 4096


@query
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = id_and_text(table(spark, folder, "documents"))
    counted = docs.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        token_counts.token_count("text", vocabulary("piece_bpe_32k.model")).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op8_projection_forest(spark: SparkSession, folder: str) -> DataFrame:
    return projection_forest.neighbours(
        table(spark, folder, "embeddings"), F.pmod("id", F.lit(20)) == 0, k=20
    )


@query
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    answers = warc.responses(table(spark, folder, "pages"))
    return warc.derived_records(answers, date="date", record_id="record_id", headers="headers")


@query
def op10_rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    entries = rule_ledger.ledger(table(spark, folder, "documents"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rule_ledger.fails("base").alias("base_failed"),
        (~rule_ledger.fails(rule_ledger.CURRENT)).alias("kept"),
        "failures",
    )


ORACLES["op10_rule_ledger"] = r"""
with docs as (
    select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
), listed as (
    select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
        list_filter(string_split(text, chr(10)),
                    lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
    from docs
), placed as (
    select r, i, list_slice(words, i, i + 4) as w
    from (select r, words, unnest(generate_series(1, len(words) - 4)) as i from listed)
), covered as (
    select r, count(distinct i + k) as n
    from (select r, i, count(*) over (partition by r, w) as c from placed), range(5) as s(k)
    where c > 1
    group by r
), measured as (
    select doc_id,
        len(words) as n_words,
        coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) as n_symbols,
        length(text) - length(regexp_replace(text, '\p{Lu}+', '', 'g')) as n_upper,
        len(lines) as n_lines,
        len(lines) - len(list_distinct(lines)) as n_dup_lines,
        coalesce(n, 0) as n_repeat_words,
        len(list_filter(generate_series(2, len(words)), lambda i: words[i] = words[i - 1])) as n_echoes
    from listed left join covered using (r)
), judged as (
    select *,
        (n_words < 10)::bigint
        | ((100 * n_repeat_words > 20 * n_words)::bigint << 1)
        | ((100 * n_symbols > 5 * word_chars)::bigint << 2)
        | ((100 * n_dup_lines > 50 * n_lines)::bigint << 3)
        | ((100 * n_upper > 40 * word_chars)::bigint << 4)
        | ((100 * n_echoes > 30 * n_words)::bigint << 5) as failures
    from measured
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    failures & 3 != 0 as base_failed, failures = 0 as kept, failures
from judged
"""


@query
def op11_bisector_clusters(spark: SparkSession, folder: str) -> DataFrame:
    found, centroids = bisector_clusters.cluster(table(spark, folder, "embeddings"))
    return bisector_clusters.with_inertia(found, centroids).withColumnRenamed("key", "vec_id")


def _cluster_sql(rounds: int = 3, centroids: int = 16) -> str:
    """Each round as two steps: the nearest centroid of every vector, then the floored means."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""a{n} as (
    select r, any_value(v) as v, min(d * {centroids} + c) % {centroids} as c,
        min(d * {centroids} + c) // {centroids} as d
    from (select r, v, c, cast(list_sum(list_transform(
              list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) as d
          from kept cross join c{n})
    group by r
)""")
        if n < rounds:
            steps.append(f"""c{n + 1} as (
    select c{n}.c, coalesce(moved.m, c{n}.m) as m
    from c{n} left join (
        select c, list(q order by i) as m
        from (select c, i, cast((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as bigint) as q
              from (select c, unnest(v) as x, unnest(range(1, 65)) as i from a{n}) group by c, i)
        group by c) moved on moved.c = c{n}.c
)""")
    return f"""
with kept as materialized (
    select row_number() over () as r, vec_id,
        list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
    from embeddings
    where len(embedding) = 64
        and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
), c0 as (
    select row_number() over (order by sha256('1:' || coalesce(cast(vec_id as varchar), '')), v) - 1 as c, v as m
    from kept
    qualify c < {centroids}
), {", ".join(steps)}
select vec_id, cast(c as integer) as cluster, cast(d as bigint) as distance,
    cast(sum(d) over (partition by c) as bigint) as cluster_inertia,
    cast(sum(d) over () as bigint) as inertia,
    sha256(array_to_string(m, ',')) as centroid_sha256
from a{rounds} join kept using (r) join c{rounds} using (c)
"""


ORACLES["op11_bisector_clusters"] = _cluster_sql()


@query
def op12_fuse_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = fuse_dedup.deduplicated(table(spark, folder, "documents"))
    return found.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


ORACLES["op12_fuse_dedup"] = r"""
with read as (
    select row_number() over () as r, doc_id, length(coalesce(text, '')) as n,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as body
    from documents
)
select doc_id,
    first_value(doc_id) over (partition by body order by n desc, doc_id nulls last, r) as keep_id,
    count(*) over (partition by body) as group_size,
    row_number() over (partition by body order by n desc, doc_id nulls last, r) = 1 as kept,
    sha256(body) as text_sha256
from read
"""


@query
def op13_term_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return term_ranking.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op13_term_ranking"] = r"""
with read as (
    select row_number() over () as r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t
    from documents
), asked as (
    select row_number() over () as item, item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t
    from benchmark
), size as (
    select count(*) filter (len(t) > 0) as n_docs, cast(sum(len(t)) as bigint) as n_terms from read
), wanted as (
    select item, term, count(*) as repeats from (select item, unnest(t) as term from asked) group by all
), postings as (
    select r, term, count(*) as tf
    from (select r, unnest(t) as term from read) where term in (select term from wanted) group by all
), weights as (
    select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) as w
    from postings, size group by term, n_docs
), scored as (
    select item, r, cast(sum(repeats * w * ((1000000000 * tf)
        // (1000 * tf + 12 * (100 - 25 + ((25 * len(t) * n_docs) // n_terms))))) as bigint) as score
    from wanted join postings using (term) join weights using (term) join read using (r), size
    group by item, r
)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by item order by score desc, doc_id nulls last) as rank
      from scored join read using (r) join asked using (item) where score > 0)
where rank <= 20
"""
