"""The registered queries and the pipeline on the smallest tables."""

import pathlib
from collections import Counter

import duckdb
import pytest
from test_ngram_join import brute, shingle_set

import __spark_entry__ as driver
import corpus_pipeline
from cartwright.llm import mixture, quality_knn, queries, secret_scan
from cartwright.llm.words import remainder
from scripts.check_oracles import TABLES, rows_of, same_kind

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(DATA).exists(), reason="no star tables")


def test_every_operator_is_registered():
    names = driver.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
    assert names["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = driver.queries()[name](spark, DATA)
    cursor = con.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    assert sorted(columns) == sorted(df.columns)
    assert all(same_kind(f.dataType.simpleString(), kinds[f.name]) for f in df.schema)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_stages_do_what_brute_force_does(spark, tmp_path):
    import tiktoken

    from cartwright.llm.bpe_transducer import read_ranks

    docs = queries.table(spark, DATA, "documents")
    columns = docs.columns
    tables = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        tables[name] = docs.collect()
        assert name == "encode" or docs.columns == columns

    raw = queries.table(spark, DATA, "documents")
    labels = queries.table(spark, DATA, "labels").where(remainder("doc_id", 5) != 0)
    model = quality_knn.fit(raw, labels)
    good = [
        tuple(r)
        for r in raw.collect()
        if model.scores(model.place(*quality_knn.terms(r.text))[None])[0] >= queries.QUALITY_THRESHOLD
    ]
    assert sorted(tuple(r) for r in tables["quality"]) == sorted(good)

    component = {i: c for i, _, c in brute([(r[0], r[1]) for r in good])}
    kept = sorted(r for r in good if component[r[0]] == r[0] or not shingle_set(r[1]))
    assert sorted(tuple(r) for r in tables["near_copies"]) == kept

    clean = {r.doc_id: r for r in tables["secrets"]}
    assert sorted(clean) == [r[0] for r in kept]
    found = {r.doc_id: r for r in secret_scan.scan(spark.read.parquet(str(tmp_path / "near_copies"))).collect()}
    for r in kept:
        text = r[1]
        for s in sorted(found[r[0]].spans, key=lambda s: -s.start):
            text = text[: s.start] + "[secret]" + text[s.stop :]
        assert clean[r[0]].text == text or len(found[r[0]].spans) > 1  # overlapping ones are merged
        assert clean[r[0]].n_chars == len(clean[r[0]].text)

    plan = mixture.mix(spark.read.parquet(str(tmp_path / "secrets")))
    want = {r.doc_id: r.taken for r in plan.taken().collect() if r.taken}
    got = Counter()
    for r in tables["mix"]:
        got[r.doc_id] += len(r.text.encode().split())
    assert got == want

    library = tiktoken.Encoding(
        "own", pat_str=queries.splitting_pattern(), special_tokens={},
        mergeable_ranks=read_ranks(queries.vocabulary("byte_bpe_50k.tiktoken")),
    )
    texts = Counter((r.doc_id, r.source, tuple(library.encode_ordinary(r.text))) for r in tables["mix"])
    assert Counter((r.doc_id, r.source, tuple(r.ids)) for r in tables["encode"]) == texts
    assert all(r.exact and r.n_tokens == len(r.ids) for r in tables["encode"])


def test_pipeline_bears_awkward_rows(spark, tmp_path, make, awkward):
    for name, rows in (("some", awkward), ("none", [])):
        folder = tmp_path / name
        make(rows).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(4, 1, 0)] if rows else [], "doc_id bigint, quality int, toxic int").write.parquet(
            str(folder / "labels.parquet")
        )
        out = corpus_pipeline.run(spark, str(folder)).collect()
        assert (len(out) > 0) == bool(rows) and all(r.exact for r in out)
