"""Registered queries against DuckDB, and the pipeline against stages in plain Python."""

import sys

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
from flockmetrics.llm.queries import ORACLE, QUERIES
from tests.llm.test_decontaminate import plain as plain_contamination
from tests.llm.test_duplicates import plain_classes, plain_groups, plain_print


def rows_of(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, smoke_dir, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        duck.execute(f"create view {table} as select * from '{smoke_dir}/{table}.parquet'")
    got = entry_point.queries()[name](spark, smoke_dir)
    columns = sorted(got.columns)
    relation = duck.execute(ORACLE[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    assert rows_of(got, columns) == sorted((tuple(r[names.index(c)] for c in columns) for r in relation.fetchall()), key=repr)


def test_registered():
    import corpus_pipeline

    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES if name != "pipeline"}
    assert set(QUERIES) <= set(entry_point.queries()) and corpus_pipeline.ORACLE_SQL is None
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline(spark, smoke_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{smoke_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in corpus_pipeline.good_quality(spark, docs, smoke_dir).collect()]
    assert 0 < len(rows) < docs.count()
    keep = {k for _, k, _ in plain_groups(rows)}
    rows = [r for r in rows if r[0] in keep]
    label = plain_classes([plain_print(t) for _, t in rows], lambda a, b: (a ^ b).bit_count() <= 3)
    rows = [min(r for r, m in zip(rows, label, strict=True) if m == own) for own in set(label)]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{smoke_dir}/benchmark.parquet").collect()]
    bad = {k[0] for k in plain_contamination(rows, items) if k[4]}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = sorted(
        (d, " ".join(map(str, tokenizer.encode(t, add_special_tokens=False).ids))) for d, t in rows if d not in bad
    )
    found = corpus_pipeline.run(spark, smoke_dir).collect()
    assert sorted((r.doc_id, r.ids) for r in found) == expected and len(bad) > 0


def test_stages_on_awkward_rows(spark, awkward, nothing, smoke_dir):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, awkward, smoke_dir)
        assert out.columns == awkward.columns and 0 < out.count() <= awkward.count()
        assert stage(spark, nothing, smoke_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, awkward, smoke_dir).count() == awkward.count()


def test_the_rest_does_not_import_the_subpackage():
    import subprocess

    code = "import sys, workload.queries, flockmetrics, bench; assert not [m for m in sys.modules if 'llm' in m]"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_token_counts_of_ids_that_are_null_or_repeat(spark, tmp_path):
    docs = [(None, "one two", "en", "a"), (None, "three", "en", "a"), (None, None, None, None), (1, "x y!", "en", "a"), (1, "x y!", "en", "a"),
            (1, "z!", "de", "b"), (2, "gone", "en", "a"), (2, "gone too", "en", "a"), (3, "w", "en", "b")]
    labels = [(1, 0, 0), (2, 1, 1), (None, 0, 1), (7, 0, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    connection = duckdb.connect()
    for name in ("documents", "labels"):
        connection.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    expected = connection.execute(ORACLE["op4_token_counts"]).fetchall()
    assert sorted(map(tuple, QUERIES["op4_token_counts"](spark, str(tmp_path)).collect()), key=repr) == sorted(expected, key=repr)
