"""The numbered queries next to their SQL on the given tables, and the pipeline by brute force."""

import hashlib
import os

import duckdb
import public_tokenizers
import pyarrow as pa
import pyarrow.dataset as ds
import pytest
import sentencepiece

import corpus_pipeline
from pinwright.llm.quality import Bands, measure
from pinwright.llm.queries import ORACLES, QUERIES

from test_tables import plain_components, plain_item, plain_lines, plain_print, plain_shingles

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_the_sql(spark, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    base = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        base.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = base.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)


def test_every_query_has_its_number():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    rows = [(r["doc_id"], r["text"]) for r in ds.dataset(f"{SF}/documents.parquet").to_table().to_pylist()]
    n_words, _, _, _, n_repeat, in_bands = measure(pa.array([t for _, t in rows]), Bands())
    rows = [r for r, n, k, ok in zip(rows, n_words, n_repeat, in_bands) if n >= 20 and 100 * k <= 30 * n and ok]
    rows = [(i, t) for _, i, t, _, _ in plain_lines(rows)]
    root = plain_components([(i, plain_print(t)) for i, t in rows], lambda x, y: (x ^ y).bit_count() <= 4)
    rows = [(i, t) for i, t in rows if root[i] == i]
    items = [plain_item(r["text"]) for r in ds.dataset(f"{SF}/benchmark.parquet").to_table().to_pylist()]
    rows = [(i, t) for i, t in rows
            if not any(x and len(x & plain_shingles(t, n)) >= 0.8 * len(x) for n, x in items)]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((i, model.encode(t), sha(model.decode(model.encode(t)))) for i, t in rows)
    got = corpus_pipeline.run(spark, SF).select("doc_id", "ids", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == want and 0 < len(want)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
