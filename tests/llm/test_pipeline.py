"""The corpus pipeline and the registered queries on the smallest tables."""

import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tidemark.llm import queries

from .test_texts import brute_components, covered_words, repeated_lines

SF_DIR = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "substring_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        after = stage(spark, docs, SF_DIR)
        rows = after.collect()
        if name != "packing":
            assert after.columns == docs.columns
        if name == "toxicity":
            assert 0 < len(rows) <= len(before)  # so few labels may not do to reject any; test_texts.py has enough
        elif name == "line_dedup":
            import hashlib

            want = {x[0]: x[3] for x in repeated_lines(before, 2)}
            assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in rows} == want
        elif name == "near_dedup":
            assert sorted(r.doc_id for r in rows) == sorted(x[0] for x in brute_components(before) if x[3])
        elif name == "substring_dedup":
            sizes = {x[0]: x[1] - x[2] for x in covered_words(before, 50)}
            assert {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows} == sizes
        else:
            assert {r.doc_id for r in rows} == {x[0] for x in before}
        docs = after
    whole = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    df = queries.QUERIES[name](spark, SF_DIR)
    result = connection.execute(queries.SQL[name])
    order = [x[0] for x in result.description]
    want = sorted(str([row[order.index(x)] for x in sorted(order)]) for row in result.fetchall())
    assert sorted(df.columns) == sorted(order)
    assert sorted(str([row[x] for x in sorted(df.columns)]) for row in df.collect()) == want


def test_nearest_neighbours_recall(spark):
    rows = pq.read_table(f"{SF_DIR}/embeddings.parquet").to_pandas()
    matrix = np.stack(rows.embedding.values).astype(float)
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    ids = rows.vec_id.values
    want = set()
    for q in np.flatnonzero(ids % 50 == 0):
        score = matrix @ matrix[q]
        score[q] = -9
        want |= {(ids[q], i) for i in ids[np.lexsort([ids, -score])[:5]]}
    got = {(r.query_id, r.vec_id) for r in queries.op6_nearest_neighbours(spark, SF_DIR).collect()}
    assert len(got & want) >= 0.99 * len(want)


def test_packing_query_covers_every_token(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in queries.op3_best_fit_packing(spark, SF_DIR).collect():
        ids = np.array(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [1], "<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
