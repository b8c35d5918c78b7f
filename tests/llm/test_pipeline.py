"""The pipeline's stages against brute force, and its queries' registration."""

import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm import feistel, queries
from tests.llm.test_minhash import brute


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "12 34", None, "s", 5), (-3, "", "en", "s", 0), (None, "the of and that is from with", "en", None, 1), (-4, "the of and 4111111111111111", "en", "s", 1), (-4, "the of and 4111111111111111", "en", "s", 1)], docs.schema)
    docs = docs.unionByName(extra)
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    assert names == ("language", "near-dedup", "pii", "packing")
    known = stages[0](spark, docs, sf)
    assert known.columns == docs.columns
    assert {r.doc_id for r in docs.join(known.select("doc_id", "text"), ["doc_id", "text"], "left_anti").collect()} >= {-1, -2, -3}
    kept = [r.doc_id for r in known.collect()]
    assert len(kept) == docs.count() - 3 and None in kept
    apart = stages[1](spark, known, sf)
    assert apart.columns == docs.columns
    groups = brute([(r.doc_id, r.text) for r in known.collect()], 80)
    assert sorted(r.doc_id for r in apart.collect() if r.doc_id is not None) == sorted({i for i, c in groups.items() if i == c})
    assert sum(r.doc_id is None for r in apart.collect()) == 1
    hidden = stages[2](spark, apart, sf)
    made = feistel.Pseudonyms(queries.DEMO_KEY)
    assert rows_of(hidden) == sorted([(r.doc_id, made.text(r.text)[0], r.lang, r.source, len(made.text(r.text)[0])) for r in apart.collect()], key=str)
    packed = stages[3](spark, hidden, sf).collect()
    library = Tokenizer.from_file(queries.tokenizer_file())
    expected = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 1] for r in hidden.collect()}
    pieces = {}
    for r in packed:
        pieces.setdefault(r.doc_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids)
    assert {i: [int(x) for r in sorted(own, key=lambda r: r.start) for x in np.frombuffer(r.ids, "<u4")] for i, own in pieces.items()} == expected


def test_registration(spark, sf):
    import __spark_entry__

    made = __spark_entry__.queries()
    assert "pipeline" in made and corpus_pipeline.ORACLE_SQL is None
    assert [sum(name.startswith(f"op{n}_") for name in made) for n in range(1, 11)] == [1] * 10
    assert set(__spark_entry__.oracle_sql()) <= set(made)
