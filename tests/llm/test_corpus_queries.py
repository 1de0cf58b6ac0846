"""Corpus queries against their SQL, and those without SQL against plain restatements."""

import hashlib
import re
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

ROOT = Path(__file__).resolve().parent.parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import check_queries  # noqa: E402

from bagwise.llm import packing  # noqa: E402
from bagwise.llm.queries import QUERIES, oracles  # noqa: E402

NEAR_PERCENT = 75


@pytest.mark.parametrize("name", list(oracles()))
def test_against_sql(spark, small, name):
    assert not check_queries.compare(spark, check_queries.connect(small), small, name).startswith("FAIL")


def test_only_these_have_no_sql():
    assert set(QUERIES) - set(oracles()) == {"op4_pii", "op8_quality_classifier", "op9_packing", "op10_near_dedup"}


def texts(folder):
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{folder}/documents.parquet'").fetchall())


def plain_shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def plain_components(docs):
    """All pairs that share a shingle, compared; the smallest id of each component."""
    sets = {i: plain_shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    holders = {}
    for i in sorted(docs):
        met = {j for s in sets[i] for j in holders.get(s, ())}
        for j in met:
            common = len(sets[i] & sets[j])
            if 100 * common >= NEAR_PERCENT * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    return {i: (len(sets[i]), find(i)) for i in docs}


def test_near_dedup(spark, small):
    expected = plain_components(texts(small))
    rows = QUERIES["op10_near_dedup"](spark, small).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_packing(spark, small):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.production_tokenizer())
    docs = texts(small)
    ids = {i: np.array(plain.encode(t, add_special_tokens=False).ids + [0], "<u4") for i, t in docs.items()}
    rows = QUERIES["op9_packing"](spark, small).collect()
    at = dict.fromkeys(docs, 0)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert all(n == 1024 or n & (n - 1) == 0 and n < 1024 for n in filled.values())


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op8_quality_classifier"](spark, folder).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall()
    held = [(rows[i].score, y) for i, y in labels if rows[i].held_out]
    good, bad = ([s for s, y in held if y == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())


def test_pipeline_stages(spark, tmp_path):
    """Each stage against what its own input says, on the smallest tables."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, folder)
        if at == len(corpus_pipeline.STAGES) - 1:
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in before}
            break
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{at}")
        docs = spark.read.parquet(f"{tmp_path}/{at}")
        after = docs.collect()
        assert set(after) <= set(before)
        if at == 1:
            norm = lambda t: hashlib.md5(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).digest()
            first = {}
            for r in before:
                first[norm(r.text)] = min(r.doc_id, first.get(norm(r.text), r.doc_id))
            assert {r.doc_id for r in after} == set(first.values())
        if at == 2:
            parts = plain_components({r.doc_id: r.text for r in before})
            assert {r.doc_id for r in after} == {i for i, (_, c) in parts.items() if c == i}
        if at == 3:
            words = lambda r: len((r.text or "").split())
            assert sum(map(words, after)) == pytest.approx(1.5 * sum(map(words, before)), rel=0.1)
            assert max(after.count(r) for r in set(after)) <= 2


def test_pipeline_is_a_query(spark, small):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"](spark, small).count() > 0
