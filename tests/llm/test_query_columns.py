"""The columns of the queries that other tests reach only through their operators."""

import hashlib
import zlib

import numpy as np
import pytest
from test_packing_output import plain_ids
from test_text_matching import (
    benchmark_rows, contamination_brute, fingerprint_brute, repeated_brute, smallest_reachable,
)

from icetally.llm import binary_output, decontaminate, embeddings, packing, simhash, substrings


@pytest.fixture(scope="module")
def folder(spark, docs, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    items = spark.createDataFrame(benchmark_rows(corpus), "item_id string, text string")
    items.write.parquet(f"{path}/benchmark.parquet")
    return path


def crc(ids):
    return zlib.crc32(ids.astype("<u4").tobytes())


def test_op1(spark, folder, corpus):
    got = packing.op1_best_fit_packing(spark, folder).collect()
    want = []
    for doc, text in corpus:
        ids = plain_ids(text, 0)
        for piece, start in enumerate(range(0, len(ids), 2048)):
            cut = ids[start : start + 2048]
            want.append((str(doc), piece, start, len(cut), crc(cut)))
    names = ("piece", "start", "length", "ids_crc32")
    assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in got) == sorted(want)


def test_op2(spark, folder, corpus):
    got = substrings.op2_substring_dedup(spark, folder)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == repeated_brute(corpus, 50)


def test_op3(spark, folder, corpus):
    got = simhash.op3_simhash_near_dedup(spark, folder).collect()
    prints = [(d, fingerprint_brute(t)) for d, t in corpus if d is not None]
    linked = [(a, b) for a, f in prints for b, g in prints if a < b and bin(f ^ g).count("1") <= 3]
    root = smallest_reachable({d for d, _ in prints}, linked)
    mine = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] is not None)
    assert mine == sorted((d, f"{f:016x}", root[d]) for d, f in prints)


def test_op7(spark, folder, corpus):
    got = decontaminate.op7_benchmark_decontamination(spark, folder).collect()
    want = {}
    for doc, n_words, n_hit, items in contamination_brute(corpus, benchmark_rows(corpus)):
        listed = ",".join(sorted(str(i) for i in items))
        row = (n_words, n_hit, len(items), hashlib.sha256(listed.encode()).hexdigest(), n_hit > 0)
        want.setdefault(str(doc), []).append(row)
    mine = {}
    for r in got:
        row = tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
        mine.setdefault(str(r["doc_id"]), []).append(row)
    assert {d: sorted(v) for d, v in mine.items()} == {d: sorted(v) for d, v in want.items()}


def test_op10(spark, folder, corpus):
    got = binary_output.op10_token_id_output(spark, folder).collect()
    mine = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got)
    rows = [(str(d), plain_ids(t, 2)) for d, t in corpus]
    assert mine == sorted((d, len(ids), crc(ids)) for d, ids in rows)
    order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in order] == np.cumsum([0, *(r["n_tokens"] for r in order)])[:-1].tolist()
    named = [r["doc_id"] for r in order if r["doc_id"] is not None]
    assert named == sorted(named)


def test_op8_finds_planted_pairs(spark, tmp_path):
    """Random vectors hold no close pair, so some get a neighbour at a known cosine."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    planted = []
    for i, cosine in zip(range(0, 300), np.linspace(0.90, 0.999, 300)):
        away = rng.normal(size=64)
        away -= away @ x[i] * x[i]
        planted.append(cosine * x[i] + np.sqrt(1 - cosine**2) * away / np.linalg.norm(away))
    every = np.concatenate([x, planted]).astype(np.float32)
    spark.createDataFrame(list(enumerate(every.tolist())), "vec_id long, embedding array<float>").write.parquet(
        f"{tmp_path}/embeddings.parquet"
    )
    unit = every.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = ((unit @ unit.T) >= 0.95).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embeddings.op8_embedding_near_dedup(spark, str(tmp_path)).collect()}
    assert want.sum() >= 250 and [got[i] for i in range(len(every))] == want.tolist()
