"""Phrase counts and scores against plain counters."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from icetally.llm import collocations as co


def plain(rows, least=10, share=50):
    import re

    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        for p, a in found.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= share * a for q, b in found.items()):
                continue
            cuts = [(1000000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.append((lang, " ".join(p), a, count[p[:k]], count[p[k:]], score, n[lang]))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    words = ["The", "of", "é", "straße", "Ä", "x\x1cy", "a-b", "北京", " ", "q"] + [f"v{i}" for i in range(25)]
    weight = [1 / (i + 1) for i in range(len(words))]
    out = []
    for i in range(160):
        w = rnd.choices(words, weight, k=rnd.randint(0, 60))
        text = "".join(x + rnd.choice([" ", " ", "\t", "  ", ", ", ".", "\n", "!? "]) for x in w)
        out.append((rnd.choice(["en", "de", None, "und"]), text))
    out += [("en", None), ("fr", ""), (None, " . "), ("en", " ".join(words) * 40), ("en", out[0][1]), ("en", out[0][1])]
    return out


@pytest.mark.parametrize(
    "limits", [{}, {"full": 200, "burst": 5, "chunk": 7, "slot_chars": 300}, {"burst": 2, "slot_chars": 1}]
)
def test_counts_and_scores(spark, texts, limits):
    rows = [(*t, 5, "k", 1.0) for t in texts]
    docs = spark.createDataFrame(rows, "lang string, text string, f int, phrase string, score double")
    got = co.collocations(docs, **limits).select("lang", "phrase", "a", "l", "r", "score", "n")
    assert sorted(map(tuple, got.collect())) == plain(texts)


def test_query_equals_sql(spark, tmp_path, texts):
    spark.createDataFrame(texts, "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = co.op11_phrase_collocations(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(co.OP11_SQL).fetchall()
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50


def test_top_is_cut_per_lang(spark, texts):
    docs = spark.createDataFrame(texts, "lang string, text string")
    whole = co.collocations(docs).collect()
    got = co.collocations(docs, top=3).collect()
    for lang in {r["lang"] for r in whole}:
        order = sorted((-r["score"], -r["a"], r["phrase"].encode()) for r in whole if r["lang"] == lang)
        mine = sorted((r["rank"], r["phrase"].encode()) for r in got if r["lang"] == lang)
        assert mine == [(i + 1, x[2]) for i, x in enumerate(order[:3])]


def test_no_rows(spark):
    assert co.collocations(spark.createDataFrame([], "lang string, text string"), top=5).collect() == []


def test_large_products_are_exact(spark):
    big = 10**13
    row = spark.sql(
        f"select (1000000BD * cast({big}L as decimal(15,0)) * {big}L) div (cast({big + 1}L as decimal(19,0)) * {big + 7}L) s"
    ).first()
    assert row["s"] == 1000000 * big * big // ((big + 1) * (big + 7))


def test_trie_gives_back_what_it_got():
    rng = np.random.default_rng(1)
    trie, want = co.HatTrie(burst=4), Counter()
    for _ in range(20):
        ids = np.sort(rng.integers(1, 9, (50, 3)) @ np.array([1 << 42, 1 << 21, 1]))
        keys, n = np.unique(ids, return_counts=True)
        trie.add(keys, n)
        want.update(dict(zip(keys.tolist(), n.tolist())))
    assert trie.size == len(want)
    parts = [trie.take(left) for left in (100, 0)]
    got = Counter()
    for keys, n in parts:
        assert (np.diff(keys) > 0).all()
        got.update(dict(zip(keys.tolist(), n.tolist())))
    assert got == want and trie.size == 0
