"""Substring dedup, SimHash groups and benchmark windows against brute force."""

import hashlib
import re

import pytest
import xxhash

from icetally.llm import decontaminate, simhash, substrings

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def repeated_brute(rows, window):
    """Kept words of each row, by comparing every window with the windows of smaller ids."""
    low = {}
    words = [SPACED.findall(t or "") for _, t in rows]
    big = substrings.NO_ID
    for (doc, _), w in zip(rows, words):
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            low[key] = min(low.get(key, big + 1), big if doc is None else doc)
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for a in range(len(w) - window + 1):
            if low[tuple(w[a : a + window])] < (big if doc is None else doc):
                gone.update(range(a, a + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), sha(kept)))
    return sorted(out, key=str)


def test_cover_has_every_difference():
    found = {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER}
    assert found == set(range(substrings.PERIOD))


@pytest.mark.parametrize("window", [50, 33])
def test_repeated_windows(docs, corpus, window):
    got = substrings.repeated_windows(docs, window).collect()
    assert sorted(((r[0], r[1], r[2], r[3]) for r in got), key=str) == repeated_brute(corpus, window)
    for r in got:
        assert sum(s["stop"] - s["first"] for s in r["spans"]) == r["n_removed"]


def test_windows_of_a_hot_passage_across_batches(spark):
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(i, f"a{i} {passage} b{i}" if i % 3 else passage) for i in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted(tuple(r)[:4] for r in substrings.repeated_windows(frame).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(repeated_brute(rows, 50))


def test_windows_that_a_document_repeats(spark):
    rows = [(0, "er " * 400), (1, "a b " + "er " * 90 + "c " + "er " * 70), (2, "x y " * 200), (3, "z " + "y x " * 60)]
    rows += [(4, "er " * 49), (5, ("er " * 49 + "q ") * 5), (6, ("er " * 49 + "q ") * 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[:4] for r in substrings.repeated_windows(frame).collect())
    assert got == sorted(repeated_brute(rows, 50))
    one = substrings.anchor_rows(
        spark.createDataFrame([(1, 1, 400, substrings.zstandard.compress(b"er " * 400))], "uid long, ord long, n_words long, packed binary"), 50
    )
    assert one.count() == 1


def fingerprint_brute(text):
    words = SPACED.findall(lower_ascii(text))
    if not words:
        return 0
    cut = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(c.encode(), 42) for c in cut]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(nodes, linked):
    root = {n: n for n in nodes}
    while True:
        before = dict(root)
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root


def test_simhash_groups(docs, corpus):
    prints = [(d, fingerprint_brute(t)) for d, t in corpus]
    owners = [(d, f) for d, f in prints if d is not None]
    linked = [
        (a, b) for a, f in owners for b, g in owners if a < b and bin(f ^ g).count("1") <= 3
    ]
    root = smallest_reachable({d for d, _ in owners}, linked)
    by_print = {f: root[d] for d, f in owners}
    want = sorted(((d, f, root[d] if d is not None else by_print.get(f)) for d, f in prints), key=str)
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.groups(docs).collect()]
    assert sorted(got, key=str) == want


def test_chunked_keys_lose_no_link(spark, monkeypatch):
    """One key with more classes than a chunk, and a chain of links."""
    import random

    rnd = random.Random(2)
    fps, at = set(), 0
    for _ in range(700):
        at ^= 1 << rnd.randrange(20)
        fps.add(at)
    fps |= {rnd.getrandbits(64) for _ in range(300)}
    named = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(sorted(fps, key=hash))]
    monkeypatch.setattr(simhash, "CHUNK", 64)
    scratch = simhash.Scratch(spark)
    links = simhash.class_links(spark.createDataFrame(named, "fp long, name long"), scratch)
    got = {r["node"]: r["root"] for r in simhash.components(links, scratch, "roots").collect()}
    pairs = [
        (a, b)
        for i, (f, a) in enumerate(named)
        for g, b in named[i + 1 :]
        if bin((f ^ g) % (1 << 64)).count("1") <= 3
    ]
    root = smallest_reachable({n for _, n in named}, pairs)
    assert {n: got.get(n, n) for _, n in named} == root


def benchmark_rows(corpus):
    by_id = dict(corpus)
    cut = lambda d, a, b: " ".join(ALNUM.findall(by_id[d])[a:b])
    return [
        (1, cut(92, 100, 118)), (2, cut(92, 109, 125)), (3, "one"), (4, "w1 w2"), (5, None),
        (6, "..."), (7, cut(3, 0, 9)), (8, cut(40, 10, 20).upper()), (9, "not there at all"),
        (10, cut(92, 5000, 5030) + " zz"), (None, cut(60, 3, 13)), (1, "w3 W4 w5"),
    ]


def contamination_brute(docs, items, window=10):
    runs = {}
    for item, text in items:
        w = ALNUM.findall(lower_ascii(text))
        for a in range(max(1, len(w) - window + 1) if w else 0):
            runs.setdefault(tuple(w[a : a + window]), set()).add(item)
    out = []
    for doc, text in docs:
        w = ALNUM.findall(lower_ascii(text))
        hit, names = set(), set()
        for a in range(len(w)):
            for n in range(1, window + 1):
                key = tuple(w[a : a + n])
                if len(key) == n and key in runs:
                    hit.update(range(a, a + n))
                    names |= runs[key]
        names = sorted(str(n) for n in names if n is not None)
        out.append((doc, len(w), len(hit), tuple(names)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [10**6, 25])
def test_contamination(spark, docs, corpus, block):
    items = benchmark_rows(corpus)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, benchmark, block_words=block).collect()
    got = [
        (r["doc_id"], r["n_words"], sum(s["stop"] - s["first"] for s in r["spans"]), tuple(r["items"]))
        for r in got
    ]
    assert sorted(got, key=str) == contamination_brute(corpus, items)


def test_empty_tables(spark, no_docs, docs, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    assert substrings.repeated_windows(no_docs).collect() == []
    assert simhash.groups(no_docs).collect() == []
    assert decontaminate.contamination(no_docs, none).collect() == []
    got = decontaminate.contamination(docs, none)
    assert got.where("size(spans) > 0").count() == 0 and got.count() == len(corpus)
