"""Each stage of the pipeline against brute force on what the stage before kept."""

import random

import corpus_pipeline
from test_lines import brute as lines_brute
from test_packing_output import check_packed, plain_ids
from test_text_matching import contamination_brute, fingerprint_brute, smallest_reachable

BAD = ["grum", "flox", "zarn"]


def make(spark, folder):
    rnd = random.Random(12)
    words = [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    text = lambda: "\n".join(line(rnd.randint(4, 14)) for _ in range(rnd.randint(1, 9)))
    rows, labels = [], []
    for i in range(500):
        body = text()
        if i % 5 == 0:
            body += f"\n{line(6)} {rnd.choice(BAD)} {line(6)}"
        rows.append((i, body))
        labels.append((i, 1, int(i % 5 == 0)))
    block = "\n".join(line(8) for _ in range(4))
    item = line(14)
    rows += [(600 + i, f"{line(30)}\n{block}\n{line(20)}") for i in range(5)]
    rows += [(620 + i, rows[1 + i][1]) for i in range(8)]
    long = line(300)
    rows += [(640 + i, long if i == 0 else f"{long} x{i}") for i in range(4)]
    rows += [(650 + i, f"{line(9)} {item.upper()} {line(9)}") for i in range(3)]
    rows += [(700, None), (701, ""), (702, line(5000)), (None, "no id here at all"), (704, line(2))]
    rnd.shuffle(rows)
    docs = [(d, t, "en", "s", None if t is None else len(t)) for d, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, item), (2, line(12)), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    rows, items = make(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns

    def step(n, given):
        out = corpus_pipeline.STAGES[n][1](spark, given, folder)
        assert n == 4 or out.columns == columns
        path = f"{folder}/stage-{n}"
        out.write.parquet(path)
        return spark.read.parquet(path)

    held = lambda frame: [(r["doc_id"], r["text"]) for r in frame.collect()]

    docs = step(0, docs)
    kept = held(docs)
    toxic = {d for d, t in rows if t and any(b in t.split() for b in BAD)}
    left = {d for d, _ in kept}
    clean = {d for d, _ in rows} - toxic
    assert len(toxic & left) <= 0.1 * len(toxic) and len(clean - left) <= 0.02 * len(clean)

    docs = step(1, docs)
    want = [(d, t) for d, t, n, gone in lines_brute(kept, 3) if gone < n or not n]
    assert sorted(held(docs), key=str) == sorted(want, key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in docs.where("text is not null").collect())
    kept = want

    docs = step(2, docs)
    prints = [(d, fingerprint_brute(t)) for d, t in kept if d is not None]
    linked = [(a, b) for a, f in prints for b, g in prints if a < b and bin(f ^ g).count("1") <= 3]
    root = smallest_reachable({d for d, _ in prints}, linked)
    want = [(d, t) for d, t in kept if d is None or root[d] == d]
    assert sorted(held(docs), key=str) == sorted(want, key=str)
    kept = want

    docs = step(3, docs)
    hit = {d for d, _, n, _ in contamination_brute(kept, items) if n}
    assert hit == {650, 651, 652} & {d for d, _ in kept}
    want = [(d, t) for d, t in kept if d not in hit]
    assert sorted(held(docs), key=str) == sorted(want, key=str)

    pieces = step(4, docs).collect()
    check_packed(pieces, 2048, [(d, plain_ids(t, 0)) for d, t in want])

    again = corpus_pipeline.run(spark, folder)
    digest = lambda got: sorted((str(r["doc_id"]), r["piece"], r["ids_crc32"]) for r in got)
    assert digest(again.collect()) == digest(pieces)


def test_empty_documents(spark, tmp_path):
    make(spark, str(tmp_path))
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []
