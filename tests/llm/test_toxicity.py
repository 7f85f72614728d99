"""The network's gradients and its accuracy on rows that it hasn't seen."""

import random
import zlib

import numpy as np

from icetally.llm import toxicity
from icetally.llm.shared import Scratch

BAD = ["grum", "flox", "zarn"]
PLAIN = [f"word{i}" for i in range(300)]


def rows(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        words = [rnd.choice(PLAIN) for _ in range(rnd.randint(5, 220))]
        toxic = i % 5 == 0
        if toxic:
            words[rnd.randrange(len(words))] = rnd.choice(BAD)
        out.append((i, " ".join(words).capitalize() + ".", int(toxic)))
    return out


def test_states_match_a_loop_over_words():
    rng = np.random.default_rng(0)
    model = toxicity.Model(toxicity.initial(rng), np.zeros(toxicity.BUCKETS), np.zeros(toxicity.BUCKETS), 0.1)
    reader, p, h = model.reader(), model.p, toxicity.HIDDEN
    words = [b"one", b"two", b"three", b"one"]
    got = reader.logits(reader.windows(reader.numbers(words)))[0]
    ids = reader.numbers(words)

    def run(gates, U):
        state, out = np.zeros(h), []
        for g in gates:
            z = 1 / (1 + np.exp(-(g[:h] + state @ U[:, :h])))
            r = 1 / (1 + np.exp(-(g[h : 2 * h] + state @ U[:, h : 2 * h])))
            c = np.tanh(g[2 * h :] + (r * state) @ U[:, 2 * h :])
            state = (1 - z) * state + z * c
            out.append(state)
        return out

    forward = run([reader.forward[i] for i in ids], p["Uf"])
    backward = run([reader.backward[i] for i in ids[::-1]], p["Ub"])[::-1]
    states = np.array([np.concatenate(s) for s in zip(forward, backward)])
    score = np.tanh(states @ p["A"] + p["a"]) @ p["v"]
    weight = np.exp(score) / np.exp(score).sum()
    assert abs(got - (weight @ states @ p["o"] + p["o0"][0])) < 1e-4


def test_windows_cover_whole_texts():
    reader = toxicity.Model(toxicity.initial(np.random.default_rng(0)), np.zeros(toxicity.BUCKETS), np.zeros(toxicity.BUCKETS), 0.1).reader()
    for n in (0, 1, 31, 32, 33, 100, 1000):
        windows = reader.windows(np.arange(n, dtype=np.int32))
        assert set(windows.ravel().tolist()) - {-1} == set(range(n))
        assert n <= 32 or (np.diff(np.sort(windows[:, 0])) <= toxicity.STRIDE).all()


def test_held_out_accuracy_and_odd_rows(spark):
    data = rows(1500, 3)
    odd = [(9001, None), (9002, ""), (9003, "..."), (None, "grum"), (9004, "word1 " * 20_000), (7, "again")]
    docs = spark.createDataFrame([(d, t, 1) for d, t, _ in data] + [(*o, 1) for o in odd], "doc_id long, text string, toxic int")
    labels = [(d, y) for d, _, y in data] + [(None, 1), (9002, None), (77_777, 1), (3, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, Scratch(spark))
    got = toxicity.scores(docs, model).collect()
    assert len(got) == len(data) + len(odd)
    assert all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    unseen = [(score[d], y) for d, _, y in data if zlib.crc32(str(d).encode()) % 4 == 2 and d != 7]
    right = sum((s >= 0.3) == bool(y) for s, y in unseen)
    assert right / len(unseen) > 0.95


def test_no_labels_and_no_rows(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = toxicity.fit(docs, labels, Scratch(spark))
    assert toxicity.scores(no_docs, model).collect() == []
    got = [r["score"] for r in toxicity.scores(docs, model).collect()]
    assert len(got) == 2 and all(0 <= s < 0.3 for s in got)
