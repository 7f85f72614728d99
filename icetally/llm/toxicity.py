"""Toxicity of whole texts by a small recurrent network, trained in numpy.

A bidirectional gated recurrent network reads windows of words; each word comes in as a hashed word
vector, the mean vector of its character trigrams, and its hashed log-odds in the training
rows. Attention pools the states of a window into one logit, and a document has that of its worst
window; windows overlap by half, start at every 16th word and at the last place, and cover every
word of the whole text. Training uses a bounded sample of
the labelled rows: word statistics and windows are made by Spark, the weights on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icetally.llm.decontaminate import split_words
from icetally.llm.shared import Scratch, batched, rows, text_bytes

SAMPLE = 8_000
"""Labelled rows that the model is fitted on, chosen by a hash of their id."""
LENGTH, STRIDE = 32, 16
BUCKETS = 1 << 18
WORD_ROWS, CHAR_ROWS, WORD_DIM, CHAR_DIM, HIDDEN, LOOK = 4096, 2048, 4, 4, 8, 8
PRIOR = 4.0
WORD_CACHE = 150_000
BATCH = 2048


def buckets_of(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(w) for w in words], dtype=np.int64) % BUCKETS


def trigrams_of(word: bytes) -> list[int]:
    held = b"^" + word + b"$"
    return [xxhash.xxh32_intdigest(held[i : i + 3], 3) % CHAR_ROWS for i in range(max(1, len(held) - 2))]


def log_odds(toxic: np.ndarray, clean: np.ndarray, rate: float) -> np.ndarray:
    """Shrunk towards the base rate; as large as 4."""
    share = (toxic + PRIOR * rate) / (clean + PRIOR * (1 - rate))
    return np.clip(np.log(share * (1 - rate) / rate), -4, 4)


def inputs_width() -> int:
    return 1 + WORD_DIM + CHAR_DIM


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    d, h = inputs_width(), HIDDEN
    near = lambda *shape, s: rng.normal(scale=s, size=shape)
    out = {"word": near(WORD_ROWS, WORD_DIM, s=0.1), "char": near(CHAR_ROWS, CHAR_DIM, s=0.1)}
    for way in ("f", "b"):
        out |= {
            f"W{way}": near(d, 3 * h, s=0.4),
            f"U{way}": near(h, 3 * h, s=0.3),
            f"c{way}": np.zeros(3 * h),
        }
    out |= {"A": near(2 * h, LOOK, s=0.4), "a": np.zeros(LOOK), "v": near(LOOK, s=0.4)}
    return out | {"o": near(2 * h, s=0.4), "o0": np.zeros(1)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def recur(gates: list[np.ndarray], mask: np.ndarray | None, U: np.ndarray, keep: bool):
    """States over the steps, from the inputs' share of the gates; what backward needs if asked."""
    n, h = gates[0].shape[0], HIDDEN
    state = np.zeros((n, h), dtype=U.dtype)
    states, held = [], []
    for t, gate in enumerate(gates):
        zr = sigmoid(gate[:, : 2 * h] + state @ U[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        c = np.tanh(gate[:, 2 * h :] + (r * state) @ U[:, 2 * h :])
        new = state + z * (c - state)
        if mask is not None:
            new = np.where(mask[t], new, state)
        if keep:
            held.append((state, z, r, c))
        state = new
        states.append(state)
    return states, held


def recur_back(grads: list[np.ndarray], held: list, mask: np.ndarray, U: np.ndarray):
    """Gradients of the gate inputs and of U."""
    h, dU = HIDDEN, np.zeros_like(U)
    later = np.zeros_like(grads[0])
    out = [None] * len(grads)
    for t in range(len(grads) - 1, -1, -1):
        before, z, r, c = held[t]
        total = grads[t] + later
        active = np.where(mask[t], total, 0)
        dc = active * z * (1 - c * c)
        dz = active * (c - before) * z * (1 - z)
        drh = dc @ U[:, 2 * h :].T
        dr = drh * before * r * (1 - r)
        dgate = np.concatenate((dz, dr, dc), axis=1)
        dU[:, : 2 * h] += before.T @ dgate[:, : 2 * h]
        dU[:, 2 * h :] += (r * before).T @ dc
        later = np.where(mask[t], 0, total) + active * (1 - z) + drh * r
        later = later + dgate[:, : 2 * h] @ U[:, : 2 * h].T
        out[t] = dgate
    return out, dU


def attend(states: np.ndarray, mask: np.ndarray | None, p: dict) -> tuple:
    """Logits of windows from their states (steps, windows, 2 x hidden)."""
    look = np.tanh(states @ p["A"] + p["a"])
    score = look @ p["v"]
    if mask is not None:
        score = np.where(mask, score, -1e9)
    weight = np.exp(score - score.max(axis=0))
    if mask is not None:
        weight = weight * mask
    weight = weight / np.maximum(weight.sum(axis=0), 1e-9)
    pooled = np.einsum("tn,tnh->nh", weight, states)
    return pooled @ p["o"] + p["o0"][0], look, weight, pooled


class Vocabulary:
    """Numbers of words, with what the network reads of each."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.chars: list[list[int]] = []
        self.bucket: list[int] = []

    def numbers(self, words: list[bytes]) -> list[int]:
        out = []
        for w in words:
            if w not in self.ids:
                self.ids[w] = len(self.bucket)
                self.bucket.append(xxhash.xxh32_intdigest(w) % BUCKETS)
                self.chars.append(trigrams_of(w))
            out.append(self.ids[w])
        return out


def char_matrix(chars: list[list[int]], table: np.ndarray) -> np.ndarray:
    """Mean trigram vectors of words."""
    sizes = np.array([len(c) for c in chars], dtype=np.int64)
    flat = np.fromiter((x for c in chars for x in c), np.int64, int(sizes.sum()))
    out = np.zeros((len(chars), table.shape[1]), dtype=table.dtype)
    np.add.at(out, np.repeat(np.arange(len(chars)), sizes), table[flat])
    return out / np.maximum(sizes, 1)[:, None]


def train(
    windows: list[list[bytes]], odds: list[np.ndarray], labels: np.ndarray,
    batch: int = 64, rate: float = 0.01, seed: int = 1,
) -> dict[str, np.ndarray]:
    """Fit the weights to windows by backpropagation and Adam."""
    rng = np.random.default_rng(seed)
    p = initial(rng)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    words = Vocabulary()
    n = len(windows)
    number = np.full((n, LENGTH), -1, dtype=np.int64)
    lo = np.zeros((n, LENGTH))
    for i, (w, o) in enumerate(zip(windows, odds)):
        number[i, : len(w)] = words.numbers(w)
        lo[i, : len(w)] = o
    if not n or not words.bucket:
        return p
    word_row = np.array(words.bucket) % WORD_ROWS
    most = max(map(len, words.chars))
    chars = np.full((len(words.chars), most), -1, dtype=np.int64)
    for i, c in enumerate(words.chars):
        chars[i, : len(c)] = c
    n_chars = (chars >= 0).sum(axis=1)
    step = 0
    # Two passes over a large sample, more over a small one.
    for _ in range(max(2, min(60, round(250 * batch / n)))):
        order = rng.permutation(n)
        for a in range(0, n, batch):
            own = order[a : a + batch]
            ids, y = number[own].T, labels[own]
            mask = ids >= 0
            safe = np.where(mask, ids, 0)
            mean = (p["char"][np.maximum(chars, 0)[safe]] * (chars[safe] >= 0)[..., None]).sum(axis=2)
            mean = mean / n_chars[safe][..., None]
            x = np.concatenate((lo[own].T[..., None], p["word"][word_row[safe]], mean), axis=2)
            # Half of the learned inputs are hidden at a time, so that no word is learned by heart.
            shown = np.ones(x.shape)
            shown[..., 1:] = np.where(rng.random(ids.shape) < 0.5, 0.0, 2.0)[..., None]
            x = x * mask[..., None] * shown
            cell_mask = mask[..., None]
            gates = {w: list(x @ p[f"W{w}"] + p[f"c{w}"]) for w in "fb"}
            sf, hf = recur(gates["f"], cell_mask, p["Uf"], True)
            sb, hb = recur(gates["b"][::-1], cell_mask[::-1], p["Ub"], True)
            states = np.concatenate((np.stack(sf), np.stack(sb[::-1])), axis=2)
            logit, look, weight, pooled = attend(states, mask, p)
            dlogit = (sigmoid(logit) - y) / len(own)
            g = {"o": pooled.T @ dlogit, "o0": np.array([dlogit.sum()])}
            dpooled = dlogit[:, None] * p["o"]
            dstates = weight[..., None] * dpooled
            dweight = np.einsum("tnh,nh->tn", states, dpooled)
            dscore = weight * (dweight - (weight * dweight).sum(axis=0))
            g["v"] = np.einsum("tnk,tn->k", look, dscore)
            dlook = dscore[..., None] * p["v"] * (1 - look * look)
            g["A"] = np.einsum("tnh,tnk->hk", states, dlook)
            g["a"] = dlook.sum(axis=(0, 1))
            dstates = dstates + dlook @ p["A"].T
            back_f, g["Uf"] = recur_back(list(dstates[..., :HIDDEN]), hf, cell_mask, p["Uf"])
            back_b, g["Ub"] = recur_back(
                list(dstates[::-1, :, HIDDEN:]), hb, cell_mask[::-1], p["Ub"]
            )
            dx = 0
            for w, back in (("f", np.stack(back_f)), ("b", np.stack(back_b[::-1]))):
                g[f"W{w}"] = np.einsum("tnd,tng->dg", x, back)
                g[f"c{w}"] = back.sum(axis=(0, 1))
                dx = dx + back @ p[f"W{w}"].T
            dx = dx * mask[..., None] * shown
            g["word"] = np.zeros_like(p["word"])
            np.add.at(g["word"], word_row[safe], dx[..., 1 : 1 + WORD_DIM])
            g["char"] = np.zeros_like(p["char"])
            share = dx[..., 1 + WORD_DIM :] / n_chars[safe][..., None]
            spread = (chars[safe] >= 0)[..., None] * share[:, :, None, :]
            np.add.at(g["char"], np.maximum(chars[safe], 0), spread)
            step += 1
            for k, grad in g.items():
                first[k] += 0.1 * (grad - first[k])
                second[k] += 0.001 * (grad * grad - second[k])
                size = first[k] / (1 - 0.9**step)
                p[k] -= rate * size / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                if k in ("word", "char"):
                    p[k] *= 1 - 0.02 * rate
    return p


class Model:
    """Weights, word statistics and calibration; scores windows in batches."""

    def __init__(self, weights: dict, toxic: np.ndarray, clean: np.ndarray, rate: float):
        self.p = {k: v.astype(np.float32) for k, v in weights.items()}
        self.toxic, self.clean, self.rate = toxic, clean, rate
        self.odds = log_odds(toxic, clean, rate).astype(np.float32)
        self.scale, self.shift = 1.0, 0.0

    def reader(self) -> "Reader":
        return Reader(self)

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * logits + self.shift)))


class Reader:
    """Scores texts in one task. Words that it has met keep their share of the gates."""

    def __init__(self, model: Model):
        self.model, self.p = model, model.p
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.forward = np.zeros((1024, 3 * HIDDEN), dtype=np.float32)
        self.backward = np.zeros((1024, 3 * HIDDEN), dtype=np.float32)

    def learn(self, new: list[bytes]) -> None:
        bucket = buckets_of(new)
        chars = char_matrix([trigrams_of(w) for w in new], self.p["char"]).astype(np.float32)
        x = np.concatenate(
            (self.model.odds[bucket][:, None], self.p["word"][bucket % WORD_ROWS], chars), axis=1
        )
        base = len(self.known)
        self.known.update((w, base + i) for i, w in enumerate(new))
        while len(self.known) > len(self.forward):
            self.forward = np.concatenate((self.forward, np.zeros_like(self.forward)))
            self.backward = np.concatenate((self.backward, np.zeros_like(self.backward)))
        self.forward[base : base + len(new)] = x @ self.p["Wf"] + self.p["cf"]
        self.backward[base : base + len(new)] = x @ self.p["Wb"] + self.p["cb"]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self.known.get, words))
        if None in found:
            new = list(dict.fromkeys(w for w, i in zip(words, found) if i is None))
            self.learn(new)
            found = list(map(self.known.get, words))
        return np.array(found, dtype=np.int32)

    def windows(self, numbers: np.ndarray) -> np.ndarray:
        """All overlapping windows of a text; the last one ends with it. Short texts are padded."""
        n = len(numbers)
        if n <= LENGTH:
            out = np.full((1, LENGTH), -1, dtype=np.int32)
            out[0, :n] = numbers
            return out
        starts = np.append(np.arange(0, n - LENGTH, STRIDE), n - LENGTH)
        return np.lib.stride_tricks.sliding_window_view(numbers, LENGTH)[starts]

    def logits(self, windows: np.ndarray) -> np.ndarray:
        steps = np.ascontiguousarray(windows.T)
        mask = steps >= 0
        whole = bool(mask.all())
        cell_mask = None if whole else mask[..., None]
        safe = steps if whole else np.where(mask, steps, 0)
        if not len(self.known):
            self.learn([b""])
        f, _ = recur([self.forward[s] for s in safe], cell_mask, self.p["Uf"], False)
        back = None if whole else cell_mask[::-1]
        b, _ = recur([self.backward[s] for s in safe[::-1]], back, self.p["Ub"], False)
        states = np.concatenate((np.stack(f), np.stack(b[::-1])), axis=2)
        return attend(states, None if whole else mask, self.p)[0]

    def score(self, texts: Iterator[tuple]) -> Iterator[tuple]:
        """(key, ..., text) to (key, ..., logit of the worst window)."""
        keys, parts, sizes = [], [], []

        def flush() -> Iterator[tuple]:
            every = np.concatenate(parts)
            short = (every < 0).any(axis=1)
            logit = np.empty(len(every), dtype=np.float64)
            for own in (np.flatnonzero(short), np.flatnonzero(~short)):
                for a in range(0, len(own), BATCH):
                    logit[own[a : a + BATCH]] = self.logits(every[own[a : a + BATCH]])
            ends = np.cumsum(sizes)
            worst = np.maximum.reduceat(logit, ends - np.array(sizes))
            yield from ((*k, float(x)) for k, x in zip(keys, worst))

        for *key, text in texts:
            windows = self.windows(self.numbers(split_words(text)))
            keys.append(tuple(key))
            parts.append(windows)
            sizes.append(len(windows))
            if sum(sizes) >= BATCH:
                yield from flush()
                keys, parts, sizes = [], [], []
                if len(self.known) > WORD_CACHE:
                    self.forget()
        if keys:
            yield from flush()


def held_out(column="doc_id"):
    """The rows that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> Model:
    """Fit the network to at most ``sample`` labelled rows that aren't held out.

    A document counts as toxic if one of its labels says so. Without any usable label the score
    of every text is the same.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` rows of two numbers.
    texts = text_bytes(docs).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    texts = scratch.write(texts.select("doc_id", "label", "text"), "train")
    totals = texts.agg(F.sum("label"), F.count("*")).first()
    positive, total = float(totals[0] or 0), int(totals[1])
    rate = min(max(positive / max(total, 1), 1e-3), 1 - 1e-3)

    def occurring(batches):
        schema = pa.schema([("bucket", pa.int32()), ("toxic", pa.int64()), ("clean", pa.int64())])
        counts = np.zeros((2, BUCKETS), dtype=np.int64)
        for label, text in rows(batches, "label", "text"):
            counts[int(label < 0.5), np.unique(buckets_of(list(set(split_words(text)))))] += 1
        used = np.flatnonzero(counts.any(axis=0))
        columns = [pa.array(used.astype(np.int32)), *(pa.array(c[used]) for c in counts)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    counted = texts.mapInArrow(occurring, "bucket int, toxic long, clean long")
    counted = counted.groupBy("bucket").agg(F.sum("toxic"), F.sum("clean")).toArrow()
    toxic, clean = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counted.column(0).to_numpy()
    toxic[at], clean[at] = counted.column(1).to_numpy(), counted.column(2).to_numpy()

    def without(label: float, words: list[bytes]) -> np.ndarray:
        """Log-odds of a training row's words as the other rows give them."""
        bucket = buckets_of(words)
        own = 1.0 if label > 0.5 else 0.0
        return log_odds(np.maximum(toxic[bucket] - own, 0), np.maximum(clean[bucket] - 1 + own, 0), rate)

    def chosen_windows(batches):
        schema = pa.schema(
            [("label", pa.float64()), ("words", pa.list_(pa.binary())), ("odds", pa.list_(pa.float64()))]
        )

        def records():
            for doc_id, label, text in rows(batches, "doc_id", "label", "text"):
                words = split_words(text)
                odds = without(label, words)
                last = max(0, len(words) - LENGTH)
                starts = np.append(np.arange(0, last, STRIDE), last)
                worst, best = 0, (-np.inf, 0.0)
                for a in starts.tolist():
                    own = odds[a : a + LENGTH]
                    value = (own.max(initial=-9), own.sum())
                    if value > best:
                        worst, best = a, value
                yield label, words[worst : worst + LENGTH], odds[worst : worst + LENGTH]
                other = int(starts[hash(doc_id) % len(starts)])
                if label < 0.5 and other != worst:
                    yield label, words[other : other + LENGTH], odds[other : other + LENGTH]

        yield from batched(records(), schema)

    # A quarter of the rows is kept for the calibration.
    in_fold = "pmod(xxhash64(doc_id, 1), 4) = 0"
    found = texts.where(f"not {in_fold}").mapInArrow(
        chosen_windows, "label double, words array<binary>, odds array<double>"
    ).toArrow()
    y = found.column("label").to_numpy()
    # The order of the rows shall not depend on how Spark dealt them.
    words, odds = found.column("words").to_pylist(), found.column("odds").to_pylist()
    order = sorted(range(len(y)), key=lambda i: (words[i], y[i]))
    weights = train(
        [words[i] for i in order], [np.array(odds[i]) for i in order], y[order]
    )
    model = Model(weights, toxic, clean, rate)

    def judged(batches):
        reader = model.reader()

        def cleaned():
            # The row's own share of the counts is taken out while it is scored.
            for label, text in rows(batches, "label", "text"):
                bucket = np.unique(buckets_of(list(set(split_words(text)))))
                own = 1.0 if label > 0.5 else 0.0
                kept = model.odds[bucket].copy()
                model.odds[bucket] = log_odds(
                    np.maximum(toxic[bucket] - own, 0), np.maximum(clean[bucket] - 1 + own, 0), rate
                )
                reader.forget()
                yield from reader.score(iter([(label, text)]))
                model.odds[bucket] = kept

        schema = pa.schema([("label", pa.float64()), ("logit", pa.float64())])
        yield from batched(cleaned(), schema)

    fold = texts.where(in_fold).mapInArrow(judged, "label double, logit double")
    fold = fold.toArrow()
    model.scale, model.shift = calibrated(fold.column(1).to_numpy(), fold.column(0).to_numpy(), rate)
    return model


def calibrated(logits: np.ndarray, y: np.ndarray, rate: float) -> tuple[float, float]:
    """Scale and shift that make the worst window's logit a probability (two-parameter logistic fit)."""
    base = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0 if len(y) else base
    x = np.stack((logits, np.ones_like(logits)), axis=1)
    w = np.array([1.0, 0.0])
    # A mild pull to scale 1 and shift 0, so that a separable fold has a finite answer.
    for _ in range(100):
        q = sigmoid(x @ w)
        slope = x.T @ (q - y) + (w - [1.0, 0.0])
        hessian = x.T @ (x * (q * (1 - q))[:, None]) + np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, slope), -0.5, 0.5)
    return max(float(w[0]), 0.05), float(w[1])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) for each row; null and empty texts are scored as no words."""
    schema = pa.schema([("doc_id", pa.int64()), ("logit", pa.float64())])

    def judge(batches):
        yield from batched(model.reader().score(rows(batches, "doc_id", "text")), schema)

    found = text_bytes(docs).mapInArrow(judge, "doc_id long, logit double")
    logit = F.lit(model.scale) * F.col("logit") + F.lit(model.shift)
    return found.select("doc_id", (1 / (1 + F.exp(-logit))).alias("score"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold."""

    def keep(batches):
        reader = model.reader()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            each = ((i, (t.as_py() or "").encode()) for i, t in enumerate(texts))
            logit = np.empty(batch.num_rows)
            for i, x in reader.score(each):
                logit[i] = x
            yield batch.filter(pa.array(model.probability(logit) < threshold))

    return docs.mapInArrow(keep, docs.schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, Scratch(spark))
    return scores(docs, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
