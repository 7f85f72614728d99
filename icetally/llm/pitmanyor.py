"""Language-model scores by a hierarchical Pitman-Yor model of word pairs.

Each preceding word is a restaurant, and all of them share one parent, the restaurant of single
words, whose base is uniform over the known words and one unknown word. A word's tables in a
restaurant are its customers in the parent. Gibbs sampling takes a customer from its table and
seats it anew, or all customers of a frequent word together; discount and concentration of both
levels are sampled too. Probabilities are averaged over the samples after the burn-in.

Work is dealt by hashes: restaurants over *slots*, words of the parent over slots of their own, and
the two send each other numbers of tables and probabilities once a round. Within a round each slot
seats its customers with the other slots' totals of the round before. Texts are cut into blocks,
which ask the slots for their different pairs and words, so no token is shuffled by itself. A
preceding word that would fill a slot of its own is spread over all slots by its followers; there
are fewer of these than slots.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from icetally.llm.alignment import from_planes, planes
from icetally.llm.shared import Scratch, batched, rows

END, START = xxhash.xxh64_intdigest(b" end"), 2**64 - 1
"""The end of a text, and what precedes its first word: a place past all words in their order."""

BLOCK_TOKENS = 2 << 20
"""Tokens that a worker sends in one block, and at least one document."""

SLOT_TOKENS = 5 << 19
"""Tokens of the corpus for each slot."""

ROUNDS, BURN_IN, SWEEPS = 3, 1, 1
"""Rounds in all, rounds that are not averaged, and sweeps of the pairs in each round."""

MOST = 32
"""Customers of one dish in one restaurant that a sweep seats one by one. Those of larger dishes are
dealt over the tables all at once."""

DEALS, MARKS = 4, 10.0
"""How often a sweep deals a large dish, and marks for each customer that a table's weight is worth."""

CELLS = 1 << 20
"""Tables, taken and free ones, that a sweep holds at once, and at least one dish."""

MAIL = pa.schema(
    [("slot", pa.int64()), ("kind", pa.string()), ("sender", pa.int64()), ("data", pa.binary()),
     ("x", pa.list_(pa.float64()))]
)
MAIL_DDL = "slot long, kind string, sender long, data binary, x array<double>"
SCORES = pa.schema(
    [("doc_id", pa.int64()), ("learned", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
     ("base_score", pa.float64()), ("score", pa.float64())]
)
SCORES_DDL = "doc_id long, learned boolean, n_tokens long, n_known long, base_score double, score double"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one value: byte planes, compressed."""
    zstd, out = zstandard.ZstdCompressor(1), []
    for x in arrays:
        data = zstd.compress(planes(np.ascontiguousarray(x)))
        out += [struct.pack("<3sI", x.dtype.str.encode()[-3:], len(data)), data]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    zstd, out, at = zstandard.ZstdDecompressor(), [], 0
    while at < len(data):
        kind, size = struct.unpack_from("<3sI", data, at)
        at += 7
        out.append(from_planes(zstd.decompress(data[at : at + size]), kind.decode()))
        at += size
    return out


def slot_of(hashes: np.ndarray, slots: int) -> np.ndarray:
    """Slots ascend with the hash, so a sorted list is cut into ranges."""
    return ((hashes >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


def pair_slots(u: np.ndarray, w: np.ndarray, heavy: np.ndarray, slots: int) -> np.ndarray:
    """A pair lies with its preceding word, or if that is heavy anywhere."""
    spread = (u ^ (w * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return slot_of(np.where(np.isin(u, heavy), spread, u), slots)


def pack_pairs(u: np.ndarray, w: np.ndarray, *numbers: np.ndarray) -> bytes:
    """Pairs sorted by (u, w): each u once with its number of pairs, and w by a list of its own."""
    starts = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1]))) if len(u) else np.empty(0, np.int64)
    length = np.diff(np.append(starts, len(u)))
    listed, place = np.unique(w, return_inverse=True)
    return pack(steps(u[starts]), length.astype("<u4"), steps(listed), place.astype("<u4"), *numbers)


def steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of a sorted list, whose leading bytes are zero; ``np.cumsum`` undoes it."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


class Pairs:
    """What ``pack_pairs`` has packed."""

    def __init__(self, data: bytes):
        contexts, length, words, self.place, *self.numbers = unpack(data)
        self.contexts, self.words = np.cumsum(contexts), np.cumsum(words)
        self.context = np.repeat(np.arange(len(length), dtype="<u4"), length)


class Seating:
    """Tables of many dishes: ``tables`` of each, and the ``sizes`` of all tables, dish by dish."""

    def __init__(self, customers: np.ndarray, tables: np.ndarray, sizes: np.ndarray):
        self.customers, self.tables, self.sizes = customers, tables, sizes

    @classmethod
    def at_one_table(cls, customers: np.ndarray) -> "Seating":
        return cls(customers, np.ones(len(customers), np.int64), customers.copy())

    def firsts(self) -> np.ndarray:
        return np.cumsum(self.tables) - self.tables

    def grown(self, customers: np.ndarray) -> "Seating":
        """As a start for the next sweep: a dish's new customers sit at its first table, or all at
        one table where more customers have left than that table has."""
        first = self.firsts()
        sizes, tables = self.sizes.copy(), self.tables.copy()
        sizes[first] += customers - self.customers
        broken = sizes[first] < 1
        if broken.any():
            of = np.repeat(np.arange(len(tables)), tables)
            keep = ~broken[of]
            keep[first] = True
            sizes[first[broken]] = customers[broken]
            sizes, tables[broken] = sizes[keep], 1
        return Seating(customers, tables, sizes)

    def opened(self, strength: np.ndarray, discount: float, most: int = MOST) -> "Seating":
        """As a start, dishes with more customers than a sweep seats one by one get about the tables
        that they have on average: their seats are a Poisson number of tables, strength / discount *
        (1 - gap ** discount), and the gap is such that these have the dish's customers."""
        large = self.customers > most
        n, a = self.customers[large].astype(float), strength[large]
        low, high = np.full(len(n), -700.0), np.zeros(len(n))  # of the gap's logarithm
        for _ in range(50):
            log_gap = (low + high) / 2
            over = a * -np.expm1(log_gap) * np.exp((discount - 1) * log_gap) > n
            low, high = np.where(over, log_gap, low), np.where(over, high, log_gap)
        tables = 1 + a / discount * -np.expm1(discount * high)
        want = self.tables.copy()
        want[large] = np.clip(np.rint(tables), 1, n).astype(np.int64)
        sizes = np.ones(want.sum(), dtype=np.int64)
        sizes[np.cumsum(want) - want] = self.customers - want + 1
        if not large.all():  # the others keep the tables that they have
            sizes[np.repeat(~large, want)] = self.sizes[np.repeat(~large, self.tables)]
        return Seating(self.customers, want, sizes)

    def sweep(
        self, strength: np.ndarray, discount: float, rng: np.random.Generator, most: int = MOST, cells: int = CELLS
    ) -> "Seating":
        """Take customers from their tables and seat them anew. ``strength`` of a dish: the weight
        of a new table, (concentration + discount * tables of the restaurant) * parent's probability.
        No dish's seats change another's odds, so they are taken some at a time, about ``cells``
        tables together: of up to ``most`` customers one by one, of more all at once."""
        if not len(self.customers):
            return self
        order = np.argsort(-self.customers, kind="stable")
        large = self.customers[order] > most
        span = spans(self.customers[order], strength[order], discount, cells)
        free = strength[order] / discount * span
        # A deal has some more arrays of its tables.
        room = np.where(large, 4 * (self.tables[order] + free.astype(np.int64)), self.tables[order] + self.customers[order])
        part = (np.cumsum(room) - room) // cells * 2 + ~large
        tables, parts = np.empty(len(order), dtype=np.int64), []
        firsts = self.firsts()
        for _, s, e in ranges(part):
            own = order[s:e]
            if large[s]:
                tables[own], sizes = self.dealt(own, firsts[own], strength[own], discount, rng, span[s:e])
            else:
                tables[own], sizes = self.swept(own, firsts[own], strength[own], discount, rng)
            parts.append(sizes)
        sizes = np.concatenate(parts)
        stops = np.cumsum(tables[order])
        firsts[order] = stops - tables[order]
        return Seating(self.customers, tables, sizes[np.repeat(firsts, tables) + ragged(tables)])

    def swept(
        self, own: np.ndarray, old_firsts: np.ndarray, a: np.ndarray, discount: float, rng: np.random.Generator
    ) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of tables and the sizes of some dishes, by falling customers, after a sweep."""
        c, t = self.customers[own], self.tables[own]
        room = t + c
        first = np.cumsum(room) - room
        flat = np.zeros(room.sum(), dtype=np.int64)
        flat[np.repeat(first, t) + ragged(t)] = self.sizes[np.repeat(old_firsts, t) + ragged(t)]
        free = first + t
        for k in range(int(c[0])):
            n = int(np.searchsorted(-c, -k, side="left"))  # dishes with more than k customers
            stop = first[n - 1] + room[n - 1]
            part = flat[:stop]
            left = np.cumsum(part)
            before = np.concatenate(([0], left[first[1:n] - 1]))
            # Everyone is as likely to stand up.
            up = np.searchsorted(left, before + (rng.random(n) * c[:n]).astype(np.int64) + 1)
            part[up] -= 1
            t[:n] -= part[up] == 0
            old_weight = c[:n] - 1 - discount * t[:n]
            new = rng.random(n) * (old_weight + a[:n]) < a[:n]
            new |= t[:n] == 0
            # A table by its size less the discount: the table of a customer, taken with 1 - d / size.
            seek = np.flatnonzero(~new)
            left = np.cumsum(part)
            before = np.concatenate(([0], left[first[1:n] - 1]))
            while len(seek):
                at = np.searchsorted(left, before[seek] + (rng.random(len(seek)) * (c[seek] - 1)).astype(np.int64) + 1)
                # part grows as customers sit down; each dish has one at a time, so left stays right
                taken = rng.random(len(seek)) * part[at] >= discount
                part[at[taken]] += 1
                seek = seek[~taken]
            opened = np.flatnonzero(new)
            part[free[opened]] = 1
            free[opened] += 1
            t[opened] += 1
        return t, flat[flat > 0]

    def dealt(
        self, own: np.ndarray, old_firsts: np.ndarray, a: np.ndarray, discount: float, rng: np.random.Generator,
        span: np.ndarray,
    ) -> tuple[np.ndarray, np.ndarray]:
        """As ``swept`` and with the same odds, but all customers of a dish move together.

        The seats of a dish are those of customers who choose tables by weight, where weights are a
        Poisson process of density a / gamma(1 - d) * x ** (-1 - d) * exp(-x). Given its customers a
        taken table's weight is gamma(size - d). Tables get Poisson marks by their weights; those with
        a mark, taken and free ones, deal their customers among each other by weight alone. The
        customers of tables without one, mostly small ones, stay until the next time."""
        dishes, t = len(own), self.tables[own]
        sizes = self.sizes[np.repeat(old_firsts, t) + ragged(t)]
        dish = np.repeat(np.arange(dishes), t)
        marks = np.expm1(np.log1p(span) / discount)
        for _ in range(DEALS):
            weight = rng.standard_gamma(sizes - discount)
            marked = rng.random(len(sizes)) < -np.expm1(-marks[dish] * weight)
            free = rng.poisson(a / discount * span)
            # A free table's weight: gamma(1 - d) / v, with v ** d uniform from 1 to 1 + span.
            empty = rng.random(free.sum()) * np.repeat(span, free)
            empty = rng.standard_gamma(1 - discount, len(empty)) / np.exp(np.log1p(empty) / discount)
            stop = np.append(0.0, np.cumsum(empty))
            last = np.cumsum(free)
            low, high = stop[last - free], stop[last]
            del empty
            # The marked tables of a dish and, last, its free ones together.
            length = np.bincount(dish[marked], minlength=dishes) + 1
            end = np.cumsum(length) - 1
            table = np.ones(end[-1] + 1, dtype=bool)
            table[end] = False
            weights = np.empty(len(table))
            weights[table], weights[end] = weight[marked], high - low
            moving = np.bincount(dish[marked], weights=sizes[marked], minlength=dishes).astype(np.int64)
            got = divided(moving, weights, length, rng)
            new = np.repeat(np.arange(dishes), got[end])
            at = np.searchsorted(stop, low[new] + rng.random(len(new)) * (high - low)[new], side="right") - 1
            at, new_sizes = np.unique(np.clip(at, (last - free)[new], last[new] - 1), return_counts=True)
            sizes = np.concatenate((sizes[~marked], got[table], new_sizes))
            dish = np.concatenate((dish[~marked], dish[marked], np.searchsorted(last, at, side="right")))
            order = np.argsort(dish, kind="stable")
            order = order[sizes[order] > 0]
            sizes, dish = sizes[order], dish[order]
        return np.bincount(dish, minlength=dishes), sizes


def spans(customers: np.ndarray, a: np.ndarray, discount: float, cells: int) -> np.ndarray:
    """(1 + marks) ** discount - 1 of each dish, by which ``a`` / discount grows to the mean number of
    its free tables with a mark. Dishes with far fewer customers than these, or with more of them
    than are held at once, get fewer marks, which changes no odds."""
    most = np.minimum(8.0 * customers, cells)
    return np.minimum((1 + MARKS) ** discount - 1, most * discount / np.maximum(a, 1e-300))


def divided(n: np.ndarray, weights: np.ndarray, length: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """``n`` of each group dealt over its ``length`` places by weight: neighbours are taken together
    until one place is left for each group, and what that gets is split again and again."""
    if length.max() == 1:
        return n
    half = (length + 1) // 2
    left = np.repeat(np.cumsum(length) - length, half) + 2 * ragged(half)
    both = left + 1 < np.repeat(np.cumsum(length), half)
    right = left[both] + 1
    total = weights[left]
    total[both] += weights[right]
    upper = divided(n, total, half, rng)
    out = np.empty(len(weights), dtype=np.int64)
    out[left] = upper
    share = np.divide(weights[right], total[both], out=np.zeros(len(right)), where=total[both] > 0)
    out[right] = rng.binomial(upper[both], np.minimum(share, 1.0))
    out[left[both]] -= out[right]
    return out


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each length in turn."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def bins(values: np.ndarray) -> np.ndarray:
    """Small numbers each, larger ones by quarters of an octave: some hundred bins for any size."""
    large = np.log2(np.maximum(values, 8) / 8.0)
    return np.where(values < 8, values, 8 + (4 * large).astype(np.int64)).astype(np.int64)


def shape_letters(slot: int, customers: np.ndarray, tables: np.ndarray, sizes: np.ndarray) -> Iterator[tuple]:
    """Binned restaurants (number, sums of customers and of tables) and tables with several
    customers (number, sum of sizes): all that a level's parameters depend on."""
    for kind, key, *numbers in (
        ("shape", bins(customers) << 20 | bins(tables), customers, tables),
        ("size", bins(sizes[sizes > 1]), sizes[sizes > 1]),
    ):
        found, place, n = np.unique(key, return_inverse=True, return_counts=True)
        sums = [np.bincount(place, weights=x, minlength=len(found)) for x in numbers]
        for b, *x in zip(found.tolist(), n.tolist(), *(y.tolist() for y in sums)):
            yield b, kind, slot, b"", [float(v) for v in x]


def digamma(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for _ in range(6):
        out -= 1 / x
        x = x + 1
    return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def new_parameters(level: dict, shape: np.ndarray, sizes: np.ndarray, rng, turns: int = 40) -> dict[str, float]:
    """Discount and concentration of a level, with priors Beta(1, 1) and Gamma(1, 1), given its
    seats: ``shape`` has rows (number, customers, tables) of like restaurants, ``sizes`` rows
    (number, size) of like tables. Each turn draws both from their conditionals given the expected
    auxiliary variables: y and log x of restaurants, z of tables."""
    d, strength = level["discount"], level["strength"]
    n, customers, tables = shape[shape[:, 1] > 1].T
    many, size = sizes.T
    for _ in range(turns):
        ratio = strength / d
        y1 = (n * ratio * (digamma(ratio + np.maximum(tables, 1)) - digamma(np.full(len(n), ratio + 1)))).sum()
        y0 = max(0.0, (n * np.maximum(tables - 1, 0)).sum() - y1)
        log_x = (n * (digamma(np.full(len(n), strength + 1)) - digamma(strength + customers))).sum()
        z0 = (many * (1 - d) * (digamma(size - d) - digamma(np.full(len(size), 1 - d)))).sum()
        d = float(np.clip(rng.beta(1 + y0, 1 + z0), 0.01, 0.99))
        strength = float(np.clip(rng.gamma(1 + y1) / (1 - log_x), 1e-3, 1e9))
    return {"discount": d, "strength": strength}


# Blocks of texts


def tokenised(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[tuple]:
    """MAIL rows of kind 'block': hashes of the block's words in order with their counts in learned
    texts, each token's place among them, and doc_id, learned and number of tokens of each text."""
    task, n = TaskContext.get().partitionId() << 32, 0
    ids: dict[bytes, int] = {}

    class Ids(dict):
        def __missing__(self, word: bytes) -> int:
            self[word] = number = len(self)
            return number

    def block(number: int) -> tuple:
        hashes = np.array([END, *(xxhash.xxh64_intdigest(w) for w in list(ids)[1:])], dtype="<u8")
        words, place = np.unique(hashes, return_inverse=True)
        place = place.astype("<u4")
        # Frequent words come early, so numbers in order of appearance are small ones.
        seen = np.concatenate(parts)
        sizes = np.array(lengths, dtype="<i8")
        learned = np.array(learns, dtype="<u1")
        known = np.bincount(place[seen[np.repeat(learned, sizes) > 0]], minlength=len(words))
        names = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
        no_name = np.array([d is None for d in doc_ids], dtype="<u1")
        data = pack(
            steps(words), known.astype("<u8"), place, seen, sizes, learned, names, no_name
        )
        return number, "block", number, data, [float(len(seen)), float(known.sum()), float(learned.sum())]

    parts, lengths, learns, doc_ids, held = [], [], [], [], 0
    ids = Ids({b"": 0})
    for doc_id, text, learn in rows(batches, "doc_id", "text", "learn"):
        # bytes.split() takes 0x1C to 0x1F for no white space, and 0x0B and 0x0C for some.
        words = text.lower().split()
        own = np.zeros(len(words) + 1, dtype="<u4")
        own[:-1] = np.fromiter(map(ids.__getitem__, words), "<u4", len(words))
        parts.append(own)
        lengths.append(len(own))
        learns.append(bool(learn))
        doc_ids.append(doc_id)
        held += len(own)
        if held >= block_tokens:
            yield block(task + n)
            parts, lengths, learns, doc_ids, held, n = [], [], [], [], 0, n + 1
            ids = Ids({b"": 0})
    if lengths:
        yield block(task + n)


class Block:
    """A block's tokens and its different pairs, in the order in which they are asked for."""

    def __init__(self, data: bytes, heavy: np.ndarray, slots: int):
        words, self.known, place, seen, self.sizes, self.learned, self.names, self.no_name = unpack(data)
        self.words, self.tokens = np.cumsum(words), place[seen]
        first = np.cumsum(self.sizes) - self.sizes
        del seen, place
        key = np.empty(len(self.tokens), dtype=np.int64)
        key[1:] = self.tokens[:-1]
        key[first] = len(self.words)  # the start of a text
        key <<= 32
        key |= self.tokens
        key, pair = np.unique(key, return_inverse=True)
        self.pair = pair.astype("<u4")
        del pair
        u, w = np.append(self.words, np.uint64(START))[key >> 32], self.words[key & 0xFFFFFFFF]
        counts = np.bincount(self.pair[np.repeat(self.learned, self.sizes) > 0], minlength=len(key))
        slot = pair_slots(u, w, heavy, slots)
        del key
        # Keys are in the order of (u, w) already, so slots are brought together, and stay sorted.
        order = np.argsort(slot.astype(np.uint16) if slots < 1 << 16 else slot, kind="stable")
        self.place = np.empty(len(order), dtype="<u4")
        self.place[order] = np.arange(len(order))
        self.u, self.w, self.counts, self.slot = u[order], w[order], counts[order], slot[order]

    def cuts(self) -> list[tuple[int, int, int]]:
        return ranges(self.slot)


def ranges(slot: np.ndarray) -> list[tuple[int, int, int]]:
    """(slot, start, stop) of equal runs."""
    if not len(slot):
        return []
    at = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
    return list(zip(slot[at].tolist(), at.tolist(), [*at[1:].tolist(), len(slot)]))


def each_block(make: Callable[[int, bytes], Iterator[tuple]]):
    """A function of mail for ``mapInArrow``."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (r for number, data in rows(batches, "slot", "data") for r in make(number, data))
        yield from batched(found, MAIL, 64)

    return take


def each_slot(make: Callable[[int, dict], Iterator[tuple]], schema: pa.Schema = MAIL):
    """A function of a slot's mail for ``applyInArrow``; ``make`` gets the rows by kind, by sender."""

    def take(table: pa.Table) -> pa.Table:
        mail: dict[str, list[tuple[int, memoryview]]] = {}
        # Letters are read where Arrow holds them, not copied.
        letters = (memoryview(d.as_buffer()) for d in table["data"])
        for kind, sender, data in zip(*(table[c].to_pylist() for c in ("kind", "sender")), letters):
            mail.setdefault(kind, []).append((sender, data))
        for letters in mail.values():
            letters.sort(key=lambda x: x[0])
        found = list(make(table["slot"][0].as_py(), mail))
        columns = zip(*found) if found else [[] for _ in schema]
        return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    return take


def word_letters(number: int, data: bytes, slots: int, kind: str) -> Iterator[tuple]:
    """A block's words and their counts, for each slot of words."""
    words, known, *_ = unpack(data)
    words = np.cumsum(words)
    for q, s, e in ranges(slot_of(words, slots)):
        yield q, kind, number, pack(steps(words[s:e]), known[s:e]), None


def pair_letters(number: int, data: bytes, heavy: np.ndarray, slots: int) -> Iterator[tuple]:
    """A block's pairs and their counts in learned texts, for each slot of restaurants."""
    block = Block(data, heavy, slots)
    for q, s, e in block.cuts():
        yield q, "ask", number, pack_pairs(block.u[s:e], block.w[s:e], block.counts[s:e].astype("<u4")), None


# Slots


def summed(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and their sums."""
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, weights=numbers, minlength=len(found)).astype(np.int64)


def merge_words(slot: int, mail: dict) -> Iterator[tuple]:
    """The known words of a slot and their counts."""
    parts = [unpack(d) for _, d in mail["words"]]
    words, counts = summed(np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts]))
    words, counts = words[counts > 0], counts[counts > 0]
    yield slot, "words", slot, pack(words, counts.astype("<u8")), [float(len(words)), float(counts.sum())]


def merge_pairs(slot: int, mail: dict, slots: int, heavy: np.ndarray) -> Iterator[tuple]:
    """The pairs of a slot, the seats of those that occur several times, all at one table, and for
    the parent the tables of each word: of pairs that occur once, which never change, and of others."""
    parts = [(number, Pairs(d)) for number, d in mail["ask"]]
    contexts, words = (np.unique(np.concatenate(x)) for x in zip(*((p.contexts, p.words) for _, p in parts)))
    key, stop = np.empty(sum(len(p.place) for _, p in parts), dtype=np.int64), 0
    for _, p in parts:
        own = key[stop : stop + len(p.place)]
        own[:] = np.searchsorted(contexts, p.contexts)[p.context]
        own <<= 32
        own |= np.searchsorted(words, p.words)[p.place]
        stop += len(own)
        p.words = p.place = None
    n = np.concatenate([p.numbers.pop(0) for _, p in parts])
    order = np.argsort(key, kind="stable")  # a merge: each block's pairs are sorted
    key = key[order]
    first = np.diff(key, prepend=-1) != 0
    new = np.flatnonzero(first)
    n = np.add.reduceat(n[order], new, dtype=np.int64) if len(new) else n.astype(np.int64)
    key = key[new]
    # Where each asked pair is among those that were learned, past their end if it was not.
    kept = n > 0
    place_of = np.where(kept, np.cumsum(kept) - 1, kept.sum()).astype("<u4")
    where = np.empty(len(order), dtype="<u4")
    where[order] = np.repeat(place_of, np.diff(np.append(new, len(order))))
    del order, first, new, place_of
    key, n = key[kept], n[kept]
    u, w = contexts[key >> 32], words[key & 0xFFFFFFFF]
    listed = np.unique(u)
    stop = 0
    for number, p in parts:
        start, stop = stop, stop + len(p.context)
        # Places ascend but for the unknown ones, which are listed on their own.
        own = where[start:stop]
        unknown = np.flatnonzero(own == kept.sum())
        own[unknown] = 0
        places = pack(
            steps(np.maximum.accumulate(own)).astype("<u4"), unknown.astype("<u4"),
            np.bincount(p.context).astype("<u4"), find(listed, p.contexts).astype("<u4"),
            find(heavy, p.contexts).astype("<u4"),
        )
        yield slot, "places", number, places, None
    names, context = np.unique(key >> 32, return_inverse=True)
    # Answers go by places, so they need the numbers of the pairs, not their names.
    yield slot, "pairs", slot, pack(np.bincount(context, minlength=len(names)).astype("<u4"), n.astype("<u8")), None
    # The rounds need the pairs that occur several times, and of the others how many there are.
    often = n > 1
    asked, place = np.unique(w[often], return_inverse=True)
    once = np.bincount(context[~often], minlength=len(names))
    customers = np.bincount(context, weights=n, minlength=len(names))
    heavy_at = np.flatnonzero(np.isin(contexts[names], heavy))
    heavy_name = np.searchsorted(heavy, contexts[names[heavy_at]])
    many = pack(
        customers.astype("<u8"), once.astype("<u8"), heavy_at.astype("<u4"), heavy_name.astype("<u4"), asked,
        place.astype("<u4"), context[often].astype("<u4"), n[often].astype("<u8"),
    )
    yield slot, "many", slot, many, None
    seats = Seating.at_one_table(n[n > 1].astype(np.int64))
    yield slot, "seats", slot, pack(seats.tables.astype("<u4"), seats.sizes.astype("<u8")), None
    is_heavy = np.isin(u, heavy)
    light = ~is_heavy
    _, place, tables = np.unique(key[light] >> 32, return_inverse=True, return_counts=True)
    customers = np.bincount(place, weights=n[light], minlength=len(tables)).astype(np.int64)
    yield from shape_letters(slot, customers, tables, n[light])
    at = np.searchsorted(heavy, u[is_heavy])
    if len(at):
        yield slot, "heavy", slot, b"", np.bincount(at, minlength=len(heavy)).astype(float).tolist()
    words, ones = summed(w[n == 1], np.ones((n == 1).sum()))
    yield from to_words("ones", slot, words, ones, slots)
    words, tables = summed(w[n > 1], np.ones((n > 1).sum()))
    yield from to_words("tables", slot, words, tables, slots)


def to_words(kind: str, slot: int, words: np.ndarray, numbers: np.ndarray, slots: int) -> Iterator[tuple]:
    for q, s, e in ranges(slot_of(words, slots)):
        yield q, kind, slot, pack(words[s:e], numbers[s:e].astype("<u8")), [float(numbers[s:e].sum())]


def fresh(level: dict) -> float:
    """The weight of a new table of the parent."""
    return level["strength"] + level["discount"] * level["tables"]


def chance(weight: np.ndarray, level: dict) -> np.ndarray:
    """The parent's probabilities of words from their weights; of the unknown word for weight 0."""
    everyone = level["strength"] + level["customers"]
    return (weight.astype(float) + fresh(level) / level["kinds"]) / everyone


def seat_words(slot: int, mail: dict, round_: int, level: dict) -> Iterator[tuple]:
    """One round of the parent in a slot of words: new seats, and for the slots of restaurants what
    the words that they have tables of weigh, customers less discounts."""
    (_, data), = mail["words"]
    words, counts = unpack(data)
    ones = unpack(mail["once"][0][1])[0] if "once" in mail else np.zeros(len(words), "<u8")
    for _, data in mail.get("ones", []):
        own, n = unpack(data)
        ones[np.searchsorted(words, own)] += n
    customers = ones.astype(np.int64)
    asked = [(sender, *unpack(d)) for sender, d in mail.get("tables", [])]
    for _, own, n in asked:
        customers[np.searchsorted(words, own)] += n.astype(np.int64)
    rng = np.random.default_rng((round_, slot, 1))
    if "parent" in mail:
        tables, sizes, old = (x.astype(np.int64) for x in unpack(mail["parent"][0][1]))
        seats = Seating(old, tables, sizes).grown(customers)
    else:
        seats = Seating.at_one_table(customers)
    seats = seats.sweep(np.full(len(words), fresh(level) / level["kinds"]), level["discount"], rng)
    shown = customers - level["discount"] * seats.tables
    # The parent is one restaurant, whose totals the driver sums; its tables are binned here.
    none = np.empty(0, dtype=np.int64)
    yield from shape_letters(slot, none, none, seats.sizes)
    totals = [float(seats.tables.sum())]
    data = pack(seats.tables.astype("<u4"), seats.sizes.astype("<u8"), customers.astype("<u8"))
    yield slot, "parent", slot, data, totals
    if "ones" in mail:
        yield slot, "once", slot, pack(ones), None
    yield slot, "shown", round_, pack(shown.astype("<f4")), None
    for sender, own, _ in asked:
        yield sender, "chances", slot, pack(shown[np.searchsorted(words, own)].astype("<f4")), None


def seat_pairs(
    slot: int, mail: dict, round_: int, slots: int, heavy: np.ndarray, heavy_tables: np.ndarray,
    level: dict, top: dict,
) -> Iterator[tuple]:
    """One round of the restaurants of a slot: new seats, tables for the parent, binned restaurants
    for the level's parameters, and partial tables of heavy restaurants."""
    customers, once, heavy_at, heavy_name, words, place, context, count = unpack(mail["many"][0][1])
    customers, once, count = (x.astype(np.int64) for x in (customers, once, count))
    tables, sizes = (x.astype(np.int64) for x in unpack(mail["seats"][0][1]))
    seats = Seating(count, tables, sizes)
    rng = np.random.default_rng((round_, slot, 0))
    weights = np.concatenate([unpack(d)[0] for _, d in mail.get("chances", [])] or [np.empty(0)])
    chances = chance(weights, top)[place]

    def own_tables() -> np.ndarray:
        more = np.bincount(context, weights=seats.tables, minlength=len(once))
        return once + more.astype(np.int64)

    for turn in range(SWEEPS):
        tables = own_tables()
        tables[heavy_at] = heavy_tables[heavy_name]
        weight = (level["strength"] + level["discount"] * tables[context]) * chances
        if round_ == 1 and turn == 0:
            seats = seats.opened(weight, level["discount"])
        seats = seats.sweep(weight, level["discount"], rng)
    tables = own_tables()
    light = np.ones(len(once), dtype=bool)
    light[heavy_at] = False
    yield from shape_letters(slot, customers[light], tables[light], seats.sizes)
    data = pack(seats.tables.astype("<u4"), seats.sizes.astype("<u8"))
    yield slot, "seats", slot, data, None
    yield slot, "sample", round_, pack(seats.tables.astype("<u4")), None
    if len(heavy_at):
        found = np.zeros(len(heavy))
        found[heavy_name] = tables[heavy_at]
        yield slot, "heavy", slot, b"", found.tolist()
    total = np.bincount(place, weights=seats.tables, minlength=len(words))
    yield from to_words("tables", slot, words, total, slots)


def answer_pairs(slot: int, mail: dict, heavy: np.ndarray, heavy_state: np.ndarray) -> Iterator[tuple]:
    """For each block its pairs' counts and tables, and its preceding words' totals, per sample.
    ``heavy_state``: customers of the heavy restaurants, and below their tables per sample."""
    length, count = unpack(mail["pairs"][0][1])
    count, kinds = count.astype(np.int64), len(length)
    context = np.repeat(np.arange(kinds, dtype="<u4"), length)
    per_context = [np.bincount(context, weights=count, minlength=kinds).astype(np.int64)]
    per_pair = [count]
    for _, data in mail["sample"]:
        tables = np.ones(len(count), dtype=np.int64)
        tables[count > 1] = unpack(data)[0]
        per_pair.append(tables)
        per_context.append(np.bincount(context, weights=tables, minlength=kinds).astype(np.int64))
    # Past the end: a pair or a preceding word that isn't known.
    per_pair = [np.append(x, 0) for x in per_pair]
    per_context = [np.append(x, 0) for x in per_context]
    for number, data in mail["places"]:
        pair, unknown, length, at, name = unpack(data)
        pair = np.cumsum(pair, dtype=np.int64)
        pair[unknown] = len(count)
        # Heavy words have the totals of all slots even where this one has none of their pairs.
        totals = [np.where(name < len(heavy), np.append(h, 0)[name], x[at]) for h, x in zip(heavy_state, per_context)]
        out = [x[pair].astype("<u4") for x in per_pair] + [length]
        yield number, "pair", slot, pack(*out, *(x.astype("<u8") for x in totals)), None


def answer_words(slot: int, mail: dict, tops: list[dict]) -> Iterator[tuple]:
    """For each block its words' counts, and their probabilities per sample."""
    (_, data), = mail["words"]
    words, counts = unpack(data)
    shown = [unpack(d)[0] for _, d in mail["shown"]]
    # Past the end: a word that isn't known.
    counts = np.append(counts, np.uint64(0))
    shown = [chance(np.append(x, np.float32(0)), top) for x, top in zip(shown, tops)]
    for number, data in mail.get("need", []):
        at = find(words, np.cumsum(unpack(data)[0]))
        yield number, "word", slot, pack(counts[at], *(x[at].astype("<f4") for x in shown)), None


def find(listed: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in a sorted list, its length for what isn't there."""
    at = np.searchsorted(listed, wanted)
    if len(listed):
        at[listed[np.minimum(at, len(listed) - 1)] != wanted] = len(listed)
    return at


def score_block(
    number: int, mail: dict, heavy: np.ndarray, slots: int, levels: list[tuple[float, float]], totals: tuple
) -> Iterator[tuple]:
    """SCORES rows of a block. ``levels``: discount and concentration of the restaurants per
    sample; ``totals``: tokens and words that were learned."""
    block = Block(mail["block"][0][1], heavy, slots)
    replies = [unpack(d) for _, d in mail["word"]]
    count, *shown = (np.concatenate(x) for x in zip(*replies))
    n = len(levels)
    letters = [unpack(d) for _, d in mail["pair"]]
    pair_count, *rest = (np.concatenate(x) for x in zip(*letters))
    tables, length, customers, own = rest[:n], rest[n], rest[n + 1], rest[n + 2 :]
    context = np.repeat(np.arange(len(length), dtype="<u4"), length)
    word = np.searchsorted(block.words, block.w)
    chance = np.zeros(len(context))
    for k, (discount, strength) in enumerate(levels):
        there = customers[context] + strength
        fresh = strength + discount * own[k][context]
        chance += (pair_count - discount * tables[k] + fresh * shown[k][word].astype(float)) / there
    logs = np.log10(chance / n)[block.place[block.pair]]
    learned, kinds = totals
    base = np.log10((count.astype(float) + 1) / (learned + kinds + 1))[block.tokens]
    first = np.cumsum(block.sizes) - block.sizes
    known = np.add.reduceat((count > 0)[block.tokens], first, dtype=np.int64)
    names = [None if no else d for d, no in zip(block.names.tolist(), block.no_name.tolist())]
    yield from zip(
        names, (block.learned > 0).tolist(), block.sizes.tolist(), known.tolist(),
        np.add.reduceat(base, first).tolist(), np.add.reduceat(logs, first).tolist(),
    )


def scores(
    docs: DataFrame, learn: Column, rounds: int = ROUNDS, burn_in: int = BURN_IN,
    block_tokens: int = BLOCK_TOKENS, slot_tokens: int = SLOT_TOKENS, seed: int = 1,
) -> DataFrame:
    """``doc_id``, ``learned``, ``n_tokens``, ``n_known``, ``base_score``, ``score``, ``train_tokens``.

    The model learns from the rows for which ``learn`` holds (null: not) and scores every row: the
    sum of log10 probabilities of its words and its end. One row for each row of ``docs``, also of
    rows that are alike or have no id; null texts are empty. With nothing to learn from, every word
    is the unknown one, with probability 1. Words are told apart by 64-bit hashes. ``doc_id``,
    ``text`` and what ``learn`` names are the only columns read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    texts = docs.select("doc_id", text.alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(tokenised(batches, block_tokens), MAIL, 1)

    blocks = scratch.write(texts.mapInArrow(take, MAIL_DDL), "blocks")
    tokens, learned, learned_docs = (int(x or 0) for x in sums_of(blocks, 3))
    slots = 1 + tokens // slot_tokens
    letters = blocks.mapInArrow(each_block(lambda b, d: word_letters(b, d, slots, "words")), MAIL_DDL)
    words = scratch.write(by_slot(letters, merge_words), "words")
    kinds = int(sums_of(words, 1)[0] or 0)
    heavy, heavy_customers = heavy_words(words, learned_docs, max(1, learned // slots))
    asks = blocks.mapInArrow(each_block(lambda b, d: pair_letters(b, d, heavy, slots)), MAIL_DDL)
    state = kept(scratch, by_slot(asks, lambda s, m: merge_pairs(s, m, slots, heavy)), "state-0")
    state_0, many = state, state.where("kind = 'many'")
    ones = sums_of(state.where("kind = 'ones'"), 1)[0] or 0.0
    heavy_tables = heavy_sums(state, len(heavy))
    rng = np.random.default_rng(seed)
    low = {"discount": 0.8, "strength": 1.0}
    top = {"discount": 0.8, "strength": 1.0, "kinds": kinds + 1, "tables": kinds}
    samples, mail = [], words.union(state.where("kind in ('ones', 'tables')"))
    for r in range(rounds + 1):
        if r:
            mail = many.union(state.where("kind = 'seats'")).union(parent.where("kind = 'chances'"))
            step = partial(seat_pairs, round_=r, slots=slots, heavy=heavy, heavy_tables=heavy_tables, level=low, top=top)
            state = kept(scratch, by_slot(mail, step), f"state-{r}")
            heavy_tables = heavy_sums(state, len(heavy))
            mail = words.union(state.where("kind = 'tables'")).union(parent.where("kind = 'parent'")).union(once)
        top = top | {"customers": ones + (sums_of(state.where("kind = 'tables'"), 1)[0] or 0.0)}
        parent = kept(scratch, by_slot(mail, partial(seat_words, round_=r, level=top)), f"parent-{r}")
        if r == 0:
            once = parent.where("kind = 'once'")
        top = top | {"tables": sums_of(parent.where("kind = 'parent'"), 1)[0] or 0.0}
        if r > burn_in:
            shown, seated = parent.where("kind = 'shown'"), state.where("kind = 'sample'")
            samples.append((low, top, heavy_tables, shown, seated))
        if r < rounds:
            low = new_parameters(low, *level_shape(state), rng)
            whole = np.array([[1.0, top["customers"], top["tables"]]])
            top = top | new_parameters(top, whole, level_shape(parent)[1], rng)
    lows, tops, heavies, shown, seated = zip(*samples)
    need = blocks.mapInArrow(each_block(lambda b, d: word_letters(b, d, slots, "need")), MAIL_DDL)
    word_mail = reduce(DataFrame.union, [words, need, *shown])
    pair_mail = reduce(DataFrame.union, [state_0.where("kind in ('pairs', 'places')"), *seated])
    heavy_state = np.array([heavy_customers, *heavies])
    answers = by_slot(word_mail, partial(answer_words, tops=tops))
    answers = answers.union(by_slot(pair_mail, partial(answer_pairs, heavy=heavy, heavy_state=heavy_state)))
    answers = scratch.write(answers, "answers")
    scratch.drop("words", *(f"{name}-{r}" for name in ("state", "parent") for r in range(rounds + 1)))
    levels = [(x["discount"], x["strength"]) for x in lows]
    last = partial(score_block, heavy=heavy, slots=slots, levels=levels, totals=(learned, kinds))
    scored = blocks.union(answers).groupBy("slot").applyInArrow(each_slot(last, SCORES), SCORES_DDL)
    return scored.withColumn("train_tokens", F.lit(learned).cast("long"))


def kept(scratch: Scratch, mail: DataFrame, name: str) -> DataFrame:
    """The mail, stored in a folder for each kind, so that reading one kind reads no other."""
    path = scratch.path(name)
    mail.write.partitionBy("kind").parquet(path)
    return scratch.spark.read.schema(MAIL_DDL).parquet(path).select(*MAIL.names)


def by_slot(mail: DataFrame, make: Callable[[int, dict], Iterator[tuple]]) -> DataFrame:
    return mail.groupBy("slot").applyInArrow(each_slot(make), MAIL_DDL)


def sums_of(mail: DataFrame, n: int) -> tuple:
    return tuple(mail.select(*[F.sum(F.col("x")[k]) for k in range(n)]).first())


def heavy_words(words: DataFrame, texts: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Preceding words with more than ``limit`` followers, a slot's share, and how many each has:
    at most one for each slot."""

    def heavy(number: int, data: bytes) -> Iterator[tuple]:
        own, counts = unpack(data)
        large = (counts > limit) & (own != END)
        yield number, "heavy", number, pack(own[large], counts[large]), None

    found = words.mapInArrow(each_block(heavy), MAIL_DDL).select("data").collect()
    parts = [unpack(bytes(r["data"])) for r in found]
    if texts > limit:
        parts.append([np.array([START], "<u8"), np.array([texts], "<u8")])
    names = np.concatenate([p[0] for p in parts] or [np.empty(0, "<u8")])
    counts = np.concatenate([p[1] for p in parts] or [np.empty(0, "<u8")]).astype(np.int64)
    order = np.argsort(names)
    return names[order], counts[order]


def heavy_sums(state: DataFrame, n: int) -> np.ndarray:
    """Tables of each heavy restaurant, over all slots."""
    part = state.where("kind = 'heavy'").select(F.posexplode("x").alias("at", "tables"))
    out = np.zeros(n, dtype=np.int64)
    for at, tables in part.groupBy("at").agg(F.sum("tables")).collect() if n else []:
        out[at] = int(tables)
    return out


def level_shape(mail: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Like restaurants (number, mean customers, mean tables) and like tables (number, mean size)
    of all slots, one row for each bin."""
    sums = [F.sum(F.get("x", F.lit(k))).alias(f"x{k}") for k in range(3)]
    binned = mail.where("kind in ('shape', 'size')").groupBy("kind", "slot").agg(*sums).collect()
    shape = [(r["x0"], r["x1"] / r["x0"], r["x2"] / r["x0"]) for r in binned if r["kind"] == "shape"]
    sizes = [(r["x0"], r["x1"] / r["x0"]) for r in binned if r["kind"] == "size"]
    return np.array(sorted(shape)).reshape(-1, 3), np.array(sorted(sizes)).reshape(-1, 2)


def perplexity(scored: DataFrame) -> DataFrame:
    """``learned``, ``n_tokens``, ``perplexity``, ``base_perplexity`` of learned and other texts."""
    tokens = F.sum("n_tokens")
    return scored.groupBy("learned").agg(
        tokens.alias("n_tokens"),
        F.pow(10.0, -F.sum("score") / tokens).alias("perplexity"),
        F.pow(10.0, -F.sum("base_score") / tokens).alias("base_perplexity"),
    )


def op13_pitman_yor_scores(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored = scores(docs, ~F.coalesce(held_out, F.lit(False)))
    return scored.select(
        "doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
