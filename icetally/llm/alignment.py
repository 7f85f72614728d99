"""Align the tokens of two vocabularies by merging their byte ends along merge paths.

Texts are encoded in blocks. A block's ends of A tokens and of B tokens are two sorted lists; binary
searches on evenly spaced diagonals cut their merge into pieces of equal work, whatever the two
lists look like. Each piece finds its common ends alone, and where a diagonal falls between an A end
and the equal B end, stitching the two neighbours joins them. Common ends close the groups. How
often two ids are linked is counted per block, summed in Spark, and looked up again by the block's
different pairs, so no occurrence is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icetally.llm.shared import Scratch, batched, rows, text_bytes
from icetally.llm.tokens import byte_letters, vocabulary

BLOCK_BYTES = 4 << 20
"""Text that a worker aligns at once, and at least one document."""

WORK = 1 << 16
"""Ends that one piece of a merge path holds."""

BLOCKS = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())),
     ("n_b", pa.list_(pa.int64())), ("n_groups", pa.list_(pa.int64())), ("groups", pa.list_(pa.string())),
     ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
)
BLOCKS_DDL = (
    "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>,"
    " groups array<string>, links binary, pairs array<long>, times array<long>"
)
OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
     ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups", pa.string())]
)
OUT_DDL = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long,"
    " groups string"
)


def diagonal_cuts(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two sorted arrays (A first among equals) is cut every ``work`` elements:
    how many elements of each lie before each cut, from (0, 0) to both lengths."""
    total = len(a) + len(b)
    at = np.append(np.arange(0, total, work, dtype=np.int64), total)
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (open_ := low < high).any():
        mid = (low[open_] + high[open_]) // 2
        first = a[mid] <= b[at[open_] - 1 - mid]
        low[open_] = np.where(first, mid + 1, low[open_])
        high[open_] = np.where(first, high[open_], mid)
    return low, at - low


def common_in_piece(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the equal elements of two sorted pieces without repeats."""
    place = np.searchsorted(a, b)
    j = np.flatnonzero(place < len(a))
    j = j[a[place[j]] == b[j]]
    return place[j], j


def common_ends(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), in order, at which ``a[i] == b[j]``; both ascend without repeats."""
    i_cut, j_cut = diagonal_cuts(a, b, work)
    found_a, found_b = [], []
    for i0, i1, j0, j1 in zip(i_cut, i_cut[1:], j_cut, j_cut[1:]):
        i, j = common_in_piece(a[i0:i1], b[j0:j1])
        found_a.append(i + i0)
        found_b.append(j + j0)
        # The A end closes this piece and the equal B end opens the next one.
        if 0 < i1 and j1 < len(b) and a[i1 - 1] == b[j1]:
            found_a.append(np.array([i1 - 1]))
            found_b.append(np.array([j1]))
    none = [np.empty(0, np.int64)]
    return np.concatenate(found_a or none), np.concatenate(found_b or none)


class Vocabulary:
    """One tokenizer of a worker process: ids of a text, and the bytes and lengths of its tokens."""

    _open: dict[str, "Vocabulary"] = {}

    def __init__(self, name: str):
        self.sentence_pieces = name.endswith(".model")
        if self.sentence_pieces:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            self.bytes = [
                bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in enumerate(pieces)
            ]
            self.encode = lambda text: model.encode(text, num_threads=1)
        else:
            self.bytes, self.encode = byte_level(name)
        self.lengths = np.array([len(x) for x in self.bytes], dtype=np.int64)
        # Each id in decimal, as a token inside its side of a group and as its last one.
        self.inner = np.array([b"%d," % i for i in range(len(self.bytes))], dtype=object)
        self.last = np.array(
            [b"%d%s" % (i, b";" if self.sentence_pieces else b"|") for i in range(len(self.bytes))],
            dtype=object,
        )

    @classmethod
    def of(cls, name: str) -> "Vocabulary":
        if name not in cls._open:
            cls._open[name] = cls(name)
        return cls._open[name]


def byte_level(name: str):
    """Token bytes and encoder of a byte-level vocabulary. Where its ranks are installed too, they
    encode the same ids several times faster."""
    import json

    with open(vocabulary(name)) as file:
        ids = json.load(file)["model"]["vocab"]
    letters = {chr(b): b for b in range(256)} | {c: b for b, c in byte_letters().items()}
    token = [b""] * (max(ids.values()) + 1)
    for text, i in ids.items():
        token[i] = bytes(letters.get(c, 0) for c in text)
    try:
        import public_tokenizers
        import tiktoken

        with open(vocabulary(name.replace(".json", ".tiktoken")), "rb") as file:
            ranks = {base64.b64decode(x): int(n) for x, n in map(bytes.split, file)}
        if all(token[i] == x for x, i in ranks.items()):
            own = tiktoken.Encoding(
                name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )
            return token, own.encode_ordinary
    except FileNotFoundError:
        pass
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary(name))
    tokenizer.encode_special_tokens = True
    return token, lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def token_ids(text: bytes, a: Vocabulary, b: Vocabulary) -> tuple[list[int], list[int]]:
    """Ids of a text by both, or none if it is empty or their bytes aren't a space and the text."""
    if text:
        shown = text.decode("utf-8", "replace")
        own_a, own_b = a.encode(" " + shown), b.encode(shown)
        whole = b" " + text
        if b"".join(map(a.bytes.__getitem__, own_a)) == whole == b"".join(map(b.bytes.__getitem__, own_b)):
            return own_a, own_b
    return [], []


def aligned_block(block: int, docs: list[tuple], a: Vocabulary, b: Vocabulary, digest: bool, work: int) -> tuple:
    """A row of BLOCKS from (doc_id, A ids, B ids)."""
    n_a, n_b = (np.array([len(d[k]) for d in docs], dtype=np.int64) for k in (1, 2))
    ids_a = np.fromiter((x for d in docs for x in d[1]), np.int64, n_a.sum())
    ids_b = np.fromiter((x for d in docs for x in d[2]), np.int64, n_b.sum())
    # Texts follow each other, so ends ascend through the whole block and each text's end is common.
    i, j = common_ends(np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b]), work)
    stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
    before = np.searchsorted(i, stop_a - 1, side="right")
    before[stop_a == 0] = 0
    n_groups = np.diff(before, prepend=0)
    pairs, links, times = np.unique(ids_a[i] << 32 | ids_b[j], return_inverse=True, return_counts=True)
    # Every token goes to its place among the groups: a group's A tokens, then its B tokens.
    is_last_a, is_last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    is_last_a[i], is_last_b[j] = True, True
    group_a, group_b = np.cumsum(is_last_a) - is_last_a, np.cumsum(is_last_b) - is_last_b
    text = np.empty(len(ids_a) + len(ids_b), dtype=object)
    for ids, own, last, place in (
        (ids_a, a, is_last_a, np.arange(len(ids_a)) + np.append(0, j + 1)[group_a]),
        (ids_b, b, is_last_b, np.arange(len(ids_b)) + np.append(i + 1, 0)[group_b]),
    ):
        text[place] = own.inner[ids]
        text[place[last]] = own.last[ids[last]]
    stops = (stop_a + stop_b).tolist()
    groups = [b"".join(text[s:e].tolist())[:-1] for s, e in zip([0, *stops], stops)]
    shown = [(hashlib.sha256(g).hexdigest() if digest and g else g.decode()) for g in groups]
    packed = zstandard.ZstdCompressor(3).compress(planes(links.astype("<u4")))
    return (
        block, [d[0] for d in docs], n_a.tolist(), n_b.tolist(), n_groups.tolist(), shown, packed,
        pairs.tolist(), times.tolist(),
    )


def planes(values: np.ndarray) -> bytes:
    """The bytes of all values, first bytes first: high bytes are mostly zero and go together."""
    return values.view("u1").reshape(-1, values.itemsize).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, "u1").reshape(size, -1).T.copy().view(kind).ravel()


def align(
    docs: DataFrame,
    a: str = "byte_bpe_50k.json",
    b: str = "piece_bpe_32k.model",
    digest: bool = False,
    block_bytes: int = BLOCK_BYTES,
    work: int = WORK,
) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups``.

    ``groups`` holds the ids as ``a1,a2|b1;a3|b2,b3``, or with ``digest`` the SHA-256 of that text.
    One row for each row of ``docs``, also of rows that are alike or have no id. Texts that are
    null, empty, or that a vocabulary doesn't give back byte by byte, have no tokens: zeros and ''.
    Tokens have at least one byte, so a common end is one link. Only ``doc_id`` and ``text`` are
    read, so other columns may have any names. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_a, own_b = Vocabulary.of(a), Vocabulary.of(b)
        task = TaskContext.get().partitionId() << 32

        def records() -> Iterator[tuple]:
            held, size, n = [], 0, 0
            for doc_id, text in rows(batches, "doc_id", "text"):
                held.append((doc_id, *token_ids(text, own_a, own_b)))
                size += len(text) + 64
                if size >= block_bytes:
                    yield aligned_block(task + n, held, own_a, own_b, digest, work)
                    held, size, n = [], 0, n + 1
            if held:
                yield aligned_block(task + n, held, own_a, own_b, digest, work)

        yield from batched(records(), BLOCKS, 1)

    blocks = scratch.write(text_bytes(docs).mapInArrow(encode, BLOCKS_DDL), "blocks")
    known = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "times")))
    known = known.select("block", F.col("pos").alias("at"), "col.pairs", "col.times")
    totals = known.groupBy("pairs").agg(F.sum("times").alias("total"))
    totals = scratch.write(totals.withColumn("b", F.expr("pairs & 4294967295L")), "totals")
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    ranked = totals.join(most, "b").select("pairs", "total", (F.col("total") == F.col("most")).alias("best"))
    answers = known.join(ranked, "pairs").select(F.col("block").alias("of"), "at", "total", "best")
    done = blocks.drop("pairs", "times").groupBy("block").cogroup(answers.groupBy("of"))
    return done.applyInArrow(counted_block, OUT_DDL)


def counted_block(block: pa.Table, answers: pa.Table) -> pa.Table:
    """Rows of OUT from a block and what Spark says about its pairs."""
    at = answers["at"].to_numpy()
    total, best = np.zeros((2, len(at)), dtype=np.int64)
    total[at] = answers["total"].to_numpy()
    best[at] = answers["best"].to_numpy(zero_copy_only=False)
    column = {c: block[c][0].values for c in ("doc_id", "n_a", "n_b", "n_groups", "groups")}
    links = from_planes(zstandard.ZstdDecompressor().decompress(block["links"][0].as_py()), "<u4")
    stops = np.cumsum(column["n_groups"].to_numpy())
    sums = [np.diff(np.append(0, np.cumsum(x[links]))[np.append(0, stops)]) for x in (best, total)]
    return pa.table(
        [column["doc_id"], column["n_a"], column["n_b"], column["n_groups"], column["n_groups"],
         pa.array(sums[0]), pa.array(sums[1]), column["groups"]],
        schema=OUT,
    )


def op12_cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    aligned = align(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return aligned.withColumnRenamed("groups", "groups_sha256")
