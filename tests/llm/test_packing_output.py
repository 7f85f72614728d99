"""Packing and token-id files against the tokenizer and exact round trips."""

import zlib

import numpy as np
import pytest

from icetally.llm import binary_output, packing
from icetally.llm.shared import Scratch
from icetally.llm.tokens import Encoder, vocabulary

ODD = ["a ́b", "x<|endoftext|>y", "ΟΔΟΣ ΟΔΟΣ", "it's  we'll\t\n don 't", " x y\x1cz", "İI", "ÿ ðþ. ſ Ÿ", "a.. ,. Éa. É, ª. ßẞ µ."]


def plain_ids(text, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_exact(corpus, name):
    encoder = Encoder.of(name)
    for text in [t or "" for _, t in corpus] + ODD:
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want


def test_plan_places_every_piece():
    rng = np.random.default_rng(1)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 129, 90), rng.integers(1, 60, 90))}
    counts[128] = 7
    entries = packing.plan(counts, 128)
    placed = dict.fromkeys(counts, 0)
    for bins, use in entries:
        assert bins > 0 and sum(length * k for length, k in use) <= 128
        for length, k in use:
            placed[length] += bins * k
    assert placed == counts
    plain = sum(bins for bins, _ in packing.best_fit(counts, 128))
    assert sum(bins for bins, _ in entries) <= plain


def test_many_lengths_fill_the_sequences():
    rng = np.random.default_rng(3)
    counts = {}
    for length in np.minimum(rng.lognormal(6.3, 0.9, 60_000).astype(int) + 1, 2048):
        counts[int(length)] = counts.get(int(length), 0) + 1
    used = sum(bins for bins, _ in packing.plan(counts, 2048))
    assert used <= 1.002 * sum(n * c for n, c in counts.items()) / 2048 + 1


def check_packed(rows, capacity, want):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    got = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] is not None)
    pieces = []
    for doc, ids in want:
        for piece, start in enumerate(range(0, len(ids), capacity)):
            cut = ids[start : start + capacity]
            pieces.append((doc, piece, start, len(cut), zlib.crc32(cut.tobytes())))
    assert got == sorted(p for p in pieces if p[0] is not None)
    assert len(rows) == len(pieces)
    return len(by_sequence), -(-sum(len(ids) for _, ids in want) // capacity)


def test_packed_documents(docs, corpus):
    rows = packing.pack(docs, capacity=256).collect()
    used, bound = check_packed(rows, 256, [(d, plain_ids(t, 0)) for d, t in corpus])
    assert used <= 1.05 * bound + 1


def test_files_come_back(spark, docs, corpus):
    got = binary_output.encode_and_read_back(docs).collect()
    want = sorted(((d, plain_ids(t, 2)) for d, t in corpus), key=lambda x: (x[0] is None, x[0] or 0))
    got = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [d for d, _ in want]
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    crcs = lambda rows: sorted((str(d), n, c) for d, n, c in rows)
    assert crcs((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == crcs(
        (d, len(ids), zlib.crc32(ids.tobytes())) for d, ids in want
    )


def test_single_documents_are_read(spark, docs, corpus, monkeypatch):
    scratch = Scratch(spark)
    folder = scratch.path("ids")
    manifest = scratch.write(binary_output.encode_files(docs, folder), "manifest")
    wanted = spark.createDataFrame([(3,), (60,), (90,), (12345,)], "doc_id long")
    got = binary_output.read_documents(manifest, folder, wanted).collect()
    want = [(d, plain_ids(t, 2).tolist()) for d, t in corpus if d in (3, 60, 90)]
    assert sorted((r["doc_id"], r["ids"]) for r in got) == sorted(want)


def test_a_changed_frame_is_noticed(tmp_path):
    path = tmp_path / "x.zst"
    contents = [(1, b"abcd" * 50), (None, b""), (3, b"wxyz")]
    with open(path, "wb") as target:
        binary_output.write_file(target, iter(contents))
    with open(path, "rb") as source:
        reader = binary_output.SeekableReader(source)
        assert [reader.document(i) for i in range(3)] == [c for _, c in contents]
        reader.checks[2] ^= 1
        with pytest.raises(ValueError):
            reader.document(2)


def test_a_seekable_file_is_plain_zstandard(tmp_path):
    import io

    import zstandard

    target = io.BytesIO()
    binary_output.write_file(target, iter([(1, b"abcd"), (2, b"efgh")]))
    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(target.getvalue()), read_across_frames=True)
    assert stream.read() == b"abcdefgh"


def test_empty_tables(no_docs):
    assert packing.pack(no_docs).collect() == []
    assert binary_output.encode_and_read_back(no_docs).collect() == []
