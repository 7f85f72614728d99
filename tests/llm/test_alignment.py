"""Alignment against a plain merge of both token lists."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from icetally.llm import alignment
from icetally.llm.tokens import vocabulary

ODD = [
    "  two  blanks ", "tab\tand\nline", "<|endoftext|> </s> <0x41>", "ｆｕｌｌ ﬁ", "été ñandú 北京 🙂🙂",
    "▁under", "a\x00b", "don't  '", "x" * 3000, " 　", "<unk>",
]


def plain(rows):
    """The contract, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    letters = {}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for n in shown:
        letters[chr(n)] = n
    for n, k in enumerate(x for x in range(256) if x not in shown):
        letters[chr(256 + n)] = k
    out, links = [], []
    for doc_id, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
            for i in ids_b
        ]
        if not text or not (b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode()):
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        ends_a = dict(zip(np.cumsum([len(x) for x in bytes_a]).tolist(), ids_a))
        ends_b = dict(zip(np.cumsum([len(x) for x in bytes_b]).tolist(), ids_b))
        common = sorted(ends_a.keys() & ends_b.keys())
        sides = []
        for ends in (ends_a, ends_b):
            side, now = [], []
            for end, i in sorted(ends.items()):
                now.append(str(i))
                if end in ends_a and end in ends_b:
                    side.append(",".join(now))
                    now = []
            sides.append(side)
        groups = [f"{x}|{y}" for x, y in zip(*sides)]
        links.append([(ends_a[e], ends_b[e]) for e in common])
        out.append([doc_id, len(ids_a), len(ids_b), len(common), len(common), ";".join(groups)])
    counts = Counter(x for own in links for x in own)
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [
        (*r[:5], sum(counts[x] == most[x[1]] for x in own), sum(counts[x] for x in own), r[5])
        for r, own in zip(out, links)
    ]


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else x for x in row)


@pytest.mark.parametrize("block_bytes, work", [(1 << 20, 1 << 16), (300, 3)])
def test_groups_links_and_counts(spark, docs, corpus, block_bytes, work):
    extra = [(1000 + n, t) for n, t in enumerate(ODD)] + [(1000, ODD[0])]
    more = spark.createDataFrame([(*r, 7, None, None, "u") for r in extra], docs.schema)
    got = alignment.align(docs.union(more), block_bytes=block_bytes, work=work).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(corpus + extra), key=key)


def test_query_digests(spark, tmp_path, corpus):
    table = spark.createDataFrame(corpus, "doc_id long, text string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = alignment.op12_cross_tokenizer_alignment(spark, str(tmp_path)).collect()
    want = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[1] else "") for r in plain(corpus)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert set(got[0].asDict()) == {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}


def test_empty_table(no_docs):
    assert alignment.align(no_docs).collect() == []


def test_diagonals_cut_equal_work():
    rng = np.random.default_rng(2)
    for n, m, work in ((1000, 10, 7), (0, 50, 4), (300, 300, 1), (1, 0, 5), (0, 0, 3)):
        a = np.sort(rng.choice(2000, n, replace=False))
        b = np.sort(rng.choice(2000, m, replace=False))
        i, j = alignment.diagonal_cuts(a, b, work)
        steps = np.diff(i + j)
        assert (steps[:-1] == work).all() and (i[-1], j[-1]) == (n, m)
        i, j = alignment.common_ends(a, b, work)
        want = np.intersect1d(a, b)
        assert a[i].tolist() == b[j].tolist() == want.tolist()
