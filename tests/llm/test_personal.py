"""Fixed patterns against plain searches, and identifiers that only contexts give away."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from icetally.llm import personal

PLAIN = {
    0: re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    1: re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    2: re.compile(r"[0-9]([\x20-]?[0-9])+"),
    3: re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def good(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == 1:
        return all(int(p) <= 255 for p in text.split("."))
    if kind == 2:
        double = [sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
        return 14 <= len(digits) <= 19 and sum(double) % 10 == 0
    return kind == 0 or 10 <= len(digits) <= 15


def brute(text):
    return sorted(
        (m.start(), kind, m.end())
        for kind, pattern in PLAIN.items()
        for m in pattern.finditer(text)
        if good(kind, m.group())
    )


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab1205.@+-() %é\n", max_size=60))
def test_fixed_patterns(text):
    assert personal.fixed_spans(text) == brute(text)


def test_known_cases():
    for text in [
        "a@b.c@d.e x..y@z.w.v, 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 4539 1488 0343 6467",
        "+1 (743) 555-3824) +1234567890+12 345-678-90123 1.2.3 4-5 " + "9" * 3000 + " " + "a" * 3000 + "@",
        "é x@y.zé 78.5.3.2é",
    ]:
        assert personal.fixed_spans(text) == brute(text)


def card(rnd):
    body = [rnd.randint(0, 9) for _ in range(15)]
    return next(s for d in range(10) if personal.luhn(s := "".join(map(str, [*body, d]))))


def make():
    rnd = random.Random(4)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    fill = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows, hidden = [], {}
    for i in range(60):
        rows.append((i, f"{fill(5)} card number {card(rnd)} thanks bye {fill(4)}"))
        rows.append((100 + i, f"{fill(5)} please call +1 (555) 555-{rnd.randint(1000, 9999)} any time {fill(3)}"))
        rows.append((200 + i, f"{fill(8)} {rnd.randint(10**8, 10**9)} {fill(8)}"))
    for i in range(5):
        number = str(rnd.randint(2 * 10**9, 10**10 - 1))
        rows.append((300 + i, f"{fill(3)} please call {number} any time {fill(2)}"))
        hidden[300 + i] = (3, number)
    rows += [(400, None), (401, ""), (402, "x" * 200_000 + "@"), (403, rows[0][1]), (0, rows[0][1]), (None, "a@b.de")]
    return rows, hidden


def test_contexts_find_unseen_numbers(spark):
    data, hidden = make()
    frame = spark.createDataFrame([(*r, 1, "k") for r in data], "doc_id long, text string, start int, kind string")
    got = personal.personal_data(frame).collect()
    assert len(got) == len(data)
    want = sorted((str(d), brute(t or "")) for d, t in data)
    assert sorted((str(r["doc_id"]), [tuple(s) for s in r["base"]]) for r in got) == want
    texts = dict(data)
    added = {
        r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"] : s["stop"]]) for s in r["added"]]
        for r in got
        if r["added"]
    }
    assert added == {d: [x] for d, x in hidden.items()}


def test_found_numbers_make_the_next_generations_patterns(spark):
    """Only numbers of the first generation stand in the second context."""
    rnd = random.Random(9)
    words = [f"filler{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    fill = lambda n: " ".join(rnd.sample(words, n))
    data = [(i, f"{fill(4)} please call +1 (555) 555-{1000 + i} any time {fill(3)}") for i in range(60)]
    first = [str(2_000_000_000 + 7919 * i) for i in range(30)]
    for i, number in enumerate(first):
        data.append((100 + i, f"{fill(3)} please call {number} any time {fill(2)}"))
        data.append((200 + i, f"{fill(3)} my mobile {number} after lunch {fill(2)}"))
    data.append((300, f"{fill(3)} my mobile 3123456789 after lunch {fill(2)}"))
    data.append((301, f"{fill(3)} other thing 3987654321 entirely different {fill(2)}"))
    frame = spark.createDataFrame(data, "doc_id long, text string")
    texts = dict(data)
    added = {
        r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["stop"]] for s in r["added"]]
        for r in personal.personal_data(frame).collect()
        if r["added"]
    }
    want = {100 + i: [n] for i, n in enumerate(first)} | {200 + i: [n] for i, n in enumerate(first)}
    assert added == want | {300: ["3123456789"]}


def test_query_columns(spark, tmp_path):
    data, _ = make()
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = {}
    for d, t in data:
        texts.setdefault(d, t or "")
    for r in personal.op9_personal_data(spark, str(tmp_path)).collect():
        base = ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in brute(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        assert r["n_card"] == base.count("card:") and r["n_phone"] == base.count("phone:")


def test_no_rows(spark, no_docs):
    assert personal.personal_data(no_docs).collect() == []
