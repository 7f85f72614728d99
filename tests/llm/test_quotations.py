"""Quotation links and reply order against a direct reading of small threads."""

import random

from icetally.llm import quotations as q

ROWS = [
    (1, 0, "user", "How do I bake bread?\nI have flour.\n\nAnd no yeast at all."),
    (1, 1, "assistant", "Use baking soda.\nMix it well."),
    (1, 2, "user", "On Monday the assistant wrote:\n> Use   baking soda. Mix\n> it well.\n\nHow much of it?"),
    (1, 3, "user", "> I have FLOUR.\n\nI have rye flour too."),
    (1, 4, "assistant", "> > Use baking soda.\n> > Mix it well.\n> How much of it?\n\nTwo spoons."),
    (1, 5, "user", "> nobody said this\nStill here."),
    (1, 6, "user", "Thanks.\n>And no yeast at all.\n"),
    (2, 0, "user", "Use baking soda."),
    (2, 1, "user", "> And no yeast at all.\nwrong conversation"),
    (2, 2, None, None),
    (2, 3, "user", ""),
    (None, 0, "user", "lost"),
    (None, 1, "user", "> lost\nfound"),
]


def run(spark, rows):
    frame = spark.createDataFrame(
        [(*r, 1, 2) for r in rows],
        "conv_id long, turn long, role string, text string, uid int, path int",
    )
    return q.conversations(frame).collect()


def test_threads(spark):
    got = {(r["conv_id"], r["turn"]): r for r in run(spark, ROWS)}
    assert len(got) == len(ROWS)
    reply = {k: r["reply_to"] for k, r in got.items() if r["reply_to"] is not None}
    assert reply == {(1, 2): 1, (1, 3): 0, (1, 4): 2, (1, 6): 0, (None, 1): 0}
    order = [t for _, t in sorted((r["place"], k[1]) for k, r in got.items() if k[0] == 1)]
    assert order == [0, 3, 6, 1, 2, 4, 5]
    assert [tuple(x) for x in got[1, 4]["quotes"]] == [(1, 2), (2, 1)]
    assert got[1, 4]["depth"] == 2 and got[1, 4]["text"] == "Two spoons." and got[1, 4]["n_quoted"] == 3
    assert got[1, 2]["text"] == "How much of it?"
    assert got[1, 5]["text"] == "Still here." and got[1, 5]["reply_to"] is None
    assert got[2, 2]["text"] is None and got[2, 3]["text"] == ""
    assert got[2, 1]["reply_to"] is None


def test_sentences_of_a_paragraph_that_is_wrapped_anew(spark):
    source = "Heat the oven first. Then knead the dough for ten minutes!\nLet it rest (in a bowl). Bake it."
    rows = [
        (1, 0, "user", source),
        (1, 1, "user", "Let it rest, they said.\nNothing more."),
        (1, 2, "user", "> Then knead the\n> dough for ten minutes! Let it\n> rest (in a bowl).\n\nTen?"),
        (1, 3, "user", "> ten minutes! Let it\n\nNo whole sentence."),
    ]
    got = {r["turn"]: r for r in run(spark, rows)}
    assert [got[t]["reply_to"] for t in range(4)] == [None, None, 0, None]
    assert got[2]["text"] == "Ten?" and got[2]["depth"] == 1
    levels = {(g, w) for _, g, w, _, _ in q.pieces(0, source.split("\n"))}
    assert levels == {(q.WHOLE, 19), (q.LINE, 11), (q.LINE, 8), (q.SENTENCE, 4), (q.SENTENCE, 7), (q.SENTENCE, 6), (q.SENTENCE, 2)}


def brute(rows):
    """Place of each message by walking the tree of whole-message quotations."""
    places = {}
    for conv in {r[0] for r in rows}:
        own = sorted((t, text) for c, t, _, text in rows if c == conv)
        clean = {t: text.split("\n")[-1] for t, text in own}
        parent = {}
        for t, text in own:
            if text.startswith(">"):
                quoted = text.split("\n")[0][2:]
                source = [s for s, _ in own if s < t and clean[s] == quoted]
                if source:
                    parent[t] = source[-1]
        order = []

        def walk(t):
            order.append(t)
            for u, _ in own:
                if parent.get(u) == t:
                    walk(u)

        for t, _ in own:
            if t not in parent:
                walk(t)
        places |= {(conv, t): n for n, t in enumerate(order)}
    return places


def test_deep_threads_and_a_long_conversation(spark):
    rnd = random.Random(6)
    rows = []
    for conv, n in ((0, 400), (1, 30), (2, 3)):
        texts = []
        for t in range(n):
            mine = f"message {rnd.randint(0, 50)} words" if rnd.random() < 0.3 else f"own {conv} {t}"
            if texts and rnd.random() < 0.7:
                rows.append((conv, t, "user", f"> {rnd.choice(texts[-3:])}\n{mine}"))
            else:
                rows.append((conv, t, "user", mine))
            texts.append(mine)
    rnd.shuffle(rows)
    assert {(r["conv_id"], r["turn"]): r["place"] for r in run(spark, rows)} == brute(rows)


def test_table_and_no_rows(spark):
    sf_dir = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = q.op4_chat_formatting(spark, sf_dir)
    assert got.count() == given.count()
    assert got.select("conv_id", "turn", "text").exceptAll(given.select("conv_id", "turn", "text")).isEmpty()
    assert q.conversations(given.limit(0)).collect() == []
