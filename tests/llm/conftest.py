import random

import pytest

WORDS = [f"w{i}" for i in range(60)] + ["Ünter", "Straße", "été", "A1", "x.y"]


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows with copies, near copies, shared passages, odd spaces, empties, nulls and ties."""
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    passage, other = text(70), text(55)
    rows = [(i, text(rnd.randint(1, 160))) for i in range(40)]
    rows += [(40 + i, f"{text(9)} {passage}\t{text(7)}\n{text(3)}") for i in range(6)]
    rows += [(50 + i, rows[i][1]) for i in range(8)]
    rows += [(60, f"{other} {text(20)} {other}"), (61, other), (62, other + "\x0b tail")]
    rows += [(70, None), (71, ""), (72, " \n\t "), (73, "one"), (74, "one two"), (75, None)]
    rows += [(80, passage + "\n" + rows[3][1]), (81, " ".join(passage.split()[5:60]))]
    rows += [(None, passage), (None, None), (90, rows[5][1]), (90, rows[6][1]), (91, rows[5][1])]
    rows += [(92, text(6000)), (93, "\xa0" + rows[2][1])]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns of clashing names."""
    schema = "doc_id long, text string, n_words long, name string, key long, uid string"
    return spark.createDataFrame([(*r, 7, None, None, "u") for r in corpus], schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
