"""Small tables with every awkward case."""

import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, doc string, node int, key string, size int, "
          "_doc int, copies string, shard string")  # clashing names
def _texts():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, line, base = prose(60), "A common Line of text, repeated", prose(150)
    out = [None, "", " \n\t ", "one", "two words", "ÀB c", line, f"x\n  {line.upper()}\t\ny\nshort\nshort", base, base.upper(), base]
    for i in range(14):  # near copies of different strength
        ws = base.split()
        for _ in range(i):
            ws[rng.randrange(len(ws))] = rng.choice(vocab)
        out.append(" ".join(ws))
    out += [f"{prose(30)} {passage} {prose(20)}", f"{passage} {prose(5)}", f"{prose(8)} {passage}", f"{passage} {prose(3)} {passage}"]
    out += ["same " * 300, "same " * 120, prose(20_000), f"{prose(70)}\n{line}\n{prose(4)}"]
    out += [prose(rng.randint(3, 120)) for _ in range(25)]
    return out


@pytest.fixture(scope="session")
def texts():
    return _texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Unique ids in an order of their own, without NULL ids: what the brute-force versions take."""
    ids = list(range(100, 100 + len(texts)))
    random.Random(3).shuffle(ids)
    rows = [(i, t, "en", [None, "a", "b", "c"][i % 4], len(t or ""), "x", 1, "k", 2, 3, "c", "s") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows and rows without an id."""
    rows = [(7, "a b c d e f g"), (7, "a b c d e f g"), (None, "a b c d e f g"), (None, "quite another text, this one"), (None, None), (9, None), (3, "")]
    return spark.createDataFrame([(i, t, "en", "a", 0, "x", 1, "k", 2, 3, "c", "s") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def pairs(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
