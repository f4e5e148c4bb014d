import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, uid long, score double, id string, w string, spans string, held_out string, component string, lang_pred string"


def prose(seed: int, n: int, words: int = 400) -> str:
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice(["an", "the", "or", "in", "est", "ü", "re"]) for _ in range(rnd.randint(1, 3))) for _ in range(60)]
    own = [f"w{seed}x{i}" for i in range(words)]
    return " ".join(rnd.choice(vocab) if rnd.random() < 0.5 else rnd.choice(own) for _ in range(n))


def corpus() -> list[tuple[int | None, str | None]]:
    """Texts with exact and near copies, shared passages, repetition inside one text, odd and missing values."""
    shared, other = prose(1000, 60), prose(1001, 45)
    out: list[tuple[int | None, str | None]] = [(i, prose(i, 30 + 7 * i)) for i in range(12)]
    out += [(20, out[3][1]), (21, out[3][1]), (19, out[5][1] + " tail words here"), (22, "Lead " + shared + " " + prose(77, 20)), (23, prose(78, 33) + "\n" + shared), (24, shared)]
    out += [(25, other + " " + prose(79, 10) + " " + other), (26, "Same Same " * 150), (27, "Same Same " * 150), (28, "a" * 900), (29, "é" * 300 + prose(80, 40) + "é" * 300)]
    out += [(30, None), (31, ""), (32, "   \t\n "), (33, "one two"), (34, "one two"), (35, "x" * 199), (36, "x" * 200), (None, prose(90, 40)), (None, prose(90, 40)), (37, prose(2, 3000, 900))]
    out += [(9, out[9][1]), (40, "A\x00B\x0bC\x0cD <|endoftext|> 日本語 😀 é"), (41, "THE The the"), (42, "!!! ??? 123")]
    return out


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, 1, k, k, 0.5, "q", None, "z", "true", None, "xx") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
