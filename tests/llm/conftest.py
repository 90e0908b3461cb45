import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 60)) for _ in range(n))


def corpus(seed=5, n=60):
    """Texts with copies, near copies, shared lines, blanks, nulls, a long one and repeated rows."""
    r = random.Random(seed)
    texts = []
    for i in range(n):
        lines = [sentence(r, r.randint(1, 30)) for _ in range(r.randint(1, 8))]
        texts.append("\n".join(lines))
    for i in range(0, n, 6):
        words = texts[i].split(" ")
        for _ in range(max(1, len(words) // 40)):
            words[r.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [texts[0], texts[0], "", "   \n ", "one", "two words", "ONE", None, "x" * 5000, sentence(r, 6000), "a b c\nd e f\ng h i\na b c\nd e f\ng h i"]
    rows = [(i + 1, t, i) for i, t in enumerate(texts)]
    return rows + [rows[0], (None, texts[1], 0)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names an operator might use itself."""
    names = "doc_id long, text string, n long"
    df = spark.createDataFrame(rows, names)
    clash = {c: df["n"] for c in ("v", "c", "rid", "key", "sig", "score", "base", "spans", "removed", "bucket", "place", "label", "n_chars")}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
