import random

import pytest


def texts(seed: int, n: int) -> list[str | None]:
    """Prose with copies, near copies, odd and empty texts."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(300)]
    out: list[str | None] = []
    for k in range(n):
        if k % 11 == 5 and out:
            out.append(r.choice(out))
        elif k % 7 == 3 and (base := r.choice([x for x in out if x] or ["a b"]).split(" ")):
            base[r.randrange(len(base))] = r.choice(words)
            out.append(" ".join(base))
        else:
            out.append(" ".join(r.choice(words) for _ in range(r.randint(1, 120))))
    return [*out, None, "", " \n\t", "one", "two words", "Ünïcode ß 日本 words and words", "x" * 5000, "a  b\n\n c d"]


@pytest.fixture(scope="session")
def docs(spark):
    """documents with nulls in every column, a repeated row and extra columns that clash with names used within."""
    rows = [(k, t, None if k % 13 == 0 else f"src{k % 5}", "en", k * 7) for k, t in enumerate(texts(3, 150))]
    rows += [(None, "no id at all but words enough to count", None, None, None), rows[1]]
    schema = "doc_id long, text string, source string, lang string, n_chars long"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "'x' as utf8", "1 as part", "2 as n", "3 as size", "true as kept", "0.5D as score")
    return df.repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
