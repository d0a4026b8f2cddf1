import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that the operators use themselves.
CLASHES = ["doc", "h", "key", "fp", "n", "spans", "head", "runs", "score", "host", "size", "words"]


@pytest.fixture(scope="session")
def table(spark):
    """A documents table of ``(doc_id, text)`` or ``(doc_id, text, lang)`` rows, with clashing extra columns."""
    def build(rows, clashes=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clashes:
            from pyspark.sql import functions as F
            df = df.withColumns({c: F.lit(None).cast("string") if i % 2 else F.lit(i) for i, c in enumerate(CLASHES)})
        return df
    return build


def odd_rows(seed=0, words=None):
    """Nulls, empty and blank texts, ties, repeated rows, other scripts, one long text."""
    rng = random.Random(seed)
    words = words or ["alpha", "beta", "Gamma", "δέλτα", "x1"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    same = say(60)
    rows = [(1, None), (2, ""), (3, "   \n\t"), (4, same), (5, same), (5, same), (7, same + " end"), (6, "one"), (None, same), (None, None),
            (9, say(3000)), (10, "\x00\x0b weird space ▁▁ \U0001f389"), (11, "a" * 5000), (12, "日本語 " * 50)]
    return rows + [(20 + i, say(rng.randrange(1, 80))) for i in range(20)]


@pytest.fixture(scope="session")
def odd():
    return odd_rows
