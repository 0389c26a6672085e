"""Small document sets and plain reference versions."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, pairs, parts=3):
    """(doc_id, text) rows as documents."""
    data = [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs]
    return spark.createDataFrame(data, DOCS).repartition(parts)


def clashing(df):
    """With extra columns named like those that operators use inside."""
    return df.withColumns({c: F.lit(7) for c in ("id", "n", "sig", "component", "keys", "ranges", "part", "size", "line", "_drop", "score", "w", "k", "p", "t", "item_id")})


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def copies(seed=1, groups=6, each=5, words=60, edits=3):
    """Texts in groups of near copies, with exact copies, short and empty ones and a null."""
    r, out = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{r.randrange(4000)}" for _ in range(words)]
        for _ in range(each):
            t = list(base)
            for _ in range(r.randrange(edits + 1)):
                t[r.randrange(words)] = f"x{r.randrange(10**6)}"
            out.append(" ".join(t))
        out.append(" ".join(base))
    out += ["", None, "a b", "a b", "A  b\t", "one", "a b c d e", "a b c d e f", "  ", "ü ß é a b c d e f g"]
    r.shuffle(out)
    return list(enumerate(out))
