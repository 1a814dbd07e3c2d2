import random

import pytest
from pyspark.sql import types as T

#: The columns of documents, with others whose names clash with those that operators make.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    *(T.StructField(n, T.StringType()) for n in (
        "kept", "keep_id", "node", "score", "slice", "words", "spans", "length", "_text", "Text_",
        "c0", "block", "held_out"))])


@pytest.fixture(scope="session")
def make(spark):
    """Builds documents from (doc_id, text) or (doc_id, text, lang, source)."""

    def docs(rows, parts=3):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "a")),
                 len(r[1]) if r[1] is not None else None, *["x"] * 13) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return docs


@pytest.fixture(scope="session")
def corpus():
    """Texts with nothing, white space, other scripts, copies, near copies, passages and repeats."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abdefghiklmnorstu") for _ in range(rng.randrange(2, 9)))
                  for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", "."])
                        for _ in range(n))

    passage = prose(60)
    rows, base = [], prose(120)
    for i in range(90):
        kind = i % 9
        if kind == 0:
            text = base
        elif kind == 1:
            words = base.split(" ")
            for _ in range(rng.randrange(1, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        elif kind == 2:
            text = prose(30) + "\n" + passage + "\n" + prose(20)
        elif kind == 3:
            text = base.upper() if i % 2 else base.title()
        elif kind == 4:
            text = rng.choice(["", None, "   \n\t ", "one", "Two words", "ÄÖ ß été 日本語 🎉 İx"])
        elif kind == 5:
            text = " ".join([rng.choice(vocabulary)] * 40)
        else:
            text = prose(rng.randrange(5, 200))
        rows.append((i, text))
    rows += [(90, "x" * 5000 + " " + prose(20000)), (91, rows[0][1]), (3, rows[3][1])]
    return rows
