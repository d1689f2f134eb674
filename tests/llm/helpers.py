"""Small documents with the awkward cases every operator must take."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, _group int, bytes string"


def texts(seed: int = 1, n: int = 60) -> list:
    rng = random.Random(seed)
    words = ["the", "of", "and", "erth", "Ingtion", "THE!!", "a|b", "###", "été", "straße", "漢字", "😀", "x" * 40, "I'm", "don't", "12", "3.5", "\x85", " y"]
    out = [None, "", " \n\t", "a", "a b", "été", "'s", "\x00", "z\x00\x00", "<|endoftext|>", "x<|endoftext|> <|startoftext|> y", "൬ \U0003fffe z", "w" * 9000, "same text here now", "same text here now", "same text here now!", "\n".join(["line one two"] * 8)]
    for _ in range(n):
        out.append("".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", " "]) for _ in range(rng.randint(1, 120))))
    out.append(" ".join(rng.choice(words) for _ in range(6000)))
    return out


def documents(spark, rows: list | None = None):
    """Documents with clashing extra columns; the last id occurs three times, and one id is null."""
    rows = texts() if rows is None else rows
    ids = [*range(len(rows))]
    data = [(i, t, ["en", "fr", None][i % 3], "src0", None if t is None else len(t), 0.5, "x", 1, "b") for i, t in zip(ids, rows)]
    if rows:
        data += [data[-1], data[-1], (None, "null id text with a few words", None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
