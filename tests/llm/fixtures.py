"""Small tables with the hard cases that every operator must handle."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n: int = 60, seed: int = 1) -> list[tuple]:
    """Documents with copies, near copies, shared passages, repeated lines, nulls, empty and long texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abdeilmnorstué") for _ in range(r.randrange(2, 9))) for _ in range(400)] + ["the", "of", "and"]
    line = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, boilerplate = line(60), line(14)
    rows = []
    for _ in range(n):
        parts = [line(r.randrange(5, 40)) for _ in range(r.randrange(1, 6))]
        if r.random() < 0.3:
            parts.insert(r.randrange(len(parts) + 1), passage)
        if r.random() < 0.3:
            parts.append(boilerplate)
        rows.append("\n".join(parts))
    for k in range(0, n, 6):
        rows.append(rows[k])
        words = rows[k].split(" ")
        words[r.randrange(len(words))] = "changed"
        rows.append(" ".join(words))
        rows.append(rows[k][:-1] + "z")
    rows += [None, "", " \n\t\n", "one", "one two", "one two", rows[0] + "\n" + "\n".join(rows[:40])]
    found = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(rows)]
    return [*found, found[3], (None, rows[1], None, None, None)]


def table(spark, rows=None):
    return spark.createDataFrame(texts() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
