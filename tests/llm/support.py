"""Small tables with everything that a table may hold, and ways to read results."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"
#: names that operators use inside
CLASHES = ("size", "row_key", "n", "cls", "shard", "slot", "score", "row", "spans", "copies", "doc_key", "hash", "once", "component")


def documents(spark, rows, clash: bool = True):
    """(doc_id, text, source) rows as a documents table, with columns whose names clash."""
    extra = "".join(f", {c} string" for c in CLASHES) if clash else ""
    wide = [(i, t, "en", s, len(t or ""), *(("x",) * len(CLASHES) if clash else ())) for i, t, s in rows]
    return spark.createDataFrame(wide, f"doc_id long, text string, lang string, source string, n_chars long{extra}")


def edge_rows(seed: int = 1, n: int = 60):
    """Null ids, texts and sources; empty, blank, one-word and long texts; repeated rows, ids and texts."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    text = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    rows = [(i, text(rnd.randint(5, 60)), f"s{i % 4}") for i in range(n)]
    rows += [(n + i, rows[i][1], "s1") for i in range(10)]  # equal texts
    rows += [rows[3], rows[3], rows[4]]  # equal rows
    rows += [(5, text(20), "s2")]  # an id with another text
    rows += [(None, text(9), "s0"), (200, None, "s0"), (201, "", None), (202, " \n\t ", None), (203, "one", "s3"), (204, "one", "s3"), (205, text(20000), "s3")]
    rows += [(206, None, None), (206, None, None)]
    return rows


def words(text):
    return (text or "").encode().split()
