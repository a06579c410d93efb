"""Small tables and brute-force versions for the tests of the training-data operators."""

import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=""):
    """Rows of (doc_id, text[, lang, source]); ``extra`` adds columns with clashing names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s1",
             None if r[1] is None else len(r[1])) for r in rows]
    if not extra:
        return spark.createDataFrame(full, DOCS)
    names = [e.strip() for e in extra.split(",")]
    return spark.createDataFrame([(*f, *["x"] * len(names)) for f in full],
                                 DOCS + "".join(f", `{n}` string" for n in names))


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def components(ids, links):
    """Smallest member of each one's component."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
