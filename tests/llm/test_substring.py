import hashlib
import random

from salesgrid.llm import bitmap, queries, substring

from .helpers import docs, prose, words

SF = "/root/testdata/sf0.001"


def _brute(table):
    """Kept words of (doc_id, text) rows; rows of one id are one document, a null id comes last."""
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, t in table:
        w = words(t)
        for j in range(len(w) - 19):
            key, at = tuple(w[j:j + 20]), (order(i), j)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, t in table:
        w, gone = words(t), set()
        for j in range(len(w) - 19):
            if first[tuple(w[j:j + 20])] < (order(i), j):
                gone.update(range(j, j + 20))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def _found(frame):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256)
                  for r in substring.digests(frame).collect())


def _tables():
    rng = random.Random(9)
    shared = [prose(rng, n) for n in (20, 25, 60, 300, 19)]
    for seed in range(3):
        rows = []
        for i in range(60):
            parts = [prose(rng, rng.randint(0, 60))]
            for _ in range(rng.randint(0, 4)):
                w = rng.choice(shared).split()
                if rng.random() < 0.4:
                    w[rng.randrange(len(w))] = "edit"
                parts.append(" ".join(w[rng.randint(0, 3):]))
                parts.append(prose(rng, rng.randint(0, 8)))
            if rng.random() < 0.3:
                parts.append(" ".join(rng.choice(["a", "a b", "a b c d e f g h i j k", "x y x"]) for _ in range(1))
                             .join([" "] * rng.randint(2, 90)))
            rows.append((rng.randrange(1000), " ".join(parts)))
        yield list({i: (i, t) for i, t in rows}.values())


def test_generated_tables_against_brute_force(spark, monkeypatch):
    for k, rows in enumerate(_tables()):
        monkeypatch.setattr(substring, "MAX_CONTENTS", (1024, 2, 1)[k])     # also every anchor by windows
        assert _found(substring.remove_repeats(docs(spark, rows))) == _brute(rows)


def test_full_bitmap_costs_no_result(spark, monkeypatch):
    monkeypatch.setattr(bitmap, "MAX_BITS", 1 << 16)
    rows = next(_tables())
    assert _found(substring.remove_repeats(docs(spark, rows))) == _brute(rows)


def test_whole_table(spark):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op7_substring(spark, SF).collect())
    assert got == _brute(table)


def test_every_period_alone_and_in_two_documents(spark):
    rows = []
    for period in range(1, 21):
        for times in range(2, 9):
            for copies in (1, 2):
                line = " ".join(f"p{period}t{times}c{copies}w{j}" for j in range(period))
                rows += [(len(rows) + j, " ".join([line] * times)) for j in range(copies)]
    assert _found(substring.remove_repeats(docs(spark, rows))) == _brute(rows)


def test_repeated_rows_beside_an_edited_copy(spark):
    rows = []
    for k in range(12):
        line = [f"r{k}w{j}" for j in range(30)]
        edited = " ".join([*line[:27], "edit", *line[28:]])
        rows += [(2 * k, " ".join(line)), (2 * k, " ".join(line)), (2 * k + 1, edited), (2 * k + 1, edited)]
    assert _found(substring.remove_repeats(docs(spark, rows))) == _brute(rows)


def test_edges(spark):
    long = " ".join(f"v{i}" for i in range(30))
    rows = [(3, long), (1, "A" + long), (2, None), (4, ""), (5, "one two"), (6, long.upper()), (7, "z " * 5000),
            (8, "z " * 21), (9, long.replace(" ", "\n")), (10, long.replace(" ", "\xa0"))]
    assert _found(substring.remove_repeats(docs(spark, rows, "ord,row,start,size"))) == _brute(rows)
    assert _found(substring.remove_repeats(docs(spark, []))) == []
    # Rows that share an id are one document for the order; equal rows keep their words.
    twice = [(1, long), (1, long), (1, "x " + long), (None, long)]
    assert _found(substring.remove_repeats(docs(spark, twice))) == _brute(twice)


def test_automaton_matching_statistics():
    rng = random.Random(10)
    for _ in range(200):
        automaton, seen = substring.SuffixAutomaton(), []
        for _ in range(rng.randint(1, 5)):
            text = [rng.randrange(3) for _ in range(rng.randint(0, 12))]
            got = automaton.add(text)
            for j in range(len(text)):
                earlier = [t[:e] for t in seen for e in range(1, len(t) + 1)] + [text[:e] for e in range(1, j + 1)]
                best = max((n for n in range(1, j + 2) if any(x[-n:] == text[j + 1 - n:j + 1] for x in earlier
                                                             if len(x) >= n)), default=0)
                assert got[j] == best
            seen.append(text)
