import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from salesgrid.llm import cross_tokenizer as ct
from salesgrid.llm import queries, textops

from .helpers import docs

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a  b ", " ", "  ", "a\tb\n\nc d", "x▁y abc d", "▁", "<s>hi</s> <|endoftext|> ok <unk> <0x41>", "　 x ﬁ    y", "a  b",
       "a  b   c", "a\x00b c", "\x1c x \x85 y \x1f z", "é\r\n d", "😀😀 日本語 テスト " * 30, "word " * 3 + " ", "don't we're 12,000.50 $%",
       "aaaa aaaaa aaaaaa", " lead", "é ​ x‍ y", "日本語" * 400, "x" * 3000, None, ""]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    sign = ct._byte_signs()
    of_a = {i: bytes(sign[c] for c in n) if all(c in sign for c in n) else n.encode() for n, i in a.get_vocab().items()}
    of_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, b.id_to_piece(i)) for i in range(b.get_piece_size()))]
    return a, b, of_a, of_b


def _plain(tools, text):
    """Groups and links of one text, by a walk over both token lists."""
    a, b, of_a, of_b = tools
    x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
    if not text or any(b"".join(t) != (" " + text).encode() for t in ([of_a[k] for k in x], [of_b[k] for k in y])):
        return [], [], [], []
    groups, links, left, right, i, j, end_a, end_b = [], [], [], [], 0, 0, len(of_a[x[0]]), len(of_b[y[0]])
    while True:
        links.append((x[i], y[j]))
        step_a, step_b = end_a <= end_b, end_b <= end_a
        left += [x[i]] * step_a
        right += [y[j]] * step_b
        if step_a and step_b:
            groups.append((left, right))
            left, right = [], []
        i, j = i + step_a, j + step_b
        if i == len(x):
            return x, y, groups, links
        end_a += len(of_a[x[i]]) * step_a
        end_b += len(of_b[y[j]]) * step_b


def _check(tools, table, rows):
    plain = [(r.doc_id, _plain(tools, r.text)) for r in table]
    count = Counter(link for _, p in plain for link in p[3])
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)

    def digest(groups):
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        return hashlib.sha256(shown.encode()).hexdigest() if shown else ""

    want = [(d, len(x), len(y), len(g), len(k), sum(count[p] == best[p[1]] for p in k), sum(count[p] for p in k), digest(g))
            for d, (x, y, g, k) in plain]
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_whole_table_against_a_walk(spark, tools):
    _check(tools, spark.read.parquet(f"{SF}/documents.parquet").collect(), queries.op11_alignment(spark, SF).collect())


def test_odd_texts_nulls_and_repeated_rows(spark, tools):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "again a b"), (3, "again a b"), (None, "the cat"), (None, "the cat"), (None, None)]
    rng = random.Random(5)
    signs = ["the", " ", "  ", "\n", "token", "ization", "é", "▁", "日", "😀", "'s", "12", " ", "　", "\t", "-", "un"]
    rows += [(100 + i, "".join(rng.choices(signs, k=rng.randint(1, 40)))) for i in range(300)]
    table = docs(spark, rows, "row,kind,pairs,n_best")
    _check(tools, table.collect(), ct.align(table, A, B).collect())
    assert ct.align(table.limit(0), A, B).collect() == []


def test_links_beyond_the_broadcast_pairs(spark, tools, monkeypatch):
    monkeypatch.setattr(ct, "HOT", 20)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    _check(tools, table.collect(), ct.align(table, A, B).collect())


def test_cut_texts_and_a_full_cache_give_the_same(monkeypatch):
    monkeypatch.setattr(ct, "CACHE", 50)
    cut, whole = ct.Aligner(A, B), ct.Aligner(A, B)
    assert cut.cuts
    whole.cuts = False
    for _ in range(3):
        for at in range(0, len(ODD), 7):
            texts = pa.record_batch({"text": pa.array(ODD[at:at + 7], pa.string())})
            one, other = ct._one(cut, texts), ct._one(whole, texts)
            assert all(one[k].to_pylist() == other[k].to_pylist() for k in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256"))
            assert [sorted(zip(x or [], n or [])) for x, n in zip(one["pairs"].to_pylist(), one["pairs_n"].to_pylist())] \
                == [sorted(zip(x or [], n or [])) for x, n in zip(other["pairs"].to_pylist(), other["pairs_n"].to_pylist())]
    assert len(cut.known) <= 50


def test_segments_keep_the_text():
    data, rows = textops.buffers(pa.array([t for t in ODD if t]))
    start, end, row = ct.segments(data, rows, True)
    for r in range(len(rows) - 1):
        parts = [data[a:b].tobytes() for a, b in zip(start[row == r], end[row == r])]
        assert b" ".join(parts) == data[rows[r]:rows[r + 1]].tobytes() and all(parts)


def test_other_kinds_of_tokenizer_are_refused():
    with pytest.raises(ValueError):
        ct.Aligner(public_tokenizers.path("word_bpe_49k.json"), B)
