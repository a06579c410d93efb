import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from salesgrid.llm import queries, token_output

from .helpers import docs

SF = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("word_bpe_49k.json")


def _want(table):
    t, out, start = Tokenizer.from_file(FILE), [], 0
    for i, text in sorted(table, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op9_token_files(spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == _want(table)


def test_pieces_encode_like_whole_texts():
    rng = random.Random(12)
    parts = list("abAB'.,;:!?<>|- \n\t1٣éÉßΣσ́ﬁ€  ‍日😀İ") + ["<|endoftext|>", "<|EndOfText|>", "'s", "'RE"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(5000)]
    ids, offsets = token_output._Encoder(FILE).encode(token_output.pieces(pa.array(texts)), 1)
    whole = Tokenizer.from_file(FILE).encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [[*e.ids, 1] for e in whole]


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(token_output, "CACHE_WORDS", 3)
    encoder = token_output._Encoder(FILE)
    one = encoder.encode(token_output.pieces(pa.array(["a b c d e"])), 1)[0].tolist()
    encoder.encode(token_output.pieces(pa.array(["f g h"])), 1)
    assert encoder.encode(token_output.pieces(pa.array(["a b c d e"])), 1)[0].tolist() == one


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_file_format(spark, tmp_path, encoding):
    rng = random.Random(13)
    table = docs(spark, [(i, " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(40)))
                         for i in range(3000)]).repartition(3)
    token_output.write_tokens(table, f"file://{tmp_path}/t", FILE, metadata=["source"], encoding=encoding,
                              row_group_bytes=128 << 10, page_bytes=16 << 10)
    files = [tmp_path / "t" / f for f in sorted(os.listdir(tmp_path / "t")) if f.endswith(".parquet")]
    ids, groups = [], 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c)
                       for c in range(meta.num_columns)}
            tokens = next(c for n, c in columns.items() if n.startswith("tokens"))
            want = "RLE_DICTIONARY" if encoding == "dictionary" else "DELTA_BINARY_PACKED"
            assert want in tokens.encodings or (want == "RLE_DICTIONARY" and "PLAIN_DICTIONARY" in tokens.encodings)
            assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index
        ids += pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()
    assert ids == list(range(3000)) and groups > len(files)
    back = token_output.read_back(spark, f"file://{tmp_path}/t").collect()
    assert sorted(tuple(r) for r in back) == _want([(r.doc_id, r.text) for r in table.collect()])


def test_selective_reads(spark, tmp_path):
    token_output.write_tokens(docs(spark, [(i, "a b") for i in range(50)]), f"file://{tmp_path}/t", FILE,
                              metadata=["source"])
    read = spark.read.parquet(f"file://{tmp_path}/t")
    plan = read.filter("doc_id = 7").select("n_tokens", "meta_source")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,7)" in plan and "tokens:array" not in plan.split("ReadSchema")[1]
    starts = token_output.starts(read.select("part", "pos", "doc_id", "n_tokens")).orderBy("doc_id").collect()
    assert [r.start for r in starts] == list(range(0, 150, 3))


def test_edges(spark, tmp_path):
    rows = [(None, "n"), (2, None), (1, ""), (3, " \t"), (4, "long " * 60_000), (5, "<|endoftext|> x")]
    token_output.write_tokens(docs(spark, rows, "part,pos,tokens,n_tokens"), f"file://{tmp_path}/t", FILE)
    got = [tuple(r) for r in token_output.read_back(spark, f"file://{tmp_path}/t").collect()]
    assert sorted(got, key=lambda r: r[1]) == _want(rows)
    twice = [(1, "a"), (1, "a"), (1, "b c")]
    token_output.write_tokens(docs(spark, twice), f"file://{tmp_path}/u", FILE)
    got = token_output.read_back(spark, f"file://{tmp_path}/u").collect()
    assert sorted(r.start for r in got)[0] == 0 and sum(r.n_tokens for r in got) == 7 and len({r.start for r in got}) == 3
    token_output.write_tokens(docs(spark, []), f"file://{tmp_path}/v", FILE)
    assert token_output.read_back(spark, f"file://{tmp_path}/v").collect() == []
