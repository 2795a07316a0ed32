import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from turfspark.llm import tokenbin as T
from turfspark.llm._store import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)
ODD = ["", " ", "  a", "a  b   c", "it's  we'll\n\n x \t y", "é  ö", "日本 語 ", "<|endoftext|> a<|endoftext|>b", " a\n b", "12 3.4, x!?", "a \n"]


def test_encoder_equals_library_on_odd_texts():
    e = T.Encoder(PATH)
    assert e.cuts
    for got, t in zip(e(ODD), ODD, strict=True):
        assert got.tolist() == TOK.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sZ \n\t.,é日 　1<|>"), max_size=40), max_size=5))
def test_encoder_equals_library(texts):
    for got, t in zip(T.Encoder(PATH)(texts), texts, strict=True):
        assert got.tolist() == TOK.encode(t, add_special_tokens=False).ids


#: Texts that end in white space, before texts that begin with anything.
ENDS = ["\n\n", "1", "a \n\n", "b", "  ", "c\t\t", " d", "e\u3000\u3000", "é", "\r\n\r\n", "'s", "f\n \n", "", "g  ", "!", " \n"]


def test_white_space_at_text_ends():
    e = T.Encoder(PATH)
    for got, t in zip(e(["\n\n", "1"]), ["\n\n", "1"], strict=True):
        assert got.tolist() == TOK.encode(t, add_special_tokens=False).ids
    for texts in (ENDS, ENDS[::-1], [x for pair in zip(ENDS, ENDS[5:] + ENDS[:5], strict=True) for x in pair]):
        for got, t in zip(e(texts), texts, strict=True):
            assert got.tolist() == TOK.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab's1 \n\t\r.é\u3000"), max_size=8), max_size=8))
def test_texts_encode_alike_together_and_singly(texts):
    for got, t in zip(ENCODER(texts), texts, strict=True):
        assert got.tolist() == ENCODER([t])[0].tolist() == TOK.encode(t, add_special_tokens=False).ids


def test_text_ends_over_slices_and_partitions(spark):
    texts = [("w" * (i % 7) + e) * (1 + i % 3) for i in range(40) for e in ENDS]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for part_bytes in (300, 1 << 20):
        got = {r.doc_id: r for r in T.read(T.write(docs, scratch_path(spark, "tokens"), PATH, part_bytes=part_bytes)).collect()}
        start = 0
        for i, t in enumerate(texts):
            ids = np.array([*TOK.encode(t, add_special_tokens=False).ids, 2], "<u4")
            assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)


def test_files_and_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    extra = spark.createDataFrame([(10_000_000, t, "s") for t in ODD] + [(None, None, "t"), (-5, None, "t")], docs.schema)
    docs = docs.union(extra)
    to = scratch_path(spark, "tokens")
    manifest = T.write(docs, to, PATH, part_bytes=60_000)
    got = sorted(T.read(manifest).collect(), key=lambda r: r.start)
    rows = sorted(docs.selectExpr("*", "xxhash64(text) tie").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie))
    start = 0
    for r, w in zip(got, rows, strict=True):
        ids = np.array([*TOK.encode(w.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (w.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    first = manifest.orderBy("part").first().asDict()
    assert first["dtype"] == "<u2" and T.document_ids(first, 1).tolist()[-1] == 2
    assert T.read(T.write(docs.limit(0), to, PATH)).count() == 0


def test_generations_and_blocks(monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 64)
    e = T.Encoder(PATH, known=20)
    texts = [*ODD, "one two three, four's (five) 6th 7.8\n\n  nine\r\nten　 eleven\xa0\xa0twelve  x"] * 3
    for _ in range(2):
        for got, t in zip(e(texts), texts, strict=True):
            assert got.tolist() == TOK.encode(t, add_special_tokens=False).ids, t
    assert e.old.n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_encoder_equals_library_on_any_characters(texts):
    for got, t in zip(ENCODER(texts), texts, strict=True):
        assert got.tolist() == TOK.encode(t, add_special_tokens=False).ids


ENCODER = T.Encoder(PATH)


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, e = Tokenizer.from_file(path), T.Encoder(path)
    assert not e.cuts
    for got, t in zip(e(["Two words.", "", None]), ["Two words.", "", ""], strict=True):
        assert got.tolist() == tok.encode(t, add_special_tokens=False).ids


def test_long_and_repeated_texts_and_clashing_names(spark):
    text = "Some wörds, again and again: 日本 x1\n" * 80_000  # over one slice
    rows = [(2, text, 1, 2, 3), (1, text, 1, 2, 3), (1, text, 1, 2, 3), (3, "x" * 30_000, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, start int, part int")
    got = sorted(map(tuple, T.round_trip(spark, docs, scratch_path(spark, "tokens"), PATH).collect()), key=lambda r: r[1])
    start = 0
    for r, (i, t) in zip(got, sorted((x[0], x[1]) for x in rows), strict=True):
        ids = np.array([*TOK.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert r == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_partitions_follow_the_bytes(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "repeat('some words ', 100) text")
    parts = lambda n: T.byte_parts(docs, "text", n, 1 << 30)
    assert parts(1 << 30) == 1 and parts(1_100_000) == 4 and parts(110_000) == 40


def test_pieces_that_share_a_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(T, "SpanHasher", lambda data: lambda a, b: (b - a).astype(np.uint64) << np.uint64(40))
    text = "one two six ten one four five"
    assert T.Encoder(PATH)([text])[0].tolist() == TOK.encode(text, add_special_tokens=False).ids
