import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from turfspark.llm import sentencepiece_fst as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
FST = S.Transducer(PATH)
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a" + " " * 37 + "b", "x\ny\n\n z", "▁a ▁", "日本語 été œuvre", "😀 b😀", "\t\r", "aaaaaaaaaaaaaaa", "12345 6.7", "don't (a),"]


def check(text):
    assert FST([text])[0].tolist() == LIB.encode(text), repr(text)
    assert FST.decode(LIB.encode(text)) == LIB.decode(LIB.encode(text))


def test_odd_texts_equal_library():
    for t in ODD:
        check(t)
    assert FST([None])[0].tolist() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abenorst  \n.,'é日▁😀1"), max_size=40))
def test_equals_library(text):
    check(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=20))
def test_equals_library_on_any_characters(text):
    if "\x00" not in text:
        check(text)


def test_pairs_stay_apart_as_merging_leaves_them():
    number = {lib_piece(i): i for i in range(LIB.vocab_size()) if not (LIB.is_byte(i) or LIB.is_control(i) or LIB.is_unknown(i))}
    rank = {x: -LIB.get_score(i) for x, i in number.items()}

    def merged(parts):
        while True:
            found = [(rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]
            if not found:
                return parts
            k = min(found)[1]
            parts = [*parts[:k], parts[k] + parts[k + 1], *parts[k + 2 :]]

    rng = np.random.default_rng(1)
    pieces = [x for x in number if x.isascii() or rng.random() < 0.1]
    formed = [x for x in pieces if merged(list(x)) == [x]]
    pairs = [(formed[i], formed[j]) for i, j in rng.integers(0, len(formed), (4000, 2))] + [(x, x) for x in formed[:500]]
    want = [merged(list(a + b)) == [a, b] for a, b in pairs]
    left, right = (np.array([number[p[k]] for p in pairs]) for k in (0, 1))
    for _ in range(2):  # worked out, then remembered
        assert FST.stable(left, right).tolist() == want
    FST.long_path(np.frombuffer(b" a", np.uint8))
    assert [FST._apart_one(number[a], number[b]) for a, b in pairs[:300]] == want[:300]


def lib_piece(i):
    return LIB.id_to_piece(i)


def test_long_segments_windows_and_blocks(monkeypatch):
    rnd = random.Random(4)
    runs = ["a" * 5000, "".join(rnd.choice("abcdefXYZ0189") for _ in range(3000)), "日本語é" * 200, "-" * 999, " " * 700, "ab c" * 300]
    for x in runs:
        check(x)
    monkeypatch.setattr(S, "BLOCK", 50)
    monkeypatch.setattr(S, "BATCH", 20)
    monkeypatch.setattr(S, "WINDOW", 7)
    monkeypatch.setattr(S, "LONG", 9)
    for x in [*runs, *ODD]:
        check(x)
    got = FST([*ODD, *runs, None])
    assert [g.tolist() for g in got] == [LIB.encode(t) for t in [*ODD, *runs, ""]]


def test_unigram_takes_the_shortest_path(tmp_path):
    """The same pieces with scores of their own, as a unigram model of the library's."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model, rng = proto.ModelProto(), np.random.default_rng(3)
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        if p.type == p.NORMAL:
            p.score = -float(rng.integers(2000, 3000)) / 256 - len(p.piece) / 8
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    lib, fst = sentencepiece.SentencePieceProcessor(model_file=path), S.Transducer(path)
    for t in [*ODD, "in there, somewhere over", "x" * 600]:
        got, want = fst([t])[0].tolist(), lib.encode(t)
        cost = lambda ids: round(-sum(lib.get_score(i) for i in ids if not lib.is_byte(i)), 2)
        assert fst.decode(got) == lib.decode(want) and cost(got) == cost(want), t


def test_models_that_cannot_be_compiled(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    def changed(change):
        model = proto.ModelProto()
        with open(PATH, "rb") as f:
            model.ParseFromString(f.read())
        change(model)
        path = str(tmp_path / "changed.model")
        with open(path, "wb") as f:
            f.write(model.SerializeToString())
        with pytest.raises(ValueError):
            S.Transducer(path)

    changed(lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True))
    changed(lambda m: setattr(m.normalizer_spec, "precompiled_charsmap", b"x"))
    changed(lambda m: setattr(m.pieces[400], "type", m.pieces[400].USER_DEFINED))
    changed(lambda m: setattr(next(p for p in m.pieces if p.piece == "e"), "piece", "\U0010ffff"))
    changed(lambda m: setattr(next(p for p in m.pieces if p.piece == "<0x41>"), "type", m.pieces[0].CONTROL))


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.union(spark.createDataFrame([(None, t, "ids") for t in [*ODD, None]], docs.schema))
    want = sorted(((r.doc_id or -1), len(i := LIB.encode(r.text or "")), zlib.crc32(np.array(i, "<u4").tobytes()), S.SPACE not in (r.text or "")) for r in docs.collect())
    assert sorted(((r[0] or -1), *r[1:]) for r in S.round_trip(docs, PATH).collect()) == want
    back = S.decode(S.encode(docs, PATH).withColumnRenamed("text", "was"), PATH)
    assert back.columns == ["doc_id", "was", "source", "ids", "text"]
    assert back.filter("coalesce(translate(was, '▁', ' '), '') <> text").count() == 0 and back.count() == docs.count()
    assert S.round_trip(docs.limit(0), PATH).count() == 0
    assert S.encode(docs.limit(0), PATH).count() == S.decode(docs.limit(0).selectExpr("array(1) ids"), PATH).count() == 0


def test_very_long_and_repeated_texts_and_clashing_names(spark):
    text = "Some wörds, again and again: 日本 x1\n" * 80_000  # over one slice
    rows = [(1, text, 7), (1, text, 7), (2, "a" * 20_000, 8), (None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS int")
    out = S.encode(docs, PATH)
    assert out.columns == ["doc_id", "text", "ids"]
    got = sorted((r.doc_id or 0, list(r.ids)) for r in out.collect())
    assert got == sorted((i or 0, LIB.encode(t or "")) for i, t, _ in rows)
    assert [r.decodes for r in S.round_trip(docs.withColumnRenamed("IDS", "id"), PATH).collect()] == [True] * 4
