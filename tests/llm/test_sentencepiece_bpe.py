import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from shuffleframe.llm import sentencepiece_bpe as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(text):
    ids = S.model(PATH).encode(text)
    assert ids == LIBRARY.encode(text, num_threads=1), text
    assert S.model(PATH).decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", ["", " ", "  a", "a  ", "\n", "\t▁x", "你好 \U0001f600!", "<s> </s> <unk> <0x0A>", "aaaaaaaaaaaaaaaaaaaaaaaa", " " * 70 + "word" + " " * 33, "x\x00y", "a" * 3000, "the" * 2000, "ab" * 700 + "  " * 50 + "\n\n"])
def test_given_texts(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" \n▁abetnhio,.", max_size=80), st.lists(st.sampled_from(["the", " ", "  ", "ing", "é", "tion", "ss", "\n", "."]), max_size=30).map("".join)))
def test_random_texts(text):
    same(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=20))
def test_decode_any_ids(ids):
    assert S.model(PATH).decode(ids) == LIBRARY.decode(ids)


def test_frame(spark):
    rows = [(1, "Hello  world", "a"), (2, None, "b"), (3, "", None), (4, "x " * 40000, "d"), (1, "Hello  world", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = S.encode_documents(docs, PATH, decoded="decoded").collect()
    assert [(r.doc_id, list(r.ids), r.decoded) for r in sorted(got, key=lambda r: r.doc_id)] == [(i, LIBRARY.encode(t or ""), t or "") for i, t, _ in sorted(rows, key=lambda r: r[0])]
    assert S.encode_documents(docs.limit(0), PATH, digests=True).collect() == []
