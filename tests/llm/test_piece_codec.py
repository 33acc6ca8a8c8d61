import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pitlake.llm import piece_codec, queries

MODEL = queries.tokenizer_path("piece_bpe_32k.model")
CODEC = piece_codec.PieceCodec(MODEL, cached=64)
ODD = [None, "", " ", "  two  spaces ", "▁a ▁▁b", "<s> </s> <0x0A> <unk>", "a\x00b\r\n\tc", "é ① ﬁ 日本語 \U0001f600", "x" * 3000, "ab12" * 500, "\n\n", "don't 'S ###***", "a" * 70 + "日" * 70]


def own(text, codec=CODEC):
    return np.frombuffer(codec.encode(text), "<i4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab thein▁\n\t12'."), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_and_text_equal_the_library(text):
    ids = own(text)
    assert ids == CODEC.library.encode(text) and CODEC.unlike_the_library() == []
    assert CODEC.decode(ids) == CODEC.decode(ids, CODEC.regular(np.array(ids, int))) == CODEC.library.decode(ids)


def test_any_ids_decode_as_in_the_library():
    """Bytes that fit nowhere, ends and unknown ids in the middle, prefixes after them."""
    rng = random.Random(4)
    pool = [0, 1, 2, *range(3, 259), 259, 260, 28705, 300, 229, 148, 163]
    for _ in range(5000):
        ids = [rng.choice(pool) if rng.random() < .8 else rng.randrange(32000) for _ in range(rng.randint(0, 8))]
        assert CODEC.decode(ids) == CODEC.decode(ids, CODEC.regular(np.array(ids, int))) == CODEC.library.decode(ids), ids


def test_a_vocabulary_that_joins_over_words_is_one_agenda():
    whole = piece_codec.PieceCodec(MODEL)
    whole.words_are_apart = False
    for text in filter(None, ODD):
        assert own(text, whole) == own(text)


def test_islands_only_spare_work():
    for text in filter(None, ODD):
        whole = CODEC.merged(text)
        assert [p for island in CODEC.islands(text) for p in CODEC.merged(island)] == whole == CODEC.merged_short(text)


def test_recent_words_are_kept():
    made = []
    words = piece_codec.Recent(4, lambda w: made.append(w) or w.encode())
    for w in "abacadaeafa":
        assert words[w] == w.encode()
    assert made.count("a") == 1 and made == list("abcdef")
    assert words["b"] == b"b" and made[-1] == "b"


def test_query_equals_the_library(spark):
    rng = random.Random(7)
    docs = [(i, t, i) for i, t in enumerate(ODD)] + [(None, "no id", 0), (3, "again", 0), (3, "again", 0)]
    docs += [(100 + i, " ".join(rng.choice(["the", "Reshon,", "ther.\nThe", "Éoi", "x1y2", "und"]) for _ in range(rng.choice([1, 20, 3000]))), 1) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, ids long").repartition(4)
    coded = piece_codec.encode(df, MODEL)
    assert sorted(map(str, coded.collect())) == sorted(map(str, piece_codec.encode(df, MODEL, check="documents").collect()))
    got = sorted(tuple(map(str, r)) for r in piece_codec.digests(piece_codec.decode(coded, MODEL)).collect())

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = []
    for doc_id, text, _ in docs:
        ids = CODEC.library.encode(text or "", add_eos=True)
        want.append((str(doc_id), str(len(ids)), sha(" ".join(map(str, ids))), sha(CODEC.library.decode(ids))))
    assert got == sorted(want)
    assert piece_codec.decode(piece_codec.encode(df.limit(0), MODEL), MODEL).count() == 0
    assert {tuple(r.ids) for r in piece_codec.encode(df.where("text = ''"), MODEL, end=False).collect()} == {()}


def test_malformed_text_and_null_ids(spark):
    broken = spark.sql("select 1L as doc_id, cast(X'61C3' as string) as text")
    assert [r.text for r in piece_codec.decode(piece_codec.encode(broken, MODEL), MODEL).collect()] == ["a�"]
    assert [r.text for r in piece_codec.decode(spark.sql("select 1L as doc_id, cast(null as array<int>) as ids"), MODEL).collect()] == [""]


def test_differences_are_named():
    assert piece_codec.differing([7, 8], [[1], [2]], [[1], [3]]) == [8]
    wrong = piece_codec.PieceCodec(MODEL)
    del wrong.scores["▁the"]
    wrong.encode("the und ")
    assert wrong.unlike_the_library() == ["▁the"] and wrong.unlike_the_library() == []


def test_other_vocabularies_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    other = tmp_path / "unigram.model"
    other.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="merge-type"):
        piece_codec.PieceCodec(str(other))
