import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from boutline.llm.tokens import PieceCounter

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
COUNTER = PieceCounter(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aehtsinr \n\t▁éß漢😀　</>0x1", max_size=60))
def test_counts_equal_the_library(text):
    assert COUNTER.count([text]) == [len(MODEL.encode(text))]


def test_whole_documents(texts):
    rows = list(texts.values())
    assert COUNTER.count(rows) == [len(x) for x in MODEL.encode(rows)]


def test_long_unbroken_text():
    for text in ("a" * 30_000, "abcabd" * 5_000, " " * 5_000, "\n" * 5_000):
        assert COUNTER.count([text]) == [len(MODEL.encode(text))]
