"""Ids of the chunk encoder equal those of the tokenizer over the whole text."""

import random

import pyarrow as pa
import pytest

from attesta.llm.common import ChunkEncoder
from attesta.llm.queries import _tokenizer

ODD = ["a  b", " a", "a ", "a\n b", "\t x \t", "<|endoftext|> a <|endoftext|>b", "x \x01 y", "\x01", "", None, " ", "  ", "é  à \xa0b", "it's 12,345 \n\n ok",
       "İ I ẞ ́x", "a \x1c b", "don't <|startoftext|> y", "Hi all.\nNext line, ok\nx", "foo,\tbar x", "w \nq", "n.\xa0\nm o", "日本 語 текст один", "x" * 5000]


@pytest.mark.parametrize(("name", "byte_level"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@pytest.mark.parametrize("keep", [1_000_000, 3])
def test_chunks_equal_whole_texts(name, byte_level, keep):
    e = ChunkEncoder(_tokenizer(name), byte_level, keep)
    texts = ODD + [f"{a or ''} {b or ''}" for a in ODD for b in ODD]
    whole = [x.ids for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in e.encode(texts)] == whole
    assert [x.tolist() for x in e.encode(texts[::-1])] == whole[::-1]


@pytest.mark.parametrize(("name", "byte_level"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_a_word_is_encoded_once_before_all_marks(name, byte_level):
    """What the library encodes, and so most of the time, is the word and not each of its endings."""
    e = ChunkEncoder(_tokenizer(name), byte_level)
    e.encode(["so Wortstamm, Wortstamm. Wortstamm!!\nUnd Wortstamm%%% Wortstamm.\nDann"])
    assert [c.strip() for c in e.cache if "Wort" in c] == ["Wortstamm"]


#: What may stand beside a cut: letters of one and two bytes and others, combining marks, marks, added tokens, white space of all kinds.
BESIDE = ["a", "Wort", "é", "É", "ß", "İ", "œ", "Σ", "e\u0301", "\u0338", "=", "<", ">", "|", "<|endoftext|>", "<|startoftext|>", ".", ",", "'", "'s", "'re", "!!", "%%%", "\n", "\n\n", " ", "  ",
          "\t", "\xa0", "\r\n", "7", "12,3", "日本", "\x01", "\x85", "\u2028", "×", "÷", "À", "ÿ", "-", "_", "I'm", "“", "…", "\x1c", "ǅ", "ﬁ", "\u212a"]


@pytest.mark.parametrize(("name", "byte_level"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@pytest.mark.parametrize(("keep", "size"), [(1_000_000, 2 << 20), (3, 100)])
def test_cuts_inside_chunks(name, byte_level, keep, size):
    rng = random.Random(5)
    texts = ["".join(rng.choices(BESIDE, k=rng.randint(0, 14))) for _ in range(4000)] + [None, ""]
    e = ChunkEncoder(_tokenizer(name), byte_level, keep)
    e._SLICE = size
    whole = [x.ids for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in e.encode(texts)] == whole
    for kind in (pa.string(), pa.large_string()):  # columns as Spark hands them over, also a part of one
        assert [x.tolist() for x in e.encode(pa.array(texts, kind).slice(7, 500))] == whole[7:507]
    assert e.encode(pa.array([], pa.string())) == []
    assert [x.tolist() for x in e.encode([None, ""])] == [[], []]
