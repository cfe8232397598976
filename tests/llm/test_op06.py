"""Operator 6: the short ways of encoding and writing give what the long ones give."""

import numpy as np
import public_tokenizers as vocab
from tokenizers import Tokenizer

from matchloom.llm import op06_binary, tokens


def test_plain_words_and_their_ends_go_the_short_way(monkeypatch):
    path = vocab.path("byte_bpe_50k.json")
    encoder, library = tokens.load(path), Tokenizer.from_file(path)
    asked, part = [], tokens.ByteLevel._part
    monkeypatch.setattr(tokens.ByteLevel, "_part", lambda self, text: asked.append(text) or part(self, text))
    encoder.parts.clear()
    for text in ("a zygomorphic, quixotry. flummery)!", "a b2 née -- x\ny  z", "a ", " a", "a ,. b"):
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert not {" zygomorphic,", " zygomorphic", " quixotry.", " flummery)!"} & set(asked)


def test_columns_of_ids_are_cut_within_their_bytes():
    assert op06_binary._within(np.array([3, 4, 9, 1, 1]), 7) == [(0, 2), (2, 3), (3, 5)]
    assert op06_binary._within(np.array([], np.int64), 7) == []


def test_values_of_all_widths_come_back():
    for most in (200, 60_000, 1 << 20, 1 << 31):
        values = np.array([0, 1, most, 255, 256], np.uint32)
        assert (op06_binary.decode_values(*op06_binary.encode_values(values), 5) == values).all()
    assert op06_binary.encode_values(np.zeros(0, np.uint32)) == (b"", b"")
