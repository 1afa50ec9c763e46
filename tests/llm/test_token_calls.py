from __future__ import annotations

import random

import pytest
from tokenizers.pre_tokenizers import Whitespace

from rankloom.llm import tokens
from rankloom.llm.tokens import LINE, LINES, Encoder, vocabulary_path


class Recorder:
    """The library, with the number of words of its largest call."""

    def __init__(self, library):
        self.library, self.most = library, 0

    def encode_batch_fast(self, texts, **options):
        self.most = max(self.most, sum(len(t.split()) for t in texts))
        return self.library.encode_batch_fast(texts, **options)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_new_words_go_to_the_library_in_small_calls(name):
    encoder = Encoder(vocabulary_path(name))
    plain = encoder.library
    encoder.library = Recorder(plain)
    texts = [" ".join(f"w{i}x{j}" for j in range(500)) for i in range(40)]
    found = encoder.encode(texts)
    assert encoder.library.most <= (LINE + LINE) * LINES  # a mark may count as a word
    assert [f.tolist() for f in found] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


WORDS = ["foo", "Bar", "été", "ÀÉ", "ß", "µ", "'s", "don't", "!", "...", "%%%", "22", "中文", "é", "İ", "\n\n", "  ", "\t", "ª", "×"]
WORDS += ["<|endoftext|>", "\x1c", "\x85", " ", "_", "é.", "ſ", " ", " ", " ", " "]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(name):
    encoder, choose = Encoder(vocabulary_path(name)), random.Random(5)
    texts = ["".join(choose.choices(WORDS, k=choose.randint(0, 14))) for _ in range(3000)]
    found = encoder.encode(texts)
    assert [f.tolist() for f in found] == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_plain_words_do_not_pass_the_whole_library(name):
    encoder = Encoder(vocabulary_path(name))
    plain = encoder.library
    encoder.library = Recorder(plain)
    words = [f"{a}{b}{end}" for a in "Straße Äpfel plain".split() for b in "abcdef" for end in ("", ".", "%%%")]
    encoder._learn(words)
    assert encoder.library.most == 0
    assert all(encoder[w] == encoder._raw(plain.encode(encoder.lead + w, add_special_tokens=False).ids) for w in words)


def test_an_unknown_way_to_cut_goes_to_the_library():
    encoder = Encoder(vocabulary_path("byte_bpe_50k.json"))
    encoder.library.pre_tokenizer = Whitespace()
    assert encoder._letter_table() is None


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_digits_and_line_ends_do_not_pass_the_whole_library(name):
    encoder = Encoder(vocabulary_path(name))
    plain = encoder.library
    encoder.library = Recorder(plain)
    words = ["end.\nÉté", "end.\n\nNow", "v1.25x", "(see", "###", "007", "$1,000.00\n2\n\n3!", "[a]_b", "Zürich22%"]
    encoder._learn(words)
    assert encoder.library.most == 0
    assert all(encoder[w] == encoder._raw(plain.encode(encoder.lead + w, add_special_tokens=False).ids) for w in words)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_in_use_are_not_learned_again(name, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 200)
    encoder, asked = Encoder(vocabulary_path(name)), []
    keep = Encoder._of_pieces
    monkeypatch.setattr(Encoder, "_of_pieces", lambda self, word: asked.append(word) or keep(self, word))
    texts = [f"first often {' '.join(f'new{chr(97 + i)}{chr(97 + j)}' for j in range(26))}" for i in range(26)]
    for text in texts:  # a call each, so that words go many times
        assert encoder.encode([text])[0].tolist() == encoder.library.encode(text, add_special_tokens=False).ids
    assert asked.count("often") == 1
    assert len(encoder) + len(encoder.old) <= 200 + 2 * 30


ENDS = ["a", "Bé", "b2", "!", "'s", " ", "  ", "\n", "\n\n", "\n\n\n", "\t", "\x1c", "\u3000", "\u0301", "日", "٣", "²", "<|endoftext|>"]


@pytest.mark.parametrize("kept", [8, 800_000])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_white_space_and_kept_words_do_not_change_ids(name, kept, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", kept)
    encoder, choose = Encoder(vocabulary_path(name)), random.Random(7)
    texts = ["".join(choose.choices(ENDS, k=choose.randint(0, 9))) for _ in range(8000)]
    found = encoder.encode(texts)
    assert [f.tolist() for f in found] == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_an_unknown_way_to_cut_gives_the_same_ids(name):
    encoder, choose = Encoder(vocabulary_path(name)), random.Random(9)
    encoder.letters = None
    texts = ["".join(choose.choices(ENDS, k=choose.randint(0, 9))) for _ in range(2000)]
    found = encoder.encode(texts)
    assert [f.tolist() for f in found] == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]
