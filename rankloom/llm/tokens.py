"""Encoding whole texts with a ready-made tokenizer file.

Words repeat, so a worker keeps the ids of the words it has seen and asks the
library only for new ones. A text is cut at single spaces between two other
characters; both kinds of supported vocabulary never join tokens across such a
place, so the ids equal those of one call over the whole text (tested).

Most new words are Latin letters, then ASCII marks, and nearly all others add digits
and line ends. For known ways to cut (``_CUTS``) it is known which pieces these make, so
the library's model is asked for the ids of each piece at once; its normaliser and its
pre-tokeniser say what each character becomes. All other words pass through the whole
library, many in one call.

Words are looked up once, when their ids are put together: a new word of known pieces is
learned on the way, a text with other new words is put together again when these are learned.
"""

from __future__ import annotations

import json
import re
import string
from array import array
from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np

_SPACE = re.compile(r"\s")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Words a worker keeps, in two halves: when the newer one is full, the older one, with what was not used since, goes.
#: Bounds its memory to about 200 MB.
KEPT_WORDS = 800_000
#: Texts whose words are held at once.
TEXTS = 128
#: Words and lines that go to the library in one call. What it returns takes some hundred bytes a token.
LINE, LINES = 64, 16
#: Latin letters that no normaliser joins with their neighbours, and marks that stand after them in one piece.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # no apostrophe: some vocabularies cut before the letters behind it
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False}
#: Words of letters, digits and marks, or several of them with one or two line ends between (of more, the first make a piece).
_KNOWN = f"[A-Za-zÀ-ÖØ-öø-ÿ0-9{re.escape(MARKS)}]+"
_PLAIN = re.compile(f"{_KNOWN}(?:\n\n?{_KNOWN})*")
_RUNS = f"[A-Za-zÀ-ÖØ-öø-ÿ]+|[{re.escape(MARKS)}]+|\n"
#: How a vocabulary cuts texts, before that the parts of its normaliser, and the pieces that come of it: runs of letters,
#: runs of marks, line ends, and runs of digits or each digit alone.
_CUTS = [
    ([_BYTE_LEVEL | {"use_regex": True}], [], re.compile(f"{_RUNS}|[0-9]+")),
    (
        [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            _BYTE_LEVEL | {"use_regex": False},
        ],
        [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
        re.compile(f"{_RUNS}|[0-9]"),
    ),
]
_encoders: dict[str, Encoder] = {}


def _parts(step: dict | None, name: str) -> list[dict]:
    return [] if step is None else step[name] if step["type"] == "Sequence" else [step]


def _holds(steps: list[dict], known: list[dict]) -> bool:
    """Whether the steps are the known ones; what else they say, as on offsets, does not matter."""
    return len(steps) == len(known) and all(k.items() <= s.items() for s, k in zip(steps, known))


class Encoder(dict):
    """Ids of words as bytes of ``dtype``, by word."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        resize = getattr(self.library.model, "_resize_cache", None)
        if resize:  # the words are kept here; the library's own cache only costs time then
            resize(0)
        self.vocabulary = self.library.get_vocab_size()
        self.dtype = np.dtype("u2" if self.vocabulary <= 1 << 16 else "u4")
        # A vocabulary with byte-level spaces writes the space before a word into its token.
        keeps_space = len(self._ids(" a")) != len(self._ids("a")) or self._ids(" a") != self._ids("a")
        self.lead = " " if keeps_space else ""
        self.mark = "\n" if keeps_space else " \0 "
        marks = self._ids(self.mark)
        self.mark_id = marks[0] if len(marks) == 1 else None
        self.tokenize = self.library.model.tokenize
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.old: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.waiting: set[str] = set()
        self.missed = self.ragged = False
        self.cuts: re.Pattern | None = None
        self.letters = self._letter_table()
        if self.letters is not None:
            self.space = self.lead.translate(self.letters)
            ascii = string.ascii_letters
            self.fold = {ascii: str, ascii.lower(): str.lower}.get(ascii.translate(self.letters))

    def _letter_table(self) -> dict[int, str] | None:
        """What characters become before the model sees them; None for vocabularies that cut in unknown ways."""
        whole = json.loads(self.library.to_str())
        known = [_parts(whole["pre_tokenizer"], "pretokenizers"), _parts(whole["normalizer"], "normalizers")]
        self.cuts = next((p for cuts, norms, p in _CUTS if _holds(known[0], cuts) and _holds(known[1], norms)), None)
        if self.cuts is None or any(not t["special"] for t in whole["added_tokens"]):
            return None
        table = {}
        for char in [*MARKS, *string.digits, "\n", *"".join(_LETTERS.findall(" ".join(map(chr, range(256)))))]:
            normal = self.library.normalizer.normalize_str(char) if self.library.normalizer else char
            table[ord(char)] = "".join(piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal))
        if self.lead:
            table[32] = self.library.pre_tokenizer.pre_tokenize_str(" a")[0][0][:-1]
        return table

    def __missing__(self, word: str) -> bytes:
        """The ids of a word that was not used lately; empty, and a note, if they can't be had now."""
        raw = self.old.pop(word, None) or self._of_pieces(word)
        if raw is None:
            if self.lead and (not word or word[0].isspace() or word[-1].isspace()):
                self.ragged = True
            else:
                self.missed = True
                self.waiting.add(word)
            return b""
        self[word] = raw
        return raw

    def _of_pieces(self, word: str) -> bytes | None:
        """The ids of a word of letters, digits, marks and line ends; None for others."""
        table = self.letters
        if table is None:
            return None
        head = word.rstrip(MARKS)
        if head.isascii() and head.isalpha() and self.fold:
            piece = self.space + self.fold(head)
        elif _LETTERS.fullmatch(head):
            piece = self.space + head.translate(table)
        elif _PLAIN.fullmatch(word):
            first, *others = self.cuts.findall(word)
            return self._asked(self.space + first.translate(table)) + b"".join(map(self._piece, others))
        else:
            return None
        if head == word:
            return self._asked(piece)
        raw = self.get(head) or self._asked(piece)
        tail = word[len(head) :]
        return raw + (self.pieces.get(tail) or self._piece(tail))

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece without a space before it."""
        raw = self.pieces.get(piece)
        if raw is None:
            if len(self.pieces) > KEPT_WORDS // 8:
                self.pieces.clear()
            raw = self.pieces[piece] = self._asked(piece.translate(self.letters))
        return raw

    def _asked(self, piece: str) -> bytes:
        return array(self.code, [t.id for t in self.tokenize(piece)]).tobytes()

    def _ids(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _raw(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _encoded(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of each text, from calls of bounded size."""
        for some in batched(texts, LINES):
            for found in self.library.encode_batch_fast(list(some), add_special_tokens=False):
                yield found.ids

    def _learn(self, words: list[str]) -> None:
        found = {w: self._of_pieces(w) for w in words}
        self.update((w, raw) for w, raw in found.items() if raw is not None)
        words = [w for w, raw in found.items() if raw is None]
        plain = [w for w in words if self.mark_id is not None and w and not _SPACE.search(w) and "\0" not in w]
        lines = [plain[i : i + LINE] for i in range(0, len(plain), LINE)]
        for line, found in zip(lines, self._encoded(self.mark.join(self.lead + w for w in x) + self.mark for x in lines)):
            ids = np.array(found, dtype=self.dtype)
            ends = np.flatnonzero(ids == self.mark_id).tolist()
            if len(ends) != len(line):  # a word of its own tokenises to the mark
                continue
            raw, width, start = ids.tobytes(), self.dtype.itemsize, 0
            for word, end in zip(line, ends):
                self[word] = raw[width * start : width * end]
                start = end + 1
        rest = [w for w in words if w not in self]
        for word, found in zip(rest, self._encoded(self.lead + w for w in rest)):
            self[word] = self._raw(found)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text, without special tokens."""
        return [ids for some in batched(texts, TEXTS) for ids in self._encode(some)]

    def _encode(self, texts: tuple[str, ...]) -> list[np.ndarray]:
        if len(self) > KEPT_WORDS // 2:
            self.old = dict(self)
            self.clear()
        out, again = [], []
        for k, text in enumerate(texts):
            self.missed = False
            out.append(self._whole(text))
            if self.missed:
                again.append(k)
        if again:
            self._learn(list(self.waiting))
            self.waiting.clear()
            for k in again:
                out[k] = self._whole(texts[k])
        return [np.frombuffer(raw, dtype=self.dtype) for raw in out]

    def _whole(self, text: str) -> bytes:
        """The ids of a text, if no word of it is missed."""
        words = text.split(" ")
        if not self.lead:
            return b"".join(map(self.__getitem__, words))
        self.ragged = len(words) > 1 and words[0][-1:].strip() == ""
        if not self.ragged:
            raw = self._spaced(words)
        if self.ragged:  # a space that is next to another one is no place to cut
            raw = self._spaced(_CUT.split(text))
        return raw

    def _spaced(self, words: list[str]) -> bytes:
        """The ids of words with a space between; those at the ends of a text may have white space there."""
        first, last = self._raw(self._ids(words[0])), b""
        if len(words) > 1 and words[-1][-1:].isspace() and not words[-1][0].isspace():
            last = self._raw(self._ids(self.lead + words.pop()))
        return first + b"".join(map(self.__getitem__, words[1:])) + last


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary_path(name: str) -> str:
    """Where an installed public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
