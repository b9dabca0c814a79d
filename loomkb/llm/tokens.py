"""Tokenizing whole texts with public tokenizer files.

The tokenizers split a text into words before they merge bytes, so a text's ids
are those of its space-separated pieces one after another. Pieces repeat, so
each Python worker remembers the ids of pieces from task to task, within
``PIECE_BYTES``, and asks the library for the rest only: the first ones it meets,
then those it meets twice. A text is cut only at a space that a non-space
follows; there, both kinds of tokenizer begin a new word.

For pieces of plain Latin characters the words are found here, by the
tokenizer's own pattern, and only their merges are asked of its model; all
other pieces go through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

CUT = re.compile(r" (?=\S)")
ODD_SPACE = re.compile(r" (?:\s|\Z)")
#: Characters that every Unicode version classes, folds and composes alike.
PLAIN = re.compile(r"[\t\n\x21-\x7e\xa1-\xac\xae-įı-ſ]+")
#: Memory of a Python worker for the ids of pieces and of words, and the bytes that an entry takes besides its key.
PIECE_BYTES, WORD_BYTES, ENTRY_BYTES = 96 << 20, 16 << 20, 180
#: Share of it for whatever comes first; bytes of key and ids beyond which a piece is encoded each time; hashes of pieces met once.
FIRST, LONGEST, ONCE = 0.75, 128, 100_000


#: Letters of PLAIN in all their mixtures: what a pattern that keeps them together finds as one word.
LETTERS = (" abc", " Abc", " ABC", " aBcDe", " \xe9\xc0\xfc\xdf", " a\xe9Z\xaa\xba\xb5", " \u0141\xf3d\u017a", "abc", "ABc", "\xc9a")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def word_rule(spec: dict) -> tuple[str, bool] | None:
    """(pattern of words, whether to lower-case) of a tokenizer file; None if it works otherwise."""
    import public_tokenizers

    before, split = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
    if before is None and split == byte_level | {"use_regex": True}:
        return public_tokenizers.PATTERN, False
    steps = split.get("pretokenizers") or []
    folds = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    if (before or {}).get("normalizers") == folds and len(steps) == 2 and steps[1] == byte_level | {"use_regex": False}:
        if steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"]:
            return steps[0]["pattern"]["Regex"], True
    return None


class Remembered(dict):
    """Ids by key, made by ``make`` when asked for; kept are the first ones, then those asked for twice, up to ``most`` bytes."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most, self.held = make, most, 0
        self.once: set[int] = set()
        self.before: set[int] = set()

    def __missing__(self, key: str) -> bytes:
        ids = self.make(key)
        size = len(key) + len(ids)
        if size > LONGEST or self.held >= self.most:
            return ids
        if self.held >= self.most * FIRST:
            h = hash(key)
            if h not in self.once and h not in self.before:
                self.once.add(h)
                if len(self.once) >= ONCE:
                    self.before, self.once = self.once, set()
                return ids
        self[key] = ids
        self.held += ENTRY_BYTES + size
        return ids


class Encoder:
    """Ids of texts as little-endian unsigned 16- or 32-bit integers."""

    def __init__(self, name: str, path: str | None = None, piece_bytes: int = PIECE_BYTES, word_bytes: int = WORD_BYTES, plain_specials: bool = False):
        """``plain_specials``: the strings of special tokens in a text are ordinary text; else they become those tokens."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        #: Strings that the tokenizer takes out of a text before all else; a text that holds one goes through it whole.
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if not (plain_specials and t.special)]
        self.added = [t.content for t in added]
        self.never_cut = any(t.normalized for t in added)  # these show after normalisation only
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        with open(path, encoding="utf-8") as f:
            rule = word_rule(json.load(f))
        self.words = regex.compile(rule[0]).findall if rule else None
        self.lower = bool(rule and rule[1])
        self.merge, self.letters = self.tokenizer.model.tokenize, byte_letters()
        self.space = self.letters[32]
        #: Whether letters are never cut from each other before merging.
        self.whole = bool(rule) and all(len(self.words(t.lower() if self.lower else t)) == 1 for t in LETTERS)
        #: Ids of pieces with a space before them, of those that begin a text, and of words in them.
        self.known = Remembered(lambda p: self.ids_of_piece(p, " "), piece_bytes)
        self.firsts = Remembered(lambda p: self.ids_of_piece(p, ""), word_bytes)
        self.known_words = Remembered(self.ids_of_word, word_bytes)

    def ids_of_text(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids_of_word(self, word: str) -> bytes:
        """Ids of one word: its bytes as letters, merged by the model."""
        if word.isascii() and word.lstrip(" ").isalpha():
            letters = word.replace(" ", self.space)
        else:
            letters = word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.merge(letters)]).tobytes()

    def ids_of_piece(self, piece: str, space: str) -> bytes:
        """Ids of a piece of a text, after ``space``."""
        if not (self.words and PLAIN.fullmatch(piece)):
            return self.ids_of_text(space + piece)
        text = piece.lower() if self.lower else space + piece
        if self.whole and piece.isalpha():  # one word, which is the piece
            return self.ids_of_word(text)
        known = self.known_words
        return b"".join([known[w] for w in self.words(text)])

    def __call__(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text, as bytes of ``dtype``; null texts are empty."""
        ids = self.known.__getitem__
        for text in texts:
            if not text:
                yield b""
                continue
            if self.never_cut or any(a in text for a in self.added):
                yield self.ids_of_text(text)
                continue
            pieces = iter(CUT.split(text) if ODD_SPACE.search(text) else text.split(" "))
            yield self.firsts[next(pieces)] + b"".join(map(ids, pieces))


def byte_tokens(encoder: Encoder) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    codes = {letter: b for b, letter in byte_letters().items()}
    tokens = map(encoder.tokenizer.id_to_token, range(encoder.tokenizer.get_vocab_size()))
    return [bytes(codes[c] for c in t) if t is not None and all(c in codes for c in t) else (t or "").encode() for t in tokens]


_encoders: dict[tuple, Encoder] = {}


def encoder(name: str, path: str | None = None, *memory_and_specials: object) -> Encoder:
    """The worker's encoder for a tokenizer file: later tasks find what earlier ones remember."""
    key = (name, path, *memory_and_specials)
    if key not in _encoders:
        _encoders.clear()  # memory for one at a time
        _encoders[key] = Encoder(*key)
    return _encoders[key]
