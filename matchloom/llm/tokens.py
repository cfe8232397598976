"""Fast exact use of tokenizer files: whole texts in, what the library would give out.

For byte-level BPE files the ids of a text are those of its parts between safe boundaries (a
non-space character followed by a space), one after the other; parts recur, so their ids are kept in
a bounded table and the library's model only sees new ones. Any other file, and any text that holds
an added token's string, goes through the library whole.
"""

from __future__ import annotations

import array
import hashlib
import json
import re

#: Parts whose ids a worker keeps (about 200 bytes each): the first ones seen, which are the frequent ones.
KEPT_PARTS = 450_000

_SPLIT = re.compile(r"(?<=\S)(?=[ \n\t\r])")
#: Signs that end a word and, however many, are one pre-token of byte-level patterns.
_TAIL = ".,;:!?#$%&*|)]}\"/"
_LOADED: dict = {}


class _Unsafe(Exception):
    """A part that ends in white space: the next boundary isn't safe."""


def version(path: str) -> str:
    """Digest of a tokenizer file, with the library that reads it."""
    with open(path, "rb") as f:
        return ("sentencepiece:" if path.endswith(".model") else "tokenizers:") + hashlib.sha256(f.read()).hexdigest()


def _byte_letters() -> list[str]:
    """The printable letter that byte-level models write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


class _Table(dict):
    """Values of parts, by the text after their leading space; made by `make` where missing."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if key == "" or key[-1].isspace():
            raise _Unsafe
        value = self.make(key)
        if len(self) < KEPT_PARTS:
            self[key] = value
        return value


class ByteLevel:
    """Ids as bytes (little-endian unsigned 32-bit) of texts, for a byte-level BPE file."""

    def __init__(self, tokenizer, added: list[str]):
        self.tokenizer, self.added = tokenizer, added
        self.model, self.pre = tokenizer.model, tokenizer.pre_tokenizer
        letters = _byte_letters()
        self.letters = {chr(b): x for b, x in enumerate(letters)}  # of latin-1 decoded bytes
        self.letters = str.maketrans(self.letters)
        self.tokens: dict[str, bytes] = {}
        self.names = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]
        self.space = letters[32]
        self.parts = _Table(self._after_space)

    def _token(self, mapped: str) -> bytes:
        got = self.tokens.get(mapped)
        if got is None:
            got = b"".join([self.names[t.id] for t in self.model.tokenize(mapped)])
            if len(mapped) < 8 and len(self.tokens) < KEPT_PARTS // 10:
                self.tokens[mapped] = got
        return got

    def _word(self, word: str) -> bytes:
        """A pre-token."""
        return self._token(word.encode().decode("latin-1").translate(self.letters))

    def _after_space(self, core: str) -> bytes:
        """The part of a space and what follows: words of ASCII letters, and their ends, go the short way."""
        if core.isascii():
            if core.isalpha():
                return b"".join([self.names[t.id] for t in self.model.tokenize(self.space + core)])
            stem = core.rstrip(_TAIL)
            if stem.isalpha():
                return self.parts[stem] + self._token(core[len(stem) :])
        return self._part(" " + core)

    def _part(self, part: str) -> bytes:
        core = part[1:] if part[:1] == " " else part
        if core.isascii() and core is not part:
            if core.isalpha():
                return b"".join([self.names[t.id] for t in self.model.tokenize(self.space + core)])
        elif core and core[-1] < "ɐ" and core.isalpha() and max(core) < "ɐ":
            return self._word(part)
        stem = core.rstrip(_TAIL)
        if stem and len(stem) < len(core) and stem.isalpha() and (core.isascii() or max(core) < "ɐ"):
            return (self.parts[stem] if core is not part else self._word(stem)) + self._token(core[len(stem) :])
        if "\n" not in part:
            return self._pre_tokens(part)
        lines, at, out = part.split("\n"), 0, []
        for k in range(len(lines) - 1):
            left, right = lines[k], lines[k + 1]
            if not left or not right or left[-1].isspace() or right[0].isspace():
                continue  # not a safe newline: it stays inside its piece
            piece = "\n".join(lines[at : k + 1])
            if "\n" in piece:
                out.append(self._pre_tokens(piece))
            else:
                out.append(self.parts[piece[1:]] if piece[0] == " " and len(piece) > 1 else self._part(piece))
            out.append(self._word("\n"))
            at = k + 1
        rest = "\n".join(lines[at:])
        out.append(self._part(rest) if at and "\n" not in rest else self._pre_tokens(rest))
        return b"".join(out)

    def _pre_tokens(self, part: str) -> bytes:
        return b"".join([self._token(mapped) for mapped, _ in self.pre.pre_tokenize_str(part)])

    def _whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return self._whole(text)
        try:
            first, *rest = text.split(" ")
            head = self._part(first) if first and not first[-1].isspace() else b""
            if rest and first and not head:
                raise _Unsafe
            if not rest and first and not head:
                return self._whole(text)
            return head + b"".join(map(self.parts.__getitem__, rest))
        except _Unsafe:
            return b"".join([self._part(p) for p in _SPLIT.split(text)])

    def count(self, text: str) -> int:
        return len(self.ids(text)) // 4


class Whole:
    """Any other tokenizers file: the library on whole texts."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def ids(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)


class Pieces:
    """A sentencepiece model, without begin and end ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, text: str) -> bytes:
        return array.array("I", self.model.encode(text, num_threads=1)).tobytes()

    def count(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))


def load(path: str):
    """The encoder for a file; kept for the life of the worker."""
    if path in _LOADED:
        return _LOADED[path]
    if path.endswith(".model"):
        _LOADED[path] = Pieces(path)
        return _LOADED[path]
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    pre, model, added = told.get("pre_tokenizer") or {}, told.get("model") or {}, told.get("added_tokens") or []
    plain = (
        told.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
        and not any(a.get(k) for a in added for k in ("lstrip", "rstrip", "single_word", "normalized"))
    )
    _LOADED[path] = ByteLevel(tokenizer, [a["content"] for a in added]) if plain else Whole(tokenizer)
    return _LOADED[path]
