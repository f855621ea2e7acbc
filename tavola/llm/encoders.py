"""Encoding whole texts with public tokenizer files, chunk by chunk with a bounded cache.

A text is cut only where the tokenizer itself always cuts, so the ids of the
chunks in order are the ids of the text:

* ``SPACED``: a run of white space stays with the word after it.  The byte-level
  pattern ends a token before every white-space run that follows a visible
  character, and nothing in it looks past the next visible character.
* ``WORDS``: white space separates.  For tokenizers whose pattern drops white
  space and never matches across it.

White space is Unicode White_Space, as the libraries' ``\\s``.  Distinct chunks
recur far more often than new ones appear, so each worker keeps the chunks it
has met; a cache that reaches its limit starts afresh, which changes no result.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Callable

# Code points with the Unicode White_Space property.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                          0x202F, 0x205F, 0x3000]))
SPACED = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
WORDS = re.compile(f"[^{WHITE}]+")
#: Latin letters that no normalisation changes but lower-casing to one letter, and one closing mark.
_LATIN = "".join(c for c in map(chr, range(0xC0, 0x17F)) if c.isalpha() and len(c.lower()) == 1)
PLAIN = re.compile(f"([A-Za-z{_LATIN}]+)([.,]?)")
CACHE_LIMIT = 600_000
LONG = 64  # longer chunks seldom recur and are not kept


def words(text: str) -> list[str]:
    """The runs of visible characters, as ``WORDS``."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split() takes these for white space too
        return WORDS.findall(text)
    return text.split()


def spaced(text: str) -> list[str]:
    """The chunks of ``SPACED``, without the space in front of those that begin with just one.

    So the first chunk is as it stands; a later chunk that begins with a
    visible character has one space before it.
    """
    if text[:1] not in (" ", "\n") and not any(x in text for x in ("  ", " \n", "\n ", "\n\n")) \
            and text.replace("\n", "").isprintable() and text[-1:] not in (" ", "\n"):
        return text.replace("\n", " \n").split(" ") if text else []
    found = SPACED.findall(text)
    return found[:1] + [c[1:] if c[0] == " " and len(c) > 1 and c[1] not in WHITE else c for c in found[1:]]


class ChunkCache(dict):
    """chunk -> encoded value, computed on first use by ``encode``; bounded."""

    def __init__(self, encode: Callable[[str], object], limit: int = CACHE_LIMIT):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, chunk: str):
        value = self.encode(chunk)
        if len(chunk) <= LONG:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = value
        return value


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizers library's tokenizer of a .json file, with truncation and padding off."""
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@functools.lru_cache(maxsize=4)
def word_encoder(path: str) -> Callable[[str], bytes]:
    """text -> little-endian uint32 ids, for a .json tokenizer that drops white space.

    A plain Latin word goes straight to the library's merge model (lower-cased,
    in its byte alphabet); any other chunk goes through the whole library.
    """
    tok = load_tokenizer(path)
    model = tok.model
    letters = _byte_letters()

    def ids(values) -> bytes:
        return array("I", values).tobytes()

    def core(word: str) -> bytes:
        if not word.isascii():
            word = "".join([letters[b] for b in word.encode()])
        return ids([t.id for t in model.tokenize(word)])

    def whole(chunk: str) -> bytes:
        return ids(tok.encode(chunk, add_special_tokens=False).ids)

    cores = ChunkCache(core)
    marks = {"": b"", ".": whole("."), ",": whole(",")}

    def chunk(text: str) -> bytes:
        plain = PLAIN.fullmatch(text)
        return whole(text) if plain is None else cores[plain[1].lower()] + marks[plain[2]]

    cache = ChunkCache(chunk, 1_000_000)
    probe = "The quick, \xe9t\xe9 na\xefve Words. x"
    if b"".join(map(chunk, WORDS.findall(probe))) != whole(probe):  # a file of another make
        cache.encode = whole
    return lambda text: b"".join(map(cache.__getitem__, words(text)))


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [table[b] for b in range(256)]
