"""Pre-tokens of public byte-level BPE tokenizers, encoded one distinct pre-token at a time.

A text is cut into pre-tokens with the standard library's pattern matcher; each distinct pre-token is
encoded once by the library's own BPE model and remembered in its Python worker. Texts with characters
outside the plain set below, or with a special token's string inside, are encoded whole by the library.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from tokenizers import Tokenizer

# Character classes of the plain set (ASCII, Latin-1, Latin Extended-A, common punctuation).
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\\t-\\r \x85\xa0"
NOT_PLAIN = re.compile("[^\\x00-\\x1b\\x20-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u203a\u20ac]")
# The pre-token patterns that the two tokenizer files state, over the plain set.
# (Letters come first: no other alternative starts with one, and most pre-tokens do.)
WORDS = re.compile(f"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
BYTE_LEVEL = re.compile(
    f" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: Distinct pre-tokens that a worker remembers before it starts anew, and the longest ones that it remembers at all. Both bound its memory.
REMEMBERED, LONG = 600_000, 128


def byte_alphabet() -> str:
    """The 256 characters by which byte-level BPE writes bytes: printable ones stand for themselves."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return "".join(chr(b if b in keep else next(spare)) for b in range(256))


class PreTokenizer:
    """One tokenizer file in one Python process.

    ``words``: lower-cased words with the white space dropped (word_bpe files); otherwise byte-level
    pre-tokens that carry their leading space. ``value`` turns a pre-token's ids into what is remembered.
    """

    def __init__(self, path: str, words: bool, value: Callable = list, known: dict | None = None):
        self.path, self.words, self.value = path, words, value
        self.known = known or {}  # first tier: given, never dropped
        self.cache: dict = {}  # second tier: what this worker has met
        self.room = REMEMBERED

    @cached_property
    def library(self) -> Tokenizer:
        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    @cached_property
    def special(self) -> re.Pattern:
        return re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or "(?!)")

    @cached_property
    def alphabet(self) -> dict[int, str]:
        return dict(enumerate(byte_alphabet()))

    def plain(self, text: str) -> bool:
        return not NOT_PLAIN.search(text) and not ("<|" in text and self.special.search(text))

    def cut(self, text: str) -> list[str]:
        return WORDS.findall(text.lower()) if self.words else BYTE_LEVEL.findall(text)

    def whole(self, text: str) -> list[int]:
        """Ids of any text, by the library alone."""
        return self.library.encode(text, add_special_tokens=False).ids

    def piece(self, piece: str):
        """The value of one pre-token, which is remembered unless it is long."""
        found = self.value([t.id for t in self.library.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))])
        if len(piece) <= LONG:
            if len(self.cache) >= self.room:
                self.cache = {}
            self.cache[piece] = found
        return found

    def values(self, text: str) -> list:
        """The values of a plain text's pre-tokens, in order."""
        pieces = self.cut(text)
        found = list(map((self.known or self.cache).get, pieces))
        if None in found:
            for i, value in enumerate(found):
                if value is None:
                    value = self.cache.get(pieces[i])
                    found[i] = self.piece(pieces[i]) if value is None else value
        return found
