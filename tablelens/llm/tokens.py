"""Token ids of whole texts by the tokenizers library, with a cache of pieces.

The byte-level vocabulary splits a text into pieces before it merges bytes, and
a piece never runs from a character other than white space into white space.
So a text may be cut before every space or line break that stands alone, and
its ids are the ids of the parts, joined. Parts repeat a lot, so each worker
keeps those it has met twice. Texts with runs of white space, white space at an
end, or the string of an added token that counts as one are encoded whole.

Ids are kept as little-endian unsigned 32-bit bytes.
"""

from __future__ import annotations

import os
from array import array

#: Parts that a worker remembers. When it holds so many it adds no more, and starts afresh after ``STALE`` further misses.
CACHE_PARTS = 400_000
STALE = 2_000_000
LONGEST_PART = 64
#: Parts are remembered when met again, as most are met once: a byte per hash tells.
_MET_MASK = (1 << 22) - 1
#: Marks that follow a word in a piece of their own. An apostrophe may be part of one with letters.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: White space (by any library's reading) other than the space and the line break.
_OTHER_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_WIDE_SPACE = "\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200b)))
_WORKERS: dict[tuple[str, bool], Encoder] = {}


def _plain(text: str) -> bool:
    """Only single spaces and single line breaks, and none at the ends. A dozen substring searches are
    much faster here than one regular expression."""
    return not (text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text
                or any(c in text for c in _OTHER_SPACE) or (not text.isascii() and any(c in text for c in _WIDE_SPACE)))


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder(dict):
    """part (without its leading space) -> id bytes.

    ``added_tokens``: strings of the vocabulary's added tokens get those tokens' ids, as the library
    does unless told otherwise; else they are ordinary text.
    """

    def __init__(self, vocabulary: str, added_tokens: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = not added_tokens
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added_tokens else []
        self.letters = _byte_letters()
        self.line = self.whole("\n")
        self.met, self.missed = bytearray(_MET_MASK + 1), 0

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str, space: str) -> bytes:
        """Letters only, or marks only: one piece, so the merges alone give its ids."""
        mapped = space + (piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def __missing__(self, part: str) -> bytes:
        """Ids of a part after its space. Keys that begin with a space (no part does) are pieces without one."""
        if part.isalpha():
            ids = self._piece(part, "Ġ")
        elif part[0] == " ":
            ids = self._piece(part[1:], "")
        else:
            word = part.rstrip(_MARKS)
            line = word[:1] == "\n"
            if not word[line:].isalpha():
                ids = self.whole(part if part[0] == "\n" else " " + part)
            else:
                ids = self.line + self[" " + word[1:]] if line else self[word]
                if len(word) < len(part):
                    ids += self[" " + part[len(word):]]
        if len(self) >= CACHE_PARTS:
            self.missed += 1
        elif self.met[at := hash(part) & _MET_MASK]:
            if len(part) <= LONGEST_PART:
                self[part] = ids
        else:
            self.met[at] = 1
        return ids

    def ids(self, text: str) -> bytes:
        if not text or not _plain(text) or any(t in text for t in self.added):
            return self.whole(text) if text else b""
        if self.missed > STALE:
            self.clear()
            self.met, self.missed = bytearray(_MET_MASK + 1), 0
        first, *parts = text.replace("\n", " \n").split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, parts))


def encoder(vocabulary: str, added_tokens: bool = False) -> Encoder:
    key = vocabulary, added_tokens
    if key not in _WORKERS:
        _WORKERS[key] = Encoder(*key)
    return _WORKERS[key]
