"""Token ids of whole texts by the tokenizers library, with each distinct chunk between spaces encoded once.

A byte-level pre-tokenizer never joins what stands on both sides of a single space between two other characters: the
space always begins the next pre-token. One that drops white space never joins over any space. So a text's ids are
its chunks' ids in order, and a chunk met before needs one dictionary look-up. Where a text has other runs of white
space, it is cut only at the single spaces, and the rest goes to the library as it is.

A new chunk is cut further where a pre-token must end: around a single line break between other characters, and after
a leading run of Latin letters that an ASCII character other than a letter follows. Such a run is one pre-token, which
the library's model takes without its normaliser and pre-tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable
from itertools import islice

from papyra.llm._shared import kept

#: Between two characters that are not white space.
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Chunks kept in a worker's memory; at more, it starts anew.
MOST_CHUNKS = 250_000
#: Letters that neither lower case nor composition joins to others, up to an ASCII character that is no letter or the end.
_HEAD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\x00-@\[-`{-\x7f]|\Z)")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes as: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


def _trim(cache: dict, most: int) -> None:
    """A cache with more entries keeps its oldest half, which has the common ones."""
    if len(cache) > most:
        kept = dict(islice(cache.items(), most // 2))
        cache.clear()
        cache.update(kept)


class _Memo(dict):
    """A dictionary that makes what it lacks."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class _Uneven(Exception):
    """A chunk that other white space touches: not what a cut at lone spaces gives."""


class ChunkEncoder:
    """encode(texts) gives the library's ids of each text, add_special_tokens=False, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most_chunks: int = MOST_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = not self._drops_space()  # else it lowers case, too
        self.most = most_chunks
        self.model = self.tokenizer.model
        self.line_break = self._ids("\n")
        self.chunks = _Memo(self._chunk)
        self.heads, self.inner, self.rests = _Memo(self._head), _Memo(self._inner_head), _Memo(self._ids)

    def _drops_space(self) -> bool:
        ids = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("a b", "a  \n b", " a b ")]
        return ids[0] == ids[1] == ids[2]

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _inner_head(self, letters: str) -> bytes:
        """Ids of letters that are one pre-token."""
        if not self.spaced:
            letters = letters.lower()
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _head(self, letters: str) -> bytes:
        """Ids of letters after a space."""
        if not self.spaced:
            return self._inner_head(letters)
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(_LETTERS[32] + letters)]).tobytes()

    def _part(self, part: str, heads: _Memo, lead: str) -> bytes:
        head = _HEAD.match(part)
        if head is None:
            return self._ids(lead + part)
        end = head.end()
        return heads[part] if end == len(part) else heads[part[:end]] + self.rests[part[end:]]

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk after a space."""
        lead = " " if self.spaced else ""
        if lead and (not chunk or chunk[0].isspace() or chunk[-1].isspace()):
            raise _Uneven
        if "\n" not in chunk:
            return self._part(chunk, self.heads, lead)
        parts = chunk.split("\n")
        if lead and any(not p or p[0].isspace() or p[-1].isspace() for p in parts):
            return self._ids(lead + chunk)
        out = [self._part(parts[0], self.heads, lead)]
        for part in parts[1:]:
            out += [self.line_break if lead else b"", self._part(part, self.inner, "")]
        return b"".join(out)

    def _text(self, text: str) -> bytes:
        get = self.chunks.__getitem__
        if not self.spaced:
            return b"".join(map(get, text.split(" ")))
        head, *parts = text.split(" ")
        try:
            if head[-1:].isspace():
                raise _Uneven
            return self._ids(head) + b"".join(map(get, parts))
        except _Uneven:
            head, *parts = _LONE_SPACE.split(text)
            tail = self._ids(" " + parts.pop()) if parts else b""
            return self._ids(head) + b"".join(map(get, parts)) + tail

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        for memo in (self.chunks, self.heads, self.inner, self.rests):
            _trim(memo, self.most)
        return list(map(self._text, texts))


def encoder(path: str, most_chunks: int = MOST_CHUNKS) -> ChunkEncoder:
    """The worker's own encoder of the file, kept between tasks."""
    return kept(("chunks", path, most_chunks), lambda: ChunkEncoder(path, most_chunks))
