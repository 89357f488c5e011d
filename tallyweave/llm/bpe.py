"""Whole-text encoding with the ``tokenizers`` library, with a bounded cache of chunks.

In a byte-level BPE with the usual split pattern and no normaliser, a text's ids are those
of its chunks put together, when each chunk begins at a run of white space that follows a
character of another kind.  Chunks recur, so a worker keeps the ids of short ones; each id
still comes from the library.  Texts that hold the string of an added token (which the library
takes out before it splits) are encoded as one, and so are all texts of other kinds of
tokenizers.
"""

from __future__ import annotations

import array
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks after a space, and at a line's start, that a worker keeps (about 200 bytes each), and
#: the longest that it keeps.
CACHE, FIRST_CACHE = 300_000, 75_000
CACHE_CHARS = 40

#: White space as the split pattern has it.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: What a text of single spaces and single line ends between words does not have.
_ODD = ["  ", " \n", "\n ", "\n\n", *"\t\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B))]
#: Letters and then ASCII marks, which the split keeps apart (an apostrophe can begin a suffix).
_MARKED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)\Z")


#: The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 ones for
#: themselves, the other bytes for 256, 257, ... in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: Up to here, what Python calls a letter is one for every version of Unicode's tables.
_LATIN = "\u024f"


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        t = self.tokenizer = Tokenizer.from_file(path)
        #: A text that holds one of these is encoded as one.
        self.added = [x.content for x in t.get_added_tokens_decoder().values()]
        pre, self.model = t.pre_tokenizer, t.model
        self.chunked = t.normalizer is None and type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space and type(self.model).__name__ == "BPE" and not self.model.dropout
        #: Ids, as little-endian 32-bit bytes, of chunks after a space and of chunks at a text's start.
        self.later: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.line = self._raw("\n")

    def _raw(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, held: dict[str, bytes], prefix: str, chunk: str) -> bytes:
        """Ids of a chunk without spaces, after ``prefix`` (a space or nothing)."""
        ids = held.get(chunk)
        if ids is None:
            if chunk.isalpha() and (chunk.isascii() or max(chunk) <= _LATIN):  # one run of letters: the split has nothing to do
                shown = (prefix + chunk).encode().decode("latin1").translate(_BYTES)
                ids = array.array("I", [x.id for x in self.model.tokenize(shown)]).tobytes()
            elif (m := _MARKED.match(chunk)) and (chunk.isascii() or max(m[1]) <= _LATIN):
                ids = self._chunk(held, prefix, m[1]) + self._chunk(self.first, "", m[2])
            else:
                ids = self._raw(prefix + chunk)
            if len(chunk) <= CACHE_CHARS and len(held) < (CACHE if held is self.later else FIRST_CACHE):
                held[chunk] = ids
        return ids

    def _line(self, text: str) -> bytes:
        """Ids of words between single spaces."""
        if not text:
            return b""
        head, *rest = text.split(" ")
        get, add = self.later.get, self._later
        return (self._chunk(self.first, "", head) if head else b"") + b"".join([get(w) or add(w) for w in rest])

    def _later(self, chunk: str) -> bytes:
        return self._chunk(self.later, " ", chunk)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.chunked or any(x in text for x in self.added):
            return self._raw(text)
        if not any(x in text for x in _ODD):
            return self.line.join([self._line(x) for x in text.split("\n")])
        out = []
        for c in _CHUNK.findall(text):
            if c[0] == " " and len(c) > 1 and not c[1].isspace():
                out.append(self._chunk(self.later, " ", c[1:]))
            elif not c[0].isspace():
                out.append(self._chunk(self.first, "", c))
            else:
                out.append(self._raw(c))
        return b"".join(out)


def narrow(ids: bytes, width: int) -> bytes:
    """Little-endian 32-bit ids as ids of ``width`` bytes; an id that needs more is an error."""
    if width == 4:
        return ids
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and int(wide.max()) >> 8 * width:
        raise ValueError(f"id {int(wide.max())} does not fit into {width} bytes")
    return wide.astype(f"<u{width}").tobytes()


def widen(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file; a worker process keeps it between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(col: pa.Array, path: str, end: int) -> Iterator[tuple[int, bytes]]:
    """(row, ids of the text and then ``end``) for each row; null counts as empty."""
    enc, last = encoder(path), int(end).to_bytes(4, "little")
    for at in range(0, len(col), 256):
        for k, text in enumerate(col.slice(at, 256).to_pylist(), at):
            yield k, enc.encode(text or "") + last
