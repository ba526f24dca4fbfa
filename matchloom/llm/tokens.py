"""Exact token ids of whole texts, with a memory of chunks.

Both public BPE vocabularies end a pre-token at every blank and line end, so a text's ids
are those of its chunks between them, one after the other. A worker asks the tokenizers
library only for chunks that it has not met yet and keeps the answers; texts whose white
space could join pre-tokens across chunks go to the library whole.

The memory holds at most MEMORY chunks, or fewer where asked for. When it is full, all but the short ones, which are
the frequent ones, are forgotten; that changes the time, never the ids.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Sequence

import numpy as np

MEMORY = 450_000
SHORT = 7
#: Letters, then ASCII punctuation without the apostrophe: two pre-tokens of either vocabulary.
WORD = re.compile(r"^([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)$")


def _byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + k for k, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


def ids_bytes(ids: Iterable[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


class Memory(dict):
    """Chunk -> ids; what is missing is learned when it is asked for."""

    def __init__(self, learn, blank: bool, most: int | None):
        super().__init__()
        self.learn, self.blank, self.most = learn, blank, most

    def __missing__(self, chunk: str) -> bytes | None:
        ids = self[chunk] = self.learn(self, chunk)
        return ids

    def make_room(self) -> None:
        most = self.most or MEMORY
        if len(self) > most:
            short = {c: v for c, v in self.items() if len(c) <= SHORT}
            self.clear()
            if len(short) < most // 2:
                self.update(short)


class ChunkEncoder:
    """Little-endian unsigned 32-bit ids of texts, special strings of the vocabulary as the library reads them."""

    def __init__(self, path: str, most: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: The byte-level vocabulary keeps white space in its tokens, the other one drops it.
        self.keeps_blanks = len(self._plain("a \n")) > len(self._plain("a"))
        self.first = Memory(self._learn, False, most)
        self.later = Memory(self._learn, self.keeps_blanks, most)
        self.tails: dict[str, bytes] = {}
        if self.keeps_blanks:
            self.line_end = ids_bytes(self._plain("\n"))

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def sentence_ends(self) -> np.ndarray:
        """For each id, whether its token ends a sentence or a line."""
        size = self.tokenizer.get_vocab_size()
        ends = re.compile(r"(?:[.!?][\"')\]]*|Ċ)(?:</w>)?$")
        return np.array([bool(ends.search(self.tokenizer.id_to_token(i) or "")) for i in range(size)])

    def _key(self, core: str) -> str | None:
        """What a run of letters is remembered and asked by; None where the library may lower-case it in another way than Python."""
        if self.keeps_blanks:
            return core
        if not core.isascii() and ("Σ" in core or not unicodedata.is_normalized("NFC", core)):
            return None
        return core.lower()

    def _word(self, key: str, blank: bool) -> bytes | None:
        """Ids of one run of letters by the library's model, which the pre-tokenizer would hand it alone."""
        if not key.isalpha():
            return None
        raw = key if key.isascii() else key.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.tokenizer.model.tokenize("Ġ" + raw if blank else raw)]).tobytes()

    def _learn(self, memory: Memory, c: str) -> bytes | None:
        """Letters with punctuation behind them word by word, all else by the whole tokenizer."""
        found = WORD.match(c)
        key = self._key(found[1]) if found else None
        if key is not None:
            ids = memory.get(key)
            if ids is None:
                ids = self._word(key, memory.blank)
                if ids is not None:
                    memory[key] = ids
            if ids is not None:
                tail = found[2]
                if not tail:
                    return ids
                end = self.tails.get(tail)
                if end is None:
                    end = self.tails[tail] = ids_bytes(self._plain(tail))
                return ids + end
        if self.keeps_blanks and any(x.isspace() for x in c):
            return None
        return ids_bytes(self._plain(" " + c if memory.blank else c))

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        self.first.make_room()
        self.later.make_room()
        return self._with_blanks(texts) if self.keeps_blanks else self._without_blanks(texts)

    def _without_blanks(self, texts: Sequence[str]) -> list[bytes]:
        memory = self.later
        memory[""] = b""
        get = memory.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]

    def _with_blanks(self, texts: Sequence[str]) -> list[bytes]:
        first, get, line_end = self.first, self.later.__getitem__, self.line_end
        out = []
        for text in texts:
            lines = [x.split(" ") for x in text.split("\n")]
            if not any("" in p for p in lines):
                try:
                    out.append(line_end.join([first[p[0]] + b"".join(map(get, p[1:])) for p in lines]))
                    continue
                except TypeError:  # a chunk with other white space in it
                    pass
            out.append(ids_bytes(self._plain(text)))
        return out


_ENCODERS: dict[tuple[str, int | None], ChunkEncoder] = {}


def encoder(path: str, most: int | None = None) -> ChunkEncoder:
    """One encoder a worker process, vocabulary and bound of its memory of chunks."""
    if (path, most) not in _ENCODERS:
        _ENCODERS[path, most] = ChunkEncoder(path, most)
    return _ENCODERS[path, most]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(count: int, weights: Sequence[int], most: int) -> Iterable[tuple[int, int]]:
    """Row ranges whose weights add up to about `most`, one row at least."""
    start = total = 0
    for i in range(count):
        if i > start and total + weights[i] > most:
            yield start, i
            start, total = i, 0
        total += weights[i]
    if start < count:
        yield start, count
