"""Token ids of whole texts, through a cache of the library's answers for single words.

Both tokenizers used here cut a text before every run of white space and never look across such a cut, so a text's
ids are the ids of its ``white space + word`` chunks one after another. A worker asks the tokenizers library for
each chunk it has not met lately and keeps the answer, which is several times faster than encoding whole texts
again and gives the same ids. Where white space gives no ids, texts may also go in groups, with one look at the
cache for each different word of a group.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space as the tokenizers' patterns see it. Python's \s has four control characters more.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_CUT = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
END_ID = 1
BLOCK_CHARS = 1 << 20
# Characters of the texts that are encoded together.
GROUP_CHARS = 1 << 22
# For each worker: entries of a generation of the cache, and bytes of what is in them (long words).
CACHE_CHUNKS, CACHE_BYTES = 400_000, 1 << 25
# A word of Latin letters, after a line end or not, with ASCII marks behind it: the patterns cut at both places.
# Without U+0130: in lower case it is a letter and a combining dot, which the patterns take apart.
_EASY = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-/:-@\[-`{-~]*)")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = frozenset(c for c in map(chr, range(0x250)) if _EASY.fullmatch(c))
# The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
BYTE_LETTERS = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(_HIDDEN)}


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; an absolute path is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=64)
def _packer(n: int) -> Callable[..., bytes]:
    return struct.Struct(f"<{n}I").pack


class _Pieces(dict):
    """Ids by piece. One that is not there is learned on the way, so a text is gone through once."""

    def __init__(self, learn: Callable[[str], bytes]):
        self.learn = learn

    def __missing__(self, piece: str) -> bytes:
        return self.learn(piece)


class Encoder:
    """``encode(text)`` gives a text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, name: str, cache_chunks: int = CACHE_CHUNKS, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.tokenizer.encode_special_tokens = True
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        # Whether normalising a word of Latin letters is nothing but lower case.
        latin = "".join(sorted(_LETTERS))
        self.lower = self.normalizer is not None and self.normalizer.normalize_str(latin) == latin.lower()
        # Whether white space only separates words, which are normalised.
        self.separated = self.lower and self._direct([SPACE]) == [b""]
        self.cache_chunks, self.cache_bytes = cache_chunks, cache_bytes
        # Two generations: what has not been asked for since the last change is forgotten at the next.
        self.pieces: dict[str, bytes] = _Pieces(self._learn)
        self.old: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        # Bytes of the texts and ids in ``pieces`` and in ``chunks``.
        self.pieces_held = self.chunks_held = 0

    def _direct(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in got]

    def _chunk(self, text: str) -> bytes:
        if text not in self.chunks:
            self._forget_chunks()
            self._add_chunks([text])
        return self.chunks[text]

    def _add_chunks(self, texts: list[str]) -> None:
        ids = self._direct(texts)
        self.chunks.update(zip(texts, ids))
        self.chunks_held += sum(map(len, texts)) + sum(map(len, ids))

    def _forget_chunks(self) -> None:
        """Empty ``chunks`` if it has grown too large."""
        if len(self.chunks) > self.cache_chunks or self.chunks_held > self.cache_bytes:
            self.chunks.clear()
            self.chunks_held = 0

    def _forget_pieces(self) -> None:
        """A new generation if ``pieces`` has grown too large."""
        if len(self.pieces) > self.cache_chunks or self.pieces_held > self.cache_bytes:
            self.old, self.pieces, self.pieces_held = self.pieces, _Pieces(self._learn), 0

    def _word(self, word: str) -> bytes:
        """Ids of letters after at most one space: a single unit for either tokenizer's pattern."""
        if self.normalizer is not None:
            word = (word.lower() if self.lower else self.normalizer.normalize_str(word)).strip(" ")
        shown = word.replace(" ", "Ġ") if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
        ids = [t.id for t in self.model.tokenize(shown)]
        return _packer(len(ids))(*ids)

    def _learn(self, piece: str) -> bytes:
        """Ids of a piece not known yet; KeyError if it does not end in a word."""
        if not piece or piece[-1].isspace():
            raise KeyError(piece)
        ids = self.old.get(piece)
        if ids is None:
            if parts := _EASY.fullmatch(piece):
                line, word, marks = parts.groups()
                if self.lower:
                    word = word.lower()
                if line and self.normalizer is None:
                    ids = self._chunk("\n") + self._word(word)
                else:  # a normalised word has the same ids after any white space
                    ids = self.pieces.get(word) or self.old.get(word) or self._word(" " + word)
                    self.pieces[word] = ids
                if marks:
                    ids += self._chunk(marks)
            else:
                ids = self._direct([piece if piece[0] == "\n" else " " + piece])[0]
        self.pieces[piece] = ids
        # A word kept beside a piece is no longer than the piece.
        self.pieces_held += len(piece) + len(ids)
        return ids

    def _block(self, text: str) -> bytes:
        body = text.rstrip(SPACE)
        tail = self._chunk(text[len(body) :]) if len(body) < len(text) else b""
        # A piece stands for itself with the space before it, or for itself if it begins with a line end.
        first, *pieces = body.replace("\n", " \n").split(" ")
        if first and first[-1].isspace():
            return self._careful(body) + tail
        self._forget_pieces()
        try:
            rest = b"".join(map(self.pieces.__getitem__, pieces))
        except KeyError:
            return self._careful(body) + tail
        return (self._chunk(first) if first else b"") + rest + tail

    def _careful(self, text: str) -> bytes:
        """Any white space, chunk by chunk."""
        chunks = _CHUNK.findall(text)
        self._forget_chunks()
        self._add_chunks(list({c for c in chunks if c not in self.chunks}))
        return b"".join(map(self.chunks.__getitem__, chunks))

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self._block, blocks(text or "")))

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """``encode`` of each text in order. Each different piece of a group of texts is looked up once."""
        if not self.separated:
            yield from map(self.encode, texts)
            return
        group, held = [], 0
        for text in texts:
            text = text or ""
            if held + len(text) > GROUP_CHARS:
                yield from self._group(group)
                group, held = [], 0
            if len(text) > GROUP_CHARS:
                yield b"".join(ids for part in blocks(text, GROUP_CHARS) for ids in self._group([part]))
            else:
                group.append(text)
                held += len(text)
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        """``encode`` of each text, where white space only separates."""
        self._forget_pieces()
        # Among ASCII letters alone nothing composes, so a text may be in lower case before it is normalised.
        plain = [(t.lower() if t.isascii() else t).replace("\n", " ") for t in texts]
        pieces = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        coded = pieces.flatten().dictionary_encode()
        # As numpy objects, strings come out several times faster than by to_pylist().
        ids = list(map(self._ids, coded.dictionary.to_numpy(zero_copy_only=False)))
        _, ends, data = pa.array(ids, pa.large_binary()).take(coded.indices).buffers()
        data = data.to_pybytes() if data else b""
        ends = np.frombuffer(ends, "<i8")[pieces.offsets.to_numpy()].tolist() if texts else []
        for start, end in pairwise(ends):
            yield data[start:end]

    def _ids(self, piece: str) -> bytes:
        """Ids of what stands between white space. Words are kept without the ASCII marks behind them."""
        word = piece.rstrip(_MARKS)
        try:
            if word == piece or word[-1:] not in _LETTERS:
                return self.pieces[piece]
            return self.pieces[word] + self._chunk(piece[len(word) :])
        except KeyError:
            return self._chunk(" " + piece)


def blocks(text: str, most: int = BLOCK_CHARS) -> Iterator[str]:
    """A long text in parts that end before white space, so that no list of all its chunks is made at once."""
    at = 0
    while len(text) - at > most:
        cut = _CUT.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


@lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    """One encoder, and so one cache, for each worker process and vocabulary."""
    return Encoder(name)


END = np.array([END_ID], "<u4").tobytes()
