"""Words of UTF-8 bytes, without a list of all words of a very long text."""

from __future__ import annotations

import re
from collections.abc import Iterator

# bytes.split() cuts at exactly these six bytes, the white space of the word pattern [^\x20\x09-\x0D]+.
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
BLOCK_BYTES = 1 << 20


def word_blocks(data: bytes, most: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The words in order, in lists from about ``most`` bytes of text each."""
    at = 0
    while len(data) - at > most:
        cut = _WHITE.search(data, at + most)
        if cut is None:
            break
        yield data[at : cut.start()].split()
        at = cut.start()
    yield (data[at:] if at else data).split()
