"""What several operators of this subpackage share: words, folds, cached maps, chunking."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most characters that a kernel works on at a time, so that a batch of long texts stays small.
CHUNK_CHARS = 3_000_000


def fold(doc_id: Column | str, k: int) -> Column:
    """crc32 of the id as text, modulo k: which rows are held out. Null ids give null."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % k


def byte_words(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than space and U+0009-U+000D, as UTF-8.

    bytes.split() separates at exactly these six bytes, which never occur inside a
    multi-byte sequence. Null gives no words.
    """
    return text.encode("utf-8", "replace").split() if text else []


def folded_words(text: str | None) -> list[bytes]:
    """byte_words() with A-Z lower-cased; bytes.lower() touches no other byte."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def chunks(texts: Iterable[str | None], most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """The texts in order (null as empty), in lists of about `most` characters; none is cut."""
    held: list[str] = []
    size = 0
    for t in texts:
        t = t if isinstance(t, str) else ""
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


class Memo(dict):
    """A dictionary that computes what it lacks and starts afresh beyond a size, so memory is bounded."""

    def __init__(self, compute, most: int = 400_000):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.compute(key)
        return value
