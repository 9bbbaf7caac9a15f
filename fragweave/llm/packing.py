"""Packing of token sequences by the dot-product heuristic of vector bin packing.

A sequence is a bin with three capacities: tokens, segments and loss-bearing tokens. An open
sequence takes, of the examples that fit as they are, the one whose demands have the largest
dot product with what is left of the capacities; if none fits, it takes the head of one and the
rest waits. Packing runs inside each partition over a bounded pool, so nothing is shuffled and
no group is gathered; the last, partly filled sequence of a partition is dealt out to sequences
whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragweave.llm.bpe import byte_symbols
from fragweave.llm.common import chunks

MAX_TOKENS = 1024
MAX_SEGMENTS = 128
#: Examples that wait at most before sequences are closed over them.
POOL = 2048
END = b"\0\0\0\0"
#: The fixed pattern by which byte-level vocabularies split a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass
class Piece:
    """Tokens start .. start + length of an example, put at `offset` of a sequence."""

    doc: object
    start: int
    length: int
    sequence: int
    offset: int


@dataclass
class Packer:
    """Places examples under limits on tokens, segments and loss-bearing tokens of a sequence.

    An example is `total` tokens of which the last `loss` bear loss. add() and finish() give
    closed pieces. Every token is in exactly one piece and the pieces of a sequence leave no gap.
    With a loss limit below the token limit, sequences may stay partly filled where all that
    waits bears loss.
    """

    max_tokens: int = MAX_TOKENS
    max_segments: int = MAX_SEGMENTS
    max_loss: int = MAX_TOKENS
    pool: int = POOL
    next_sequence: int = 0
    docs: list = field(default_factory=list)
    rows: list = field(default_factory=list)  # (document index, start, length, loss) that wait

    def add(self, doc: object, total: int, loss: int | None = None) -> list[Piece]:
        """Takes one example; returns what closed meanwhile. No tokens: no pieces."""
        loss = total if loss is None else loss
        out, start = [], 0
        free = total - loss  # tokens before this one bear no loss
        step = self.max_tokens
        while total - start >= step and min(step, start + step - free) <= self.max_loss:
            out.append(Piece(doc, start, step, self._new(), 0))
            start += step
        if start < total:
            self.docs.append(doc)
            self.rows.append((len(self.docs) - 1, start, total - start, min(loss, total - start)))
        if len(self.rows) >= self.pool:
            out += self._pack(self.pool // 2)
        return out

    def finish(self) -> list[Piece]:
        """Places all that waits."""
        return self._pack(0)

    def _new(self) -> int:
        self.next_sequence += 1
        return self.next_sequence - 1

    def _pack(self, keep: int) -> list[Piece]:
        """Closes full sequences until `keep` examples or fewer wait; with 0, everything."""
        if not self.rows:
            return []
        at, start, size, loss = (np.array(c, np.int64) for c in zip(*self.rows))
        alive = np.ones(len(at), bool)
        left = len(at)
        # how scarce each capacity is: the mean demand on it of what waits
        weight = np.array([size.mean() / self.max_tokens, 1 / self.max_segments, loss.mean() / self.max_loss]) + 1e-9
        out: list[Piece] = []
        while left > keep:
            sequence, used = self._new(), []
            room = np.array([self.max_tokens, self.max_segments, self.max_loss], np.int64)
            while left and room[0] > 0 and room[1] > 0:
                fits = alive & (size <= room[0]) & (loss <= room[2])
                # dot product of demands and room, each a share of its capacity; every example is one segment
                per = weight * room / np.square((self.max_tokens, self.max_segments, self.max_loss))
                gain = size * per[0] + per[1] + loss * per[2]
                i = int(np.argmax(np.where(fits, gain, -1.0)))
                if fits[i] and not (room[1] == 1 and size[i] < room[0] and self._longer(alive, size, room)):
                    take = int(size[i])
                else:
                    # nothing fits whole, or the last segment would leave a gap: the head of a longer one
                    able = np.where(alive, np.minimum(size, np.minimum(room[0], size - loss + room[2])), 0)
                    i = int(np.argmax(able))
                    take = int(able[i])
                    if not take:
                        break
                bears = max(0, take - int(size[i] - loss[i]))
                used.append((int(at[i]), int(start[i]), take, bears))
                room -= (take, 1, bears)
                start[i] += take
                size[i] -= take
                loss[i] -= bears
                if not size[i]:
                    alive[i] = False
                    left -= 1
            out += self._close(sequence, used, room)
        self.rows = [(int(a), int(s), int(n), int(k)) for a, s, n, k in zip(at[alive], start[alive], size[alive], loss[alive])]
        held = [self.docs[r[0]] for r in self.rows]
        self.rows = [(i, *r[1:]) for i, r in enumerate(self.rows)]
        self.docs = held
        return out

    @staticmethod
    def _longer(alive, size, room) -> bool:
        return bool((alive & (size >= room[0])).any())

    def _close(self, sequence: int, used: list[tuple[int, int, int, int]], room) -> list[Piece]:
        """Pieces of one sequence; a partly filled one is dealt out to sequences of a power of two."""
        out, total = [], sum(u[2] for u in used)
        if total == self.max_tokens:
            lengths = [total]
        else:
            lengths = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        todo, k, offset = list(used), 0, 0
        ids = [sequence] + [self._new() for _ in lengths[1:]]
        for doc, start, n, _ in todo:
            while n:
                take = min(n, lengths[k] - offset)
                out.append(Piece(self.docs[doc], start, take, ids[k], offset))
                start, n, offset = start + take, n - take, offset + take
                if offset == lengths[k]:
                    k, offset = k + 1, 0
        return out


class Tokens:
    """Whole texts to the ids of a byte-level vocabulary in the tokenizers JSON format.

    tiktoken runs the same merges over the same splits, several times as fast; it wants ranks
    and takes ids for them, so ids have to be in the order of the merges. Tests hold its ids
    against the tokenizers library. Special tokens' strings in a text become their ids.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("ids aren't in the order of the merges")
        byte = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(byte[c] for c in s): i for s, i in vocab.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.path, self.slow = path, None
        self.width = np.zeros(max([*vocab.values(), *special.values()]) + 1, np.int64)
        for b, i in [*ranks.items(), *((s.encode("utf-8"), i) for s, i in special.items())]:
            self.width[i] = len(b)
        self.run = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special).encode_to_numpy

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [self._ids(t).astype("<u4").tobytes() for t in texts]

    def within(self, ids: bytes, size: int) -> int:
        """How many of the ids lie wholly within the text's first `size` bytes."""
        return int(np.searchsorted(np.cumsum(self.width[np.frombuffer(ids, "<u4")]), size, "right")) if size else 0

    def _ids(self, text: str) -> np.ndarray:
        try:
            return self.run(text, allowed_special="all")
        except ValueError:
            # its pattern matcher gives up on very long runs of white space; the tokenizers library doesn't
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)



_LOADED: dict[str, Tokens] = {}


def prompt(text: str) -> str:
    """What of a document bears no loss: its heading, which is the first of several lines, with the line's end."""
    head, end, rest = text.partition("\n")
    return head + end if rest.strip() else ""


def _packed(path: str, id_col: str, limits: dict, prompt_of):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def rows(pieces: list[Piece]) -> pd.DataFrame:
        data = [(p.doc[0], p.start, p.length, zlib.crc32(p.doc[1][4 * p.start : 4 * (p.start + p.length)]), len(p.doc[1]) // 4, p.sequence, p.offset) for p in pieces]
        return pd.DataFrame(data, columns=columns).astype({c: "int64" for c in columns[1:]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _LOADED:
            _LOADED[path] = Tokens(path)
        tokens = _LOADED[path]
        packer = Packer(next_sequence=TaskContext.get().partitionId() << 36, **limits)
        for pdf in batches:
            ids, at = pdf[id_col].astype(object).tolist(), 0
            for part in chunks(pdf["text"]):
                out = []
                for text, b in zip(part, tokens.encode(part)):
                    key = ids[at]
                    at += 1
                    no_loss = tokens.within(b, len(prompt_of(text).encode("utf-8", "replace")))
                    b += END
                    total = len(b) // 4
                    out += packer.add((None if pd.isna(key) else key, b), total, total - no_loss)
                yield rows(out)
        yield rows(packer.finish())

    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", prompt_of=prompt, **limits) -> DataFrame:
    """documents -> a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and then id 0 (null and empty texts: id 0 alone). All tokens but
    those of prompt_of(text), which stands at the text's beginning, bear loss. Repeated and null ids
    are packed once for each row. Sequence ids are unique over all partitions. Whole texts are
    encoded, however long, and longer ones than a sequence are cut. No documents: no rows. limits:
    max_tokens, max_segments, max_loss, pool.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
    return docs.select(F.col(id_col), F.col("text")).mapInPandas(_packed(path, id_col, limits, prompt_of), schema)
