"""BPE encoding by prefix-sharing trie traversal, and decoding.

Distinct words of a batch form a trie over symbols, which sorting them lists depth first, so only
the path to the present word is held. The walk keeps, for every node of the path, the last token
of the encoding of the path to it. That token is the one candidate t
(ending there) whose merge history can't be disturbed by the last token of the encoding of the
path without t; following these states back gives the encoding of any word, and what words
share at their start is worked out once. Exactness rests on merges being ordered: a token's
parts always have lower ranks than the token.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragweave.llm.common import Memo

#: Unicode's White_Space characters.
_SPACE = r"\t-\r \x85\xa0  -     　"
_NEVER = 1 << 60
#: Most characters that are split, and whose new words are encoded, at a time.
RUN_CHARS = 1_000_000
#: Most words, and characters of each, that are kept from one run to the next; most pairs of tokens, and steps, that are.
KNOWN, KNOWN_CHARS, PAIRS = 150_000, 100, 200_000
#: Added to the byte of a word's last symbol, which bears the end-of-word suffix.
_MARK = 256


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others take code points from 256 on, in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Bpe:
    """A byte-level BPE vocabulary in the tokenizers JSON format, with whole-word encoding.

    Handles what the two public files use: an optional NFC, white-space and lower-case
    normaliser, a split pattern, byte-level symbols, an end-of-word suffix, added special tokens
    that are recognised in raw text before normalisation, no decoder or a byte-level one.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        # per id: as text, and what it decodes to
        self.texts = {i: (str(i).encode(), s.encode("utf-8", "replace")) for i, s in names.items()}
        norm = json.dumps(spec.get("normalizer") or "")
        # runs of white space are squeezed too, which changes no piece where pieces hold none
        self.nfc, self.lower = '"NFC"' in norm, '"Lowercase"' in norm
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [spec["pre_tokenizer"]])
        split = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), None)
        # the byte-level splitter's fixed pattern
        split = split or r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        own = split.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
        self.split = regex.compile(own)
        # merges: pair of ids -> rank; parts: id -> (rank, left, right), single symbols have none
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = self.vocab[a + b]
            self.merge[self.vocab[a], self.vocab[b]] = rank
            self.parts.setdefault(whole, (rank, self.vocab[a], self.vocab[b]))
        self.size = 1 + max(self.texts)
        self.fits = Memo(self._fits, PAIRS)
        self._automaton()
        self.step = Memo(self._step, PAIRS)

    def _automaton(self) -> None:
        """Which tokens end where: a trie of all tokens that merges can make, with suffix links.

        A symbol is a byte, with _MARK if it bears the suffix; child and step have 512 * state + symbol as key.
        ending[state]: (symbols, id) of the tokens that are suffixes of the state's path, longest first.
        """
        byte = {s: b for b, s in enumerate(byte_symbols())}
        self.child: dict[int, int] = {}
        own: list[tuple[int, int] | None] = [None]
        n = len(self.suffix)
        for s, t in self.vocab.items():
            marked = n and len(s) > n and s.endswith(self.suffix)
            symbols = [byte.get(x) for x in (s[:-n] if marked else s)]
            if len(symbols) > 1 and t not in self.parts or None in symbols:
                continue
            if marked:
                symbols[-1] += _MARK
            state = 0
            for x in symbols:
                if (key := state << 9 | x) not in self.child:
                    self.child[key] = len(own)
                    own.append(None)
                state = self.child[key]
            own[state] = (len(symbols), t)
        below: list[list[tuple[int, int]]] = [[] for _ in own]
        for key, to in self.child.items():
            below[key >> 9].append((key & 511, to))
        self.fall, self.ending = [0] * len(own), [()] * len(own)
        level = [(0, x, to) for x, to in below[0]]
        while level:
            deeper = []
            for state, x, to in level:
                if state:
                    self.fall[to] = self._step(self.fall[state] << 9 | x)
                self.ending[to] = ((own[to],) if own[to] else ()) + self.ending[self.fall[to]]
                deeper += [(to, y, z) for y, z in below[to]]
            level = deeper

    def _step(self, key: int) -> int:
        """The state of the longest known suffix after one more symbol."""
        state, x = key >> 9, key & 511
        while state and state << 9 | x not in self.child:
            state = self.fall[state]
        return self.child.get(state << 9 | x, 0)

    def _fits(self, pair: int) -> bool:
        """Whether two finished tokens stay apart when merges run in rank order from single symbols.

        Walks both merge histories backwards from the end. At each time the pair that meets at the
        boundary would merge if its rank came before the merges that consumed either of the two; on
        equal ranks the pair further left goes first.
        """
        a, b = divmod(pair, self.size)
        gone_a = gone_b = _NEVER  # ranks at which a and b were themselves merged into what follows
        while True:
            rank = self.merge.get((a, b), _NEVER)
            if rank < gone_a and rank <= gone_b and rank < _NEVER:
                return False
            up_a, up_b = self.parts.get(a), self.parts.get(b)
            if up_a is None and up_b is None:
                return True
            # undo the later of the two merges
            if up_b is None or (up_a is not None and up_a[0] > up_b[0]):
                gone_a, a = up_a[0], up_a[2]
            elif up_a is None or up_b[0] > up_a[0]:
                gone_b, b = up_b[0], up_b[1]
            else:
                # the same merge on both sides: it ran on the left first, so undo the right first
                gone_b, b = up_b[0], up_b[1]

    def encode_words(self, words: list[str]) -> Iterator[tuple[int, list[int]]]:
        """(place in words, ids) of each (distinct, not empty) word, by one walk over their common trie."""
        fits, step, ending, size = self.fits, self.step, self.ending, self.size
        mark = _MARK if self.suffix else 0
        # of the first d symbols of the path, last[d]: last token of their encoding; width[d]: its symbols; states[d]: the automaton's state
        last, width, states = [-1], [0], [0]
        before = b""
        for w, i in sorted((w.encode("utf-8", "replace"), i) for i, w in enumerate(words)):
            # the symbol that bears the suffix ends its word, so it isn't shared
            depth, most = 0, min(len(w), len(before)) - (mark > 0)
            while depth < most and w[depth] == before[depth]:
                depth += 1
            del last[depth + 1 :], width[depth + 1 :], states[depth + 1 :]
            state, symbols = states[depth], [*w[depth:]]
            if symbols:
                symbols[-1] += mark
            for s in symbols:
                state = step[state << 9 | s]
                depth += 1
                for n, t in ending[state]:
                    if n == depth or fits[last[depth - n] * size + t]:
                        last.append(t)
                        width.append(n)
                        states.append(state)
                        break
                else:
                    raise ValueError(f"the vocabulary lacks the byte {s & 255}" + " at a word's end" * (s >= _MARK))
            ids = []
            while depth:
                ids.append(last[depth])
                depth -= width[depth]
            yield i, ids[::-1]
            before = w

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """(part, is special) in order; special tokens' strings are taken from the raw text."""
        if "<|" not in text or not self.special:
            return [(text, False)]
        found = regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text)
        return [(x, x in self.special) for x in found if x]

    def words(self, text: str) -> Iterable[str]:
        """Pieces of a text without special tokens that are encoded on their own; a long text's one by one."""
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            # character by character, so a final capital sigma is no special case
            text = text.replace("Σ", "σ").lower()
        return self.split.findall(text) if len(text) <= RUN_CHARS else (m[0] for m in self.split.finditer(text))

    def pieces(self, text: str) -> Iterable[str | tuple[str]]:
        """A text's words and, as tuples, its special tokens in order."""
        segments = self.segments(text)
        if len(segments) == 1 and not segments[0][1]:
            return self.words(text)
        return chain.from_iterable([(x,)] if is_special else self.words(x) for x, is_special in segments)


def runs(texts: Iterable[str | None], bpe: Bpe, most: int) -> Iterator[list[tuple[bool, list]]]:
    """(a text begins, its pieces) of the texts in order (null as empty), in runs of about `most` characters.

    A longer text goes on in the runs after; none of its pieces is cut.
    """
    held, size = [], 0
    for t in texts:
        t = t if isinstance(t, str) else ""
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        begins, part = True, []
        if len(t) <= most:
            part = bpe.pieces(t)
            part = part if isinstance(part, list) else list(part)
            size += len(t)
        else:
            for x in bpe.pieces(t):
                part.append(x)
                size += len(x)
                if size >= most:
                    yield [(begins, part)]
                    begins, part, size = False, [], 0
        held.append((begins, part))
    if held:
        yield held


def learn(fresh: set, bpe: Bpe, known: dict) -> None:
    """Adds the ids as text and the decoded text, joined by spaces, of words that aren't known."""
    texts = bpe.texts
    plain = [w for w in fresh if isinstance(w, str)]
    for i, ids in bpe.encode_words(plain):
        found = [texts[t] for t in ids]
        known[plain[i]] = found[0] if len(found) == 1 else tuple(map(b" ".join, zip(*found)))
    for w in fresh:
        if not isinstance(w, str):
            known[w] = texts[bpe.special[w[0]]]


def digests(texts: Iterable[str | None], bpe: Bpe, known: dict, most: int = KNOWN, run: int = RUN_CHARS) -> list[tuple[int, str, str]]:
    """(number of ids, SHA-256 of the ids as text, SHA-256 of the decoded text) of whole texts.

    known: words met before -> (ids as text, decoded). Beyond `most` words only those met again stay, and
    long ones never do, so memory is bounded. Without a decoder the tokens' strings are joined by spaces.
    """
    out, again = [], set()
    n, sums = 0, None
    for held in runs(texts, bpe, run):
        met = set().union(*(part for _, part in held))
        old = {w for w in met if w in known}
        again |= old
        if len(known) > most:
            stay = {w: known[w] for w in (again if len(again) <= most // 2 else old)}
            known.clear()
            known.update(stay)
            again.clear()
        learn(met - old, bpe, known)
        for begins, part in held:
            if begins:
                if sums:
                    out.append((n, *(x.hexdigest() for x in sums)))
                n, sums = 0, (hashlib.sha256(), hashlib.sha256())
            if part:
                ids, names = map(b" ".join, zip(*map(known.__getitem__, part)))
                for x, added in zip(sums, (ids, names)):
                    if n:
                        x.update(b" ")
                    x.update(added)
                n += ids.count(b" ") + 1
        for w in met:
            if len(w) > KNOWN_CHARS:
                del known[w]
    if sums:
        out.append((n, *(x.hexdigest() for x in sums)))
    return out


def encoder(path: str) -> Callable:
    """A column function: text -> struct(n_tokens, ids_sha256, decoded_sha256) under the vocabulary at path."""
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe, known = vocabulary(path)
        for s in batches:
            yield pd.DataFrame(digests(s, bpe, known), columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run


_LOADED: dict[str, tuple[Bpe, dict]] = {}


def vocabulary(path: str) -> tuple[Bpe, dict]:
    """The vocabulary and the words met so far, kept from task to task in a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path), {}
    return _LOADED[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """documents -> (doc_id, n_tokens, ids_sha256, decoded_sha256), a row per row, repeated and null ids too.

    Null text is empty: no ids, and the digest of nothing. Whole texts are encoded, however long; memory
    follows the distinct words of a run of texts, and a text is one word at worst. No documents: no rows.
    """
    return docs.select("doc_id", encoder(path)("text").alias("e")).select("doc_id", "e.n_tokens", "e.ids_sha256", "e.decoded_sha256")
