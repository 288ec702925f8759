"""Encoding texts inside tasks with the public tokenizer files.

A worker process keeps one encoder per tokenizer file.  For byte-level BPE without a
normaliser the encoder remembers the ids of space-delimited pieces: a single space
between two visible characters is always the start of a pre-token, so pieces can be
encoded apart and their ids joined.  A text where that does not hold (runs of white
space around a space, say) is encoded as a whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

#: Pieces an encoder remembers before it starts anew; bounds a worker's memory.
PIECES_KEPT = 400_000
#: New pieces encoded together.
RUN = 128
#: Letters and digits below this are so in all versions of Unicode.
_LATIN_END = "\u0250"
_STOPS = (".", ",")
#: Remembered words that begin a line.
HEADS_KEPT = 100_000
#: Characters encoded in one call.
CHARS_AT_ONCE = 2_000_000

_ENCODERS: dict[str, TextEncoder] = {}


def _visible(ch: str) -> bool:
    return "!" <= ch <= "~" or ch > "~" and unicodedata.category(ch)[0] not in "ZC"


class TextEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers, without added tokens."""

    def __init__(self, path: str):
        self._by_piece = False
        self._pieces: dict[str, bytes | None] = {}
        self._heads: dict[str, bytes | None] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._ids = lambda texts: model.encode(texts, num_threads=1)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core already
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_padding()
            tokenizer.no_truncation()
            self._ids = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            pre = spec.get("pre_tokenizer") or {}
            self._by_piece = (
                pre.get("type") == "ByteLevel"
                and pre.get("use_regex", True)
                and not pre.get("add_prefix_space")
                and spec.get("normalizer") is None
                and not any(
                    " " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"]
                    for t in spec["added_tokens"]
                )
            )
            if self._by_piece:
                # In a byte-level vocabulary a token has a character for each of its bytes.
                self._stops = dict(zip((*_STOPS, "\n"), self._whole([*_STOPS, "\n"])))
                vocab = tokenizer.get_vocab(with_added_tokens=True)
                self._bytes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
                for token, i in vocab.items():
                    self._bytes[i] = len(token)
                for i, token in tokenizer.get_added_tokens_decoder().items():
                    self._bytes[i] = len(token.content.encode())

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self._ids(texts)] if texts else []

    def _learn(self, wanted: set[str]) -> None:
        """Have the ids of all ``wanted`` pieces; None for those where a text can't be cut."""
        new = wanted.difference(self._pieces)
        if len(self._pieces) + len(new) > PIECES_KEPT:  # those in use are kept
            self._pieces = {x: self._pieces[x] for x in wanted.difference(new)}
        plain = set(filter(str.isalnum, new))  # most are words of letters alone
        new -= plain
        # A line break between visible characters is a token of its own, as is a full stop
        # or comma after a letter: such pieces are made of others.
        broken = {x: tuple(x.split("\n")) for x in new if x.count("\n") == 1}
        broken = {x: (a, b) for x, (a, b) in broken.items() if a and b and all(map(_visible, (a[0], a[-1], b[0], b[-1])))}
        new.difference_update(broken)
        before = {a for a, _ in broken.values()}.difference(self._pieces)
        ending = [x for y in (new, before) for x in y if x[-1:] in _STOPS and x[-2:-1].isalnum() and x[-2] < _LATIN_END]
        new |= before
        new.difference_update(ending)
        new.update({x[:-1] for x in ending}.difference(self._pieces))
        plain.update(x for x in new if x.isalnum() or x and _visible(x[0]) and _visible(x[-1]) or self._pieces.setdefault(x))
        self._together(list(plain), " ", self._pieces)
        if len(self._heads) > HEADS_KEPT:
            self._heads.clear()
        self._together([b for b in {b for _, b in broken.values()} if b not in self._heads], "\n", self._heads)
        for x in ending:
            word = self._pieces[x[:-1]]
            self._pieces[x] = None if word is None else word + self._stops[x[-1]]
        for x, (a, b) in broken.items():
            word = self._pieces[a]
            self._pieces[x] = None if word is None else word + self._stops["\n"] + self._heads[b]

    def _together(self, texts: list[str], joint: str, found: dict[str, bytes | None]) -> None:
        """Encode ``texts`` many at a time, parted by the bytes of their tokens.

        With a space as joint each text's ids are those after a space, else those on their own.
        """
        runs = [texts[i : i + RUN] for i in range(0, len(texts), RUN)]
        lead = joint if joint == " " else ""
        joined = [lead + joint.join(run) for run in runs]
        for run, text, ids in zip(runs, joined, self._whole(joined)):
            ends = np.cumsum(self._bytes[np.frombuffer(ids, dtype="<u4")])
            # No text holds the joint, so each of its bytes parts two of them.
            parted = np.flatnonzero(np.frombuffer(text.encode(), dtype=np.uint8) == ord(joint))
            if lead:
                starts, stops = parted, np.append(parted[1:], ends[-1])
            else:
                starts, stops = np.append(0, parted + 1), np.append(parted, ends[-1])
            first, last = (4 * np.searchsorted(ends, x, side="right") for x in (starts, stops))
            found.update(zip(run, map(ids.__getitem__, map(slice, first.tolist(), last.tolist()))))

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        cut = {}
        for i, text in enumerate(texts):
            first, *rest = text.split(" ")
            if rest and first and _visible(first[-1]) and rest[-1] and _visible(rest[-1][0]):
                cut[i] = (first, " " + rest.pop(), rest)
        self._learn(set().union(*(rest for _, _, rest in cut.values())))
        out: list[bytes | None] = [None] * len(texts)
        edges = iter(self._whole([x for first, last, _ in cut.values() for x in (first, last)]))
        for i, (_, _, rest) in cut.items():
            first, last = next(edges), next(edges)
            try:
                out[i] = first + b"".join(map(self._pieces.__getitem__, rest)) + last
            except TypeError:  # a piece that can't be cut off
                pass
        whole = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = ids
        return out

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order; null counts as empty."""
        some: list[str] = []
        size = 0
        for text in texts:
            some.append(text or "")
            size += len(some[-1])
            if size >= CHARS_AT_ONCE:
                yield from self._flush(some)
                some, size = [], 0
        yield from self._flush(some)

    def _flush(self, some: list[str]) -> list[bytes]:
        return self._encode_some(some) if self._by_piece else self._whole(some)


def encoder(path: str) -> TextEncoder:
    """This process's encoder for the tokenizer file at ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def tokenizer_version(path: str) -> str:
    """Hex digest of the tokenizer file: counts stored under it hold for that file alone."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
