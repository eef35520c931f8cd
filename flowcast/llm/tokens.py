"""Token ids of whole texts with a public tokenizer, word by word.

The tokenizer drops white space and splits texts at it, so the ids of a text are those of its pieces between ASCII
blanks, one after the other. Pieces repeat a lot; a bounded memory of their ids (as bytes) makes a text a join of
known byte strings, and only new pieces reach the tokenizer.
"""

from __future__ import annotations

import os
import re

import numpy as np

_BLANKS = re.compile("[ \t\n\r\x0b\x0c]+")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII marks but for the apostrophe, which starts endings
_loaded: dict[str, "Encoder"] = {}


def _pieces(text: str) -> list[str]:
    """What lies between blanks; Python also splits at four separators that the tokenizer doesn't drop.

    Latin-1 text has no marks that combine, so its case may be dropped before the tokenizer does so.
    """
    try:
        text.encode("latin-1")
        text = text.lower()
    except UnicodeEncodeError:
        pass
    return _BLANKS.split(text) if any(mark in text for mark in "\x1c\x1d\x1e\x1f") else text.split()


class _Known(dict):
    """Ids of pieces; a piece that is not known yet comes back as it is and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> str:
        self.new.append(piece)
        return piece


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes. ``remembered`` pieces are kept at most."""

    def __init__(self, path: str, remembered: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer, self._remembered = Tokenizer.from_file(path), remembered
        self._known = _Known()
        self._ids: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        """A run of letters with plain marks behind it is the ids of the letters and those of the marks."""
        ids = self._ids
        heads = [piece.rstrip(_MARKS) for piece in pieces]
        heads = [(head.lower() if head.isascii() else head) if head.isalpha() else "" for head in heads]
        words = {head for head in heads if head}
        tails = [piece[len(head):] if head else piece for piece, head in zip(pieces, heads, strict=True)]
        others = {tail for tail in tails if tail}
        self._learn_words([word for word in words if word not in ids])
        others = [piece for piece in others if piece not in ids]
        for piece, found in zip(others, self._tokenizer.encode_batch(others, add_special_tokens=False), strict=True):
            ids[piece] = np.asarray(found.ids, dtype="<u4").tobytes()
        ids[""] = b""
        self._known.update(zip(pieces, [ids[head] + ids[tail] for head, tail in zip(heads, tails, strict=True)], strict=True))

    def _learn_words(self, words: list[str]) -> None:
        """Many words go through the tokenizer as one text; it numbers the words that ids belong to."""
        texts = [words[at:at + 500] for at in range(0, len(words), 500)]
        for part, found in zip(texts, self._tokenizer.encode_batch([" ".join(t) for t in texts], add_special_tokens=False), strict=True):
            ids = np.asarray(found.ids, dtype="<u4")
            number = np.asarray(found.word_ids, dtype=np.int64)
            first = np.flatnonzero(np.diff(number, prepend=-1))
            if len(first) != len(part):  # a letter that normalisation splits: one by one
                for word in part:
                    self._ids[word] = np.asarray(self._tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
                continue
            ends, ids = [*(4 * first[1:]).tolist(), 4 * len(ids)], ids.tobytes()
            self._ids.update(zip(part, map(ids.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Texts that are null or blank have no ids."""
        known = self._known
        if len(known) > self._remembered:
            known.clear()
        if len(self._ids) > self._remembered:
            self._ids.clear()
        found: list[bytes | list] = []
        for text in texts:
            before = len(known.new)
            parts = list(map(known.__getitem__, _pieces(text))) if text else []
            found.append(b"".join(parts) if len(known.new) == before else parts)
        if known.new:
            self._learn(list(set(known.new)))
            known.new.clear()
            found = [own if type(own) is bytes else b"".join([p if type(p) is bytes else known[p] for p in own]) for own in found]
        return found


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def vocabulary() -> str:
    """The default vocabulary file; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
