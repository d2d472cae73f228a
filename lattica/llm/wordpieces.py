"""Encoding with a word-level BPE file of the tokenizers library, each distinct piece encoded once.

The file's own pipeline (NFC, white space, lower case, split, byte-level BPE) never joins
characters across ASCII white space, so a text's ids are those of its words in turn. Plain
Latin texts are cut into the file's pre-tokens here; new pre-tokens are encoded by the
file's BPE model, many in one call. Words with any other character go through the
whole tokenizer. The result equals Tokenizer.encode(text, add_special_tokens=False).ids.
"""

from __future__ import annotations

import re

import numpy as np

from .common import WORD

# Characters that normalise to themselves, and the pre-token pattern on them in lower case.
PLAIN = re.compile(r"[\t\n\v\f\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
# The alternatives begin with different characters but for the last two, so the most frequent is tried first.
PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-zß-öø-ÿ0-9]+")
#: Pieces known at a time; beyond that those not met since the last time are forgotten.
MOST = 250_000
#: Characters of a text that are cut into pieces at once.
SLICE = 100_000
END = "</w>"
SPACE = re.compile(r"[\x20\x09-\x0D]")


class WordPieces:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab()
        self.wide = max(vocab.values()) >= 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(END)]] = True
        self.known: dict[str, bytes] = {}  # by pre-token, or OTHER and a word
        self.older: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        # the same ids as encode gives, without the places of the characters
        ids = np.array(self.bare.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.int64)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(pieces):
            raise ValueError("pieces and word ends differ")
        raw, size = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
        ends = (stops * size).tolist()
        self.known.update(zip(pieces, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def _other(self, word: str) -> bytes:
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian bytes of self.dtype; null and empty: none."""
        out: list[bytes] = []
        run: list[str] = []
        size = 0
        for text in texts:
            if text and len(text) > SLICE:
                out += self._group(run)
                run, size = [], 0
                out.append(b"".join(self._group([part])[0] for part in _slices(text)))
                continue
            run.append(text or "")
            size += len(run[-1])
            if size >= SLICE:
                out += self._group(run)
                run, size = [], 0
        return out + self._group(run)

    def _group(self, texts: list[str]) -> list[bytes]:
        cut = [_pieces(x) for x in texts]
        new = set().union(*cut).difference(self.known)
        if new:
            if len(self.known) + len(new) > MOST:
                self.older, self.known = self.known, {}
                new = set().union(*cut)
            again = {p: self.older[p] for p in new if p in self.older}  # set.intersection would walk through all of older
            self.known.update(again)
            new.difference_update(again)
            others = [p for p in new if p[0] == OTHER]
            self.known.update((p, self._other(p[1:])) for p in others)
            if len(others) < len(new):
                self._learn([p for p in new if p[0] != OTHER])
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in cut]


#: Marks words that the whole tokenizer encodes; no piece begins with it.
OTHER = "\0"


def _pieces(text: str) -> list[str]:
    if _plain(text):
        return PIECE.findall(text.lower())
    out: list[str] = []
    for word in WORD.findall(text):
        if _plain(word):
            out += PIECE.findall(word.lower())
        else:
            out.append(OTHER + word)
    return out


def _slices(text: str):
    """A long text in slices that end at ASCII white space; a longer word stays whole."""
    at = 0
    while at < len(text):
        m = SPACE.search(text, at + SLICE) if at + SLICE < len(text) else None
        to = m.end() if m else len(text)
        yield text[at:to]
        at = to


def _plain(text: str) -> bool:
    return PLAIN.fullmatch(text) is not None and "<|" not in text
