"""Token ids of texts with a public tokenizer, one call for each distinct piece of a word.

The tokenizer in use lower-cases, never merges across white space and splits
between letters or digits and what is neither, so a text's ids are those of its
pieces in a row: lower-cased words, cut before the punctuation that ends them.
Pieces repeat; each distinct one of a chunk is encoded once.  The tests hold this
against encoding whole texts.  Texts that may hold a special token (``<|``) are
encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd

from cohortlens.llm.words import Words

#: distinct pieces whose ids a worker remembers
CACHE_PIECES = 400_000
_CLOSING = np.zeros(256, bool)  # ASCII punctuation but for the apostrophe, which begins pieces like 's
_CLOSING[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: lower-cased ASCII and Latin-1 letters only
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
_encoders: dict[int, PieceEncoder] = {}


def pieces(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of words cut before closing punctuation that follows a letter or digit (ASCII or Latin-1)."""
    if not len(w.start):
        return w.start, w.end
    inner = np.where(_CLOSING[w.buf], -1, np.arange(len(w.buf)))
    last = np.maximum.accumulate(inner)[w.end - 1]  # last byte of the word that is not closing
    byte, before = w.buf[last], w.buf[last - 1]
    latin = (before == 0xC3) & (byte >= 0x80) & (byte != 0x97) & (byte != 0xB7) & (last > w.start)
    cut = (last >= w.start) & (last < w.end - 1) & (_ALNUM[byte] | latin)
    return np.sort(np.concatenate([w.start, last[cut] + 1])), np.sort(np.concatenate([w.end, last[cut] + 1]))


class PieceEncoder:
    def __init__(self, definition: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.cache_pieces = cache_pieces

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each text."""
        out = []
        for at in range(0, len(texts), 4096):
            found = self.tokenizer.encode_batch_fast([x.decode() for x in texts[at:at + 4096]], add_special_tokens=False)
            out += [np.array(e.ids, np.uint32).tobytes() for e in found]
        return out

    def _learn(self, new: list[bytes]) -> None:
        """Encode pieces; plain letters go many to a call, told apart by the ids that end a word."""
        simple = [x for x in new if _LETTERS(x)]
        for at in range(0, len(simple), 1000):
            part = simple[at:at + 1000]
            line = b" ".join(part).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32)
            ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            if len(ends) != len(part):  # not this kind of vocabulary
                self.known.update(zip(part, self._ids(part), strict=True))
                continue
            raw, a = ids.tobytes(), 0
            for x, b in zip(part, ends, strict=True):
                self.known[x] = raw[4 * a:4 * b]
                a = b
        rest = [x for x in new if x not in self.known]
        self.known.update(zip(rest, self._ids(rest), strict=True))

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        whole = [i for i, t in enumerate(texts) if t and b"<|" in t]
        if whole:
            return self._with_specials(texts, whole)
        w = Words(texts, lower=True, hashes=False)
        start, end = pieces(w)
        code, firsts = _distinct(w.span_hash(start, end))
        raw = w.buf.tobytes()
        distinct = [raw[a:b] for a, b in zip(start[firsts].tolist(), end[firsts].tolist(), strict=True)]
        if len(self.known) > self.cache_pieces:
            self.known.clear()
        new = [x for x in distinct if x not in self.known]
        self._learn(new)
        packed = [self.known[x] for x in distinct]
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        table = np.frombuffer(b"".join(packed), np.uint32)
        n = size[code]
        ends = np.cumsum(n)
        place = np.repeat((np.cumsum(size) - size)[code] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        upto = np.concatenate([[0], ends])[np.searchsorted(start, w.at)]
        return table[place], np.diff(upto)

    def _with_specials(self, texts: list[bytes | None], whole: list[int]) -> tuple[np.ndarray, np.ndarray]:
        ids, n = self.encode([None if t and b"<|" in t else t for t in texts])
        each = np.split(ids, np.cumsum(n)[:-1])
        for i, found in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
            each[i] = np.frombuffer(found, np.uint32)
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each one's group, first place of each group)."""
    code, _ = pd.factorize(hashes)
    firsts = np.full(code.max() + 1 if len(code) else 0, -1, np.int64)
    firsts[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return code, firsts


def encoder(definition: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer definition."""
    key = hash(definition)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PieceEncoder(definition)
    return _encoders[key]
