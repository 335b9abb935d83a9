"""Word BPE by the tokenizers library, each distinct piece of a batch once.

Texts are cut, as flat bytes, where the tokenizer's own rules never look across: at blanks, next to a digit, and between
ASCII letters (or Latin-1 letters) and ASCII marks. Apostrophes and other non-ASCII bytes are never cut from their
neighbours, as contractions, compositions and unknown letters may go across. ASCII letters are lower-cased first, as
the tokenizer does. Pieces of one kind of ASCII go straight to the library's model, others through all of its steps.
Texts that hold one of the tokenizer's added tokens (such as `<|endoftext|>`) go through the library whole.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa

from .common import FORGET, TokenPool, binary_array, codes_of, flat

VOCABULARY = "word_bpe_49k.json"
KEPT_PIECES, KEPT_LENGTH = 400_000, 64

_BLANK, _LETTER, _DIGIT, _MARK, _JOINS = range(5)
_KIND = np.full(256, _JOINS, np.uint8)
_KIND[:128] = _MARK
_KIND[[9, 10, 11, 12, 13, 32]] = _BLANK
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[39] = _JOINS
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def split_values(values: pa.Array) -> list[bytes]:
    """The values, none of which holds a blank or is empty."""
    body, offsets = flat(values)
    if len(offsets) < 2:
        return []
    out = np.full(len(body) + len(offsets) - 2, 32, np.uint8)
    size = np.diff(offsets)
    out[np.arange(len(body)) + np.repeat(np.arange(len(size)), size)] = body
    return out.tobytes().split(b" ")


class WordBPE:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # looked for in ASCII lower case, as they may be matched after the tokenizer's own lower-casing
        self.added = sorted({t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.pool = TokenPool(KEPT_PIECES)

    def _pieces(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes without blanks, the pieces' offsets in them, and the number of pieces before each text (len + 1)."""
        kind = _KIND[body]
        latin = np.flatnonzero((body[:-1] == 0xC3) & (body[1:] != 0x97) & (body[1:] != 0xB7))
        kind[latin] = kind[latin + 1] = _LETTER
        one, two = kind[:-1], kind[1:]
        cut = np.ones(len(body), bool)
        cut[1:] = (one != two) & (one != _JOINS) & (two != _JOINS) | (one == _BLANK) | (two == _BLANK) | (one == _DIGIT) & (two == _DIGIT)
        cut[offsets[:-1][offsets[:-1] < len(body)]] = True
        solid = kind != _BLANK
        starts = np.flatnonzero(cut & solid)
        before = np.concatenate([[0], np.cumsum(solid)])
        return _LOWER[body[solid]], np.append(before[starts], before[-1]), np.searchsorted(starts, offsets)

    def _with_added(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The numbers of the texts in which an added token may stand."""
        lowered, found = _LOWER[body].tobytes(), []
        for token in self.added:
            at = lowered.find(token)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, "right")) - 1
                found.append(text)
                # what begins in this text and ends in the next one is no token, but does no harm
                at = lowered.find(token, max(at + 1, int(offsets[text + 1]) - len(token) + 1))
        return np.unique(np.array(found, np.int64))

    def encode(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts body[offsets[i]:offsets[i + 1]] one after another, and the number of ids before each text (len + 1)."""
        whole = self._with_added(body, offsets)
        if not len(whole):
            return self._encode(body, offsets)
        rest, sizes = body.copy(), np.zeros(len(offsets) - 1, np.int64)
        for i in whole:
            rest[offsets[i] : offsets[i + 1]] = 32
        ids, starts = self._encode(rest, offsets)
        said = self.tokenizer.encode_batch_fast([body[offsets[i] : offsets[i + 1]].tobytes().decode() for i in whole], add_special_tokens=False)
        sizes[whole] = [len(x.ids) for x in said]
        own = np.repeat(np.isin(np.arange(len(sizes)), whole), sizes + np.diff(starts))
        out = np.empty(len(own), ids.dtype)
        out[~own], out[own] = ids, np.concatenate([np.array(x.ids, ids.dtype) for x in said])
        return out, starts + np.concatenate([[0], np.cumsum(sizes)])

    def _encode(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without added tokens."""
        self.pool.trim()
        packed, at, before = self._pieces(body, offsets)
        codes, distinct = codes_of(binary_array(packed, at))
        pieces = split_values(distinct)
        known, model = self.pool.known, self.tokenizer.model
        numbers = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        hard = []
        for i in np.flatnonzero(numbers < 0).tolist():
            piece = pieces[i]
            if piece.isascii() and b"'" not in piece and (text := piece.decode()).isprintable():
                numbers[i] = self.pool.add(piece, [t.id for t in model.tokenize(text)], len(piece) <= KEPT_LENGTH)
            else:
                hard.append(i)
        if hard:
            for i, found in zip(hard, self.tokenizer.encode_batch_fast([pieces[i].decode() for i in hard], add_special_tokens=False), strict=True):
                numbers[i] = self.pool.add(pieces[i], found.ids, len(pieces[i]) <= KEPT_LENGTH)
        ids, ends = self.pool.gather(numbers[codes] if len(codes) else np.zeros(0, np.int64))
        return ids, ends[before]


_CODERS: dict[str, WordBPE] = {}
FORGET.append(_CODERS.clear)


def coder(name: str = VOCABULARY) -> WordBPE:
    """Each worker reads a vocabulary once."""
    import os

    import public_tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks have a core each
    if name not in _CODERS:
        _CODERS[name] = WordBPE(public_tokenizers.path(name))
    return _CODERS[name]


def with_end(ids: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an id after each text."""
    n = len(starts) - 1
    out = np.empty(len(ids) + n, ids.dtype)
    mark = np.zeros(len(out), bool)
    mark[starts[1:] + np.arange(n)] = True
    out[mark], out[~mark] = end, ids
    return out, starts + np.arange(n + 1)
