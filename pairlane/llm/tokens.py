"""Token ids of whole texts with a byte-level BPE, a block of texts at a time.

The BPE splits a text by a pattern into pieces and encodes each piece by itself. In texts
of ASCII and Latin letters the pieces are cut for a whole block at once and each distinct
piece is encoded once per task; every other text is encoded by the library as it stands.
A special token's string within a text becomes that token's id, as the tokenizer file's own
defaults have it. Either way the ids are those of the library for the text.
"""

from __future__ import annotations

import base64

import numpy as np

from pairlane.llm import bytewise as bw

#: Distinct pieces that a task remembers between blocks; it starts afresh beyond that.
REMEMBERED = 400_000

_LETTERS, _DIGITS, _BLANK, _OTHER = 0, 1, 2, 3
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTERS
_KIND[48:58] = _DIGITS
_KIND[[9, 10, 32]] = _BLANK
#: Bytes that send a text to the library: the apostrophe, controls, and all but two-byte Latin letters.
_HARD = np.zeros(256, bool)
_HARD[[39, 127, *range(0, 9), *range(11, 32), *range(0xC0, 0xC3), *range(0xC6, 256)]] = True


def load(ranks_path: str, pattern: str, specials: dict[str, int]):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)


def starts_of_pieces(d: np.ndarray, off: np.ndarray) -> np.ndarray:
    """First bytes of the pieces of easy texts: runs of letters, digits or others with the one space before, and runs of blanks."""
    n = len(d)
    kind = _KIND[d]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    cut = np.ones(n, bool)
    cut[1:] = (kind[1:] != kind[:-1]) | edge[1:n]
    # the last blank before a word leaves its run; if it is a space, it joins the word
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == _BLANK) & (kind[1:] != _BLANK) & ~edge[1:n]
    cut |= last
    joined = np.flatnonzero(last & (d == 32)) + 1
    cut[joined] = False
    return np.flatnonzero(cut)


class Tokens:
    def __init__(self, ranks_path: str, pattern: str, specials: dict[str, int] | None = None):
        self.bpe = load(ranks_path, pattern, specials or {})
        self.specials = [x.encode() for x in specials or {}]
        self.known: dict[int, np.ndarray] = {}

    def _special(self, d: np.ndarray) -> np.ndarray:
        """Where the first two bytes of a special token's string stand; such texts go to the library."""
        out = np.zeros(len(d), bool)
        for x in self.specials:
            if len(x) == 1:
                out |= d == x[0]
            else:
                out[:-1] |= (d[:-1] == x[0]) & (d[1:] == x[1])
        return out

    def _pieces(self, d: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text) of easy texts."""
        start = starts_of_pieces(d, off)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64)
        end = np.r_[start[1:], len(d)]
        hashes = bw.Hasher(d)(start, end)
        distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        raw, known, encode = d.tobytes(), self.known, self.bpe.encode_ordinary
        found = []
        for h, a, b in zip(distinct.tolist(), start[at].tolist(), end[at].tolist(), strict=True):
            ids = known.get(h)
            if ids is None:
                ids = known[h] = np.array(encode(raw[a:b].decode()), np.int32)
            found.append(ids)
        length = np.array([len(x) for x in found])
        flat, begin = np.concatenate(found), np.r_[0, np.cumsum(length)[:-1]]
        each = length[which]
        total = np.r_[0, np.cumsum(each)]
        ids = flat[np.repeat(begin[which] - total[:-1], each) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(start, off)])

    def encode(self, d: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, offsets of the texts in them)."""
        n = len(off) - 1
        bad = _HARD[d] | self._special(d)
        # the multiplication and division signs are no letters
        bad[1:] |= (d[:-1] == 0xC3) & ((d[1:] == 0x97) | (d[1:] == 0xB7))
        hard = bw.per_doc(bad, off) > 0
        if not hard.any():
            ids, size = self._pieces(d, off)
            return ids, np.r_[0, np.cumsum(size)]
        easy = np.flatnonzero(~hard)
        keep = np.repeat(~hard, np.diff(off))
        ids, size = self._pieces(d[keep], np.r_[0, np.cumsum(np.diff(off)[easy])])
        bound = np.r_[0, np.cumsum(size)]
        parts: list[np.ndarray] = [np.zeros(0, np.int32)] * n
        for j, i in enumerate(easy.tolist()):
            parts[i] = ids[bound[j] : bound[j + 1]]
        for i in np.flatnonzero(hard).tolist():
            parts[i] = np.array(self.bpe.encode(d[off[i] : off[i + 1]].tobytes().decode(), allowed_special="all"), np.int32)
        return np.concatenate([np.zeros(0, np.int32), *parts]), np.r_[0, np.cumsum([len(x) for x in parts])]
