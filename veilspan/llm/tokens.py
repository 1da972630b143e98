"""Token ids of whole texts, with each distinct space-parted piece encoded once.

Both vocabularies part a text at white space before they merge, so a text's ids are the ids of its
pieces one after another. Encoding distinct pieces only and joining their stored ids gives the same
ids many times faster. Texts that hold one of the vocabulary's special strings are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: White space as Unicode lists it (Python's \\s has four control characters more).
WHITE = "\t-\r \x85\xa0  -     　"
#: White space dropped, and white space kept with one space leading a word.
DROPPED, LEADING = f"[^{WHITE}]+", f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Characters that str.split parts at besides.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Pieces held between batches, and the longest piece held.
HELD_PIECES, HELD_LENGTH = 700_000, 40
#: Pieces encoded in one call, and characters of text worked on at once.
JOINED, TEXT_AT_ONCE = 100, 1_000_000


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids; `pieces` is DROPPED or LEADING."""

    def __init__(self, path: str, pieces: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = re.compile(pieces).findall
        self.dropped = pieces == DROPPED
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        vocabulary = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        #: Bytes that each token stands for: byte-level tokens have one character a byte.
        self.sizes = np.array([len(t.removesuffix(suffix)) for t in vocabulary], np.int64)
        self.held: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids straight from the tokenizer."""
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of some plain pieces (printable ASCII), which are encoded many to a text. A token's
        size tells where pieces end; pieces for which the sizes do not add up are encoded apart."""
        out: list[bytes] = []
        for at in range(0, len(pieces), JOINED):
            some = pieces[at : at + JOINED]
            text = " ".join(some) if self.dropped else "".join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            wanted, reached = np.cumsum([len(p) for p in some]), np.cumsum(self.sizes[ids])
            ends = np.searchsorted(reached, wanted)
            if ends[-1] == len(ids) - 1 and np.array_equal(reached[ends], wanted):
                data = ids.tobytes()
                out += [data[4 * a : 4 * b] for a, b in zip([0, *(ends[:-1] + 1).tolist()], (ends + 1).tolist(), strict=True)]
            else:
                out += self.apart(some)
        return out

    def _plain(self, piece: str) -> bool:
        """Whether a piece can be encoded together with others."""
        return piece.isascii() and (piece.isprintable() if self.dropped else piece[0] == " " and piece[1:].isprintable() and piece[1:2] > " ")

    def apart(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece. Pieces free of special strings are encoded many to a text, parted by
        a special string, whose id occurs nowhere else."""
        mark = self.special[-1]
        number = self.tokenizer.token_to_id(mark)
        out: list[bytes] = []
        for at in range(0, len(pieces), JOINED):
            some = pieces[at : at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([mark.join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == number)
            data = ids.tobytes()
            out += [data[4 * a : 4 * b] for a, b in zip([0, *(ends + 1)], [*ends, len(ids)], strict=True)]
        return out

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text."""
        waiting: list[str] = []
        size = 0
        for text in texts:
            waiting.append(text or "")
            size += len(waiting[-1])
            if size >= TEXT_AT_ONCE:
                yield from self._encode(waiting)
                waiting, size = [], 0
        yield from self._encode(waiting)

    def _encode(self, texts: list[str]) -> list[bytes]:
        odd = {i for i, text in enumerate(texts) if any(s in text for s in self.special)}
        find = str.split if self.dropped and not any(c in text for text in texts for c in SEPARATORS) else self.find
        ends, pieces = [], []
        for i, text in enumerate(texts):
            if i not in odd:
                pieces += find(text)
            ends.append(len(pieces))
        found = list(map(self.held.get, pieces))
        lacking = [i for i, ids in enumerate(found) if ids is None]
        learned = self._learn(list(dict.fromkeys([pieces[i] for i in lacking])))
        for i in lacking:
            found[i] = learned[pieces[i]]
        return [self.whole([text])[0] if i in odd else b"".join(found[a:b]) for i, (text, a, b) in enumerate(zip(texts, [0, *ends], ends, strict=False))]

    def _learn(self, distinct: list[str]) -> dict[str, bytes]:
        """Ids of pieces not held, which then are."""
        learned = {p: self.older[p] for p in distinct if p in self.older}
        if fresh := [p for p in distinct if p not in learned]:
            plain = [p for p in fresh if self._plain(p)]
            learned.update(zip(plain, self.together(plain), strict=True))
            if other := [p for p in fresh if p not in learned]:
                learned.update(zip(other, self.apart(other), strict=True))
        self.held.update((p, ids) for p, ids in learned.items() if len(p) <= HELD_LENGTH)
        if len(self.held) > HELD_PIECES:  # what is not met again while the next lot is gathered goes
            self.older, self.held = self.held, {}
        return learned


@lru_cache(maxsize=4)
def encoder(path: str, pieces: str) -> Encoder:
    """The process's encoder of a vocabulary; what it holds serves later tasks too."""
    return Encoder(path, pieces)
