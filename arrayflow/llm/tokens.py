"""Token ids of texts by a public tokenizer's file, a word at a time with a bounded cache.

The pre-tokenizers of the supported files join no character to ASCII white space that follows it, and no letter to the
plain punctuation that follows it. A text may therefore be cut at these places, and the ids of the pieces are the ids of
the text. Pieces are found and told apart in numpy for many texts at once, so that each distinct one is looked up once. New
pieces are encoded many at a time, as one string: letters after a space one after the other, where the lengths of
the tokens tell the pieces apart, and other pieces between added tokens. A text that holds an added token's string, such as ``<|endoftext|>``, is encoded as a whole, so that the string
becomes that token's id as the library's default has it.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Sequence
from itertools import islice, pairwise

import numpy as np

from arrayflow.llm.shingles import xx_long

_SPACE, _LETTER = r"\x20\x09-\x0D", "A-Za-zÀ-ÖØ-öø-ÿ"
# Where texts are cut: letters with the white space before them and white space or plain punctuation after them, else what stands
# between white space, with the white space before it.
_IS_SPACE, _IS_PUNCTUATION = (np.isin(np.arange(256), list(b)) for b in (b" \t\n\x0b\x0c\r", b".,;:!?|"))
_IS_LETTER = np.isin(np.arange(256), [b for b in range(128) if chr(b).isalpha()])
#: The letters beyond ASCII are this byte and one of these.
_LEAD, _IS_SECOND = 0xC3, np.isin(np.arange(256), [b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)])
#: Bytes up to which pieces are compared as two numbers.
_SHORT = 16
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
# Other white space may be joined to ASCII white space; such a text is encoded as a whole.
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACED = re.compile(rf" [{_LETTER}]+").fullmatch
_LONGEST_CACHED = 64
#: Characters whose pieces are held at once.
_AT_ONCE = 1 << 21
_PIECES_AT_ONCE, _JOINED = 512, 64
_LITTLE = [struct.Struct(f"<{n}I").pack for n in range(16)]


def _starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the pieces of texts start that lie one after the other in ``data``; ``edges`` are the places of the texts."""
    size = len(data)
    opens = np.zeros(size + 1, bool)
    opens[edges] = True
    opens = opens[:size]
    space, letter = _IS_SPACE[data], _IS_LETTER[data]
    pair = (data[:-1] == _LEAD) & _IS_SECOND[data[1:]]
    letter[:-1] |= pair
    letter[1:] |= pair
    after = opens.copy()  # white space before, or the start of a text
    after[1:] |= space[:-1]
    stop = np.append(np.flatnonzero(~letter | opens), size)
    first = np.flatnonzero(after & letter)
    ends = stop[np.searchsorted(stop, first, side="right")]
    ends = ends[ends < size]
    starts = opens.copy()
    starts[1:] |= space[1:] & ~space[:-1]
    starts[ends[_IS_PUNCTUATION[data[ends]]]] = True
    return np.flatnonzero(starts)


def _distinct(texts: list[bytes], short: int = _SHORT) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct pieces of texts, for every piece the place of its like among those, and the number of pieces of each text."""
    raw = b"".join(texts)
    if not raw:
        return [], np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts = _starts(np.frombuffer(raw, np.uint8), edges)
    ends = np.append(starts[1:], len(raw))
    numbers, size = np.empty(len(starts), np.int64), ends - starts
    # Short pieces are equal if their bytes, as two numbers, and their lengths are; a hash of these brings equal ones together.
    few = np.flatnonzero(size <= short)
    at, n = starts[few], size[few]
    eights = np.ndarray((len(raw) + 9,), "<u8", raw + bytes(16), strides=(1,))
    low, high = eights[at] & _MASKS[np.minimum(n, 8)], eights[at + np.minimum(n, 8)] & _MASKS[np.clip(n - 8, 0, 8)]
    hashes = xx_long(high, xx_long(low, n.astype(np.uint64)))
    order = np.argsort(hashes)
    new = np.concatenate([[True], np.diff(hashes[order]) != 0])[:len(few)]
    group = np.cumsum(new) - 1
    heads = order[new]
    if any((c[order] != c[heads][group]).any() for c in (low, high, n)):
        return _distinct(texts, 0)  # two pieces share a hash
    numbers[few[order]] = group
    pieces = [raw[a:b] for a, b in zip(at[heads].tolist(), (at + n)[heads].tolist(), strict=True)]
    others: dict[bytes, int] = {}
    many = np.flatnonzero(size > short)
    numbers[many] = [others.setdefault(raw[a:b], len(pieces) + len(others))
                     for a, b in zip(starts[many].tolist(), ends[many].tolist(), strict=True)]
    return pieces + list(others), numbers, np.diff(np.searchsorted(starts, edges))


class Encoder:
    """Encodes batches of texts; each result is the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cached: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        added = self._tokenizer.get_added_tokens_decoder().values()
        if any(token.normalized for token in added):
            raise ValueError(f"{path}: added tokens that are looked for in the normalized text are not supported")
        self._added = [token.content for token in added]
        # Bytes that a token stands for, with its white space if the pre-tokenizer keeps that.
        suffix, vocabulary = getattr(self._tokenizer.model, "end_of_word_suffix", None) or "", self._tokenizer.get_vocab()
        self._bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self._bytes[list(vocabulary.values())] = [len(token.removesuffix(suffix)) for token in vocabulary]
        self._space = int(self._bytes[self._tokenizer.encode(" a", add_special_tokens=False).ids].sum()) - 1
        alone = [t.content for t in added if not (t.lstrip or t.rstrip or t.single_word)]
        self._separator = alone[0] if alone else None
        self._separator_id = self._tokenizer.token_to_id(alone[0]) if alone else -1
        # Ids of pieces, and the pieces that more than one group of texts had since the cache was last full.
        self._cached, self._known, self._again = cached, {}, set()

    def _plain(self, texts: Sequence[str]) -> list[bytes]:
        out = []
        # Few encodings at once: they are read while they are in the processor's cache.
        for low in range(0, len(texts), _PIECES_AT_ONCE):
            encoded = self._tokenizer.encode_batch_fast(texts[low:low + _PIECES_AT_ONCE], add_special_tokens=False)
            out += [_LITTLE[n](*ids) if (n := len(ids := e.ids)) < len(_LITTLE) else np.array(ids, "<u4").tobytes() for e in encoded]
        return out

    def _together(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that hold no added token: all letters after a space, or none such."""
        letters, out = bool(pieces) and _SPACED(pieces[0]) is not None, []
        if not letters and self._separator is None:
            return self._plain(pieces)
        between = "" if letters else self._separator
        runs = [pieces[low:low + _JOINED] for low in range(0, len(pieces), _JOINED)]
        for low in range(0, len(runs), _PIECES_AT_ONCE // _JOINED):
            some = runs[low:low + _PIECES_AT_ONCE // _JOINED]
            for run, encoded in zip(some, self._tokenizer.encode_batch_fast([between.join(r) for r in some], add_special_tokens=False), strict=True):
                ids = np.array(encoded.ids, "<u4")
                if letters:
                    ends = np.cumsum(self._bytes[ids])
                    wanted = np.cumsum([len(p.encode()) - 1 + self._space for p in run])
                    cuts = np.searchsorted(ends, wanted) + 1
                    told = cuts[-1] == len(ids) and (ends[cuts - 1] == wanted).all()
                    firsts, cuts = [0, *cuts[:-1].tolist()], cuts.tolist()
                else:
                    cuts = np.flatnonzero(ids == self._separator_id).tolist()
                    told = len(cuts) == len(run) - 1
                    firsts, cuts = [0, *(c + 1 for c in cuts)], [*cuts, len(ids)]
                data = ids.tobytes()
                out += [data[4 * a:4 * b] for a, b in zip(firsts, cuts, strict=True)] if told else self._plain(run)
        return out

    def _whole(self, text: str) -> bool:
        return _OTHER_SPACE.search(text) is not None or any(token in text for token in self._added)

    def __call__(self, texts: Sequence[str]) -> list[bytes]:
        out, held, size = [], [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= _AT_ONCE:
                out += self._group(held)
                held, size = [], 0
        return out + self._group(held)

    def _group(self, texts: Sequence[str]) -> list[bytes]:
        whole = [self._whole(t) for t in texts]
        plain = [t.encode() for t, w in zip(texts, whole, strict=True) if not w]
        pieces, numbers, counts = _distinct(plain)
        known = self._known
        ids = list(map(known.get, pieces))
        new = [p for p, d in zip(pieces, ids, strict=True) if d is None]
        self._again.update(p for p, d in zip(pieces, ids, strict=True) if d is not None)
        told = [p.decode() for p in new]
        spaced = [_SPACED(t) is not None for t in told]
        for kind in (True, False):
            some = [i for i, s in enumerate(spaced) if s is kind]
            known.update(zip([new[i] for i in some], self._together([told[i] for i in some]), strict=True))
        ids = [known[p] if d is None else d for p, d in zip(pieces, ids, strict=True)]
        # The ids of the distinct pieces, taken in the order of all pieces.
        pool, sizes = np.frombuffer(b"".join(ids), "<u4"), np.array([len(d) // 4 for d in ids], np.int64)
        own = sizes[numbers]
        ends = np.cumsum(own)
        data = pool[np.repeat((np.cumsum(sizes) - sizes)[numbers] - ends + own, own) + np.arange(len(pool) and ends[-1])].tobytes()
        cuts = [0, *(4 * np.concatenate([[0], ends])[np.cumsum(counts)]).tolist()]
        parts = iter([data[a:b] for a, b in pairwise(cuts)])
        alone = iter(self._plain([t for t, w in zip(texts, whole, strict=True) if w]))
        out = [next(alone if w else parts) for w in whole]
        for piece, text in zip(new, told, strict=True):
            if len(text) > _LONGEST_CACHED:
                del known[piece]
        if len(known) > self._cached:
            self._forget()
        return out

    def _forget(self) -> None:
        """Keep the pieces that were used again, at most half of the cache, so that rare ones make room for new ones."""
        again = [p for p in self._again if p in self._known]
        self._known = {p: self._known[p] for p in islice(again, self._cached // 2)}
        self._again = set()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of ``path`` in this Python process, loaded once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
