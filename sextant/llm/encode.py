"""Token ids by the tokenizers library, a block of texts at a time.

Both vocabularies cut a text into pre-tokens by a pattern and merge inside one
pre-token only, so a text's ids are its pre-tokens' ids in turn. Cutting is
done on arrays of code points; the library's model encodes each pre-token that the
bounded memo lacks (found by a 64-bit fingerprint). A text that holds a special
string, or a character whose class is not beyond doubt, goes to the library whole.
"""

from __future__ import annotations

import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import regex

from .common import U64, mix64, _powers, _BASE, _INV

# The pre-token patterns, as the vocabulary files state them.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SURE = regex.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\xffŒœŠš–—‘-„…€]")
_TOP = 0x3000
LETTER, NUMBER, SPACE, OTHER, DOUBT, EDGE = range(6)
MEMO_ENTRIES = 750_000
MEMO_SLOTS = 1 << 21
BLOCK_CHARS = 1 << 18


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> np.ndarray:
    kinds = np.full(_TOP + 1, DOUBT, dtype=np.uint8)
    for c in range(_TOP):
        ch = chr(c)
        if _SURE.match(ch):
            kinds[c] = LETTER if regex.match(r"\p{L}", ch) else NUMBER if regex.match(r"\p{N}", ch) else SPACE if ch.isspace() else OTHER
    return kinds


_KINDS = _classes()
_CHAR_KEYS = np.random.default_rng(771).integers(0, 2**63, _TOP + 1, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def byte_alphabet() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids of whole texts, without added special tokens."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lower = "Lowercase" in str(self.tokenizer.normalizer)
        self.alphabet = byte_alphabet()
        self._clear()
        # Array cutting is used only where it agrees with the library on a probe.
        probe = "I'll  don't ''s 'start's 12 3\n\n x'd\n't!?--'re  é½²'ve\t "
        self.sure = True
        self.sure = self._cut_block([probe])[0].tolist() == self.whole(probe).tolist()

    def _clear(self) -> None:
        self.keys = np.zeros(MEMO_SLOTS, dtype=U64)
        self.at = np.zeros(MEMO_SLOTS, dtype=np.uint32)
        self.size = np.zeros(MEMO_SLOTS, dtype=np.uint32)
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.used = self.entries = 0

    def whole(self, text: str) -> np.ndarray:
        """By one call of the library."""
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as uint32; a null text has none."""
        out: list[np.ndarray | None] = [None] * len(texts)
        block: list[int] = []
        chars = 0
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.zeros(0, np.uint32)
            elif not self.sure or ("<|" in t and any(s in t for s in self.specials)):
                out[i] = self.whole(t)
            else:
                block.append(i)
                chars += len(t)
                if chars >= BLOCK_CHARS:
                    self._fill(out, texts, block)
                    block, chars = [], 0
        self._fill(out, texts, block)
        return out  # type: ignore[return-value]

    def _fill(self, out: list, texts: list, block: list[int]) -> None:
        if not block:
            return
        if self.entries > MEMO_ENTRIES:
            self._clear()
        for i, ids in zip(block, self._cut_block([texts[i] for i in block]), strict=True):
            out[i] = self.whole(texts[i]) if ids is None else ids

    def _cut_block(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids by arrays; None for a text with a doubtful character. No text is empty."""
        joined = "".join(texts)
        first = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in texts], out=first[1:])
        cp = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4"), _TOP)
        kind = _KINDS[cp]
        doubt = np.maximum.reduceat(kind == DOUBT, first[:-1])
        if doubt.any():
            keep = [t for t, d in zip(texts, doubt, strict=True) if not d]
            done = iter(self._cut_block(keep) if keep else [])
            return [None if d else next(done) for d in doubt]
        if self.lower:
            joined = joined.lower()
            cp = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        lo, hi = self._spans(cp, kind, first)
        keys = np.zeros(len(cp) + 1, dtype=U64)
        np.cumsum(_CHAR_KEYS[cp] * _powers(_BASE, len(cp)), out=keys[1:])
        h = mix64((keys[hi] - keys[lo]) * _powers(_INV, len(keys))[lo]) | U64(1)
        slot = self._find(h)
        miss = np.flatnonzero(self.keys[slot] != h)
        if len(miss):
            _, one = np.unique(h[miss], return_index=True)
            new = miss[one]
            self._learn(h[new], [joined[a:b] for a, b in zip(lo[new].tolist(), hi[new].tolist(), strict=True)])
            slot[miss] = self._find(h[miss])
        size = self.size[slot].astype(np.int64)
        end = np.cumsum(size)
        flat = self.pool[np.repeat(self.at[slot] - (end - size), size) + np.arange(end[-1] if len(end) else 0)]
        ends = np.concatenate([[0], end])[np.searchsorted(lo, first)]
        return [flat[ends[i] : ends[i + 1]] for i in range(len(texts))]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each fingerprint, or the free slot where it would go."""
        mask = U64(MEMO_SLOTS - 1)
        slot = (h >> U64(17)) & mask
        todo = np.flatnonzero((self.keys[slot] != h) & (self.keys[slot] != 0))
        while len(todo):
            slot[todo] = (slot[todo] + U64(1)) & mask
            k = self.keys[slot[todo]]
            todo = todo[(k != h[todo]) & (k != 0)]
        return slot.astype(np.int64)

    def _learn(self, h: np.ndarray, words: list[str]) -> None:
        """Put distinct new fingerprints and their ids into the memo."""
        made = [[t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(self.alphabet))] for w in words]
        size = np.asarray([len(x) for x in made], dtype=np.int64)
        at = self.used + np.cumsum(size) - size
        self.used += int(size.sum())
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), self.used - len(self.pool)), np.uint32)])
        self.pool[self.used - int(size.sum()) : self.used] = [i for x in made for i in x]
        self.entries += len(words)
        todo = np.arange(len(h))
        while len(todo):  # one of those that want the same free slot gets it
            slot, pick = np.unique(self._find(h[todo]), return_index=True)
            put = todo[pick]
            self.keys[slot], self.at[slot], self.size[slot] = h[put], at[put], size[put]
            todo = np.delete(todo, pick)

    def _spans(self, cp: np.ndarray, kind: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pre-token spans; they never cross from one text to the next."""
        n = len(cp)
        before = np.empty(n, np.uint8)
        before[1:] = kind[:-1]
        before[first[:-1]] = EDGE
        cut = kind != before
        if self.lower:
            cut |= kind == NUMBER
            begins = before != OTHER
        else:
            after = np.empty(n, np.uint8)
            after[:-1] = kind[1:]
            after[first[1:] - 1] = EDGE
            space = kind == SPACE
            cut |= space & (after != SPACE) & (after != EDGE)
            blank = np.zeros(n, bool)
            blank[1:] = cp[:-1] == 32
            blank &= before == SPACE
            cut &= ~(blank & ~space)
            begins = (before != OTHER) & ~blank
        mark = np.flatnonzero((cp == 39) & begins)
        if len(mark):  # contractions
            stop = first[np.searchsorted(first, mark, side="right")]
            nxt = lambda k: np.where(mark + k < stop, cp[np.minimum(mark + k, n - 1)], 0)
            a, b = nxt(1), nxt(2)
            ch = ord
            two = ((a == ch("r")) | (a == ch("v"))) & (b == ch("e")) | (a == ch("l")) & (b == ch("l"))
            one = np.isin(a, [ch("s"), ch("t"), ch("m"), ch("d")])
            for hit, size in ((one, 2), (two, 3)):
                at = mark[hit]
                cut[at + 1] = False
                end = at + size
                cut[end[end < stop[hit]]] = True
        lo = np.flatnonzero(cut)
        hi = np.append(lo[1:], n)
        if self.lower:
            keep = kind[lo] != SPACE
            lo, hi = lo[keep], hi[keep]
        return lo, hi


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker, kept over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
