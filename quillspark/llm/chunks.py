"""Splits texts at single spaces, where byte-level pre-tokenizers always split, and keeps the ids of chunks seen.

A boundary before a space is one of the pre-tokenizer too if the character before is no white space or the one
after is none: no piece reaches over it. Texts with a space between white space on both sides go through the
pattern as a whole. So the ids are those of the whole text, and frequent chunks are encoded once per worker.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))

#: Signs that end a word without belonging to its piece; no apostrophe, which contractions begin with.
SIGNS = ".,!?;:#*$%&|)]}\""
#: By code point: white space; the last element stands for all that follow.
_IS_WHITE = np.zeros(0x3002, bool)
_IS_WHITE[[ord(x) for x in WHITE]] = True


def pattern(p: str) -> regex.Pattern:
    """The pre-tokenizer's pattern with white space as Unicode's White_Space property has it."""
    return regex.compile(p.replace(r"[^\s", f"[^{WS}").replace(r"(?!\S)", f"(?![^{WS}])").replace(r"\s", f"[{WS}]"))


class ChunkCache:
    """Ids of chunks. encode gets distinct strings and returns all their ids one after another, and how many each has.

    most: so many chunks are kept; beyond it those seen least go, which costs time and changes no result. Arrays grow by
    doubling; the first n (or n_flat) elements are in use.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], pat: str, most: int = 400_000):
        self.encode, self.pat, self.most = encode, pattern(pat), most
        # chunks with a space before them, and those without
        self.spaced: dict[str, int] = {}
        self.bare: dict[str, int] = {}
        self.n = self.n_flat = 0
        self.flat = np.zeros(1 << 12, np.int32)
        self.start, self.size, self.seen = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        # begins (or ends) with white space; empty: both
        self.opens, self.closes = np.zeros(1 << 12, bool), np.zeros(1 << 12, bool)

    def _add(self, spaced: list[str], bare: list[str]) -> None:
        if spaced or bare:
            flat, size = self.encode([" " + x for x in spaced] + bare)
            self._keep(spaced, bare, size, flat)

    def _room(self, name: str, used: int, more: int) -> np.ndarray:
        old = getattr(self, name)
        if used + more > len(old):
            new = np.zeros(max(2 * len(old), used + more), old.dtype)
            new[:used] = old[:used]
            setattr(self, name, new)
            return new
        return old

    def _keep(self, spaced: list[str], bare: list[str], size: np.ndarray, flat: np.ndarray) -> None:
        n, k = self.n, len(size)
        m = n + len(spaced)
        self.spaced.update(zip(spaced, range(n, m), strict=True))
        self.bare.update(zip(bare, range(m, n + k), strict=True))
        opens, closes = _white_ends(spaced)
        self._room("opens", n, k)[n : n + k] = np.append(opens, np.fromiter((not x or x[0] in WHITE for x in bare), bool, len(bare)))
        self._room("closes", n, k)[n : n + k] = np.append(closes, np.fromiter((not x or x[-1] in WHITE for x in bare), bool, len(bare)))
        self._room("start", n, k)[n : n + k] = self.n_flat + np.cumsum(size) - size
        self._room("size", n, k)[n : n + k] = size
        self._room("seen", n, k)[n : n + k] = 0
        self._room("flat", self.n_flat, len(flat))[self.n_flat : self.n_flat + len(flat)] = flat
        self.n, self.n_flat = n + k, self.n_flat + len(flat)

    def _forget(self) -> None:
        n = self.n
        keep = np.zeros(n, bool)
        keep[np.argsort(-self.seen[:n], kind="stable")[: self.most // 2]] = True
        new = np.cumsum(keep) - 1
        for name in ("spaced", "bare"):
            old = getattr(self, name)
            setattr(self, name, {x: int(new[k]) for x, k in old.items() if keep[k]})
        size = self.size[:n][keep]
        flat = gather(self.flat, self.start[:n][keep], size.astype(np.int64))
        self.n, self.n_flat = len(size), len(flat)
        self.flat[: self.n_flat] = flat
        for name in ("opens", "closes"):
            getattr(self, name)[: self.n] = getattr(self, name)[:n][keep]
        self.seen[: self.n] = self.seen[:n][keep] // 2
        self.size[: self.n] = size
        self.start[: self.n] = np.cumsum(size, dtype=np.int64) - size

    def _codes(self, known: dict[str, int], chunks: list[str], spaced: bool) -> np.ndarray:
        code = np.fromiter(map(known.get, chunks, repeat(-1)), np.int64, len(chunks))
        miss = np.flatnonzero(code < 0)
        if len(miss):
            asked = [chunks[k] for k in miss.tolist()]
            new = list(dict.fromkeys(asked))
            self._add(new if spaced else [], [] if spaced else new)
            code[miss] = np.fromiter(map(known.__getitem__, asked), np.int64, len(miss))
        return code

    def _parts(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the parts of chunks with a space before them, one after another, and how many each has.

        Letters and then signs are two parts; a line's end between signs that are no white space parts the lines. So words
        are kept, and not each of their forms.
        """
        stem = pc.utf8_rtrim(chunks, SIGNS)
        cut = pc.binary_length(chunks).to_numpy() - pc.binary_length(stem).to_numpy()
        signed = (cut > 0) & pc.utf8_is_alpha(stem).to_numpy(zero_copy_only=False)
        in_lines, lines = [], []
        ended = pc.match_substring(chunks, "\n")
        for k, x in zip(np.flatnonzero(ended.to_numpy(zero_copy_only=False)).tolist(), _strings(chunks.filter(ended)), strict=True):
            if (own := x.split("\n")) == x.split():
                in_lines.append(k)
                lines.append([*_signs_off(own[0]), *(y for z in own[1:] for y in ("\n", *_signs_off(z)))])
        n = np.where(signed, 2, 1)
        n[in_lines] = [len(x) for x in lines]
        at = np.cumsum(n) - n
        parts = np.zeros(int(n.sum()), np.int64)
        other = np.ones(len(n), bool)
        other[in_lines] = False
        words = pc.if_else(pa.array(signed), stem, chunks).filter(pa.array(other)).dictionary_encode()
        parts[at[other]] = self._codes(self.spaced, _strings(words.dictionary), True)[words.indices.to_numpy()]
        signs = [x[-k:] for x, k in zip(_strings(chunks.filter(pa.array(signed))), cut[signed].tolist(), strict=True)]
        parts[at[signed] + 1] = self._codes(self.bare, signs, False)
        if lines:
            parts[at[in_lines]] = self._codes(self.spaced, [x[0] for x in lines], True)
            rest = n[in_lines] - 1
            later = np.repeat(at[in_lines] + 1 - (np.cumsum(rest) - rest), rest) + np.arange(int(rest.sum()))
            parts[later] = self._codes(self.bare, [y for x in lines for y in x[1:]], False)
        return parts, n

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each has. None counts as empty."""
        if self.n > self.most:
            self._forget()
        # split and made distinct outside Python, so that a chunk is looked up once a batch and not at each place
        parts = pc.split_pattern(pa.array(["" if t is None else t for t in texts], pa.string()), " ")
        at = parts.offsets.to_numpy().astype(np.int64)
        first, per, words = at[:-1] - at[0], np.diff(at), parts.flatten()
        is_head = np.zeros(len(words), bool)
        is_head[first] = True
        heads, rest = _strings(words.filter(pa.array(is_head))), words.filter(pa.array(~is_head)).dictionary_encode()
        head, of = self._codes(self.bare, heads, False), rest.indices.to_numpy()
        part, n_parts = self._parts(rest.dictionary)
        part_at = np.cumsum(n_parts) - n_parts
        unsafe, closes = np.zeros(len(words), bool), np.zeros(len(words), bool)
        # an empty head is the start of a text, not white space
        unsafe[~is_head] = self.opens[part[part_at]][of]
        closes[is_head], closes[~is_head] = self.closes[head], self.closes[part[part_at + n_parts - 1]][of]
        unsafe[1:] &= closes[:-1]
        after_head = np.flatnonzero(is_head[:-1]) + 1
        after_head = after_head[~is_head[after_head]]
        unsafe[after_head[np.fromiter((not heads[k] for k in np.searchsorted(first, after_head - 1)), bool, len(after_head))]] = False
        owner = np.unique(np.searchsorted(first, np.flatnonzero(unsafe), "right") - 1).tolist()
        whole = [self._codes(self.bare, self.pat.findall(texts[k]), False) for k in owner]
        # the ids of the batch's distinct chunks stand behind all that is kept, until the next batch
        part_size = self.size[part].astype(np.int64)
        ids = gather(self.flat, self.start[part], part_size)
        self._room("flat", self.n_flat, len(ids))[self.n_flat : self.n_flat + len(ids)] = ids
        upto = np.append(0, np.cumsum(part_size))
        begin, length = self.n_flat + upto[part_at], upto[part_at + n_parts] - upto[part_at]
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        start[is_head], start[~is_head] = self.start[head], begin[of]
        size[is_head], size[~is_head] = self.size[head], length[of]
        times = np.bincount(of, minlength=len(n_parts))
        seen = np.bincount(part, np.repeat(times, n_parts), self.n) + np.bincount(np.concatenate([head, *whole]), minlength=self.n)
        self.seen[: self.n] += seen.astype(np.int32)
        if owner:
            starts, sizes, per, done = [], [], per.copy(), 0
            for k, code in zip(owner, whole, strict=True):
                starts += [start[done : first[k]], self.start[code]]
                sizes += [size[done : first[k]], self.size[code]]
                done = first[k] + per[k]
                per[k] = len(code)
            start, size = np.concatenate([*starts, start[done:]]), np.concatenate([*sizes, size[done:]]).astype(np.int64)
        upto = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(per))]
        return gather(self.flat, start, size), np.diff(upto)


def _strings(a: pa.StringArray) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()


def _signs_off(line: str) -> tuple[str, ...]:
    """Letters, and the signs after them; or the line as it is."""
    w = line.rstrip(SIGNS)
    return (w, line[len(w) :]) if len(w) < len(line) and w.isalpha() else (line,)


def _white_ends(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each string begins, and whether it ends, with white space; empty: both. None has a space."""
    u = np.frombuffer("".join([f"{x} " for x in strings]).encode("utf-32-le"), np.uint32)
    white = _IS_WHITE[np.minimum(u, len(_IS_WHITE) - 1)]
    ends = np.flatnonzero(u == ord(" "))
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    return white[starts], white[ends - 1] | (starts == ends)


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of flat that begin at start and have so many elements, one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - size), size) + np.arange(total)]
