"""Pre-tokens of a byte-level BPE for batches of texts, and numpy kernels that work on their distinct forms.

The pre-token pattern is 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ of byte-level BPE
tokenizers. It is evaluated by array operations over code points: runs of one class, the space before a run, the last
blank before a run, and the contractions. Letters and numbers are those of the tokenizers library, for every code point.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pandas as pd
import regex
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from .common import CHUNK, span_hashes

#: Distinct pre-tokens that a Python worker keeps; beyond that it starts anew, which changes no result.
CACHE = 1_000_000

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_BLANKS = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_TABLES: list[np.ndarray] = []


def _all_of(kind: str) -> np.ndarray:
    """Which code points are letters (L) or numbers (N) to the tokenizers library.

    Two sources of other Unicode versions agree on all but some thousands of them; those the library is asked for.
    """
    older = np.fromiter((unicodedata.category(chr(c))[0] == kind for c in range(0x110000)), dtype=bool, count=0x110000)
    newer = np.zeros(0x110000, dtype=bool)
    for m in regex.finditer(rf"\p{{{kind}}}+", "".join(map(chr, range(0x110000)))):
        newer[m.start() : m.end()] = True
    asked = np.flatnonzero(older != newer)
    older[asked] = False
    text = "".join(map(chr, asked.tolist()))
    for _, (lo, hi) in Split(Regex(rf"[^\p{{{kind}}}]+"), "removed").pre_tokenize_str(text):
        older[asked[lo:hi]] = True
    return older


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """(class of each code point, a random odd number for each of 65,536 residues)."""
    if not _TABLES:
        table = np.full(0x110000, _OTHER, dtype=np.uint8)
        table[_all_of("L")], table[_all_of("N")] = _LETTER, _NUMBER
        table[list(_BLANKS)] = _SPACE
        odd = np.random.default_rng(5).integers(1, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        _TABLES.extend((table, odd))
    return _TABLES[0], _TABLES[1]


def split(texts: list[str], special: str | None) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(all texts joined, start of each pre-token, its hash, first pre-token of each text and one more).

    The special string is one pre-token wherever it stands, and texts end around it.
    """
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(points)
    table, odd = _classes()
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    if not n:
        return joined, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    begins = np.zeros(n + 1, dtype=bool)
    begins[bounds] = True
    inside = np.zeros(n, dtype=bool)
    if special and special in joined:
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            at = joined.find(special, lo, hi)
            while at >= 0:
                begins[at] = begins[at + len(special)] = True
                inside[at + 1 : at + len(special)] = True
                at = joined.find(special, at + len(special), hi)
    kind = table[points]
    run = begins[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    token = run.copy()
    # A run of letters, numbers or others takes the space before it; the last blank before a run starts a pre-token.
    after = np.flatnonzero(run & (kind != _SPACE) & ~begins[:n])
    after = after[kind[after - 1] == _SPACE]
    token[after[points[after - 1] == 32]] = False
    token[after - 1] = True
    # Contractions: an apostrophe alone at a pre-token's start, with the letters after it.
    for i in np.flatnonzero(token & (points == 39)).tolist():
        if i + 1 < n and run[i + 1] and not begins[i + 1] and kind[i + 1] == _LETTER:
            one, two = joined[i + 1], joined[i + 1 : i + 3]
            size = 2 if one in "stmd" else 3 if two in ("re", "ve", "ll") and not begins[i + 2] else 0
            if size:
                token[i + 1] = False
                if i + size < n:
                    token[i + size] = True
    token &= ~inside
    starts = np.flatnonzero(token)
    ends = np.append(starts[1:], n)
    hashes = span_hashes(odd[points & 0xFFFF] + (points >> 16).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), starts, ends)
    return joined, starts, hashes, np.searchsorted(starts, bounds)


def text_chunks(texts: list[str], limit: int = CHUNK):
    """Lists of (text number, piece) of about limit characters in all. A longer text is cut before a space that starts a
    pre-token, so that its pieces' pre-tokens are its own."""
    now, size = [], 0
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > limit:
            to = at + limit
            while 0 < (to := t.find(" ", to)) and not (to + 1 < len(t) and t[to - 1].isalpha() and t[to + 1].isalpha()):
                to += 1
            if to <= 0:
                break
            if now:
                yield now
            yield [(i, t[at:to])]
            now, size, at = [], 0, to
        if size and size + len(t) - at > limit:
            yield now
            now, size = [], 0
        now.append((i, t[at:] if at else t))
        size += len(t) - at
    if now:
        yield now


def largest_id(path: str) -> int:
    """The largest id of a tokenizer's .json."""
    with open(path, encoding="utf-8") as f:
        loaded = json.load(f)
    return max([*loaded["model"]["vocab"].values(), *(t["id"] for t in loaded["added_tokens"])])


class Forms:
    """Distinct pre-tokens seen by this worker, by hash, with what solve(strings) gives for each: a ragged array of numbers."""

    def __init__(self, solve, dtype):
        self.solve, self.dtype = solve, dtype
        self.clear()

    def clear(self):
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.slots = np.zeros(0, dtype=np.int64)
        self.sizes = np.zeros(0, dtype=np.int64)
        self.firsts = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=self.dtype)

    def lookup(self, joined: str, starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The slot of each pre-token; new ones are solved first."""
        if len(self.hashes) > CACHE:
            self.clear()
        codes, uniques = pd.factorize(hashes)
        at = np.searchsorted(self.hashes, uniques)
        known = np.zeros(len(uniques), dtype=bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == uniques
        new = np.flatnonzero(~known)
        slots = np.empty(len(uniques), dtype=np.int64)
        slots[known] = self.slots[at[known]]
        if len(new):
            seen = np.maximum.accumulate(codes)
            first = np.flatnonzero(np.concatenate(([True], seen[1:] != seen[:-1])))
            ends = np.append(starts[1:], len(joined))
            strings = [joined[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            sizes, flat = self.solve(strings)
            slots[new] = len(self.sizes) + np.arange(len(new))
            self.firsts = np.concatenate((self.firsts, len(self.flat) + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.flat = np.concatenate((self.flat, flat.astype(self.dtype)))
            order = np.argsort(uniques[new])
            place = at[new][order]
            self.hashes = np.insert(self.hashes, place, uniques[new][order])
            self.slots = np.insert(self.slots, place, slots[new][order])
        return slots[codes]


class Merges:
    """The merge table of a byte-level BPE, and the count of symbols that it leaves of a pre-token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            loaded = json.load(f)
        vocabulary, merges = loaded["model"]["vocab"], loaded["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in loaded["added_tokens"]}
        # The printable stand-ins of bytes in such vocabularies: printable Latin-1 for itself, the rest from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        stand_in = {b: chr(b if b in plain else next(rest)) for b in range(256)}
        self.byte = np.array([vocabulary[stand_in[b]] for b in range(256)], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.into = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], np.int32(len(self.keys)))

    def merged(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols that survive of each string, all of them in order).

        In every round, each sequence merges all places of its lowest-ranked pair; sequences without a pair are done.
        """
        raw = [s.encode("utf-8", "surrogatepass") for s in strings]
        symbols = self.byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(raw), dtype=np.int32), np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))
        none, done = len(self.keys), []
        # Each place's rank with the next one; a merge changes only those beside it.
        rank = np.full(len(symbols), none, dtype=np.int32)
        rank[:-1] = np.where(owner[:-1] == owner[1:], self._ranks(symbols[:-1], symbols[1:]), none)
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lengths = np.diff(np.append(first, len(symbols)))
            lowest = np.repeat(np.minimum.reduceat(rank, first), lengths)
            over = lowest == none
            if over.any():
                done.append((owner[over], symbols[over]))
                live = ~over
                symbols, owner, rank, lowest = symbols[live], owner[live], rank[live], lowest[live]
                if not len(symbols):
                    break
            places = np.flatnonzero(rank == lowest)
            # Of overlapping places (a a a) every second one from the left merges.
            if len(places) > 1 and (touching := places[1:] == places[:-1] + 1).any():
                nth = np.arange(len(places))
                nth -= np.maximum.accumulate(np.where(np.concatenate(([True], ~touching)), nth, 0))
                places = places[nth % 2 == 0]
            symbols[places] = self.into[rank[places]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[places + 1] = False
            at = places - np.arange(len(places))  # where they are afterwards
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            for left in (at, at[at > 0] - 1):
                right = left + 1
                inside = right < len(symbols)
                inside[inside] = owner[left[inside]] == owner[right[inside]]
                rank[left] = none
                rank[left[inside]] = self._ranks(symbols[left[inside]], symbols[right[inside]])
        if not done:
            return np.zeros(len(raw), dtype=np.int64), symbols
        owners = np.concatenate([o for o, _ in done])
        order = np.argsort(owners, kind="stable")
        return np.bincount(owners, minlength=len(raw)), np.concatenate([x for _, x in done])[order]

    def counts(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For Forms: one number for each string, how many of its symbols survive."""
        sizes = self.merged(strings)[0]
        for k, s in enumerate(strings):
            if s in self.special:
                sizes[k] = 1
        return np.ones(len(strings), dtype=np.int64), sizes

    def ids(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For Forms: the ids of each string."""
        sizes, flat = self.merged(strings)
        for k in reversed([k for k, s in enumerate(strings) if s in self.special]):
            at = int(sizes[:k].sum())
            flat = np.concatenate((flat[:at], [self.special[strings[k]]], flat[at + sizes[k] :]))
            sizes[k] = 1
        return sizes, flat
