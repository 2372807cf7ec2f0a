"""Byte-level BPE over batches of texts: pre-tokens by vectorised rules, token counts by rank-synchronous merging.

A pre-token is what the published pattern of the vocabulary matches (contractions, an optional blank with letters, digits or
other signs, white space). Merges never cross pre-tokens, so equal pre-tokens are merged once per worker and remembered. Two are
equal if their signs are; hashes only say which to compare.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

from runledger.llm.common import SpanHash, texts_in_steps

_EDGE = 0x110000
_SPACE, _LETTER, _DIGIT, _SIGN = 1, 2, 3, 4
#: Pre-tokens remembered by a worker; beyond, it starts afresh (results stay the same).
REMEMBERED = 500_000
#: Texts that the library encodes in one call; its results take some hundred bytes each until they are read.
AT_ONCE = 8_192
#: Pre-tokens that are put into one such text, with a special token behind each.
TOGETHER = 64


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point, as the tokenizers library's patterns have it; the edge between texts is 0."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    points = np.array([i for i in range(_EDGE) if not 0xD800 <= i < 0xE000])
    # in parts: the library counts signs from the start of the text for every piece that it gives
    parts = [(at, points[at:at + 512].astype(np.uint32).tobytes().decode("utf-32-le")) for at in range(0, len(points), 512)]
    table = np.full(_EDGE + 1, _SIGN, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_SPACE, r"\s+")):
        matched = np.ones(len(points), bool)
        split = Split(Regex(pattern), "removed")
        for at, part in parts:
            for _, (start, end) in split.pre_tokenize_str(part):
                matched[at + start:at + end] = False
        table[points[matched]] = kind
    table[_EDGE] = 0
    return table


class Pretokens:
    """Pre-tokens of several texts: start, end (in `points`), number of the text, hash."""

    def __init__(self, texts: list[str]):
        edge = np.array([_EDGE], np.uint32)
        parts = [edge]
        for t in texts:
            parts += [np.frombuffer(t.encode("utf-32-le"), np.uint32), edge]
        # two more edges, so that looking three signs ahead stays inside
        self.points = p = np.concatenate([*parts, edge, edge])
        kind = _classes()[p]
        before, after = np.concatenate([kind[:1], kind[:-1]]), np.concatenate([kind[1:], kind[:1]])
        first = (kind != before) & (kind != 0)
        white, blank = kind == _SPACE, p == 32
        after_blank = np.concatenate([[False], blank[:-1]])
        start = (white & (first | (after >= _LETTER))) | ((kind >= _LETTER) & first & ~after_blank)
        at = np.flatnonzero((p == 39) & first & ~after_blank & (after == _LETTER))
        if len(at):
            one, two = p[at + 1], p[at + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for chosen, width in ((at[short], 2), (at[long], 3)):
                start[chosen + 1] = False
                start[chosen + width] |= kind[chosen + width] == _LETTER
        marks = np.flatnonzero(start | (kind == 0))
        own = start[marks]
        self.start, self.end = marks[own], marks[1:][own[:-1]]
        sizes = np.array([len(x) for x in parts[1::2]], np.int64)
        ends = 1 + np.cumsum(sizes + 1)
        self.text = np.searchsorted(ends, self.start, side="right")
        self.hash = SpanHash(p)(self.start, self.end)

    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """First occurrence of each distinct pre-token, and the number of its kind for every occurrence.

        Kinds are found by hash and compared as strings: an occurrence that differs from the first of its hash gets a kind of its
        own, behind the others.
        """
        _, first, kind = np.unique(self.hash, return_index=True, return_inverse=True)
        size, lead = self.end - self.start, first[kind]
        other = np.flatnonzero(~same_strings(self.points, self.start, size, self.points, self.start[lead], size[lead]))
        if len(other):
            found: dict[bytes, int] = {}
            for i in other.tolist():
                kind[i] = found.setdefault(self.points[self.start[i]:self.end[i]].tobytes(), len(first) + len(found))
            own = np.zeros(len(found), np.int64)
            own[kind[other[::-1]] - len(first)] = other[::-1]
            first = np.concatenate([first, own])
        return first, kind

    def cut(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signs of some pre-tokens one after the other, and their sizes."""
        size = (self.end - self.start)[which]
        ends = np.cumsum(size)
        return self.points[np.arange(int(size.sum())) + np.repeat(self.start[which] - (ends - size), size)], size

    def strings(self, which: np.ndarray) -> list[str]:
        signs, size = self.cut(which)
        text, ends = signs.tobytes().decode("utf-32-le"), np.cumsum(size)
        return [text[a:b] for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]


#: Signs of two strings that are compared for all strings at once; what is longer is compared one by one.
COMPARED = 32


def same_strings(p: np.ndarray, at: np.ndarray, size: np.ndarray, q: np.ndarray, other: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Whether p[at:at + size] and q[other:other + other_size] hold the same signs."""
    same = size == other_size
    live = np.flatnonzero(same & ((at != other) | (p is not q)))
    for j in range(COMPARED):
        live = live[size[live] > j]
        if not len(live):
            return same
        equal = p[at[live] + j] == q[other[live] + j]
        if not equal.all():
            same[live[~equal]] = False
            live = live[equal]
    for i in live[size[live] > COMPARED].tolist():
        same[i] = np.array_equal(p[at[i]:at[i] + size[i]], q[other[i]:other[i] + size[i]])
    return same


class Memory:
    """Known pre-tokens, each with a number. They are looked up by hash and compared as strings."""

    def __init__(self):
        self.keys, self.numbers, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.points, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, pre: Pretokens, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each pre-token, -1 where unknown, and whether its hash is not in use."""
        keys = pre.hash[which]
        if not len(self.keys):
            return np.full(len(keys), -1), np.ones(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == keys)
        place = self.places[at[hit]]
        own = which[hit]
        same = same_strings(pre.points, pre.start[own], (pre.end - pre.start)[own], self.points, self.starts[place], self.sizes[place])
        numbers, free = np.full(len(keys), -1), np.ones(len(keys), bool)
        numbers[hit[same]] = self.numbers[at[hit[same]]]
        free[hit] = False
        return numbers, free

    def add(self, pre: Pretokens, which: np.ndarray, numbers: np.ndarray) -> None:
        """Remember pre-tokens; of those with one hash only the first."""
        keys, first = np.unique(pre.hash[which], return_index=True)
        signs, size = pre.cut(which[first])
        places = len(self.sizes) + np.arange(len(first))
        self.starts = np.concatenate([self.starts, len(self.points) + np.cumsum(size) - size])
        self.points, self.sizes = np.concatenate([self.points, signs]), np.concatenate([self.sizes, size])
        # both halves are sorted: a stable sort merges them
        merged = np.concatenate([self.keys, keys])
        order = np.argsort(merged, kind="stable")
        self.keys = merged[order]
        self.numbers = np.concatenate([self.numbers, numbers[first]])[order]
        self.places = np.concatenate([self.places, places])[order]


class Merges:
    """Merge table of a byte-level BPE vocabulary file, and counting of tokens by rank-synchronous merging."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        # printable stand-ins of the bytes: printable Latin-1 as it is, all others from U+0100 on in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.byte_id = np.array([ids[chr(b) if b in plain else chr(256 + rest.index(b))] for b in range(256)], np.int64)
        self.known = Memory()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.order[at], len(self.key))

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word. All words take their next merge, the one of lowest rank, in the same step."""
        sizes = np.array([len(w) for w in words], np.int64)
        out = sizes.copy()
        symbols = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        none = len(self.key)
        while len(symbols) > 1:
            rank = np.full(len(symbols), none)
            same = word[:-1] == word[1:]
            rank[:-1][same] = self.ranks(symbols[:-1][same], symbols[1:][same])
            begin = np.flatnonzero(np.concatenate([[True], ~same]))
            lowest = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(symbols)))
            each = np.repeat(lowest, size)
            hit = (rank == each) & (each < none)
            # of overlapping pairs (a a a) every second counts, from the left
            at = np.flatnonzero(hit)
            run = np.concatenate([[0], np.cumsum(np.diff(at) != 1)])[:len(at)]
            place = np.arange(len(at)) - np.searchsorted(run, run)
            at = at[place % 2 == 0]
            np.subtract.at(out, word[at], 1)
            symbols[at] = self.made[rank[at]]
            keep = each < none
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        return out

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; strings of special tokens inside a text are one token each."""
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            pieces = split_special(t, self.specials)
            extra[i] = len(pieces) - 1
            parts += pieces
            owner += [i] * len(pieces)
        pre = Pretokens(parts)
        first, kind = pre.kinds()
        n, free = self.known.find(pre, first)
        new = np.flatnonzero(n < 0)
        if len(new):
            n[new] = self.count([t.encode() for t in pre.strings(first[new])])
            if len(self.known.keys) + len(new) > REMEMBERED:
                self.known, free[:] = Memory(), True
            fresh = new[free[new]]
            self.known.add(pre, first[fresh], n[fresh])
        sums = np.bincount(np.array(owner)[pre.text], weights=n[kind], minlength=len(texts)) if len(pre.text) else 0
        return extra + np.asarray(sums, np.int64)


def split_special(text: str, specials: list[str]) -> list[str]:
    """Pieces of a text between the strings of special tokens."""
    if not any(s in text for s in specials):
        return [text]
    return regex.split("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)), text)


class Encoder:
    """Ids of whole texts: the tokenizers library encodes each pre-token once, and its ids are gathered for the texts.

    Texts that hold a string of a special token go to the library whole.
    """

    def __init__(self, path: str):
        # a task has one core; threads of the library would cost memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        self.specials = [t["content"] for t in added]
        # one that takes no signs beside it and does not run over into what follows
        plain = [t for t in added if t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])]
        alone = len(added) == 1 and plain and self.specials[0].rfind(self.specials[0][0]) == 0
        self.ender = (self.specials[0], added[0]["id"]) if alone else None
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.offsets = Memory(), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and how many each has."""
        made, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(texts), AT_ONCE):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at:at + AT_ONCE], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            made.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(made), np.concatenate(sizes)

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As `library`, for texts without strings of special tokens: TOGETHER of them in one call, each ended by such a string.

        The library takes the text apart at special tokens before all else, so what lies between two of them is encoded as if it
        stood alone; only the results are fewer.
        """
        if self.ender is None:
            return self.library(texts)
        mark, number = self.ender
        joined = [mark.join([*texts[at:at + TOGETHER], ""]) for at in range(0, len(texts), TOGETHER)]
        made, _ = self.library(joined)
        ends = np.flatnonzero(made == number)
        return made[made != number], np.diff(ends, prepend=-1) - 1

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [i for i, t in enumerate(texts) if any(s in t for s in self.specials)]
        plain = list(texts)
        for i in whole:
            plain[i] = ""
        pre = Pretokens(plain)
        first, kind = pre.kinds()
        number, free = self.known.find(pre, first)
        new = np.flatnonzero(number < 0)
        if len(self.known.keys) + len(new) > REMEMBERED and len(self.known.keys):
            self._forget()
            number[:], free[:] = -1, True
            new = np.arange(len(first))
        if len(new):
            made, sizes = self.pieces(pre.strings(first[new]))
            number[new] = len(self.offsets) - 1 + np.arange(len(new))
            self.ids = np.concatenate([self.ids, made])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
            fresh = new[free[new]]
            self.known.add(pre, first[fresh], number[fresh])
        number = number[kind]
        size = self.offsets[number + 1] - self.offsets[number]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.arange(total) + np.repeat(self.offsets[number] - (ends - size), size)]
        per_text = np.bincount(pre.text, weights=size, minlength=len(texts)).astype(np.int64) if total else np.zeros(len(texts), np.int64)
        out = np.split(flat, np.cumsum(per_text)[:-1])
        if whole:
            made, sizes = self.library([texts[i] for i in whole])
            for i, ids in zip(whole, np.split(made, np.cumsum(sizes)[:-1]), strict=True):
                out[i] = ids
        return out


@lru_cache(4)
def merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def string_steps(values: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of bounded size; null is the empty text."""
    raw = [(v or "").encode() for v in values]
    for first, part in texts_in_steps(raw):
        yield first, [p.decode() for p in part]
