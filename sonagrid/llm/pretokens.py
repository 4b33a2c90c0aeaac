"""Pre-tokens of a lower-casing BPE tokenizer file, for whole blocks of texts at once.

A text is a row of chunks, the runs between ASCII blanks: no pre-token, special string or
normalisation reaches over a blank. Chunks of ASCII and the letters U+00C0 to U+00FF, without
apostrophes and special strings, are cut by byte classes in numpy; the tokenizer file's rules say
the same for them. Each distinct other chunk is cut by the tokenizers library, once as long as it is
remembered. Either way a pre-token comes out as UTF-8 bytes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any, NamedTuple

import numpy as np
from tokenizers import Tokenizer

from sonagrid.llm.textarrays import LOWER, NOT_BLANK, Block, Words, span_hashes, words

_SPACE, _LETTER, _DIGIT, _OTHER, _LEAD = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[0xC3] = _LEAD


#: What the byte classes stand for. A file with other rules is refused.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Chunks that are remembered, and the longest of them in bytes.
CHUNKS = 200_000
CHUNK_BYTES = 64


class Pretokens(NamedTuple):
    data: np.ndarray  # bytes that the spans refer to
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  # which text of the block, ascending
    special: np.ndarray  # -1, or the id of a special token
    hash: np.ndarray


class Remembered:
    """What ``make`` gives for chunks, kept from block to block up to ``CHUNKS`` short ones."""

    def __init__(self, make: Callable[[list[str]], list[Any]]) -> None:
        self.make, self.held = make, {}

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[Any], np.ndarray]:
        """One value a distinct chunk, and which of these each chunk has."""
        keys, first, back = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        known = [self.held.get(k) for k in keys.tolist()]
        fresh = [i for i, x in enumerate(known) if x is None]
        spans = list(zip(start[first[fresh]].tolist(), end[first[fresh]].tolist(), strict=True))
        made = self.make([data[s:e].tobytes().decode("utf-8", "replace") for s, e in spans])
        if len(self.held) + len(fresh) > CHUNKS:
            self.held.clear()
        for i, (s, e), x in zip(fresh, spans, made, strict=True):
            known[i] = x
            if e - s <= CHUNK_BYTES and len(self.held) < CHUNKS:
                self.held[int(keys[i])] = x
        return known, back


class Pretokenizer:
    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        first = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        if kinds != _NORMALIZERS or first.get("pattern", {}).get("Regex") != _RULE:
            raise ValueError(f"{path} doesn't normalise and cut texts as the byte classes do")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(not NOT_BLANK[list(x.encode())].all() for x in self.special):
            raise ValueError(f"a special string of {path} holds a blank")
        self.split = re.compile("|".join(f"({re.escape(x)})" for x in self.special) or r"(?!)")
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.merges: list = spec["model"]["merges"]
        self.suffix: str = spec["model"]["end_of_word_suffix"] or ""
        byte_chars = [*range(33, 127), *range(161, 173), *range(174, 256)]  # printable bytes stand for themselves
        rest = [b for b in range(256) if b not in byte_chars]
        self.char = {b: chr(b) for b in byte_chars} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.byte = {c: b for b, c in self.char.items()}
        self.openings = sorted({tuple(x.encode()[:2]) for x in self.special})
        self.pieces = Remembered(lambda texts: [self._cut(x) for x in texts])

    def chunks(self, block: Block) -> tuple[Words, np.ndarray]:
        """The chunks of a block, and which of them the byte classes can cut."""
        data = block.data
        bad = (data == 39) | ((data >= 0x80) & (data != 0xC3))
        after = np.zeros(len(data), bool)
        after[1:] = data[:-1] == 0xC3
        bad &= ~(after & (data >= 0x80))
        bad[:-1] |= (data[:-1] == 0xC3) & (data[1:] < 0x80)
        for opening in self.openings:  # a special string may begin here
            here = data == opening[0]
            if len(opening) > 1:
                here[:-1] &= data[1:] == opening[1]
            bad |= here
        counts = np.concatenate([[0], np.cumsum(bad)])
        at = words(block, NOT_BLANK)
        return at, counts[at.end] == counts[at.start]

    def __call__(self, block: Block) -> Pretokens:
        at, easy = self.chunks(block)
        fast = self.cut(block, at, easy)
        if easy.all():
            return fast
        start, end, text = at.start[~easy], at.end[~easy], at.text[~easy]
        cut, which = self.pieces(block.data, start, end)
        pieces = [x for piece in cut for x in piece]
        many = np.array([len(x) for x in cut], np.int64)
        data = np.frombuffer(b"".join(x for x, _ in pieces), np.uint8)
        ends = np.cumsum([len(x) for x, _ in pieces], dtype=np.int64)
        starts = ends - [len(x) for x, _ in pieces]
        own = runs(np.cumsum(many)[which] - many[which], many[which])
        special, hashes = np.array([x for _, x in pieces], np.int64), span_hashes(data, starts, ends)
        order = np.argsort(np.concatenate([fast.start, np.repeat(start, many[which])]), kind="stable")
        spans = [(fast.start, starts[own] + len(fast.data)), (fast.end, ends[own] + len(fast.data)), (fast.text, np.repeat(text, many[which])), (fast.special, special[own]), (fast.hash, hashes[own])]
        return Pretokens(np.concatenate([fast.data, data]), *(np.concatenate(x)[order] for x in spans))

    def cut(self, block: Block, at: Words, easy: np.ndarray) -> Pretokens:
        """The pre-tokens of chunks that the byte classes can cut; they stand where they stood in the block."""
        data = LOWER[block.data]
        kind = _KIND[data]
        lead = np.flatnonzero(kind == _LEAD)
        second = data[np.minimum(lead + 1, len(data) - 1)] if len(lead) else lead
        letter = np.where((second == 0x97) | (second == 0xB7), _OTHER, _LETTER).astype(np.uint8)
        kind[lead] = letter
        inside = (lead + 1 < len(data)) & (second >= 0x80)
        kind[lead[inside] + 1] = letter[inside]
        upper = inside & (second <= 0x9E) & (second != 0x97)
        data[lead[upper] + 1] += 0x20
        n = len(kind)
        new = np.ones(n, bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        new[at.start] = True
        cut = np.flatnonzero(new)
        end = np.append(cut[1:], n)
        keep = kind[cut] != _SPACE
        if not easy.all():
            depth = np.zeros(n + 1, np.int8)
            depth[at.start[~easy]] = 1
            depth[at.end[~easy]] -= 1
            keep &= np.cumsum(depth, dtype=np.int8)[cut] == 0
        start, end = cut[keep], end[keep]
        text = np.repeat(np.arange(len(block.bounds) - 1), np.diff(np.searchsorted(start, block.bounds)))
        return Pretokens(data, start, end, text, np.full(len(start), -1), span_hashes(data, start, end))

    def _cut(self, chunk: str) -> list[tuple[bytes, int]]:
        """Pre-tokens of one chunk by the library, each with -1 or the id of a special string."""
        out = []
        for part in self.split.split(chunk):
            if part in self.special:
                out.append((part.encode(), self.special[part]))
            elif part:
                for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part)):
                    out.append((bytes(self.byte[c] for c in piece), -1))
        return out


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each size, end to end."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def new_spans(found: Pretokens, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``found`` that the sorted ``known`` lacks, and a place of each; specials aside."""
    own = np.flatnonzero(found.special < 0)
    distinct, first = np.unique(found.hash[own], return_index=True)
    if len(known):
        at = np.searchsorted(known, distinct)
        at[at == len(known)] = 0
        fresh = known[at] != distinct
        distinct, first = distinct[fresh], first[fresh]
    return distinct, own[first]
