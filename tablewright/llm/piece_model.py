"""A SentencePiece model of byte-pair kind: its pieces, its character map, its merges.

The file is a protocol buffer; only the fields that decide results are read. A word keeps its
tokens as (id, number of normalised characters), so callers can follow them back to the source.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from operator import add

import numpy as np

SPACE = "▁"  #: stands for a space in pieces
# field numbers and piece kinds of the file format (fixed values)
PIECES, TRAINER, NORMALIZER = 1, 2, 3
TEXT, SCORE, KIND = 1, 2, 3
CHARACTER_MAP, ADD_SPACE, REMOVE_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
MODEL_KIND, SPACE_BEHIND, UNKNOWN_TEXT = 3, 24, 44
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BYTE_PAIR = 2

SHORT = 32            #: characters up to which a word's pairs are simply searched
NEVER = float("inf")  #: rank of a pair that is no piece


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        field, wire = tag >> 3, tag & 7
        if wire == 0:
            yield field, number()
        else:
            size = {1: 8, 5: 4}.get(wire)
            size = number() if size is None else size
            yield field, data[at: at + size]
            at += size


class CharacterMap:
    """Replacements of the longest matching prefix: a double array of bytes, then the texts."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4: 4 + size], "<u4").tolist() if blob else []
        self.texts = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes taken, replacement) of the longest prefix from a place on."""
        if not self.units:
            return None
        unit, node, found = self.units[0], 0, None
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1]: self.texts.index(b"\0", found[1])]


class PieceModel:
    """Normalisation with alignment, merges within words, byte fallback, decoding."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        for field, value in _fields(data):
            if field == PIECES:
                own = dict(_fields(value))
                self.pieces.append((own[TEXT].decode(), struct.unpack("<f", own.get(SCORE, b"\0" * 4))[0], own.get(KIND, NORMAL)))
            elif field == TRAINER:
                trainer = dict(_fields(value))
            elif field == NORMALIZER:
                normalizer = dict(_fields(value))
        if trainer.get(MODEL_KIND, 1) != BYTE_PAIR:
            raise ValueError("only models of byte-pair kind are read")
        if any(kind in (USER, UNUSED) for _, _, kind in self.pieces) or trainer.get(SPACE_BEHIND, 0):
            raise ValueError("models with user-defined or unused pieces, or with spaces behind words, are not read")
        self.map = CharacterMap(normalizer.get(CHARACTER_MAP, b""))
        self.add_space = bool(normalizer.get(ADD_SPACE, 1))
        self.remove_spaces = bool(normalizer.get(REMOVE_SPACES, 1))
        self.space = SPACE if normalizer.get(ESCAPE_SPACES, 1) else " "
        self.unknown_text = trainer.get(UNKNOWN_TEXT, " ⁇ ".encode()).decode()
        self.ids = {text: i for i, (text, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.names = {text: str(i) for text, i in self.ids.items()}
        self.ranked = {text: -score for text, score, kind in self.pieces if kind == NORMAL}
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.bytes = {int(text[3:5], 16): i for i, (text, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        # characters that are next to each other in no piece are never merged: words are cut there
        self.inner = {text[i: i + 2] for text in self.ids for i in range(len(text) - 1)}
        together = {c for pair in self.inner for c in pair}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in together and c != 32)
        starts = not any(pair[1] == SPACE and pair[0] != SPACE for pair in self.inner) and self.space == SPACE
        single = f"[{alone}]|" if alone else ""
        self.words = re.compile(f"{single}[ {SPACE}]*[^ {SPACE}{alone}]+|[ {SPACE}]+" if starts else "(?s).+")
        self.plain = not self.map.units and not self.remove_spaces

    def _single(self, data: bytes, at: int) -> tuple[int, str]:
        found = self.map.longest(data, at)
        if found is not None:
            return found[0], found[1].decode()
        size = 1 if data[at] < 128 else 2 if data[at] < 224 else 3 if data[at] < 240 else 4
        return size, data[at: at + size].decode()

    def normalised(self, text: str) -> tuple[str, list[int]]:
        """The text as merges see it and, for each of its characters and for its end, the source byte."""
        data, at, end = text.encode(), 0, 0
        steps = []
        while at < len(data):
            size, new = self._single(data, at)
            steps.append((at, size, new))
            at += size
        if self.remove_spaces:
            first = next((i for i, s in enumerate(steps) if s[2] != " "), len(steps))
            steps = steps[first:]
        if not steps:
            return "", [0]
        out, source, after_space = [], [], self.remove_spaces
        end = steps[0][0]
        if self.add_space:
            out.append(self.space)
            source.append(steps[0][0])
        for at, size, new in steps:
            if after_space:
                new = new.lstrip(" ")
            for c in new:
                out.append(self.space if c == " " else c)
                source.append(at)
            if new:
                end, after_space = at + size, self.remove_spaces and new.endswith(" ")
        if self.remove_spaces:
            while out and out[-1] == self.space:
                end = source.pop()
                out.pop()
        return "".join(out), [*source, end]

    def merged_parts(self, word: str) -> list[str]:
        """The word cut as merges leave it: the best-scored pair of neighbours is joined first, of equal ones the leftmost."""
        return self._merged_short(word) if len(word) <= SHORT else self._merged_long(word)

    def tokens(self, parts: list[str]) -> list[tuple[int, int]]:
        """(id, characters) of parts; a character that is no piece gives its bytes: the last takes the character, the others none."""
        out = []
        for part in parts:
            known = self.ids.get(part)
            if known is not None:
                out.append((known, len(part)))
            elif self.bytes:
                raw = part.encode()
                out += [(self.bytes[b], int(i == len(raw))) for i, b in enumerate(raw, 1)]
            else:
                out.append((self.unknown, len(part)))
        return out

    def _merged_short(self, word: str) -> list[str]:
        parts, rank = list(word), self.ranked.get
        ranks = [rank(pair, NEVER) for pair in map(add, word, word[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            at = ranks.index(best)
            own = parts[at] = parts[at] + parts[at + 1]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + own, NEVER)
            if at < len(ranks):
                ranks[at] = rank(own + parts[at + 1], NEVER)
        return parts

    def _merged_long(self, word: str) -> list[str]:
        parts = list(word)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        waiting: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            both = parts[left] + parts[right]
            rank = self.ranked.get(both)
            if rank is not None:
                heapq.heappush(waiting, (rank, left, right, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while waiting:
            _, left, right, both = heapq.heappop(waiting)
            if not parts[left] or not parts[right] or parts[left] + parts[right] != both or after[left] != right:
                continue
            parts[left], parts[right] = both, ""
            after[left] = after[right]
            if after[left] < len(parts):
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        return [p for p in parts if p]

    def joined_unknowns(self, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Neighbouring unknown tokens are one."""
        if self.bytes:
            return tokens
        out: list[tuple[int, int]] = []
        for token, size in tokens:
            if out and token == out[-1][0] == self.unknown:
                out[-1] = token, out[-1][1] + size
            else:
                out.append((token, size))
        return out

    def piece_text(self, token: int) -> bytes:
        """What a token stands for when decoded, but for the space before the first one."""
        text, _, kind = self.pieces[token]
        if kind == BYTE:
            return bytes([self.byte_of[token]])
        if kind == CONTROL:
            return b""
        return self.unknown_text.encode() if kind == UNKNOWN else text.replace(SPACE, " ").encode()

    def decoded(self, ids: list[int]) -> str:
        """The text of tokens; bytes that are no UTF-8 read as U+FFFD, each of them."""
        out, run, begun = [], b"", False
        for token in ids:
            text = self.piece_text(token)
            if token in self.byte_of:
                run += text
                continue
            if run:
                out.append(_characters(run))
                run, begun = b"", True
            text = text.decode()
            if not begun and (self.add_space or self.remove_spaces) and text.startswith(" ") and token != self.unknown:
                text = text[1:]  # the space that encoding put in front
                begun = not self.remove_spaces  # if spaces are not kept, all in front go
            begun = begun or bool(text)
            out.append(text)
        return "".join([*out, _characters(run)])


def _characters(data: bytes) -> str:
    """UTF-8, with one U+FFFD for each byte that belongs to no character."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[at: at + size].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                size = 1
                out.append("�")
            at += size
        return "".join(out)
