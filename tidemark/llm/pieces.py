"""Exact token ids through the tokenizers library, one library call per distinct piece and worker.

A text is cut only where the tokenizer itself always cuts, so joining the pieces' ids equals encoding the whole
text. The cache of a Python worker outlives its tasks, as the next task reads much the same words. It has two
generations: when the younger one has MAX_BYTES it becomes the older one, whose pieces stay only if they are seen again,
so a worker keeps twice that at most and the frequent pieces survive; after a task one generation stays at most, by
default half of one. New pieces that follow a space go to the library as lines of one text, as a line feed between them
is a token of its own there. Texts are taken in groups of GROUP characters, and
a text that alone has more is encoded by the library, so one batch cannot overshoot the bound by more than a group.

ColumnEncoder does the same for an Arrow column: pieces are cut and counted by arrays, so Python sees each distinct piece
of a batch once, and the ids lie in one array a generation. Between tasks it keeps one generation. Where the library
drops white space, new pieces go to it as one text with a mark, which is one token, after each.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np

from tidemark.llm.common import SPACE_BYTES, text_arrays, tokenizer_path, trim_process

MAX_BYTES = 128 << 20
GROUP = 1 << 21
#: The same as MAX_BYTES for a ColumnEncoder, which took about as much time with 64 or 96 MB as with 128 MB.
COLUMN_BYTES = 96 << 20
#: What Python and the dictionary take for an entry besides its characters and ids.
ENTRY = 180

#: White space other than a single space or line feed, or two white-space characters in a row.
ODD_SPACE = re.compile("[\t\x0b-\r\x85\xa0  -     　\x1c-\x1f​﻿]|[ \n]{2}")

#: The same below U+0080, and what marks a first piece: a search for each is faster than the expression.
ODD = ("  ", " \n", "\n ", "\n\n", *"\0\t\x0b\x0c\r\x1c\x1d\x1e\x1f")

#: A word of one token that stands between new words; where a piece has it too, those of the call are learnt one by one.
MARK = "\x01"

#: str.split() cuts at these, the library does not.
CONTROL = re.compile("[\x1c-\x1f]")


class Encoder:
    """whole: ids of a text from the library alone; __call__: the same ids through the cache."""

    def __init__(self, name: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path(name))
        self.library.encode_special_tokens = True
        self.keeps_space = keeps_space
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.line = self.library.encode("\n", add_special_tokens=False).ids[0] if keeps_space else None

    def whole(self, text: str) -> np.ndarray:
        (found,) = self.library.encode_batch_fast([text], add_special_tokens=False)  # without offsets
        return np.array(found.ids, np.uint16)

    def learn(self, pieces: list[str]) -> None:
        if self.keeps_space:
            pieces = [*self.learn_lines([p for p in pieces if p[:1] != "\0" and "\n" not in p]), *(p for p in pieces if p[:1] == "\0" or "\n" in p)]
        for i in range(0, len(pieces), 4096):
            part = pieces[i : i + 4096]
            for piece, e in zip(part, self.library.encode_batch_fast([self.as_text(p) for p in part], add_special_tokens=False)):
                self.keep(piece, np.array(e.ids, np.uint16).tobytes())

    def learn_lines(self, pieces: list[str]) -> list[str]:
        """Learns pieces that follow a space, many in one call; returns those of calls whose lines can't be told apart."""
        left = []
        for i in range(0, len(pieces), 512):
            part = pieces[i : i + 512]
            ids = self.whole(" " + "\n ".join(part) + "\n")
            ends = np.flatnonzero(ids == self.line)
            if len(ends) != len(part):
                left += part
                continue
            data, at = ids.tobytes(), 0
            for piece, end in zip(part, (2 * ends).tolist()):
                self.keep(piece, data[at:end])
                at = end + 2
        return left

    def trim(self, most: int = MAX_BYTES // 2) -> None:
        """After a task: only the younger generation stays, and only up to most bytes; with MAX_BYTES or more as the older one."""
        if most >= MAX_BYTES and self.held > MAX_BYTES // 2:
            self.cache, self.older, self.held = {}, self.cache, 0
            return
        self.older = {} if most < MAX_BYTES else self.older
        if self.held > most:
            self.cache, self.held = {}, 0

    def keep(self, piece: str, ids: bytes) -> None:
        self.cache[piece] = ids
        self.held += ENTRY + len(piece) + len(ids)

    def as_text(self, piece: str) -> str:
        """A leading space stands for none, since most pieces follow a space."""
        if not self.keeps_space:
            return piece
        return piece[1:] if piece[:1] == "\0" else piece if piece[:1] == "\n" else f" {piece}"

    def split(self, text: str) -> list[str] | None:
        """Pieces, or None where only the whole text is safe."""
        if not self.keeps_space:
            return None if CONTROL.search(text) else text.split()
        if text[-1:] in " \n" or text[:1] in " \n" or any(c in text for c in ODD) or not text.isascii() and ODD_SPACE.search(text):
            return None
        first, *rest = text.replace("\n", " \n").split(" ")
        return [f"\0{first}", *rest]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        group, size = [], 0
        for text in texts:
            if group and size + len(text) > GROUP:
                out += self.encode(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        return out + self.encode(group)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [None if len(t) > GROUP else self.split(t) if t else [] for t in texts]
        if self.held > MAX_BYTES:
            self.cache, self.older, self.held = {}, self.cache, 0
        have, older = self.cache, self.older
        flat = [p for pieces in cut if pieces for p in pieces]
        ids = list(map(have.get, flat))
        missing = [i for i, found in enumerate(ids) if found is None]
        if missing:
            unknown = []
            for p in dict.fromkeys([flat[i] for i in missing]):
                if (found := older.get(p)) is None:
                    unknown.append(p)
                else:
                    self.keep(p, found)
            self.learn(unknown)
            for i in missing:
                ids[i] = have[flat[i]]
        out, at = [], 0
        for text, pieces in zip(texts, cut):
            if pieces is None:
                out.append(self.whole(text))
            else:
                out.append(np.frombuffer(b"".join(ids[at : at + len(pieces)]), np.uint16))
                at += len(pieces)
        return out


#: The characters of ODD_SPACE in UTF-8: 1 for the bytes of those below U+0080, 2 for the first bytes of the others, and those as numbers of two and of three bytes.
ODD_UTF8 = [c.encode() for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) if ODD_SPACE.match(c)]
ODD_KINDS = np.zeros(256, np.uint8)
ODD_KINDS[[c[0] for c in ODD_UTF8]] = [min(len(c), 2) for c in ODD_UTF8]
ODD_TWO, ODD_THREE = (np.array([int.from_bytes(c) for c in ODD_UTF8 if len(c) == k]) for k in (2, 3))


#: Bytes as ASCII letters, digits and others, and 3 for those beside which a word is not cut.
KINDS = np.array([3 if b == 0x27 or b > 0x7F else 0 if chr(b).isalpha() else 1 if chr(b).isdigit() else 2 for b in range(256)], np.uint8)


class Known:
    """Ids of pieces: a place for each piece, and each place's start and number of ids in one array."""

    def __init__(self):
        self.places: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.uint16)
        self.start, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.used = self.held = 0

    def add(self, pieces: list[str], ids: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        """New pieces, each with so many ids from its start on."""
        k, n = len(self.places), len(pieces)
        while len(self.start) < k + n:
            self.start, self.count = (np.concatenate((x, np.empty_like(x))) for x in (self.start, self.count))
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        self.places.update(zip(pieces, range(k, k + n)))
        self.start[k : k + n], self.count[k : k + n] = start + self.used, count
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.held += ENTRY * n + sum(map(len, pieces)) + 2 * len(ids)

    def find(self, pieces: list[str]) -> np.ndarray:
        """Places, -1 for unknown pieces."""
        return np.fromiter(map(self.places.get, pieces, repeat(-1)), np.int64, len(pieces))

    def join(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these places one after another, and how many each has."""
        count = self.count[places]
        end = np.cumsum(count, dtype=np.int64)
        kind = np.int32 if max(len(self.ids), end[-1] if len(end) else 0) < 1 << 30 else np.int64
        at = np.repeat((self.start[places] - end + count).astype(kind), count)
        at += np.arange(len(at), dtype=kind)
        return self.ids[at], count


class ColumnEncoder:
    """Ids of an Arrow column's texts, equal to Encoder.whole() of each."""

    def __init__(self, name: str):
        self.library = Encoder(name, keeps_space(name))
        self.young, self.older = Known(), Known()
        #: Words: the token of a mark that stands between two of them.
        self.between = None if self.library.keeps_space else int(self.library.whole(MARK)[0])

    def __call__(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        raw, at = text_arrays(column)
        odd = self.odd(raw, at, (raw == 0x20) | (raw == 0x0A)) if self.library.keeps_space else np.diff(at) > GROUP
        if not odd.any():
            return self.joined(raw, at)
        plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
        ids, counts = self.joined(*text_arrays(column.take(plain)))
        found = dict(zip(plain.tolist(), np.split(ids, np.cumsum(counts)[:-1]))) | {i: self.library.whole(raw[at[i] : at[i + 1]].tobytes().decode()) for i in rest.tolist()}
        parts = [found[i] for i in range(len(odd))]
        return np.concatenate(parts), np.array(list(map(len, parts)), np.int64)

    @staticmethod
    def odd(raw: np.ndarray, at: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Which texts only the library may cut: as in Encoder.split(), or longer than GROUP. gap: the spaces and line feeds."""
        bad = gap.copy()
        bad[1:] &= gap[:-1]
        start, end = at[:-1][np.diff(at) > 0], at[1:][np.diff(at) > 0]
        bad[start], bad[end - 1] = gap[start], bad[end - 1] | gap[end - 1]
        kind = ODD_KINDS[raw]
        bad |= kind == 1
        lead = np.flatnonzero(kind == 2)
        one, two, three = (np.append(raw, [np.uint8(0)] * 2)[lead + k].astype(np.int64) for k in range(3))
        bad[lead] |= np.isin(one << 8 | two, ODD_TWO) | np.isin(one << 16 | two << 8 | three, ODD_THREE)
        out = np.diff(at) > GROUP
        out[np.searchsorted(at, np.flatnonzero(bad), "right") - 1] = True
        return out

    def joined(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that are cut before each space and line feed, or into the words between white space."""
        import pyarrow as pa

        if self.library.keeps_space:
            first = np.append((raw == 0x20) | (raw == 0x0A), True)
        else:
            raw, at, first = self.words(raw, at)
        first[at] = True
        edges = np.flatnonzero(first)
        if len(edges) < 2:
            return np.empty(0, np.uint16), np.zeros(len(at) - 1, np.int64)
        cut = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        places = self.places(cut.dictionary.to_pylist())
        ids, counts = self.young.join(places[cut.indices.to_numpy()])
        before = np.concatenate(([0], np.cumsum(counts)))
        return ids, np.diff(before[np.searchsorted(edges, at)])

    @staticmethod
    def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts without their white space and with A-Z folded, as the library does both; where their pieces begin, and the end.

        A word is also cut between ASCII letters, digits and others, as the library's expression always ends a match
        there, but not beside an apostrophe, which may begin "'s" or "'ll". White space beyond U+0080 stays within
        words, where the library cuts it.
        """
        gap = SPACE_BYTES[raw]
        keep = np.flatnonzero(~gap)
        after = np.append(True, gap[:-1])[keep]
        at = np.searchsorted(keep, at)
        raw = raw[keep]
        raw += ((raw >= 65) & (raw <= 90)).view(np.uint8) << np.uint8(5)
        kind = KINDS[raw]
        after[1:] |= (kind[1:] != kind[:-1]) & (np.maximum(kind[1:], kind[:-1]) < 3)
        return raw, at, np.append(after, True)

    def trim(self) -> None:
        """After a task: only one generation stays, the younger one from half its bound on, else the larger one."""
        kept = self.young if self.young.held > COLUMN_BYTES // 2 else max(self.young, self.older, key=lambda x: x.held)
        self.young, self.older = Known(), kept
        trim_process()

    def places(self, pieces: list[str]) -> np.ndarray:
        """Places of distinct pieces in the younger generation, which the missing ones enter."""
        if self.young.held > COLUMN_BYTES:
            self.young, self.older = Known(), self.young
        out = self.young.find(pieces)
        if len(missing := np.flatnonzero(out < 0)):
            names = [pieces[i] for i in missing.tolist()]
            self.enter(names)
            out[missing] = self.young.find(names)
        return out

    def enter(self, pieces: list[str]) -> None:
        """Enters pieces that the younger generation lacks."""
        old = self.older.find(pieces)
        if len(known := np.flatnonzero(old >= 0)):
            ids, count = self.older.join(old[known])
            self.young.add([pieces[i] for i in known.tolist()], ids, np.cumsum(count) - count, count)
            pieces = [pieces[i] for i in np.flatnonzero(old < 0).tolist()]
        self.learn(pieces)

    def learn(self, pieces: list[str]) -> None:
        """Asks the library for new pieces, many in one call, as lines of one text or with marks between words."""
        if not self.library.keeps_space:
            for i in range(0, len(pieces), 512):
                self.learn_words(pieces[i : i + 512])
            return
        kinds: dict[str, list[str]] = {" ": [], "\n": [], "": []}
        for p in pieces:
            kinds[p[0] if p[0] in " \n" else ""].append(p)
        for kind, group in kinds.items():
            for i in range(0, len(group), 128):
                self.learn_lines(kind, group[i : i + 128])

    def learn_lines(self, kind: str, part: list[str]) -> None:
        if kind == "\n":  # a line feed is a token of its own, and the first of its piece
            ids = self.library.whole("".join(part))
            start = np.flatnonzero(ids == self.library.line)
            end = np.append(start[1:], len(ids))
        else:
            ids = self.library.whole("\n".join(part) + "\n")
            end = np.flatnonzero(ids == self.library.line)
            start = np.concatenate(([0], end[:-1] + 1))
        if len(start) == len(part):
            self.young.add(part, ids, start, end - start)
        else:
            self.learn_each(part)

    def learn_words(self, part: list[str]) -> None:
        ids = self.library.whole(f" {MARK} ".join([*part, ""]))
        end = np.flatnonzero(ids == self.between)
        if len(end) == len(part):
            start = np.concatenate(([0], end[:-1] + 1))
            self.young.add(part, ids, start, end - start)
        else:
            self.learn_each(part)

    def learn_each(self, part: list[str]) -> None:
        """Pieces that can't be told apart in one text."""
        for p in part:
            ids = self.library.whole(p)
            self.young.add([p], ids, np.zeros(1, np.int64), np.array([len(ids)]))


_encoders: dict[str, Encoder] = {}
_columns: dict[str, ColumnEncoder] = {}


def keeps_space(name: str) -> bool:
    return not name.startswith("word_")


def encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name, keeps_space(name))
    return _encoders[name]


def column_encoder(name: str) -> ColumnEncoder:
    if name not in _columns:
        _columns[name] = ColumnEncoder(name)
    return _columns[name]


def forget(name: str) -> None:
    """Drops a column encoder with all that it knows, so that stages after its own have the memory."""
    _columns.pop(name, None)
    trim_process()
