"""A SentencePiece BPE model as a weighted finite-state transducer.

The transducer is the composition of three machines.

* The normaliser puts a space mark before the text and turns every space into the mark.
* The lexicon is a trie over UTF-8 bytes whose final states emit a piece; a character that is no
  piece takes a byte-fallback arc that emits one token a byte.
* The grammar is an acceptor over pieces whose state is the last piece. An arc has weight 0 if the
  model's merges leave the two pieces, put side by side, as they are, and infinite weight if not.

Merges go by score, then from left to right, so whether a merge crosses a place depends on its two
neighbours alone. Hence a segmentation is the model's own exactly if every piece and every pair of
neighbours is stable, and the one path of finite weight in the tropical semiring is the encoding.

Texts are cut before composition only where no piece can cross: before a space that
follows no other space mark, and on both sides of characters that occur in no longer piece. Each distinct
part is composed once, all parts of a batch side by side: arcs are found by one walk of the trie from
all characters at once, and the shortest path goes forward over positions in lockstep. As any prefix
has one path of finite weight, one piece a position is all that the search must carry.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np

from .bytescan import mix, span_hasher

MARK = "▁"
_MARK = MARK.encode()
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2


def _fields(blob: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            c = blob[at]
            at += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while at < len(blob):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, blob[at:at + n]
            at += n


class PieceModel:
    """The parts of a model file that the transducer is built from."""

    def __init__(self, blob: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict[int, object] = {}
        rules: dict[int, object] = {}
        for number, value in _fields(blob):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f[1].decode())
                self.scores.append(float(np.frombuffer(f.get(2, bytes(4)), "<f4")[0]))
                self.kinds.append(int(f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        if trainer.get(3) != BPE or not trainer.get(35):
            raise ValueError("a BPE model with byte fallback is needed")
        if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1) or set(self.kinds) - {1, 2, 3, 6}:
            raise ValueError("only the identity normaliser with escaped spaces is compiled here")
        self.prefix = bool(rules.get(3, 1))
        self.size = len(self.pieces)
        self.score = {p: s for p, s, k in zip(self.pieces, self.scores, self.kinds, strict=True) if k == NORMAL}
        self.byte_ids = np.array([self.pieces.index(f"<0x{b:02X}>") for b in range(256)], np.int32)

    def merges_cross(self, text: str, place: int) -> bool:
        """Whether merging ``text`` joins something across ``place`` (0: never asked)."""
        parts, score = list(text), self.score
        edge = place  # index of the part that begins at the place
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return False
            if at == edge - 1:
                return True
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            if at < edge:
                edge -= 1
        return False

    def is_stable(self, piece: str) -> bool:
        """Whether merging the piece's characters gives the piece."""
        parts, score = list(piece), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return False
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return True


class Transducer:
    """Compiled form; built once in each Python worker."""

    MEMO = 1 << 19     # distinct parts whose encoding is remembered
    PAIRS = 1 << 20    # slots of the table of known pairs

    def __init__(self, model: PieceModel):
        self.model = model
        self.unknown, self.begin = model.size, model.size + 1
        lexicon = [(p.encode(), i) for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True))
                   if k == NORMAL and model.is_stable(p)]
        longer = {c for p in model.score if len(p) > 1 for c in p}
        crossing = any(MARK in p.lstrip(MARK) for p in model.score)
        self.breaks = np.zeros(256, bool)
        self.breaks[[b for b in range(128) if chr(b) not in longer and b != 32]] = True
        self.cut_marks = not crossing
        # Trie: a row of next states for each inner state.
        inner: dict[bytes, int] = {b"": 0}
        for p, _ in lexicon:
            for n in range(1, len(p)):
                inner.setdefault(p[:n], len(inner))
        states = dict(inner)
        for p, _ in lexicon:
            states.setdefault(p, len(states))
        self.inner = len(inner)
        used = sorted({b for p, _ in lexicon for b in p})
        self.byte_class = np.full(256, len(used), np.int32)
        self.byte_class[used] = np.arange(len(used))
        kind = np.uint16 if len(states) < 65535 else np.uint32
        self.none = kind(np.iinfo(kind).max)
        self.next = np.full((self.inner, len(used) + 1), self.none, kind)
        for p, s in states.items():
            if p:
                self.next[inner[p[:-1]], self.byte_class[p[-1]]] = s
        self.emits = np.full(len(states), -1, np.int32)
        for p, i in lexicon:
            self.emits[states[p]] = i
        self.known = np.zeros(self.PAIRS, np.uint64)
        self.keys = np.zeros(0, np.uint64)
        self.begins = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.tokens = np.zeros(0, np.int32)

    # -------------------------------------------------------------- grammar
    def finite(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the arc from state ``left`` over piece ``right`` has weight 0."""
        out = (left >= self.unknown) | (right >= self.unknown)
        ask = np.flatnonzero(~out)
        if not len(ask):
            return out
        pair = (left[ask].astype(np.uint64) * np.uint64(1 << 24) + right[ask].astype(np.uint64) + np.uint64(1)) << np.uint64(1)
        slot = (mix(pair) & np.uint64(self.PAIRS - 1)).astype(np.int64)
        found = self.known[slot]
        miss = (found >> np.uint64(1)) != (pair >> np.uint64(1))
        if miss.any():
            pieces, cross = self.model.pieces, self.model.merges_cross
            new, first, back = np.unique(pair[miss], return_index=True, return_inverse=True)
            a, b = left[ask][miss][first].tolist(), right[ask][miss][first].tolist()
            ok = np.fromiter((not cross(pieces[x] + pieces[y], len(pieces[x])) for x, y in zip(a, b, strict=True)),
                             bool, len(new))
            self.known[slot[miss][first]] = new | ok.astype(np.uint64)
            found[miss] = (new | ok.astype(np.uint64))[back]
        out[ask] = (found & np.uint64(1)).astype(bool)
        return out

    # -------------------------------------------------------------- shortest paths
    def compose(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, tokens of each part) of normalised parts."""
        data = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(parts)), sizes)
        stop = ends[owner]
        classes = self.byte_class[data]
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.diff(np.append(heads, len(data)))
        at, state, from_, to, piece = heads, np.zeros(len(heads), self.next.dtype), [], [], []
        lone = np.zeros(len(data), bool)
        span = np.zeros(len(data), np.int64)
        span[heads] = width
        depth = 0
        while len(at):
            live = (state < self.inner) & (at + depth < stop[at])
            at, state = at[live], state[live]
            state = self.next[state, classes[at + depth]]
            depth += 1
            live = state != self.none
            at, state = at[live], state[live]
            emit = self.emits[state]
            hit = emit >= 0
            from_.append(at[hit])
            to.append(at[hit] + depth)
            piece.append(emit[hit])
            lone[at[hit & (span[at] == depth)]] = True
        bare = heads[~lone[heads]]
        from_.append(bare)
        to.append(bare + span[bare])
        piece.append(np.full(len(bare), self.unknown, np.int32))
        start, end, piece = np.concatenate(from_), np.concatenate(to), np.concatenate(piece)
        part = owner[start]
        begin = ends - sizes
        reach = end - begin[part]
        order = np.argsort(reach, kind="stable")
        start, end, piece = (start + part)[order], (end + part)[order], piece[order]
        last = np.full(len(data) + len(parts), -1, np.int64)  # the piece that ends here on the path
        back = np.zeros(len(last), np.int64)
        last[begin + np.arange(len(parts))] = self.begin
        edges = np.flatnonzero(np.diff(reach[order])) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(order)], strict=True):
            before = last[start[lo:hi]]
            open_ = np.flatnonzero(before >= 0)
            ok = open_[self.finite(before[open_], piece[lo:hi][open_])]
            last[end[lo:hi][ok]] = piece[lo:hi][ok]
            back[end[lo:hi][ok]] = start[lo:hi][ok]
        here, base = ends + np.arange(len(parts)), begin + np.arange(len(parts))
        who, step, ids, where = [], [], [], []
        live, n = np.arange(len(parts)), 0
        while len(live):
            live = live[here[live] > base[live]]
            pos = here[live]
            if (last[pos] < 0).any():
                raise RuntimeError("no path of finite weight")
            who.append(live)
            step.append(np.full(len(live), n))
            ids.append(last[pos])
            where.append(back[pos])
            here[live] = back[pos]
            n += 1
        who, step, ids, where = map(np.concatenate, (who, step, ids, where))
        order = np.lexsort((-step, who))
        who, ids, where = who[order], ids[order], where[order] - who[order]  # byte positions again
        raw = ids == self.unknown
        count = np.where(raw, span[np.minimum(where, max(len(data) - 1, 0))] if len(data) else 0, 1)
        out = np.repeat(ids, count).astype(np.int32)
        inside = np.arange(len(out)) - np.repeat(np.cumsum(count) - count, count)
        spell = np.repeat(raw, count)
        out[spell] = self.model.byte_ids[data[(np.repeat(where, count) + inside)[spell]]]
        return out, np.bincount(np.repeat(who, count), minlength=len(parts))

    # -------------------------------------------------------------- encoding
    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all texts, number of ids of each)."""
        lead = b" " if self.model.prefix else b""
        raw = b"".join([lead + t if t else b"" for t in texts])
        sizes = np.fromiter((len(t) + len(lead) if t else 0 for t in texts), np.int64, len(texts))
        data = np.frombuffer(raw, np.uint8)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        first = np.zeros(len(data), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        if self.cut_marks:
            space = data == 32
            mark = space.copy()  # a mark written out in the text counts as a space
            mark[2:] |= (data[2:] == _MARK[2]) & (data[1:-1] == _MARK[1]) & (data[:-2] == _MARK[0])
            first[1:] |= space[1:] & ~mark[:-1]
        lone = self.breaks[data]
        first |= lone
        first[1:] |= lone[:-1]
        a = np.flatnonzero(first)
        b = np.append(a[1:], len(data))
        keys, some, back = np.unique(span_hasher(data)(a, b), return_index=True, return_inverse=True)
        spot = np.searchsorted(self.keys, keys)
        miss = np.ones(len(keys), bool)
        inside = spot < len(self.keys)
        miss[inside] = self.keys[spot[inside]] != keys[inside]
        new = np.flatnonzero(miss)
        if len(new):
            parts = [raw[x:y].replace(b" ", _MARK) for x, y in zip(a[some[new]].tolist(), b[some[new]].tolist(), strict=True)]
            ids, count = self.compose(parts)
            if len(self.keys) + len(new) > self.MEMO:  # start anew, with what this batch needs
                held = keys[~miss]
                old = np.searchsorted(self.keys, held)
                self.tokens = self._gather(self.begins[old], self.sizes[old])
                self.keys, self.sizes = held, self.sizes[old]
                self.begins = np.cumsum(self.sizes) - self.sizes
            place = np.searchsorted(self.keys, keys[new])
            self.begins = np.insert(self.begins, place, len(self.tokens) + np.cumsum(count) - count)
            self.sizes = np.insert(self.sizes, place, count)
            self.keys = np.insert(self.keys, place, keys[new])
            self.tokens = np.concatenate((self.tokens, ids))
            spot = np.searchsorted(self.keys, keys)
        count = self.sizes[spot][back]
        out = self._gather(self.begins[spot][back], count)
        total = np.concatenate(([0], np.cumsum(count)))
        text_ends = np.searchsorted(a, np.cumsum(sizes))
        return out, np.diff(np.concatenate(([0], total[text_ends])))

    def _gather(self, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self.tokens[np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]

    # -------------------------------------------------------------- decoding
    @cached_property
    def spelling(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = [(bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else
                  " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode())
                 for p, k in zip(self.model.pieces, self.model.kinds, strict=True)]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        return np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Texts of consecutive lists of ids (bytes that are no UTF-8 stay as they are)."""
        letters, begins, sizes = self.spelling
        n = sizes[ids]
        flat = letters[np.repeat(begins[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes()
        ends = np.concatenate(([0], np.cumsum(n)))[np.cumsum(counts)].tolist() if len(counts) else []
        out, at = [], 0
        for end in ends:
            text = flat[at:end]
            out.append(text[1:] if self.model.prefix and text[:1] == b" " else text)
            at = end
        return out
