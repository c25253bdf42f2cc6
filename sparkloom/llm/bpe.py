"""Byte-pair encoding as a lazily determinised finite-state transducer.

A prefix of a word has exactly one canonical encoding, so the *last* token of every prefix is a function of the
bytes read.  The transducer's state is the set of places where a token that is still being read may have begun:
pairs of a trie node and the token that ends where it began.  States and transitions are made the first time they
are met and kept (up to ``MAX_STATES``, then the table starts afresh).  A token is emitted once every token still
being read begins behind it, which is at most a few token lengths later.
"""

from __future__ import annotations

import base64

import regex

MAX_STATES = 200_000
MAX_WORDS = 400_000


def parse_ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines() if line.strip())}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._edge: dict[int, int] = {}
        self._token: list[int] = [-1]
        self._inner: set[int] = set()
        for tok, rank in ranks.items():
            node = 0
            for b in tok:
                key = node << 8 | b
                nxt = self._edge.get(key)
                if nxt is None:
                    nxt = self._edge[key] = len(self._token)
                    self._token.append(-1)
                    self._inner.add(node)
                node = nxt
            self._token[node] = rank
        self._pairs: dict[tuple[int, int], bool] = {}
        self._words: dict[str, tuple[int, ...]] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1),)
        self._states: list[tuple] = [start]
        self._ids: dict[tuple, int] = {start: 0}
        self._go: dict[int, tuple[int, int, bool]] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The merge procedure itself, used for two-token strings when a transition is first made."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _follows(self, left: int, right: int) -> bool:
        if left < 0:
            return len(self.merged(self.bytes_of[right])) == 1
        ok = self._pairs.get((left, right))
        if ok is None:
            ok = self._pairs[left, right] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return ok

    def _transition(self, sid: int, byte: int) -> tuple[int, int, bool]:
        alive, last = [], -1
        for node, before in self._states[sid]:
            nxt = self._edge.get(node << 8 | byte)
            if nxt is None:
                continue
            tok = self._token[nxt]
            if last < 0 and tok >= 0 and self._follows(before, tok):
                last = tok
            if nxt in self._inner:
                alive.append((nxt, before))
        state = (*alive, (0, last))
        nid = self._ids.get(state)
        if nid is None:
            if len(self._states) >= MAX_STATES:
                self._reset()
                nid = self._ids.get(state)
            if nid is None:
                nid = self._ids[state] = len(self._states)
                self._states.append(state)
        move = (nid, last, not alive)
        if sid < len(self._states):
            self._go[sid << 8 | byte] = move
        return move

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token: run forwards, write the last token of each prefix, read back at cut points."""
        out: list[int] = []
        ends: list[int] = []
        sid, lens = 0, self.bytes_of
        for byte in piece:
            move = self._go.get(sid << 8 | byte)
            if move is None:
                before = len(self._states)
                move = self._transition(sid, byte)
                if len(self._states) < before:  # the table was begun afresh: the old number of this state is gone
                    sid = move[0]
            sid, last, lone = move
            ends.append(last)
            if lone and len(ends) > self.longest:
                self._flush(ends, out, lens)
            elif len(ends) >= 32 * self.longest:
                self._flush_settled(ends, out, lens)
        self._flush(ends, out, lens)
        return out

    def _flush_settled(self, ends: list[int], out: list[int], lens: dict[int, bytes]) -> None:
        """Emit what no later byte can change: the tokens before the place where all open readings have met."""
        places = set(range(len(ends) - self.longest, len(ends) + 1))
        while len(places) > 1:
            far = max(places)
            places.remove(far)
            places.add(far - len(lens[ends[far - 1]]))
        cut = places.pop()
        if cut > 0:
            tail = ends[cut:]
            del ends[cut:]
            self._flush(ends, out, lens)
            ends.extend(tail)

    @staticmethod
    def _flush(ends: list[int], out: list[int], lens: dict[int, bytes]) -> None:
        i, back = len(ends), []
        while i:
            tok = ends[i - 1]
            back.append(tok)
            i -= len(lens[tok])
        out.extend(reversed(back))
        ends.clear()


class Encoder:
    """Whole texts: pre-tokens by the vocabulary's published pattern, each through the transducer (kept per word)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.fst = Transducer(ranks)
        self.split = regex.compile(pattern)

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; none for a null or empty text.  Strings that look like special tokens are plain text."""
        out: list[int] = []
        if not text:
            return out
        words, extend = self.fst._words, out.extend
        for w in self.split.findall(text):
            ids = words.get(w)
            if ids is None:
                ids = tuple(self.fst.encode_piece(w.encode()))
                if len(w) <= 64:
                    if len(words) >= MAX_WORDS:
                        words.clear()
                    words[w] = ids
            extend(ids)
        return out


#: UTF-8 as a byte automaton: (state, first byte, last byte, next state); state 0 accepts.  Fixed values of the standard.
UTF8_MOVES = (
    (0, 0x00, 0x7F, 0), (0, 0xC2, 0xDF, 1), (0, 0xE0, 0xE0, 4), (0, 0xE1, 0xEC, 2), (0, 0xED, 0xED, 5), (0, 0xEE, 0xEF, 2),
    (0, 0xF0, 0xF0, 6), (0, 0xF1, 0xF3, 3), (0, 0xF4, 0xF4, 7), (1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2),
    (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2),
)
UTF8_NEXT = {(s, b): n for s, lo, hi, n in UTF8_MOVES for b in range(lo, hi + 1)}


class Decoder:
    """Ids to text piece by piece; a character cut by a token border waits for its rest, wrong bytes give U+FFFD."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.state, self.held = 0, bytearray()

    def feed(self, ids) -> str:
        out: list[str] = []
        for i in ids:
            for b in self.bytes_of[int(i)]:
                nxt = UTF8_NEXT.get((self.state, b))
                if nxt is None and self.held:
                    out.append("�")
                    self.held.clear()
                    self.state = 0
                    nxt = UTF8_NEXT.get((0, b))
                if nxt is None:
                    out.append("�")
                    continue
                self.held.append(b)
                self.state = nxt
                if nxt == 0:
                    out.append(self.held.decode())
                    self.held.clear()
        return "".join(out)

    def finish(self) -> str:
        tail = "�" if self.held else ""
        self.held.clear()
        self.state = 0
        return tail
