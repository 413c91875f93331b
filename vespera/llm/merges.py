"""Priority merges (byte-pair encoding): derivations of tokens, and which tokens may stand side by side.

A sequence of tokens is what the merges give exactly if each token alone gives itself and each
adjacent pair is compatible: re-running both derivations, no merge across the border comes first.
"""

from __future__ import annotations

from math import inf


class Merges:
    """ranks: token (bytes or str) -> priority, lower first; a pair merges if its concatenation has a rank.

    Atoms (single bytes or characters) needn't have one. Two tokens have different ranks.
    """

    def __init__(self, ranks: dict):
        self.ranks = ranks
        self._parts: dict = {}
        self._right: dict = {}
        self._left: dict = {}
        self.known: dict = {}

    def merge(self, text, below=inf) -> list:
        """The plain way, one merge after another, of merges with a rank under `below`."""
        parts, ranks = [text[i : i + 1] for i in range(len(text))], self.ranks
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], inf)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def parts(self, token) -> tuple | None:
        """The two tokens whose merge makes this one; None for an atom or a token that no text gives."""
        if token not in self._parts:
            found = self.merge(token, self.ranks[token]) if len(token) > 1 else ()
            self._parts[token] = tuple(found) if len(found) == 2 else None
        return self._parts[token]

    def reachable(self, token) -> bool:
        return len(token) == 1 or self.parts(token) is not None

    def _spine(self, token, side: int) -> list:
        """(piece, rank that made it, rank that takes it up) at one border of the token, the latest first."""
        known = self._right if side else self._left
        if token not in known:
            out, until = [], inf
            piece = token
            while True:
                made = self.ranks[piece] if len(piece) > 1 else -1
                out.append((piece, made, until))
                if len(piece) == 1:
                    break
                until, piece = made, self.parts(piece)[side]
            known[token] = out
        return known[token]

    def compatible(self, a, b) -> bool:
        known = self.known.get((a, b))
        if known is None:
            if len(self.known) > 150_000:
                self.known.clear()
            known = self.known[a, b] = self._apart(self._spine(a, 1), self._spine(b, 0))
        return known

    def _apart(self, xs: list, ys: list) -> bool:
        i = j = 0
        while True:
            (x, made_x, until_x), (y, made_y, until_y) = xs[i], ys[j]
            r = self.ranks.get(x + y)
            if r is not None and r < until_x and r <= until_y:
                return False
            if made_x < 0 and made_y < 0:
                return True
            if made_x >= made_y:
                i += 1
            else:
                j += 1
