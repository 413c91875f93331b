"""Token counts by a compiled finite-state transducer.

The merges of a sentence-piece vocabulary are compiled, as texts call for it, into a deterministic
transducer. A state holds what the tokens of a prefix can still influence: every vocabulary prefix
that ends here, the last token before it, and how many tokens lie between. Each transition is
annotated with the change of the token count, so a text is counted without building its tokens.

A text is cut into chunks, at its spaces. No piece has a space after another character, so a chunk
that starts with a space forgets its entry state: its state map is constant, and such maps compose
by adding their token counts. A longer word is cut further. Each of its chunks has a map from entry
states to exit states and token counts, first for the state that the last characters before the
chunk lead to, which nearly always is the entry state; the maps compose in a prefix scan of
logarithmic depth, and one that is asked for another state is extended. States are bounded: between
chunks they are known by what they hold, so compiled ones may be forgotten.

Nulls and empty texts have no token. Rows are independent: ties, repeated rows and empty tables
need no rule, and further columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vespera.llm.common import blocks, forget_late, map_arrow, strings
from vespera.llm.merges import Merges

SPACE = "▁"
START = ((0, None, 0),)


class Transducer:
    """States are interned; moves[state][char] = (next state, tokens emitted)."""

    def __init__(self, ranks: dict[str, float], chars: set[str], most_states: int = 150_000):
        self.merges, self.chars, self.most = Merges(ranks), chars, most_states
        self.child: list[dict[str, int]] = [{}]
        self.token: list[str | None] = [None]
        for piece in [*chars, *ranks]:
            if not self.merges.reachable(piece):
                continue
            node = 0
            for c in piece:
                to = self.child[node].get(c)
                if to is None:
                    to = self.child[node][c] = len(self.token)
                    self.token.append(None)
                    self.child.append({})
                node = to
            self.token[node] = piece
        self.reset()

    def reset(self) -> None:
        self.keys, self.ids, self.moves, self.last = [START], {START: 0}, [{}], [None]

    def build(self, state: int, c: str) -> tuple[int, int]:
        if c not in self.chars:  # its bytes are the tokens, and nothing merges with them
            move = self.moves[state][c] = (0, len(c.encode("utf-8", "surrogatepass")))
            return move
        went, last, delta = [], None, 0
        child, tokens, compatible = self.child, self.token, self.merges.compatible
        for node, before, count in self.keys[state]:
            to = child[node].get(c)
            if to is None:
                continue
            if last is None and (token := tokens[to]) is not None and (before is None or compatible(before, token)):
                last, delta = token, count + 1
            if child[to]:
                went.append((to, before, count))
        key = (*(went if not delta else [(to, before, count - delta) for to, before, count in went]), (0, last, 0))
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
            self.last.append(last)
        move = self.moves[state][c] = (to, delta)
        return move

    def run(self, text: str, state: int = 0) -> tuple[int, int]:
        total, moves = 0, self.moves
        for c in text:
            move = moves[state].get(c) or self.build(state, c)
            state = move[0]
            total += move[1]
        return state, total

    def state_of(self, key: tuple) -> int:
        """The number of the state that holds this, also if it was forgotten."""
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
            self.last.append(key[-1][1])
        return found

    def through(self, text: str, entry: tuple) -> tuple[tuple, int]:
        """What the exit state holds, and the tokens emitted, from a state that holds `entry`."""
        self.tidy()
        state, total = self.run(text, self.state_of(entry))
        return self.keys[state], total

    def first_token(self, text: str, chunk: int = 4096) -> str:
        """The first token of a text: last tokens of all prefixes, followed back from the end."""
        key, lasts = START, []
        for at in range(0, len(text), chunk):
            self.tidy()
            state = self.state_of(key)
            for c in text[at : at + chunk]:
                state = (self.moves[state].get(c) or self.build(state, c))[0]
                lasts.append(self.last[state] or c)
            key = self.keys[state]
        at, token = len(text), text
        while at > 0:
            token = lasts[at - 1]
            at -= len(token)
        return token

    def tidy(self) -> None:
        """Forgets compiled states once they are many; later texts compile anew what they need."""
        if len(self.keys) > self.most:
            self.reset()


class ChunkMap(dict):
    """entry state -> (exit state, tokens) of a chunk, for the entry states that were asked for."""

    def __init__(self, transducer: Transducer, text: str):
        super().__init__()
        self.transducer, self.text = transducer, text

    def __missing__(self, entry: tuple) -> tuple[tuple, int]:
        out = self[entry] = self.transducer.through(self.text, entry)
        return out


class Composed(dict):
    """The map of two neighbouring stretches, for the entry states that the first one has, and others when asked for."""

    def __init__(self, first: dict, second: dict):
        super().__init__()
        self.first, self.second = first, second
        for entry in list(first):
            self[entry]

    def __missing__(self, entry: tuple) -> tuple[tuple, int]:
        between, n = self.first[entry]
        exit_, more = self.second[between]
        out = self[entry] = (exit_, n + more)
        return out


def prefix_scan(maps: list[dict]) -> list[dict]:
    """The maps of all prefixes, in a logarithmic number of rounds; the compositions of a round are independent."""
    step = 1
    while step < len(maps):
        maps = maps[:step] + [Composed(maps[i - step], maps[i]) for i in range(step, len(maps))]
        step *= 2
    return maps


class Counter(dict):
    """word (without its space) -> tokens of space + word: the constant state maps of chunks, kept by content."""

    def __init__(self, path: str, most: int = 250_000, chunk: int = 4096):
        super().__init__()
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        plain = {model.id_to_piece(i): -model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        blank = {p for p in plain if set(p) == {SPACE}}
        if any(SPACE in p.lstrip(SPACE) for p in plain) or any(p.startswith(SPACE * 2) for p in plain.keys() - blank):
            raise ValueError("pieces must have spaces in front only, and several only among themselves")
        if model.encode("a  b") == model.encode("a b") or model.encode("Ａ") == model.encode("A") or model.encode("a")[0] != model.encode(" a")[-1]:
            raise ValueError("a model that adds a space in front and doesn't alter the text is needed")
        ranks = {p: r for p, r in plain.items() if len(p) > 1 and p not in blank}
        if blank and min(plain[p] for p in blank if len(p) > 1) <= max(ranks.values()):
            raise ValueError("merges of spaces must come last")
        self.blank, self.most, self.chunk = blank, most, chunk
        self.transducer = Transducer(ranks, {p for p in plain if len(p) == 1})
        self.runs = re.compile(" +[^ ]*")

    def __missing__(self, word: str) -> int:
        if len(self) > self.most:
            forget_late(self)
        if len(word) <= self.chunk:
            self.transducer.tidy()
            n = self[word] = self.transducer.run(SPACE + word)[1]
            return n
        return self.long_word(SPACE + word)

    def long_word(self, text: str, before: int = 64) -> int:
        """By the maps of its chunks; equal chunks share one."""
        parts = [text[at : at + self.chunk] for at in range(0, len(text), self.chunk)]
        kept = {p: ChunkMap(self.transducer, p) for p in parts}
        maps = [kept[p] for p in parts]
        maps[0][START]
        for last, own in zip(parts, maps[1:], strict=False):
            own[self.transducer.through(last[-before:], START)[0]]
        return prefix_scan(maps)[-1][START][1]

    def spaces(self, n: int) -> int:
        """Tokens of n spaces alone; merges of spaces come leftmost first."""
        done: list[int] = []
        for _ in range(n):
            done.append(1)
            while len(done) > 1 and SPACE * (done[-2] + done[-1]) in self.blank:
                done[-2:] = [done[-2] + done[-1]]
        return len(done)

    def after_spaces(self, run: str) -> int:
        """Tokens of two or more spaces and a word."""
        word = run.lstrip(" ")
        k = len(run) - len(word)
        if not word:
            return self.spaces(k)
        if k == 1:
            return self[word]
        alone = self.transducer.first_token(SPACE + word) == SPACE
        return self[word] - alone + self.spaces(k if alone else k - 1)

    def chunks(self, text: str) -> list[int]:
        """Tokens that each chunk of the text emits."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return list(map(self.__getitem__, text.split(" ")))
        return list(map(self.after_spaces, self.runs.findall(" " + text)))

    def count_batch(self, texts: list[str]) -> np.ndarray:
        return np.fromiter((sum(self.chunks(t)) for t in texts), np.int64, len(texts))


@lru_cache(1)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every text; no shuffle, memory bounded by a batch and the caches."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path)
        for part in blocks(batches, "text"):
            n = own.count_batch(strings(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = map_arrow(rows, count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
