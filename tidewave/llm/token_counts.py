"""Token counts by a finite-state tokenizer.

A byte-level BPE vocabulary is compiled into a deterministic transducer over bytes whose transitions carry the change
of the number of emitted tokens, so the sum along a path is the token count. The states are found when text first
needs them, and equal ones are merged:

* BPE of a word is the one token sequence in which each neighbouring pair encodes to itself. So the last token of every
  prefix follows from the last tokens of shorter prefixes, and the future of a prefix depends only on the starts from
  which its rest is still a proper prefix of a vocabulary entry, each with the token that ends there and its count.
  That tuple, counts taken relative to the end, is the state. States are finite in number.
* Words never influence each other: the pre-tokenizer (itself finite-state, evaluated on arrays of character classes)
  sends the transducer back to its root at each word start.

A text is cut into chunks of ``CHUNK`` bytes, all of which advance in lockstep, one byte a step, as array operations.
A chunk's state map (entry state to exit state and count) is constant behind its first word start. The maps then
compose by a scan over the chunks: the bytes in front of the first word start are run from the composed exit state of
the chunk before; chunks without any word start join the scan when their predecessor's exit state is known.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

CHUNK = 256
#: Bytes that advance together; bounds the memory of a batch.
BLOCK = 1 << 22
#: Compiled states a process keeps; beyond them it starts afresh, which costs time and changes no count.
MAX_STATES = 250_000
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
_BIAS = 128


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of each code point: letter, number, white space, or other."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            for a, b in [(m.start(), m.end())]:
                shift = lambda i: i if i < 0xD800 else i + 0x800
                table[shift(a) : shift(b - 1) + 1] = kind
    return table


def word_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pre-tokenizer starts words: runs of one class, an optional blank in front, English contractions.

    ``points`` are the code points of texts set one behind the other, ``first`` marks the first one of each text.
    """
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = char_classes()[points]
    space = kind == SPACE
    start = first.copy()
    last = np.append(first[1:], True)
    same = np.zeros(n, bool)
    same[1:] = kind[1:] == kind[:-1]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = points[:-1] == 0x20
    start |= ~space & ~same & ~after_blank
    start |= space & ~same
    next_word = np.append(~space[1:], False) & ~last
    start |= space & next_word
    mark = np.flatnonzero((points == 0x27) & start & ~last)
    if len(mark):
        wide = np.concatenate([points, np.zeros(3, points.dtype)])
        ends = np.concatenate([last, np.ones(3, bool)])
        a, b = wide[mark + 1], wide[mark + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ~ends[mark + 1] & np.isin(a * 256 + b, [ord(x) * 256 + ord(y) for x, y in ("re", "ve", "ll")])
        for which, width in ((one, 2), (two & ~one, 3)):
            at = mark[which]
            start[at + 1] = False
            stop = at + width
            stop = stop[~ends[stop - 1]]
            start[stop] = True
    return start


class Transducer:
    """The lazily compiled transducer of one byte-level BPE vocabulary in the tokenizers' JSON format."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # The byte-level alphabet, printable characters for themselves, the others from 256 on.
        plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
        odd = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}
        added = {x["content"] for x in spec["added_tokens"]}
        vocab = {bytes(byte_of[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in added}
        self.specials = sorted(added, key=len, reverse=True)
        self.vocab = vocab
        self.word = {i: w for w, i in vocab.items()}
        self.prefixes = {w[:k] for w in vocab for k in range(1, len(w))}
        self.encode = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=vocab, special_tokens={})._encode_single_piece
        self.pairs: dict = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.column = np.full(256, -1, np.int32)
        self.bytes: list[int] = []
        self.table = np.full((1 << 13, 64), -1, np.int32)
        self.states.append(())  # state 0: entry state unknown, counts nothing
        self.table[0] = _BIAS
        self._state(((b"", -1, 0),))  # state 1: a word starts

    def _state(self, key: tuple) -> int:
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.states)
            self.states.append(key)
            if found == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return found

    def _fits(self, before: int, word: bytes) -> bool:
        """Does a word that ends in token ``before`` go on with ``word`` as one token of its own?"""
        token = self.vocab[word]
        if before < 0:
            return self.encode(word) == [token]
        key = (before, token)
        fits = self.pairs.get(key)
        if fits is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            fits = self.pairs[key] = self.encode(self.word[before] + word) == [before, token]
        return fits

    def _compile(self, state: int, col: int) -> None:
        byte = bytes([self.bytes[col]])
        key = self.states[state]
        for head, token, count in key:  # the longest rest first
            word = head + byte
            if word in self.vocab and self._fits(token, word):
                ends, change = self.vocab[word], count + 1
                break
        else:
            raise AssertionError("each byte is a token, so some token ends here")
        kept = [(head + byte, token, count - change) for head, token, count in key if head + byte in self.prefixes]
        target = self._state((*kept, (b"", ends, 0)))
        self.table[state, col] = target << 8 | (change + _BIAS)

    def columns(self, block: np.ndarray) -> np.ndarray:
        for b in np.flatnonzero(np.bincount(block, minlength=256)):
            if self.column[b] < 0:
                self.column[b] = len(self.bytes)
                self.bytes.append(int(b))
        if len(self.bytes) > self.table.shape[1]:
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
            self.table[0] = _BIAS
            return self.columns(block)
        return self.column[block]

    def run(self, cols: np.ndarray, reset: np.ndarray, stop: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Advance lanes side by side. ``cols``, ``reset``: step by lane; lane i takes ``stop[i]`` steps. Exit states and counts."""
        state, total = state.copy(), np.zeros(len(state), np.int64)
        order = np.argsort(-stop, kind="stable")
        alive = np.searchsorted(-stop[order], -np.arange(len(cols)), side="left")
        cols, reset, state, total = cols[:, order], reset[:, order], state[order], total[order]
        for k in range(len(cols)):
            m = alive[k]
            if not m:
                break
            s, c = state[:m], cols[k, :m]
            s[reset[k, :m]] = 1
            v = self.table[s, c]
            if v.min() < 0:
                for x in np.unique(s[v < 0].astype(np.int64) * 256 + c[v < 0]):
                    self._compile(int(x) // 256, int(x) % 256)
                v = self.table[s, c]
            total[:m] += (v & 255) - _BIAS
            state[:m] = v >> 8
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], total[back]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text. Special strings inside texts count as one token, as the library has it."""
        pieces, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = [text]
            for special in self.specials:
                if special in text:
                    parts = [x for p in parts for x in p.split(special)]
                    extra[i] = len(parts) - 1
            for p in parts:
                if p:
                    pieces.append(p)
                    owner.append(i)
        out, at = extra, 0
        while at < len(pieces):
            to, size = at, 0
            while to < len(pieces) and (to == at or size + len(pieces[to]) <= BLOCK):
                size += len(pieces[to])
                to += 1
            np.add.at(out, np.array(owner[at:to]), self._block(pieces[at:to]))
            at = to
        return out

    def _block(self, texts: list[str]) -> np.ndarray:
        if len(self.states) > MAX_STATES:
            self.reset()
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        chars = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.zeros(len(points), bool)
        first[np.cumsum(chars) - chars] = True
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        offset = np.cumsum(width) - width
        data = np.frombuffer(joined.encode(), np.uint8)
        begins = np.zeros(len(data), bool)
        begins[offset[word_starts(points, first)]] = True
        base = offset[first]
        size = np.diff(np.append(base, len(data)))
        chunks = -(-size // CHUNK)
        text_of = np.repeat(np.arange(len(texts)), chunks)
        nth = np.arange(len(text_of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        lo = base[text_of] + nth * CHUNK
        length = np.minimum(CHUNK, size[text_of] - nth * CHUNK)
        index = np.minimum(lo[None, :] + np.arange(CHUNK)[:, None], len(data) - 1)
        cols, reset = self.columns(data)[index], begins[index]
        exits, total = self.run(cols, reset, length, np.zeros(len(lo), np.int64))
        inside = reset & (np.arange(CHUNK)[:, None] < length)
        head = np.where(inside.any(axis=0), inside.argmax(axis=0), length)
        waiting = np.flatnonzero(head)
        none = np.zeros_like(reset)
        while len(waiting):
            known = exits[waiting - 1] > 0
            ready, waiting = waiting[known], waiting[~known]
            out, count = self.run(cols[:, ready], none[:, : len(ready)], head[ready], exits[ready - 1])
            total[ready] += count
            whole = head[ready] == length[ready]
            exits[ready[whole]] = out[whole]
        return np.bincount(text_of, weights=total, minlength=len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def token_counter(path: str):
    """A column function: number of tokens of a text, 0 for a null."""

    @F.pandas_udf(LongType())
    def count(text: pd.Series) -> pd.Series:
        return pd.Series(transducer(path).counts(text.fillna("").tolist()))

    return count


def token_counts(docs: DataFrame, vocabulary: str, *, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of each text, one row per row of ``docs``.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows give repeated rows; other
    columns are not read. No shuffle: one pass over (id, text).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), token_counter(vocabulary)(text).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
