"""Token counts by a finite-state transducer compiled from a byte-pair tokenizer's file.

The tokenizer's splitting into words is a scan over character classes. Inside a word, the last token of
every prefix is known once it is known for the shorter prefixes: token t ends the prefix if what stands
before t ends in a token that keeps its border with t. A state holds what the next symbols can depend
on: for every suffix that may still grow into a token, its place in the trie of tokens, the token
before it, and how many tokens that leaves behind. A transition carries the change of the token count,
so the sum over a text is its number of tokens. States and transitions are compiled when first met and
kept in one dense table, which begins anew when it has reached its size.

Symbols are cut into chunks of even size that walk the table side by side. A chunk with a word end maps
every entry state to one exit state; a chunk inside a long word gets a map over the likely entry states,
and the maps are composed by a parallel prefix scan (a state that was not foreseen is walked afresh).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_groups

#: Symbols of a chunk, states of the table, characters walked together, and characters of a piece of a long text.
CHUNK, MAX_STATES, GROUP_CHARS, PIECE_CHARS = 256, 120_000, 1 << 20, 1 << 20
#: Entry states foreseen for a chunk inside a word: those of a word begun so many symbols before it.
FORESEEN = tuple(range(16, 32))
SPACE, LETTER, DIGIT, OTHER, UNKNOWN = range(5)
#: Marks the last symbol of a word.
END = 256
# Fixed values of the tokenizer's split pattern: what may follow an apostrophe that begins a word.
AFTER_APOSTROPHE = ("s", "t", "re", "ve", "m", "ll", "d")
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def byte_characters() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies, reversed."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Transducer:
    """Lazily compiled transducer from word symbols (bytes, the last of a word plus ``END``) to token counts."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str, max_states: int = MAX_STATES):
        to_byte, self.max_states = byte_characters(), max_states
        self.tokens: dict[int, tuple[int, ...]] = {}
        for text, i in vocabulary.items():
            ends = bool(suffix) and text.endswith(suffix)
            symbols = [to_byte[c] for c in (text[: -len(suffix)] if ends else text)]
            if symbols:
                self.tokens[i] = (*symbols[:-1], symbols[-1] + END * ends)
        self.single = {s[0]: i for i, s in self.tokens.items() if len(s) == 1}
        self.ends = bool(suffix)
        if not self.ends:
            self.single |= {b + END: i for b, i in list(self.single.items())}
        pairs = (m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges)
        self.merges = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.child: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        for i, symbols in self.tokens.items():
            node = 0
            for s in symbols:
                node = self.child[node].setdefault(s, len(self.child))
                if node == len(self.child):
                    self.child.append({})
                    self.token_at.append(-1)
            self.token_at[node] = i
        self.own: dict[int, bool] = {}
        self.border: dict[tuple[int, int], bool] = {}
        self._begin()

    def _begin(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.column = np.full(256, -1, np.int32)
        self.columns = 0
        self.next = np.full((1024, 64), -1, np.int32)
        self.gain = np.zeros((1024, 64), np.int16)
        self.last = np.zeros((1024, 64), np.int16)
        self.seen_last = np.zeros((1024, 64), bool)
        self.start = self._state(((0, -1, 0),))

    def encode(self, symbols) -> list[int]:
        """Token ids by merging the pair of lowest rank, the leftmost first, until none is left."""
        ids = [self.single[s] for s in symbols]
        while len(ids) > 1:
            rank, at = min((self.merges.get(p, (1 << 60,))[0], k) for k, p in enumerate(zip(ids, ids[1:])))
            if rank == 1 << 60:
                break
            ids[at : at + 2] = [self.merges[ids[at], ids[at + 1]][1]]
        return ids

    def _stands(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow ``before`` (-1: the word's begin): their border outlives merging."""
        key = (before, token)
        if (known := self.border.get(key)) is None:
            if before < 0:
                known = self.encode(self.tokens[token]) == [token]
            else:
                known = self._stands(-1, token) and self.encode(self.tokens[before] + self.tokens[token]) == [before, token]
            if len(self.border) > 4_000_000:
                self.border.clear()
            self.border[key] = known
        return known

    def _state(self, key: tuple) -> int:
        if (i := self.number.get(key)) is None:
            i = self.number[key] = len(self.states)
            self.states.append(key)
            if i >= len(self.next):
                grow = lambda a, v: np.concatenate([a, np.full(a.shape, v, a.dtype)])
                self.next, self.gain, self.last, self.seen_last = grow(self.next, -1), grow(self.gain, 0), grow(self.last, 0), grow(self.seen_last, False)
        return i

    def _token(self, node: int, symbol: int) -> int:
        """Token that ends with ``symbol`` below ``node``; without end marks a last symbol is like any other."""
        below = self.child[node].get(symbol if self.ends or symbol < END else symbol - END)
        return -1 if below is None else self.token_at[below]

    def compile(self, state: int, symbol: int) -> None:
        """Fill in one transition."""
        items, found = self.states[state], None
        for node, before, behind in items:
            token = self._token(node, symbol)
            if token >= 0 and self._stands(before, token):
                found = (token, behind + 1)
                break
        if found is None:
            raise ValueError("the tokenizer's merges do not cover this word")
        token, gain = found
        c = self.column[symbol % END]
        if symbol >= END:
            self.last[state, c], self.seen_last[state, c] = gain, True
            return
        grown = []
        for node, before, behind in items:
            below = self.child[node].get(symbol)
            if below is not None and self.child[below]:
                grown.append((below, before, behind - gain))
        target = self._state((*grown, (0, token, 0)))
        self.next[state, c], self.gain[state, c] = target, gain

    def walk(self, symbols: np.ndarray, entry: np.ndarray, begin: np.ndarray, stop: np.ndarray, out: np.ndarray | None) -> np.ndarray:
        """Exit state of every lane that reads symbols[begin:stop] from its entry state; gains go to ``out``."""
        state, step = entry.copy(), 0
        length = stop - begin
        live = np.flatnonzero(length > 0)
        while len(live):
            at = begin[live] + step
            s = symbols[at]
            c, final = self.column[s % END], s >= END
            state[live], gain = self._step(state[live], s, c, final)
            if out is not None:
                out[at] = gain
            step += 1
            live = live[length[live] > step]
        return state

    def _step(self, state, s, c, final):
        known = np.where(final, self.seen_last[state, c], self.next[state, c] >= 0)
        if not known.all():
            for key in np.unique(state[~known].astype(np.int64) * 512 + s[~known]):
                self.compile(int(key) >> 9, int(key) & 511)
        return np.where(final, self.start, self.next[state, c]), np.where(final, self.last[state, c], self.gain[state, c])

    def prepare(self, symbols: np.ndarray) -> None:
        """Room for the bytes that occur; a full table begins anew."""
        if len(self.states) > self.max_states:
            self._begin()
        for b in np.flatnonzero(np.bincount(symbols % END, minlength=END)):
            if self.column[b] < 0:
                if self.columns == self.next.shape[1]:
                    wide = lambda a, v: np.concatenate([a, np.full(a.shape, v, a.dtype)], 1)
                    self.next, self.gain, self.last, self.seen_last = wide(self.next, -1), wide(self.gain, 0), wide(self.last, 0), wide(self.seen_last, False)
                self.column[b], self.columns = self.columns, self.columns + 1

    def gains(self, symbols: np.ndarray, chunk: int | None = None) -> np.ndarray:
        """Change of the token count at every symbol; the first symbol begins a word, the last one ends one."""
        n = len(symbols)
        out = np.zeros(n, np.int16)
        if not n:
            return out
        self.prepare(symbols)
        low = np.arange(0, n, chunk or CHUNK)
        high = np.minimum(low + (chunk or CHUNK), n)
        ends = np.flatnonzero(symbols >= END)
        first = np.searchsorted(ends, low)  # the first word end at or after a chunk's begin
        resume = np.where(first < len(ends), ends[np.minimum(first, len(ends) - 1)] + 1, n)
        constant = resume <= high  # these chunks have a word end: one exit state whatever the entry
        start = np.full(len(low), self.start, np.int32)
        exits = self.walk(symbols, start, np.minimum(resume, high), high, out)
        entry = np.concatenate([[self.start], exits[:-1]]).astype(np.int32)
        known = np.concatenate([[True], constant[:-1]])
        exits[~constant & known] = self.walk(symbols, entry[~constant & known], low[~constant & known], high[~constant & known], None)
        if not known.all():
            self._compose(symbols, low, high, constant, known, entry, exits)
        self.walk(symbols, entry, low, np.minimum(resume, high), out)
        return out

    def _compose(self, symbols, low, high, constant, known, entry, exits) -> None:
        """Entry states of chunks that follow a chunk without a word end, by a prefix scan over maps."""
        lanes = np.flatnonzero(~known)
        k = len(FORESEEN)
        begin = np.maximum(low[lanes, None] - np.array(FORESEEN), 0)
        guess = self.walk(symbols, np.full(len(lanes) * k, self.start, np.int32), begin.ravel(), np.repeat(low[lanes], k), None).reshape(-1, k)
        ends = self.walk(symbols, guess.ravel(), np.repeat(low[lanes], k), np.repeat(high[lanes], k), None).reshape(-1, k)
        ends = np.where(constant[lanes, None], exits[lanes, None], ends)
        # step[i, j]: which guess of the next lane the exit of guess j is, -1: none of them
        follows = np.concatenate([lanes[1:] == lanes[:-1] + 1, [False]])
        same = ends[:-1, :, None] == guess[1:, None, :]
        step = np.full((len(lanes), k), -1)
        step[:-1] = np.where(same.any(2) & follows[:-1, None], same.argmax(2), -1)
        # first[i]: the guess of lane i that its true entry is, where the lane before it has a known entry
        truth = np.where(known[lanes - 1] & ~constant[lanes - 1], exits[lanes - 1], -1)
        hit = guess == truth[:, None]
        first = np.where(hit.any(1), hit.argmax(1), -1)
        # maps of 1, 2, 4, ... chunks; ``reach`` is the guess that holds at each lane, as far as it is known
        reach, jump, width = first.copy(), step, 1
        while width < len(lanes):
            ahead = np.full(len(lanes), -1)
            from_here = reach[:-width]
            ahead[width:] = np.where(from_here >= 0, jump[np.arange(len(lanes) - width), np.maximum(from_here, 0)], -1)
            reach = np.where(reach >= 0, reach, ahead)
            onward = np.full_like(jump, -1)
            onward[:-width] = np.where(jump[:-width] >= 0, np.take_along_axis(jump[width:], np.maximum(jump[:-width], 0), 1), -1)
            jump, width = onward, 2 * width
        for i, lane in enumerate(lanes):
            if reach[i] >= 0 and (i == 0 or reach[i - 1] >= 0 or known[lane - 1]):
                entry[lane] = guess[i, reach[i]]
            else:
                entry[lane] = exits[lane - 1]
            if not constant[lane]:
                if reach[i] >= 0 and guess[i, reach[i]] == entry[lane]:
                    exits[lane] = ends[i, reach[i]]
                else:  # not foreseen: walk this chunk from its true entry
                    exits[lane] = self.walk(symbols, entry[lane : lane + 1], low[lane : lane + 1], high[lane : lane + 1], None)[0]


class TokenCounter:
    """Token counts of whole texts as the tokenizer file gives them, without special tokens added."""

    def __init__(self, path: str, max_states: int = MAX_STATES):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        pattern = [p.get("pattern", {}).get("Regex") for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        plain = all(not t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        odd = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")]
        if model["type"] != "BPE" or SPLIT not in pattern or not plain or any(odd) or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("only byte-level BPE files with this split pattern and normalizer can be compiled")
        self.library = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None
        self.machine = Transducer(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "", max_states)
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        low = [self.library.normalizer.normalize_str(chr(c)) for c in range(0x300)]
        self.lower = np.array([ord(x) if len(x) == 1 else 0xFFFF for x in low], np.uint32)  # 0xFFFF: becomes several characters

    def _class(self, c: int) -> int:
        """Class of a character after normalisation, told by how the library's own splitter treats it."""
        pieces = lambda s: len(self.library.pre_tokenizer.pre_tokenize_str(s))
        inside, twice = pieces(f"a{chr(c)}a"), pieces(chr(c) * 2)
        return LETTER if inside == 1 else SPACE if inside == 2 else DIGIT if twice == 2 else OTHER

    def _characters(self, text: str) -> np.ndarray:
        """Code points of the normalised text."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if points.max(initial=0) < 0x300:
            out = self.lower[points]
            if not (out == 0xFFFF).any():
                return out
        return np.frombuffer(self.library.normalizer.normalize_str(text).encode("utf-32-le"), np.uint32)

    def symbols(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the words of a run of characters, and how many symbols precede each character."""
        kind = self.kind[points]
        if (kind == UNKNOWN).any():
            for c in np.unique(points[kind == UNKNOWN]):
                self.kind[c] = self._class(int(c))
            kind = self.kind[points]
        before = np.concatenate([[SPACE], kind[:-1]])
        begins = (kind != SPACE) & ((kind == DIGIT) | (kind != before))
        for i in np.flatnonzero((points == 0x27) & begins):
            tail = "".join(map(chr, points[i + 1 : i + 3]))
            for word in AFTER_APOSTROPHE:
                if tail.startswith(word):
                    begins[i + 1], after = False, i + 1 + len(word)
                    if after < len(points) and kind[after] == LETTER:
                        begins[after] = True
                    break
        solid = kind != SPACE
        ends = solid & np.concatenate([~solid[1:] | begins[1:], [True]])
        size = np.where(solid, 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000), 0)
        place = np.cumsum(size)
        data = np.frombuffer(points[solid].astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), np.uint8).astype(np.int16)
        data[place[ends] - 1] += END
        return data, np.concatenate([[0], place])

    def counts(self, texts) -> np.ndarray:
        """Number of tokens of each text; null and empty texts have none. Long texts go piece by piece."""
        out, parts, owner, held = np.zeros(len(texts), np.int64), [], [], 0
        gap = np.array([0x20], np.uint32)

        def flush():
            nonlocal parts, owner, held
            if parts:
                points = np.concatenate([x for p in parts for x in (p, gap)])
                symbols, place = self.symbols(points)
                total = np.concatenate([[0], np.cumsum(self.machine.gains(symbols), dtype=np.int64)])
                edge = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
                np.add.at(out, owner, np.diff(total[place[edge]]))
            parts, owner, held = [], [], 0

        for i, text in enumerate(texts):
            if not isinstance(text, str) or not text:
                continue
            if self.special and "<" in text:
                text, n = self.special.subn(" ", text)  # nothing joins over a blank, so it parts what a special token parts
                out[i] += n
            for piece in _pieces(text):
                points = self._characters(piece)
                parts.append(points)
                owner.append(i)
                held += len(points)
                if held >= GROUP_CHARS:
                    flush()
        flush()
        return out


_BLANK = re.compile(r"[ \n\t]")


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about ``PIECE_CHARS`` characters that end before white space."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        cut = _BLANK.search(text, at + PIECE_CHARS)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


_COUNTERS: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row: bytes of the text in UTF-8, tokens of the whole
    text by the compiled ``tokenizer`` file, and whether they are more than ``limit``.

    Null and empty texts have 0 of both; special strings in a text are one token each; null ids stay, repeated
    rows are rows, other columns are dropped; an empty table gives no rows. No shuffle."""

    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _COUNTERS.get(tokenizer) or _COUNTERS.setdefault(tokenizer, TokenCounter(tokenizer))
        for texts in batches:
            yield pd.Series(np.concatenate([np.zeros(0, np.int64), *(counter.counts(g) for g in text_groups(texts, 4 * GROUP_CHARS))]))

    n_tokens = F.pandas_udf(counts, "long")(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"), n_tokens.alias("n_tokens"))
    return materialize(rows.withColumn("over_limit", F.col("n_tokens") > limit))
