"""Token counts by a finite-state transducer compiled from a tokenizer's vocabulary.

A deterministic machine reads the UTF-8 bytes of a text; its transitions carry the
number of tokens emitted, and each state the number still owed if the text ends
there.  A state holds what splitting and merging can still depend on: the kind of
piece that is open, the longest end of it that begins a token, and for each place
where a token could still start, the last token before it and the count up to it.
States and transitions are compiled on first use from the merges alone.

Texts are cut into chunks that step through the machine together, all from the
start state.  So each chunk's state map is known at its default entry at once; it
is worked out at the exits of the chunk before, too, only as far as the two runs differ.
A parallel prefix scan composes the maps: its rounds join maps of 1, 2, 4, ... chunks,
so a text's path through them takes as many rounds as its chunks' number has digits.
Where a piece spans whole chunks and the path leaves the known entries, the maps are
worked out there and the scan is run again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import buffers, with_fields

CHUNK = 2048
#: Steps of a chunk's first run that are kept to meet later ones.
TRACK = 48
#: A worker's compiled states are dropped and compiled anew beyond this many, between groups of chunks.  A group that comes
#: to twice as many is begun again as smaller ones: random letters make up to 0.4 states a byte, other texts under 0.01.
MAX_STATES = 200_000
#: States that a transition's key has room for.
ROOM = 1 << 23
#: Entries of each table of remembered merges and steps; they are only forgotten, never wrong.
MEMO = 60_000
LANE_BYTES = 8 << 20
#: Chunks of the smallest group.
LEAST_LANES = 64
#: So few chunks step one by one.
FEW = 1

# Classes of characters in the splitter: letters, numbers, space, other white space, anything else.
LETTER, NUMBER, BLANK, WHITE, OTHER = range(5)
#: Fixed values of the pre-tokenizer: what may follow an apostrophe at the start of a piece.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Crowded(Exception):
    """A group of chunks has made too many states."""


class Vocabulary:
    """Merges of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or spec["model"].get("ignore_merges"):
            raise ValueError("only byte-level BPE without normalizer or prefix space is compiled")
        back = byte_alphabet()
        bytes_of = lambda s: bytes(back[c] for c in s)
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[bytes_of(a), bytes_of(b)] = i
        self.tokens = {a + b for a, b in self.rank} | {bytes([b]) for b in range(256)}
        self.one = {t: t for t in self.tokens}  # one object for equal places and tokens
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.special = [x["content"].encode() for x in spec["added_tokens"]]
        if any(x[k] for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that strip or match words are not compiled")
        self._split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self._classes: dict[str, int] = {}
        self._fits: dict[tuple[bytes, bytes], bool] = {}

    def merge(self, piece: bytes) -> list[bytes]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            pair = parts[best], parts[best + 1]
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):  # every occurrence of the pair, from the left
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether the merges leave a followed by b as just these two tokens."""
        got = self._fits.get((a, b))
        if got is None:
            if len(self._fits) > MEMO:
                self._fits.clear()
            got = self._fits[a, b] = self.merge(a + b) == [a, b]
        return got

    def kind(self, char: str) -> int:
        """The class of a character, asked of the pre-tokenizer itself, so its Unicode version holds."""
        got = self._classes.get(char)
        if got is None:
            if char == " ":
                got = BLANK
            elif len(self._split("a" + char)) == 1:
                got = LETTER
            elif len(self._split("1" + char)) == 1:
                got = NUMBER
            elif len(self._split("!" + char)) == 1:
                got = OTHER
            else:
                got = WHITE
            self._classes[char] = got
        return got


#: BPE part of a state at the start of a piece: no open end, one place (0 bytes back, no last token, count 0).
_START = (b"", ((0, b"", 0),))
_NAMES = {LETTER: "letter", NUMBER: "number", OTHER: "other"}
_BIAS = 128


class Counter:
    """The counting transducer.

    Compiled transitions stand in an open hash table: key state << 8 | byte, value next
    state << 8 | tokens emitted + 128.  A state is (mode, open bytes of a character, BPE part, tokens owed for
    a run of white space without its last character, that character); modes are start,
    letter, number, other, white, and an apostrophe with the letters after it."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.size(1 << 16)
        self.final = np.zeros(4096, np.int32)
        self.pushed: dict = {}
        self.steps: dict[int, int] = {}
        self.same: dict = {}
        self.start = self.state(("start", b"", _START, 0, ""))
        self.made, self.most = 0.5, float("inf")  # states for each byte of the last group, and how many one may come to

    def lanes(self) -> int:
        """Chunks to run together: as many as make no more than MAX_STATES states, if they are like those before."""
        fit = min(LANE_BYTES, int(MAX_STATES / max(self.made, 1e-9)))
        return max(LEAST_LANES, fit // CHUNK)

    def size(self, slots: int) -> None:
        self.keys, self.values = np.full(slots, -1, np.int32), np.zeros(slots, np.int32)
        self.shift, self.used = np.uint32(33 - slots.bit_length()), 0

    def slot(self, index: np.ndarray) -> np.ndarray:
        return (index.view(np.uint32) * np.uint32(2654435761)) >> self.shift

    def put(self, index: np.ndarray, value: np.ndarray) -> None:
        """Add distinct new transitions."""
        if 3 * (self.used + len(index)) > len(self.keys):
            old = self.keys >= 0
            index, value = np.concatenate((self.keys[old], index)), np.concatenate((self.values[old], value))
            self.size(4 * len(self.keys))
        self.used += len(index)
        slot = self.slot(index).astype(np.int64)
        while len(index):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.values[slot[won]] = index[won], value[won]
            lost = np.ones(len(index), bool)
            lost[won] = False
            index, value, slot = index[lost], value[lost], (slot[lost] + 1) & (len(self.keys) - 1)

    def state(self, key: tuple) -> int:
        i = self.ids.get(key)
        if i is None:
            i = self.ids[key] = len(self.states)
            if i >= ROOM:
                raise RuntimeError("more states than a transition's key has room for")
            self.states.append(key)
            if i >= len(self.final):
                self.final = np.concatenate((self.final, np.zeros(len(self.final), np.int32)))
            mode, _, part, _, _ = key
            owed = 0 if mode == "start" else self.count(part)
            if mode[0] == "'" and len(mode) > 1:
                owed += self.whole(mode[1:].encode())
            self.final[i] = owed
        return i

    def compile(self, state: int, byte: int) -> int:
        mode, open_, part, owed, last = self.states[state]
        data = open_ + bytes([byte])
        lead = data[0]
        if len(data) < (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
            n, key = 0, (mode, data, part, owed, last)
        else:
            n, (mode, part, owed, last) = self.char(mode, part, owed, last, data.decode("utf-8", "replace"))
            key = (mode, b"", part, owed, last)
        return self.state(key) << 8 | n + _BIAS

    @staticmethod
    def count(part: tuple) -> int:
        """Tokens of a piece that ends here, besides those emitted."""
        return part[1][-1][2]

    def push(self, part: tuple, byte: int) -> tuple[int, tuple]:
        """Read a byte of a piece: tokens emitted, and the BPE part after it."""
        got = self.pushed.get((part, byte))
        if got is not None:
            return got
        v, tail = self.v, part[0] + bytes([byte])
        token, count = b"", 0
        for back, before, n in part[1]:
            t = tail[len(tail) - back - 1 :]
            if t in v.tokens and (not before or v.fits(before, t)):
                token, count = v.one[t], n + 1
                break
        places = [(back + 1, before, n) for back, before, n in part[1] if tail[len(tail) - back - 1 :] in v.prefixes]
        places.append((0, token, count))
        reach, least = max(p[0] for p in places), min(p[2] for p in places)
        if len(self.pushed) > MEMO:
            self.pushed.clear()
        got = self.pushed[part, byte] = least, (tail[len(tail) - reach :] if reach else b"", tuple(self.same.setdefault(x, x) for x in ((b, t, n - least) for b, t, n in places)))
        return got

    def feed(self, part: tuple, data: bytes) -> tuple[int, tuple]:
        out = 0
        for b in data:
            n, part = self.push(part, b)
            out += n
        return out, part

    def whole(self, data: bytes) -> int:
        n, part = self.feed(_START, data)
        return n + self.count(part)

    def char(self, mode: str, part: tuple, owed: int, last: str, c: str) -> tuple[int, tuple]:
        """Read a character: tokens emitted, and the state after it."""
        kind, data = self.v.kind(c), c.encode()
        n = 0
        if mode == "white":
            if kind in (BLANK, WHITE):
                m, after = self.feed(part, data)
                return m, ("white", after, self.count(part) - m, c)
            # all but the last character of the run is a piece; a last blank begins the next piece
            n, mode = owed, "start"
            if last == " ":
                m, part = self.feed(_START, b" " + data)
                return n + m, (_NAMES[kind], part, 0, "")
            n += self.whole(last.encode())
        elif mode[0] == "'":
            seen = mode[1:] + c
            if seen in CONTRACTIONS:
                m, part = self.feed(part, seen.encode())
                return m + self.count(part), ("start", _START, 0, "")
            if any(x.startswith(seen) for x in CONTRACTIONS):
                return 0, ("'" + seen, part, 0, "")
            if len(mode) == 1:
                mode = "other"
            else:  # the apostrophe was a piece, and a word has begun after it
                n = self.count(part)
                m, part = self.feed(_START, mode[1:].encode())
                n, mode = n + m, "letter"
        if mode != "start":
            if mode == _NAMES.get(kind):
                m, part = self.feed(part, data)
                return n + m, (mode, part, 0, "")
            n += self.count(part)
        m, part = self.feed(_START, data)
        if kind in (BLANK, WHITE):
            return n + m, ("white", part, -m, c)
        return n + m, ("'" if c == "'" else _NAMES[kind], part, 0, "")

    def take(self, states: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One byte for each of many states: the next states, and the tokens emitted."""
        index = (states << 8) | data
        slot = self.slot(index)
        t = self.values[slot]
        bad = np.flatnonzero(self.keys[slot] != index)
        at, missing = slot[bad].astype(np.int64), []
        while len(bad):
            empty = self.keys[at] < 0
            if empty.any():
                missing.append(bad[empty])
                bad, at = bad[~empty], at[~empty]
            at = (at + 1) & (len(self.keys) - 1)
            right = self.keys[at] == index[bad]
            t[bad[right]] = self.values[at[right]]
            bad, at = bad[~right], at[~right]
        if missing:
            if len(self.states) > self.most:
                raise Crowded
            where = np.concatenate(missing)
            new, place = np.unique(index[where], return_inverse=True)
            value = np.array([self.compile(k >> 8, k & 255) for k in new.tolist()], np.int32)
            self.put(new, value)
            t[where] = value[place]
        return t >> 8, (t & 255) - _BIAS

    def run(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """All chunks from the start state: exits and tokens emitted, and both after each of the first steps."""
        order = np.argsort(-sizes, kind="stable")
        at, left = starts[order], -sizes[order]
        state, n = np.full(len(order), self.start, np.int32), np.zeros(len(order), np.int32)
        states, counts = np.full((TRACK, len(order)), -1, np.int32), np.zeros((TRACK, len(order)), np.int32)
        for step in range(int(-left[0]) if len(left) else 0):
            live = int(np.searchsorted(left, -step, "left"))
            state[:live], emitted = self.take(state[:live], data[at[:live] + step])
            n[:live] += emitted
            if step < TRACK:
                states[step, :live], counts[step, :live] = state[:live], n[:live]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], n[back], states[:, back], counts[:, back]

    def follow(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, entry: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, ...]:
        """Chunks from given entries until each meets its run from the start state: exits, tokens, the step of meeting or -1."""
        state, n, met = entry.astype(np.int32), np.zeros(len(entry), np.int32), np.full(len(entry), -1)
        active, step = np.flatnonzero(sizes > 0), 0
        while len(active):
            if len(active) <= FEW:  # steps of few chunks are quicker one by one
                for i in active.tolist():
                    state[i], m, met[i] = self.follow_one(data[starts[i] + step : starts[i] + sizes[i]].tobytes(), int(state[i]), step, states[:, i].tolist())
                    n[i] += m
                break
            state[active], emitted = self.take(state[active], data[starts[active] + step])
            n[active] += emitted
            if step < TRACK:
                met[active[states[step, active] == state[active]]] = step
            step += 1
            active = active[(met[active] < 0) & (sizes[active] > step)]
        return state, n, met


    def follow_one(self, data: bytes, state: int, step: int, states: list[int]) -> tuple[int, int, int]:
        """One chunk's rest from a state, until it meets its run from the start state: exit, tokens, the step of meeting or -1."""
        n = 0
        for step, byte in enumerate(data, step):
            t = self.steps.get(state << 8 | byte)
            if t is None:
                if len(self.steps) > 4 * MEMO:
                    self.steps.clear()
                t = self.steps[state << 8 | byte] = self.compile(state, byte)
            state = t >> 8
            n += (t & 255) - _BIAS
            if step < TRACK and states[step] == state:
                return state, n, step
        return state, n, -1


def count_texts(machine: Counter, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens of each text data[offsets[i]:offsets[i + 1]], none of which holds a special string."""
    if not len(offsets) - 1:
        return np.zeros(0, np.int64)
    chunks = np.maximum(1, -(-np.diff(offsets) // CHUNK))
    text = np.repeat(np.arange(len(chunks)), chunks)
    first = np.cumsum(chunks) - chunks
    part = np.arange(len(text)) - first[text]
    starts, end = offsets[:-1][text] + part * CHUNK, offsets[1:][text]
    for _ in range(3):  # a chunk never begins inside a character
        inside = np.flatnonzero((part > 0) & (starts < end))
        starts[inside] += (data[starts[inside]] & 0xC0) == 0x80
    sizes = np.append(starts[1:], offsets[-1]) - starts
    total, owed = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    lo, carried = 0, machine.start
    while lo < len(text):  # groups of chunks; a long text goes on in the next one, in the state it has come to
        if len(machine.states) > MAX_STATES:
            held, made = machine.states[carried], machine.made
            machine.reset()
            carried, machine.made = machine.state(held), made
        hi, before = min(len(text), lo + machine.lanes()), len(machine.states)
        machine.most = 2 * MAX_STATES if hi - lo > LEAST_LANES else float("inf")
        try:
            exits, total[lo:hi] = _group(machine, data, starts[lo:hi], sizes[lo:hi], part[lo:hi] > 0, carried)
        except Crowded:  # this text makes more states than those before: again, in smaller groups
            held, made = machine.states[carried], max(0.5, 2 * machine.made)
            machine.reset()
            carried, machine.made = machine.state(held), made  # twice as many each time, down to the smallest group
            continue
        owed[lo:hi] = machine.final[exits]
        machine.made = (len(machine.states) - before) / max(1, int(sizes[lo:hi].sum()))
        lo, carried = hi, int(exits[-1])
    return np.add.reduceat(total, first) + owed[first + chunks - 1]


class _Maps:
    """State maps of a group's chunks, each at the entries that were asked for: (chunk, entry) leads to (exit, tokens)."""

    def __init__(self, machine: Counter, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, goes_on: np.ndarray):
        self.machine, self.data, self.starts, self.sizes, self.goes_on = machine, data, starts, sizes, np.append(goes_on, False)
        self.base_exit, self.base_total, self.states, self.counts = machine.run(data, starts, sizes)
        self.chunk, self.exit, self.total = np.arange(len(starts)), self.base_exit.astype(np.int64), self.base_total.astype(np.int64)
        self.place = {key: i for i, key in enumerate((self.chunk << 32 | machine.start).tolist())}

    def add(self, keys: list[int]) -> np.ndarray:
        """Works out the maps at further entries; a run that meets the one from the default entry ends as that does.  Their places."""
        at = np.array(keys, np.int64)
        chunk, entry = at >> 32, at & 0xFFFFFFFF
        out, n, met = self.machine.follow(self.data, self.starts[chunk], self.sizes[chunk], entry, self.states[:, chunk])
        first = len(self.place)
        self.place.update(zip(keys, range(first, first + len(keys)), strict=True))
        self.chunk = np.append(self.chunk, chunk)
        self.exit = np.append(self.exit, np.where(met >= 0, self.base_exit[chunk], out))
        self.total = np.append(self.total, np.where(met >= 0, self.base_total[chunk] - self.counts[met, chunk], 0) + n)
        return np.arange(first, first + len(keys))

    def after(self, places: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Of maps whose chunk's text goes on: their places, and the keys of the maps that follow."""
        on = places[self.goes_on[self.chunk[places] + 1]]
        return on, ((self.chunk[on] + 1) << 32 | self.exit[on]).tolist()

    def lacking(self, keys: list[int]) -> list[int]:
        return list(dict.fromkeys(k for k in keys if k not in self.place))

    def reached(self, heads: np.ndarray) -> np.ndarray:
        """Which maps the texts go through from their heads on: in each round of this scan the maps of twice as many
        chunks are composed to one, and what was reached leads on through them."""
        n = len(self.chunk)
        on, keys = self.after(np.arange(n))
        jump = np.full(n + 1, n)
        jump[on] = [self.place.get(k, n) for k in keys]
        seen = np.zeros(n + 1, bool)
        seen[heads] = True
        for _ in range(len(self.starts).bit_length()):
            seen[jump[seen]] = True
            jump = jump[jump]
        return np.flatnonzero(seen[:n])


def _group(machine: Counter, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, goes_on: np.ndarray, carried: int) -> tuple[np.ndarray, np.ndarray]:
    """Exits and tokens of a group of chunks; one that goes on begins in the state that the one before ends in."""
    maps = _Maps(machine, data, starts, sizes, goes_on)
    begin = np.flatnonzero(~goes_on) << 32 | machine.start
    heads = [carried, *begin.tolist()] if goes_on[0] else begin.tolist()  # of chunk 0
    for keys in (heads, None, None):  # every chunk at the exits of the one before, twice, as most runs meet
        if todo := maps.lacking(maps.after(np.arange(len(maps.chunk)))[1] if keys is None else keys):
            maps.add(todo)
    first = np.array([maps.place[k] for k in heads])
    while True:
        path = maps.reached(first)
        todo = maps.lacking(maps.after(path)[1])
        if not todo:
            break
        while todo:  # a piece spans whole chunks: on from where the path ends, till it is on known maps again
            todo = maps.lacking(maps.after(maps.add(todo))[1])
    exits, total = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
    exits[maps.chunk[path]], total[maps.chunk[path]] = maps.exit[path], maps.total[path]
    return exits, total


_machines: dict[str, Counter] = {}


def machine_for(path: str) -> Counter:
    """The worker's machine for a tokenizer file; it is kept between batches."""
    if path not in _machines:
        _machines[path] = Counter(Vocabulary(path))
    return _machines[path]


def count_column(machine: Counter, column: pa.Array) -> np.ndarray:
    """Tokens of every text of a string column; null counts as empty."""
    out = np.zeros(len(column), np.int64)
    data, offsets, valid = buffers(column)
    whole = np.frombuffer(data, np.uint8)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + LANE_BYTES, "right")) - 1)
        end = min(end, len(column))
        raw = bytes(data[offsets[start] : offsets[end]])
        sound = True
        try:
            raw.decode()
        except UnicodeDecodeError:
            sound = False
        if sound and not any(x in raw for x in machine.v.special):
            out[start:end] = count_texts(machine, np.frombuffer(raw, np.uint8), offsets[start : end + 1] - offsets[start])
        else:
            for i in range(start, end):
                out[i] = count_special(machine, bytes(whole[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace").encode())
        start = end
    out[~valid] = 0
    return out


def count_special(machine: Counter, text: bytes) -> int:
    """A text that may hold special strings, which are one token each and end the pieces around them."""
    parts, n = [text], 0
    for x in machine.v.special:
        parts = [y for p in parts for y in p.split(x)]
    n = len(parts) - 1
    parts = [p for p in parts if p]
    offsets = np.cumsum([0, *map(len, parts)])
    return n + int(count_texts(machine, np.frombuffer(b"".join(parts), np.uint8), offsets).sum())


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", context: int = 1024) -> DataFrame:
    """Bytes and tokens of every whole text, without begin, end or added special tokens.

    Special strings inside a text are one token each, as in the library.  Returns
    id_col, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more tokens than ``context``),
    one row for each row of docs, repeated ones too.  A null or empty text has no bytes
    and no tokens; a very long text is read whole, in groups of chunks that carry their
    state on; a null id stays null; an empty table gives an empty one; bytes that are not
    UTF-8 count as replacement characters; other columns are not carried.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias(text_col))
    schema = with_fields(rows.select(id_col).schema, ("n_bytes", "long"), ("n_tokens", "long"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_for(tokenizer)
        for batch in batches:
            column = batch.column(1)
            _, offsets, valid = buffers(column)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets) * valid), pa.array(count_column(machine, column))], names=[id_col, "n_bytes", "n_tokens"])

    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > context)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
