"""SentencePiece encoding that keeps byte spans, and decoding.

A text is normalised by the longest prefix of what is left that the model's compiled
character map knows; each byte of the normal form remembers where in the text it comes
from.  The normal form is cut into words, between which no piece of the vocabulary can
stand, each word is merged by scores, and every piece's place in the normal form is
projected back to bytes of the text.

Words' pieces are kept for the next texts, up to a bound.  Long texts go through in
slabs, so beside a text stand only its ids and spans.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, texts, tidy, with_fields

#: Words of at most WORD letters are kept, KEPT of them; longer ones are cut where no piece can stand.
WORD, KEPT = 40, 250_000
#: Letters or ids of a long text at a time.
SLAB = 1 << 18
SPACE = "▁"
# Kinds of pieces, and the model's kind that merges by scores.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2

#: The score of neighbours that make no piece.
NEVER = float("inf")

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


def character_map(blob: bytes) -> dict[bytes, bytes]:
    """All rules of a compiled character map: a double array of units, then what they lead to, each ended by a zero byte."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, ends = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
    labels = np.arange(256)
    rules: dict[bytes, bytes] = {}
    step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
    todo = [(b"", step(int(units[0])))]
    while todo:
        prefix, base = todo.pop()
        places = base ^ labels
        inside = places < len(units)
        # a unit's label has bit 31 set where it is a value instead
        found = labels[inside][(units[places[inside]] & 0x800000FF) == labels[inside]]
        for label in found.tolist():
            if label == 0:
                continue
            unit = int(units[base ^ label])
            child, key = (base ^ label) ^ step(unit), prefix + bytes([label])
            if unit & 256:
                start = int(units[child]) & 0x7FFFFFFF
                rules[key] = ends[start : ends.index(0, start)]
            todo.append((key, child))
    return rules


def _longest(rules: dict[bytes, bytes]) -> re.Pattern | None:
    """A pattern that matches, at any place, the longest key of the rules there."""
    if not rules:
        return None
    tree: dict = {}
    for key in rules:
        node = tree
        for byte in key:
            node = node.setdefault(byte, {})
        node[-1] = True

    def written(node: dict) -> bytes:
        ends = node.get(-1, False)
        leaves = sorted(b for b, n in node.items() if b >= 0 and set(n) == {-1})
        parts = [re.escape(bytes([b])) + written(n) for b, n in sorted((b, n) for b, n in node.items() if b >= 0) if b not in leaves]
        if leaves:
            parts.append(b"[" + b"".join(re.escape(bytes([b])) for b in leaves) + b"]")
        if not parts:
            return b""
        return b"(?:" + b"|".join(parts) + b")" + (b"?" if ends else b"")

    return re.compile(written(tree), re.DOTALL)


class Model:
    """A model file's vocabulary, character map and options."""

    def __init__(self, proto: bytes):
        pieces, trainer, normal = [], {}, {}
        for field, value in _fields(proto):
            if field == 1:
                pieces.append(dict(_fields(value)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normal = dict(_fields(value))
            elif field == 5 and dict(_fields(value)).get(2):
                raise ValueError("models that map characters on decoding are not supported")
        self.pieces = [p.get(1, b"").decode() for p in pieces]
        self.kinds = [p.get(3, NORMAL) for p in pieces]
        scores = [float(np.frombuffer(p.get(2, bytes(4)), "<f4")[0]) for p in pieces]
        if trainer.get(3, 1) != BPE or not trainer.get(35, 0) or {USER, UNUSED} & set(self.kinds) or trainer.get(24, 0):
            raise ValueError("only models that merge by scores, fall back to bytes and have no pieces of the user are supported")
        self.prefix, self.squeeze, self.escape = (bool(normal.get(k, 1)) for k in (3, 4, 5))
        if not self.escape:
            raise ValueError("only models that write spaces as a symbol are supported")
        self.rules = character_map(normal.get(2, b""))
        if any(b"  " in out for out in self.rules.values()):
            raise ValueError("a rule that makes two spaces is not supported")
        self.pattern = _longest(self.rules)
        ids = {p: i for i, p in enumerate(self.pieces)}
        self.begin, self.end = (ids[trainer.get(k, d).decode()] for k, d in ((46, b"<s>"), (47, b"</s>")))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        # the less the sooner it merges
        self.scores = {p: -x for p, x, k in zip(self.pieces, scores, self.kinds, strict=True) if k == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        unknown = trainer.get(44, b" \xe2\x81\x87 ")
        surface = {NORMAL: lambda p: p.replace(SPACE, " ").encode(), BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: unknown}
        self.surfaces = [surface[k](p) for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.controls = np.array([k == CONTROL for k in self.kinds])
        # letters that stand side by side in a piece: between any others no merge can reach
        self.beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.known, self.store = {}, _Store()
        # letters by their numbers: a piece's if they are one, else further ones if some piece has them
        number = dict(self.ids)
        for letter in sorted({c for p in self.ids for c in p} - set(number)):
            number[letter] = len(self.pieces) + len(number)
        self.letters = np.full(0x110000, -1, np.int64)
        for piece, i in number.items():
            if len(piece) == 1:
                self.letters[ord(piece)] = i
        pairs = {number[p[:k]] << 32 | number[p[k:]]: (self.scores[p], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        # slots of a hash table: a pair stands in the first free one from its own on
        self.slots = np.full(1 << max(4, (4 * len(pairs)).bit_length()), -1, np.int64)
        mask, self.shift = len(self.slots) - 1, 65 - len(self.slots).bit_length()
        self.slot_costs, self.slot_pieces = np.full(len(self.slots), NEVER), np.full(len(self.slots), -1, np.int64)
        keys = np.array(list(pairs), np.int64)
        for key, at in zip(pairs, self._slot(keys).tolist(), strict=True):
            while self.slots[at] != -1:
                at = at + 1 & mask
            self.slots[at] = key
            self.slot_costs[at], self.slot_pieces[at] = pairs[key]
        self.piece_bytes = np.array([len(p.encode()) for p in self.pieces], "<u4")
        self.piece_plain = np.array([len(p.encode()) - 2 * p.count(SPACE) for p in self.pieces], "<u4")
        # a space begins a word, unless some piece goes on after a letter with one; a letter that no piece has beside another stands alone
        letters = "".join(sorted({c for b in self.beside for c in b} - {SPACE}))
        self.splits = bool(letters) and not any(b[1] == SPACE != b[0] for b in self.beside)
        self.word = re.compile(f"{SPACE}*[{re.escape(letters)}]+|{SPACE}+|." if self.splits else ".+", re.DOTALL)

    # ---- normal form ----

    def normal(self, data: bytes) -> tuple[str, np.ndarray | None]:
        """The normal form of a text, and where each of its bytes, and its end, come from.

        The places are None where they follow from the form alone: spaces are three bytes for one."""
        text = None
        try:
            text = data.decode()
        except UnicodeDecodeError:
            pass
        if not data:
            return "", None
        if text is not None and not self.squeeze and SPACE not in text and (self.pattern is None or self.pattern.search(data) is None):
            return (SPACE if self.prefix else "") + text.replace(" ", SPACE), None
        parts, places = [], []
        for part, start in self._parts(data):
            if isinstance(start, int):
                places.append(np.full(len(part), start))
            else:
                places.append(np.arange(start[0], start[0] + len(part)))
            parts.append(part)
        form, origin = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([*places, [len(data)]]).astype(np.int64)
        blank = form == 32
        keep = np.ones(len(form), bool)
        first, last = 0, len(form)
        if self.squeeze:
            keep[1:] = ~(blank[1:] & blank[:-1])
            solid = np.flatnonzero(~blank)
            if not len(solid):
                return "", np.array([len(data)])
            first, last = int(solid[0]), int(solid[-1]) + 1
            keep[:first] = keep[last:] = False
        kept = np.flatnonzero(keep)
        times = np.where(blank[kept], 3, 1)
        begin = int(origin[first])
        out = np.repeat(form[kept], times).tobytes().decode().replace("   ", SPACE)  # three spaces for each one
        places = np.concatenate([np.full(3 if self.prefix else 0, begin), np.repeat(origin[kept], times), [origin[last]]])
        out = (SPACE if self.prefix else "") + out
        while self.squeeze and out.endswith(SPACE):
            out, places = out[:-1], places[:-3]
        return out, places

    def _parts(self, data: bytes) -> Iterator[tuple[bytes, int | tuple[int]]]:
        """Stretches of the normal form with spaces: copied ones with (start,), others with the start of what they stand for."""
        at = 0
        while at < len(data):
            end, bad = len(data), False
            try:
                data[at:].decode()
            except UnicodeDecodeError as e:
                end, bad = at + e.start, True
            for m in self.pattern.finditer(data, at, end) if self.pattern else ():
                if m.start() > at:
                    yield data[at : m.start()], (at,)
                yield self.rules[m.group()], m.start()
                at = m.end()
            if end > at:
                yield data[at:end], (at,)
            at = end
            if bad:
                yield "�".encode(), at
                at += 1

    # ---- pieces ----

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words' pieces, by their numbers, and how many each has; all words take their best merge at once, again and again.

        Of all neighbours that make a piece, the one of the best score merges first, the leftmost of equals."""
        of = np.repeat(np.arange(len(words)), [len(w) for w in words])
        piece = self.letters[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        cost, into = self._pairs(piece[:-1], piece[1:])
        cost = np.append(np.where(of[:-1] == of[1:], cost, NEVER), NEVER)
        into = np.append(into, -1)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(of):
            begins = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            best = np.minimum.reduceat(cost, begins)
            sizes = np.diff(np.append(begins, len(of)))
            goes = np.repeat(best < NEVER, sizes)
            if not goes.all():
                done.append((of[~goes], piece[~goes]))
                cost, into, of, piece = cost[goes], into[goes], of[goes], piece[goes]
                sizes, best = sizes[best < NEVER], best[best < NEVER]
                if not len(of):
                    break
            at = np.flatnonzero(cost == np.repeat(best, sizes))
            at = at[np.append(True, of[at[1:]] != of[at[:-1]])]
            piece[at] = into[at]
            keep = np.ones(len(of), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            cost[at] = cost[at + 1]  # what follows the second part follows the whole, if it is of the same word
            cost, into, of, piece, at = cost[keep], into[keep], of[keep], piece[keep], place[at]
            for left in (at[at > 0] - 1, at[at + 1 < len(of)]):
                left = left[of[left] == of[left + 1]]
                cost[left], into[left] = self._pairs(piece[left], piece[left + 1])
            ends = at[np.append(of[1:] != of[:-1], True)[at]]
            cost[ends] = NEVER
        of, piece = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in (0, 1))
        return piece[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of neighbours, and the piece that they make."""
        keys = np.where((left >= 0) & (right >= 0), left << 32 | right, -2)
        at = self._slot(keys)
        found = self.slots[at]
        cost, into = self.slot_costs[at], self.slot_pieces[at]
        odd = np.flatnonzero(found != keys)
        cost[odd], into[odd] = NEVER, -1
        odd = odd[(found[odd] != -1) & (keys[odd] >= 0)]
        while len(odd):  # another pair stands there
            at[odd] = at[odd] + 1 & len(self.slots) - 1
            there = self.slots[at[odd]]
            hit = odd[there == keys[odd]]
            cost[hit], into[hit] = self.slot_costs[at[hit]], self.slot_pieces[at[hit]]
            odd = odd[(there != -1) & (there != keys[odd])]
        return cost, into

    def merged(self, word: str) -> list[str]:
        """The pieces of one word, as ``merge_all`` has them."""
        score = self.scores.get
        parts: list[str | None] = list(word)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap = [(found, i, 2) for i in range(len(parts) - 1) if (found := score(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, left, size = heapq.heappop(heap)
            right = after[left] if parts[left] is not None else len(parts)
            if right >= len(parts) or len(parts[left]) + len(parts[right]) != size:
                continue
            parts[left] += parts[right]
            parts[right] = None
            after[left] = after[right]
            if after[left] < len(parts):
                before[after[left]] = left
            for i, j in ((before[left], left), (left, after[left])):
                if i >= 0 and j < len(parts) and (found := score(parts[i] + parts[j])) is not None:
                    heapq.heappush(heap, (found, i, len(parts[i]) + len(parts[j])))
        return [p for p in parts if p is not None]

    def cut(self, word: str) -> Iterator[str]:
        """Parts of a long word, between letters that no piece has side by side."""
        start = 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.beside:
                yield word[start:i]
                start = i
        yield word[start:]

    def rows_of(self, word: str, pieces: list[str]) -> list[tuple[int, int, int]]:
        """(id, bytes in the normal form, bytes in a text whose spaces are one byte) of a word's pieces.

        A letter that isn't in the vocabulary has an id for each byte; the last one has all of its bytes."""
        out = []
        for piece in pieces:
            data = piece.encode()
            found = self.ids.get(piece)
            if found is None:
                out += [(self.byte_ids[b], 0, 0) for b in data[:-1]]
            out.append((self.byte_ids[data[-1]] if found is None else found, len(data), len(data) - 2 * piece.count(SPACE)))
        return out

    def meet(self, words: list[str]) -> np.ndarray:
        """Places of words in the store; those that it lacks are merged together."""
        if len(self.known) > KEPT or self.store.used > 16 * KEPT:
            self.known, self.store = {}, _Store()
        known = self.known
        at = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        lacking = np.flatnonzero(at < 0).tolist()
        if not lacking:
            return at
        asked = [words[i] for i in lacking]
        new = list(set(asked))
        short = [w for w in new if len(w) <= WORD]
        if short:
            piece, counts = self.merge_all(short)
            odd = (piece < 0) | (piece >= len(self.pieces))
            if odd.any():
                of = np.repeat(np.arange(len(short)), counts)
                odd_words = set(of[odd].tolist())
                piece, counts = piece[~np.isin(of, list(odd_words))], np.delete(counts, sorted(odd_words))
                new = [w for i, w in enumerate(short) if i in odd_words] + [w for w in new if len(w) > WORD]
                short = [w for i, w in enumerate(short) if i not in odd_words]
            else:
                new = [w for w in new if len(w) > WORD]
            known.update(zip(short, range(len(known), len(known) + len(short))))
            self.store.add(counts, np.stack([piece, self.piece_bytes[piece], self.piece_plain[piece]]))
        for word in new:
            rows = self.rows_of(word, self.merged(word))
            known[word] = len(known)
            self.store.add(np.array([len(rows)]), np.array(rows).T)
        at[lacking] = np.fromiter(map(known.__getitem__, asked), np.int64, len(asked))
        return at

    def cut_words(self, form: str) -> list[str]:
        """Words of a normal form; long ones are cut further where no piece can stand."""
        words = self.word.findall(form)
        if max(map(len, words), default=0) <= WORD:
            return words
        return [part for w in words for part in (self.cut(w) if len(w) > WORD else (w,))]

    def slabs(self, form: str) -> Iterator[str]:
        """A normal form in parts of about SLAB letters, cut where a word begins."""
        at = 0
        while at < len(form):
            end = form.find(SPACE, at + SLAB) if at + SLAB < len(form) else -1
            while end > at and form[end - 1] == SPACE:
                end -= 1
            end = end if end > at and self.splits else len(form)
            yield form[at:end]
            at = end

    def encode_all(self, batch: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        """Of each text the ids between begin and end, four bytes each, and for each id the first of its bytes
        in the text and the one after its last.  Short texts go through together."""
        held: list[tuple[np.ndarray | None, list[str]]] = []
        size = 0
        for data in batch:
            form, places = self.normal(data)
            if held and size + len(form) > SLAB:
                yield from self._encoded(held)
                held, size = [], 0
            if len(form) > SLAB:
                parts = []
                for words in map(self.cut_words, self.slabs(form)):
                    at = self.meet(words)  # which may begin a new store
                    parts.append(self.store.rows(at))
                yield self._spans(np.concatenate(parts, 1), places)
            else:
                held.append((places, self.cut_words(form)))
                size += len(form)
        yield from self._encoded(held)

    def _encoded(self, held: list[tuple[np.ndarray | None, list[str]]]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        at = self.meet([w for _, words in held for w in words])
        ends = np.cumsum([len(words) for _, words in held])
        for (places, words), end in zip(held, ends.tolist(), strict=True):
            yield self._spans(self.store.rows(at[end - len(words) : end]), places)

    def _spans(self, rows: np.ndarray, places: np.ndarray | None) -> tuple[bytes, np.ndarray, np.ndarray]:
        ids = np.empty(rows.shape[1] + 2, "<u4")
        ids[0], ids[1:-1], ids[-1] = self.begin, rows[0], self.end
        ends = np.zeros(len(ids), np.int64)
        np.cumsum(rows[1 if places is not None else 2], out=ends[1:-1])
        ends[-1] = ends[-2]
        starts = np.concatenate([[0], ends[:-1]])
        if places is not None:
            starts, ends = places[starts], places[ends]
        elif self.prefix and len(ids) > 2:  # the space before the text is none of its bytes
            starts, ends = np.maximum(starts - 1, 0), np.maximum(ends - 1, 0)
        return ids.tobytes(), starts, ends

    def encode(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """One text's ids and spans, as ``encode_all`` has them."""
        return next(self.encode_all([data]))

    # ---- text ----

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids give nothing, a space that stands for the beginning goes, bytes of no letter give U+FFFD each."""
        out: list[bytes] = []
        head = 0
        if self.prefix or self.squeeze:
            while head < len(ids):
                i = int(ids[head])
                if self.kinds[i] == BYTE:
                    break
                surface = self.surfaces[i]
                begins = self.kinds[i] == NORMAL and surface.startswith(b" ")
                out.append(surface[1:] if begins else surface)
                head += 1
                if out[-1] or begins and not self.squeeze:
                    break
        # bytes on both sides of a control id make no letter together
        rest = ids[head:]
        edges = [0, *(np.flatnonzero(self.controls[rest]) + 1).tolist(), len(rest)]
        return _text(b"".join(out)) + "".join(_text(b"".join(self._surfaces(rest[a:b]))) for a, b in zip(edges, edges[1:]))

    def _surfaces(self, ids: np.ndarray) -> Iterator[bytes]:
        for at in range(0, len(ids), SLAB):
            yield b"".join(map(self.surfaces.__getitem__, ids[at : at + SLAB].tolist()))


def _text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("utf-8", "each_byte")


class _Store:
    """Pieces of words one after another, in arrays that grow by halves."""

    def __init__(self):
        self.begins, self.data = np.zeros(1024, np.int64), np.zeros((3, 4096), np.int32)
        self.words = self.used = 0

    def add(self, counts: np.ndarray, rows: np.ndarray) -> None:
        words, used = self.words + len(counts), self.used + rows.shape[1]
        if words >= len(self.begins):
            self.begins = np.resize(self.begins, words * 3 // 2 + 1)
        if used > self.data.shape[1]:
            self.data = np.concatenate([self.data, np.zeros((3, used * 3 // 2 - self.data.shape[1]), np.int32)], 1)
        self.begins[self.words + 1 : words + 1] = self.used + np.cumsum(counts)
        self.data[:, self.used : used] = rows
        self.words, self.used = words, used

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The pieces of the words at these places, in order."""
        begins = self.begins[at]
        counts = self.begins[at + 1] - begins
        ends = np.cumsum(counts)
        return self.data[:, np.repeat(begins - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]


_loaded: dict[bytes, Model] = {}


def loaded(proto: bytes) -> Model:
    """The model of a file's bytes, one for each worker."""
    if proto not in _loaded:
        _loaded.clear()
        _loaded[proto] = Model(proto)
    return _loaded[proto]


def proto_of(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(rows: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """rows with ``ids`` (begin and end included), ``starts`` and ``ends``: binary, a little-endian unsigned 32-bit number for each id.

    An id's span are the bytes of the text that it stands for, in UTF-8; begin, end and the
    space put before a text have empty ones, and of the ids of a letter's bytes the last has
    all of the letter.  A null text counts as an empty one: begin and end.  Bytes that are no
    UTF-8 count as U+FFFD each.  Strings of special pieces are ordinary text.  A very long
    text is encoded whole, in one worker.  Repeated rows are encoded each; columns named
    ids, starts or ends are replaced, others stay; an empty table gives an empty one.  The
    file at path is read by the driver and travels with the tasks.
    """
    proto = proto_of(path)
    schema = with_fields(rows.schema, ("ids", "binary"), ("starts", "binary"), ("ends", "binary"))
    kept = [f.name for f in schema.fields if f.name not in ("ids", "starts", "ends")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(proto)
        for batch in tidy(batches):
            found = list(model.encode_all([x or b"" for x in texts(batch.column(len(kept)))]))
            spans = [pa.array([x[k].astype("<u4").tobytes() for x in found], pa.binary()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([x[0] for x in found], pa.binary()), *spans], names=[*kept, "ids", "starts", "ends"])

    return small_batches(rows).select(*kept, F.col(text_col).cast("string").alias("_text_")).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """rows with ``decoded``, the text of the ids (binary, as ``encode`` gives them); of null ids it is null."""
    proto = proto_of(path)
    schema = with_fields(rows.schema, ("decoded", "string"))
    kept = [f.name for f in schema.fields if f.name != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(proto)
        for batch in tidy(batches):
            out = [None if x is None else model.decode(np.frombuffer(x, "<u4")) for x in texts(batch.column(len(kept)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out, pa.string())], names=[*kept, "decoded"])

    return rows.select(*kept, F.col(ids_col).alias("_ids_")).mapInArrow(run, schema)


def op12_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decode(encode(docs, path).drop("text"), path)
    digest = lambda c: F.sha2(c, 256)
    n = (F.octet_length("ids") / 4).cast("long")
    return found.select("doc_id", n.alias("n_tokens"), digest(F.col("ids")).alias("ids_sha256"), digest(F.encode("decoded", "UTF-8")).alias("decoded_sha256"), digest(F.concat("starts", "ends")).alias("spans_sha256"))
