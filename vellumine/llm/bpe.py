"""Byte-level BPE as a transducer over bytes, and streaming decoding through a UTF-8 state machine.

A token sequence is what the merges give exactly when each adjacent pair is, so the encoding of every
prefix is the encoding of a shorter prefix plus one token. The transducer follows all prefixes from
which a token may still run on; a state is that set of prefixes, each with the tokens that lead to it
since the last settled one. Transitions are found when first taken and kept; a transition emits the
tokens that all prefixes then live have in common, so lookahead is bounded by how long a token can
still change what stands before it.

Work goes by Arrow batch: texts are cut where a match of the pattern always begins, equal pieces of
text are found together, only those that the worker does not know yet pass the transducer, and the ids
of whole texts are gathered from theirs. Decoding gathers the bytes of tokens likewise; the state machine
runs wherever a token is not a whole number of characters.

Nulls encode as the empty text; empty texts give no ids. Repeated rows give equal rows. Columns other
than the two named ones are passed through only where ``keep`` names them, whatever their names; a kept
column gives way to a new one of its name. Empty tables give empty results. Texts are processed whole,
whatever their length, one Arrow batch in memory at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.store import Shared, slices

#: Bounds of what a worker keeps: pieces of text, states with their transitions, answers on token pairs.
MEMO_PIECES, MEMO_STATES, MEMO_PAIRS = 80_000, 1 << 16, 1 << 19
#: Longer pieces of text (bytes) are not kept.
MEMO_BYTES = 48
#: Rows and bytes of an Arrow batch that are encoded together: the more, the more pieces are equal.
SLICE_ROWS, SLICE_BYTES = 1000, 4 << 20
#: So many matches pass the transducer side by side if they have at most so many bytes; longer ones go alone,
#: and their tokens are settled whenever LOOKAHEAD bytes wait.
LANES, LANE_BYTES, LOOKAHEAD = 1 << 15, 64, 256

TOKEN_BITS = 24
NO_TOKEN = (1 << TOKEN_BITS) - 1

#: Fixed value: the pattern, public with its vocabularies, whose matches follow runs of white space: a match
#: begins where white space does, at the last character of such a run before other text, and behind it unless
#: that is a space. Texts can then be cut at those places before matching.
SPACE_LED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(blob: bytes) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: a base64 token and its rank per line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in blob.splitlines() if line.strip())}


class Pairs:
    """Answers by key, in a table with open addresses that is emptied when half full."""

    FACTOR = 0x9E3779B97F4A7C15

    def __init__(self, answer, room: int = 0):
        self.answer, self.bits = answer, max(4, (room or MEMO_PAIRS).bit_length())
        self._empty()

    def _empty(self) -> None:
        self.keys, self.values, self.held = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, bool), 0

    def put(self, key: int) -> bool:
        if 2 * self.held >= len(self.keys):
            self._empty()
        at = (key * self.FACTOR & (1 << 64) - 1) >> (64 - self.bits)
        while self.keys[at] not in (-1, key):
            at = (at + 1) & (len(self.keys) - 1)
        self.held += self.keys[at] != key
        self.keys[at], self.values[at] = key, self.answer(key)
        return bool(self.values[at])

    def look(self, keys: np.ndarray) -> np.ndarray:
        at = (keys.view(np.uint64) * np.uint64(self.FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[at]
        other = np.flatnonzero((found != keys) & (found != -1))
        while len(other):
            at[other] = (at[other] + 1) & (len(self.keys) - 1)
            found[other] = self.keys[at[other]]
            other = other[(found[other] != keys[other]) & (found[other] != -1)]
        out, unknown = self.values[at], np.flatnonzero(found == -1)
        if len(unknown):
            new, places = np.unique(keys[unknown], return_inverse=True)
            out[unknown] = np.array([self.put(key) for key in new.tolist()], bool)[places]
        return out


class Transducer:
    """Lazily determinised byte transducer of one vocabulary.

    A state stands for all runs of bytes that end here and can still become tokens, and is named by the
    trie node of the longest; the others follow from it. ``table`` has a row of transitions for each state
    met; what a state can emit, the tokens that end there, stands in ``emits`` from ``first`` on, longest
    first. Of these a prefix ends with the one that the merges leave beside the token before it.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        self.lengths = np.zeros(max(self.token_bytes, default=-1) + 1, np.int32)
        for rank, token in self.token_bytes.items():
            self.lengths[rank] = len(token)
        # The trie: node << 8 | byte -> node; what a node accepts, its depth, whether it goes on, how it is reached.
        self.child: dict[int, int] = {}
        self.accepts, self.depths, self.inner, self.reached = [NO_TOKEN], [0], [True], [0]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                below = self.child.get(node << 8 | byte)
                if below is None:
                    below = self.child[node << 8 | byte] = len(self.accepts)
                    self.inner[node] = True
                    self.accepts.append(NO_TOKEN)
                    self.depths.append(self.depths[node] + 1)
                    self.inner.append(False)
                    self.reached.append(node << 8 | byte)
                node = below
            self.accepts[node] = rank
        self.next_longest: list[int | None] = [None] * len(self.accepts)
        self.endings: dict[int, tuple] = {0: ()}
        self.splits: dict[int, tuple[tuple, tuple]] = {}
        self.pairs = Pairs(lambda pair: self.parts_stay(pair >> TOKEN_BITS, pair & NO_TOKEN))
        self.first, self.count = np.full(len(self.accepts), -1, np.int32), np.zeros(len(self.accepts), np.int32)
        self.emits, self.emitted = np.empty(1024, np.int32), 0
        self._restart()

    def _restart(self) -> None:
        self.row = np.full(len(self.accepts), -1, np.int32)
        self.table, self.rows = np.full((1024, 256), -1, np.int32), 0

    def shorter(self, node: int) -> int:
        """The state of the same bytes without the longest run."""
        known = self.next_longest[node]
        if known is None:
            before = self.reached[node]
            known = self.next_longest[node] = self.target(self.shorter(before >> 8), before & 255) if before >> 8 else 0
        return known

    def target(self, node: int, byte: int) -> int:
        while True:
            below = self.child.get(node << 8 | byte)
            if below is not None:
                return below
            if not node:
                return 0
            node = self.shorter(node)

    def tokens(self, node: int) -> tuple[int, ...]:
        """All runs that end here and are tokens as they stand, longest first."""
        known = self.endings.get(node)
        if known is None:
            token = self.accepts[node]
            own = (token,) if token != NO_TOKEN and self.merge(self.token_bytes[token]) == [self.token_bytes[token]] else ()
            known = self.endings[node] = own + self.tokens(self.shorter(node))
        return known

    def _meet(self, node: int) -> None:
        """Lays down what a state emits."""
        tokens = self.tokens(node)
        if self.emitted + len(tokens) > len(self.emits):
            self.emits = np.concatenate((self.emits, np.empty(len(self.emits) + len(tokens), np.int32)))
        self.emits[self.emitted : self.emitted + len(tokens)] = tokens
        self.first[node], self.count[node] = self.emitted, len(tokens)
        self.emitted += len(tokens)

    def moves(self, nodes: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """The next states."""
        rows = self.row[nodes]
        if (rows < 0).any():
            new = np.unique(nodes[rows < 0])
            if self.rows + len(new) > MEMO_STATES:
                self._restart()
                new = np.unique(nodes)
            while self.rows + len(new) > len(self.table):
                self.table = np.concatenate((self.table, np.full_like(self.table, -1)))
            self.row[new] = np.arange(self.rows, self.rows + len(new))
            self.rows += len(new)
            rows = self.row[nodes]
        out = self.table[rows, bytes_]
        missing = np.flatnonzero(out < 0)
        if len(missing):
            keys = np.unique(nodes[missing].astype(np.int64) << 8 | bytes_[missing])
            for key in keys.tolist():
                node = self.table[self.row[key >> 8], key & 255] = self.target(key >> 8, key & 255)
                if self.first[node] < 0:
                    self._meet(node)
            out[missing] = self.table[rows[missing], bytes_[missing]]
        return out

    def ends(self, nodes: np.ndarray, before: np.ndarray, place: int) -> np.ndarray:
        """The last tokens of prefixes of ``place`` bytes that end in the states; ``before`` has a row a shorter prefix."""
        out = np.full(len(nodes), NO_TOKEN, np.int32)
        open_, k = np.arange(len(nodes)), 0
        while len(open_):
            node = nodes[open_]
            if (self.count[node] <= k).any():
                raise ValueError("the vocabulary has no token for some byte")
            token = self.emits[self.first[node] + k]
            start = place - self.lengths[token]
            left = before[np.maximum(start, 1) - 1, open_].astype(np.int64)
            inner = np.flatnonzero(start > 0)
            stays = start == 0
            stays[inner] = self.pairs.look(left[inner] << TOKEN_BITS | token[inner])
            out[open_[stays]] = token[stays]
            open_, k = open_[~stays], k + 1
        return out

    def run(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list]:
        """Token counts of runs of bytes side by side, and (runs, tokens) by place from the end."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        last = np.empty((int(sizes[0]), len(sizes)), np.int32)
        nodes = np.zeros(len(sizes), np.int32)
        for place in range(len(last)):
            n = int(np.searchsorted(-sizes, -place, side="left"))
            nodes = self.moves(nodes[:n], data[starts[:n] + place])
            last[place, :n] = self.ends(nodes, last, place + 1)
        counts, found, place, open_ = np.zeros(len(sizes), np.int64), [], sizes.copy(), np.arange(len(sizes))
        while len(open_):
            token = last[place[open_] - 1, open_]
            found.append((order[open_], token))
            counts[order[open_]] += 1
            place[open_] -= self.lengths[token]
            open_ = open_[place[open_] > 0]
        return counts, found

    def encode_all(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the pieces' tokens."""
        ranks = np.fromiter((self.ranks.get(piece, -1) for piece in pieces.to_pylist()), np.int64, len(pieces))
        offsets, data = _flat(pieces)
        sizes = np.diff(offsets)
        counts = np.where(ranks >= 0, 1, 0)
        side = np.flatnonzero((ranks < 0) & (sizes > 0) & (sizes <= LANE_BYTES))
        side, runs, alone = side[np.argsort(sizes[side], kind="stable")], [], {}
        for start in range(0, len(side), LANES):
            part = side[start : start + LANES]
            counts[part], found = self.run(data, offsets[part], sizes[part])
            runs.append((part, found))
        for i in np.flatnonzero((ranks < 0) & (sizes > LANE_BYTES)).tolist():
            alone[i] = self.encode_piece(data[offsets[i] : offsets[i + 1]].tobytes())
            counts[i] = len(alone[i])
        places = np.concatenate(([0], np.cumsum(counts)))
        ids = np.empty(places[-1], np.int32)
        single = np.flatnonzero(ranks >= 0)
        ids[places[single]] = ranks[single]
        for part, found in runs:
            for back, (run, tokens) in enumerate(found, 1):
                ids[places[part[run] + 1] - back] = tokens
        for i, tokens in alone.items():
            ids[places[i] : places[i + 1]] = tokens
        return places, ids

    def merge(self, data: bytes, least_parts: int = 1) -> list[bytes]:
        """The merges themselves, lowest rank first and leftmost among equals; for short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least_parts:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def spines(self, token: int) -> tuple[tuple, tuple]:
        """What stands at the token's left and right edge while it forms: (bytes, rank of the merge that ends it)."""
        known = self.splits.get(token)
        if known is None:
            data, halves = self.token_bytes[token], ()
            if len(data) > 1:
                halves = self.merge(data, 2)
            if len(halves) == 2:
                left, right = (self.ranks[h] for h in halves)
                known = ((*self.spines(left)[0], (halves[0], token)), (*self.spines(right)[1], (halves[1], token)))
            else:
                known = ((), ())
            self.splits[token] = known
        return known

    def parts_stay(self, left: int, right: int) -> bool:
        """Whether no merge joins the edges of two adjacent tokens before their own merges are done."""
        ranks, never = self.ranks, 1 << 60
        a, b = self.spines(left)[1], self.spines(right)[0]
        i = j = 0
        while True:
            edge_a, until_a = a[i] if i < len(a) else (self.token_bytes[left], never)
            edge_b, until_b = b[j] if j < len(b) else (self.token_bytes[right], never)
            across = ranks.get(edge_a + edge_b, never)
            if across < until_a and across <= until_b and across != never:
                return False
            if until_a == never and until_b == never:
                return True
            if until_a <= until_b:
                i += 1
            else:
                j += 1

    def encode_piece(self, data: bytes) -> list[int]:
        """One run of bytes of any length."""
        if data in self.ranks:
            return [self.ranks[data]]
        done: list[int] = []
        node, waiting = np.zeros(1, np.int32), []  # waiting: the token that ends each prefix since the settled ones
        for byte in data:
            node = self.moves(node, np.array([byte], np.uint8))
            waiting.append(self._end(int(node[0]), waiting, done))
            if len(waiting) > LOOKAHEAD:
                settled = self._settled(int(node[0]), waiting)
                done += self._back(waiting, settled)
                del waiting[:settled]
        return done + self._back(waiting, len(waiting))

    def _end(self, node: int, waiting: list[int], done: list[int]) -> int:
        for token in self.tokens(node):
            start = len(waiting) + 1 - len(self.token_bytes[token])
            if not start and not done:
                return token
            left = waiting[start - 1] if start else done[-1]
            if self.pairs.look(np.array([left << TOKEN_BITS | token]))[0]:
                return token
        raise ValueError("the vocabulary has no token for some byte")

    def _back(self, ends: list[int], place: int) -> list[int]:
        """The tokens that lead to ``place``."""
        out, token_bytes = [], self.token_bytes
        while place > 0:
            token = ends[place - 1]
            out.append(token)
            place -= len(token_bytes[token])
        out.reverse()
        return out

    def _settled(self, node: int, ends: list[int]) -> int:
        """The last place that the ways to all prefixes share from which a token may still run on."""
        places = {len(ends)}
        while node:
            if self.inner[node]:
                places.add(len(ends) - self.depths[node])
            node = self.shorter(node)
        while len(places) > 1:
            last = max(places)
            places.discard(last)
            places.add(last - len(self.token_bytes[ends[last - 1]]))
        return places.pop()


def _spaces() -> tuple[np.ndarray, np.ndarray]:
    """White space of one byte as a table, and that of more as numbers of three bytes (the last of two: 0)."""
    found = [c.encode("utf-8") for c in regex.findall(r"\s", "".join(map(chr, range(0x3001))))]
    table = np.zeros(256, bool)
    table[[c[0] for c in found if len(c) == 1]] = True
    return table, np.array([int.from_bytes(c.ljust(3, b"\0"), "big") for c in found if len(c) > 1])


_SPACE, _WIDE_SPACES = _spaces()


def spaces(data: np.ndarray) -> np.ndarray:
    """Marks the bytes of white space in UTF-8."""
    out = _SPACE[data]
    for lead in np.unique(_WIDE_SPACES >> 16):
        width = 2 if lead < 0xE0 else 3
        at = np.flatnonzero(data[: max(0, len(data) - width + 1)] == lead)
        code = lead << 16 | data[at + 1].astype(np.int64) << 8 | (data[at + 2] if width == 3 else 0)
        at = at[np.isin(code, _WIDE_SPACES)]
        for k in range(width):
            out[at + k] = True
    return out


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places in texts that stand one behind another, from ``offsets`` on, where a match of SPACE_LED must begin."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    space = spaces(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:n]
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    # Of a text's inner runs: where white space starts, where other text does.
    inner = change[~first[change]]
    opens, words = inner[space[inner]], inner[~space[inner]]
    before = words - 1
    for _ in range(2):
        before = before - ((data[before] & 0xC0) == 0x80)
    out = first.copy()
    out[opens] = True
    out[before] = True
    out[words[data[words - 1] != 32]] = True
    return np.flatnonzero(out)


class Encoder:
    """Splits texts by a pattern and encodes each match separately; keeps the ids of pieces seen lately.

    Two tables of pieces hold about ``MEMO_PIECES`` each: a young one, and the one before it.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.space_led = pattern == SPACE_LED
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _matches(self, pieces: list[str]) -> tuple[list[str], np.ndarray]:
        """The pattern's matches in all pieces, and how many each has."""
        if not self.space_led:
            found = [self.split(piece) for piece in pieces]
            return [match for matches in found for match in matches], np.fromiter(map(len, found), np.int64, len(found))
        # No piece but those of white space alone holds a line end, and these are matches as they stand.
        found = self.split("\n".join(["x" if piece.isspace() else piece for piece in pieces]))
        ends = np.append(np.flatnonzero(np.fromiter((match == "\n" for match in found), bool, len(found))), len(found))
        counts = np.diff(ends, prepend=-1) - 1
        matches = [match for match in found if match != "\n"]
        places = np.cumsum(counts) - counts
        for i, piece in enumerate(pieces):
            if piece.isspace():
                matches[places[i]] = piece
        return matches, counts

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of text as bytes of 32-bit numbers."""
        matches, counts = self._matches([piece.decode("utf-8") for piece in pieces])
        coded = pa.array(matches, pa.large_string()).dictionary_encode()
        places, ids = self.transducer.encode_all(coded.dictionary.cast(pa.large_binary()))
        flat = pa.LargeListArray.from_arrays(pa.array(places), pa.array(ids)).take(coded.indices).flatten()
        through = np.concatenate(([0], np.cumsum(np.diff(places)[coded.indices.to_numpy()])))
        ends = 4 * through[np.concatenate(([0], np.cumsum(counts)))]
        blob = flat.to_numpy().astype(np.int32).tobytes()
        return [blob[start:end] for start, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _known(self, pieces: list[bytes]) -> list[bytes]:
        ids = [self.young.get(piece) or self.old.get(piece) for piece in pieces]
        new = [i for i, known in enumerate(ids) if known is None]
        for i, known in zip(new, self._encode([pieces[i] for i in new]) if new else [], strict=True):
            ids[i] = known
        self.young.update((piece, known) for piece, known in zip(pieces, ids, strict=True) if len(piece) <= MEMO_BYTES)
        if len(self.young) >= MEMO_PIECES:
            self.old, self.young = self.young, {}
        return ids

    def encode_all(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text; nulls as empty texts."""
        offsets, data = _flat(texts)
        starts = cuts(data, offsets) if self.space_led else np.unique(offsets[:-1][np.diff(offsets) > 0])
        if not len(starts):
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1), pa.int32()), pa.array([], pa.int32()))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        ids = self._known(coded.dictionary.to_pylist())
        ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))))) // 4
        flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
        gathered = pa.LargeListArray.from_arrays(pa.array(ends), flat).take(coded.indices).flatten()
        through = np.concatenate(([0], np.cumsum(np.diff(ends)[coded.indices.to_numpy()])))
        return pa.ListArray.from_arrays(pa.array(through[np.searchsorted(starts, offsets)], pa.int32()), gathered)

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text], pa.string()))[0].as_py()


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of texts, from the first text on; nulls are empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return ends - ends[0], data[ends[0] : ends[-1]]


#: Fixed values of UTF-8: first byte from, to; bytes that follow; least and greatest second byte.
LEADS = (
    (0xC2, 0xDF, 1, 0x80, 0xBF),
    (0xE0, 0xE0, 2, 0xA0, 0xBF),
    (0xE1, 0xEC, 2, 0x80, 0xBF),
    (0xED, 0xED, 2, 0x80, 0x9F),
    (0xEE, 0xEF, 2, 0x80, 0xBF),
    (0xF0, 0xF0, 3, 0x90, 0xBF),
    (0xF1, 0xF3, 3, 0x80, 0xBF),
    (0xF4, 0xF4, 3, 0x80, 0x8F),
)
FRESH = (b"", 0, 0, 0)


def utf8_step(state: tuple, byte: int) -> tuple[tuple, str]:
    """State (bytes held, bytes missing, least and greatest next byte) and a byte to the next state and text."""
    held, missing, low, high = state
    if missing:
        if low <= byte <= high:
            held += bytes((byte,))
            if missing == 1:
                return FRESH, held.decode("utf-8")
            return (held, missing - 1, 0x80, 0xBF), ""
        after, text = utf8_step(FRESH, byte)
        return after, "�" + text
    if byte < 0x80:
        return FRESH, chr(byte)
    for start, end, count, least, most in LEADS:
        if start <= byte <= end:
            return (bytes((byte,)), count, least, most), ""
    return FRESH, "�"


class StreamDecoder:
    """Tokens in, text out as soon as it is whole; a table from (state, token) is filled when first needed."""

    def __init__(self, token_bytes: dict[int, bytes]):
        self.token_bytes = token_bytes
        self.tables: dict[tuple, dict[int, tuple[str, dict]]] = {}
        self.states: dict[int, tuple] = {}
        self.fresh = self._table(FRESH)
        every = [token_bytes.get(token, b"") for token in range(max(token_bytes, default=-1) + 1)]
        self.bytes = pa.array(every, pa.large_binary())
        self.whole = np.array([_is_text(data) for data in every], bool)

    def _table(self, state: tuple) -> dict:
        table = self.tables.get(state)
        if table is None:
            table = self.tables[state] = {}
            self.states[id(table)] = state
        return table

    def _fill(self, table: dict, token: int) -> tuple[str, dict]:
        state, out = self.states[id(table)], []
        for byte in self.token_bytes[token]:
            state, text = utf8_step(state, byte)
            out.append(text)
        entry = table[token] = ("".join(out), self._table(state))
        return entry

    def stream(self, ids: list[int], at: int, end: int) -> tuple[str, int]:
        """The text of tokens from ``at`` until none of it is held back, and the place behind them."""
        table, out = self.fresh, []
        while at < end:
            entry = table.get(ids[at]) or self._fill(table, ids[at])
            out.append(entry[0])
            table = entry[1]
            at += 1
            if table is self.fresh:
                return "".join(out), at
        return "".join(out) + ("\ufffd" if table is not self.fresh else ""), at

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """The text of each id sequence, as its bytes decoded with replacement characters; nulls as empty ones."""
        sizes = ids.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        offsets, flat = np.concatenate(([0], np.cumsum(sizes))), ids.flatten()
        joined = self.bytes.take(flat)
        ends = np.frombuffer(joined.buffers()[1], np.int64)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        places, data = ends[offsets], joined.buffers()[2] if len(flat) else pa.py_buffer(b"")
        changes = self._changes(flat.to_numpy(), offsets, ends, data)
        if not changes:
            return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(places), data]).cast(pa.string())
        parts, texts, view, k = [], [], memoryview(data), 0
        for start, end in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
            parts = []
            while k < len(changes) and changes[k][0] < end:
                first, last, text = changes[k]
                parts += [bytes(view[start:first]), text.encode("utf-8")]
                start, k = last, k + 1
            texts.append(b"".join([*parts, bytes(view[start:end])]).decode("utf-8"))
        return pa.array(texts, pa.string())

    def _changes(self, flat: np.ndarray, offsets: np.ndarray, ends: np.ndarray, data) -> list[tuple[int, int, str]]:
        """(first byte, byte behind, text) where the state machine gives other bytes than the tokens' own."""
        part = np.flatnonzero(~self.whole[flat])
        if not len(part):
            return []
        until = offsets[np.searchsorted(offsets, part, side="right")]
        out, at, ids, view = [], 0, flat.tolist(), memoryview(data)
        for start, end in zip(part.tolist(), until.tolist(), strict=True):
            if start < at:
                continue
            text, at = self.stream(ids, start, end)
            if "\ufffd" in text and text.encode("utf-8") != view[ends[start] : ends[at]]:
                out.append((int(ends[start]), int(ends[at]), text))
        return out

    def decode(self, ids) -> str:
        """As bytes joined and decoded with replacement characters."""
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


def _is_text(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


_made: dict = {}


def _room() -> None:
    if len(_made) >= 6:
        _made.clear()


def _ranks(ranks) -> dict[bytes, int]:
    key = ("ranks", ranks.id)
    if key not in _made:
        _made[key] = load_ranks(ranks.value)
    return _made[key]


def _encoder(ranks, pattern: str) -> Encoder:
    key = ("encoder", ranks.id, pattern)
    if key not in _made:
        _room()
        _made[key] = Encoder(_ranks(ranks), pattern)
    return _made[key]


def _decoder(ranks) -> StreamDecoder:
    key = ("decoder", ranks.id)
    if key not in _made:
        _room()
        _made[key] = StreamDecoder({rank: token for token, rank in _ranks(ranks).items()})
    return _made[key]


def _share(df: DataFrame, path: str) -> Shared:
    """The vocabulary file (a megabyte at most in public tokenizers) to every executor.

    Workers keep what they build from it by its content, so later queries find it again.
    """
    with open(path, "rb") as f:
        blob = f.read()
    return Shared(df.sparkSession, blob, hashlib.sha256(blob).hexdigest())


def _in_order(df: DataFrame, column: str, keep: tuple[str, ...], added: list[T.StructField], work) -> DataFrame:
    """``keep`` columns and ``added`` ones, which ``work`` makes of slices of ``column``; by place, so that no names clash."""
    kept = [c for c in keep if c not in {f.name for f in added}]
    slim = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{column}`").alias("given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = work()
        for batch in batches:
            for part in slices(batch, SLICE_ROWS, SLICE_BYTES):
                columns = [*part.columns[:-1], *make(part.columns[-1])]
                yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])
        # The worker goes on to other tasks, which need the room.
        pa.default_memory_pool().release_unused()

    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate([*slim.schema.fields[:-1], *added])]
    return slim.mapInArrow(run, T.StructType(fields)).toDF(*kept, *[f.name for f in added])


def encode(df: DataFrame, text_col: str = "text", *, vocab_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``keep`` columns plus ``ids`` (array<int>) of each whole text.

    ``decoded_col`` adds the text that the stream decoder gives for the ids, in the same task.
    """
    shared = _share(df, vocab_path)

    def work():
        coder, decoder = _encoder(shared, pattern), _decoder(shared) if decoded_col else None

        def make(texts: pa.Array) -> list[pa.Array]:
            ids = coder.encode_all(texts)
            return [ids, decoder.decode_all(ids)] if decoder else [ids]

        return make

    added = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] + [T.StructField(decoded_col, T.StringType())] * bool(decoded_col)
    return _in_order(df, text_col, keep, added, work)


def decode(df: DataFrame, ids_col: str = "ids", *, vocab_path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "decoded") -> DataFrame:
    """``keep`` columns plus the text of each id sequence; null sequences decode as the empty text."""
    shared = _share(df, vocab_path)

    def work():
        coder = _decoder(shared)
        return lambda ids: [coder.decode_all(ids)]

    return _in_order(df, ids_col, keep, [T.StructField(text_col, T.StringType())], work)


def digests(docs: DataFrame, *, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: token count, hash of the decimal ids, hash of the text decoded from them again."""
    both = encode(docs, text_col, vocab_path=vocab_path, pattern=pattern, keep=(id_col,), decoded_col="decoded")
    return both.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
