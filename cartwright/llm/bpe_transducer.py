"""Byte-level byte-pair encoding as a finite-state transducer, and its streaming decoding.

**Encoding.** Applying merges in rank order gives every byte string exactly one token sequence,
and a sequence is that one if and only if every two adjacent tokens stay apart when the bytes of
the two are merged on their own. That makes the encoder a finite-state transducer over bytes: a
configuration is a place in the prefix tree of the vocabulary plus the token before it.
:class:`Transducer` determinises it lazily: a deterministic state is the set of live
configurations, made when it is first reached; a transition yields the token that ends at the
byte in the encoding of everything up to it. Tokens are emitted once all live configurations
agree on them; as a configuration dies within the longest token, that is after a bounded
lookahead. The tables are emptied when they reach ``MAX_TRANSITIONS``.

:class:`Lockstep` runs that machine over all distinct pieces of some texts at once, byte place by
byte place: the states of a place and their moves are arrays, every (state, byte) is moved once for
all pieces that reach it, and states of equal configurations are one. It keeps nothing between
calls, so its memory is bounded by the texts given at once. Pieces beyond ``LONG_PIECE`` bytes go
through :class:`Transducer` one by one.

**Decoding.** :class:`Utf8Stream` takes tokens in any portions and yields text at once, holding
back at most three bytes of an unfinished character; malformed bytes become U+FFFD, one for each
maximal ill-formed part.

Null or empty texts give no ids and decode to the empty text. Repeated rows give repeated rows and
an empty table an empty one. Long texts take memory in proportion to themselves.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from cartwright.llm.memory import give_back

MAX_TRANSITIONS = 150_000
MAX_PAIRS = 150_000
MAX_KNOWN = 1_000_000  # pairs of tokens, 9 bytes each, that outlast a call
ROOT = 0
NEVER = 1 << 60

NONE = -1
UNKNOWN = -2
LONG_PIECE = 512
SLICE_BYTES = 1 << 20  # of texts that are encoded together
State = tuple  # ((token before, tree node), ...): live configurations, the oldest first


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes of each token with its rank, from lines of base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Merges:
    """What the rank table says about single tokens and pairs of tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        # the two tokens whose merge makes each; UNKNOWN until asked for, NONE if there are none
        self._parts = np.full((len(self.bytes_of), 2), UNKNOWN, np.int32)
        self._edges: dict[tuple[int, int], list[tuple[bytes, int, int]]] = {}
        self.known_apart: dict[int, bool] = {}

    def forget(self) -> None:
        self._edges.clear()
        self.known_apart.clear()

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte or an unreachable token."""
        left, right = self._parts[token].tolist()
        if left == UNKNOWN:
            left, right = self._parts[token] = self._merged(self.bytes_of[token])
        return None if left == NONE else (left, right)

    def _merged(self, data: bytes) -> tuple[int, int]:
        """The last merge of the bytes of a token, (NONE, NONE) if they don't come together."""
        parts, last = [self.ranks[data[i : i + 1]] for i in range(len(data))], (NONE, NONE)
        while len(parts) > 1:
            rank, i = min(
                (self.ranks.get(self.bytes_of[a] + self.bytes_of[b], NEVER), i)
                for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))
            )
            if rank == NEVER:
                return NONE, NONE
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [rank]
        return last

    def reachable(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        return len(self.bytes_of[token]) == 1 or self.split(token) is not None

    def edge(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """Tokens that stand at this end (0 left, 1 right) while the token forms: the bytes, and
        the ranks of the merges that make the token and that end it."""
        known = self._edges.get((token, side))
        if known is None:
            known, ends, at = [], NEVER, token
            while True:
                parts = self.split(at)
                known.append((self.bytes_of[at], -1 if parts is None else at, ends))
                if parts is None:
                    break
                ends, at = at, parts[side]
            self._edges[token, side] = known
        return known

    def apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border when the bytes of the two are merged."""
        pair = left << 32 | right
        known = self.known_apart.get(pair)
        if known is None:
            if len(self.known_apart) >= MAX_PAIRS:
                self.known_apart.clear()
            known = self.known_apart[pair] = not self.crossed(left, right)
        return known

    def crossed(self, left: int, right: int) -> bool:
        """A crossing merge of two edge tokens happens once both stand there and before either
        is merged within its own side; of equal ranks the left one goes first."""
        rank_of, firsts = self.ranks.get, self.edge(right, 0)
        for a, a_made, a_ends in self.edge(left, 1):
            for b, b_made, b_ends in firsts:
                if b_made >= a_ends or a_made > b_ends:
                    continue  # they never stand side by side
                rank = rank_of(a + b)
                if rank is not None and rank < a_ends and rank <= b_ends:
                    return True
        return False


class Transducer:
    """Bytes in, tokens out; deterministic states are made as they are reached."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        child: dict[int, int] = {}  # by node << 8 | byte
        depth, token_at = [0], {}
        for token, rank in ranks.items():
            if not self.merges.reachable(rank):
                continue
            node = ROOT
            for byte in token:
                following = child.get(node << 8 | byte)
                if following is None:
                    following = child[node << 8 | byte] = len(depth)
                    depth.append(depth[node] + 1)
                node = following
            token_at[node] = rank
        # arrays from here on: a worker keeps them for long
        self.edges = np.array([*sorted(child), 1 << 62], np.int64)
        self.kids = np.array([child[k] for k in self.edges[:-1].tolist()] + [NONE], np.int32)
        self.depth = np.array(depth, np.int32)
        self.token_at = np.full(len(depth), NONE, np.int32)
        self.token_at[list(token_at)] = list(token_at.values())
        self.inner = np.zeros(len(depth), bool)  # nodes that lead on
        self.inner[self.edges[:-1] >> 8] = True
        self.lookahead = int(self.depth.max())
        self.length = np.fromiter(map(len, self.merges.bytes_of), np.int32)
        self.restart()

    def child(self, node: int, byte: int) -> int:
        at = node << 8 | byte
        edge = int(np.searchsorted(self.edges, at))
        return int(self.kids[edge]) if self.edges[edge] == at else NONE

    def restart(self) -> None:
        self.states: list[State] = []
        self.number: dict[State, int] = {}
        self.table: dict[int, tuple[int, int]] = {}
        self.start = self._numbered(((NONE, ROOT),))

    def _numbered(self, state: State) -> int:
        n = self.number.get(state)
        if n is None:
            n = self.number[state] = len(self.states)
            self.states.append(state)
        return n

    def _step(self, state: State, byte: int) -> tuple[State, int]:
        """The next state, and the token that ends here in the encoding of all bytes so far."""
        live, ended = [], NONE
        for before, node in state:
            node = self.child(node, byte)
            if node == NONE:
                continue
            if self.inner[node]:
                live.append((before, node))
            token = int(self.token_at[node])
            if token != NONE and ended == NONE:
                if before == NONE or self.merges.apart(before, token):
                    ended = token
        live.append((ended, ROOT))
        return tuple(live), ended

    def _moved(self, state: int, byte: int) -> tuple[int, int]:
        full = self.states[state]
        if len(self.table) >= MAX_TRANSITIONS:
            self.restart()
            state = self._numbered(full)
        following, ended = self._step(full, byte)
        move = self.table[state << 8 | byte] = (self._numbered(following), ended)
        return move

    def _path(self, ends: list[int], stop: int) -> list[int]:
        """Tokens of the first ``stop`` bytes, given the token that ends at each byte."""
        path = []
        while stop > 0:
            path.append(ends[stop - 1])
            stop -= int(self.length[path[-1]])
        path.reverse()
        return path

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Tokens of the bytes, each once it is certain; holds a few lookaheads of bytes."""
        state, ends = self.start, []
        for byte in data:
            state, ended = self.table.get(state << 8 | byte) or self._moved(state, byte)
            ends.append(ended)
            if len(ends) >= 4 * self.lookahead:
                paths = [
                    self._path(ends, len(ends) - int(self.depth[node]))
                    for _, node in self.states[state]
                ]
                sure = []
                for tokens in zip(*paths, strict=False):
                    if len(set(tokens)) > 1:
                        break
                    sure.append(tokens[0])
                yield from sure
                del ends[: sum(int(self.length[t]) for t in sure)]
        yield from self._path(ends, len(ends))

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match of the splitting pattern; a piece that is a token is that token."""
        whole = self.merges.ranks.get(piece)
        return [whole] if whole is not None else list(self.stream(piece))


class Lockstep:
    """The transducer on many pieces at once; configurations, moves and paths are arrays."""

    def __init__(self, transducer: Transducer):
        self.merges = transducer.merges
        self.edges, self.kids = transducer.edges, transducer.kids
        self.token_at, self.inner, self.length = transducer.token_at, transducer.inner, transducer.length
        self._forget_pairs()

    def _apart(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each token may follow the one before it (none: it may)."""
        pairs = before << 32 | token
        place = np.searchsorted(self.pairs, pairs)
        out = self.verdicts[place]
        unknown = np.flatnonzero((self.pairs[place] != pairs) & (before != NONE))
        if len(unknown):
            fresh, own = np.unique(pairs[unknown], return_inverse=True)
            crossed = self.merges.crossed
            found = np.array([not crossed(p >> 32, p & 0xFFFFFFFF) for p in fresh.tolist()], bool)
            out[unknown] = found[own]
            if len(self.pairs) + len(fresh) > MAX_KNOWN:
                self._forget_pairs()
            place = np.searchsorted(self.pairs, fresh)
            self.pairs = np.insert(self.pairs, place, fresh)
            self.verdicts = np.insert(self.verdicts, place, found)
        out[before == NONE] = True
        return out

    def _forget_pairs(self) -> None:
        """Pairs of tokens met lately, ascending, and whether no merge crosses them; an end mark."""
        self.pairs = np.array([(1 << 63) - 1], np.int64)
        self.verdicts = np.zeros(1, bool)

    def ends(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For every byte of the pieces (of ``size`` bytes from ``begin``, the longest first) the
        token that ends there in the encoding of the piece up to it."""
        out = np.full(len(data), NONE, np.int64)
        state = np.zeros(len(begin), np.int64)  # of each piece, among the states of its place
        first = np.array([0, 1])  # where the configurations of each state begin
        before, node = np.array([NONE]), np.array([ROOT])
        active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        for place, n in enumerate(active.tolist()):
            at = begin[:n] + place
            moves, own = np.unique(state[:n] << 8 | data[at], return_inverse=True)
            start = first[moves >> 8]
            count = first[(moves >> 8) + 1] - start
            move = np.repeat(np.arange(len(moves)), count)
            config = np.arange(len(move)) + np.repeat(start - (np.cumsum(count) - count), count)
            step = node[config] << 8 | (moves & 255)[move]
            edge = np.searchsorted(self.edges, step)
            live = np.flatnonzero(self.edges[edge] == step)
            move, before, node = move[live], before[config[live]], self.kids[edge[live]].astype(np.int64)
            token = self.token_at[node].astype(np.int64)
            whole = np.flatnonzero(token != NONE)
            whole = whole[self._apart(before[whole], token[whole])]
            ended = np.full(len(moves), NONE, np.int64)
            ended[move[whole]] = token[whole]
            out[at] = ended[own]
            on = self.inner[node]
            move = np.concatenate([move[on], np.arange(len(moves))])
            order = np.argsort(move, kind="stable")
            before = np.concatenate([before[on], ended])[order]
            node = np.concatenate([node[on], np.zeros(len(moves), np.int64)])[order]
            first = np.searchsorted(move[order], np.arange(len(moves) + 1))
            state[:n] = own
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join([pieces[k] for k in order.tolist()]), np.uint8).astype(np.int64)
        size = size[order]
        begin = np.cumsum(size) - size
        ends = self.ends(data, begin, size)
        kept = np.zeros(len(data), bool)
        counts = np.zeros(len(pieces), np.int64)
        open_, left = np.arange(len(pieces)), size.copy()
        while len(open_):  # back from the ends, a token of every piece at a time
            last = begin[open_] + left - 1
            kept[last] = True
            counts[open_] += 1
            left -= self.length[ends[last]]
            on = left > 0
            open_, left = open_[on], left[on]
        ids = ends[kept]
        # back to the order in which the pieces were given
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return _gathered(ids, np.cumsum(counts) - counts, counts, back), counts[back]


def _gathered(values: np.ndarray, begin: np.ndarray, count: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The runs ``values[begin : begin + count]`` of the chosen numbers, one after the other."""
    count, begin = count[chosen], begin[chosen]
    shift = np.repeat(begin - (np.cumsum(count) - count), count)
    return values[np.arange(len(shift)) + shift]


class _Numbers(dict):
    """Numbers pieces in the order they are met."""

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        return number


class Encoder:
    """Ids of texts, some texts at a time; between calls it holds the vocabulary and little else."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.transducer = Transducer(ranks)
        self.lockstep = Lockstep(self.transducer)
        self.pattern = regex.compile(pattern)

    def forget(self) -> None:
        """Give back what texts have taught, so that a waiting worker holds the vocabulary only."""
        self.transducer.merges.forget()
        self.transducer.restart()
        give_back()

    def _numbered(self, text: str, numbers: _Numbers) -> np.ndarray:
        if len(text) > SLICE_BYTES:  # its pieces needn't all stand side by side
            found = (numbers[m.group()] for m in self.pattern.finditer(text))
            return np.fromiter(found, np.int32)
        pieces = self.pattern.findall(text)
        return np.fromiter(map(numbers.__getitem__, pieces), np.int32, len(pieces))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Every distinct piece of the texts is encoded once."""
        numbers = _Numbers()
        rows = [self._numbered(text, numbers) for text in texts]
        pieces = [p.encode() for p in numbers]
        rank = self.transducer.merges.ranks.get
        whole = np.fromiter((rank(p, NONE) for p in pieces), np.int64, len(pieces))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        short = np.flatnonzero((whole == NONE) & (size <= LONG_PIECE))
        long = np.flatnonzero((whole == NONE) & (size > LONG_PIECE))
        ids, counts = self.lockstep.encode([pieces[k] for k in short.tolist()])
        spelled = [np.array(self.transducer.encode(pieces[k]), np.int64) for k in long.tolist()]
        count = np.ones(len(pieces), np.int64)
        count[short] = counts
        count[long] = list(map(len, spelled))
        begin = np.arange(len(pieces))  # tokens that are pieces stand at their own number
        begin[short] = len(pieces) + np.cumsum(counts) - counts
        begin[long] = len(pieces) + len(ids) + np.cumsum(count[long]) - count[long]
        flat = np.concatenate([whole, ids, *spelled]).astype(np.int32)
        return [_gathered(flat, begin, count, row) for row in rows]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


def _character(lead: int) -> tuple[int, int, int]:
    """Length of the character this byte leads (0: none), and the range of its second byte."""
    if lead < 0x80:
        return 1, 0, 0
    if 0xC2 <= lead <= 0xDF:
        return 2, 0x80, 0xBF
    if 0xE0 <= lead <= 0xEF:
        return 3, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
    if 0xF0 <= lead <= 0xF4:
        return 4, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
    return 0, 0, 0


def utf8_step(held: bytes, byte: int) -> tuple[str, bytes]:
    """One move of the machine whose states are the starts of characters: (text out, next state)."""
    if held:
        length, low, high = _character(held[0])
        if (low <= byte <= high) if len(held) == 1 else (0x80 <= byte <= 0xBF):
            held += bytes((byte,))
            return (held.decode(), b"") if len(held) == length else ("", held)
        out, after = utf8_step(b"", byte)
        return "�" + out, after
    length = _character(byte)[0]
    if length == 1:
        return chr(byte), b""
    return ("�", b"") if length == 0 else ("", bytes((byte,)))


class Utf8Stream:
    """Text of tokens that come in portions; the state is the unfinished character.

    The machine's moves are composed over whole tokens and remembered: ``whole`` for the state
    between characters, ``moves`` for the few others.
    """

    def __init__(self, vocabulary: Sequence[bytes] | dict[int, bytes], tables: tuple[dict, dict] | None = None):
        self.vocabulary = vocabulary
        self.whole, self.moves = tables or ({}, {})
        self.held = b""

    def _move(self, held: bytes, token: int) -> tuple[str, bytes]:
        move = self.moves.get((held, token))
        if move is None:
            out, state = [], held
            for byte in self.vocabulary[token]:
                text, state = utf8_step(state, byte)
                out.append(text)
            move = ("".join(out), state)
            if not held and not state:
                self.whole[token] = move[0]
            else:
                if len(self.moves) >= MAX_TRANSITIONS:
                    self.moves.clear()
                self.moves[held, token] = move
        return move

    def feed(self, tokens: list[int]) -> str:
        """Text that is certain after these tokens."""
        parts = list(map(self.whole.get, tokens))
        at = 0
        while True:
            if not self.held:  # on to the next token that isn't known to be whole characters
                try:
                    at = parts.index(None, at)
                except ValueError:
                    return "".join(parts)
            if at == len(tokens):
                return "".join(parts)
            parts[at], self.held = self._move(self.held, tokens[at])
            at += 1

    def end(self) -> str:
        """What an unfinished character becomes at the end."""
        held, self.held = self.held, b""
        return "�" if held else ""


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    encoder = Encoder(read_ranks(path), pattern)
    gc.collect()
    gc.freeze()  # the vocabulary stays: the collector need not walk it again
    return encoder


@lru_cache(maxsize=2)
def _decoding(path: str, pattern: str) -> tuple[list[bytes], tuple[dict, dict]]:
    """Tokens by number, those of the encoder, and the moves that decoding has learnt."""
    return _encoder(path, pattern).transducer.merges.bytes_of, ({}, {})


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[list[bytes], tuple[dict, dict]]:
    return Merges(read_ranks(path)).bytes_of, ({}, {})


PORTION = 4096  # ids decoded at once


def token_ids(text: str | Column, ranks_path: str, pattern: str) -> Column:
    """``array<int>``: ids of the text; ``ranks_path`` must exist on every executor."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(ranks_path, pattern)
        for batch in batches:
            made = [_ids([])]
            made += [_ids(encoder.encode_all(texts)) for texts in _slices(batch)]
            yield pa.concat_arrays(made)
        encoder.forget()

    return encode(F.col(text) if isinstance(text, str) else text)


def _slices(batch: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch, some of about ``SLICE_BYTES`` together or one of any length at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(batch):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        yield [t.as_py() or "" for t in batch.slice(begin, end - begin)]
        begin = end


def _ids(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.fromiter(accumulate(map(len, rows), initial=0), np.int32, len(rows) + 1)
    flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _decoded(ids: np.ndarray, vocabulary: Sequence[bytes] | dict[int, bytes], tables: tuple[dict, dict]) -> str:
    stream = Utf8Stream(vocabulary, tables)
    out = [stream.feed(ids[i : i + PORTION].tolist()) for i in range(0, len(ids), PORTION)]
    return "".join([*out, stream.end()])


def decoded_text(ids: str | Column, ranks_path: str) -> Column:
    """Text of an array of ids, taken in portions; a missing array is empty text."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary, tables = _vocabulary(ranks_path)
        none = np.empty(0, np.int32)
        for batch in batches:
            rows = [none if r.values is None else r.values.to_numpy() for r in batch]
            yield pa.array([_decoded(r, vocabulary, tables) for r in rows], pa.string())

    return decode(F.col(ids) if isinstance(ids, str) else ids)


def round_trip(text: str | Column, ranks_path: str, pattern: str) -> Column:
    """``struct<ids array<int>, decoded string>``: both directions in one visit to Python."""

    @F.arrow_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(ranks_path, pattern)
        vocabulary, tables = _decoding(ranks_path, pattern)
        for batch in batches:
            ids, texts = [_ids([])], [pa.array([], pa.string())]
            for part in _slices(batch):
                rows = encoder.encode_all(part)
                ids.append(_ids(rows))
                texts.append(pa.array([_decoded(r, vocabulary, tables) for r in rows], pa.string()))
            yield pa.StructArray.from_arrays(
                [pa.concat_arrays(ids), pa.concat_arrays(texts)], ["ids", "decoded"]
            )
        encoder.forget()

    return both(F.col(text) if isinstance(text, str) else text)
