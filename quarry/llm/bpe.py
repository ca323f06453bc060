"""Byte-level BPE: a lazily determinised transducer encodes, an incremental UTF-8 machine decodes.

A state is (edge of the last emitted token, bytes since). Reading a byte finds the one token that can end there, given the token
before it; tokens on which all still possible continuations agree are emitted. Tokens are short, so the bytes held
back are bounded; states and transitions are built when first met, and dropped together when there are too many.

A piece that is itself a token is emitted as it is; merging would give the same.

Defined cases: a null text counts as empty (no ids); any other text, of any length, is encoded whole; rows are independent
of each other, so repeated rows and rows with a null id give a row each; an empty table gives none; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from array import array
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, held, trim

#: States, and pieces in each of two generations, that a worker keeps: about 350 MB.
MAX_STATES, MAX_PIECES = 350_000, 250_000
#: Marks of what was met once: only what comes again is kept, for most of the words of a corpus come once.
MARKS = 1 << 21
#: Pieces or ids that are handled at a time.
BLOCK = 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _State:
    __slots__ = ("edge", "ends", "final", "live", "next", "window")

    def __init__(self, edge: tuple, window: bytes, ends: tuple[int, ...], live: tuple[int, ...]):
        self.edge, self.window, self.ends, self.live, self.next, self.final = edge, window, ends, live, {}, None


_BYTES = [bytes([b]) for b in range(256)]
_NONE = 1 << 60


class BpeTransducer:
    """Encodes pieces (matches of the split pattern) to token ids as rank-ordered merging would.

    Of the token before the window a state keeps only ``edge``: those parts of its right spine that could still merge
    with something that begins like the window. Tokens that differ elsewhere share their states."""

    def __init__(self, ranks: dict[bytes, int], max_states: int | None = None, max_pieces: int | None = None):
        self.ranks, self.max_states, self.max_pieces = ranks, max_states or MAX_STATES, max_pieces or MAX_PIECES
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self.spines: dict[int, tuple[tuple, tuple] | None] = {}  # of the tokens met, so at most one a token
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}  # pieces kept before those, for as long
        self.met_pieces = bytearray(MARKS)
        self._reset()

    def _reset(self) -> None:
        self.start = _State((), b"", (-1,), (0,))
        self.states = {((), b"", ()): self.start}
        self.met = bytearray(MARKS)
        self.fits: dict[tuple, bool] = {}

    def _spine(self, token: int) -> tuple[tuple, tuple] | None:
        """Left and right spine of a token's merge tree, as (bytes, rank of the merge that consumes it); None if merging its bytes gives another result."""
        if token not in self.spines:
            parts = [self.tokens[token][i : i + 1] for i in range(len(self.tokens[token]))]
            left, right = [], []
            first, last = parts[0], parts[-1]
            while len(parts) > 1:
                rank, i = min((self.ranks.get(a + b, _NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == _NONE:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                if parts[0] != first:
                    left.append((first, rank))
                    first = parts[0]
                if parts[-1] != last:
                    right.append((last, rank))
                    last = parts[-1]
            self.spines[token] = ((*left, (first, _NONE)), (*right, (last, _NONE))) if len(parts) == 1 else None
        return self.spines[token]

    def _fits(self, edge: tuple, token: int) -> bool:
        """Whether a token can stand after that right edge: no merge across the border comes before the merges inside."""
        if (edge, token) not in self.fits:
            if len(self.fits) >= 4 * self.max_states:
                self.fits.clear()
            get = self.ranks.get
            self.fits[edge, token] = not any((m := get(x + y)) is not None and m < p and m <= q for x, p in edge for y, q in self._spine(token)[0])
        return self.fits[edge, token]

    def _edge(self, spine: tuple, window: bytes) -> tuple:
        """What of a right spine could merge with a token that begins like the window."""
        if not window:
            return spine
        ranks, prefixes = self.ranks, self.prefixes
        return tuple(e for e in spine if (x := e[0] + window) in prefixes or any(x[:i] in ranks for i in range(len(e[0]) + 1, len(x) + 1)))

    def _chain(self, ends: Sequence[int], at: int) -> list[int]:
        """Tokens, in order, that lead from the window's start to ``at``."""
        out = []
        while at:
            out.append(ends[at])
            at -= len(self.tokens[ends[at]])
        return out[::-1]

    def _step(self, s: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        window, ranks, found = s.window + _BYTES[byte], self.ranks, -1
        for j in s.live:  # longest first
            token = ranks.get(window[j:])
            if token is not None and self._spine(token):
                edge = self._spine(s.ends[j])[1] if j else s.edge
                if not edge or self._fits(edge, token):
                    found = token
                    break
        ends = [*s.ends, found]
        live = [j for j in s.live if window[j:] in self.prefixes]
        if found >= 0:
            live.append(len(window))
        emitted, *others = (self._chain(ends, j) for j in live)
        for other in others:
            same = 0
            while same < len(emitted) and same < len(other) and emitted[same] == other[same]:
                same += 1
            emitted = emitted[:same]
        cut = sum(len(self.tokens[t]) for t in emitted)
        if live[0] > cut:
            edge = ()  # no token can begin at the window's start any more
        else:
            edge = self._edge(self._spine(emitted[-1])[1] if emitted else s.edge, window[cut:])
        key = (edge, window[cut:], tuple(ends[cut + 1 :]))
        state = self.states.get(key)
        again = hash((s.window, byte, s.edge)) % MARKS
        if state is None:
            state = _State(edge, key[1], (-1, *key[2]), tuple(j - cut for j in live))
            if self.met[again]:
                if len(self.states) >= self.max_states:
                    self._reset()
                self.states[key] = state
        out = (state, tuple(emitted))
        if self.met[again]:
            s.next[byte] = out
        self.met[again] = 1
        return out

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        state, out = self.start, []
        for byte in piece:
            state, emitted = state.next.get(byte) or self._step(state, byte)
            if emitted:
                out += emitted
        if state.final is None:
            state.final = tuple(self._chain(state.ends, len(state.window)))
        return (*out, *state.final)

    def encode(self, pieces: Iterable[str]) -> list[int]:
        """Ids of pieces, in order."""
        seen, ids = self.pieces, []
        for piece in pieces:
            if (found := seen.get(piece)) is None:
                mark = hash(piece) % MARKS
                if (found := self.older.get(piece)) is None:
                    found = self.encode_piece(piece.encode())
                if self.met_pieces[mark] and len(piece) < 64:
                    seen[piece] = found
                    if len(seen) >= self.max_pieces:
                        self.older, self.pieces, self.met_pieces = seen, {}, bytearray(MARKS)
                        seen = self.pieces
                self.met_pieces[mark] = 1
            ids += found
        return ids


#: The UTF-8 machine: by state, (lowest byte, highest byte, next state). State 0 is between characters.
_UTF8 = {
    0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 2), (0xE1, 0xEC, 3), (0xED, 0xED, 4), (0xEE, 0xEF, 3), (0xF0, 0xF0, 5), (0xF1, 0xF3, 6), (0xF4, 0xF4, 7)],
    1: [(0x80, 0xBF, 0)], 2: [(0xA0, 0xBF, 1)], 3: [(0x80, 0xBF, 1)], 4: [(0x80, 0x9F, 1)],
    5: [(0x90, 0xBF, 3)], 6: [(0x80, 0xBF, 3)], 7: [(0x80, 0x8F, 3)],
}
_MOVES = [{b: to for lo, hi, to in _UTF8[s] for b in range(lo, hi + 1)} for s in range(8)]


class Utf8Decoder:
    """Takes bytes in any cuts, gives text as soon as characters are complete; bad bytes raise ValueError."""

    def __init__(self) -> None:
        self.state, self.held = 0, b""

    def feed(self, data: bytes) -> str:
        if not self.state and data.isascii():
            return data.decode("ascii")
        data, state = self.held + data, 0
        at = max(0, len(data) - 3)  # a character that is still open began in the last three bytes
        while at and data[at] & 0xC0 == 0x80 and len(data) - at < 7:
            at -= 1
        text, whole = data[:at].decode(), at
        for i in range(at, len(data)):
            if (state := _MOVES[state].get(data[i], -1)) < 0:
                raise ValueError(f"byte {data[i]:#x} can't follow")
            if not state:
                whole = i + 1
        self.state, self.held = state, data[whole:]
        return text + data[at:whole].decode()

    def close(self) -> None:
        if self.state:
            raise ValueError("the bytes end inside a character")


def _tools(path: str, pattern: str, *limits: int | None) -> tuple:
    def make() -> tuple:
        import regex

        return BpeTransducer(load_ranks(path), *limits), regex.compile(pattern)

    return held(("bpe", path, pattern, *limits), make)


def blocks(text: str, pattern) -> Iterator[list[str]]:
    """The pieces of a text, block by block."""
    if len(text) <= 16 * BLOCK:
        yield pattern.findall(text)
        return
    found = pattern.finditer(text)
    while some := [m.group() for m in itertools.islice(found, BLOCK)]:
        yield some


def digest(text: str, transducer: BpeTransducer, pattern) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids, SHA-256 of the decoded bytes; block by block."""
    ids, n = hashlib.sha256(), 0
    decoded, machine = hashlib.sha256(), Utf8Decoder()
    for pieces in blocks(text, pattern):
        block = array("I", transducer.encode(pieces))
        n += len(block)
        ids.update(block.tobytes())
        decoded.update(machine.feed(b"".join(map(transducer.tokens.__getitem__, block))).encode())
    machine.close()
    return n, ids.hexdigest(), decoded.hexdigest()


def bpe_roundtrip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", max_states: int | None = None, max_pieces: int | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit integers), decoded_sha256.

    ``max_states`` and ``max_pieces`` bound what a worker remembers; they change its memory and speed, not the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer, compiled = _tools(path, pattern, max_states, max_pieces)
        for batch in batches:
            found = [digest(t or "", transducer, compiled) for t in batch.column(1).to_pylist()]
            n, ids, decoded = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        trim()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id and ids, the token ids of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer, compiled = _tools(path, pattern)
        for batch in batches:
            ids = [[i for pieces in blocks(t or "", compiled) for i in transducer.encode(pieces)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id and text; null ids give an empty text, ids that are no UTF-8 together raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in load_ranks(path).items()}
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                machine, out = Utf8Decoder(), []
                for i in range(0, len(ids or ()), BLOCK):
                    out.append(machine.feed(b"".join(tokens[x] for x in ids[i : i + BLOCK])))
                machine.close()
                texts.append("".join(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_roundtrip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
