"""Operator 8: byte-level BPE as a finite-state transducer, and streaming decoding.

Encoding.  A byte prefix has exactly one BPE encoding, and a token row is the
encoding of its bytes exactly if each two neighbours are.  So the encoding of a
prefix is that of a shorter prefix plus its last token, the one token ending there
that may follow the shorter prefix's last one.  A state keeps, for every place
where a token that is still unfinished may have begun, the pending tokens up to
there; tokens on which all of these agree (but for the last, which decides what
may follow) are emitted.  The lookahead is bounded, as no token is longer than the
longest.  States and arcs are made when a text first asks for them and kept, so
common text runs along arcs that exist: one dictionary lookup a byte.

Decoding.  A state machine over bytes tells after each token how far the bytes so
far are whole UTF-8 characters; :class:`StreamingDecoder` gives text out as soon as
it is whole.

Null text counts as empty: no ids.  Texts are encoded whole; decoding goes on a bounded
run of ids at a time.  Repeated ids and texts give a row each; an empty table gives none.
Columns other than the two named are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.llm.common import id_and_text


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_by_rank(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """The definition: join the neighbours of least rank until none can be joined."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


#: Ids that are fed to the decoder at a time.
FED = 1 << 14


class Transducer:
    """Merges as a transducer; states and arcs up to ``most``, then made anew."""

    def __init__(self, ranks: dict[bytes, int], most: int = 1_000_000):
        self.ranks, self.most = ranks, most
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._prefixes = {t[:n] for t in ranks for n in range(1, len(t))}
        self._follows: dict[tuple[int, int], bool] = {}
        self._whole: dict[bytes, bool] = {}
        self._forget()

    def _forget(self) -> None:
        # a state: bytes since the earliest live place, and (bytes before the end, pending ids) of each live place
        self._states: list[tuple[bytes, tuple[tuple[int, tuple[int, ...]], ...]]] = [(b"", ((0, ()),))]
        self._numbers = {self._states[0]: 0}
        self._arcs: dict[int, tuple[int, tuple[int, ...]]] = {}

    def _reachable(self, token: bytes) -> bool:
        """Whether merges lead to the token at all."""
        if (known := self._whole.get(token)) is None:
            known = self._whole[token] = merge_by_rank(self.ranks, token) == [self.ranks[token]]
        return known

    def _may_follow(self, left: int, right: int) -> bool:
        if (known := self._follows.get((left, right))) is None:
            if len(self._follows) > self.most:
                self._follows.clear()
            known = self._follows[left, right] = merge_by_rank(self.ranks, self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def _arc(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        tail, live = self._states[state]
        tail += bytes((byte,))
        own = None
        for back, pending in live:  # the token that ends here began at a live place
            token = tail[len(tail) - back - 1 :]
            rank = self.ranks.get(token)
            if rank is not None and self._reachable(token) and (not pending or self._may_follow(pending[-1], rank)):
                own = (*pending, rank)
                break
        if own is None:
            raise ValueError(f"no token for byte {byte}")
        now = [(back + 1, pending) for back, pending in live if tail[len(tail) - back - 1 :] in self._prefixes] + [(0, own)]
        first, shared = now[0][1], 0
        most = min([len(p) for _, p in now]) - 1
        while shared < most and all(p[shared] == first[shared] for _, p in now):
            shared += 1
        key = (tail[len(tail) - now[0][0] :], tuple((back, p[shared:]) for back, p in now))
        number = self._numbers.get(key)
        if number is None:
            number = self._numbers[key] = len(self._states)
            self._states.append(key)
        return number, first[:shared]

    def encode(self, piece: bytes) -> list[int]:
        if (rank := self.ranks.get(piece)) is not None:
            return [rank]
        if len(self._arcs) > self.most:
            self._forget()
        out, state, arcs = [], 0, self._arcs
        for byte in piece:
            arc = arcs.get(state << 8 | byte)
            if arc is None:
                arc = arcs[state << 8 | byte] = self._arc(state, byte)
            state, emitted = arc
            if emitted:
                out += emitted
        out += self._states[state][1][-1][1]
        return out


def _utf8_step(state: int, byte: int) -> int:
    """States: 0 whole; 1, 2, 3 so many continuation bytes are due; 4 to 7 the same
    but with a narrower next byte (after E0, ED, F0, F4); -1 not UTF-8."""
    low, high, due = {0: (0, 0x7F, 0), 1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2), -1: (1, 0, 0)}[state]
    if low <= byte <= high:
        return due
    if state == 0:
        if 0xC2 <= byte <= 0xDF:
            return 1
        if 0xE0 <= byte <= 0xEF:
            return {0xE0: 4, 0xED: 5}.get(byte, 2)
        if 0xF0 <= byte <= 0xF4:
            return {0xF0: 6, 0xF4: 7}.get(byte, 3)
    return -1


class StreamingDecoder:
    """Ids in, text out as soon as its characters are whole.  Bytes that are no UTF-8
    come out as U+FFFD."""

    def __init__(self, bytes_of: list[bytes]):
        self.bytes_of = bytes_of
        self._arcs: dict[tuple[int, int], tuple[int, int]] = {}
        #: Tokens of whole characters: the arc from state 0 to itself.
        self._whole = bytearray(self._arc(0, k) == (0, 0) for k in range(len(bytes_of)))
        self.reset()

    def reset(self) -> None:
        self.state, self._held = 0, b""

    def _arc(self, state: int, token: int) -> tuple[int, int]:
        """The state after a token, and how many of its bytes belong to an unfinished character."""
        open_bytes = -1
        data = self.bytes_of[token]
        if state == 0 and data.isascii():
            return 0, 0
        for k, byte in enumerate(data):
            state = _utf8_step(state, byte)
            if state <= 0:
                open_bytes = len(data) - k - 1
        return state, len(data) if open_bytes < 0 else open_bytes

    def feed(self, ids: Iterable[int]) -> str:
        out, whole, bytes_of = [], self._whole, self.bytes_of
        for token in ids:
            if self.state == 0 and whole[token]:
                out.append(bytes_of[token])
                continue
            arc = self._arcs.get((self.state, token))
            if arc is None:
                arc = self._arcs[self.state, token] = self._arc(max(self.state, 0), token)
            self.state, rest = arc
            data = bytes_of[token]
            if self.state == 0:
                out.append(self._held + data)
                self._held = b""
            else:
                out.append(self._held + data[: len(data) - rest] if rest < len(data) else b"")
                self._held = data[len(data) - rest :] if rest < len(data) else self._held + data
                if self.state < 0:
                    out[-1], self._held = out[-1] + self._held, b""
        return b"".join(out).decode("utf-8", "replace")

    def finish(self) -> str:
        held, self._held, self.state = self._held, b"", 0
        return held.decode("utf-8", "replace")


class Codec:
    """Whole texts: pieces by the pattern, each through the transducer.  The ids of
    space-delimited units are kept in a memo of two generations of ``most`` units."""

    def __init__(self, path: str, pattern: str, most: int = 500_000):
        import regex

        self.transducer = Transducer(read_ranks(path))
        self.bytes_of = [self.transducer.bytes_of.get(k, b"") for k in range(max(self.transducer.bytes_of) + 1)]
        self._find = regex.compile(pattern).findall
        self._memo: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._marks: dict[str, bytes] = {}
        self._most = most

    def _piece(self, piece: str) -> bytes:
        return array("I", self.transducer.encode(piece.encode())).tobytes()

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self._piece, self._find(text)))

    def _unit(self, unit: str) -> bytes:
        """With its space.  Letters, and a mark after letters, are pieces in any such pattern."""
        if (known := self._memo.get(unit)) is not None:
            return known
        if (known := self._older.get(unit)) is None:
            if unit.isalpha():
                known = self._piece(" " + unit)
            elif (mark := unit[-1:]) in ".,;:!?" and unit[:-1].isalpha():
                if mark not in self._marks:
                    self._marks[mark] = self._piece(mark)
                known = self._unit(unit[:-1]) + self._marks[mark]
            else:
                known = self._whole(" " + unit)
        if len(self._memo) >= self._most:
            self._older, self._memo = self._memo, {}
        self._memo[unit] = known
        return known

    def encode(self, text: str) -> bytes:
        from foliant.llm.tokens import by_itself

        if by_itself(text):
            return self._whole(text)
        first, space, rest = text.partition(" ")
        head = self._whole(first)
        if not space:
            return head
        units = rest.split(" ")
        parts = list(map(self._memo.get, units))
        if None in parts:
            parts = [self._unit(u) if p is None else p for u, p in zip(units, parts, strict=True)]
        return head + b"".join(parts)


    def decoder(self) -> StreamingDecoder:
        return StreamingDecoder(self.bytes_of)


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _round_trip(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        decoder = own.decoder()
        for batch in batches:
            n_tokens, ids_sha, back_sha, whole = [], [], [], []
            for text in batch.column("text").to_pylist():
                raw, back = own.encode(text), hashlib.sha256()
                ids = memoryview(raw).cast("I")
                decoder.reset()
                for first in range(0, len(ids), FED):
                    back.update(decoder.feed(ids[first : first + FED]).encode())
                back.update(decoder.finish().encode())
                n_tokens.append(len(ids))
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                back_sha.append(back.hexdigest())
                whole.append(back.digest() == hashlib.sha256(text.encode()).digest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(ids_sha), pa.array(back_sha), pa.array(whole)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    return run


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip: one row a document."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_round_trip(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def encode_column(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its ids."""

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            ids = [list(memoryview(own.encode(t)).cast("I")) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<long>")


def decode_column(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the text of its ids, through the streaming decoder."""

    def run(batches):
        own = codec(path, pattern)
        decoder = own.decoder()
        for batch in batches:
            texts = []
            for ids in batch.column("ids").to_pylist():
                decoder.reset()
                texts.append(decoder.feed(ids or ()) + decoder.finish())
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
