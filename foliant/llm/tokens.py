"""Exact tokenizer ids of whole texts, a space-delimited unit at a time.

No pre-tokenizer used here ever matches across a single space that has other
characters on both sides, so a text's ids are the ids of its units in a row, and
units repeat.  A batch of texts is cut into units, these are numbered, and the ids of
all are gathered in a few vector steps; only units that a worker has not met yet
(within a memo of bounded size) go through the tokenizer.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import time
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

_BY_ITSELF = re.compile(r"^\s|\s$|\s\s")
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def by_itself(text: str) -> bool:
    """Whether white space stands at an end or twice in a row."""
    if any(c in text for c in _OTHER_SPACE):
        return _BY_ITSELF.search(text) is not None
    return text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or any(pair in text for pair in ("  ", " \n", "\n ", "\n\n"))


#: Symbols of ASCII that close a unit; not the apostrophe, which can begin a token of letters.
_SYMBOLS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _strings(column: pa.Array) -> list[str]:
    """As Python strings; several times as fast as ``to_pylist``."""
    return column.to_numpy(zero_copy_only=False).tolist()


#: Characters that are cut into units at a time, and those that the library is given at a time:
#: what it returns has a hundred bytes a token, all there until the last is read.
AT_ONCE, ASK_AT_ONCE = 4 << 20, 1 << 17


def parts_of(texts: list[str], most: int) -> list[list[str]]:
    """Texts in a row, of ``most`` characters in all or a single text; an empty one counts as a character."""
    parts, held = [], 0
    for text in texts:
        if not parts or held + len(text) > most:
            parts.append([])
            held = 0
        parts[-1].append(text)
        held += len(text) or 1
    return parts


class IdLists:
    """Lists of ids one after the other, found by number."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self._ids, self._starts, self._lengths = np.empty(1 << 16, np.uint32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.used, self.count = 0, 0

    def cut_to(self, count: int, used: int) -> None:
        self.count, self.used = count, used

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers of new lists, given together."""
        while self.used + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.empty_like(self._ids)])
        while self.count + len(lengths) > len(self._starts):
            self._starts, self._lengths = (np.concatenate([x, np.empty_like(x)]) for x in (self._starts, self._lengths))
        own = slice(self.count, self.count + len(lengths))
        self._ids[self.used : self.used + len(ids)] = ids
        self._starts[own], self._lengths[own] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used, self.count = self.used + len(ids), self.count + len(lengths)
        return np.arange(own.start, own.stop)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of lists in a row, and where each list ends."""
        lengths = self._lengths[numbers]
        ends = np.cumsum(lengths)
        at = np.repeat(self._starts[numbers] - ends + lengths, lengths)
        at += np.arange(len(at))
        return self._ids[at], ends


class UnitEncoder:
    """``encode_batch(texts)``: the ids of all texts in a row, and where each text ends.

    keeps_space: the tokenizer joins a leading space to the word that follows;
    then texts with white space at an end or twice in a row are encoded whole, and
    a line's first unit is one with its line end (others drop line ends and put all in
    lower case: ASCII letters can be so before texts are cut).  Texts that hold an added
    token such as <|endoftext|> are encoded whole too.
    A unit of letters and closing symbols is put together from the two, which
    every pattern in use splits there.  Units of letters that are not known yet are
    encoded a few hundred at a time, in one text, and told apart by the tokens that
    begin (or end) a word.  The memo has up to ``most`` units and then begins anew.
    """

    def __init__(self, path: str, keeps_space: bool, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._keeps_space, self._most = keeps_space, most
        self._added = [t.content.lower() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._marks = {re.match(r"\W*", c)[0] for c in self._added}
        self._memo: dict[str, int] = {}
        self._lists = IdLists()
        tokens = [self._tokenizer.id_to_token(k) or "" for k in range(self._tokenizer.get_vocab_size())]
        self._line_end = np.array([t == "Ċ" for t in tokens])
        self._edge = np.array([t.startswith("Ġ") if keeps_space else t.endswith("</w>") for t in tokens])

    def _ask(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row, and how many each has."""
        ids, lengths = array("I"), []
        for part in parts_of(texts, ASK_AT_ONCE):
            for e in self._tokenizer.encode_batch_fast(part, add_special_tokens=False):
                own = e.ids
                ids.extend(own)
                lengths.append(len(own))
        return np.array(ids, np.uint32), np.array(lengths, np.int64)

    def _ask_joined(self, texts: list[str], between: str, edge: np.ndarray, at_once: int = 200) -> tuple[np.ndarray, np.ndarray]:
        """The same of short texts, encoded many at a time where the edges show which are whose."""
        parts = [texts[k : k + at_once] for k in range(0, len(texts), at_once)]
        all_ids, lengths = self._ask([between.join(p) for p in parts])
        out_ids, out_lengths, at = [], [], 0
        for part, n in zip(parts, lengths.tolist(), strict=True):
            ids = all_ids[at : at + n]
            at += n
            edges = np.flatnonzero(edge[ids])
            bounds = np.append(edges, n) if self._keeps_space else np.concatenate([[0], edges + 1])
            if len(edges) == len(part) and bounds[0] == 0 and bounds[-1] == n:
                own = np.diff(bounds)
            else:
                ids, own = self._ask(part)
            out_ids.append(ids)
            out_lengths.append(own)
        return (np.concatenate(out_ids), np.concatenate(out_lengths)) if parts else (np.empty(0, np.uint32), np.empty(0, np.int64))

    def _holds_added(self, text: str) -> bool:
        """Whether an added token stands in the text, in any case: in lower case it would read as one."""
        return any(m in text for m in self._marks) and any(c in text.lower() for c in self._added)

    def _keep(self, units: list[str], found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        numbers = self._lists.add(*found)
        self._memo.update(zip(units, numbers.tolist(), strict=True))
        return numbers

    def _cores(self, cores: pa.StringArray, ask) -> np.ndarray:
        """Numbers of units of letters, of which some may repeat or be known."""
        kinds = cores.dictionary_encode()
        names = _strings(kinds.dictionary)
        found = np.fromiter(map(self._memo.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(found < 0)
        if len(new):
            words = [names[k] for k in new.tolist()]
            found[new] = self._keep(words, ask(words))
        return found[kinds.indices.to_numpy()]

    def _learn(self, units: pa.StringArray) -> np.ndarray:
        """Numbers of units that the memo does not have, each once."""
        line = pc.starts_with(units, "\n") if self._keeps_space else pa.repeat(False, len(units))
        core = pc.utf8_rtrim(units, _SYMBOLS)
        letters = pc.if_else(line, pc.utf8_slice_codeunits(core, 1), core)
        is_word = pc.utf8_is_alpha(letters).to_numpy(zero_copy_only=False).copy()
        other = pc.invert(pc.string_is_ascii(letters)).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(is_word & other).tolist():  # lower case can add marks
            is_word[k] = letters[k].as_py().lower().isalpha()
        begins = line.to_numpy(zero_copy_only=False)
        numbers = np.empty(len(units), np.int64)
        # units of letters, each with its leading space if that is kept
        spaced = (lambda w: self._ask_joined([f" {x}" for x in w], "", self._edge)) if self._keeps_space else (lambda w: self._ask_joined(w, " ", self._edge))
        for own, ask in ((is_word & ~begins, spaced), (is_word & begins, lambda w: self._ask_joined(w, "", self._line_end))):
            numbers[own] = self._cores(core.filter(pa.array(own)), ask)
        rest = _strings(units.filter(pa.array(~is_word)))
        numbers[~is_word] = self._keep(rest, self._ask([f" {u}" if self._keeps_space and u[:1] != "\n" else u for u in rest]))
        closed = is_word & pc.not_equal(pc.binary_length(units), pc.binary_length(core)).to_numpy(zero_copy_only=False)
        if closed.any():
            names = _strings(units.filter(pa.array(closed)))
            bare = pc.utf8_length(core.filter(pa.array(closed))).to_pylist()
            marks = pa.array([u[n:] for u, n in zip(names, bare, strict=True)], pa.string()).dictionary_encode()
            count, used = self._lists.count, self._lists.used
            tails = self._lists.add(*self._ask(_strings(marks.dictionary)))
            ids, ends = self._lists.gather(np.column_stack([numbers[closed], tails[marks.indices.to_numpy()]]).ravel())
            self._lists.cut_to(count, used)
            numbers[closed] = self._keep(names, (ids, np.diff(ends[1::2], prepend=0)))
        return numbers

    def _numbers(self, units: pa.StringArray) -> np.ndarray:
        names = _strings(units)
        found = np.fromiter(map(self._memo.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(found < 0)
        if len(new):
            if len(self._memo) + len(new) > self._most:
                self._memo.clear()
                self._lists.clear()
                new = np.arange(len(names))
            found[new] = self._learn(units.take(pa.array(new)))
        return found

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A few million characters at a time (one text at least), which bounds what is held besides the ids."""
        found = [self._encode_part(p) for p in parts_of(texts, AT_ONCE) or [[]]]
        before = np.cumsum([0, *(len(ids) for ids, _ in found[:-1])]).tolist()
        return np.concatenate([ids for ids, _ in found]), np.concatenate([ends + n for (_, ends), n in zip(found, before, strict=True)])

    def _encode_part(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        alone = [k for k, t in enumerate(texts) if (self._keeps_space and by_itself(t)) or self._holds_added(t)]
        cut = list(texts)
        for k in alone:
            cut[k] = ""
        column = pa.array(cut, pa.string())
        column = pc.replace_substring(column, "\n", " \n") if self._keeps_space else pc.replace_substring(pc.ascii_lower(column), "\n", " ")
        lists = pc.split_pattern(column, " ")
        units = lists.flatten().dictionary_encode()
        numbers = self._numbers(units.dictionary)[units.indices.to_numpy()]
        offsets = lists.offsets.to_numpy()
        count, used = self._lists.count, self._lists.used
        if self._keeps_space:  # a text's first unit has no space before it
            numbers[offsets[:-1]] = self._lists.add(*self._ask([units.dictionary[k].as_py() for k in units.indices.to_numpy()[offsets[:-1]].tolist()]))
        ids, ends = self._lists.gather(numbers)
        self._lists.cut_to(count, used)
        ends = ends[offsets[1:] - 1]
        if alone:
            own, lengths = self._ask([texts[k] for k in alone])
            parts, own = np.split(ids, ends[:-1]), np.split(own, np.cumsum(lengths)[:-1])
            for k, x in zip(alone, own, strict=True):
                parts[k] = x
            ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return ids, ends

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Of each text, its ids as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode_batch(texts)
        return [x.astype("<u4").tobytes() for x in np.split(ids, ends[:-1])] if texts else []

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def _allocator(name: str, *values: int) -> None:
    """A call of glibc's allocator; none where another library is in its place."""
    call = getattr(ctypes.CDLL(None), name, None)
    if call:
        call(*values)


def trim() -> None:
    """Gives memory that nothing uses any more back to the system."""
    pa.default_memory_pool().release_unused()
    _allocator("malloc_trim", 0)


#: Bytes from which an allocation is mapped by itself and unmapped when freed, for good: by default glibc
#: raises this to 32 MB as it goes, and what is free between smaller pieces stays. -3 names this setting.
_MMAP_THRESHOLD, MAPPED = -3, 1 << 20


#: Batches put together after which a worker trims its memory.
TRIM_EVERY = 4


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches put together until their texts have about ``most`` bytes: units that repeat are looked up once.
    What the steps in between leave unused is given back now and then, and at the end."""
    own, held, given = [], 0, 0
    for batch in batches:
        own.append(batch)
        held += batch.column(column).nbytes
        if held >= most:
            yield pa.concat_batches(own)
            own, held, given = [], 0, given + 1
            if given % TRIM_EVERY == 0:
                trim()
    if own:
        yield pa.concat_batches(own)
    own = batch = None
    trim()


@cache
def encoder(path: str, keeps_space: bool) -> UnitEncoder:
    """One per worker process, kept over its tasks.  Arrow shares C's allocator there: two
    allocators each keep what the other could use."""
    _allocator("mallopt", _MMAP_THRESHOLD, MAPPED)
    pa.set_memory_pool(pa.system_memory_pool())
    return UnitEncoder(path, keeps_space)


def forget() -> None:
    """Gives back what encoders hold in this worker: later steps of a job need the room."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()
    trim()


def forget_everywhere(spark: SparkSession) -> None:
    """Idle workers forget too: what follows in the JVMs of a job needs the room of their encoders.

    Short tasks, several a core, so that each worker gets some; one that gets none keeps its encoder.
    """
    n = 4 * spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        time.sleep(0.1)
        yield from batches

    spark.range(0, n, 1, n).mapInArrow(run, "id long").write.format("noop").mode("overwrite").save()


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
