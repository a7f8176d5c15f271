"""Token ids of whole texts, with the pieces of text that recur encoded once for each worker."""

from __future__ import annotations

import ctypes
import os
import re
from array import array
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigtables.llm.common import slices, small_batches

#: The tokenizer's pattern always ends a piece between a letter or number and a symbol, so a word and what follows it are known each by itself.
STOP = r"([\pL\pN])([!-/:-@\[-`{-~])"
#: Two line ends between characters that are not white space (or are too rare to ask).
TWO_ENDS = r"([^\pZ\x00-\x20\x7f-\xa0])\n\n([^\pZ\x00-\x20\x7f-\xa0])"
TWO = "\x01"
#: A piece that others can follow after a line end and still get its own ids: no white space but one space at its beginning.
PLAIN = re.compile(r" ?\S+").fullmatch
#: A piece that the tokenizer's pattern takes as one, which its model alone can cut up; how its alphabet of bytes writes a space.
LETTERS, SPACE = re.compile(r" ?[A-Za-z]+").fullmatch, "\u0120"
#: Most pieces that a worker remembers (about 200 bytes each), beyond which it forgets all that few texts had; bytes of text that are split at a time.
MOST, AT_A_TIME = 400_000, 1 << 22
LINE_END, END = 198, 0
#: In place of a piece: its text goes to the tokenizer whole; not met yet.
WHOLE, NEW = -1, -2


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def id_kind(vocabulary: int) -> str:
    """Ids are kept in 16 bits where the vocabulary allows, else in 32."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def flat(column: pa.Array, kind: str) -> np.ndarray:
    """All values of a binary column without nulls in a row, as numbers; nothing is copied."""
    if not len(column):
        return np.zeros(0, kind)
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if data is not None else np.zeros(0, kind)


def cut_up(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    """Numbers in a row as a binary column with so many numbers in each value."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    if ends[-1] >= 1 << 31:
        raise ValueError("one batch of texts has over 2 GB of ids")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


class Encoder:
    """Ids of texts as the tokenizer gives them for the whole text.

    The byte-level pattern ends a piece before a space, and around a line end or two, between two other
    characters. Texts are split there and each new piece is encoded once. Any other text (runs of white
    space, white space at an end, control strings) goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        plain = self.tokenizer.normalizer is None and isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and not self.tokenizer.pre_tokenizer.add_prefix_space
        self.model = self.tokenizer.model if plain else None
        self.kind = id_kind(self.tokenizer.get_vocab_size())
        self._start()

    def _start(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends, self.used = np.zeros(1 << 20, self.kind), np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32)
        self.count = 0
        self._remember(["\n", TWO], np.array([1, 2]), np.full(3, LINE_END, self.kind))

    def _forget(self) -> None:
        """Start afresh, with the pieces that several slices of text had since the last time; with none where they are over half of MOST."""
        often = [(p, k) for p, k in self.known.items() if k > 1 and self.used[k] > 1]
        pieces = [p for p, _ in often] if len(often) <= MOST // 2 else []
        sizes, ids = self._ids_of(np.array([k for _, k in often][: len(pieces)], np.int64))
        self._start()
        self._remember(pieces, sizes, ids)

    def _ids_of(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each place has, all ids in a row); WHOLE has none."""
        n = np.where(place < 0, 0, np.diff(self.ends[: self.count], prepend=0)[place])
        ends = np.cumsum(n)
        begin = np.where(place < 0, 0, self.ends[place] - n)
        at = np.repeat((begin - (ends - n)).astype(np.int32), n) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
        return n, self.ids[at]

    def _remember(self, pieces: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        begin = int(self.ends[self.count - 1]) if self.count else 0
        while begin + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + len(pieces) > len(self.ends):
            self.ends, self.used = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ends, self.used))
        self.ids[begin : begin + len(ids)] = ids
        self.ends[self.count : self.count + len(pieces)] = begin + np.cumsum(sizes)
        self.known.update(zip(pieces, range(self.count, self.count + len(pieces)), strict=True))
        self.count += len(pieces)

    def _learn(self, pieces: list[str]) -> None:
        """Words of ASCII letters go to the tokenizer's model; other pieces line by line into one text, and are told apart at the line ends."""
        fit = list(filter(PLAIN, pieces))
        if len(fit) < len(pieces):
            self.known.update(dict.fromkeys(set(pieces).difference(fit), WHOLE))
        if self.model is not None:
            words = list(filter(LETTERS, fit))
            ids, sizes = array("I"), array("q")
            for w in words:
                found = [t.id for t in self.model.tokenize(w.replace(" ", SPACE))]
                ids.extend(found)
                sizes.append(len(found))
            self._remember(words, np.array(sizes, np.int64), np.array(ids, self.kind))
            fit = [p for p in fit if not LETTERS(p)]
        groups = [fit[i : i + 200] for i in range(0, len(fit), 200)]
        for some, found in zip(groups, self.tokenizer.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, self.kind)
            ends = np.append((ids == LINE_END).nonzero()[0], len(ids))
            if len(ends) != len(some):
                raise ValueError("the tokenizer doesn't keep line ends apart")
            self._remember(some, np.diff(ends, prepend=-1) - 1, ids[ids != LINE_END])

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Where each piece is remembered, or WHOLE."""
        k = np.fromiter(map(self.known.get, pieces, repeat(NEW)), np.int64, len(pieces))
        at = (k == NEW).nonzero()[0]
        if len(at) and len(self.known) + len(at) > MOST:
            self._forget()
            k = np.fromiter(map(self.known.get, pieces, repeat(NEW)), np.int64, len(pieces))
            at = (k == NEW).nonzero()[0]
        if len(at):
            new = list(map(pieces.__getitem__, at.tolist()))
            self._learn(new)
            k[at] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        self.used[k[k >= 0]] += 1  # each piece is there once
        return k

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids in each text, all ids in a row); a null text is empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring_regex(texts, "[\\x00\\x01]"), pc.match_substring(texts, "<|"))
        marked = pc.if_else(odd, "", texts)
        if pc.any(pc.match_substring(marked, "\n\n")).as_py():
            marked = pc.replace_substring_regex(marked, TWO_ENDS, f"\\1\0{TWO}\0\\2")
        marked = pc.replace_substring_regex(marked, STOP, "\\1\0\\2")
        marked = pc.replace_substring(pc.replace_substring(marked, " ", "\0 "), "\n", "\0\n\0")
        split = pc.split_pattern(marked, "\0")
        pieces = split.flatten().dictionary_encode()
        place = self._places(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
        bounds = np.asarray(split.offsets) - (split.offsets[0].as_py() if len(split) else 0)
        empty = np.asarray(pc.equal(marked, ""))  # one piece that is nothing
        whole = np.asarray(odd) | (np.add.reduceat(place == WHOLE, bounds[:-1]) > 0 if len(place) else empty) & ~empty
        n, ids = self._ids_of(place)
        ends = np.cumsum(n)
        sizes = np.diff(np.concatenate([[0], ends])[bounds])
        if not whole.any():
            return sizes, ids
        ends, out, done = np.concatenate([[0], np.cumsum(sizes)]), [], 0
        for t in whole.nonzero()[0].tolist():
            found = self.tokenizer.encode(texts[t].as_py(), add_special_tokens=False).ids
            out += [ids[done : ends[t]], np.array(found, self.kind)]
            done, sizes[t] = ends[t + 1], len(found)
        return sizes, np.concatenate([*out, ids[done:]])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned integers of `kind`; null is empty."""
        return cut_up(*self.flat(pa.array(texts, pa.string()))).to_pylist()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, kept from task to task."""
    return Encoder(path)


def lighter() -> None:
    """Give back what earlier stages left in this Python worker, which Spark hands on from stage to stage: encoders, and free memory that is still held.

    For tasks that need no encoder, as they begin.
    """
    encoder.cache_clear()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def with_end(sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id after each text."""
    out = np.full(len(ids) + len(sizes), END, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
    return sizes + 1, out


def token_ids(docs: DataFrame, key: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, path: str | None = None) -> DataFrame:
    """(doc_id, [key], n_tokens, ids): ids are little-endian unsigned integers of id_kind(), id 0 at the end.

    A null text is empty and has the end id alone. `key` makes a long of each document from (sizes, all ids).
    """
    small_batches(docs.sparkSession)
    where = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(where)
        for b in (s for whole in batches for s in slices(whole, 1, AT_A_TIME)):
            sizes, ids = with_end(*e.flat(b.column(1)))
            keys = {"key": pa.array(key(sizes, ids), pa.int64())} if key else {}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0)} | keys | {"n_tokens": pa.array(sizes, pa.int64()), "ids": cut_up(sizes, ids)})
            pa.default_memory_pool().release_unused()

    out = "doc_id long, " + "key long, " * (key is not None) + "n_tokens long, ids binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, out)


def vocabulary_size(path: str | None = None) -> int:
    return encoder(path or tokenizer_path()).tokenizer.get_vocab_size()
