"""Token packing: sum-of-squares online placement into fixed-length training sequences.

Documents arrive one by one. Every open window is known only by its fill level, and ``count[h]``
is the number of windows filled to ``h``. A piece of ``a`` tokens goes to the level ``h`` (0 opens
a new window) for which the sum of ``count[h] ** 2`` over the partly filled levels comes out
least, which keeps the levels diverse so that later pieces find a gap of their size. Windows
that fill up leave at once. A task that holds more open windows than it may closes the fullest one
by a cut of the emptiest, and goes on. What is open at the end of a task is cut and joined, so
that a task leaves only windows whose length is a power of two, which need no padding.

Each task packs its own input on its own: no shuffle, memory bounded by the windows that can be
open at once, and a lost task is simply run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
END_ID = 1
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_tokens long"
)
#: Characters of text that a task encodes at once.
BLOCK_CHARS = 8_000_000
#: Open windows a task may hold (at most ``4 * window`` bytes each).
MAX_OPEN = 8192
SPECIAL = "<|endoftext|>"
_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class Encoder:
    """Ids of the byte-level BPE tokenizer in the file ``path``, for blocks of texts.

    A word with the one blank before it always begins a token, so each distinct word of a block
    is encoded once and its ids are gathered for every place it stands at. Texts where that
    doesn't hold (a run of white space with a blank inside it) or which spell the special token
    go through the tokenizer as a whole.
    """

    def __init__(self, path: str) -> None:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = sorted(set(range(256)) - set(visible))
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token != SPECIAL}
        self.token_bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.token_bytes[i] = len(token)
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.words = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (none for a null)."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring(texts, SPECIAL), pc.match_substring_regex(texts, f"{_BLANK} {_BLANK}"))
        found = self._by_words(pc.if_else(odd, "", texts))
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            found[k] = np.asarray(self.whole.encode(texts[k].as_py(), add_special_tokens=False).ids, dtype="<u4")
        return found

    def _by_words(self, texts: pa.Array) -> list[np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = lists.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        alone = pc.match_substring_regex(words, f"^$|^{_BLANK}|{_BLANK}$").to_numpy(zero_copy_only=False)
        pool, length = self._joined(words.filter(pa.array(~alone)))
        lengths = np.zeros(len(words), dtype=np.int64)
        lengths[~alone] = length
        starts = np.zeros(len(words), dtype=np.int64)
        starts[~alone] = np.cumsum(length) - length
        pools, size = [pool], len(pool)
        # A text's first word has no blank before it; words that begin or end with white space stand alone.
        firsts = words.take(coded.indices.take(pa.array(offsets[:-1]))).to_pylist()
        more_starts, more_lengths = [], []
        for word in firsts:
            ids = self.words.encode_to_numpy(word) if word else pool[:0]
            pools.append(ids)
            more_starts.append(size)
            more_lengths.append(len(ids))
            size += len(ids)
        for k in np.flatnonzero(alone):
            ids = self.words.encode_to_numpy(" " + words[k].as_py())
            pools.append(ids)
            starts[k], lengths[k] = size, len(ids)
            size += len(ids)
        at[offsets[:-1]] = len(words) + np.arange(len(firsts))
        starts = np.concatenate([starts, np.asarray(more_starts, dtype=np.int64)])
        lengths = np.concatenate([lengths, np.asarray(more_lengths, dtype=np.int64)])
        each = lengths[at]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = np.concatenate(pools)[np.repeat(starts[at] - ends[:-1], each) + np.arange(ends[-1])].astype("<u4", copy=False)
        return np.split(ids, ends[offsets[1:-1]])

    def _joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with a blank before each, and how many each has."""
        if not len(words):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        ids = self.words.encode_to_numpy(" " + " ".join(words.to_pylist()))
        ends = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
        last = np.searchsorted(np.cumsum(self.token_bytes[ids]), ends) + 1
        return ids, np.diff(last, prepend=0)


class SumOfSquares:
    """Level array of the partly filled windows: chooses where each piece goes."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)

    def choose(self, size: int) -> int:
        """Level to place ``size`` on; ties go to the fullest, 0 opens a window."""
        levels = np.flatnonzero(self.count[: self.window - size + 1])
        after = self.count[levels + size] if len(levels) else self.count[:0]
        gain = 2 * after + 1
        gain[levels + size == self.window] = 0
        gain = gain - 2 * self.count[levels] + 1
        opening = 0 if size == self.window else 2 * int(self.count[size]) + 1
        best, level = opening, 0
        if len(levels):
            at = len(gain) - 1 - int(np.argmin(gain[::-1]))
            if gain[at] <= best:
                best, level = int(gain[at]), int(levels[at])
        return level

    def place(self, size: int) -> int:
        level = self.choose(size)
        if level:
            self.count[level] -= 1
        if level + size < self.window:
            self.count[level + size] += 1
        return level


class Packer:
    """Packs the documents of one task; yields finished pieces as tuples of :data:`SCHEMA`."""

    def __init__(self, first_id: int, window: int = WINDOW, max_open: int = MAX_OPEN) -> None:
        self.window, self.next_id, self.max_open = window, first_id, max(1, max_open)
        self.levels = SumOfSquares(window)
        self.open: dict[int, list[list[tuple]]] = {}  # level -> windows, each a list of pieces
        self.n_open = 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        total = len(ids) // 4
        full = total - total % self.window
        for start in range(0, full, self.window):
            self._emit([(doc_id, start, total, ids[4 * start : 4 * (start + self.window)])])
        if total > full:
            self._place((doc_id, full, total, ids[4 * full :]))

    def _place(self, piece: tuple) -> None:
        size = len(piece[3]) // 4
        level = self.levels.place(size)
        if level:
            pieces = self.open[level].pop()
        else:
            pieces, self.n_open = [], self.n_open + 1
        pieces.append(piece)
        if level + size == self.window:
            self.n_open -= 1
            self._emit(pieces)
        else:
            self.open.setdefault(level + size, []).append(pieces)
        if self.n_open > self.max_open:
            self._close_fullest()

    def _take(self, level: int) -> list[tuple]:
        """Take a window of that level out of what is open."""
        self.levels.count[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _hold(self, pieces: list[tuple]) -> None:
        level = sum(len(p[3]) for p in pieces) // 4
        self.levels.count[level] += 1
        self.n_open += 1
        self.open.setdefault(level, []).append(pieces)

    def _close_fullest(self) -> None:
        """Fill the fullest window from the emptiest others, of which the last one is cut."""
        held = np.flatnonzero(self.levels.count)
        full = int(held[-1])
        pieces, room = self._take(full), self.window - full
        while room:
            rest = []
            for doc_id, start, total, ids in self._take(int(np.flatnonzero(self.levels.count)[0])):
                take = min(room, len(ids) // 4)
                if take:
                    pieces.append((doc_id, start, total, ids[: 4 * take]))
                    room -= take
                if 4 * take < len(ids):
                    rest.append((doc_id, start + take, total, ids[4 * take :]))
            if rest:
                self._hold(rest)
            if room and not self.n_open:
                return self._hold(pieces)
        self._emit(pieces)

    def _emit(self, pieces: list) -> None:
        length = sum(len(p[3]) for p in pieces) // 4
        at = 0
        for doc_id, start, total, ids in pieces:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, zlib.crc32(ids), total, self.next_id, at, length))
            at += n
        self.next_id += 1

    def close(self) -> None:
        """Join the open windows from the fullest, cutting pieces to fit; the rest leaves as powers of two."""
        windows = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open, self.n_open = {}, 0
        self.levels.count[:] = 0
        queue = [p for w in windows for p in w]
        left = sum(len(p[3]) for p in queue) // 4
        room = min(self.window, 1 << left.bit_length() - 1) if left else 0
        current: list[tuple] = []
        for piece in queue:
            doc_id, start, total, ids = piece
            while ids:
                take = min(room, len(ids) // 4)
                current.append((doc_id, start, total, ids[: 4 * take]))
                start, ids, room, left = start + take, ids[4 * take :], room - take, left - take
                if not room:
                    self._emit(current)
                    current = []
                    room = min(self.window, 1 << left.bit_length() - 1) if left else 0

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens.

    One row per piece: ``doc_id``, ``start`` (its document's tokens before it), ``length``,
    ``ids_crc32`` (CRC-32 of its ids as little-endian unsigned 32-bit), ``doc_tokens`` (with the
    end id), ``sequence_id``, ``offset`` and ``sequence_tokens`` (length of its sequence: ``window``
    or a power of two, so nothing is padded). Null and empty texts are the end id alone. A null
    ``doc_id`` stays null; repeated rows are packed once each. Very long texts become whole
    windows and a rest. Other columns of the input are ignored; an empty input gives no rows.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    end = np.asarray([END_ID], dtype="<u4").tobytes()
    schema = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = Encoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 40, window)
        for batch in batches:
            for ids, texts in _blocks(batch):
                for doc_id, found in zip(ids.to_pylist(), encode(texts), strict=True):
                    packer.add(doc_id, found.tobytes() + end)
                yield _rows(packer.take(), schema)
        packer.close()
        yield _rows(packer.take(), schema)

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(task, SCHEMA)


def _rows(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], schema=schema)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Slices of about :data:`BLOCK_CHARS` bytes of text; a longer text is one slice."""
    texts = batch.column(1)
    block = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)) // BLOCK_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.column(0).slice(a, b - a), texts.slice(a, b - a)
