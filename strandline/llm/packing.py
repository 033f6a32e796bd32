"""Packing documents into token sequences of a fixed length.

Documents become token ids with an end token; only those longer than a
sequence are cut. Pieces are packed by best fit, largest first, and then
improved by a local search between underfull sequences.

Pieces that fill a sequence need no search. The others are dealt by a hash
into groups of a fixed expected size, each packed by one task, so memory does
not grow with the corpus and at most about one sequence a group is lost
against packing all at once.

Defined results: a null text is an empty one, which has the end token alone.
Rows with equal ids, or without one, are separate documents. Columns other than
``doc_id`` and ``text`` are ignored. An empty table gives an empty result. A
text of any length is cut into as many pieces as it takes; pieces of equal
length may change places with each other, and all of them have one.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.storage import written


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@dataclass(frozen=True)
class PackingConfig:
    length: int = 1024
    end_id: int = 2
    #: A file of a byte-level BPE tokenizer, at the same place on every executor; None is the public 50k one.
    tokenizer: str | None = None
    #: Pieces that one task packs, about.
    group_rows: int = 8192
    #: Passes of the local search over the underfull sequences.
    most_passes: int = 8


# The public pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a visible character: itself, or in order the next from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, by a file of the tokenizers library.

    In byte-level BPE whose ids follow the order of its merges, the ids alone
    are the merge ranks, which tiktoken applies to the same pre-tokens several
    times as fast. Other files, and texts with a special token's string, are
    left to tokenizers.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.quick = self._quick(json.loads(self.tokenizer.to_str()))

    def _quick(self, file: dict):
        import tiktoken

        model, split = file["model"], file.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not file.get("normalizer")
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in self.special}
        made = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model.get("merges", [])]
        single = sum(len(t) == 1 for t in vocabulary)
        if not plain or made != list(range(single, single + len(made))):
            return None
        of = byte_of_character()
        ranks = {bytes(of[c] for c in t): i for t, i in vocabulary.items()}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.quick is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, which Spark uses for task after task: it is loaded once."""
    return Encoder(path)


PIECE = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(config: PackingConfig):
    path = config.tokenizer or default_tokenizer()
    end = np.array([config.end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        names = [c.split()[0] for c in PIECE.split(", ")]
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                ids = own.encode(text or "") + end
                size, start, piece = len(ids) // 4, 0, 0
                stop = size % config.length or config.length
                while start < size:
                    crc = zlib.crc32(ids[4 * start : 4 * stop])
                    for column, value in zip(columns, (row, doc_id, piece, start, stop - start, crc), strict=True):
                        column.append(value)
                    start, stop, piece = stop, stop + config.length, piece + 1
            types = [pa.int32() if n == "piece" else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return pieces


def pieces(docs: DataFrame, config: PackingConfig = PackingConfig()) -> DataFrame:
    """``row, doc_id, piece, start, length, ids_crc32`` for each piece; ``row`` tells documents apart."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_cut(config), PIECE)


class Bins:
    """Items in bins of one capacity."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bin_of = np.full(len(sizes), -1)
        self.fill = np.zeros(len(sizes), dtype=np.int64)
        self.best_fit()

    def best_fit(self) -> None:
        """Largest first, each into the fullest bin that has room."""
        room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        used = 0
        # Bit g is set where a bin has room g: the lowest set bit from an item's size on is the best fit.
        open_rooms = 0
        for item in np.argsort(-self.sizes, kind="stable").tolist():
            size = int(self.sizes[item])
            fits = open_rooms >> size
            if fits:
                gap = size + (fits & -fits).bit_length() - 1
                b = room[gap].pop()
                if not room[gap]:
                    open_rooms &= ~(1 << gap)
            else:
                b, gap, used = used, self.capacity, used + 1
            self.bin_of[item] = b
            self.fill[b] += size
            room[gap - size].append(b)
            open_rooms |= 1 << (gap - size)
        self.fill = self.fill[:used]

    def improve(self, passes: int) -> None:
        """Exchange items between underfull bins as long as the sum of squared fills grows.

        Items leave the emptier bins: one moves into a gap, or is exchanged for
        a smaller one, or for two smaller ones, or two for a larger one. A bin
        that has given all its items away is gone.
        """
        for _ in range(passes):
            under = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
            if len(under) < 2:
                break
            inside = np.isin(self.bin_of, under)
            items = np.flatnonzero(inside)
            changed = False
            by_bin: dict[int, set[int]] = {}
            for i in items.tolist():
                by_bin.setdefault(int(self.bin_of[i]), set()).add(i)
            pool = _Pool(self, items)
            for source in sorted(by_bin, key=lambda b: int(self.fill[b])):
                while self.fill[source] and self._step(source, by_bin, pool):
                    changed = True
            if not changed:
                break

    def _apply(self, source: int, target: int, give: list[int], take: list[int], by_bin: dict, pool: _Pool) -> bool:
        for i, b in [(i, target) for i in give] + [(i, source) for i in take]:
            by_bin[int(self.bin_of[i])].discard(i)
            by_bin[b].add(i)
            self.bin_of[i] = b
        moved = int(self.sizes[give].sum() - self.sizes[take].sum())
        self.fill[source] -= moved
        self.fill[target] += moved
        pool.refresh(give + take, by_bin[source] | by_bin[target])
        return True

    def _step(self, source: int, by_bin: dict, pool: _Pool) -> bool:
        """One exchange that leaves less in ``source`` and makes some bin fuller than ``source`` was."""
        own = sorted(by_bin[source], key=lambda i: -int(self.sizes[i]))
        gives = [[i] for i in own] + [[i, j] for k, i in enumerate(own) for j in own[k + 1 :]][:12]
        floor = int(self.fill[source])
        for give in gives:
            if len(give) == 1 and (target := pool.gap_for(int(self.sizes[give[0]]), source, floor)) is not None:
                return self._apply(source, target, give, [], by_bin, pool)
        for give in gives:
            out = int(self.sizes[give].sum())
            if (item := pool.one_for(out, source, floor)) is not None:
                return self._apply(source, int(self.bin_of[item]), give, [item], by_bin, pool)
        for give in gives[: len(own)]:
            out = int(self.sizes[give[0]])
            if (pair := pool.two_for(out, source, floor)) is not None:
                return self._apply(source, int(self.bin_of[pair[0]]), give, pair, by_bin, pool)
        return False


class _Pool:
    """The items of underfull bins as arrays, with the gaps of their bins beside them."""

    def __init__(self, bins: Bins, items: np.ndarray):
        self.bins, self.items = bins, items
        self.place = {int(i): k for k, i in enumerate(items)}
        self.size = bins.sizes[items]
        self.bin = bins.bin_of[items].copy()
        self.gap = bins.capacity - bins.fill[self.bin]
        order = np.argsort(self.bin, kind="stable")
        same = self.bin[order][1:] == self.bin[order][:-1]
        #: Neighbours in a bin, as candidates for two at once.
        self.first, self.second = order[:-1][same], order[1:][same]

    def refresh(self, moved: list[int], touched: set[int]) -> None:
        for i in moved:
            self.bin[self.place[i]] = self.bins.bin_of[i]
        at = [self.place[i] for i in touched]
        self.gap[at] = self.bins.capacity - self.bins.fill[self.bin[at]]

    def _best(self, gain: np.ndarray, gap: np.ndarray, bin_: np.ndarray, source: int, floor: int) -> int | None:
        """The place where the least gap is left, if any place is allowed."""
        left = gap - gain
        allowed = (gain > 0) & (left >= 0) & (bin_ != source) & (self.bins.capacity - left > floor)
        at = np.flatnonzero(allowed)
        return int(at[np.argmin(left[at])]) if len(at) else None

    def gap_for(self, out: int, source: int, floor: int) -> int | None:
        k = self._best(np.full(len(self.gap), out), self.gap, self.bin, source, floor)
        return None if k is None else int(self.bin[k])

    def one_for(self, out: int, source: int, floor: int) -> int | None:
        k = self._best(out - self.size, self.gap, self.bin, source, floor)
        return None if k is None else int(self.items[k])

    def two_for(self, out: int, source: int, floor: int) -> list[int] | None:
        together = self.bin[self.first] == self.bin[self.second]
        a, b = self.first[together], self.second[together]
        k = self._best(out - self.size[a] - self.size[b], self.gap[a], self.bin[a], source, floor)
        return None if k is None else [int(self.items[a[k]]), int(self.items[b[k]])]


def pack_sizes(sizes: np.ndarray, capacity: int, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each size its bin, numbered from 0 without gaps, and its offset there."""
    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bins = Bins(np.asarray(sizes, dtype=np.int64), capacity)
    bins.improve(passes)
    number = np.unique(bins.bin_of, return_inverse=True)[1]
    order = np.argsort(number, kind="stable")
    before = np.cumsum(bins.sizes[order]) - bins.sizes[order]
    first = np.r_[True, np.diff(number[order]) > 0]
    offset = np.empty(len(order), dtype=np.int64)
    offset[order] = before - before[first][np.cumsum(first) - 1]
    return number, offset


def _pack_group(config: PackingConfig):
    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("row", "ascending"), ("piece", "ascending")])
        number, offset = pack_sizes(rows["length"].to_numpy(), config.length, config.most_passes)
        rows = rows.drop_columns(["part"])
        # Groups number their sequences apart, and apart from the full pieces, which have odd numbers.
        sequence = ((key[0].as_py() << 32) + number) * 2
        return rows.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return pack


def pack(docs: DataFrame, config: PackingConfig = PackingConfig()) -> DataFrame:
    """``row, doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for each piece of each row of ``docs``."""
    cut = written(pieces(docs, config))
    whole = cut.where(F.col("length") == config.length)
    part = cut.where(F.col("length") < config.length)
    groups = max(1, round(part.count() / config.group_rows))
    dealt = part.withColumn("part", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    packed = dealt.groupBy("part").applyInArrow(_pack_group(config), f"{PIECE}, sequence_id long, offset long")
    alone = F.monotonically_increasing_id() * 2 + 1
    return packed.unionByName(whole.withColumns({"sequence_id": alone, "offset": F.lit(0).cast("long")}))
