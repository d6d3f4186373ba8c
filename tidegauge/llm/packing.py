"""Texts into containers of a fixed number of tokens with as little unused space as possible.

Best-two-fit: a container is filled greedily with the largest item that fits; while space is left, its smallest item is
replaced by two unpacked ones that fill the space it leaves more tightly. Items are spread over partitions by hash and
packed there in blocks of a fixed number of items: only a partition's last containers stay loose.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge import model
from tidegauge.llm import tokens

_PIECE = "doc_id long, piece int, start int, n int, ids binary"
_CONTAINER = "container_id string, n_tokens int, n_items int, doc_ids array<long>, pieces array<int>, starts array<int>, lengths array<int>, token_ids array<int>"
_PIECE_FIELDS = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("ids", pa.binary())])
#: Bytes of token ids that a task holds before it hands them on.
_BATCH_BYTES = 8_000_000


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of item numbers. Sizes are 1 .. capacity; items of size 0 are left out. Deterministic."""
    stacks: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        if sizes[i]:
            stacks.setdefault(sizes[i], []).append(i)
    there = sum(1 << s for s in stacks)  # bit s: a size is among the unpacked
    mirror = sum(1 << (capacity - s) for s in stacks)  # bit capacity - s likewise

    def take(s: int) -> int:
        nonlocal there, mirror
        i = stacks[s].pop()
        if not stacks[s]:
            there ^= 1 << s
            mirror ^= 1 << (capacity - s)
        return i

    def put_back(s: int, i: int) -> None:
        nonlocal there, mirror
        if not stacks.setdefault(s, []):
            there |= 1 << s
            mirror |= 1 << (capacity - s)
        stacks[s].append(i)

    def pair(low: int, high: int) -> tuple[int, int] | None:
        """Two unpacked sizes with the largest sum in (low, high]."""
        for total in range(high, low, -1):
            x = there & (mirror >> (capacity - total)) & ((1 << total) - 1)
            if total % 2 == 0 and x >> (total // 2) & 1 and len(stacks[total // 2]) < 2:
                x ^= 1 << (total // 2)
            if x:
                a = x.bit_length() - 1
                return a, total - a
        return None

    out = []
    while there:
        held, space = [], capacity
        while fits := there & ((1 << (space + 1)) - 1):
            s = fits.bit_length() - 1
            held.append((s, take(s)))
            space -= s
        while space and there:
            s, i = min(held)
            if not (two := pair(s, s + space)):
                break
            held.remove((s, i))
            held += [(t, take(t)) for t in two]
            put_back(s, i)
            space += s - sum(two)
        out.append([i for _, i in held])
    return out


def _pieces(capacity: int, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {f.name: [] for f in _PIECE_FIELDS}
        held = 0
        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"]):
                ids = tokens.encode(text.as_py(), tokenizer)
                wide = ids.astype("<u2") if tokens_fit(ids) else ids.astype("<i4")
                mark = b"s" if wide.dtype.itemsize == 2 else b"i"
                for p, at in enumerate(range(0, len(ids), capacity)):
                    part = wide[at : at + capacity]
                    for k, v in zip(rows, (doc, p, at, len(part), mark + part.tobytes())):
                        rows[k].append(v)
                    held += part.nbytes
                    if held > _BATCH_BYTES:
                        yield pa.RecordBatch.from_pydict(rows, schema=_PIECE_FIELDS)
                        rows, held = {k: [] for k in rows}, 0
        yield pa.RecordBatch.from_pydict(rows, schema=_PIECE_FIELDS)

    return run


def tokens_fit(ids: np.ndarray) -> bool:
    return not len(ids) or int(ids.max()) < 65_536


def _ids(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype="<u2" if blob[:1] == b"s" else "<i4", offset=1).astype(np.int32)


_SCHEMA = pa.schema([
    ("container_id", pa.string()), ("n_tokens", pa.int32()), ("n_items", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
    ("pieces", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("token_ids", pa.list_(pa.int32())),
])


def carried(bins: list[list[int]], sizes: list[int], capacity: int, most: int) -> tuple[list[list[int]], list[int]]:
    """Containers to close, and items of those with space left to be packed again with later ones: the emptiest first, at most ``most`` items."""
    space = [capacity - sum(sizes[i] for i in b) for b in bins]
    again: list[int] = []
    opened = set()
    for j in sorted((j for j, s in enumerate(space) if s), key=lambda j: (-space[j], j)):
        if len(again) + len(bins[j]) > most:
            break
        again += bins[j]
        opened.add(j)
    return [b for j, b in enumerate(bins) if j not in opened], sorted(again)


class _Packer:
    """Packs a stream of pieces: full ones pass through, others wait until ``block`` are there; no more are ever held at once."""

    def __init__(self, capacity: int, block: int):
        self.capacity, self.block, self.part, self.made = capacity, block, None, 0
        self.waiting: list[tuple[int, int, int, int, bytes]] = []

    def container(self, items: list[tuple[int, int, int, int, bytes]]) -> tuple:
        doc, piece, start, n, blobs = zip(*items)
        self.made += 1
        return f"{self.part}-{self.made - 1}", sum(n), len(items), doc, piece, start, n, np.concatenate([_ids(b) for b in blobs])

    def pack(self, last: bool) -> Iterator[tuple]:
        sizes = [r[3] for r in self.waiting]
        bins, again = best_two_fit(sizes, self.capacity), []
        if not last:
            bins, again = carried(bins, sizes, self.capacity, self.block // 4)
        for b in bins:
            yield self.container([self.waiting[i] for i in b])
        self.waiting = [self.waiting[i] for i in again]

    def containers(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for part, *item in zip(*(b[c].to_pylist() for c in ("part", *_PIECE_FIELDS.names))):
                self.part = part
                if item[3] == self.capacity:
                    yield self.container([tuple(item)])
                    continue
                self.waiting.append(tuple(item))
                if len(self.waiting) >= self.block:
                    yield from self.pack(False)
        yield from self.pack(True)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {f.name: [] for f in _SCHEMA}
        for c in self.containers(batches):
            for k, v in zip(rows, c):
                rows[k].append(v)
            if len(rows["n_items"]) >= 500:
                yield pa.RecordBatch.from_pydict(rows, schema=_SCHEMA)
                rows = {k: [] for k in rows}
        yield pa.RecordBatch.from_pydict(rows, schema=_SCHEMA)


def _partitions(documents: DataFrame, least_rows: int = 5_000, rows: int = 100_000, size: int = 256_000_000) -> int:
    """One partition per ``rows`` documents or ``size`` stored bytes, whichever are more; while there are fewer than cores, one per ``least_rows``."""
    n = documents.count()
    wanted = max(math.ceil(n / rows), math.ceil(model.stored_bytes(documents) / size))
    return max(1, wanted, min(documents.sparkSession.sparkContext.defaultParallelism, math.ceil(n / least_rows)))


def pack(documents: DataFrame, capacity: int = 2048, tokenizer: str = tokens.DEFAULT_FILE, items_per_shard: int = 20_000, partitions: int | None = None) -> DataFrame:
    """One row per container: its id, token and item counts, and of each item, in order, the document, the number of its
    piece, the piece's first token and length; ``token_ids`` are the items' tokens one after another.

    ``documents`` has ``doc_id`` and ``text``. A text of at most ``capacity`` tokens is one item; a longer one is split
    into pieces of exactly ``capacity`` tokens, each a full container, and a rest, an item like any other. NULL and
    empty texts and rows without ``doc_id`` have no item. Rows of the same ``doc_id`` are items of their own.

    Each text is tokenized once and moved once, with its tokens. A hash spreads the pieces over ``partitions``, in which
    they arrive in a fixed order (so that a task that runs again makes the same containers). Full pieces go through at
    once; the others are packed ``items_per_shard`` at a time, so that a task's memory depends neither on the number of
    documents nor on their lengths. Items of a block's containers with space left are packed again with the next block.
    """
    model.utc(documents.sparkSession)
    tokens.share(documents.sparkSession, tokenizer)
    d = documents.where("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = model.spread(d).mapInArrow(_pieces(capacity, tokenizer), _PIECE)
    # The hash mixes all lengths into every partition.
    pieces = pieces.withColumn("mix", F.xxhash64("doc_id", "piece")).repartition(partitions or _partitions(documents), "mix")
    pieces = pieces.sortWithinPartitions("mix", "doc_id", "piece", "ids").withColumn("part", F.spark_partition_id()).drop("mix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _Packer(capacity, items_per_shard)(batches)

    return pieces.mapInArrow(run, _CONTAINER)


def fill(containers: DataFrame, capacity: int = 2048) -> DataFrame:
    """Number of containers, their tokens and the share of space used."""
    return containers.agg(F.count("*").alias("containers"), F.sum("n_tokens").alias("tokens"), (F.sum("n_tokens") / (F.count("*") * capacity)).alias("used"))
