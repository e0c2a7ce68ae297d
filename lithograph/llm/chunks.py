"""Corpus-wide counting of hashes with bounded tasks.

Several operators ask the same question of every hash in the corpus (a word window,
a shingle, an anchor, a token): how often does it occur over all documents?  Shipping
one row per hash costs about twenty bytes of shuffle; here it costs four to six:

1.  Texts are collapsed to distinct ones (a batch-wise pre-aggregation, so a text that
    a third of all rows share reaches a chunk once per map batch) and dealt by digest
    into *chunks* of a few megabytes.
2.  Each chunk sends its distinct hashes, sorted and packed, to *buckets* (ranges of the
    hash space).  A hash reaches a bucket once per chunk with its count, so a hash that
    every document holds is no hot key.
3.  A bucket adds up the counts and answers each chunk with one value per hash, in the
    order in which the chunk sent them.
4.  The chunk lines the answers up with its positions again.

The chunks' exchange is the same subplan in each step, so Spark runs it once and reuses
its files.  No step holds more than one chunk or one bucket in a Python worker.

Traffic.  A chunk sends a bucket one row, so chunks x buckets rows carry the hashes.  With
fixed sizes both numbers would follow the input, and rows its square; chunks and buckets
therefore both grow with the square root of the input beyond ``SCALE_BYTES`` (``growth``),
which holds the hashes of a row at about ten.  At 100 TB growth is 16: 1.5 million chunks
of 64 MB, 1.2 million buckets of 16 million hashes (some 0.5 GB in a worker), 1.7e13 hashes
in 1.8e12 rows, hence about 7 bytes of row for the 10 of a key and its count.  A hash that
every document holds is 1.5 million entries (15 MB) of its bucket there.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Raw bytes of text in a chunk, and hashes in a bucket, about.
CHUNK_BYTES = 4 << 20
BUCKET_KEYS = 1 << 20
#: Bytes of input beyond which chunks and buckets grow.
SCALE_BYTES = 400e9

DISTINCT_SCHEMA = "chunk long, sha binary, min_id long, copies long, weight long, text binary"
REQUEST_SCHEMA = "bucket long, chunk long, n long, payload binary"
ANSWER_SCHEMA = "chunk long, bucket long, payload binary"


def growth(total_bytes: int) -> float:
    """By what chunks and buckets are larger than their constants say."""
    return max(1.0, math.sqrt(total_bytes / SCALE_BYTES))


def release() -> None:
    """Give freed memory back to the system: workers live on, and their peaks would add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def released(task):
    """A function of one Arrow table, or of two, after which freed memory goes back to the system."""

    def one(table: pa.Table) -> pa.Table:
        out = task(table)
        release()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = task(left, right)
        release()
        return out

    return one if task.__code__.co_argcount == 1 else two


#: An odd multiplier of the polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def corpus_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: one number, from a pass that reads one column."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0])


def text_sha(text_col: str = "text"):
    """The key of a text: SHA-256 of its UTF-8 bytes, of the empty string for null."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def distinct_texts(docs: DataFrame, total_bytes: int, id_col: str = "doc_id", text_col: str = "text", weight=None, chunk_bytes: int | None = None) -> DataFrame:
    """Rows of DISTINCT_SCHEMA, not yet merged over map batches (see load_chunk).

    ``min_id`` is the smallest non-null id, ``copies`` the number of rows, ``weight`` the
    sum of the integer column expression ``weight`` (1 by default).
    """
    chunks = max(1, math.ceil(total_bytes / ((chunk_bytes or CHUNK_BYTES) * growth(total_bytes))))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
        text_sha(text_col).alias("sha"),
        (F.lit(1) if weight is None else weight).cast("long").alias("weight"),
    ).withColumn("chunk", F.pmod(F.xxhash64("sha"), F.lit(chunks)))

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, weights = batch["id"].to_pylist(), batch["weight"].to_pylist()
            first: dict[bytes, int] = {}
            least: dict[bytes, int | None] = {}
            copies: dict[bytes, int] = {}
            heavy: dict[bytes, int] = {}
            for i, sha in enumerate(batch["sha"].to_pylist()):
                if sha not in first:
                    first[sha], least[sha], copies[sha], heavy[sha] = i, ids[i], 0, 0
                elif ids[i] is not None and (least[sha] is None or ids[i] < least[sha]):
                    least[sha] = ids[i]
                copies[sha] += 1
                heavy[sha] += weights[i] or 0
            at = pa.array(list(first.values()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["chunk"].take(at), batch["sha"].take(at), pa.array(list(least.values()), pa.int64()), pa.array(list(copies.values()), pa.int64()), pa.array(list(heavy.values()), pa.int64()), batch["text"].take(at)],
                names=["chunk", "sha", "min_id", "copies", "weight", "text"],
            )

    return rows.mapInArrow(collapse, DISTINCT_SCHEMA)


class Chunk:
    """The distinct texts of one chunk in the order of their digests."""

    def __init__(self, table: pa.Table):
        merged: dict[bytes, list] = {}
        for sha, least, copies, weight, text in zip(*(table[c].to_pylist() for c in ("sha", "min_id", "copies", "weight", "text"))):
            if (seen := merged.get(sha)) is None:
                merged[sha] = [least, copies, weight, text]
            else:
                seen[0] = least if seen[0] is None else seen[0] if least is None else min(seen[0], least)
                seen[1] += copies
                seen[2] += weight
        self.number = table["chunk"][0].as_py() if table.num_rows else -1
        self.shas = sorted(merged)
        self.ids = [merged[s][0] for s in self.shas]
        self.copies = np.array([merged[s][1] for s in self.shas], np.int64)
        self.weights = np.array([merged[s][2] for s in self.shas], np.int64)
        self.texts = [merged[s][3] for s in self.shas]


#: Bytes of text that are hashed at once.
BLOCK_BYTES = 1 << 18

#: True for the six ASCII white-space characters.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_BYTES, each with one text at least."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > BLOCK_BYTES:
            yield start, i
            start, held = i, 0
        held += len(text) + 1
    if texts:
        yield start, len(texts)


#: Words that are hashed at once.
SLAB = 1 << 16
_ALL = np.uint64((1 << 64) - 1)


def _eight(raw: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place as one number."""
    held = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)[at]).view(np.uint64)[:, 0]
    return held & (_ALL >> (np.uint64(64) - np.minimum(n, 8).astype(np.uint64) * np.uint64(8)))


def word_hashes(texts: list[bytes], lower: bool, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in one array, and where each text begins in it.

    Words of up to 8 bytes keep all their bits, those of up to 16 mix two numbers, and longer
    ones go through BLAKE2; other seeds give independent hashes.  (A polynomial of the bytes
    modulo 2**64 would have collisions that can be written down.)
    """
    parts, counts = [np.empty(0, np.uint64)], [0]
    start = mix(np.array([seed + 1], np.uint64))
    key = seed.to_bytes(8, "little")
    for lo, hi in blocks(texts):
        raw = np.frombuffer(b" ".join([b"", *texts[lo:hi], b" " * 16]), np.uint8)
        space = SPACES[raw]
        begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        size = np.flatnonzero(~space[:-1] & space[1:]) + 1 - begin
        if lower:
            raw = LOWER[raw]
        for k in range(0, len(begin), SLAB):
            at, n = begin[k : k + SLAB], size[k : k + SLAB]
            out = mix(mix(_eight(raw, at, n) + start) + n.astype(np.uint64) * np.uint64(BASE))
            if len(some := np.flatnonzero(n > 8)):
                out[some] = mix(out[some] ^ mix(_eight(raw, at[some] + 8, n[some] - 8) - start))
            for i in np.flatnonzero(n > 16).tolist():
                out[i] = int.from_bytes(hashlib.blake2b(raw[at[i] : at[i] + n[i]], digest_size=8, salt=key).digest(), "little")
            parts.append(out)
        edges = np.cumsum([1, *(len(t) + 1 for t in texts[lo:hi])])
        counts.extend(np.diff(np.searchsorted(begin, edges)).tolist())
    return np.concatenate(parts), np.cumsum(counts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose upper bits depend on all lower ones."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Powers come from a table of the first ones and one of every ``STEP``-th.
STEP = 1 << 12


@functools.lru_cache(maxsize=8)
def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    def first(b: int, many: int) -> np.ndarray:
        out = np.full(many, b, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return first(base, STEP), first(pow(base, STEP, 1 << 64), n)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    low, high = _tables(base, 1 << max(6, (n // STEP).bit_length()))
    return np.multiply.outer(high[: -(-n // STEP)], low).reshape(-1)[:n]


@functools.lru_cache(maxsize=4)
def _slab(base: int, n: int) -> np.ndarray:
    return powers(base, n)


def slab_powers(base: int) -> np.ndarray:
    """The powers of one slab."""
    return _slab(base, SLAB)


def power_at(base: int, at: np.ndarray) -> np.ndarray:
    """base**at modulo 2**64."""
    low, high = _tables(base, 1 << max(6, (int(at.max(initial=0)) // STEP).bit_length()))
    return high[at // STEP] * low[at % STEP]


def rolling(values: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Rabin-Karp hashes of every window of ``length`` values (across texts too).

    From prefix sums of value * BASE**i; multiplying by BASE**-i makes a window's hash
    independent of where it starts, so the values are taken slab by slab.
    """
    n = len(values) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    most = min(n, SLAB)
    up, down = powers(BASE, most + length - 1), slab_powers(BASE_INVERSE)
    for lo in range(0, n, SLAB):
        part = values[lo : lo + most + length - 1]
        m = len(part) - length + 1
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)], dtype=np.uint64)])
        out[lo : lo + m] = mix((prefix[length:] - prefix[:m]) * down[:m] + np.uint64((salt * 0x2545F4914F6CDD1D + length) % (1 << 64)))
    return out


def window_starts(ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window fits into its text, and the number of that text."""
    counts = np.maximum(np.diff(ends) - length + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return ends[:-1][text] + within, text


class Keys:
    """How hashes are cut into a bucket and a packed remainder of ``width`` bytes.

    With fewer than 8 bytes, different hashes may share a remainder; users of narrow
    keys treat a shared one as a candidate to confirm, never as a result.
    """

    def __init__(self, expected: int, width: int | None = None, growth: float = 1.0):
        self.bits = max(0, math.ceil(math.log2(max(1, expected) / (BUCKET_KEYS * growth))))
        narrow = 5 if expected < 1 << 33 else 6 if expected < 1 << 41 else 8
        self.width = min(8, width or narrow)
        self.whole = self.bits + 8 * self.width >= 64
        if self.whole:
            self.width = 8

    def cut(self, hashes: np.ndarray) -> np.ndarray:
        return hashes if self.whole else hashes >> np.uint64(64 - self.bits - 8 * self.width)

    def requests(self, chunk: int, distinct: np.ndarray, counts: np.ndarray, extra: np.ndarray | None = None) -> list[tuple]:
        """Rows of REQUEST_SCHEMA for sorted distinct cut keys and their counts (uint32), by bucket."""
        if not len(distinct):
            return []
        shift = 64 - self.bits if self.whole else 8 * self.width
        bucket = distinct >> np.uint64(shift) if shift < 64 else np.zeros(len(distinct), np.uint64)
        edges = np.flatnonzero(np.diff(bucket)) + 1
        out = []
        for lo, hi in zip([0, *edges], [*edges, len(distinct)]):
            planes = distinct[lo:hi].view(np.uint8).reshape(-1, 8)[:, : self.width][:, ::-1].T
            tail = counts[lo:hi].astype("<u4").view(np.uint8).reshape(-1, 4).T
            payload = planes.tobytes() + tail.tobytes()
            if extra is not None:
                payload += extra[lo:hi].astype("<u4").tobytes()
            out.append((int(bucket[lo]), chunk, hi - lo, payload))
        return out

    def unpack(self, n: int, payload: bytes, extra: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        raw = np.frombuffer(payload, np.uint8)
        keys = np.zeros((n, 8), np.uint8)
        keys[:, : self.width] = raw[: n * self.width].reshape(self.width, n).T[:, ::-1]
        counts = np.ascontiguousarray(raw[n * self.width : n * (self.width + 4)].reshape(4, n).T).view("<u4")[:, 0]
        more = np.frombuffer(payload, "<u4", n, n * (self.width + 4)) if extra else None
        return keys.view(np.uint64)[:, 0], counts, more


def request_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table({"bucket": pa.array(cols[0], pa.int64()), "chunk": pa.array(cols[1], pa.int64()), "n": pa.array(cols[2], pa.int64()), "payload": pa.array(cols[3], pa.binary())})


def answer_requests(requests: DataFrame, keys: Keys, reply: Callable[[np.ndarray], np.ndarray], extra: bool = False) -> DataFrame:
    """Add up the counts of each key over all chunks; reply(totals) goes back, aligned, as bytes."""

    def bucket(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        sizes = table["n"].to_pylist()
        parts = [keys.unpack(n, p, extra) for n, p in zip(sizes, table["payload"].to_pylist())]
        key, count = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        if extra:
            more = np.concatenate([p[2] for p in parts])
            order = np.lexsort((more, key))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (np.diff(key[order]) != 0) | (np.diff(more[order].astype(np.int64)) != 0)
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(fresh) - 1
        else:
            _, group = np.unique(key, return_inverse=True)
        out = reply(np.bincount(group, count).astype(np.int64))[group]
        edges = np.cumsum([0, *sizes])
        answers = pa.array([out[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())
        del parts, key, count, group, out
        release()
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "payload": answers})

    return requests.groupBy("bucket").applyInArrow(bucket, ANSWER_SCHEMA)


def join_answers(table: pa.Table, dtype) -> np.ndarray:
    """A chunk's answers in the order of its sorted distinct keys."""
    table = table.sort_by("bucket")
    return np.concatenate([np.empty(0, dtype), *(np.frombuffer(p, dtype) for p in table["payload"].to_pylist())])


def log_class(totals: np.ndarray) -> np.ndarray:
    """floor(log2(total)) as one byte: 0 for a hash that occurs once."""
    return np.floor(np.log2(np.maximum(totals, 1))).astype(np.uint8)


def attach(docs: DataFrame, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id and sha, with the columns that ``texts`` has for its sha.

    ``texts`` holds a sha once; a sha that very many rows share is a skewed left side,
    which adaptive execution splits.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_sha(text_col).alias("sha"))
    return rows.join(texts, "sha", "left")
