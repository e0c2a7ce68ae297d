"""Language-model scoring by context-tree weighting over bytes, and a unigram base score.

A byte is eight binary decisions.  For each decision, contexts of 0, 1 .. ``DEPTH`` bytes
hold Krichevsky-Trofimov counts; the weight of each depth is its share in the weighted
block probability of the training data,

    Pw(s) = 1/2 Pe(s) + 1/2 product of Pw(children of s),

so estimates of all depths are mixed as the data supports them.  A context that training
never saw adds no evidence: the estimate above it stands.  A text is scored as its
lower-cased bytes and an end mark (byte 0), after ``DEPTH`` such marks; the negated
logarithm is its code length.

The tree grows with the corpus and is never gathered:

1.  Training counts every training text whole, as paths (a byte and the ``DEPTH`` before
    it) by batch.  Paths go to buckets by their last ``TOP`` + 1 context bytes, so that a
    bucket owns whole subtrees; it sends up their block probabilities, summed by context
    of ``TOP`` bytes.
2.  Contexts of up to ``TOP`` bytes are at most 65,793 rows of 256 numbers, which is the
    proven bound of what the driver holds and broadcasts.
3.  Chunks of texts ask for the paths on which they lie (``chunks``); a bucket mixes each
    path over all depths and answers with the logarithm of its byte's probability.

Word counts of the base score take the same way.

Defined results
    * null text: no words and no bytes, one end token;
    * a null id counts as the empty string when training texts are chosen;
    * equal texts have equal scores; repeated rows are trained on as often as they occur;
    * extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithograph.llm import chunks as C

#: Bytes of the longest context (a path fits 64 bits up to 7), and of those whose tables are broadcast.
DEPTH = 5
TOP = 2
PAD = b"\0" * DEPTH
#: Bytes of text for each bucket of paths, and paths of blocks that are merged at once.
PATH_BYTES = 8 << 20
MERGE_KEYS = 1 << 22

PATHS_SCHEMA = "bucket long, chunk long, payload binary"

TEXTS_SCHEMA = "sha binary, n_words long, n_bytes long, known_words long, count_logs double, score double"


def held_out(doc_id: str = "doc_id", parts: int = 7, part: int = 2) -> Column:
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts) == part


def _sequence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each after DEPTH marks and before one; places of the bytes to score."""
    raw = np.frombuffer(b"".join([PAD + t + b"\0" for t in texts]), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.cumsum(lengths + DEPTH) - lengths
    return C.LOWER[raw], np.arange(lengths.sum()) + np.repeat(first - (np.cumsum(lengths) - lengths), lengths)


def _keys(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The TOP context bytes and the byte itself in one number."""
    wide = raw.astype(np.uint32)
    return (wide[at - 2] << 16) | (wide[at - 1] << 8) | wide[at]


def _paths(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """DEPTH context bytes, the nearest first, and the byte itself in one number."""
    wide = raw.astype(np.uint64)
    out = wide[DEPTH:]  # by place, and moved as a whole
    for d in range(1, DEPTH + 1):
        out = out | (wide[DEPTH - d : len(wide) - d] << np.uint64(8 * (DEPTH + 1 - d)))
    return out[at - DEPTH]


#: Bits that a path leaves free in 64, and a slab of places that they number.
FREE = np.uint64(64 - 8 * (DEPTH + 1))
PLACES = 1 << int(FREE)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values of a sorted array begins."""
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(fresh)


def _united(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of sorted distinct arrays, and the sums of their counts."""
    if len(keys) == 1:
        return keys[0], counts[0]
    both = np.sort(np.concatenate(keys))
    both = both[_runs(both)]
    out = np.zeros(len(both), np.int64)
    for own, n in zip(keys, counts):
        out[np.searchsorted(both, own)] += n
    return both, out


def path_counts(texts: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct paths of all texts and how often each occurs, texts taken ``weights`` times.

    A path and its weight are one number, so counting is one sort.  A weight beyond the free bits goes
    digit by digit.
    """
    keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    held: list[np.ndarray] = []
    digit = 0

    def merge() -> None:
        both = np.concatenate(held)
        held.clear()
        both.sort()
        paths = both >> FREE
        first = _runs(paths)
        n = np.add.reduceat(both & np.uint64(PLACES - 1), first).astype(np.int64) << (int(FREE) * digit)
        one, sums = _united([keys[0], paths[first]], [counts[0], n])
        keys[0], counts[0] = one, sums

    while True:
        own = (weights >> (int(FREE) * digit)) & (PLACES - 1)
        # Each text is taken once at least, if with no weight; after that, those with more digits.
        some = np.arange(len(texts)) if digit == 0 else np.flatnonzero(weights >> (int(FREE) * digit))
        if not len(some):
            return keys[0], counts[0]
        taken = [texts[i] for i in some.tolist()]
        for lo, hi in C.blocks(taken):
            paths = _paths(*_sequence(taken[lo:hi]))
            held.append((paths << FREE) | np.repeat(own[some[lo:hi]], [len(t) + 1 for t in taken[lo:hi]]).astype(np.uint64))
            if sum(map(len, held)) > MERGE_KEYS:
                merge()
        if held:
            merge()
        digit += 1


def distinct_paths(texts: list[bytes]) -> np.ndarray:
    """The paths of ``path_counts`` alone, which takes no more than sorting."""
    keys: list[np.ndarray] = [np.empty(0, np.uint64)]

    def merge() -> None:
        both = np.concatenate(keys)
        both.sort()
        keys[:] = [both[_runs(both)]]

    for lo, hi in C.blocks(texts):
        keys.append(_paths(*_sequence(texts[lo:hi])))
        if sum(map(len, keys[1:])) > MERGE_KEYS:
            merge()
    merge()
    return keys[0]


def path_values(at: np.ndarray, paths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each path of ``at``; ``paths`` are sorted and have all of them.

    Paths are looked up in their order, slab by slab with their places in the free bits: a search that goes
    forward stays in the cache.
    """
    out = np.empty(len(at), values.dtype)
    for lo in range(0, len(at), PLACES):
        part = at[lo : lo + PLACES]
        both = np.sort((part << FREE) | np.arange(len(part), dtype=np.uint64))
        own = both >> FREE
        first = _runs(own)
        found = values[np.searchsorted(paths, own[first])]
        out[lo + (both & np.uint64(PLACES - 1)).astype(np.int64)] = np.repeat(found, np.diff(np.append(first, len(own))))
    return out


def _dealt(paths: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each path's subtree, and the order of paths by bucket."""
    bucket = (C.mix(paths >> np.uint64(8 * (DEPTH - TOP))) % np.uint64(buckets)).astype(np.int64)
    # Sixteen bits are sorted by radix.
    return bucket, np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")


def _path_table(chunk: int, paths: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    """Rows of PATHS_SCHEMA: sorted paths and their counts, packed by bucket."""
    bucket, order = _dealt(paths, buckets)
    bucket, paths, counts = bucket[order], paths[order], counts[order].astype(np.uint64)
    edges = np.flatnonzero(np.diff(bucket)) + 1
    rows = []
    for lo, hi in zip([0, *edges], [*edges, len(paths)]) if len(paths) else ():
        raw = paths[lo:hi].view(np.uint8).reshape(-1, 8)[:, : DEPTH + 1].T.tobytes() + _squeeze(counts[lo:hi])
        rows.append((int(bucket[lo]), int(hi - lo).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)))
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "chunk": pa.array([chunk] * len(rows), pa.int64()), "payload": pa.array([r[1] for r in rows], pa.binary())})


def _unpack_paths(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size = (int.from_bytes(payload[k : k + 8], "little") for k in (0, 8))
    raw = pa.decompress(payload[16:], size, "zstd", asbytes=True)
    paths = np.zeros((n, 8), np.uint8)
    paths[:, : DEPTH + 1] = np.frombuffer(raw, np.uint8, n * (DEPTH + 1)).reshape(DEPTH + 1, n).T
    return paths.view(np.uint64)[:, 0], _expand(raw[n * (DEPTH + 1) :])


class Subtrees:
    """The contexts of TOP + 1 .. DEPTH bytes over some paths and their counts."""

    def __init__(self, payloads: list[bytes]):
        self.parts = [_unpack_paths(p) for p in payloads]
        paths, counts = _united([p[0] for p in self.parts], [p[1].astype(np.int64) for p in self.parts])
        counts = counts.astype(np.float64)
        #: By depth from DEPTH upwards: context and byte, counts, and the place of each in the depth above.
        self.keys, self.counts, self.up = [paths], [counts], []
        while len(self.keys) < DEPTH - TOP + 1:  # the last is of TOP bytes
            keys = self.keys[-1]
            above, up = np.unique(((keys >> np.uint64(16)) << np.uint64(8)) | (keys & np.uint64(255)), return_inverse=True)
            self.up.append(up)
            self.keys.append(above)
            self.counts.append(np.bincount(up, self.counts[-1], len(above)))

    def decisions(self):
        """For each bit: nodes of the contexts of TOP + 1 bytes with the logarithm of Pw; and for
        each path its node, whether training saw it at TOP + 1 bytes, and the probability of a one."""
        for bit in range(8):
            levels = []
            for keys, n in zip(self.keys[:-1], self.counts):
                ids = keys >> np.uint64(8 - bit)
                fresh = np.ones(len(ids), bool)
                fresh[1:] = ids[1:] != ids[:-1]
                node = np.cumsum(fresh) - 1
                total = np.bincount(node, n)
                ones = np.bincount(node, n * ((keys >> np.uint64(7 - bit)) & np.uint64(1)))
                levels.append((ids[fresh], np.flatnonzero(fresh), node, total - ones, ones))
            _, first, deepest, zeros, ones = levels[0]
            weighted, p, seen = _log_kt(zeros, ones), (ones + 0.5) / (zeros + ones + 1), zeros + ones > 0
            at, entry = np.arange(len(first)), first  # node of each deepest node at this depth, and an entry of it
            for (_, below_first, *_), (_, _, node, zeros, ones), up in zip(levels, levels[1:], self.up):
                block = _log_kt(zeros, ones)
                every = np.logaddexp(block, np.bincount(node[up[below_first]], weighted, len(block))) - math.log(2)
                stay, own = np.exp(block - math.log(2) - every), (ones + 0.5) / (zeros + ones + 1)
                entry = up[entry]
                below_seen, at = seen[at], node[entry]
                p = np.where(below_seen, stay[at] * own[at] + (1 - stay[at]) * p, own[at])
                weighted, seen = every, zeros + ones > 0
            yield bit, levels[-1][0], weighted, deepest, seen[at], p


def _swap(context: np.ndarray) -> np.ndarray:
    """Two context bytes, the nearest first, in the order of the text; and back."""
    return ((context & 255) << 8) | (context >> 8)


def tops(paths: DataFrame) -> DataFrame:
    """(key, n, below): counts by context of TOP bytes and byte; where n is null, the logarithm
    of the product of its children's Pw by context and node (1 to 255 from the first bit down)."""

    def up(table: pa.Table) -> pa.Table:
        trees = Subtrees(table["payload"].to_pylist())
        keys, counts = trees.keys[-1].astype(np.int64), trees.counts[-1].astype(np.int64)
        nodes, logs = [], []
        for bit, ids, weighted, *_ in trees.decisions():
            ids = ids.astype(np.int64)
            nodes.append((_swap(ids >> (8 + bit)) << 8) | (1 << bit) | (ids & ((1 << bit) - 1)))
            logs.append(weighted)
        nodes, back = np.unique(np.concatenate(nodes), return_inverse=True)
        logs = np.bincount(back, np.concatenate(logs), len(nodes))
        C.release()
        return pa.table({
            "key": pa.array(np.concatenate([(_swap(keys >> 8) << 8) | (keys & 255), nodes])),
            "n": pa.array([*counts.tolist(), *[None] * len(nodes)], pa.int64()),
            "below": pa.array(np.concatenate([np.zeros(len(keys)), logs])),
        })

    rows = paths.groupBy("bucket").applyInArrow(up, "key long, n long, below double")
    return rows.groupBy("key", F.col("n").isNull().alias("node")).agg(F.sum("n").alias("n"), F.sum("below").alias("below"))


def training_paths(docs: DataFrame, training: Column, buckets: int, text_col: str = "text") -> DataFrame:
    rows = docs.where(training).select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def count(batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            yield from _path_table(-1, *path_counts(texts, np.ones(len(texts), np.int64)), buckets).to_batches()
            C.release()

    return rows.mapInArrow(count, PATHS_SCHEMA)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = sum(np.log(x + k) for k in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


#: Logarithms for small counts, which most nodes have.
_SMALL = 1 << 12
_HALVES, _WHOLES = (_log_gamma(np.arange(_SMALL) + x) for x in (0.5, 1.0))


def _log_gamma_at(counts: np.ndarray, more: float, small: np.ndarray) -> np.ndarray:
    """``_log_gamma`` of whole ``counts`` + ``more``; ``small`` has those of the first ones."""
    out = small[np.minimum(counts, _SMALL - 1).astype(np.int32)]
    large = counts >= _SMALL
    out[large] = _log_gamma(counts[large] + more)
    return out


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability of whole counts."""
    return _log_gamma_at(zeros, 0.5, _HALVES) + _log_gamma_at(ones, 0.5, _HALVES) - _log_gamma_at(zeros + ones, 1.0, _WHOLES) - math.log(math.pi)


class Model:
    """The top of the tree: log10 probability of each byte after each context of up to TOP bytes that training saw.

    Rows: contexts of two bytes, then of one byte, then the empty context; ``row`` maps the
    two bytes before a place to its row.  ``logs`` and ``base`` (by node, the probability of
    a one) hold where no longer context was seen; else a one has probability
    ``above`` + ``rest`` * (that of the longer contexts).  ``nodes`` and ``below`` are the
    children of the contexts of two bytes, as ``tops`` gives them.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, nodes: np.ndarray | None = None, below: np.ndarray | None = None):
        context, byte = keys >> 8, keys & 255
        two, place = np.unique(context, return_inverse=True)
        n2 = np.zeros((len(two), 256))
        np.add.at(n2, (place, byte), counts)
        one, parent = np.unique(two & 255, return_inverse=True)
        n1 = np.zeros((len(one), 256))
        np.add.at(n1, parent, n2)
        n0 = n1.sum(axis=0, keepdims=True)
        logs = [np.zeros((len(n), 256)) for n in (n2, n1, n0)]
        symbols = np.arange(256)
        children = np.zeros((len(two), 256))
        if nodes is not None:
            children[np.searchsorted(two, nodes >> 8), nodes & 255] = below
        rows = len(two) + len(one) + 1
        self.base, self.above, self.rest = np.full((rows, 256), 0.5), np.zeros((rows, 256)), np.zeros((rows, 256))
        for bit in range(8):
            node, side = symbols >> (8 - bit), (symbols >> (7 - bit)) & 1
            zeros, ones = zip(*(((c := n.reshape(len(n), 1 << bit, 2, 128 >> bit).sum(axis=3))[:, :, 0], c[:, :, 1]) for n in (n2, n1, n0)))
            block = [_log_kt(z, o) for z, o in zip(zeros, ones)]
            here = slice(1 << bit, 2 << bit)
            all2 = block[0] if nodes is None else np.logaddexp(block[0], children[:, here]) - math.log(2)
            stay2 = np.exp(block[0] - math.log(2) - all2)
            below1, below0 = np.zeros_like(block[1]), np.zeros_like(block[2])
            np.add.at(below1, parent, all2)
            all1 = np.logaddexp(block[1], below1) - math.log(2)
            below0 = all1.sum(axis=0, keepdims=True)
            stay1 = np.exp(block[1] - math.log(2) - all1)
            stay0 = np.exp(block[2] - math.log(2) - (np.logaddexp(block[2], below0) - math.log(2)))
            p2, p1, p0 = ((o + 0.5) / (z + o + 1.0) for z, o in zip(zeros, ones))
            seen2, seen1 = (zeros[0] + ones[0]) > 0, (zeros[1] + ones[1]) > 0
            mix1 = np.where(seen1, stay0 * p0 + (1 - stay0) * p1, p0)
            mix2 = np.where(seen2, stay0 * p0 + (1 - stay0) * (stay1[parent] * p1[parent] + (1 - stay1[parent]) * p2), mix1[parent])
            longer = (1 - stay0) * (1 - stay1[parent])
            self.base[:, here] = np.concatenate([mix2, mix1, p0])
            self.above[: len(two), here] = stay0 * p0 + (1 - stay0) * stay1[parent] * p1[parent] + longer * stay2 * p2
            self.rest[: len(two), here] = longer * (1 - stay2)
            for out, p in zip(logs, (mix2, mix1, p0)):
                out += np.log10(np.where(side == 1, p[:, node], 1 - p[:, node]))
        self.logs = np.concatenate(logs).astype(np.float32)
        self.row = np.full(1 << 16, len(self.logs) - 1, np.int32)
        for r, b in enumerate(one.tolist()):
            self.row[(np.arange(256) << 8) | b] = len(two) + r
        self.row[two] = np.arange(len(two))

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, hi in C.blocks(texts):
            keys = _keys(*_sequence(texts[lo:hi]))
            logs = self.logs[self.row[keys >> 8], keys & 255].astype(np.float64)
            lengths = np.array([len(t) + 1 for t in texts[lo:hi]], np.int64)
            out[lo:hi] = np.add.reduceat(logs, np.cumsum(lengths) - lengths)
        return out


    def answers(self, trees: Subtrees) -> np.ndarray:
        """log10 probability of the byte of each path, mixed over all depths."""
        paths = trees.keys[0]
        row = self.row[_swap((paths >> np.uint64(8 * (DEPTH - 1))).astype(np.int64))]
        byte = (paths & np.uint64(255)).astype(np.int64)
        # Eight probabilities, none below one in twice the training bytes: their product stays in range.
        out = np.ones(len(paths))
        for bit, _, _, node, seen, p in trees.decisions():
            place = row, (1 << bit) | (byte >> (8 - bit))
            one = np.where(seen[node], self.above[place] + self.rest[place] * p[node], self.base[place])
            out *= np.where((byte >> (7 - bit)) & 1, one, 1 - one)
        return np.log10(out).astype(np.float32)


def train(docs: DataFrame, training: Column, buckets: int, text_col: str = "text") -> Model:
    """The top of the tree; what reaches the driver has at most 2**25 rows, whatever the input."""
    table = tops(training_paths(docs, training, buckets, text_col)).toArrow()
    node = table["node"].to_numpy()
    key, n, below = table["key"].to_numpy(), table["n"].fill_null(0).to_numpy(), table["below"].to_numpy()
    return Model(key[~node], n[~node].astype(np.float64), key[node], below[node])


def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Per distinct text its lengths and scores; and one row of train_words and train_types."""
    spark = docs.sparkSession
    total = C.corpus_bytes(docs, text_col)
    buckets = max(1, math.ceil(total / (PATH_BYTES * C.growth(total))))
    model = spark.sparkContext.broadcast(train(docs, training, buckets, text_col))
    texts = C.distinct_texts(docs, total, id_col, text_col, weight=training.cast("int"))
    keys = C.Keys(total // 20 + 1, 8, C.growth(total))

    def ask(table: pa.Table) -> pa.Table:
        chunk = C.Chunk(table)
        hashes, ends = C.word_hashes(chunk.texts, True)
        distinct, back = np.unique(keys.cut(hashes), return_inverse=True)
        counts = np.bincount(back, np.repeat(chunk.weights, np.diff(ends)), len(distinct))
        return C.request_table(keys.requests(chunk.number, distinct, np.minimum(counts, (1 << 32) - 1).astype(np.uint32)))

    def ask_paths(table: pa.Table) -> pa.Table:
        chunk = C.Chunk(table)
        return _path_table(chunk.number, *path_counts(chunk.texts, chunk.weights), buckets)

    def answer_paths(table: pa.Table) -> pa.Table:
        trees = Subtrees(table["payload"].to_pylist())
        logs = model.value.answers(trees)
        payload = [logs[np.searchsorted(trees.keys[0], own)].tobytes() for own, _ in trees.parts]
        out = pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "payload": pa.array(payload, pa.binary())})
        del trees, logs
        C.release()
        return out

    def total_counts(table: pa.Table) -> pa.Table:
        """Answers of each chunk, and one row of sums for the bucket (chunk -1)."""
        table = table.sort_by("chunk")
        sizes = table["n"].to_pylist()
        parts = [keys.unpack(n, p, False) for n, p in zip(sizes, table["payload"].to_pylist())]
        distinct, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([p[1] for p in parts]), len(distinct)).astype(np.int64)
        out, edges = counts[back].astype(np.uint64), np.cumsum([0, *sizes])
        payload = [_squeeze(out[a:b]) for a, b in zip(edges, edges[1:])]
        return pa.table({
            "chunk": pa.array([*table["chunk"].to_pylist(), -1], pa.int64()),
            "bucket": pa.array([*table["bucket"].to_pylist(), -1], pa.int64()),
            "payload": pa.array([*payload, b""], pa.binary()),
            "words": pa.array([0] * len(sizes) + [int(counts.sum())], pa.int64()),
            "types": pa.array([0] * len(sizes) + [int((counts > 0).sum())], pa.int64()),
        })

    def score(texts: list[bytes], answers: np.ndarray) -> np.ndarray:
        paths = distinct_paths(texts)
        logs = np.empty(len(paths))
        logs[_dealt(paths, buckets)[1]] = answers
        out = np.zeros(len(texts))
        for lo, hi in C.blocks(texts):
            own = path_values(_paths(*_sequence(texts[lo:hi])), paths, logs)
            lengths = np.array([len(t) + 1 for t in texts[lo:hi]], np.int64)
            out[lo:hi] = np.add.reduceat(own, np.cumsum(lengths) - lengths)
        return out

    def rate(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list = [[]] * 6
        if table.num_rows:
            chunk = C.Chunk(table)
            hashes, ends = C.word_hashes(chunk.texts, True)
            _, back = np.unique(keys.cut(hashes), return_inverse=True)
            path_answers = C.join_answers(answers.filter(pc.field("path")), np.float32)
            answers = answers.filter(~pc.field("path")).sort_by("bucket")
            counts = np.concatenate([np.empty(0, np.uint64), *map(_expand, answers["payload"].to_pylist())])[back].astype(np.float64)
            text = np.repeat(np.arange(len(chunk.texts)), np.diff(ends))
            known = np.bincount(text, counts > 0, len(chunk.texts)).astype(np.int64)
            logs = np.bincount(text, np.log10(counts + 1), len(chunk.texts))
            rows = [chunk.shas, np.diff(ends), [len(t) for t in chunk.texts], known, logs, score(chunk.texts, path_answers)]
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({k: pa.array(v, t) for k, v, t in zip(("sha", "n_words", "n_bytes", "known_words", "count_logs", "score"), rows, kinds)})

    asked = texts.groupBy("chunk").applyInArrow(ask, C.REQUEST_SCHEMA)
    answered = asked.groupBy("bucket").applyInArrow(total_counts, f"{C.ANSWER_SCHEMA}, words long, types long")
    mixed = texts.groupBy("chunk").applyInArrow(ask_paths, PATHS_SCHEMA).groupBy("bucket").applyInArrow(answer_paths, C.ANSWER_SCHEMA)
    both = answered.where("chunk >= 0").select("chunk", "bucket", "payload", F.lit(False).alias("path")).unionByName(mixed.withColumn("path", F.lit(True)))
    scored = texts.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(rate, TEXTS_SCHEMA)
    sums = answered.where("chunk = -1").agg(F.coalesce(F.sum("words"), F.lit(0)).alias("train_words"), F.coalesce(F.sum("types"), F.lit(0)).alias("train_types"))
    return scored, sums


def _squeeze(counts: np.ndarray) -> bytes:
    """Counts as bytes of the fewest planes that hold them; the first byte is their number."""
    width = max(1, (int(counts.max()).bit_length() + 7) // 8)
    return bytes([width]) + counts.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _expand(payload: bytes) -> np.ndarray:
    planes = np.frombuffer(payload, np.uint8, offset=1).reshape(payload[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : payload[0]] = planes.T
    return out.view(np.uint64)[:, 0]


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: held_out, token counts, base_score, score (log10) and bits_per_byte."""
    out = held_out(id_col)
    texts, sums = score_texts(docs, ~out, id_col, text_col)
    # The sums are one row; each text is an end token as well.
    end = docs.where(~out).count()
    rows = C.attach(docs, texts, id_col, text_col).crossJoin(F.broadcast(sums))
    tokens, train_tokens = F.col("n_words") + 1, F.col("train_words") + end
    types = F.col("train_types") + int(end > 0)
    return rows.select(
        "doc_id", held_out("doc_id").alias("held_out"), tokens.alias("n_tokens"),
        (F.col("known_words") + int(end > 0)).alias("n_known"), train_tokens.alias("train_tokens"),
        (F.col("count_logs") + math.log10(end + 1) - tokens * F.log10((train_tokens + types + 1).cast("double"))).alias("base_score"),
        "score", (-F.col("score") * math.log2(10) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )


def op10_context_tree_scores(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
