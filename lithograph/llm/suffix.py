"""Suffix-array deduplication: byte strings that already start in an earlier document.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with
a smaller id.

1.  Of each ``length``-byte window the smallest hashed ``gram`` is its anchor, so equal
    windows have equal anchors at equal offsets, and one anchor serves a run of windows.
    How many texts hold each anchor is counted over the corpus (``chunks``); windows whose
    anchor is in one text only are finished.
2.  The other windows are sent, as runs of bytes, to the bucket of their anchor's hash.
    Windows under an anchor of very many places go to the bucket of their own hash instead,
    once for each chunk, so that no bucket gathers a third of the corpus.
3.  A bucket sorts its suffixes by a merge sort that compares two of them by binary search
    for their longest common extension over prefix polynomial hashes.  Neighbours of equal
    hash are verified byte by byte.  The smallest id among equal suffixes decides.

Defined results
    * null text: no bytes; texts shorter than ``length`` lose nothing;
    * equal texts: all but those with the smallest id lose every byte;
    * rows that repeat an id are no smaller than each other; a null id is larger than all;
    * extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithograph.llm import chunks as C

#: Bytes of an anchor.
GRAM = 24
#: An anchor with so many places or more is split by window.
HOT = 4096
#: Suffixes sorted at once, bytes of text in a chunk and of runs in a bucket, about.
SORT_WINDOWS = 150_000
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 4 << 20

NO_ID = np.iinfo(np.int64).max

TEXTS_SCHEMA = "sha binary, min_id long, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary"


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """prefix[i]: polynomial hash of the first i bytes."""
    out = np.zeros(len(raw) + 1, np.uint64)
    for lo in range(0, len(raw), C.SLAB):  # in place: eight bytes for each
        part = out[lo + 1 : lo + 1 + C.SLAB]
        part[:] = raw[lo : lo + C.SLAB]
        part += np.uint64(1)
        part *= C.slab_powers(C.BASE)[: len(part)]
        if lo:
            part *= np.uint64(pow(C.BASE, lo, 1 << 64))
    return np.cumsum(out, out=out)


class Suffixes:
    """Suffixes of a byte buffer, compared up to ``length`` bytes."""

    def __init__(self, raw: np.ndarray, length: int):
        self.raw, self.length = raw, length
        self.prefix = prefix_hashes(raw)
        self.inverse = C.powers(C.BASE_INVERSE, len(raw) + 1)

    def hashes(self, at: np.ndarray, n) -> np.ndarray:
        return (self.prefix[at + n] - self.prefix[at]) * self.inverse[at]

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.hashes(a, self.length) == self.hashes(b, self.length)

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a < b; binary search for the longest common extension, then the byte after it."""
        out = np.zeros(len(a), bool)
        differ = np.flatnonzero(~self.equal(a, b))
        a, b = a[differ], b[differ]
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), self.length - 1)
        while len(a) and (lo < hi).any():  # the extension is in lo..hi
            mid = (lo + hi + 1) // 2
            same = self.hashes(a, mid) == self.hashes(b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        out[differ] = self.raw[a + lo] < self.raw[b + lo]
        return out

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of suffixes ``at`` by group, then by bytes: a bottom-up merge sort of all groups at once."""
        order = np.argsort(group, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0]))
        size = np.diff(np.concatenate([begin, [len(order)]]))
        first, size = np.repeat(begin, size), np.repeat(size, size)
        place = np.arange(len(order))
        width = 1
        while width < (size.max() if len(size) else 0):
            rank = place - first
            run = rank // width
            right = (run & 1).astype(bool)
            sibling = first + (run ^ 1) * width
            stop = np.minimum(sibling + width, first + size)
            live = np.flatnonzero(sibling < stop)
            lo, hi = sibling[live], stop[live]
            mine = at[order][live]
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) // 2
                other = at[order[mid]]
                # Elements of the right run come after equal ones of the left run.
                after = np.where(right[live[open_]], ~self.less(mine[open_], other), self.less(other, mine[open_]))
                lo[open_] = np.where(after, mid + 1, lo[open_])
                hi[open_] = np.where(after, hi[open_], mid)
            target = place.copy()
            own = first[live] + (run[live] & ~1) * width + (rank[live] - run[live] * width)
            target[live] = own + (lo - sibling[live])
            moved = np.empty_like(order)
            moved[target] = order
            order = moved
            width *= 2
        return order

    def classes(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Equal numbers for suffixes of one group with the same ``length`` bytes."""
        order = self.sort(at, group)
        sorted_at, sorted_group = at[order], group[order]
        same = (sorted_group[1:] == sorted_group[:-1]) & self.equal(sorted_at[1:], sorted_at[:-1])
        strings = np.lib.stride_tricks.sliding_window_view(self.raw, self.length)
        for lo in range(0, len(same), 10_000):
            pairs = lo + np.flatnonzero(same[lo : lo + 10_000])
            exact = (strings[sorted_at[pairs]] == strings[sorted_at[pairs + 1]]).all(axis=1)
            same[pairs[~exact]] = False
            if not exact.all():  # different strings with one hash: give up hashes here
                return np.unique(np.concatenate([group[:, None].view(np.uint8).reshape(-1, 8), strings[at]], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
        out = np.empty(len(at), np.int64)
        out[order] = np.cumsum(np.concatenate([[0], ~same]))[: len(at)]
        return out


def anchor_kind(totals: np.ndarray) -> np.ndarray:
    """0: in one text only; 1: in several; 2: in so many places that its windows go by their own hash.

    totals: places in the upper bits, texts in the lower 16, which cannot overflow below HOT.
    """
    return np.where(totals >> 16 >= HOT, 2, (totals & 0xFFFF) >= 2).astype(np.uint8)


class Runs:
    """The anchors of a chunk's texts, each with the run of windows that it serves."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        gaps = np.cumsum([0, *(len(t) for t in texts)])
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        parts = [np.empty((0, 4), np.int64)]
        hashes = [np.empty(0, np.uint64)]
        for i, text in enumerate(texts):  # long texts in pieces that overlap by length - 1
            for at in range(0, max(1, len(text) - length + 1), C.BLOCK_BYTES):
                if len(text) >= length:
                    parts.append(np.array([[i, gaps[i] + at, gaps[i] + min(len(text), at + C.BLOCK_BYTES + length - 1), 0]]))
        pieces = np.concatenate(parts)
        self.offset = gaps[:-1]
        owner, start, count, anchor = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        lo = 0
        while lo < len(pieces):
            hi = lo + 1
            while hi < len(pieces) and pieces[hi, 2] - pieces[lo, 1] <= C.BLOCK_BYTES and pieces[hi, 1] >= pieces[hi - 1, 2]:
                hi += 1
            base, end = int(pieces[lo, 1]), int(pieces[hi - 1, 2])
            block = self.raw[base:end]
            prefix = prefix_hashes(block)
            grams = C.mix((prefix[GRAM:] - prefix[:-GRAM]) * C.powers(C.BASE_INVERSE, len(block) - GRAM + 1))
            least = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
            span, held = length - GRAM + 1, 1
            while held * 2 <= span:
                least = np.minimum(least[:-held], least[held:])
                held *= 2
            if held < span:
                least = np.minimum(least[: len(least) - (span - held)], least[span - held :])
            at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
            counts = pieces[lo:hi, 2] - pieces[lo:hi, 1] - length + 1
            piece = np.repeat(np.arange(lo, hi), counts)
            window = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + pieces[piece, 1] - base
            at = at[window]
            fresh = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])]))
            owner.append(pieces[piece[fresh], 0])
            start.append(window[fresh] + base)
            count.append(np.diff(np.concatenate([fresh, [len(at)]])))
            anchor.append(at[fresh] + base)
            hashes.append(grams[at[fresh]])
            lo = hi
        self.owner, self.start, self.count, self.anchor = (np.concatenate(x) for x in (owner, start, count, anchor))
        self.hash = np.concatenate(hashes)

    def window_hashes(self, start: np.ndarray) -> np.ndarray:
        prefix = prefix_hashes(self.raw)
        return C.mix((prefix[start + self.length] - prefix[start]) * C.power_at(C.BASE_INVERSE, start))


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. (count[0] of them), start[1], .."""
    return np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)


def run_hashes(raw: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A polynomial hash of each run of bytes, some thousand runs at a time."""
    out, table = np.empty(len(place), np.uint64), C.powers(C.BASE, int(size.max(initial=1)))
    for lo in range(0, len(place), 5_000):
        some = slice(lo, lo + 5_000)
        first = np.cumsum(size[some]) - size[some]
        values = raw[ragged(place[some], size[some])].astype(np.uint64) + np.uint64(1)
        values *= table[ragged(np.zeros(len(first), np.int64), size[some])]
        out[some] = np.add.reduceat(values, first)
    return out


def _first_equal(raw, key, id_, rel, count, place, length: int) -> np.ndarray:
    """For each run the equal run (key, offset and all bytes) of the smallest id, itself if there is none.

    Copies of one passage are sorted once this way, however many there are.
    """
    size = count + length - 1
    whole = run_hashes(raw, place, size)
    order = np.lexsort((id_, whole, count, rel, key))
    fresh = np.ones(len(order), bool)
    for column in (key, rel, count, whole):
        fresh[1:] &= column[order][1:] == column[order][:-1]
    fresh[1:] = ~fresh[1:]
    first = np.empty(len(order), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    copies = np.flatnonzero(first != np.arange(len(first)))
    for lo in range(0, len(copies), 5_000):
        some = copies[lo : lo + 5_000]
        equal = raw[ragged(place[some], size[some])] == raw[ragged(place[first[some]], size[some])]
        exact = np.logical_and.reduceat(equal, np.cumsum(size[some]) - size[some])
        first[some[~exact]] = some[~exact]
    return first


def suffix_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per distinct text: removed byte intervals [start, end) in the document with its smallest id, and what is kept there."""
    total = C.corpus_bytes(docs, text_col)
    texts = C.distinct_texts(docs, total, id_col, text_col, chunk_bytes=CHUNK_BYTES)
    keys = C.Keys(total // 12 + 1, growth=C.growth(total))
    buckets = max(1, math.ceil(total / (BUCKET_BYTES * C.growth(total))))

    def anchors(chunk: C.Chunk):
        runs = Runs(chunk.texts, length)
        cut = keys.cut(runs.hash)
        order = np.lexsort((runs.owner, cut))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(cut[order]) != 0) | (np.diff(runs.owner[order]) != 0)
        distinct, counts = np.unique(cut[order][fresh], return_counts=True)
        places = np.diff(np.concatenate([np.searchsorted(cut[order], distinct), [len(cut)]]))
        return runs, cut, distinct, (np.minimum(places, 0xFFFF) << 16) | np.minimum(counts, 0xFFFF)

    def ask(table: pa.Table) -> pa.Table:
        chunk = C.Chunk(table)
        _, _, distinct, counts = anchors(chunk)
        out = C.request_table(keys.requests(chunk.number, distinct, counts.astype(np.uint32)))
        C.release()
        return out

    def entries(chunk: C.Chunk, classes: np.ndarray):
        """What a chunk sends: key, id, offset of the first window from the key's place, windows, where they start.

        Also places of windows that are settled here (an earlier document of the chunk has them), and
        places that share the answer of an entry (the same document, or one of the same id).
        """
        runs, cut, distinct, _ = anchors(chunk)
        ids = np.array([NO_ID if i is None else i for i in chunk.ids], np.int64)
        kind = classes[np.searchsorted(distinct, cut)] if len(cut) else np.empty(0, np.uint8)
        some, hot = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
        key, id_, rel, count, start = runs.hash[some], ids[runs.owner[some]], runs.start[some] - runs.anchor[some], runs.count[some], runs.start[some]
        late = follow = entry = np.empty(0, np.int64)
        if len(hot):
            at = ragged(runs.start[hot], runs.count[hot])
            own = np.repeat(ids[runs.owner[hot]], runs.count[hot])
            window = runs.window_hashes(at)
            order = np.lexsort((at, own, window))
            at, own, window = at[order], own[order], window[order]
            lead = np.maximum.accumulate(np.where(np.concatenate([[True], window[1:] != window[:-1]]), np.arange(len(at)), 0))
            strings = np.lib.stride_tricks.sliding_window_view(runs.raw, length)
            same = np.concatenate([(strings[at[lo : lo + 10_000]] == strings[at[lead[lo : lo + 10_000]]]).all(axis=1) for lo in range(0, len(at), 10_000)])
            copy = same & (lead != np.arange(len(at)))
            late = at[copy & (own > own[lead])]
            sent = np.flatnonzero(~copy)
            shared = np.flatnonzero(copy & (own == own[lead]))
            follow, entry = at[shared], len(key) + np.searchsorted(sent, lead[shared])
            key, id_, start = np.concatenate([key, window[sent]]), np.concatenate([id_, own[sent]]), np.concatenate([start, at[sent]])
            rel, count = np.concatenate([rel, np.full(len(sent), 1)]), np.concatenate([count, np.ones(len(sent), np.int64)])
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return runs, bucket[order], key[order], id_[order], rel[order], count[order], start[order], late, follow, place[entry]

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return C.request_table([])
        chunk = C.Chunk(table)
        runs, bucket, key, id_, rel, count, start, *_ = entries(chunk, C.join_answers(answers, np.uint8))
        edges = np.flatnonzero(np.diff(bucket)) + 1
        rows = []
        for lo, hi in zip([0, *edges], [*edges, len(bucket)]) if len(bucket) else ():
            bytes_ = runs.raw[ragged(start[lo:hi], count[lo:hi] + length - 1)]
            rows.append((int(bucket[lo]), chunk.number, hi - lo, b"".join(x.tobytes() for x in (key[lo:hi], id_[lo:hi], rel[lo:hi].astype(np.int16), count[lo:hi].astype(np.uint16), bytes_))))
        del runs, bucket, key, id_, rel, count, start
        C.release()
        return C.request_table(rows)

    def decide(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        sizes, payloads = table["n"].to_pylist(), [p.as_buffer() for p in table["payload"]]
        part: dict[str, list] = {k: [] for k in ("key", "id", "rel", "count", "raw")}
        for n, p in zip(sizes, payloads):
            part["key"].append(np.frombuffer(p, np.uint64, n))
            part["id"].append(np.frombuffer(p, np.int64, n, 8 * n))
            part["rel"].append(np.frombuffer(p, np.int16, n, 16 * n))
            part["count"].append(np.frombuffer(p, np.uint16, n, 18 * n))
            part["raw"].append(np.frombuffer(p, np.uint8, -1, 20 * n))
        key, id_, rel, count, raw = (np.concatenate(part[k]) for k in ("key", "id", "rel", "count", "raw"))
        table = table.select(["chunk", "bucket"])
        del part, payloads, p
        rel, count = rel.astype(np.int64), count.astype(np.int64)
        place = np.cumsum(count + length - 1) - (count + length - 1)
        answer_at = np.cumsum(count) - count
        gone = np.zeros(int(count.sum()), bool)
        first = _first_equal(raw, key, id_, rel, count, place, length)
        order = np.flatnonzero(first == np.arange(len(key)))
        order = order[np.argsort(key[order], kind="stable")]
        group = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        several = np.bincount(group)[group] > 1
        order, group = order[several], group[several]
        done, reach = 0, np.cumsum(count[order])
        while done < len(order):
            base = reach[done - 1] if done else 0
            stop = max(done + 1, int(np.searchsorted(reach, base + SORT_WINDOWS, "right")))
            while stop < len(order) and group[stop] == group[stop - 1]:
                stop += 1
            own = order[done:stop]
            size = count[own]
            held = Suffixes(raw[ragged(place[own], size + length - 1)], length)
            at = ragged(np.cumsum(size + length - 1) - (size + length - 1), size)
            offset = ragged(rel[own], size)
            same_place = np.repeat(group[done:stop] - group[done], size) * 4096 + offset + 2048
            label = held.classes(at, same_place)
            ids = np.repeat(id_[own], size)
            least = np.full(int(label.max()) + 1, NO_ID)
            np.minimum.at(least, label, ids)
            gone[ragged(answer_at[own], size)] = least[label] < ids
            done = stop
        # Runs equal to one of a smaller id go whole; those of the same id share its answer.
        later = np.flatnonzero(id_ > id_[first])
        gone[ragged(answer_at[later], count[later])] = True
        again = np.flatnonzero((id_ == id_[first]) & (first != np.arange(len(key))))
        gone[ragged(answer_at[again], count[again])] = gone[ragged(answer_at[first[again]], count[again])]
        edges = np.cumsum([0, *sizes])
        windows = np.concatenate([answer_at, [len(gone)]])
        bits = pa.array([np.packbits(gone[windows[a] : windows[b]]).tobytes() for a, b in zip(edges, edges[1:])], pa.binary())
        del key, id_, rel, count, raw, gone
        C.release()
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "payload": bits})

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if table.num_rows:
            chunk = C.Chunk(table)
            rounds = answers["round"].to_numpy()
            first, last = answers.filter(pa.array(rounds == 1)), answers.filter(pa.array(rounds == 2)).sort_by("bucket")
            runs, bucket, _, _, _, count, start, late, follow, entry = entries(chunk, C.join_answers(first, np.uint8))
            windows = np.bincount(bucket, count, buckets).astype(np.int64)
            gone = [np.empty(0, bool)]
            for b, payload in zip(last["bucket"].to_pylist(), last["payload"].to_pylist()):
                gone.append(np.unpackbits(np.frombuffer(payload, np.uint8), count=int(windows[b])).astype(bool))
            every = np.concatenate(gone)
            followed = follow[every[(np.cumsum(count) - count)[entry]]]
            at = np.unique(np.concatenate([ragged(start, count)[every], late, followed]))
            first_of = np.searchsorted(at, runs.offset)
            for i, (lo, hi) in enumerate(zip(first_of, [*first_of[1:], len(at)])):
                text, own = chunk.texts[i], at[lo:hi] - runs.offset[i]
                new = np.flatnonzero(np.concatenate([[True], np.diff(own) > length])) if len(own) else own
                begin, end = own[new], np.concatenate([own[new[1:] - 1], own[-1:]]) + length
                edges = [0, *np.stack([begin, end], axis=1).reshape(-1).tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if len(own) else text
                rows.append((chunk.shas[i], chunk.ids[i], len(text), int((end - begin).sum()), begin.tolist(), end.tolist(), kept))
            del runs, bucket, count, start, late, gone, at
            C.release()
        cols = list(zip(*rows)) if rows else [[]] * 7
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        return pa.table({k: pa.array(v, t) for k, v, t in zip(("sha", "min_id", "n_bytes", "n_removed", "starts", "ends", "kept"), cols, kinds)})

    asked = texts.groupBy("chunk").applyInArrow(ask, C.REQUEST_SCHEMA)
    classes = C.answer_requests(asked, keys, anchor_kind)
    sent = texts.groupBy("chunk").cogroup(classes.groupBy("chunk")).applyInArrow(send, C.REQUEST_SCHEMA)
    decided = sent.groupBy("bucket").applyInArrow(decide, C.ANSWER_SCHEMA)
    both = classes.withColumn("round", F.lit(1)).unionByName(decided.withColumn("round", F.lit(2)))
    return texts.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(cut, TEXTS_SCHEMA)


def op7_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _per_document(docs)


def _per_document(docs: DataFrame, length: int = 50) -> DataFrame:
    texts = suffix_dedup(docs, length).select("sha", "min_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    out = C.attach(docs, texts)
    copy = F.coalesce(F.col("doc_id") > F.col("min_id"), F.col("min_id").isNotNull()) & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


ORACLE_SQL = {
    "op7_suffix_array_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, doc_id, unnest(regexp_extract_all(h, '..')) AS c, unnest(range(0, length(h) // 2)) AS i FROM d),
l AS (SELECT *, list(c) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS x FROM p),
g AS (SELECT r, doc_id, i, c, CASE WHEN len(x) = 50 THEN unhex(array_to_string(x, '')) END AS s FROM l),
a AS (SELECT s, min(doc_id) AS least FROM g WHERE s IS NOT NULL GROUP BY s HAVING count(*) > 1),
f AS (SELECT r, i, c, coalesce(least < doc_id, doc_id IS NULL AND least IS NOT NULL) AS early FROM g LEFT JOIN a ON g.s = a.s),
m AS (SELECT r, i, c, bool_or(early) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
n AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS opens FROM m),
k AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(c, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM n GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r""",
}
