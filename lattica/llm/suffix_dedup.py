"""Operator 1, suffix-array dedup by a distributed, common-prefix-aware merge sort.

Every byte covered by a `LENGTH`-byte string that also starts earlier is removed.  The
suffix array is sparse: only suffixes at anchors are sorted.  The anchor of a string is
the start of its least-hashed `GRAM`-byte piece (leftmost at ties), which depends on the
string alone, so equal strings have their anchors at the same offset and each anchor
answers for one run of consecutive string starts.

1. Map: a run of texts (`RUN_BYTES`) yields its anchors with the bytes to the right, as
   far as its strings reach, and to the left.  Equal contexts inside the run (compared byte
   by byte) are settled at once, as a combiner does: only the earliest moves on.  The rest is sorted by suffix and front-coded
   (length of the prefix shared with the predecessor, and the remaining bytes).
2. Exchange: the sorted runs go to buckets by the hash of the anchor's piece.  Buckets
   grow in number with the corpus (`BUCKET_BYTES`), so that a task holds a bounded part.
   Pieces with very many different contexts (a line that a third of all texts share) are
   found beforehand and spread over buckets by what their strings have in common.
3. Reduce: contexts without any partner are dropped, the runs are combined by a loser tree
   that carries common prefix lengths and compares bytes only beyond them, and the merged
   order with its prefix lengths names the class of every suffix prefix; the reversed left
   contexts are ranked likewise.  A string is a pair of such classes; all but the earliest
   of a pair are repeats, and an anchor's repeats cover one interval.
4. Intervals are gathered by document and applied to its bytes.

The order of documents is by id (null first).  Edge cases: a null text is empty; texts
shorter than LENGTH lose nothing; rows that share id and text are one document (each row
is reported), rows that share only the id are ordered by a hash of their text; overlaps
within a text count; empty tables give empty results; only id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LENGTH = 100
GRAM = 24
LEFT = LENGTH - GRAM
#: Bytes of text in one sorted run and in one bucket, and buckets in a task.
RUN_BYTES = 16_000_000
BUCKET_BYTES = 2_000_000
TASK_BUCKETS = 4
#: Distinct contexts from which on a piece counts as frequent, the share of them that is
#: counted, and the sub-ranges into which frequent ones are split.
HOT_ROWS, HOT_SAMPLE, HOT_PARTS = 8192, 64, 8
_POSITION_BITS = 28

_weights = C.mix(np.arange(1, 4 * LENGTH + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)) | np.uint64(1)


def _row_hash(*parts: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of each row of byte matrices side by side, column by column."""
    h, k = np.zeros(len(parts[0]), np.uint64), salt
    for m in parts:
        for column in m.T if m.ndim > 1 else (m,):
            h += C.BYTE_VALUE[column] * _weights[k]
            k += 1
    return C.mix(h)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, anchor, first and last start of the strings that it answers for, hash of
    the anchor's piece, hash of pieces at both ends of its context)."""
    n = len(data)
    none = (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    if n < LENGTH:
        return none
    prefix = C.prefix_hash(C.BYTE_VALUE[data])
    _, down = C.powers(n)
    v = C.mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: n - GRAM + 1])
    pieces = v
    bits = max(_POSITION_BITS, n.bit_length())
    v = v & ~np.uint64((1 << bits) - 1)
    v |= np.arange(len(v), dtype=np.uint64)
    width, m = 1, v
    while 2 * width <= LEFT + 1:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = LEFT + 1 - width
    m = np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
    at = (m & np.uint64((1 << bits) - 1)).astype(np.int64)  # anchor of each string start
    sizes = np.diff(offsets)
    valid = np.zeros(n + 1, np.int64)
    full = sizes >= LENGTH
    np.add.at(valid, offsets[:-1][full], 1)
    np.add.at(valid, offsets[1:][full] - LENGTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[:-1])[: len(at)] > 0)
    at = at[starts]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    doc = np.searchsorted(offsets, starts[first], "right") - 1
    at, lo, hi = at[first], starts[first], starts[last]
    ends = C.mix(pieces[hi + LEFT] + np.uint64(3) * pieces[lo] + (hi - at).astype(np.uint64) * np.uint64(LENGTH) + (at - lo).astype(np.uint64))
    return doc, at, lo, hi, pieces[at], ends


def contexts(data: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Right bytes (rows, LENGTH), reversed left bytes (rows, LEFT) and both lengths."""
    r, n_left = (hi + LENGTH - at).astype(np.int64), (at - lo).astype(np.int64)
    wide = np.concatenate((np.zeros(LEFT, np.uint8), data, np.zeros(LENGTH, np.uint8)))
    right = np.lib.stride_tricks.sliding_window_view(wide, LENGTH)[at + LEFT].copy()
    left = np.lib.stride_tricks.sliding_window_view(wide, LEFT)[at][:, ::-1].copy()
    right[np.arange(LENGTH) >= r[:, None]] = 0
    left[np.arange(LEFT) >= n_left[:, None]] = 0
    return right, left, r.astype(np.uint8), n_left.astype(np.uint8)


def shared_prefix(m: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it."""
    out = np.zeros(len(m), np.int64)
    if len(m) > 1:
        differ = m[1:] != m[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), m.shape[1])
    return out


def encode(ids: np.ndarray, doc: np.ndarray, pos: np.ndarray, right: np.ndarray, left: np.ndarray, r: np.ndarray, n_left: np.ndarray, pack) -> bytes:
    """One front-coded sorted run; `ids` (documents, 2) are the keys that `doc` refers to."""
    used, own = np.unique(doc, return_inverse=True)
    lcp = shared_prefix(right).astype(np.uint8)
    column = np.arange(LENGTH)
    tails = right[(column >= lcp[:, None]) & (column < r[:, None])]
    lefts = left[np.arange(LEFT) < n_left[:, None]]
    head = np.array([len(used), len(doc), len(tails), len(lefts)], np.int64)
    narrow = own.astype(np.uint16 if len(used) < 65536 else np.uint32)
    body = [head, ids[used], pos.astype(np.int64 if len(pos) and pos.max() >> 32 else np.uint32), narrow, lcp, r, n_left, tails, lefts]
    return bytes([int(body[2].itemsize)]) + pack(b"".join(np.ascontiguousarray(x).tobytes() for x in body))


def decode(blob: bytes, unpack) -> tuple[np.ndarray, ...]:
    raw = unpack(blob[1:])
    at = 32
    n_docs, n, n_tails, n_lefts = np.frombuffer(raw, np.int64, 4).tolist()

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    ids = take(np.int64, 2 * n_docs).reshape(-1, 2)
    pos = take(np.uint32 if blob[0] == 4 else np.int64, n).astype(np.int64)
    own = take(np.uint16 if n_docs < 65536 else np.uint32, n)
    lcp, r, n_left = (take(np.uint8, n) for _ in range(3))
    column = np.arange(LENGTH)
    right = np.zeros((n, LENGTH), np.uint8)
    right[(column >= lcp[:, None]) & (column < r[:, None])] = take(np.uint8, n_tails)
    source = np.where(column >= lcp[:, None], np.arange(n, dtype=np.int32)[:, None], np.int32(0))
    np.maximum.accumulate(source, axis=0, out=source)
    right = np.take_along_axis(right, source, 0)
    left = np.zeros((n, LEFT), np.uint8)
    left[np.arange(LEFT) < n_left[:, None]] = take(np.uint8, n_lefts)
    return ids[own], pos, right, left, r, n_left, lcp.astype(np.int64)


def loser_tree(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs of strings of one length with their shared prefixes.  Returns the
    run of each output, its place in the run and the prefix it shares with its predecessor.
    Every contender knows how far it agrees with the last output; two contenders that agree
    with it to different lengths are ordered by these lengths alone, and bytes are compared
    only beyond a common length."""
    k = 1
    while k < len(runs):
        k *= 2
    strings = [s for s, _ in runs] + [[]] * (k - len(runs))
    shared = [p for _, p in runs] + [[]] * (k - len(runs))
    sizes = [len(s) for s in strings]
    place = [0] * k
    agree = [0 if sizes[j] else -1 for j in range(k)]  # with the last output; -1: run is spent
    current = [s[0] if s else b"" for s in strings]

    def beats(a: int, b: int) -> bool:
        x, y = agree[a], agree[b]
        if x != y:
            return x > y
        if x < 0:
            return True
        s, t = current[a], current[b]
        if s == t:
            agree[b if a < b else a] = len(s)
            return a < b
        d = int.from_bytes(s[x:]) ^ int.from_bytes(t[x:])
        m = len(s) - (d.bit_length() + 7) // 8
        if s < t:
            agree[b] = m
            return True
        agree[a] = m
        return False

    loser = [0] * (2 * k)
    winner = [0] * (2 * k)
    for j in range(k):
        winner[k + j] = j
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (a, b) if beats(a, b) else (b, a)
    top = winner[1]
    out_run, out_place, out_lcp = [], [], []
    while agree[top] >= 0:
        at = place[top]
        out_run.append(top)
        out_place.append(at)
        out_lcp.append(agree[top])
        at += 1
        place[top] = at
        if at < sizes[top]:
            agree[top], current[top] = shared[top][at], strings[top][at]
        else:
            agree[top] = -1
        node = (top + k) >> 1
        while node:
            other = loser[node]
            x, y = agree[top], agree[other]
            if x < y or (x == y and not beats(top, other)):
                loser[node], top = top, other
            node >>= 1
    return out_run, out_place, out_lcp


def _partnered(right: np.ndarray, left: np.ndarray, r: np.ndarray, n_left: np.ndarray) -> np.ndarray:
    """Whether a context can share a string with another: a string reaches HALF bytes to the
    right of its anchor, or else it reaches beyond LENGTH - HALF bytes to its left."""
    half = (LENGTH + GRAM) // 2
    back = LENGTH - half + 1
    ok = np.zeros(len(r), bool)
    for rows, h in ((np.flatnonzero(r >= half), lambda i: _row_hash(right[i, :half])), (np.flatnonzero(n_left >= back), lambda i: _row_hash(left[i, :back], right[i, :GRAM], salt=LENGTH))):
        if len(rows):
            _, inverse, n = np.unique(h(rows), return_inverse=True, return_counts=True)
            ok[rows[n[inverse] > 1]] = True
    return ok


def repeats(runs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of documents (rows, 2), start and end of intervals covered by repeats, from the
    decoded runs of one bucket."""
    key, pos, right, left, r, n_left = (np.concatenate([x[j] for x in runs]) for j in range(6))
    origin = np.repeat(np.arange(len(runs)), [len(x[1]) for x in runs])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    keep = np.flatnonzero(_partnered(right, left, r, n_left))
    # equal contexts in different runs: all but the earliest are repeats as a whole
    if len(keep):
        whole = _row_hash(right[keep], left[keep], r[keep], n_left[keep])
        order = np.lexsort((pos[keep], key[keep, 1], key[keep, 0], whole))
        again, twice = repeated(whole[order], keep[order], right, left, r, n_left, key, pos)
        gone = keep[order[again & ~twice]]
        found.append((key[gone], pos[gone] - n_left[gone], pos[gone] + r[gone]))
        keep = np.sort(keep[order[~again]])
    if len(keep) > 1:
        parts, rows = [], []
        lcp = np.concatenate([x[6] for x in runs])
        for k in range(len(runs)):
            own = keep[origin[keep] == k]
            if len(own):  # a prefix shared across dropped rows is the least one between
                ends = np.column_stack((np.append(own[0], own[:-1] + 1), own + 1)).ravel()
                low = np.minimum.reduceat(lcp, ends[ends < len(lcp)])
                raw = right[own].tobytes()
                parts.append(([raw[a : a + LENGTH] for a in range(0, len(raw), LENGTH)], [0, *low[::2][1:].tolist()]))
                rows.append(own)
        run, place, agree = loser_tree(parts)
        base = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
        flat = np.concatenate(rows)
        at = flat[base[np.array(run)] + np.array(place)]  # merged suffix order
        suffix_lcp = np.array(agree)
        back_order = np.argsort(np.ascontiguousarray(left[at]).view(f"S{LEFT}").ravel(), kind="stable")
        left_lcp = shared_prefix(left[at][back_order])
        reach, back = r[at].astype(np.int64), n_left[at].astype(np.int64)
        rank = np.lexsort((pos[at], key[at, 1], key[at, 0]))  # earliest first
        most, least = np.full(len(at), -1), np.full(len(at), LENGTH)
        left_class = np.empty(len(at), np.int64)
        for a in range(LEFT + 1):  # strings that start `a` bytes before their anchor
            right_class = np.cumsum(suffix_lcp < LENGTH - a)
            left_class[back_order] = np.cumsum(left_lcp < a)
            mine = rank[((back >= a) & (reach >= LENGTH - a))[rank]]
            if len(mine) < 2:
                continue
            pair = left_class[mine] * (len(at) + 1) + right_class[mine]
            order = np.argsort(pair, kind="stable")
            again = np.zeros(len(mine), bool)
            again[1:] = pair[order][1:] == pair[order][:-1]
            hit = mine[order[again]]
            most[hit] = a
            least[hit] = np.minimum(least[hit], a)
        hit = np.flatnonzero(most >= 0)
        p = pos[at[hit]]
        found.append((key[at[hit]], p - most[hit], p - least[hit] + LENGTH))
    if not found:
        return np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def repeated(whole: np.ndarray, at: np.ndarray, right: np.ndarray, left: np.ndarray, r: np.ndarray, n_left: np.ndarray, key: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For contexts `at`, sorted by hash and place: whether one equals its predecessor, and
    whether it is the very same place (a row that the table holds twice).  Hashes only bring
    candidates together; the bytes decide, and what they part goes on to the merge."""
    again = np.zeros(len(at), bool)
    maybe = np.flatnonzero(whole[1:] == whole[:-1]) + 1
    for k in range(0, len(maybe), 1 << 15):
        i = maybe[k : k + (1 << 15)]
        a, b = at[i], at[i - 1]
        again[i] = (r[a] == r[b]) & (n_left[a] == n_left[b]) & (right[a] == right[b]).all(1) & (left[a] == left[b]).all(1)
    twice = again.copy()
    twice[1:] &= (key[at[1:]] == key[at[:-1]]).all(1) & (pos[at[1:]] == pos[at[:-1]])
    return again, twice


def merged(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of a document that touch or overlap become one."""
    if not len(start):
        return key, start, end
    order = np.lexsort((start, key[:, 1], key[:, 0]))
    key, start, end = key[order], start[order], end[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (key[1:] != key[:-1]).any(1)
    owner = np.cumsum(fresh) - 1
    span = int(end.max()) + 1
    top = np.maximum.accumulate(end + owner * span) - owner * span  # ends so far, by document
    new = fresh.copy()
    new[1:] |= start[1:] > top[:-1]
    first = np.flatnonzero(new)
    return key[first], start[first], top[np.append(first[1:], len(start)) - 1]


def _span_blob(key, start, end, pack) -> bytes:
    """Intervals that are settled already; their first byte is 0, that of a run is not."""
    return b"\0" + pack(np.column_stack((key, start, end)).astype(np.int64).tobytes())


def frequent_pieces(keyed: DataFrame, total: int, rows: int = HOT_ROWS) -> np.ndarray:
    """Sorted hashes of the pieces whose anchors have about `rows` distinct contexts or more
    (estimated from the contexts that hash to one in HOT_SAMPLE, over all documents).  The
    limit rises with the corpus, so that the list stays under a million."""

    def run(batches):
        for batch in batches:
            data, offsets = C.buffers(batch.column(2))
            for a, b in C.doc_chunks(offsets):
                *_, piece, ends = anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                own = ends % np.uint64(HOT_SAMPLE) == 0
                pairs = np.unique(np.column_stack((piece[own], ends[own])).view(np.int64), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, j])) for j in range(2)], names=["p", "e"])

    least = max(rows, total // 40_000_000) / HOT_SAMPLE
    found = keyed.mapInArrow(run, "p long, e long").distinct().groupBy("p").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r.p for r in found.orderBy(F.desc("n"), "p").limit(1 << 20).select("p").collect()], np.int64).view(np.uint64))


def split_ranges(right, left, r, n_left, piece, buckets: int):
    """Contexts of frequent pieces by sub-ranges of their strings' starts: what all strings
    of a sub-range have in common decides the bucket, so one piece fills many buckets.
    Yields (rows, right, left, r, n_left, bucket)."""
    width = -(-(LEFT + 1) // HOT_PARTS)
    for a0 in range(0, LEFT + 1, width):
        a1 = min(a0 + width - 1, LEFT)
        own = np.flatnonzero((n_left >= a0) & (LENGTH - r.astype(np.int64) <= a1))
        if not len(own):
            continue
        x, y = right[own].copy(), left[own].copy()
        x[:, LENGTH - a0 :] = 0
        y[:, a1:] = 0
        core = _row_hash(x[:, : LENGTH - a1], y[:, :a0], salt=LENGTH)
        bucket = (C.mix(core ^ piece[own] + np.uint64(a0)) % np.uint64(buckets)).astype(np.int64)
        yield own, x, y, np.minimum(r[own], LENGTH - a0).astype(np.uint8), np.minimum(n_left[own], a1).astype(np.uint8), bucket


def _runs(buckets: int, run_bytes: int, frequent):
    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        held, ids, size = [], [], 0

        def flush():
            table = np.concatenate(ids)
            doc, pos, right, left, r, n_left, piece = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            ids.clear()
            hot = frequent.value
            many = hot[np.minimum(np.searchsorted(hot, piece), len(hot) - 1)] == piece if len(hot) else np.zeros(len(piece), bool)
            parts = []
            for own, split in ((np.flatnonzero(~many), False), (np.flatnonzero(many), True)):
                if not len(own):
                    continue
                x = (right, left, r, n_left, piece) if len(own) == len(piece) else (right[own], left[own], r[own], n_left[own], piece[own])
                if split:
                    parts += [(own[rows], *rest) for rows, *rest in split_ranges(*x, buckets)]
                else:
                    parts.append((own, *x[:4], (C.mix(x[4]) % np.uint64(buckets)).astype(np.int64)))
            del right, left, r, n_left, x
            out_bucket, out_blob, settled = [], [], []
            while parts:
                own, right, left, r, n_left, bucket = parts.pop()
                d, p = doc[own], pos[own]
                whole = _row_hash(right, left, r, n_left)
                order = np.lexsort((p, table[d, 1], table[d, 0], whole))
                again, twice = repeated(whole[order], order, right, left, r, n_left, table[d], p)
                gone, keep = order[again & ~twice], order[~again]
                settled.append((table[d[gone]], p[gone] - n_left[gone], p[gone] + r[gone]))
                by = np.argsort(right[keep].view(f"S{LENGTH}").ravel(), kind="stable")
                keep = keep[by[np.argsort(bucket[keep[by]], kind="stable")]]
                d, p, right, left, r, n_left, bucket = (x[keep] for x in (d, p, right, left, r, n_left, bucket))
                cuts = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(bucket))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    o = slice(a, b)
                    out_bucket.append(int(bucket[a]))
                    out_blob.append(encode(table, d[o], p[o], right[o], left[o], r[o], n_left[o], pack))
            spans = merged(*(np.concatenate(x) for x in zip(*settled, strict=True)))
            if len(spans[1]):
                out_bucket.append(int(C.mix(piece[:1])[0] % np.uint64(buckets)))
                out_blob.append(_span_blob(*spans, pack))
            return pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int64()), pa.array(out_blob, pa.binary())], names=["bucket", "run"])

        docs = 0
        for batch in batches:
            own = np.column_stack((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            data, offsets = C.buffers(batch.column(2))
            for a, b in C.doc_chunks(offsets, min(C.CHUNK_BYTES, run_bytes)):
                piece, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                doc, at, lo, hi, gram, _ = anchors(piece, cuts)
                if len(doc):
                    held.append((doc + docs, at - cuts[doc], *contexts(piece, at, lo, hi), gram))
                ids.append(own[a:b])
                docs += b - a
                size += len(piece)
                if size >= run_bytes:
                    if held:
                        yield flush()
                    ids.clear()
                    docs = size = 0
        if held:
            yield flush()

    return run


def _merge(batches):
    from .neardup import bounds_of, whole_groups

    unpack = zstandard.ZstdDecompressor().decompress
    for table in whole_groups(batches, 1):
        cuts = bounds_of(table, 1)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            blobs = table.column(1).slice(a, b - a).to_pylist()
            out = [np.frombuffer(unpack(x[1:]), np.int64).reshape(-1, 4) for x in blobs if not x[0]]
            runs = [decode(x, unpack) for x in blobs if x[0]]
            if runs:
                key, start, end = merged(*repeats(runs))
                out.append(np.column_stack((key, start, end)))
            rows = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, j])) for j in range(4)], names=["id", "th", "s", "e"])


def _apply(batches):
    for batch in batches:
        data, offsets = C.buffers(batch.column(1))
        spans = batch.column(2).to_pylist()
        removed, n_spans, sha = [], [], []
        for i, own in enumerate(spans):
            a, b = int(offsets[i]), int(offsets[i + 1])
            digest, at, gone, n = hashlib.sha256(), 0, 0, 0
            text = memoryview(data[a:b])
            for x in own or ():
                s, e = x["s"], x["e"]
                if n and s <= at:  # continues the run before it
                    if e > at:
                        gone, at = gone + e - at, e
                    continue
                digest.update(text[at:s])
                gone, at, n = gone + e - s, e, n + 1
            digest.update(text[at:])
            removed.append(gone)
            n_spans.append(n)
            sha.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "sha"])


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", run_bytes: int = RUN_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows (id, th, spans): the covered intervals of each document that has any; th is the
    hash of its text."""
    keyed = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("th"), F.col(text).cast("string").alias("text")).where(F.octet_length("text") >= LENGTH)
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_pieces(keyed, total, hot_rows))
    runs = keyed.mapInArrow(_runs(buckets, run_bytes, frequent), "bucket long, run binary")
    # so many partitions that a task's part stays the same at any size
    spans = runs.repartition(-(-buckets // TASK_BUCKETS), "bucket").sortWithinPartitions("bucket").mapInArrow(_merge, "id long, th long, s long, e long")
    return spans.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))


def suffix_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", run_bytes: int = RUN_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows (__id, n_bytes, n_removed, n_spans, sha), one per document."""
    with C.released_shuffles(docs.sparkSession):  # the runs need disk until the intervals are written
        spans = C.shared_table(repeated_spans(docs, id, text, run_bytes, hot_rows))
    rows = docs.select(F.col(id).alias("__id"), F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("th"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = rows.select(F.col("__id").alias("id")).schema["id"].dataType.simpleString()
    joined = rows.join(spans, ["id", "th"], "left").select("__id", "text", "spans")
    return joined.mapInArrow(_apply, f"id {kind}, n_bytes long, n_removed long, n_spans long, sha string").withColumnRenamed("id", "__id")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(C.table(spark, sf_dir, "documents"))
    return found.select(F.col("__id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.col("sha").alias("kept_sha256"))


#: A byte is covered if a repeated string starts at it or at one of the 99 bytes before it.
SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT r, unnest(range(1, octet_length(b) + 1)) AS p, b FROM d),
g AS (SELECT r, p, hex(b[p : p]) AS x, CASE WHEN p + {LENGTH - 1} <= octet_length(b) THEN md5(b[p : p + {LENGTH - 1}]) END AS g FROM s),
f AS (SELECT r, p, x, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY r, p) > 1 AS again FROM g),
c AS (SELECT r, p, x, coalesce(max(CASE WHEN again THEN p END) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) > p - {LENGTH}, false) AS gone FROM f),
o AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY p), false) AS new FROM c),
k AS (SELECT r, count(*) AS n, count(*) FILTER (gone) AS gone, count(*) FILTER (new) AS spans, string_agg(x, '' ORDER BY p) FILTER (NOT gone) AS kept FROM o GROUP BY r)
SELECT doc_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_bytes, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k.kept, ''))) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r
"""
