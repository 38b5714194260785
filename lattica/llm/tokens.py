r"""Operator 3, token counts by rank-synchronous array merging.

Texts are cut into pre-tokens with the tokenizer's own public pattern; the distinct
pre-tokens that a worker has not met are held as one ragged numpy array of symbols.  In
each round every sequence finds its lowest-rank adjacent pair, all sequences merge their
pair at once (from left to right where occurrences overlap), and the survivors close up;
rounds end when no sequence has a known pair.  The symbols left are the tokens.

Pre-tokens of more than `LONG` bytes (a megabyte of letters is one) would take a round over all
their symbols for each rank.  They are merged with the same result from a queue of ranks: the
lowest rank that occurs comes next, all its places are merged at once, and only the pairs
beside them are looked up again.

Counts of pre-tokens are kept per worker in a table of at most `CACHE` entries that is
emptied when full, so memory is bounded and every text is counted whole.

Edge cases: null or empty text: 0 bytes, 0 tokens; a special string inside a text (as the
library does by default) counts as one token; repeated rows count alike; an empty table gives
an empty result; only id and text are read, so other columns never clash.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

LIMIT = 1024
#: Most pre-tokens whose counts a worker keeps.
CACHE = 400_000
#: Most symbols that are merged at once.
ROUND_SYMBOLS = 1_000_000
#: Bytes from which on a pre-token is merged from the queue of ranks.
LONG = 256


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies (public rule:
    printable Latin-1 bytes stand for themselves, the others count up from 256)."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class RankMerger:
    """Ranks of symbol pairs, and the merging of many sequences at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.size = max(vocab.values()) + 1
        self.byte_ids = np.array([vocab[c] for c in byte_letters()], np.int64)
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        key = left * self.size + right
        order = np.argsort(key)
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made[order]
        self.slots = np.full(1 << 19, -1, np.int32)  # open addressing by a multiplicative hash
        self.rest: dict[int, int] = {}
        slot = self._slot(self.keys)
        for step in range(8):
            todo = np.arange(len(self.keys)) if step == 0 else todo
            at = (slot[todo] + step) & (len(self.slots) - 1)
            free = self.slots[at] < 0
            _, pick = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            pick = pick[free[pick]]
            self.slots[at[pick]] = todo[pick]
            todo = np.setdiff1d(todo, todo[pick])
            self.probes = step + 1
            if not len(todo):
                break
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        if len(todo):
            raise ValueError("pair table too dense")

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair among the known pairs, or -1."""
        key = left * self.size + right
        slot = self._slot(key)
        out = np.full(len(key), -1, np.int64)
        todo = np.arange(len(key))
        for step in range(self.probes):
            got = self.slots[(slot[todo] + step) & (len(self.slots) - 1)]
            same = (got >= 0) & (self.keys[got] == key[todo])
            out[todo[same]] = got[same]
            todo = todo[~same & (got >= 0)]
            if not len(todo):
                break
        return out

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols that each piece is merged to."""
        result = np.zeros(len(pieces), np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        long = np.flatnonzero(sizes > LONG)
        if len(long):
            short = np.flatnonzero(sizes <= LONG)
            result[short] = self.counts([pieces[k] for k in short.tolist()])
            total = np.cumsum(sizes[long])
            for own in np.split(long, np.flatnonzero(np.diff(total // ROUND_SYMBOLS)) + 1):
                result[own] = self._merge_long(np.frombuffer(b"".join(pieces[k] for k in own.tolist()), np.uint8), sizes[own])
            return result
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        a = 0
        while a < len(pieces):
            b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + ROUND_SYMBOLS, "right")) - 1)
            result[a:b] = self._merge(np.frombuffer(b"".join(pieces[a:b]), np.uint8), sizes[a:b])
            a = b
        return result

    def _merge(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        total = sizes.copy()
        symbol, owner = self.byte_ids[data], np.repeat(np.arange(len(sizes)), sizes)
        none = len(self.keys)
        inside = owner[1:] == owner[:-1]
        pair = np.full(max(0, len(symbol) - 1), -1, np.int64)
        pair[inside] = self.find(symbol[:-1][inside], symbol[1:][inside])
        while len(pair):
            rank = np.where(pair >= 0, self.ranks[pair], none)
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            least = np.minimum.reduceat(np.append(rank, none), first)
            live = least < none
            if not live.all():  # finished sequences leave the array
                total[owner[first[~live]]] = np.diff(np.append(first, len(owner)))[~live]
                keep = np.repeat(live, np.diff(np.append(first, len(owner))))
                both = keep[:-1] & keep[1:]
                gap = owner[1:] != owner[:-1]
                pair = np.where(both & ~gap, pair, -1)
                symbol, owner = symbol[keep], owner[keep]
                pair = np.append(pair, -1)[keep][:-1]
                if not len(owner):
                    break
                rank = np.where(pair >= 0, self.ranks[pair], none)
                first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                least = np.minimum.reduceat(np.append(rank, none), first)
            hit = np.append(rank, none) == np.repeat(least, np.diff(np.append(first, len(owner))))
            at = np.flatnonzero(hit)
            if len(at) > 1:  # in runs of overlapping hits every second one merges, from the left
                run = np.concatenate(([True], np.diff(at) > 1))
                place = np.arange(len(at)) - np.repeat(np.flatnonzero(run), np.diff(np.append(np.flatnonzero(run), len(at))))
                at = at[place % 2 == 0]
            symbol[at] = self.made[pair[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            changed = np.zeros(len(symbol), bool)
            changed[at] = True
            symbol, owner, changed = symbol[keep], owner[keep], changed[keep]
            pair = np.append(pair, -1)[keep][:-1]
            again = np.flatnonzero((changed[:-1] | changed[1:]) & (owner[1:] == owner[:-1]))
            pair[owner[1:] != owner[:-1]] = -1
            pair[again] = self.find(symbol[again], symbol[again + 1])
        if len(owner):
            seen, n = np.unique(owner, return_counts=True)
            total[seen] = n
        return total

    def _merge_long(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        n, none = len(data), len(self.keys)
        owner = np.append(np.repeat(np.arange(len(sizes)), sizes), -1)
        symbol = np.append(self.byte_ids[data], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # place n ends the list
        after[n] = n
        alive = np.ones(n + 1, bool)
        alive[n] = False
        rank, pair = np.full(n + 1, none), np.full(n + 1, -1)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def look(at: np.ndarray) -> None:
            """Ranks of the pairs that begin at these places, which go into the queue."""
            at = at[owner[at] == owner[after[at]]]
            found = self.find(symbol[at], symbol[after[at]])
            at, found = at[found >= 0], found[found >= 0]
            pair[at], rank[at] = found, self.ranks[found]
            order = np.argsort(rank[at], kind="stable")
            at = at[order]
            r = rank[at]
            cuts = np.flatnonzero(np.concatenate((np.ones(min(1, len(r)), bool), r[1:] != r[:-1])))
            for k, own in zip(r[cuts].tolist(), np.split(at, cuts[1:]), strict=False):
                if k not in waiting:
                    waiting[k] = []
                    heapq.heappush(queue, k)
                waiting[k].append(own)

        look(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            run = np.concatenate(([True], after[at[:-1]] != at[1:]))  # overlapping hits: every second one
            first = np.flatnonzero(run)
            place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            at = at[place % 2 == 0]
            gone = after[at]
            symbol[at] = self.made[pair[at]]
            alive[gone] = False
            rank[gone] = rank[at] = none
            after[at] = after[gone]
            before[after[at]] = at
            left = before[at]
            left = left[left >= 0]
            rank[left] = none
            look(np.unique(np.concatenate((left, at))))
        return np.bincount(owner[:-1][alive[:-1]], minlength=len(sizes))


def counter(path: str, pattern: str, cache: int = CACHE):
    """A function from a list of texts to their token counts."""
    import regex

    merger = RankMerger(path)
    find = regex.compile(pattern).findall
    special = regex.compile("|".join(map(regex.escape, merger.special))) if merger.special else None
    known: dict[str, int] = {}

    def count(texts: list[str | None]) -> list[int]:
        if len(known) > cache:
            known.clear()
        out, lists = [], []
        for text in texts:
            extra, parts = 0, [text or ""]
            if special and text and any(s in text for s in merger.special):
                parts = special.split(text)
                extra = len(parts) - 1
            found = find(parts[0]) if len(parts) == 1 else [x for p in parts for x in find(p)]
            out.append(extra)
            lists.append(found)
        new = list({x for found in lists for x in found if x not in known})
        if new:
            known.update(zip(new, merger.counts([x.encode() for x in new]).tolist(), strict=True))
        get = known.__getitem__
        return [n + sum(map(get, found)) for n, found in zip(out, lists, strict=True)]

    return count


def token_counts(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens and over_limit."""

    def run(batches):
        count = counter(path, pattern)
        for batch in batches:
            column = batch.column(1)
            _, offsets = C.buffers(column)
            n = []
            for a, b in C.doc_chunks(offsets):
                n += count(column.slice(a, b - a).to_pylist())
            n = np.array(n, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = T.StructType([T.StructField("id", docs.schema[id].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, kind).withColumnRenamed("id", id)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
