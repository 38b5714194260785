"""Each corpus operator against brute force, a library, or held-out accuracy; edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica import llm
from lattica.llm import common, decontaminate, langid, lm_score, mixing, neardup, quality, shards, suffix_dedup, tokens, toxicity

from ..conftest import DATA

UP = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (0, None, None, None, None), (1, "", "en", "a", 0), (2, "one", "en", None, 3), (3, "one", "en", None, 3), (3, "one", "en", None, 3), (4, "a b c d e " * 30000, "en", "a", 1), (5, "...!!! 123", "de", "b", 1),
    (6, "Größe é 日本語 \U0001f600 <|endoftext|> x", "de", "b", 1), (None, "no id here at all today", "en", "a", 2), (7, "zero\x00byte and\ttabs\x0b\n\n\nlines", None, "b", 1), (8, "a b c d e " * 30000 + "end", "en", "a", 1), (9, "   \n\t ", "fr", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plant(tmp_path, spark, docs, **more):
    """A folder with the tables of the smallest data, `documents` and others replaced."""
    out = tmp_path / "sf"
    out.mkdir()
    for name in ("benchmark", "labels"):
        (out / f"{name}.parquet").symlink_to(f"{DATA}/{name}.parquet")
    docs.write.parquet(str(out / "documents.parquet"))
    return str(out)


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_odd_and_empty_tables(spark, odd, empty, name, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and clashing names don't crash."""
    clash = odd.withColumns({c: F.lit(1) for c in ("id", "size", "shard", "n", "label", "value", "component", "n_words", "__lang")})
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    full = llm.queries()[name](spark, plant(tmp_path / "a", spark, clash))
    assert full.count() == len(ODD)
    assert llm.queries()[name](spark, plant(tmp_path / "b", spark, empty)).count() == 0


# 1


def brute_repeats(rows, length=suffix_dedup.LENGTH):
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest())
    return out


@pytest.mark.parametrize(("run_bytes", "hot_rows"), [(3000, suffix_dedup.HOT_ROWS), (10**8, suffix_dedup.HOT_ROWS), (3000, 1)])
def test_suffix_dedup(spark, run_bytes, hot_rows):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 8)))
    passage = [" ".join(word() for _ in range(60)) for _ in range(4)]
    rows = [(i, " ".join(rng.choice([word(), rng.choice(passage), rng.choice(passage)[rng.randrange(90) :], "x" * rng.randrange(1, 300)]) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "ab" * 400), (63, rows[5][1]), (64, rows[5][1][40:190])]
    found = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), run_bytes=run_bytes, hot_rows=hot_rows).collect()
    assert {r["__id"]: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in found} == brute_repeats(rows)


def test_equal_hashes_of_unequal_contexts(spark, monkeypatch):
    """Bytes decide: with hashes that all collide the result stays the same."""
    monkeypatch.setattr(suffix_dedup, "_row_hash", lambda *parts, salt=0: np.zeros(len(parts[0]), np.uint64))
    rng = random.Random(13)
    rows = [(i, "".join(rng.choice("ab") for _ in range(240))) for i in range(12)]
    rows += [(20, rows[3][1]), (21, "c" + rows[4][1][20:200] + "c"), (22, "d" * 130 + rows[4][1])]
    keyed = [(i, t, 0) for i, t in rows]
    table = pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in keyed]), pa.array([0] * len(keyed)), pa.array([t for _, t, _ in keyed])], names=["id", "th", "text"])
    class Nothing:
        value = np.zeros(0, np.uint64)
    for size in (500, 10**8):
        runs = pa.Table.from_batches(suffix_dedup._runs(1, size, Nothing)([table])).combine_chunks().to_batches()
        gone = collections.defaultdict(set)
        for out in suffix_dedup._merge(runs):
            for i, _, s, e in zip(*(c.to_pylist() for c in out.columns)):
                gone[i] |= set(range(s, e))
        assert {i: len(gone[i]) for i, _ in rows} == {i: x[1] for i, x in brute_repeats(rows).items()}


def test_rows_twice_are_one_document(spark):
    text = " ".join(f"word{k * 7 % 101}" for k in range(80))
    rows = [(1, text), (1, text), (2, text), (2, text), (3, "x" + text)]
    for run_bytes in (500, 10**8):
        got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), run_bytes=run_bytes).collect()
        n = len(text)
        assert sorted((r["__id"], r.n_removed) for r in got) == [(1, 0), (1, 0), (2, n), (2, n), (3, n)]


def test_split_ranges_keep_every_string():
    rng = np.random.default_rng(1)
    n = 50
    r, left = rng.integers(24, 101, n).astype(np.uint8), rng.integers(0, 77, n).astype(np.uint8)
    m = rng.integers(97, 100, (n, 176)).astype(np.uint8)
    seen = collections.Counter()
    for own, _, _, r2, left2, _ in suffix_dedup.split_ranges(m[:, :100], m[:, 100:], r, left, np.zeros(n, np.uint64), 7):
        for i, a, b in zip(own.tolist(), r2.tolist(), left2.tolist()):
            seen.update((i, k) for k in range(100 - a, b + 1))
    assert seen == {(i, k): 1 for i in range(n) for k in range(100 - int(r[i]), int(left[i]) + 1)}


def test_loser_tree_equals_sorting():
    rng = random.Random(1)
    runs = []
    for _ in range(7):
        s = sorted(bytes(rng.choice(b"ab") for _ in range(9)) for _ in range(rng.randrange(1, 40)))
        runs.append((s, [0, *(next((k for k in range(9) if x[k] != y[k]), 9) for x, y in zip(s, s[1:]))]))
    run, place, agree = suffix_dedup.loser_tree(runs)
    merged = [runs[r][0][p] for r, p in zip(run, place)]
    assert merged == sorted(x for s, _ in runs for x in s)
    assert agree[1:] == [next((k for k in range(9) if x[k] != y[k]), 9) for x, y in zip(merged, merged[1:])]


# 2


def benchmark_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))


def brute_hits(docs, items):
    windows, texts = collections.defaultdict(set), collections.defaultdict(set)
    for i, t in items:
        w = benchmark_words(t)
        texts[i or ""].add(tuple(w))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i or "")
    lengths, want = {len(w) for w in windows}, {}
    for i, t in docs:
        w, hit, ids, longest = benchmark_words(t), set(), set(), 0
        for k in range(len(w)):
            for n in lengths:
                if k + n <= len(w) and tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
                    while n >= 10 and k + n < len(w) and any(tuple(w[k : k + n + 1]) == x[j : j + n + 1] for own in texts.values() for x in own for j in range(len(x) - n)):
                        n += 1
                    longest = max(longest, n)
        want[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), longest)
    return want


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 0])
def test_decontaminate(spark, block):
    """With a broadcast query set, and with the joined one; ties, repeated and odd items."""
    rng = random.Random(6)
    word = lambda: "w" + rng.choice("abcdefgh")
    items = [(f"i{k}", " ".join(word() for _ in range(rng.randrange(1, 40)))) for k in range(30)] + [("s", "To be"), ("z", ""), ("n", None), ("s", "wa WA"), (None, "größe wb"), ("t1", "wa wa"), ("i3", "one more text of item three with more than ten words in it")]
    items += [(f"e{k}", items[2][1]) for k in range(5)] + [(f"p{k}", items[0][1] + f" tail{k}") for k in range(5)]
    docs = []
    for i in range(60):
        parts = [rng.choice([word(), word(), rng.choice(items)[1] or "", "to be", "Größe wb"]) for _ in range(rng.randrange(1, 8))]
        docs.append((i, " ".join(parts)))
    docs += [(60, None), (61, ""), (62, "!!"), (62, "!!"), (63, docs[4][1]), (63, docs[4][1]), (64, "wa " * 3000)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("__n_hit", "__id", "id", "key", "item")}).repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.matched(table, bench, block_bytes=block, prefix="___").collect()
    want = brute_hits(docs, items)
    assert len(got) == len(docs) and {r.doc_id: (r["___n_words"], r["___n_hit"], r["___n_items"], r["___sha"], r["___longest"]) for r in got} == want
    texts = collections.defaultdict(set)
    for i, t in items:
        texts[i or ""].add(tuple(benchmark_words(t)))
    for r in got:  # the longest match stands where it is said to
        n, w = r["___longest"], tuple(benchmark_words(r.text))
        assert not n and r["___item"] is None or any(w[r["___at"] : r["___at"] + n] == x[r["___item_at"] : r["___item_at"] + n] for x in texts[r["___item"]])
    clean = decontaminate.decontaminate(table, bench, block_bytes=block)
    assert clean.columns == table.columns and sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in docs if not want[i][1])
    assert decontaminate.matched(table, bench.limit(0), block_bytes=block, prefix="___").where("___n_items > 0").count() == 0


def test_equal_items_do_not_multiply_hits(spark):
    items = spark.createDataFrame([(f"i{k}", "the") for k in range(5000)], "item_id string, text string")
    docs = spark.createDataFrame([(1, "the " * 20000), (2, "nothing")], "doc_id long, text string")
    digest = hashlib.sha256(",".join(sorted(f"i{k}" for k in range(5000))).encode()).hexdigest()
    for block in (decontaminate.BLOCK_BYTES, 0):
        got = {r.doc_id: (r["__n_hit"], r["__n_items"], r["__sha"]) for r in decontaminate.matched(docs, items, block_bytes=block).collect()}
        assert got == {1: (20000, 5000, digest), 2: (0, 0, hashlib.sha256(b"").hexdigest())}
    tests = decontaminate.TestSuffixes([("a", np.arange(3, dtype=np.uint64).tobytes())] * 9)
    assert len(tests.matches(np.tile(np.arange(3, dtype=np.uint64), 4), np.array([0, 12]))[0]) == 4


# 3


def test_token_counts(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [r.text for r in docs.select("text").collect()] + [t or "" for _, t, *_ in ODD] + ["a<|endoftext|><|endoftext|>b", "\x1c x\x85y", "aaaa" * 300, "don't WE'LL  we're\r\n\r\n", "é́ ​x 12345"]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert tokens.counter(path, public_tokenizers.PATTERN, cache=50)(texts) == want


@pytest.mark.parametrize("long", [1, 20])
def test_long_pre_tokens_are_merged_alike(docs, monkeypatch, long):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "LONG", long)
    monkeypatch.setattr(tokens, "ROUND_SYMBOLS", 3000)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdeé ") for _ in range(3000)), "a" * 5001, "ab" * 700 + "a" * 333, *(r.text for r in docs.select("text").limit(40).collect())]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert tokens.counter(path, public_tokenizers.PATTERN)(texts) == want


def test_a_megabyte_of_letters():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), "a" * 300_000]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert tokens.counter(path, public_tokenizers.PATTERN)(texts) == want


# 4


def test_masked_scores(spark, docs):
    own = docs.select("doc_id", "text")
    net, losses = lm_score.train(own, rounds=3)
    assert losses[-1] < losses[0] < math.log(256) + 1
    got = {r.doc_id: r for r in lm_score.scored(own, net).collect()}
    text = next(r.text for r in docs.collect() if r.doc_id == 3).encode()
    total = 0.0
    for k in range(len(text)):  # byte by byte, straight from the definition
        near = [text[k + d] if 0 <= k + d < len(text) else 0 for d in (*range(-lm_score.SIDE, 0), *range(1, lm_score.SIDE + 1))]
        h = net.bias + sum(net.embed[256 * j + b] for j, b in enumerate(near))
        z = (h / (1 + np.abs(h))) @ net.out + net.out_bias
        c = net.number[text[k]]
        total += float(z[c] - z.max() - np.log(np.exp(z - z.max()).sum())) - (0 if net.seen[text[k]] else math.log(net.others))
    assert got[3].n_tokens == len(text) and abs(got[3].sum_logprob - total) < 0.02
    noise = spark.createDataFrame([(1, "".join(random.Random(4).choice("qzxjkvwQZXJ#%&\x01\x02") for _ in range(500))), (2, None), (3, "")], "doc_id long, text string")
    odd = {r.doc_id: r for r in lm_score.scored(noise, net).collect()}
    assert odd[1].mean_logprob < sorted(r.mean_logprob for r in got.values())[len(got) // 2] - 1
    assert [(odd[k].n_tokens, odd[k].sum_logprob, odd[k].mean_logprob) for k in (2, 3)] == [(0, 0.0, None)] * 2


def test_held_out_likelihood_beats_a_count_table(spark):
    """Nats a byte on documents that were not trained on, against smoothed counts of each
    byte between its two neighbours."""
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    net, _ = lm_score.train(docs.where(common.crc_third("doc_id") != 1))
    held = docs.where(common.crc_third("doc_id") == 1)
    rows = lm_score.scored(held, net).agg(F.sum("sum_logprob"), F.sum("n_tokens")).first()
    nats = -rows[0] / rows[1]
    triple, pair, single = collections.Counter(), collections.Counter(), collections.Counter()
    for r in docs.where(common.crc_third("doc_id") != 1).collect():
        b = b"\0" + (r.text or "").encode() + b"\0"
        triple.update(zip(b, b[1:], b[2:]))
        pair.update(zip(b, b[2:]))
        single.update(b[1:-1])
    total, n, size = 0.0, 0, sum(single.values())
    for r in held.collect():
        b = b"\0" + (r.text or "").encode() + b"\0"
        for x, y, z in zip(b, b[1:], b[2:]):
            total -= math.log((triple[x, y, z] + 2 * (single[y] + 0.01) / size) / (pair[x, z] + 2))
            n += 1
    print(f"held-out nats a byte: network {nats:.3f}, count table {total / n:.3f}")
    assert n == rows[1] and nats < total / n


def test_gradient_equals_differences():
    rng = np.random.default_rng(4)
    seen = np.zeros(256, bool)
    seen[:6] = True
    codes = lm_score.window_codes(rng.integers(0, 8, 40).astype(np.uint8), np.array([0, 25, 40]))
    weight = rng.random(40)
    net = lm_score.WindowNet(seen, hidden=5)
    for name in net.NAMES:
        setattr(net, name, getattr(net, name).astype(np.float64))
    plain = net.flat().copy()
    loss = lambda: -float((net.log_prob(codes) + np.where(seen[codes & 255], 0, np.log(net.others))) @ weight / weight.sum())
    state = []
    net.step(codes, weight, state, 0.0)
    grads = np.concatenate([m.ravel() * 10 for m in state[1]])
    for i in np.flatnonzero(np.abs(grads) > 1e-3)[::17].tolist():
        moved = plain.copy()
        moved[i] += 1e-5
        up = net.load(moved) and loss()
        moved[i] -= 2e-5
        down = net.load(moved) and loss()
        assert abs((up - down) / 2e-5 - grads[i]) < 1e-4


def test_windows_count_every_position(docs):
    n = lm_score.windows(docs).agg(F.sum("n")).first()[0]
    assert n == docs.agg(F.sum(F.octet_length("text"))).first()[0]


# 5


def test_shards(docs, odd):
    for table in (docs, odd):
        rows = shards.shard_plan(table).collect()
        sizes = sorted(((r["__id"] is not None, r["__id"] or 0), r["__crc"], r["__size"]) for r in rows)
        text = sorted(((r.doc_id is not None, r.doc_id or 0), zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 1) for r in table.collect())
        assert sizes == text
        by = collections.defaultdict(list)
        for r in rows:
            by[r["__shard"]].append(r)
        for own in by.values():
            assert sorted(r["__slot"] for r in own) == list(range(len(own)))
        order = [r["__shard"] for r in sorted(rows, key=lambda r: ((r["__id"] is not None, r["__id"] or 0), r["__crc"], r["__slot"]))]
        if table is docs:
            assert order == sorted(order)
            total = sum(r["__size"] for r in rows)
            most = max(r["__size"] for r in rows)
            assert all(abs(sum(r["__size"] for r in by[k]) - total / 16) <= most for k in range(16))


# 6


def sql_rows(sql, names):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return sorted(con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_against_sql(spark, name):
    own = llm.queries()[name](spark, DATA)
    assert sorted(map(tuple, own.collect())) == sql_rows(llm.oracle_sql()[name], own.columns)


def test_mix_budgets(spark, odd):
    rows = spark.createDataFrame([(i, "abcdefg"[i % 7] if i % 3 else "a", 1 + i * 7 % 40, str(i), 1.0) for i in range(3000)], "__id long, __source string, __size long, __lot string, __quality double")
    got = mixing.mix(rows).collect()
    taken, target, size = collections.Counter(), {}, collections.Counter()
    for r in got:
        taken[r["__source"]] += r["__taken"]
        size[r["__source"]] += r["__size"]
        target[r["__source"]] = r["__target"]
        assert 0 <= r["__taken"] <= 2 * r["__size"]
    assert all(abs(taken[k] - target[k]) <= 1.01 and target[k] <= 2 * size[k] + 1e-6 for k in target)
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-3
    assert sorted(got) == sorted(mixing.mix(rows).collect())
    assert mixing.mix(mixing.quality(mixing.sized(odd), spark.read.parquet(f"{DATA}/labels.parquet"))).count() == len(ODD)


# 7


def test_deobfuscation_and_scores(spark):
    rng = random.Random(5)
    common_words = ["the", "river", "table", "garden", "letter", "window", "music", "stone", "paper", "light"]
    bad = ["grumblewort", "snarkfang", "blightling"]
    rows, marks = [], []
    for i in range(600):
        w = [rng.choice(common_words) for _ in range(30)]
        y = int(rng.random() < 0.3)
        if y:
            for _ in range(2):
                w.insert(rng.randrange(30), rng.choice(bad))
        rows.append((i, " ".join(w)))
        marks.append((i, 1, y))
    for k, t in enumerate(("the sn4rkf@ng stone", "g r u m b l e w o r t light", "blightliiiiing paper", "s-n-a-r-k-f-a-n-g music", "the river 2024 letter", "music music music", "")):
        rows.append((1000 + k, t))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts, model = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r["__score"] for r in toxicity.scored(docs, counts, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.7) == marks[i][2] for i in held) >= 0.98 * len(held)
    assert [got[1000 + k] >= 0.7 for k in range(7)] == [True] * 4 + [False] * 3


def test_decoder_equals_all_readings():
    """The lattice's best path against the best of all readings of short tokens."""
    counts = collections.Counter()
    for w in ("stale", "bile", "ales", "gait", "till"):
        counts.update({g: 30 for g in word_counts(w)})
    model = toxicity.CharModel(counts)

    def score(text, costs):
        total, a, b = costs, " ", " "
        for c in text + " ":
            total, a, b = total + model.log(a, b, c), b, c
        return total

    def readings(token):
        out = [("", 0.0, "")]  # letters, cost, sign before
        for c in token:
            more = []
            offers = [(x, toxicity.LEET_COST) for x in toxicity.STANDS_FOR.get(c, "")] + [(c, toxicity.KEEP_COST if c in toxicity.STANDS_FOR else 0.0)]
            for text, cost, before in out:
                more += [(text + x, cost + k, c) for x, k in offers]
                if c == before and text and any(x == text[-1] for x, _ in offers):
                    more.append((text, cost + toxicity.DROP_COST, c))
            out = more
        return [(t, k) for t, k, _ in out]

    rng = random.Random(7)
    for _ in range(60):
        token = "".join(rng.choice("s5$ta4@li1!e3gb8t7") * rng.choice([1, 1, 1, 2]) for _ in range(rng.randrange(1, 6)))
        best = max(score(t, k) for t, k in readings(token))
        got = toxicity.decode(token, model)
        assert max(score(t, k) for t, k in readings(token) if t == got) == pytest.approx(best)


def test_scores_equal_a_plain_sum(spark):
    """The logistic score of words and stems, word by word."""
    words = ["snarkfang", "stone", "snar"]
    h = lambda w: common.span_hash(common.prefix_hash(common.BYTE_VALUE[np.frombuffer(w.encode(), np.uint8)]), np.array([0]), np.array([len(w.encode())]))[0]
    model = toxicity.Classifier(np.array([h("snarkfang"), h("stone"), ~h("snar")], np.uint64), np.array([2.0, 0.5, 1.0]), -1.5)
    texts = ["a snarkfang", "snarky Stone stone", "", None, "nothing", "sn4rkf@ng"]
    want = [-1.5 + z for z in (3.0, 1.5, 0.0, 0.0, 0.0, 3.0)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r["__score"] for r in toxicity.scored(docs, word_counts("snarkfang", "stone"), model).collect()}
    assert words and all(abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9 for i, z in enumerate(want))


def test_training_sample_is_bounded(spark):
    rows = [(1, "a"), (1, "b"), (1, "b"), (2, "x" * (toxicity.TRAIN_DOC_BYTES + 1)), (3, None), *((k, "t") for k in range(4, 40))]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    got = toxicity.sample_rows(spark.createDataFrame(rows, "doc_id long, text string"), labels, "doc_id", "text", 10).collect()
    assert len(got) <= 10 and all(len(r.t) <= toxicity.TRAIN_DOC_BYTES for r in got)


def test_long_tokens_are_decoded_whole():
    counts = collections.Counter()
    for w in ("  snarkfang ", "  table ", "  letter "):
        counts.update(w[k : k + 3] for k in range(len(w) - 2))
    model = toxicity.CharModel({g: 50 * n for g, n in counts.items()})
    assert toxicity.decode("sn4rkf" + "a" * 5000 + "ng", model) == "snarkfang"
    assert toxicity.decode("s" + "-" * 300 + "narkf@ng", model) == "snarkfang"
    assert toxicity.decode("", model) == toxicity.decode("...", model) == ""


def bytes_and_offsets(*texts):
    return common.buffers(pa.array([t.lower() for t in texts]))


def word_counts(*words, n=50):
    counts = collections.Counter()
    for w in words:
        w = f"  {w} "
        counts.update({w[k : k + 3]: n for k in range(len(w) - 2)})
    return counts


@pytest.mark.parametrize("cache", [1, 2])
def test_a_full_cache_loses_no_reading(cache, monkeypatch):
    counts = word_counts("snarkfang", "table", "letter")
    chunk = bytes_and_offsets("sn4rkfang t4ble l3tter sn4rkfang", "t4ble sn4rkf@ng l3tt3r")
    restore = toxicity.Restorer(counts)
    want = [np.concatenate(x).tolist() for x in restore.words(*chunk)]
    monkeypatch.setattr(toxicity, "CACHE", cache)
    restore = toxicity.Restorer(counts)
    for _ in range(2):
        assert [np.concatenate(x).tolist() for x in restore.words(*chunk)] == want


def test_repeated_signs_and_wide_letters_are_decoded():
    counts = word_counts("hoosebang", "assel", "grünling", "stone", "you", "are", "a", "snarkfang", "the")
    model = toxicity.CharModel(counts)
    texts = ["h00sebang!! the st0ne+", "a$$el", "gr" + "ü" * 4 + "nling", "g r ü n l i n g", "stone!! stone!? 2024!! ———", "you a r e a s n a r k f a n g"]
    docs, found = toxicity.disguised(*bytes_and_offsets(*texts))
    got = collections.defaultdict(set)
    for d, t in zip(docs.tolist(), found):
        got[d] |= set(toxicity.decode(t, model).split(" "))
    assert got == {0: {"hoosebang", "stone"}, 1: {"assel"}, 2: {"grünling"}, 3: {"grünling"}, 5: {"are", "a", "snarkfang"}}


def test_character_counts_of_all_documents(spark):
    texts = ["Grün grün-stone x", "the\u00a0ßtone", None, "", "übel", "zzz9a", "日本"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    want = collections.Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", (t or "").translate(UP)):
            want.update(f"  {w} "[k : k + 3] for k in range(len(w) + 1))
    assert toxicity.char_counts(docs) == want
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, labels)[0] == want


# 8


def brute_tail(n, k, p):
    term = total = Fraction(1)
    for i in range(k):  # relative to the term at 0
        term *= Fraction(n - i, i + 1) * p / (1 - p)
        term = Fraction(round(term * 10**60), 10**60) if n > 10_000 else term
        total += term
    return math.exp(math.log(total.numerator) - math.log(total.denominator) + n * math.log1p(-float(p)))


def test_binomial_tail(spark):
    cases = [(50, 0), (300, 1), (500, 2), (2000, 10), (900, 11), (10, 5), (4000, 20), (80_000, 999), (80_000, 5)]
    df = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality.binomial_tail("n", "k", 0.0125).alias("p"))
    for r in df.collect():
        want = 1.0 if r.k >= r.n * 0.0125 else brute_tail(r.n, r.k, Fraction(1, 80))
        assert abs(r.p - want) < 1e-9
    many = spark.sql("SELECT 4000000L AS n, 49500L AS k UNION ALL SELECT 400000000L, 4999000L").select("n", "k", quality.binomial_tail("n", "k", 0.0125).alias("p")).collect()
    for r in many:  # tens of thousands and millions of false rejections: near the normal law
        z = (r.k + 0.5 - r.n * 0.0125) / math.sqrt(r.n * 0.0125 * 0.9875)
        assert abs(r.p - math.erfc(-z / math.sqrt(2)) / 2) < 3e-3


def test_cutoffs_limit_false_rejection(spark):
    rng = random.Random(8)
    rows = [(i, "en", 100, 500, 400 if i % 10 == 0 else rng.randrange(5), 10, 0, 0) for i in range(4000)]
    measured = spark.createDataFrame(rows, "__id long, __stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(4000)], "doc_id long, quality int, toxic int")
    got = quality.judged(measured, quality.cutoffs(measured, labels)).collect()
    assert all(r.kept == (r["__id"] % 10 != 0) for r in got)
    few = quality.judged(measured, quality.cutoffs(measured, labels.limit(20))).collect()
    assert all(r.kept for r in few)  # too few labels certify nothing


def test_page_breaks_against_sql(spark, docs, tmp_path):
    page = "\n".join(("one line of words", "f", "\x0c", "two lines of words", "f f", "\x0c", " \x0c ", "f"))
    texts = [page, "f\nf\nf", "\x0c\n\x0c\n\x0c", "word " * 60 + "\n\x0c\n\x0c\n\x0c\n\x0c"]
    rows = spark.createDataFrame([(10**6 + i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    sf = plant(tmp_path, spark, docs.select(*rows.columns).unionByName(rows))
    own = llm.queries()["op8_quality"](spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet/*.parquet')")
    con.execute(f"CREATE VIEW labels AS SELECT * FROM read_parquet('{sf}/labels.parquet')")
    want = con.execute(f"SELECT {', '.join(own.columns)} FROM ({llm.oracle_sql()['op8_quality']})").fetchall()
    assert sorted(map(tuple, own.collect())) == sorted(want)


# 9


def brute_groups(rows, words=4):
    sets, part = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))
        sets[i] = set(zip(*(w[k:] for k in range(words)))) if len(w) >= words else ({tuple(w)} if w else set())
        part[i] = i
    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(part[i], part[j]), min(part[i], part[j])
                part = {k: new if v == old else v for k, v in part.items()}
    return {i: (len(sets[i]), part[i]) for i in sets}


def near_rows(n, seed=9):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base) if i % 4 else [f"u{rng.randrange(9000)}" for _ in range(rng.randrange(1, 60))]
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9000)}"
        rows.append((i, " ".join(w)))
    return rows + [(n, rows[1][1]), (n + 1, rows[1][1].upper()), (n + 2, None), (n + 3, " "), (n + 4, "a b"), (n + 5, "A b")]


@pytest.mark.parametrize("block", [256, 24])
def test_near_duplicates(spark, block, monkeypatch):
    """Also with clusters much larger than a block, where pivots and prefixes decide."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "PIVOTS", 4)
    rows = near_rows(160)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["__id"]: (r["__n"], r["__component"]) for r in got} == brute_groups(rows)


@pytest.mark.parametrize("sizes", [(35, 15), (45, 12)])
def test_many_small_components_in_one_cluster(spark, monkeypatch, sizes):
    """Pairs of similarity over 0.8 among documents that are all similar by about 0.7 and so
    form one candidate cluster; the ids are texts, and other columns clash."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    monkeypatch.setattr(neardup, "SALTS", 3)
    own, swap = sizes
    rows = []
    for i in range(0, 60, 2):
        w = [f"b{k}" for k in range(200 - own)] + [f"o{i}x{k}" for k in range(own)]
        rows.append((f"d{i:03}", " ".join(w)))
        rows.append((f"d{i + 1:03}", " ".join(w[:-swap] + [f"y{i}x{k}" for k in range(swap)])))
    rows += [(None, rows[0][1]), ("d000", rows[0][1]), ("dx", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumns({c: F.lit(1) for c in ("cluster", "node", "block", "n", "gram", "id", "name")})
    want = brute_groups([r for r in rows if r[0]])
    assert {c for _, c in want.values()} == {f"d{i:03}" for i in range(0, 60, 2)} | {"dx"}
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows) and {r["__id"]: (r["__n"], r["__component"]) for r in got if r["__id"]} == want
    assert [r["__component"] for r in got if r["__id"] is None] == [None]


def test_prefix_nodes_hold_every_link(spark, monkeypatch):
    """Random sets in one cluster: all links between components meet in a node."""
    monkeypatch.setattr(neardup, "BLOCK", 5)
    rng = random.Random(21)
    rows = []
    for i in range(50):
        w = [f"c{k}" for k in range(rng.randrange(40, 56))] + [f"{rng.choice('abc')}{k}" for k in range(8)]
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in rows}
    linked = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    members = spark.createDataFrame([(1, i, i) for i in sets], "cluster long, component long, id long")
    nodes = neardup._common_prefixes(members, spark.createDataFrame(rows, "id long, text string"), 4)
    met = set()
    for part in (["node"], ["node", "block", "group"]):  # the members of nodes, then as they are dealt
        groups = collections.defaultdict(set)
        for r in (nodes if part == ["node"] else neardup._questions(nodes, 5)).collect():
            groups[tuple(r[c] for c in part)].add((r.id, part == ["node"] or r.query))
        met = {tuple(sorted((i, j))) for own in groups.values() for i, asks in own if asks for j, _ in own if i != j}
        assert linked and linked <= met


def test_near_duplicates_of_five_words(spark):
    rows = near_rows(80, seed=4)
    w = [f"v{k}" for k in range(200)]
    far = list(w)
    for k in range(5):  # similar by 0.82 on four words, by 0.77 on five
        far[20 + 40 * k] = f"z{k}"
    rows += [(500, " ".join(w)), (501, " ".join(far))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=5).collect()
    want = brute_groups(rows, 5)
    assert {r["__id"]: (r["__n"], r["__component"]) for r in got} == want and want[501][1] == 501 and brute_groups(rows)[501][1] == 500


def test_a_shared_passage_hides_no_link(spark, monkeypatch):
    """Pairs of similarity near 0.8 among documents that share a passage (similarity 0.45), so
    that nodes are larger than a leaf down to the last depth."""
    monkeypatch.setattr(neardup, "LEAF", 20)
    rng = random.Random(12)
    passage, rows, want = [f"p{k}" for k in range(125)], [], {}
    for i in range(0, 1600, 2):
        own = [f"o{i}x{k}" for k in range(75)]
        rows.append((i, " ".join(passage + own)))
        for k in rng.sample(range(75), 5):
            own[k] = f"y{i}x{k}"
        rows.append((i + 1, " ".join(passage + own)))
        want |= {k: c for k, (_, c) in brute_groups(rows[-2:]).items()}
    assert sum(c != i for i, c in want.items()) == 800
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["__id"]: r["__component"] for r in got} == want


def test_near_copies_meet_once_in_their_cluster(spark, monkeypatch):
    """Near copies of one text, similar by little more or less than 0.8, fill large nodes that
    overlap; they are compared by cluster once, not by every tree and shingle that they share."""
    size, rng, dealt = 10, random.Random(3), []
    monkeypatch.setattr(neardup, "LEAF", size)
    monkeypatch.setattr(neardup, "BLOCK", size)
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    rows = []
    for i in range(120):
        w = [f"w{k}" for k in range(120)]
        for k in range(2 + i % 2):
            w[rng.randrange(len(w))] = f"x{i}y{k}"
        rows.append((i, " ".join(w)))
    want, ask = brute_groups(rows), neardup._questions

    def asked(members, n):
        found = ask(members, n)
        parts = collections.Counter(c for _, c in {(r.id, r.component) for r in members.collect()})
        dealt.append((found.count() if found else 0, len(rows) - max(parts.values(), default=0)))
        return found

    monkeypatch.setattr(neardup, "_questions", asked)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["__id"]: (r["__n"], r["__component"]) for r in got} == want
    # the sets outside the main component ask in every block, all sets answer each group of them
    apart, blocks = max(n for _, n in dealt), -(-len(rows) // size)
    assert 0 < sum(n for n, _ in dealt) <= 2 * (apart + size) * blocks, dealt


# 10


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    tagger = langid.train(docs)
    got = langid.predict(docs, tagger).where(common.crc_third("doc_id") == 1).select("lang", "__lang", "__score").collect()
    assert sum(r.lang == r["__lang"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["__score"] <= 1 for r in got)


def test_backpropagation_equals_differences():
    rng = np.random.default_rng(2)
    layer = langid.Direction(rng, 3)
    layer.embed, layer.recur = layer.embed.astype(np.float64), layer.recur.astype(np.float64)
    x = rng.integers(0, 5, (4, 6)).astype(np.uint8)
    want = rng.standard_normal((4, 3, 6)).astype(np.float32)
    loss = lambda: float((layer.states(x) * want).sum(dtype=np.float64))
    _, tape = layer.states(x, keep=True)
    grads = layer.backward(x, tape, want)
    for p, g in zip((layer.embed, layer.recur), grads):
        for at in [(0, 1), (4, 2), (7, 0)]:
            old, eps = p[at], 1e-2
            p[at] = old + eps
            up = loss()
            p[at] = old - eps
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 0.02


def test_pooled_probabilities_equal_a_plain_loop():
    """Byte by byte, straight from the definition; a long text is cut into pieces of whole rows."""
    tagger = langid.ByteTagger(["de", "en", "fr"], seed=3)
    squash = lambda v: v / (1 + abs(v))

    def states(layer, x):
        h, out, k = np.zeros(layer.h), [], layer.h
        for c in x:
            e, u = layer.embed[:, c].astype(float), layer.recur.astype(float) @ h
            z, r = (squash(e[:k] + u[:k]) + 1) / 2, (squash(e[k : 2 * k] + u[k : 2 * k]) + 1) / 2
            h = z * h + (1 - z) * squash(e[2 * k :] + r * u[2 * k :])
            out.append(h)
        return out

    texts = ["a", "größe und mehr " * 20, "", "x" * 128, "y" * 129]
    data, offsets = common.buffers(pa.array(texts))
    got = tagger.pooled(data, offsets)
    for i, t in enumerate(texts):
        total = np.zeros(3)
        for a in range(0, len(t.encode()), langid.STEPS):
            x = t.encode()[a : a + langid.STEPS]
            for f, b in zip(states(tagger.ahead, x), states(tagger.back, x[::-1])[::-1]):
                z = np.concatenate((f, b)) @ tagger.w + tagger.b
                total += np.exp(z) / np.exp(z).sum()
        assert np.abs(got[i] - total / max(1, len(t.encode()))).max() < 1e-5


def test_a_long_text_scores_as_its_rows(spark, monkeypatch):
    tagger = langid.ByteTagger(["de", "en"], seed=9)
    table = spark.createDataFrame([(0, "le temps des cerises und so weiter " * 900), (1, "kurz")], "doc_id long, text string")
    whole = {r.doc_id: r["__score"] for r in langid.predict(table, tagger).collect()}
    monkeypatch.setattr(langid, "LAYOUT_BYTES", 4 * langid.STEPS)
    cut = {r.doc_id: r["__score"] for r in langid.predict(table, tagger).collect()}
    assert all(abs(whole[k] - cut[k]) < 1e-6 for k in whole) and langid.LAYOUT_BYTES % langid.STEPS == 0


def test_undetermined_languages(odd):
    got = {r.doc_id: r["__lang"] for r in langid.predict(odd, langid.ByteTagger(["de", "en"])).collect()}
    assert [got[k] for k in (0, 1, 5, 9)] == ["und"] * 4 and got[2] != "und"


# helpers


def test_words_and_buffers():
    column = pa.array(["Ab  c", None, "", "dé\tf"]).slice(0, 4)
    data, offsets = common.buffers(column)
    s, e, bounds = common.words(data, offsets, common.SPACE_WORDS)
    assert [data[a:b].tobytes().decode() for a, b in zip(s, e)] == ["Ab", "c", "dé", "f"] and bounds.tolist() == [0, 2, 2, 2, 4]
    assert list(common.doc_chunks(np.array([0, 5, 5, 9, 30]), 8)) == [(0, 2), (2, 3), (3, 4)]


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40) if k != 20] + [(50, 60)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges, "a", "b").collect()}
    assert got == {k: 1 if k <= 20 else 21 for k in range(1, 41)} | {50: 50, 60: 50}
