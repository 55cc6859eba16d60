"""Copies but for form (p5) and repeats of history (p1), against brute force."""

import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from gritmill.llm import bloom, formdup, history
from gritmill.llm.canon import canonical, record_key, withheld
from gritmill.llm.formdup import collapsed_records, form_duplicates
from gritmill.llm.history import SIMILAR, History, repeats_of_history, sketches
from pyspark.sql import functions as F

DDL = "row_id bigint, batch_id int, title string, location struct<file:string>, evidence struct<snippet:string>, h1 string, words string, fresh int, repo string"


def _report(spark, rows):
    return spark.createDataFrame([(i, b, t, (f,) if f != "-" else None, (s,) if s != "-" else None, "clash", "w", 1, "r") for i, b, s, f, t in rows], DDL)


SAME = [
    ('<add key="A" value="x y" />', "< ADD value = 'X  Y'\n key = 'a' / > ;"),
    ('{"a": 1, "b": {"c": "x", "d": [1, 2]}}', "{ .\n 'B' : { `d`: [1 2], 'c': 'X' }\n 'a': 1,\n},"),
    ('var c = "Server=a;Database=b;Uid=c";', "VAR c = `Uid=c; Database=b ;Server=a`"),
    ("foo(bar, 1);\r\nbaz();", "Foo ( bar , 1 ) baz ( )"),
]
OTHER = [('<add key="A" value="B" />', '<add key="B" value="A" />'), ("a();\nb();", "b();\na();"), ('{"a": "b", "c": "d"}', '{"a": "d", "c": "b"}'), ("x = [1, 2];", "x = [2, 1];"), ('"a=1;b=2"', '"a=2;b=1"')]


@pytest.mark.parametrize("a,b", SAME)
def test_forms_that_are_one(a, b):
    assert canonical(a) == canonical(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_forms_that_differ(a, b):
    assert canonical(a) != canonical(b)


def test_notices():
    assert all(withheld(s) for s in (None, "", " \n", "...", "(evidence withheld)", "[12 characters withheld, rule X1]", "Evidence is not shown because the line may hold a credential."))
    assert not any(withheld(s) for s in ("hidden = true;", "removed();\nx", "a b"))


def test_form_duplicates(spark):
    rng, rows = random.Random(2), []
    for i in range(400):
        a, b = rng.choice(SAME)
        s = rng.choice([a, b, a.upper(), None, "", "(evidence withheld)", "-", f"unique {i} text"])
        rows.append((i, 0, s, rng.choice(["F.cs", "f . CS", "g.cs", None]), rng.choice(["T", "t!", None])))
    rows += [(1000 + i, 1, "hot  copy;" if i % 2 else "HOT copy", "F.cs", "T") for i in range(300)]
    rows.append((5000, 1, "x" * 200_000, None, None))
    rng.shuffle(rows)
    groups = {}
    for i, _, s, f, t in rows:
        k = record_key(None if s == "-" else s, f, t)
        groups.setdefault(k if k is not None else ("none", i), []).append(i)
    df = _report(spark, rows)
    got = sorted(tuple(r) for r in form_duplicates(df).collect())
    assert got == sorted((min(g), i) for g in groups.values() for i in g if i > min(g))
    assert {tuple(r) for r in collapsed_records(df).collect()} == {(min(g), len(g)) for g in groups.values()}


def test_filters_of_shards(spark, monkeypatch):
    """Beyond one filter's keys the hash space is cut: the same sets, and as few singletons shuffled as before."""
    rows = [(i, 0, f"unique text {i}", None, None) for i in range(4000)] + [(9000 + i, 0, f"twice {i % 50}", None, None) for i in range(100)]
    df = _report(spark, rows)
    want = sorted((9000 + i, 9050 + i) for i in range(50))
    shares = []
    for keys in (10**9, 1024):
        monkeypatch.setattr(formdup, "SHARD_KEYS", keys)
        assert sorted(tuple(r) for r in form_duplicates(df).collect()) == want
        shares.append(formdup.possible_repeats(df).where("maybe AND row_id < 9000").count() / 4000)
    assert max(shares) < 0.03
    # what a filter of 2^16 bits lets through, filled to its 16 bits a key and sixteen times as full
    h = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, (1 << 17, 2))
    passed = []
    for n in (1 << 12, 1 << 16):
        bits = np.zeros(1 << 16, bool)
        bits[bloom.positions(h[:n], 1 << 16)] = True
        passed.append(bloom.contains(np.packbits(bits), h[1 << 16 :], 1 << 16).mean())
    assert passed[0] < 0.03 and passed[1] > 0.5
    assert collapsed_records(df).agg(F.sum("copies")).first()[0] == 4100


def test_form_duplicates_empty(spark):
    df = _report(spark, [])
    assert form_duplicates(df).count() == 0 and collapsed_records(df).count() == 0


def test_bloom_has_no_false_negatives(spark):
    df = spark.range(3000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(1)).alias("h2"))
    twice = df.unionByName(df.limit(500)).repartition(7)
    f = bloom.merged(twice, ["h1", "h2"], 3500, repeated=True)
    flags = bloom.flagged(twice, ["h1", "h2"], f, "maybe").groupBy("h1").agg(F.count("*").alias("n"), F.min("maybe").alias("m")).collect()
    assert all(r.m for r in flags if r.n > 1) and sum(r.m for r in flags if r.n == 1) < 25
    assert bloom.merged(df.limit(0), ["h1"], 0, repeated=False).load().sum() == 0


def _similar(a, b):
    return len(a & b) > SIMILAR * len(a | b)


def test_repeats_of_history(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(4000)}"
    texts, rows = [], []
    for i in range(600):
        kind = rng.random()
        if texts and kind < 0.35:
            s = rng.choice(texts).split()
            for _ in range(rng.randrange(0, 4)):
                s[rng.randrange(len(s))] = word()
            s = " ".join(s)
        elif kind < 0.4:
            s = rng.choice([None, " ", "(evidence withheld)"])
        else:
            s = " ".join(word() for _ in range(rng.randrange(25, 45)))
            texts.append(s)
        rows.append((i, min(i // 150, 3), s, None, None))
    seen, want = {}, set()
    for i, b, s, _, _ in rows:
        if withheld(s):
            continue
        w = frozenset(s.split())
        first = min([f for v, f in seen.values() if v == w or _similar(v, w)], default=i)
        seen[i] = w, first
        if b >= 1 and first < i:
            want.add((first, i))
    got = {tuple(r) for r in repeats_of_history(_report(spark, rows)).collect()}
    assert got == want and len(want) > 100


def test_a_crowd_of_near_copies_is_one_class(spark):
    base = [f"k{i}" for i in range(40)]
    rows = [(i, i // 100, " ".join(base[:20] + [f"n{i}"] + base[20:]), None, None) for i in range(300)]
    got = {tuple(r) for r in repeats_of_history(_report(spark, rows)).collect()}
    assert got == {(0, i) for i in range(100, 300)}


def test_ingest_by_hand_and_compaction(spark):
    h = History(spark, ranges=4)
    mk = lambda ids: sketches(_report(spark, [(i, 0, " ".join(f"a{i % 5}b{j}" for j in range(30)), None, None) for i in ids]))

    def away(ids):
        h.ingest(mk(ids))
        return {tuple(r) for r in h.turned_away(mk(ids)).collect()}

    assert away(range(3)) == set()
    # 8 and 9 are of new kinds, 10 repeats 0
    assert away([8, 9, 10]) == {(0, 10)}
    h.compact()
    assert away([20, 21]) == {(0, 20), (1, 21)}
    assert away([]) == set()
    # compaction after many more texts takes the order of words anew
    was = h.ordered_at
    h.ingest(sketches(_report(spark, [(i, 0, " ".join(f"c{i}d{j}" for j in range(12)), None, None) for i in range(100, 140)])))
    h.compact()
    assert h.ordered_at > 2 * was
    assert away([200, 201]) == {(0, 200), (1, 201)}


def test_a_small_batch_reads_only_the_ranges_it_touches(spark):
    h = History(spark, ranges=64)
    text = lambda i, extra="": " ".join(f"k{i}x{j}" for j in range(6)) + extra
    h.ingest(sketches(_report(spark, [(i, 0, text(i), None, None) for i in range(400)])))
    want = h.spark.table(h.keys).where("fp1 = (SELECT min(fp1) FROM " + h.keys + ")")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan does not tell them
    plan = h._touched(h.keys, "word", want, True)._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert 1 <= int(re.search(r"SelectedBucketsCount: (\d+) out of 64", plan)[1]) <= 3
    one = sketches(_report(spark, [(1000, 1, text(7, " more"), None, None)]))
    h.ingest(one)
    assert [tuple(r) for r in h.turned_away(one).collect()] == [(7, 1000)]


def test_history_empty_and_null_batch(spark):
    assert repeats_of_history(_report(spark, [])).count() == 0
    rows = [(1, None, "one two three four five six", None, None), (2, 1, "ONE two three four five six", None, None)]
    assert [tuple(r) for r in repeats_of_history(_report(spark, rows)).collect()] == [(1, 2)]


@pytest.mark.parametrize("seed", range(4))
def test_windows_lose_no_similar_pair(seed):
    """Every pair over the bound has a key in common at which sizes, places and parity bits let it pass."""
    rng = np.random.default_rng(seed)
    vocabulary = np.unique(rng.integers(-(1 << 31), 1 << 31, 400).astype(np.int32))
    sets = [np.sort(rng.choice(vocabulary, rng.integers(1, 60), replace=False)) for _ in range(60)]
    for k in range(60):  # others with some words exchanged
        s = sets[k]
        kept = rng.choice(s, max(1, int(len(s) * rng.uniform(0.6, 1))), replace=False)
        sets.append(np.unique(np.concatenate([kept, rng.choice(vocabulary, rng.integers(0, 12), replace=False)])))
    n = len(sets)
    order = SimpleNamespace(value=(vocabulary[:150], rng.integers(1, 9, 150)))
    b = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(sets, pa.list_(pa.int32()))], names=["fp1", "words"])
    (k,) = history._keys(order)(iter([b]))
    at = {}
    for word, size, pos, s1, s2, i in zip(*(c.to_pylist() for c in k.columns)):
        at.setdefault(i, {})[word] = size, pos, s1, s2
    similar = 0
    for i in range(n):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            total = len(sets[i]) + len(sets[j])
            if not shared > SIMILAR * (total - shared):
                continue
            similar += 1
            passed = False
            for w in at[i].keys() & at[j].keys():
                (n1, p1, a1, a2), (n2, p2, b1, b2) = at[i][w], at[j][w]
                apart = ((a1 ^ b1) & (2**64 - 1)).bit_count() + ((a2 ^ b2) & (2**64 - 1)).bit_count()
                passed |= min(n1, n2) > SIMILAR * max(n1, n2) and apart < 0.25 * total and min(n1 - p1, n2 - p2) > 0.375 * total
            assert passed
    assert similar > 30
