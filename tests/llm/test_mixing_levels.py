"""Apportionment against single rounds, mixtures within their caps, reading levels on held-out grades."""

import os
import random

import pytest
from gritmill.llm import tokens as T
from gritmill.llm import levels
from gritmill.llm.levels import coverage_features, prose_counts, reading_levels, word_counts, word_ranks
from gritmill.llm.mixing import apportion, mix, mix_shares, plan, shard_seats
from gritmill.llm.prose import read_prose

needs_vocabulary = pytest.mark.skipif(not os.path.exists(T.vocabulary_path()), reason="no vocabulary file here")


def _rounds(weights, seats, caps):
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        open_ = [k for k in sorted(weights) if weights[k] > 0 and got[k] < caps[k]]
        if not open_:
            break
        k = max(open_, key=lambda k: weights[k] / (2 * got[k] + 1))
        got[k] += 1
    return got


def test_apportion_equals_single_rounds():
    rng = random.Random(3)
    for _ in range(300):
        w = {f"s{i}": rng.choice([0, 0.1, 0.2, 0.2, rng.random()]) for i in range(rng.randrange(1, 7))}
        caps = {k: rng.randrange(0, 60) for k in w}
        seats = rng.randrange(0, 150)
        a, b = apportion(w, seats, caps), _rounds(w, seats, caps)
        assert sum(a.values()) == sum(b.values()) and all(abs(a[k] - b[k]) <= 1 for k in w)
        if len(set(w.values())) == len(w):
            assert a == b
    assert apportion({}, 5) == {} and apportion({"a": 1.0}, 10**12) == {"a": 10**12}


def test_plan_drops_sources_without_tokens():
    seats = plan({"a": (0.5, 1), "b": (0.3, 2), "none": (0.2, 3)}, {"a": 10000, "b": 1000}, block=10)
    a, b = seats["a"], seats["b"]
    assert b <= 200 and abs(a / (a + b) - 0.5 / 0.8) < 0.01 and plan({}, {}) == {}


def test_seats_of_shards_equal_single_rounds(spark):
    """Over shards of like size, shards far apart, and seats up to the caps."""
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(60):
        sizes = [rng.choice([1000 + rng.randrange(-40, 40), rng.randrange(1, 3000)] if i % 2 else [1000 + rng.randrange(-40, 40)]) for _ in range(rng.randrange(1, 40))]
        cap, block = rng.randrange(1, 4), 16
        most = sum(sizes) * cap // block
        q = rng.choice([most, rng.randrange(0, most + 1), max(0, most - rng.randrange(5))])
        w = {k: float(t) + k * 1e-7 for k, t in enumerate(sizes)}  # ties go to the first shard
        got = apportion({k: float(t) for k, t in enumerate(sizes)}, q, {k: -(-t * cap // block) for k, t in enumerate(sizes)})
        want[f"s{i}"] = got, q, len(w)
        rows += [(f"s{i}", k, t, q, cap) for k, t in enumerate(sizes)]
    got = {}
    for r in shard_seats(spark.createDataFrame(rows, "source string, shard int, shard_total bigint, q bigint, cap int"), 16).collect():
        got.setdefault(r.source, {})[r.shard] = r.seats
    for s, (w, q, _) in want.items():
        have = got.get(s, {})
        assert sum(have.values()) == q
        assert all(abs(have.get(k, 0) - n) <= 1 for k, n in w.items()) and sum(have.get(k, 0) != n for k, n in w.items()) <= 2


@needs_vocabulary
def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randrange(1, 60))), s, "x") for i in range(900) for s in [rng.choice(["Big", " big", "BIG", "small-one", None, "unlisted"] if i % 9 else ["small_one"])]]
    rows += [(2000, None, "big", "x"), (2001, "", "big", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_tokens string")
    targets = spark.createDataFrame([("big", 0.4, 1), ("small_one", 0.5, 4), ("gone", 0.1, 2)], "source string, target_share double, max_repeat int")
    for shard in (10**9, 3000):
        got = mix(docs, targets, block=16, shard_tokens=shard).collect()
        caps = {"big": 1, "small_one": 4}
        assert got and all(1 <= r.repeats <= caps[r.source] for r in got) and len({r.doc_id for r in got}) == len(got)
        size = {s: sum(r.n_tokens * r.repeats for r in got if r.source == s) for s in caps}
        assert abs(size["big"] / sum(size.values()) - 0.4 / 0.9) < 0.03
    again = mix(docs.repartition(5), targets, block=16, shard_tokens=3000).collect()
    assert {(r.doc_id, r.repeats) for r in again} == {(r.doc_id, r.repeats) for r in got}
    shares = {r.source: r for r in mix_shares(docs, targets, block=16).collect()}
    assert shares["gone"].n_tokens == 0 and abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-4
    assert mix(docs.limit(0), targets).count() == 0 and mix(docs, targets.limit(0)).count() == 0


PLAIN = ["The old box is red.", "We saw it two times.", "Do not keep it.", "Then it is good."]
STANDARD = ["Before the next release the method reads the value again from the open folder, so the rating should stay as it is.", "Because the page needs a login, the warning appears only when the list is empty, but nobody has written a test for it."]
HARD = ["Notwithstanding the considerable maturity of the surrounding instrumentation, retrospective reconciliation of suppressed observations acquires substantial analytical importance within the organisation."]


def _doc(rng, level):
    pick = [PLAIN, STANDARD, HARD][level - 1]
    out, n = [], 0
    while n < 70:
        s = rng.choice(pick if rng.random() < 0.85 else PLAIN + STANDARD + HARD)
        out.append(s)
        n += len(s.split())
    return " ".join(out)


def test_reading_levels_on_held_out_grades(spark):
    rng = random.Random(8)
    truth = {i: rng.randrange(1, 4) for i in range(300)}
    docs = [(i, _doc(rng, v), "c") for i, v in truth.items()] + [(900, None, "c"), (901, "", "c"), (902, "Too short.", "c"), (903, "int a = b(c);\n" * 90, "c"), (904, "{\n" + '"k": "v w x",\n' * 80 + "}", "c")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    grades = spark.createDataFrame([(i, v) for i, v in truth.items() if i < 100] + [(5, 9), (6, None), (None, 1), (903, 2)], "doc_id bigint, reading_level int")
    got = {r.doc_id: r.reading_level for r in reading_levels(df, grades).collect()}
    assert set(got) == set(truth)
    held = [i for i in truth if i >= 100]
    assert sum(got[i] == truth[i] for i in held) >= 0.95 * len(held)
    assert {r.reading_level for r in reading_levels(df, grades.limit(0)).collect()} == {None}
    assert reading_levels(df.limit(0), grades).count() == 0


@pytest.mark.parametrize("ranked", [100_000, 3, 0])
def test_coverage_rank_by_brute_force(spark, monkeypatch, ranked):
    """The same ranks whether a document's words are among those that are broadcast, some of them or none."""
    monkeypatch.setattr(levels, "RANKED", ranked)
    texts = ["the a the b " * 15 + "the a the rare one is in it", "the b c in it is of " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    counts = prose_counts(df)
    words = [w for t in texts for s in read_prose(t).sentences for w in s]
    freq = {w: words.count(w) for w in words}
    place = {w: sum(freq[v] >= n for v in freq) for w, n in freq.items()}
    assert sorted(r.place for r in word_ranks(word_counts(counts)).collect()) == sorted(place.values())
    import math

    for r in coverage_features(counts).collect():
        own = sorted(place[w] for s in read_prose(texts[r.doc_id]).sentences for w in s)
        for share, f in ((0.5, r.k50), (0.75, r.k75), (0.9, r.k90)):
            want = min(k for k in own if sum(o <= k for o in own) >= share * len(own))
            assert abs(f - math.log(want)) < 1e-9


def test_prose_parts():
    p = read_prose("# Head\n\nThe cat is in\nthe house. It is v1.2.3 of CamelCase now!\n\n- one item of it\n- the next\n\n```\nint x;\n```\nEnd of it")
    assert p.lang is None and [len(s) for s in p.sentences] == [6, 4, 4, 2, 3]
    # a heading goes alone, also right before its paragraph
    assert read_prose("## Head of it\nThe cat is in the house.\n#1 of all").sentences == [["the", "cat", "is", "in", "the", "house"]]
