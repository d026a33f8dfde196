"""Prefix trie, fill-in-the-middle and MinHash near dedup against brute force, and their odd cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import confirm, odd_sketch, prefix_trie as trie
from quillon.llm.fill_in_middle import PackedBits, fill_in_middle, restore
from quillon.llm.odd_sketch import band_keys, estimate, min_samples, minhash_near_duplicates, odd_sketches, sketch_limit
from quillon.llm.prefix_trie import ordered_turns, prefix_trie, rebuilt

CONV = "conv_id long, turn long, role string, text string, `pos` string"


def trie_by_brute_force(rows, splice=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = own
    if splice:
        made = {}
        for c, v in own.items():
            h = zlib.crc32(str(c).encode()) % 4
            made[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + v[h:]
    nodes = {}
    for c, v in made.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    words = lambda t: len(t.encode().split())
    out = []
    for k, members in nodes.items():
        below = [(x, m) for x, m in nodes.items() if x[: len(k)] == k]
        children = [x for x, _ in below if len(x) == len(k) + 1]
        ends = ",".join(str(c) for c in sorted(c for c in members if len(made[c]) == len(k)))
        out.append((
            min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(children),
            sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y, _ in below) for x, _ in below),
            sum((len(m) - 1) * words(x[-1][1]) for x, m in below if x), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=lambda r: (r[1], r[0]))


def trie_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[1], r[0]))


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 45), *range(-25, -18), 1000, 10**15]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "a  b\n", "", "é c d"])))
    rows += [(2, None, None, None), (2, None, "user", "x"), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (None, 1, "user", "lost"), (61, 0, "r", None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,first", [(1, 1), (2, 4)])
def test_trie_equals_brute_force(spark, monkeypatch, seed, first):
    monkeypatch.setattr(trie, "FIRST_BLOCK", first)
    monkeypatch.setattr(trie, "PIECE", 2)
    rows = conversations(seed)
    df = spark.createDataFrame([(*r, "z") for r in rows], CONV).repartition(7)
    assert trie_rows(prefix_trie(*rebuilt(*ordered_turns(df)))) == trie_by_brute_force(rows)
    assert trie_rows(prefix_trie(*ordered_turns(df))) == trie_by_brute_force(rows, splice=False)


def test_trie_of_long_copies_that_span_partitions(spark):
    rows = [(c, t, "user", f"turn {t}" if c < 3 or t < 37 else f"other {c}") for c in (0, 1, 2, 5) for t in range(60)] + [(9, 0, "user", "turn 0")]
    df = spark.createDataFrame([(*r, "z") for r in rows], CONV).repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else one partition holds all
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        turns, lengths = ordered_turns(df)
        assert lengths.where("conv_id = 0").first().n == 60
        assert trie_rows(prefix_trie(turns, lengths)) == trie_by_brute_force(rows, splice=False)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_trie_of_nothing_and_of_conversations_without_turns(spark):
    empty = spark.createDataFrame([], CONV)
    assert prefix_trie(*rebuilt(*ordered_turns(empty))).count() == 0
    alone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)  # no conversation 0 to begin with, and too short itself
    df = spark.createDataFrame([(alone, 0, "user", "a", "z")], CONV)
    assert trie_rows(prefix_trie(*rebuilt(*ordered_turns(df)))) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


@pytest.mark.parametrize("size", [0, 1, 63, 64, 511, 512, 513, 5000])
def test_rank_and_select_are_the_plain_ones(size):
    bits = np.random.default_rng(size).random(size) < 0.3
    packed = PackedBits(bits)
    assert packed.rank(np.arange(size + 1)).tolist() == np.concatenate([[0], np.cumsum(bits)]).tolist()
    assert packed.ones == bits.sum()
    assert packed.select(np.arange(packed.ones)).tolist() == np.flatnonzero(bits).tolist()


FIM_ROWS = [
    (0, "one two  three\n four "), (1, ""), (2, None), (3, "  \t"), (4, "a <P> b"), (5, "x" * 70000), (6, " lead \x1f sep\x00 é日本 \x0b end"), (None, "no id at all here"),
    (7, "same text again"), (7, "same text again"), (8, "\n\n\n a\n"), (9, "<M"), (-5, "S> a <"), *((100 + i, " ".join(f"w{j}" for j in range(i))) for i in range(60)),
]


def fim_by_brute_force(i, text, rate, spm):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate,spm", [(50, 80), (100, 30)])
def test_fill_in_middle_equals_brute_force_and_comes_back(spark, rate, spm):
    df = spark.createDataFrame([(i, t, "k", "clash", "d.t") for i, t in FIM_ROWS], "doc_id long, text string, `h1` string, form string, `a.b` string").repartition(3)
    out = fill_in_middle(df, rate, spm)
    assert out.columns == ["doc_id", "text", "h1", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("restored", restore(out)).collect()
    key = lambda r: (str(r[0]), r[1] or "")
    want = sorted(((i, t, *fim_by_brute_force(i, t, rate, spm)) for i, t in FIM_ROWS), key=key)
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == want
    assert all(r.restored == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(df.limit(0)).count() == 0


def minhash_by_brute_force(rows):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set()))
    least = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for x in range(len(rows)):
            for y in range(x):
                if sets[x] and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                    m = min((v for v in (least[x], least[y]) if v is not None), default=None)
                    changed |= (least[x], least[y]) != (m, m)
                    least[x] = least[y] = m
    return [(i, len(s), c, i == c) for (i, _), s, c in zip(rows, sets, least, strict=True)]


def near_texts(seed, families=6, copies=9):
    rng = random.Random(seed)
    rows, i = [], 0
    for f in range(families):
        base = [f"f{f}w{rng.randint(0, 400)}" for _ in range(rng.choice([20, 90, 300]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
            rows.append((i, rng.choice([" ", "\n"]).join(w)))
            i += 1
    rows += [(900, ""), (901, None), (902, "  "), (903, "one"), (904, "ONE"), (905, "one two"), (None, "one"), (None, "Null only"), (None, "null ONLY"), (906, "é É"), (907, "é é")]
    rows += [rows[0], (950, rows[0][1].upper()), (951, " ".join(f"v{j}" for j in range(30000))), (952, " ".join(f"v{j}" for j in range(29000)))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,key_rows,family_rows", [(1, 2000, 2000), (2, 3, 4)])
def test_minhash_near_duplicates_equal_brute_force(spark, monkeypatch, seed, key_rows, family_rows):
    monkeypatch.setattr(confirm, "KEY_ROWS", key_rows)
    monkeypatch.setattr(confirm, "FAMILY_ROWS", family_rows)
    monkeypatch.setattr(confirm, "PIVOTS", 1)
    rows = near_texts(seed)
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, node string").repartition(5)
    got = [tuple(r) for r in minhash_near_duplicates(df).collect()]
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    want = sorted(minhash_by_brute_force(rows), key=key)
    assert sorted(got, key=key) == want
    assert len({r[2] for r in want}) < len(want) - 20  # there is something to link


def test_minhash_of_nothing_and_of_words_alone(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_near_duplicates(empty).count() == 0
    blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, minhash_near_duplicates(blank).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_a_family_of_copies_that_only_their_source_joins(spark):
    """Each copy changes other words, so copies are below the threshold to each other and above it to their source."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    rows = [(500, " ".join(base))]
    for i in range(120):
        w = list(base)
        for k in rng.sample(range(0, 300, 4), 6):
            w[k] = f"c{i}x{k}"
        rows.append((i, " ".join(w)))
    got = minhash_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {(r.component_id, r.kept) for r in got} == {(0, False), (0, True)}
    assert len({c for _, _, c, _ in minhash_by_brute_force(rows[1:])}) > 100  # hardly any two copies are linked directly


def test_samples_and_sketches_estimate_similarity():
    rng = np.random.default_rng(4)
    errors = []
    for similarity in (0.95, 0.85, 0.7):
        n = 2000
        same = round(n * 2 * similarity / (1 + similarity))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[:same], rng.integers(0, 1 << 63, n - same, dtype=np.uint64)])
        values = min_samples(np.concatenate([a, b]), np.array([0, n, 2 * n]), 130)
        sketches = odd_sketches(values)
        apart = int(np.unpackbits(sketches[0] ^ sketches[1]).sum())
        errors.append(abs(estimate(apart, 130) - similarity))
        if similarity >= 0.85:
            assert apart <= sketch_limit(0.85, 130)
    assert max(errors) < 0.12
    values = np.arange(260, dtype=np.uint32).reshape(2, 130)
    assert band_keys(values, 26, 5).shape == (2, 26) and len(np.unique(band_keys(values, 26, 5))) == 52


def test_band_settings_keep_their_promise():
    assert (1 - 0.85**odd_sketch.ROWS) ** odd_sketch.BANDS < 3e-7


def test_large_families_finish_when_no_member_is_linked(spark, monkeypatch):
    """Members that meet but are below the threshold: all pairs have to be tried, in rounds of more and more pivots."""
    monkeypatch.setattr(confirm, "KEY_ROWS", 2)
    monkeypatch.setattr(confirm, "FAMILY_ROWS", 5)
    monkeypatch.setattr(confirm, "PIVOTS", 2)
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(i, f"{shared} " + " ".join(f"d{i}x{j}" for j in range(20))) for i in range(30)]
    got = minhash_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.kept for r in got) and len(got) == 30


def test_plans_hold_no_cross_join(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c d")], "doc_id long, text string")
    plan = fill_in_middle(df).where(F.col("n") > 0)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan
