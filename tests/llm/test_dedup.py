"""Substring dedup, near dedup and decontamination against brute force, and their odd cases."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm.components import components
from quillon.llm.decontamination import contamination
from quillon.llm import near_dedup
from quillon.llm.near_dedup import near_duplicates, near_links, segments_needed, similar_documents, simhash
from quillon.llm.skew import join_unique
from quillon.llm.substring_dedup import remove_repeated_spans

DOCS = "doc_id long, text string, lang string, G string"


def words_of(text):
    return (text or "").encode().split()


def spans_by_brute_force(rows, width):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.append((i, b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode(), len(w), sum(gone)))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "ß x", "日本"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 25))] for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 20))]
        rows.append((i, rng.choice([" ", "  ", "\n", "\t "]).join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_equal_brute_force(spark, seed):
    rows = [*corpus(seed), (None, "a b c d e f g h"), (500, None), (501, ""), (502, "  \n"), (7, corpus(seed)[7][1]), (503, " ".join(f"x{i}" for i in range(20000)))]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame([(i, t, "en", "z") for i, t in rows], DOCS).repartition(5)
    got = remove_repeated_spans(df, width=5, group_bytes=2000).select("doc_id", "text", "n_words", "n_removed", "lang", "G").collect()
    want = spans_by_brute_force(rows, 5)
    key = lambda r: (r[0] is None, r[0], r[1])
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(want, key=key)
    assert {tuple(r)[4:] for r in got} == {("en", "z")}


def test_spans_keep_text_that_loses_nothing(spark):
    df = spark.createDataFrame([(1, "a  b\nc"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in remove_repeated_spans(df, normalise=False).collect()} == {1: "a  b\nc", 2: None}


def test_spans_of_an_empty_table_and_small_sketch(spark):
    assert remove_repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tight = remove_repeated_spans(df, width=5, load=0, group_bytes=3000).select("doc_id", "text", "n_words", "n_removed").collect()
    assert sorted(map(tuple, tight)) == sorted(spans_by_brute_force(rows, 5))


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


@pytest.mark.parametrize("letters", [16, 64, 1024, 2048, 4096])
def test_spans_tell_words_apart_that_polynomials_confuse(spark, letters):
    same, word = [f"s{i}" for i in range(12)], thue_morse(letters)
    rows = [(1, " ".join([word, *same])), (2, " ".join([word.translate(str.maketrans("ab", "ba")), *same])), (3, " ".join([word, *same]))]
    got = remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 13}


def test_spans_pass_columns_of_any_name_through(spark):
    df = spark.createDataFrame([(1, "a b c", 1, "x", ("y",))], "doc_id long, text string, `a b` int, `a.b` string, `c``d` struct<`e f`: string>")
    out = remove_repeated_spans(df)
    assert out.columns == ["doc_id", "text", "n_words", "n_removed", "a b", "a.b", "c`d"]
    assert tuple(out.first())[4:] == (1, "x", ("y",))


def test_spans_of_many_rows_without_an_id_or_with_one_id(spark):
    passage = " ".join(f"p{i}" for i in range(13))
    df = spark.range(30_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).cast("long").alias("doc_id"), F.concat(F.lit(passage + " "), F.col("id").cast("string")).alias("text"))
    out = remove_repeated_spans(df.unionByName(spark.createDataFrame([(8, passage)], "doc_id long, text string")), group_bytes=100_000)
    assert {tuple(r) for r in out.groupBy("doc_id", "n_removed").count().collect()} == {(None, 0, 15_000), (7, 0, 15_000), (8, 13, 1)}


def fingerprint_plainly(text):
    w = words_of((text or "").encode().lower().decode() if text and text.isascii() else "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * counts[i] > len(shingles))


def test_simhash_is_the_plain_one(spark):
    rows = [(i, t) for i, t in corpus(4, 40)] + [(100, None), (101, ""), (102, "A b C"), (103, "ÄÖ Äö x Y z")]
    got = {r.doc_id: r.fingerprint % 2**64 for r in simhash(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: fingerprint_plainly(t) for i, t in rows}


def reachable(values, most):
    up = {v: v for v in values}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= most:
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in values}


@pytest.mark.parametrize("key_rows,piece_rows", [(1000, 1000), (2, 1000), (2, 5)])
def test_links_join_what_chains_of_near_values_join(spark, monkeypatch, key_rows, piece_rows):
    monkeypatch.setattr(near_dedup, "KEY_ROWS", key_rows)
    monkeypatch.setattr(near_dedup, "PIECE_ROWS", piece_rows)
    rng = random.Random(5)
    values = {0, 2**64 - 1, 2**63, *(rng.getrandbits(32) for _ in range(40)), *(rng.getrandbits(32) << 32 | 5 for _ in range(40))}
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            values.add(x)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
    values = sorted(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    links = near_links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), 4)
    roots = {r.node: r.root for r in components(links).collect()}
    want = reachable(values, 4)
    groups, expected = {}, {}
    for v, s in zip(values, signed, strict=True):
        groups.setdefault(roots.get(s, s), set()).add(v)
        expected.setdefault(want[v], set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_long_chain_a_star_and_nothing(spark):
    rows = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {1000 + i: 1000 for i in range(40)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_unique_splits_hot_keys_and_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr("quillon.llm.skew.ROWS", 10)
    left = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS k")
    out = join_unique(left, left.select("k").distinct().selectExpr("k", "k * 2 AS v").where("k <> 4"), "k", "id")
    assert sorted((r.id, r.k, r.v) for r in out.collect()) == sorted((i, k, 2 * k) for i in range(1000) for k in [1 if i % 3 == 0 else i] if k != 4)


def test_near_duplicates_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(300))
    rows = [(5, long, "x"), (3, long.upper(), "x"), (9, long + " more", "x"), (1, None, "x"), (2, " ", "x"), (None, "other text here now", "x"), (5, long, "x")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.component_id) for r in got) == [(False, 1, 1), (False, 2, 1), (False, 3, 3), (False, 5, 3), (False, 5, 3), (False, 9, 3), (True, None, None)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(150):
        base = rng.choice(rows)[1].split() if rows and rng.random() < 0.5 else [f"v{rng.randrange(400)}" for _ in range(rng.randint(1, 150))]
        if rng.random() < 0.5:
            base = [*base[:-1], f"e{i}"]
        rows.append((1000 - i, " ".join(base)))
    prints = {i: fingerprint_plainly(t) for i, t in rows}
    root = reachable(sorted(set(prints.values())), 4)
    least = {}
    for i, p in prints.items():
        least[root[p]] = min(least.get(root[p], i), i)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.fingerprint % 2**64, r.component_id) for r in got} == {i: (p, least[root[p]]) for i, p in prints.items()}
    assert len(set(least.values())) < len(set(prints.values()))


def similar_plainly(rows, shingle=5, least=80):
    """The least id of each document's component, by comparing all pairs of shingle sets."""
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in sets}


def changed(rng, base, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in base]


def test_similar_documents_equal_brute_force(spark):
    rng = random.Random(12)
    rows = [(900, None), (901, ""), (902, "A b"), (903, "a B"), (904, "b a")]
    for i in range(100):
        base = (rng.choice(rows)[1] or "z").split() if i > 5 and rng.random() < 0.6 else [f"v{rng.randrange(3000)}" for _ in range(rng.choice([3, 40, 200, 700]))]
        rows.append((i, " ".join(changed(rng, base, rng.choice([0, 0.004, 0.01, 0.05])))))
    rows.append((999, " ".join(f"v{k}" for k in range(50_000))))
    got = similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = similar_plainly(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert want[901] == 901 and want[903] == want[902] != want[904] and len(set(want.values())) < 95


def test_similar_documents_recall_at_the_threshold_and_no_link_below(spark):
    """Pairs of 300 words with ever more changed: of those of similarity 0.8 to 0.83 at least 0.95 are linked, of those below none."""
    rng = random.Random(13)
    rows = []
    for i in range(900):
        base = [f"v{rng.randrange(50_000)}" for _ in range(300)]
        rows += [(i, " ".join(base)), (10_000 + i, " ".join(changed(rng, base, rng.choice([0.018, 0.024, 0.03]))))]
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    text = dict(rows)

    def similarity(i):
        a, b = ({tuple(w[k : k + 5]) for k in range(296)} for w in (text[i].split(), text[10_000 + i].split()))
        return len(a & b) / len(a | b)

    alike = {i: similarity(i) for i in range(900)}
    near = [i for i, s in alike.items() if 0.8 <= s < 0.83]
    assert len(near) > 60 and sum(got[10_000 + i] == i for i in near) >= 0.95 * len(near)
    assert all(got[10_000 + i] == 10_000 + i for i, s in alike.items() if s < 0.8)
    above = [i for i, s in alike.items() if s >= 0.83]
    assert sum(got[10_000 + i] == i for i in above) >= 0.98 * len(above)


def test_segments_grow_with_their_width():
    assert 5 < segments_needed(24, 0.8) < segments_needed(30, 0.8) < segments_needed(40, 0.8) < 90


def test_similar_documents_spare_shared_halves_and_phrases(spark):
    rng = random.Random(14)
    rows = []
    for i in range(60):
        base = [f"v{rng.randrange(5000)}" for _ in range(300)]
        rows.append((i, " ".join(base)))
        rows.append((2000 + i, " ".join([*base[:100], *[f"o{rng.randrange(5000)}" for _ in range(200)]])))
        rows.append((3000 + i, " ".join([*(["the same phrase over and over"] * 60), *[f"p{rng.randrange(5000)}" for _ in range(120)]])))
    got = similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.doc_id == r.component_id for r in got)


def contaminated_by_brute_force(docs, items, window):
    import re

    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    out = {}
    for i, t in docs:
        w = split(t)
        hit, found = set(), set()
        for j, u in items:
            v = split(u)
            n = min(len(v), window)
            for s in range(len(v) - n + 1 if v else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(j))
        out[i] = (len(w), len(hit), sorted(found), bool(hit))
    return out


@pytest.mark.parametrize("short", [False, True])
def test_contamination_equals_brute_force(spark, short):
    rng = random.Random(6)
    vocabulary = ["The", "the", "a", "b2", "É", "é", "x", "y"]
    items = [(j, ", ".join(rng.choice(vocabulary) for _ in range(rng.randint(5 if not short else 1, 14)))) for j in range(12)] + [(90, None), (91, "?!"), (3, "the a the a b2")]
    docs = []
    for i in range(60):
        parts = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.6:
            parts += rng.choice(items[:12])[1].split(", ")
        docs.append((i, "-".join(parts)))
    docs += [(100, None), (101, ""), (102, "...")]
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, N_hit string")
    got = contamination(df, spark.createDataFrame(items, "item_id long, text string"), window=5, gram=3)
    assert got.columns == ["doc_id", "text", "n_words", "n_hit", "item_ids", "contaminated"]
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got.collect()} == contaminated_by_brute_force(docs, items, 5)


def test_contamination_of_null_and_repeated_ids_and_clashing_names(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(None, item, "a"), (None, "clean", "b"), (1, "x " + item, "c"), (1, "clean too", "d"), (1, "x " + item, "c")]
    docs = spark.createDataFrame([(*r, 5, 6, 7, 8) for r in rows], "doc_id long, text string, `a.b` string, __found int, __of int, k int, `l m` int")
    got = contamination(docs, spark.createDataFrame([(1, item), (None, item)], "item_id long, text string"))
    assert got.columns == [*docs.columns, "n_words", "n_hit", "item_ids", "contaminated"]
    want = [(i, t, x, 5, 6, 7, 8, len(t.split()), 10 * (item in t), ["1"] * (item in t), item in t) for i, t, x in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_contamination_by_many_items_that_share_a_gram(spark):
    shared = "in the course of the"
    items = spark.range(5000).select(F.col("id").alias("item_id"), F.concat_ws(" ", *[F.concat(F.lit(f"a{k}x"), "id") for k in range(5)], F.lit(shared), *[F.concat(F.lit(f"b{k}x"), "id") for k in range(5)]).alias("text"))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"say {shared} day "), F.when(F.col("id") == 7, F.lit("a0x9 a1x9 a2x9 a3x9 a4x9 in the course of the b0x9")).otherwise("")).alias("text"))
    assert [(r.doc_id, r.n_hit, r.item_ids) for r in contamination(docs, items).where("contaminated").collect()] == [(7, 11, ["9"])]


@pytest.mark.parametrize("rows", [0, 10**9])
def test_contamination_is_alike_with_and_without_broadcasts(spark, monkeypatch, rows):
    monkeypatch.setattr("quillon.llm.decontamination.BROADCAST_ROWS", rows)
    items = [(1, "a b c d e f"), (2, "b c"), (3, "z")]
    docs = [(1, "x a b c d e f y"), (2, "b b c"), (3, "a b d e f"), (4, "z z"), (5, None), (6, "c d e f g a b c d e"), (7, " ".join(["q"] * 30_000 + ["b", "c"]))]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=5, gram=3)
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got.collect()} == contaminated_by_brute_force(docs, items, 5)


def test_contamination_by_a_window_of_many_items_in_many_documents(spark):
    """Two thousand items share a window with two thousand documents: lists are made once, pairs never."""
    shared = " ".join(f"s{i}" for i in range(10))
    items = spark.range(2000).selectExpr("id AS item_id", f"concat('{shared} own', id) AS text")
    docs = spark.range(2000).selectExpr("id AS doc_id", f"concat('a b {shared} c', id) AS text")
    out = contamination(docs, items, lists={"n": lambda ids: F.size(ids), "least": lambda ids: F.array_min(ids)})
    assert out.columns == ["doc_id", "text", "n_words", "n_hit", "n", "least", "contaminated"]
    assert [tuple(r) for r in out.groupBy("n", "least", "n_hit", "contaminated").count().collect()] == [(2000, "0", 10, True, 2000)]


def test_contamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in contamination(docs, items).collect()] == [0]
    assert contamination(docs.limit(0), items).count() == 0


def test_contamination_has_no_python_in_its_plan(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string").where(F.col("doc_id") > 0)
    plan = contamination(docs, spark.createDataFrame([(1, "a b c")], "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
