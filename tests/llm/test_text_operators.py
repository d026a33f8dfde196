"""License scan, chat formatting, media, packing, token counts and the two classifiers."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillon.llm import chat_format, language_id, license_scan, license_texts, media_matroska, packing, quality, token_counts
from quillon.llm.language_id import identify, learn_profiles
from quillon.llm.pieces import PieceEncoder
from quillon.llm.quality import learn_quality, score_quality
from tests.conftest import MEDIUM, SMALL

ODD = [None, "", " ", "a", "<|endoftext|> x", "İΣς ﬁ", "日本語 text", "it's  DON'T\u0085", "x" * 3000, "\n" * 50]
PLAIN = "doc_id long, text string"


def test_licenses_equal_brute_force(spark):
    texts = pq.read_table(f"{SMALL}/documents.parquet").to_pydict()
    mit = dict(license_scan.TEMPLATES)["mit-grant"]
    extra = [mit.upper(), mit.replace("copy,", "copy! and"), " ".join(mit.split()[:12]), "filler " * 200 + mit + " tail" * 90, *ODD]
    rows = [*zip(texts["doc_id"], texts["text"], strict=True), *((10_000 + i, t) for i, t in enumerate(extra))]
    got = {(r.doc_id, r.template): r.containment for r in license_scan.license_scan(spark.createDataFrame(rows, PLAIN)).collect()}
    want = {}
    for i, t in rows:
        mine = license_scan.shingles(license_scan.scan_words(t or ""), 5)
        for name, template in license_scan.TEMPLATES:
            s = license_scan.shingles(license_scan.scan_words(template), 5)
            if s and len(s & mine) / len(s) >= 0.8:
                want[i, name] = len(s & mine) / len(s)
    sets = {name: license_scan.shingles(license_scan.scan_words(t), 5) for name, t in license_scan.TEMPLATES}
    order = {name: k for k, name in enumerate(sets)}
    rank = lambda i, n: (round(want[i, n] * len(sets[n])), want[i, n], len(sets[n]), -order[n])
    beaten = {(i, n) for i, n in want for j, m in want if i == j and m != n and 2 * len(sets[n] & sets[m]) >= min(len(sets[n]), len(sets[m])) and rank(i, m) > rank(i, n)}
    want = {k: v for k, v in want.items() if k not in beaten}
    assert set(got) == set(want) and got[10_000, "mit-grant"] == 1.0 and got[10_003, "mit-grant"] == 1.0
    assert license_scan.license_scan(spark.createDataFrame([], PLAIN)).count() == 0


def test_each_license_is_found_as_itself_alone(spark):
    """Every template in the middle of other words, in upper case, is reported under its own name and no other's; rows may repeat and lack ids."""
    texts = [(i, f"some words {'filler ' * 30} {t.upper()} {'tail ' * 40}", name) for i, (name, t) in enumerate(license_scan.TEMPLATES)]
    rows = [(i, t) for i, t, _ in texts] * 2 + [(None, texts[0][1]), (None, texts[0][1])]
    got = license_scan.license_scan(spark.createDataFrame([(*r, 1) for r in rows], PLAIN + ", `template` int")).collect()
    names = {i: name for i, _, name in texts} | {None: texts[0][2]}
    assert len(got) == len(rows) and {(r.doc_id, r.template, r.containment) for r in got} == {(i, n, 1.0) for i, n in names.items()}


def test_whole_bodies_with_changes_are_found_and_others_are_not(spark):
    bodies = dict(license_texts.bodies())
    assert len(bodies) >= 12 and min(len(t.split()) for t in bodies.values()) > 700
    rng = random.Random(8)
    rows, want = [], set()
    for i, (name, text) in enumerate(bodies.items()):
        words = text.split()
        cut = len(words) // 3
        rows.append((i, " ".join(["before"] * 40 + words + ["after"] * 300)))
        # A tenth of the words changed, in one passage; and words changed here and there, up to a share that five words in a row still survive.
        rows.append((100 + i, " ".join([*words[:cut], *(f"other{k}" for k in range(len(words) // 10)), *words[cut + len(words) // 10 :]])))
        rows.append((200 + i, " ".join(w if rng.random() > 0.02 else f"x{rng.randrange(999)}" for w in words)))
        rows.append((300 + i, " ".join(w if rng.random() > 0.1 else f"x{rng.randrange(999)}" for w in words)))  # 0.9 ** 5 of the runs are left: below the threshold
        want |= {(i, name), (100 + i, name), (200 + i, name)}
    vocabulary = sorted({w for t in bodies.values() for w in t.split()})
    rows += [(1000 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([30, 500, 6000])))) for i in range(200)]
    got = {(r.doc_id, r.template): r.containment for r in license_scan.license_scan(spark.createDataFrame(rows, PLAIN).repartition(4)).collect() if r.template in bodies}
    assert set(got) == want  # precision and recall are 1
    assert all(got[i, n] == 1.0 for i, n in want if i < 100)


def test_negated_notices_are_not_reported(spark):
    texts = ["Released under the MIT License.", "This is not released under the MIT License.", "never was it Released under the MIT license", "Not so. It is now released under the MIT License.", "code isn't released under the MIT License, but it is released under the MIT License"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = [r.doc_id for r in license_scan.license_scan(spark.createDataFrame(rows, PLAIN)).collect() if r.template == "mit-notice"]
    assert got == [0, 3, 4]


def test_windows_hold_their_templates():
    for n in range(license_scan.NOTICE, 3000):
        power, blocks = license_scan.window_of(n)
        assert (blocks - 1) << power >= n and (power == 2 or n > 2 * ((blocks - 1) << power) / 3)
    assert license_scan.least_similarity(0.8) > 0.4


def test_licenses_of_very_long_and_repeated_texts(spark):
    gpl = dict(license_texts.bodies())["gpl-3.0"]
    rows = [(1, "word " * 400_000 + gpl), (None, gpl), (None, gpl), (2, gpl + "\n" + gpl)]
    got = license_scan.license_scan(spark.createDataFrame(rows, PLAIN)).collect()
    assert sorted((str(r.doc_id), r.template, r.containment) for r in got if r.template == "gpl-3.0") == [("1", "gpl-3.0", 1.0), ("2", "gpl-3.0", 1.0), ("None", "gpl-3.0", 1.0), ("None", "gpl-3.0", 1.0)]
    assert [r.word_start for r in got if r.doc_id == 1 and r.template == "gpl-3.0"][0] > 390_000


def test_bands_keep_their_promise():
    for similarity in (0.2, 0.5):
        n = license_scan.bands_needed(similarity, 2, 0.999)
        assert 1 - (1 - similarity**2) ** n >= 0.999 > 1 - (1 - similarity**2) ** (n - 1)


@pytest.mark.parametrize("text", ["", "\\", "\\s", "<s>", "</s>[INST] ok [/INST]", "[", "<\\/s>", "a\\[INST]\\\\", "x\ny", "[INST] [/INST]</s></s>"])
def test_turns_are_reversible(text):
    turns = [("user", text), ("assistant", text), ("system", text), ("tool</s>", text), ("", text)]
    assert chat_format.read_turns("".join(chat_format.format_turn(r, t)[0] for r, t in turns)) == turns


def test_prefix_tree_emits_shared_turns_once(spark):
    rng = random.Random(7)
    rows = []
    for c in range(60):
        for turn in range(rng.randint(1, 6)):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", f"{rng.choice('ab') if turn else 'same first'} {turn}"))
    rows += [(100, 0, None, None), (None, 0, "user", "q"), (101, 0, "user", "same first 0"), (101, 0, "assistant", "tie")]
    nodes, members = chat_format.prefix_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    n, m = {r.key: r for r in nodes.collect()}, members.collect()
    assert len(n) == nodes.count() and {r.key for r in m} == set(n)
    stream = sorted(n.values(), key=lambda r: r.token_start)
    assert stream[0].token_start == 0 and all(a.token_end == b.token_start for a, b in zip(stream, stream[1:], strict=False))
    for r in n.values():  # parents come first, and subtrees are in one piece
        line, k = [], r
        while k.parent:
            k = n[k.parent]
            line.append(k)
        assert all(a.token_start < r.token_start for a in line)
        seen = sorted(t for i in r.attends for t in range(i.start, i.end))
        assert seen == sorted(t for a in line for t in range(a.token_start, a.token_end)) and r.position_start == len(seen)
        inside = [x for x in stream if x.token_start >= r.token_start]
        below = set()
        for x in stream:
            if x.key == r.key or x.parent in below:
                below.add(x.key)
        assert [x.key in below for x in inside] == sorted((x.key in below for x in inside), reverse=True)
    back = {r.conv_id: r for r in chat_format.read_back(nodes, members).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for i, t, r, x in rows if i == c))
        assert back[c].n_turns == len(turns)
        assert back[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (back[c].loss_chars, back[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_prefix_tree_holds_no_path_that_grows_with_the_turns(spark):
    long = [(5, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(3000)]
    rows = [*long, *((9, *r[1:]) for r in long[:1200]), (9, 1200, "user", "other"), *((None, *r[1:]) for r in long[:700])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = df.selectExpr("conv_id", "struct(turn, role, text) AS t").repartition("conv_id").sortWithinPartitions("conv_id", "t")
    chains = turns.mapInArrow(chat_format._chains, "conv_id long, turn int, " + chat_format._NODE)
    assert "path" not in chains.columns and chains.count() == len(rows)
    assert max(len(r.prefix) for r in chat_format._paths(chains).collect()) <= 3 * 26
    nodes, members = chat_format.prefix_tree(df)
    n = {r.key: r for r in nodes.collect()}
    assert len(n) == 3001 and members.count() == len(rows)
    ends = {k: r.token_end for k, r in n.items()}
    for r in sorted(n.values(), key=lambda r: -r.depth):
        if r.parent:
            ends[r.parent] = max(ends[r.parent], ends[r.key])
    children: dict = {}
    for r in n.values():
        children.setdefault(r.parent, []).append((r.token_start, ends[r.key]))
    for k, found in children.items():  # subtrees of one parent lie side by side behind it
        at = n[k].token_end if k else 0
        for start, end in sorted(found):
            assert start == at
            at = end
    assert {r.conv_id: r.n_turns for r in chat_format.read_back(nodes, members).collect()} == {5: 3000, 9: 1201, None: 700}


def test_prefix_tree_of_nothing(spark):
    nodes, members = chat_format.prefix_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert nodes.count() == members.count() == 0 == chat_format.read_back(nodes, members).count()


def test_media_round_trip(spark):
    texts = [*ODD, "é" * 40_000, "same", "same"]
    rows = list(enumerate(texts))
    media = media_matroska.store(spark.createDataFrame(rows, PLAIN))
    back = {r.doc_id: r for r in media_matroska.read_back(media).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = back[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), None)
    assert back[len(texts) - 1].asDict() | {"doc_id": 0} == back[len(texts) - 2].asDict() | {"doc_id": 0}
    packets = media_matroska.packet_table(media).toPandas()
    assert packets.cued.all() and packets.error.isna().all() and (packets.byte_length == 576).all()
    assert packets.groupby("doc_id").size().to_dict() == {i: back[i].payload_bytes // 576 for i in back}
    assert media_matroska.store(spark.createDataFrame([], PLAIN)).count() == 0


def test_media_parses_lacing_unknown_sizes_and_damage(spark):
    m = media_matroska
    rng = random.Random(8)
    frames = [rng.randbytes(k) for k in (3, 700, 255, 0, 510, 90_000, 5)]
    for lacing in (m.XIPH, m.EBML_LACING):
        block = m._block(frames, 300, -5, lacing)
        group = m._element(m.BLOCK_GROUP, m._element(m.BLOCK, block) + m._element(m.REFERENCE_BLOCK, b"\x01"))
        data = m._id(m.EBML) + m.vint(0) + m._id(m.SEGMENT) + b"\x01" + b"\xff" * 7 + m._id(m.CLUSTER) + b"\xff" + m._uint(m.TIMESTAMP, 7) + m._element(0xEC, b"void") + group + m._element(m.CUES, b"")
        packets, _, _, error = m.parse(data)
        assert error is None and [data[p[2] : p[2] + p[3]] for p in packets] == frames
        assert {(p[0], p[1], p[4]) for p in packets} == {(300, 2_000_000, False)}
    whole = m.write(b"z" * 576 * 40)
    for cut in range(0, len(whole), 997):
        packets, _, _, error = m.parse(whole[:cut])
        assert error or not cut or len(packets) == 40
    rows = [(1, whole[:9000]), (2, b"junk"), (3, None), (4, b"")]
    table = m.packet_table(spark.createDataFrame(rows, "doc_id long, media binary"))
    assert {r.doc_id for r in table.collect()} == {1} or table.count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_equal_the_tokenizer(name):
    encoder = PieceEncoder(public_tokenizers.path(name), most=500)
    texts = [t or "" for t in ODD] + pq.read_table(f"{SMALL}/documents.parquet")["text"].to_pylist() + ["½ ² 's 'S  x’s “q” — … ŉ ſ_1_", "a\x1cb", "_'t'"]
    for at in range(0, len(texts), 20):
        for t, ids in zip(texts[at : at + 20], encoder.encode(texts[at : at + 20]), strict=True):
            assert ids.tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize(("chunk", "overlap"), [(16, 4), (100, 20)])
def test_counts_in_chunks_are_exact(chunk, overlap):
    encoder = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t or "" for t in ODD] + ["x " * 200 + "y" * 500 + " " * 300 + "<|endoftext|>" * 20 + "  a", "日本語 ab " * 80, "don't it's " * 60, "1234567 " * 90]
    for t in texts:
        assert token_counts.count_in_chunks(encoder, t, chunk, overlap) == len(encoder.tokenizer.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("most", [500, 200_000])
def test_counts_in_chunks_hold_when_the_table_is_replaced(most):
    encoder = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), most=most)
    rng = random.Random(3)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(90_000))
    assert len(set(encoder.split(text))) > 1 << 16
    assert token_counts.count_in_chunks(encoder, text) == len(encoder.tokenizer.encode(text, add_special_tokens=False).ids)


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [*enumerate(ODD), (None, "null id"), (1, "twice")]
    got = token_counts.token_counts(spark.createDataFrame([(i, t, 5) for i, t in rows], PLAIN + ", n_tokens int"), path, limit=100, chunk=64, overlap=8).collect()
    tokenizer = PieceEncoder(path).tokenizer
    want = [(i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert token_counts.token_counts(spark.createDataFrame([], PLAIN), path).count() == 0


def test_assignment_fills_every_sequence():
    rng = random.Random(9)
    for _ in range(20):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 60))]
        bins, spare = packing.assign(lengths, 64, 1.0, 1 / 64)
        assert all(sum(n for _, _, n in b) == 64 for b in bins) and sum(n for _, _, n in spare) < 64
        got = {}
        for item, start, n in [p for b in bins for p in b] + spare:
            got.setdefault(item, []).append((start, n))
        for item, length in enumerate(lengths):
            at = 0
            for start, n in sorted(got[item]):
                assert start == at and n > 0
                at += n
            assert at == length


def test_costs_are_more_even_than_in_order_of_arrival():
    rng = random.Random(10)
    lengths = [min(4096, int(rng.lognormvariate(6, 1))) + 1 for _ in range(2000)]
    bins, _ = packing.assign(lengths, 4096, 1.0, 1 / 4096)
    balanced = np.std([sum(packing.attention_cost(n, 1.0, 1 / 4096) for _, _, n in b) for b in bins])
    costs, cost, room = [], 0.0, 4096
    for length in lengths:
        while length:
            take = min(length, room)
            cost, room, length = cost + packing.attention_cost(take, 1.0, 1 / 4096), room - take, length - take
            if not room:
                costs.append(cost)
                cost, room = 0.0, 4096
    assert balanced < np.std(costs)


def test_packs_hold_every_id_once_without_padding(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = pq.read_table(f"{SMALL}/documents.parquet")["text"].to_pylist()
    rows = [*enumerate([*ODD, *texts])]
    got = packing.pack(spark.createDataFrame(rows, PLAIN).repartition(3), path, pool_tokens=20_000).toPandas()
    tokenizer = PieceEncoder(path).tokenizer
    for i, t in rows:
        mine = got[got.doc_id == i].sort_values("start")
        ids = np.concatenate([np.frombuffer(b, "<u4") for b in mine.ids])
        assert ids.tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert mine.start.tolist() == [0, *np.cumsum(mine.length)[:-1]] and set(mine.doc_tokens) == {len(ids)}
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]]
        total = int(s.length.sum())
        assert total <= 4096 and total & (total - 1) == 0
    assert packing.pack(spark.createDataFrame([], PLAIN), path).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    profiles = learn_profiles(docs.where("doc_id % 4 <> 2").select("doc_id", "text", "lang"))
    got = identify(docs.where("doc_id % 4 = 2").select("doc_id", "text", "lang", "n_chars"), profiles).toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_of_odd_texts(spark):
    train = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "de"), ("...", "en"), ("x", None)])], "doc_id long, text string, lang string")
    profiles = learn_profiles(train)
    assert profiles.languages == ("de", "en")
    rows = [(1, None, "a"), (2, "", "a"), (3, "12 .. !", "a"), (4, "the dog", "a"), (5, "und der", "a"), (None, "日本", "a"), (6, "the dog " * 100_000, "a")]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, Score string"), profiles).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and [got[i].score for i in (1, 2, 3)] == [0.0] * 3
    assert (got[4].lang_pred, got[5].lang_pred, got[6].lang_pred) == ("en", "de", "en") and got[None].lang_pred in ("de", "en")
    none = learn_profiles(train.limit(0))
    assert {r.lang_pred for r in identify(spark.createDataFrame(rows, "doc_id long, text string, Score string"), none).collect()} == {"und"}
    assert identify(train.limit(0), profiles).count() == 0


def test_quality_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").selectExpr("doc_id", "quality AS label")
    model = learn_quality(docs.join(labels.where("doc_id % 3 <> 1"), "doc_id"))
    got = score_quality(docs.join(labels.where("doc_id % 3 = 1"), "doc_id"), model).toPandas()
    assert (got.predicted == got.label).mean() > 0.95 and got.score.between(0, 1).all()
    p = np.clip(got.score, 1e-6, 1 - 1e-6)
    assert -np.mean(np.where(got.label == 1, np.log(p), np.log(1 - p))) < 0.2
    odd = score_quality(spark.createDataFrame([*((i, t, "q") for i, t in enumerate(ODD)), (None, "a", "q")], "doc_id long, text string, predicted string"), model).toPandas()
    assert len(odd) == len(ODD) + 1 and odd.score.between(0, 1).all() and odd.score[0] == odd.score[1] == odd.score[2]


def test_quality_without_labels(spark):
    train = spark.createDataFrame([(1, "a b", 1), (2, "c d", None)], "doc_id long, text string, label int")
    model = learn_quality(train)
    assert model is None
    assert {r.score for r in score_quality(train, model).collect()} == {0.5}
    assert score_quality(train.limit(0), model).count() == 0


def test_roles_come_back_whatever_they_hold(spark):
    roles = ["tool\nx", "tool\\", "a</s>\n", "\n", "<s>[INST]", "", None, "tool\\\nx"]
    rows = [(1, i, r, "text\n" + (r or "")) for i, r in enumerate(roles)] + [(2, 0, "user", "u" * 100_000), (2, 1, "assistant", "b\\" * 50_000)]
    got = {r.conv_id: r for r in chat_format.read_back(*chat_format.prefix_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    plain = {c: "".join(f"{r or ''}\n{t}\n" for k, _, r, t in rows if k == c) for c in (1, 2)}
    assert {c: r.turns_sha256 for c, r in got.items()} == {c: hashlib.sha256(p.encode()).hexdigest() for c, p in plain.items()}
    assert got[2].loss_chars == 100_000


def test_a_full_piece_table_keeps_what_it_learned_first():
    encoder = PieceEncoder(public_tokenizers.path("word_bpe_49k.json"), most=100)
    for k in range(6):
        text = " ".join(["the", "same", *[f"w{i}x{k}" for i in range(60)]])
        assert encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert "the" in encoder.index


def test_language_scores_equal_a_plain_cosine(spark):
    """Vectors by dictionaries of single letters: trigrams within words padded by a boundary, letters rotated by their place."""
    texts = [(1, "abc ab", "x"), (2, "xyz Zx", "y"), (3, "日本 語", "z"), (4, "ab-xy", None)]
    dim = 256
    letter = lambda c: np.random.default_rng([c, 9]).integers(0, 2, dim) * 2.0 - 1

    def vector(text):
        n = [0, *(ord(c) if c.isalpha() else 0 for c in text.lower()), 0]
        out = sum(np.roll(letter(n[i - 1]), 2) * np.roll(letter(n[i]), 1) * letter(n[i + 1]) for i in range(1, len(n) - 1) if n[i])
        return out / np.linalg.norm(out)

    train = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    got = identify(train.withColumn("a.b", F.lit(1)), learn_profiles(train, dim=dim)).collect()
    languages = {g: vector(t) for _, t, g in texts if g}
    for r in got:
        cosine = {g: float(v @ vector(r.text)) for g, v in languages.items()}
        assert r.lang_pred == max(cosine, key=cosine.get) and abs(r.score - max(cosine.values())) < 1e-4


def test_letters_beyond_the_table_change_nothing(monkeypatch):
    text = [" ".join(chr(0x4E00 + i) + chr(0x4E00 + 7 * i) for i in range(300))]
    want = language_id._encode(language_id._Encoder(64), text)[0]
    monkeypatch.setattr(language_id, "_LETTERS", 5)
    assert np.array_equal(want, language_id._encode(language_id._Encoder(64), text)[0])


def test_quality_features_equal_plain_means():
    words = {b"good": 0, b"text": 1}
    vectors = quality.own_vectors(words)
    pooler = quality._Pooler(words, vectors, most=3)
    for text in (b"good text good", b"Rare-1 rare " + b"Q" * 5000 + b" good", b"a b c d e f g h", b"good"):
        mine = text.split()
        rows = [vectors[words[w] if w in words else 2 + zlib.crc32(w) % quality.SHARED] for w in mine]
        looks = [quality.index_vector(quality.shape(w)) for w in mine]
        want = np.concatenate([np.mean(rows, axis=0), np.mean(looks, axis=0), [1 - len(set(mine)) / len(mine)]])
        assert np.allclose(pooler.pool(mine), want, atol=1e-5)
    assert quality.shape(b"AbC12-x" * 9) == b"\x00" + b"AaA0-a" * 9 and quality.shape("éa9".encode()) == b"\x00a0"


def test_quality_of_repeated_rows_and_other_names(spark):
    train = spark.createDataFrame([(i, f"{'good fine' if i % 2 else 'bad! poor?'} w{i}", i % 2, i) for i in range(40)] * 2, "doc_id long, text string, label int, `a.b` int")
    got = score_quality(train.withColumnRenamed("label", "Score"), learn_quality(train))
    assert got.columns == ["doc_id", "text", "a.b", "score", "predicted"] and got.count() == 80
    assert got.groupBy("doc_id").agg(F.count_distinct("score").alias("n")).where("n > 1").count() == 0
