"""One query per numbered operator: the operator with production parameters over its whole table, cut to its contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.columns import small_batches
from quillon.sources.tables import spread

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *columns)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.substring_dedup import remove_repeated_spans

    out = remove_repeated_spans(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.license_scan import license_scan

    return license_scan(_documents(spark, sf_dir))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.chat_format import prefix_tree, read_back

    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return read_back(*prefix_tree(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)))


def op4_media_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.media_matroska import read_back, store

    return read_back(store(_documents(spark, sf_dir))).drop("error")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.decontamination import contamination

    lists = {"n_items": lambda ids: F.size(ids).cast("long"), "items_sha256": lambda ids: F.sha2(F.array_join(ids, ","), 256)}
    out = contamination(spread(_documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), lists=lists)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from quillon.llm.packing import pack

    out = pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from quillon.llm.token_counts import token_counts

    return token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.quality import held_out, learn_quality, score_quality

    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    model = learn_quality(docs.join(labels, "doc_id"))
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.language_id import held_out, identify, learn_profiles

    profiles = learn_profiles(_documents(spark, sf_dir, "lang").where(~held_out(2, 4)))
    return identify(_documents(spark, sf_dir), profiles).select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.near_dedup import near_duplicates

    out = near_duplicates(_documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.prefix_trie import ordered_turns, prefix_trie, rebuilt

    return prefix_trie(*rebuilt(*ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.fill_in_middle import fill_in_middle, restore

    out = fill_in_middle(_documents(spark, sf_dir))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(out), 256).alias("restored_sha256"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.odd_sketch import minhash_near_duplicates

    return minhash_near_duplicates(_documents(spark, sf_dir))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_substring_dedup, op2_license_scan, op3_chat_format, op4_media_matroska, op5_benchmark_decontamination, op6_packing, op7_token_counts, op8_quality_classifier, op9_language_id, op10_simhash_near_dedup, op11_prefix_trie, op12_fill_in_middle, op13_minhash_near_dedup)}

ORACLE: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM documents),
        win AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS i FROM w),
        keyed AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM win),
        least_id AS (SELECT k, min(doc_id) AS d FROM keyed GROUP BY k),
        gone AS (
            SELECT DISTINCT doc_id, i + j AS p
            FROM (SELECT doc_id, i, unnest(range(0, 13)) AS j FROM keyed JOIN least_id USING (k) WHERE d < doc_id)),
        pos AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
            FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op5_benchmark_decontamination": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
        b AS (
            SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
        iw AS (
            SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k
            FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
        dw AS (
            SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
            FROM (SELECT doc_id, ws, n, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM iw))),
        hit AS (SELECT doc_id, item_id, i, n FROM dw JOIN iw USING (n, k)),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
        its AS (
            SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op3_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
        e AS (
            SELECT *, length(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) AS n FROM c)
        SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
            sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(CASE role WHEN 'user' THEN n + 15 WHEN 'assistant' THEN n + 4 ELSE n + length(role) + 8 END)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op11_prefix_trie": r"""
        WITH o AS (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
            FROM conversations WHERE conv_id IS NOT NULL),
        h AS (  -- CRC-32 of the decimal id, a byte and then a bit at a time
            SELECT DISTINCT c, (4294967295 - list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
                lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::BIGINT) ELSE y // 2 END))) % 4 AS h
            FROM o),
        heads AS (
            SELECT h.c, o.p, o.role, o.text FROM h JOIN o ON o.c = h.c - h.c % 20 AND o.p <= h.h),
        taken AS (SELECT h.c, h.h, count(heads.p) AS k FROM h LEFT JOIN heads USING (c) GROUP BY h.c, h.h),
        turns AS (
            SELECT c, p, role, text FROM heads
            UNION ALL SELECT o.c, o.p - h + k, role, text FROM o JOIN taken USING (c) WHERE o.p > h),
        per AS (SELECT taken.c, count(p) AS n, list(sha256(concat(length(role), ':', role, text)) ORDER BY p) FILTER (p IS NOT NULL) AS ds,
                list(len(list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> ''))::BIGINT ORDER BY p) FILTER (p IS NOT NULL) AS ws
            FROM taken LEFT JOIN turns USING (c) GROUP BY taken.c),
        spot AS (
            SELECT c, n, d, CASE WHEN d = 0 THEN '' ELSE sha256(array_to_string(ds[1:d], ' ')) END AS k, CASE WHEN d = 0 THEN 0 ELSE ws[d] END AS w
            FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM per)),
        node AS (
            SELECT d, k, min(c) AS c, count(*) AS n_convs, max(w) AS w,
                sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends
            FROM spot GROUP BY d, k),
        up AS (
            SELECT DISTINCT x.d, x.k, y.d AS above, y.k AS above_k FROM spot x JOIN spot y ON x.c = y.c AND y.d <= x.d),
        kids AS (SELECT above AS d, above_k AS k, count(*) AS n FROM up WHERE above = d - 1 GROUP BY 1, 2),
        below AS (
            SELECT u.above AS d, u.above_k AS k, sum((v.n_convs - 1) * v.w) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
            FROM up u JOIN node v ON v.d = u.d AND v.k = u.k LEFT JOIN kids ON kids.d = u.d AND kids.k = u.k GROUP BY 1, 2)
        SELECT node.c::BIGINT AS conv_id, node.d::BIGINT AS depth, p.c::BIGINT AS parent_conv_id, node.n_convs::BIGINT AS n_convs,
            coalesce(kids.n, 0)::BIGINT AS n_children, below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, node.ends AS ends_sha256
        FROM node JOIN below ON below.d = node.d AND below.k = node.k LEFT JOIN kids ON kids.d = node.d AND kids.k = node.k
            LEFT JOIN up ON up.d = node.d AND up.k = node.k AND up.above = node.d - 1 LEFT JOIN node p ON p.d = up.above AND p.k = up.above_k""",
    "op12_fill_in_middle": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[ \t\n\v\f\r]*[^ \t\n\v\f\r]+|[ \t\n\v\f\r]+') AS u,
                sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
        h AS (
            SELECT *, len(u) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM t),
        f AS (
            SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
        c AS (
            SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS z FROM f)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
        FROM c""",
    "op13_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS k
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        both_ AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        link AS (
            SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 85 * (x.n + y.n - same)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
        least_id AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
        FROM w JOIN least_id USING (doc_id) LEFT JOIN n USING (doc_id)""",
}
