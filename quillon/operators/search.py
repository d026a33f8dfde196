"""Lexical search: analysis, postings, BM25, phrase and fuzzy matches, mentions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from quillon.operators.search_index import SearchIndex

# Field weights, phrase boosts, BM25 constants, limits of short queries and the query stop list.
FIELD_WEIGHTS = {"title": 4.0, "authority_name": 3.0, "official_citation": 3.0, "structural_path": 2.0, "regeste": 2.0, "content": 1.0, "content_preview": 1.0, "docket_number": 2.0}
PHRASE_BOOSTS = {"title": 8.0, "official_citation": 6.0, "authority_name": 5.0, "structural_path": 4.0, "docket_number": 4.0}
K1, B = 1.2, 0.75
SHORT_TOKENS, SHORT_CHARS = 3, 32
MENTION_BOOST = 1.0
STOP_WORDS = ("ich", "mein", "meine", "meinen", "meiner", "meinem", "mir", "mich", "du", "dein", "deine", "deinen", "dir", "dich", "wir", "unser", "unsere", "uns", "wie", "was", "wann", "wo", "warum", "weshalb", "wieso")
_CITATION_LIKE = re.compile(r"\bart\.?\b|\bbge\b|\bbvge\b|\bemrk\b|\d|/|§", re.IGNORECASE)


def german_normalised(c: Column) -> Column:
    """Umlauts lose their dots, their spellings with e too, and sharp s is ss."""
    plain = F.replace(F.translate(c, "äöü", "aou"), F.lit("ß"), F.lit("ss"))
    for pair in ("ae", "oe"):
        plain = F.replace(plain, F.lit(pair), F.lit(pair[0]))
    return F.regexp_replace(plain, r"(?<![aeq])ue", "u")


def analyse(c: Column | str) -> Column:
    """Lower-case tokens of letters and digits, German-normalised."""
    text = german_normalised(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))
    return F.array_remove(F.split(text, r"[^\p{L}\p{N}]+"), "")


def query_tokens(q: str) -> list[str]:
    """The same on the driver for a query, without stop words; a query is one short string."""
    text = q.lower().translate(str.maketrans("äöü", "aou")).replace("ß", "ss").replace("ae", "a").replace("oe", "o")
    text = re.sub(r"(?<![aeq])ue", "u", text)
    return [t for t in re.split(r"[^\w]+|_", text) if t and t not in STOP_WORDS]


def query_shape(q: str | None) -> str:
    """wildcard, short_legal or free_text."""
    text = (q or "").strip()
    if not text or text == "*":
        return "wildcard"
    if _CITATION_LIKE.search(text) or (len(text.split()) <= SHORT_TOKENS and len(text) <= SHORT_CHARS):
        return "short_legal"
    return "free_text"


def postings(docs: DataFrame, doc_id: str, field: str) -> DataFrame:
    """(doc, token, tf, dl): built once, then joined by token; the table to store for many queries."""
    tokens = docs.select(F.col(doc_id).alias("doc"), analyse(field).alias("t"))
    return tokens.select("doc", F.size("t").alias("dl"), F.explode("t").alias("token")).groupBy("doc", "dl", "token").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, n_docs: int, average_length: float, tokens: Sequence[str], k1: float = K1, b: float = B, require_all: bool = False) -> DataFrame:
    """(doc, score) of the documents that have any, or all, of the tokens.

    The token filter reaches the postings before anything is exchanged; only matching postings are shuffled.
    """
    wanted = sorted(set(tokens))
    hits = index.where(F.col("token").isin(*wanted)) if wanted else index.limit(0)
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / average_length))
    scored = hits.join(df, "token").groupBy("doc").agg(F.sum(part).alias("score"), F.count("*").alias("matched"))
    return (scored.where(F.col("matched") == len(wanted)) if require_all else scored).select("doc", "score")


def corpus_stats(docs: DataFrame, field: str) -> tuple[int, float]:
    """Documents and their mean length in tokens."""
    r = docs.agg(F.count("*").alias("n"), F.avg(F.size(analyse(field))).alias("avg")).first()
    return r.n, r.avg or 0.0


def best_fields(docs: DataFrame, doc_id: str, tokens: Sequence[str], weights: Mapping[str, float] = FIELD_WEIGHTS, require_all: bool = False) -> DataFrame:
    """The best weighted field's BM25 score of each document."""
    parts = []
    for field, weight in weights.items():
        if field in docs.columns:
            n, average = corpus_stats(docs, field)
            parts.append(bm25(postings(docs, doc_id, field), n, average or 1.0, tokens, require_all=require_all).withColumn("score", F.col("score") * weight))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc").agg(F.max("score").alias("score"))


def phrase_boost(tokens: Sequence[str], boosts: Mapping[str, float] = PHRASE_BOOSTS, fields: Sequence[str] = ()) -> Column:
    """The sum of the boosts of fields that hold the tokens side by side."""
    phrase = F.concat(F.lit(" "), F.lit(" ".join(tokens)), F.lit(" "))
    total = F.lit(0.0)
    for field in fields:
        held = F.contains(F.concat(F.lit(" "), F.array_join(analyse(field), " "), F.lit(" ")), phrase)
        total = total + F.when(held, boosts[field]).otherwise(0.0)
    return total


def fuzzy_tokens(vocabulary: DataFrame, tokens: Sequence[str], prefix: int = 2) -> DataFrame:
    """(token, query): vocabulary words within 0, 1 or 2 edits by the query token's length, equal in their first letters."""
    spark = vocabulary.sparkSession
    wanted = spark.createDataFrame([(t, t[:prefix], 0 if len(t) <= 2 else 1 if len(t) <= 5 else 2) for t in tokens], "query string, p string, most int")
    words = vocabulary.select("token").distinct().withColumn("p", F.substring("token", 1, prefix))
    near = F.levenshtein("token", "query") <= F.col("most")
    return words.join(wanted, "p").where(near).select("token", "query")


def highlight(content: Column, token: str, regeste: Column, preview: Column, size: int = 200) -> Column:
    """A fragment around the first hit, else regeste, preview or nothing."""
    at = F.instr(F.lower(content), token)
    return F.coalesce(F.when(at > 0, F.substring(content, F.greatest(F.lit(1), at - size // 4), F.lit(size))), regeste, preview, F.lit(""))


#: Words that may stand between a label and its tier word.
FILLERS = ("von", "de", "du", "di", "of", "the")
#: Places whose labels and codes are broadcast.
VOCABULARY_ROWS = 100_000


def mentions(tokens: Sequence[str], vocabulary: Sequence[tuple[str, Sequence[str], str]], tiers: Sequence[str], fillers: Sequence[str] = FILLERS) -> list[str]:
    """Ids of subdivisions that a query names: their code, or their label next to a tier word, one filler between allowed.

    ``vocabulary`` has (id, label tokens, code) for each subdivision; a query is short, so this runs on the driver.
    """
    found = []
    for identity, label, code in vocabulary:
        n, hit = len(label), code.lower() in tokens
        for i in range(len(tokens) - n + 1):
            if list(tokens[i : i + n]) == list(label):
                before = tokens[i - 2] if i >= 2 and tokens[i - 1] in fillers else tokens[i - 1] if i else None
                after = tokens[i + n] if i + n < len(tokens) else None
                hit = hit or before in tiers or after in tiers
        if hit:
            found.append(identity)
    return found


def mentioned(texts: DataFrame, text_id: str, text: str, vocabulary: DataFrame, tiers: Sequence[str], fillers: Sequence[str] = FILLERS) -> DataFrame:
    """(text id, place, pos, by): every mention of a subdivision in whole texts (R11): its code, or its label next to a tier word.

    ``vocabulary`` has ``place``, ``label`` (tokens) and ``code`` (a token or null). A place's label counts where a tier word
    stands right before or after it, before it also with one filler between. ``pos`` is the first token's place, from 0.

    A trie one level deep, as a join: each token is met with the labels that begin with it and the codes that equal it, and
    what follows is verified as a run. The places are counted first, and up to VOCABULARY_ROWS of them broadcast, so that no
    token is shuffled; of more, labels that share a first token are rows of one key, which Spark may split.
    """
    cut = texts.select(F.col(text_id), analyse(text).alias("__t"))
    held = vocabulary.agg(F.count("*").alias("n"), F.max(F.size("label")).alias("size")).first()
    size = max(held.size or 0, 1)  # of the longest label
    marks = F.array(*[F.lit(t) for t in tiers])
    gaps = F.array(*[F.lit(f) for f in fillers])
    at, n = F.col("pos"), F.size("label")
    no_label = F.array().cast("array<string>")
    names = F.array(F.struct("label", F.get("label", 0).alias("first"), F.lit("label").alias("by")), F.struct(no_label.alias("label"), F.lower("code").alias("first"), F.lit("code").alias("by")))
    words = vocabulary.select("place", F.explode(names).alias("x")).select("place", "x.label", "x.first", "x.by").where("first IS NOT NULL")
    rows = cut.select(text_id, "__t", F.posexplode("__t").alias("pos", "first"))
    run = rows.select(text_id, "pos", "first", F.slice("__t", at + 1, F.lit(size + 1)).alias("onward"), F.when(at > 0, F.try_element_at("__t", at)).alias("before"), F.when(at > 1, F.try_element_at("__t", at - 1)).alias("second"))
    near = F.when(F.array_contains(gaps, F.col("before")) & F.col("second").isNotNull(), F.col("second")).otherwise(F.col("before"))
    tier = F.coalesce(F.array_contains(marks, near), F.lit(False)) | F.coalesce(F.array_contains(marks, F.try_element_at("onward", n + 1)), F.lit(False))
    met = run.join(F.broadcast(words) if held.n <= VOCABULARY_ROWS else words, "first")
    return met.where((F.col("by") == "code") | ((F.slice("onward", 1, n) == F.col("label")) & tier)).select(text_id, "place", "pos", "by")


def refuses(mentioned: Sequence[str], held: Sequence[str]) -> bool:
    """A search is refused only if it names places and the corpus holds none of them."""
    return bool(mentioned) and not set(mentioned) & set(held)


def mention_boost(preferred: Sequence[str], field: str = "jurisdiction_ids") -> Column:
    """One point for a document of a preferred place; never a filter."""
    if not preferred:
        return F.lit(0.0)
    return F.when(F.coalesce(F.arrays_overlap(field, F.array(*[F.lit(p) for p in preferred])), F.lit(False)), MENTION_BOOST).otherwise(0.0)


def ranked(index: SearchIndex, docs: DataFrame, doc_id: str, q: str, weights: Mapping[str, float], phrase_fields: Sequence[str] = (), preferred: Sequence[str] = ()) -> DataFrame:
    """(doc, score) for a search text, by its shape (R1 to R7): everything for a wildcard, all tokens and no others for
    a short legal text, any token or a word near one for free text; the best field's weighted BM25 and the boosts add up.

    Postings come from the stored index; of ``docs`` only the fields that boosts look at are read.
    """
    shape, tokens = query_shape(q), query_tokens(q)
    boost = phrase_boost(tokens, fields=phrase_fields) + (mention_boost(preferred) if preferred else F.lit(0.0))
    if shape == "wildcard":
        return docs.select(F.col(doc_id).alias("doc"), boost.alias("score"))
    exact = docs.sparkSession.createDataFrame([(t,) for t in sorted(set(tokens))], "token string")
    words = exact if shape == "short_legal" else index.near_words(tokens)
    scored = index.matching(words, len(set(tokens)) if shape == "short_legal" else 0)
    weight = F.create_map(*[x for f, w in weights.items() for x in (F.lit(f), F.lit(float(w)))])
    found = scored.where(F.col("field").isin(*weights)).groupBy("doc").agg(F.max(F.col("score") * weight[F.col("field")]).alias("score"))
    if not phrase_fields and not preferred:
        return found
    return found.join(docs.select(F.col(doc_id).alias("doc"), boost.alias("__boost")), "doc").select("doc", (F.col("score") + F.col("__boost")).alias("score"))
