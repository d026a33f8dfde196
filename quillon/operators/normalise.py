"""Blocks and sections from markup (T1 to T11). Only HTML and XML need Python, one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# HTML tags by what they do, and words that mark legal sources.
LEAVES = ("p", "li", "td", "th", "blockquote", "pre")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CONTAINERS = ("article", "section", "main")
SKIPPED = ("script", "style", "noscript", "template", "svg", "canvas", "header", "nav", "footer", "aside", "iframe", "form", "object", "embed", "picture", "video", "audio", "track", "map")
LEGAL_WORDS = r"(?i)art\.|§|gesetz|arrêt|urteil|rechtssatz|verordnung"

# XML tags by what they do; structural ones with their level.
XML_LEVELS = {"teil": 1, "part": 1, "hauptstueck": 1, "hauptstuck": 1, "kapitel": 2, "chapter": 2, "abschnitt": 2, "unterabschnitt": 3, "subsection": 3, "paragraf": 4, "paragraph": 4, "section": 4, "artikel": 4, "article": 4, "anlage": 4, "annex": 4}
XML_TITLES = ("langtitel", "kurztitel", "titel", "title", "ueberschrift", "heading")
XML_TEXTS = ("absatz", "paragraphtext", "text", "normtext", "inhalt", "content", "p", "satz", "einleitung", "praeambel", "preamble", "unterschrift")
XML_ITEMS = ("ziffer", "litera", "listitem", "item", "punkt")
XML_SKIPPED = ("metadata", "metadaten", "header", "kopf", "stammdaten", "kzinhalt", "fzinhalt", "layoutdaten", "ausgabe")
XML_LABELS = ("nummer", "nr", "label", "bezeichnung")
XML_LABEL_WORDS = {"paragraf": "§", "artikel": "Art.", "article": "Art.", "anlage": "Anlage", "annex": "Anlage", "teil": "Teil", "part": "Teil", "abschnitt": "Abschnitt", "kapitel": "Kapitel", "chapter": "Kapitel"}

_BLOCK = "struct<type:string,text:string,level:int,anchor:string>"
_ARROW = pa.struct([("type", pa.string()), ("text", pa.string()), ("level", pa.int32()), ("anchor", pa.string())])


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def _block(kind: str, text: str, level: int | None = None, anchor: str | None = None) -> dict:
    return {"type": kind, "text": text, "level": level, "anchor": anchor}


class _Page(HTMLParser):
    """Collects blocks. The outermost leaf or heading takes all text inside it; text loose in a container is a paragraph."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.title = ""
        self.skipping = 0
        self.in_title = False
        self.leaf: tuple[str, str | None] | None = None
        self.text = ""
        self.inside: list[tuple[str, str | None]] = []  # open containers with the anchor that holds in each
        self.loose: list[str] = []

    def _end_loose(self) -> None:
        if self.inside and (text := _squeezed(self.loose[-1])):
            self.blocks.append(_block("paragraph", text, anchor=self.inside[-1][1]))
        if self.inside:
            self.loose[-1] = ""

    def _leave(self, tag: str) -> None:
        if any(t == tag for t, _ in self.inside):
            last = ""
            while last != tag:
                self._end_loose()
                self.loose.pop()
                last = self.inside.pop()[0]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        outer = self.inside[-1][1] if self.inside else None
        anchor = dict(attrs).get("id") or outer
        if tag in SKIPPED:
            self.skipping += 1
        elif self.skipping:
            return
        elif tag == "title":
            self.in_title = True
        elif tag == "br":
            self.text += "\n" if self.leaf else ""
        elif tag in CONTAINERS:
            self._end_loose()
            self.inside.append((tag, anchor))
            self.loose.append("")
        elif tag in HEADINGS or tag in LEAVES:
            self._end_loose()
            if self.leaf is None:
                self.leaf, self.text = (tag, anchor), ""

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED and self.skipping:
            self.skipping -= 1
        elif self.skipping:
            return
        elif tag == "title":
            self.in_title = False
        elif self.leaf and tag == self.leaf[0]:
            if text := _squeezed(self.text):
                self.blocks.append(_block("heading", text, int(tag[1]), self.leaf[1]) if tag in HEADINGS else _block("list_item" if tag == "li" else "paragraph", text, anchor=self.leaf[1]))
            self.leaf = None
        elif tag in CONTAINERS:
            self._leave(tag)

    def handle_data(self, data: str) -> None:
        if self.skipping:
            return
        if self.in_title:
            self.title += data
        elif self.leaf:
            self.text += data
        elif self.inside:
            self.loose[-1] += data

    def finish(self) -> None:
        while self.inside:
            self._leave(self.inside[-1][0])


def html_blocks_of(text: str) -> list[dict]:
    """The blocks of one page, its title first; without any, its text without tags as one paragraph."""
    import re

    page = _Page()
    page.feed(text)
    page.finish()
    head = [_block("title", title)] if (title := _squeezed(page.title)) else []
    if page.blocks:
        return head + page.blocks
    rest = _squeezed(re.sub(r"<[^>]*>", "", text))
    return head + ([_block("paragraph", rest)] if rest else [])


def _tag(node: ElementTree.Element) -> str:
    return node.tag.rsplit("}", 1)[-1].replace("-", "_").lower() if isinstance(node.tag, str) else ""


def _all_text(node: ElementTree.Element) -> str:
    return _squeezed(" ".join(node.itertext()))


def _label(node: ElementTree.Element) -> str | None:
    """A number given as attribute or child, with the word that its tag takes."""
    given = [node.attrib.get(k, "") for k in ("nummer", "nr", "number", "label", "bezeichnung")] + [_all_text(c) for c in node if _tag(c) in XML_LABELS]
    number = next((n for n in map(_squeezed, given) if n), None)
    return number and " ".join(filter(None, (XML_LABEL_WORDS.get(_tag(node)), number)))


def _labelled(label: str | None, text: str | None) -> str | None:
    return text if not label or (text or "").startswith(label) else f"{label} {text}" if text else label


def xml_blocks_of(text: str) -> list[dict]:
    """The blocks of one XML document (T6): structural elements give headings, text and list elements blocks.

    Text that is no well-formed XML is refused, as one block of type ``invalid``.
    """
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as x:
        return [_block("invalid", str(x))]
    out: list[dict] = []
    waiting = [root]
    while waiting:  # depth first, in document order
        node = waiting.pop()
        tag, children = _tag(node), list(node)
        header = node.attrib.get("typ") in ("kz", "fz")  # of a printed page
        if tag in XML_SKIPPED:
            continue
        if tag in XML_LEVELS:
            titles = [c for c in children if _tag(c) in XML_TITLES]
            named = next((t for t in map(_all_text, titles) if t), None)
            if shown := _labelled(_label(node), named):
                out.append(_block("heading", shown, XML_LEVELS[tag], node.get("id")))
            children = [c for c in children if _tag(c) not in XML_LABELS and c not in titles[:1]]
        elif tag == "ueberschrift":
            if not header and (shown := _all_text(node)):
                out.append(_block("heading", shown, 2, node.get("id")))
            continue
        elif tag in XML_ITEMS or (tag in XML_TEXTS and not (tag in ("text", "content", "inhalt", "normtext") and children)):
            if not header and (body := _all_text(node)):
                out.append(_block("list_item" if tag in XML_ITEMS else "paragraph", _labelled(_label(node), body), None, node.get("id")))
            continue
        waiting += reversed(children)
    rest = _all_text(root)
    return out or ([_block("paragraph", rest)] if rest else [])


def _blocks(df: DataFrame, source: str, read) -> DataFrame:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [read(t) if t else [] for t in batch.column(source).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(_ARROW))], [*batch.schema.names, "blocks"])

    return df.mapInArrow(f, df.withColumn("blocks", F.array().cast(f"array<{_BLOCK}>")).schema)


def html_blocks(df: DataFrame, source: str) -> DataFrame:
    """Adds ``blocks``: type, text, level and anchor of each block of a page."""
    return _blocks(df, source, html_blocks_of)


def xml_blocks(df: DataFrame, source: str) -> DataFrame:
    return _blocks(df, source, xml_blocks_of)


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def markdown_blocks(c: Column) -> Column:
    """Blocks of Markdown: the first ``#`` line is the title, further ones headings; list items; one paragraph a line (T3). Native."""
    lines = F.filter(F.transform(F.split(c, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")

    def block(x: Column) -> Column:
        def made(marks: Column) -> Column:
            kind = F.when(marks > 0, "heading").when(x.rlike(r"^[-*+]\s"), "list_item").otherwise("paragraph")

            def of_kind(kind: Column) -> Column:
                body = F.when(kind == "paragraph", x).otherwise(F.regexp_replace(x, r"^(#{1,6}|[-*+])\s+", ""))
                return F.struct(kind.alias("type"), F.trim(F.regexp_replace(body, r"\s+", " ")).alias("text"), F.when(marks > 0, marks).alias("level"), F.lit(None).cast("string").alias("anchor"))

            return _bound(kind, of_kind)

        return _bound(F.length(F.regexp_extract(x, r"^(#{1,6})\s", 1)), made)

    def titled(blocks: Column) -> Column:
        first = F.array_position(F.transform(blocks, lambda b: b["level"].eqNullSafe(1)), F.lit(True))
        named = lambda b: F.struct(F.lit("title").alias("type"), b["text"].alias("text"), b["level"].alias("level"), b["anchor"].alias("anchor"))
        return _bound(first, lambda n: F.transform(blocks, lambda b, i: F.when(i + 1 == n, named(b)).otherwise(b)))

    return _bound(F.transform(lines, block), titled)


def plain_blocks(c: Column) -> Column:
    """One paragraph (T4)."""
    return F.array(F.struct(F.lit("paragraph").alias("type"), F.trim(c).alias("text"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("anchor")))


def flavour(blocks: Column) -> Column:
    """legal_html with two headings and a marker word, structured_html with two headings, else generic_html (T5)."""
    n = F.size(F.filter(blocks, lambda b: b["type"] == "heading"))
    marked = F.array_join(F.transform(blocks, lambda b: b["text"]), " ").rlike(LEGAL_WORDS)
    return F.when((n >= 2) & marked, "legal_html").when(n >= 2, "structured_html").otherwise("generic_html")


def body_text(blocks: Column) -> Column:
    """Texts of blocks other than titles and footnotes, with blank lines between."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: ~b["type"].isin("footnote", "title")), lambda b: b["text"]), "\n\n")


def full_text(title: Column, body: Column) -> Column:
    """The title in front of the body unless the body begins with it."""
    return F.when(title.isNull() | (title == "") | body.startswith(title), body).otherwise(F.concat(title, F.lit("\n\n"), body))


def sections(df: DataFrame, key: str, blocks: str = "blocks", title: Column | None = None) -> DataFrame:
    """One row per section with ``ordinal``, ``title``, ``depth``, ``content`` and ``ancestors``.

    A heading begins a section; what comes before the first goes in front of that section's content; sections
    without content are dropped and do not count; a document without headings is one section, "Body".
    Ancestors are the last headings of smaller depth, in order.
    """
    heads = F.filter(F.transform(blocks, lambda b, i: F.when(b["type"] == "heading", i + 1)), lambda i: i.isNotNull())
    marked = df.select(key, (title if title is not None else F.lit(None).cast("string")).alias("doc_title"), F.col(blocks).alias("blocks"), heads.alias("heads"))

    def section(start: Column, n: Column) -> Column:
        # From behind its heading, the n-th (none: 0), up to the next.
        end = F.coalesce(F.get("heads", n), F.size("blocks") + 1)
        own = F.filter(F.slice("blocks", start + 1, end - start - 1), lambda b: (b["type"] != "title") & (b["text"] != ""))
        head = F.when(n > 0, F.get("blocks", start - 1))
        return F.struct(n.alias("n"), head["text"].alias("title"), head["level"].alias("level"), F.array_join(F.transform(own, lambda b: b["text"]), "\n\n").alias("content"))

    # A document's sections are cut out of its blocks where they lie; only sections are windowed, not blocks.
    cut = marked.select(key, "doc_title", F.explode(F.transform(F.concat(F.array(F.lit(0)), "heads"), section)).alias("s")).select(key, "doc_title", "s.*")
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    heading, depth = F.col("n") > 0, F.col("depth")
    grouped = cut.withColumn("depth", F.when(heading, F.greatest(F.lit(0), F.coalesce("level", F.lit(1)) - 1)))
    # The open heading of each depth, if no heading as shallow came after it.
    for d in range(6):
        at = F.max(F.when(depth == d, F.col("n"))).over(w)
        above = F.max(F.when(depth < d, F.col("n"))).over(w)
        grouped = grouped.withColumn(f"h{d}", F.when(at > F.coalesce(above, F.lit(-1)), F.max_by("title", F.when(depth == d, F.col("n"))).over(w)))
    by_n = Window.partitionBy(key).orderBy("n")
    preamble = F.when((F.lag("n").over(by_n) == 0), F.lag("content").over(by_n))
    whole = Window.partitionBy(key)
    joined = grouped.withColumn("headings", F.max("n").over(whole)).withColumn("content", F.trim(F.concat_ws("\n\n", F.nullif(preamble, F.lit("")), F.nullif(F.col("content"), F.lit("")))))
    kept = joined.where(((F.col("n") > 0) | (F.col("headings") == 0)) & (F.trim("content") != ""))
    ancestors = F.array_compact(F.array(*[F.when(F.lit(d) < F.col("depth"), F.col(f"h{d}")) for d in range(6)]))
    return kept.select(
        key,
        (F.row_number().over(by_n) - 1).alias("ordinal"),
        F.when(F.col("n") == 0, F.coalesce(F.nullif("doc_title", F.lit("")), F.lit("Body"))).otherwise(F.col("title")).alias("title"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.when(F.col("n") == 0, "body").otherwise("heading").alias("section_type"),
        "content",
        F.when(F.col("n") > 0, ancestors).otherwise(F.array().cast("array<string>")).alias("ancestors"),
    )
