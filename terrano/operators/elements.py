"""Markup as rows: one row an element, nested by intervals.

A page's tags are read once, front to back, with nothing but the list of what is open; from then on an element is a
row, and what lies inside another is told by numbers: elements are numbered in page order, ``end`` is the number
behind an element's last descendant, ``path`` holds the numbers of what encloses it. So containment is a comparison,
the innermost of some marked elements around another is the greatest number that its path shares with theirs, and
selectors, nearest containers and label-value pairs are filters, windows and aggregates over the page.

Pages are read as tolerant readers do: an end tag closes the last open element of its name and what was opened in it,
others are ignored; void elements hold nothing; what is open at the end is closed there; comments, scripts and style
sheets are no text; character references are decoded.

Defined cases: a null page has its root row alone; equal rows are one page; the page's own columns that are asked for
are repeated beside each element.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold most of a page; their text is kept only where a page's rules ask for it.
WIDE = frozenset("html head body main div section article nav header footer aside form ul ol table tbody thead tfoot".split())
#: Classes whose elements keep their text, wide or not.
NAMED = r"(?i)price|precio|title|titulo|address|direcc|location|neighborhood|barrio|feature|descri|content|surface|metros|area|m2|dorm|bedroom|room|bano|bath"
ROOT = "#page"
ELEMENT = "start int, end int, depth int, path array<int>, tag string, class string, attrs map<string,string>, parts array<string>, leaf boolean"
_TOKEN = re.compile(r"<!--.*?-->|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|([^<]+)|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style")}


def scanned(html: str, named: re.Pattern) -> list[tuple]:
    """The rows of ELEMENT of one page, the root first."""
    rows: list[list] = [[0, 0, 0, [], ROOT, "", {}, None, False]]
    texts: list[str] = []
    open_at: list[tuple[int, int, bool]] = [(0, 0, True)]  # number, text pieces before it, whether its text is kept

    def close() -> None:
        at, before, kept = open_at.pop()
        row = rows[at]
        row[1] = len(rows)
        row[8] = row[1] == at + 1
        if kept or row[8]:
            row[7] = texts[before:]
        if row[4] == "a" and not row[7] and open_at:  # a link without text is called what encloses it says
            open_at[-1] = (*open_at[-1][:2], True)

    at, size, run = 0, len(html), []
    while at < size:
        found = _TOKEN.match(html, at)
        at = found.end()
        ends, tag, inside, text = found.groups()
        if text is not None or found.group() == "<":  # a sign that opens no tag is text
            run.append(found.group())
            continue
        if run:
            if text := unescape("".join(run)).strip():
                texts.append(text)
            run.clear()
        if tag is None:
            continue
        if ends:
            tag = tag.lower()
            if any(rows[n][4] == tag for n, _, _ in open_at[1:]):
                while rows[open_at[-1][0]][4] != tag:
                    close()
                close()
        else:
            tag, attrs = tag.lower(), {}
            for name, a, b, c in _ATTRIBUTE.findall(inside):
                attrs.setdefault(name.lower(), unescape(a or b or c))
            named_so = attrs.get("class", "")
            rows.append([len(rows), 0, len(open_at), [n for n, _, _ in open_at], tag, named_so, attrs, None, False])
            open_at.append((len(rows) - 1, len(texts), tag not in WIDE or bool(named.search(named_so))))
            if tag in VOID:
                close()
            elif tag in _RAW_END:
                raw = _RAW_END[tag].search(html, at)
                at = raw.start() if raw else size
    if text := unescape("".join(run)).strip():
        texts.append(text)
    while open_at:
        close()
    rows[0][8] = False
    return rows


def elements(pages: DataFrame, keep: list[str], html: str = "html", named: str = NAMED) -> DataFrame:
    """page, the columns to keep, and ELEMENT of every element of every page; ``page`` tells pages apart."""
    key = F.sha2(F.to_json(F.struct(*keep, html), {"ignoreNullFields": "false"}), 256).alias("page")
    rows = pages.select(key, *keep, F.col(html).alias("_html")).dropDuplicates(["page"])
    kept = ["page", *keep]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    columns = [x.split()[0] for x in ELEMENT.split(", ")]
    arrow = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = re.compile(named)
        for batch in batches:
            for i in range(batch.num_rows):
                made = list(zip(*scanned(batch.column("_html")[i].as_py() or "", wanted), strict=True))
                made[6] = [list(a.items()) for a in made[6]]
                n = len(made[0])
                same = [pa.repeat(batch.column(c)[i], n) for c in kept]
                yield pa.RecordBatch.from_arrays([*same, *(pa.array(c, t) for c, t in zip(made, arrow, strict=True))], [*kept, *columns])

    return rows.mapInArrow(run, f"{types}, {ELEMENT}")


def text(parts: str = "parts", between: str = "") -> Column:
    """An element's text, its pieces stripped."""
    return F.array_join(F.coalesce(F.col(parts), F.array().cast("array<string>")), between)


def has_class(*names: str) -> Column:
    """Whether an element has one of the class names, whole."""
    return F.arrays_overlap(F.split("class", r"\s+"), F.array(*map(F.lit, names)))


def class_part(*parts: str) -> Column:
    """Whether a piece of text stands anywhere in the class attribute."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains("class", F.lit(p))
    return out


def attr(*names: str) -> Column:
    """The first attribute of these names that is not empty; null if none is."""
    return F.coalesce(*(F.nullif(F.trim(F.col("attrs")[n]), F.lit("")) for n in names))


def innermost(rows: DataFrame, marked: Column, name: str, itself: bool = False) -> DataFrame:
    """``rows`` with the number of the innermost marked element around each, null where there is none."""
    around = F.array_max(F.array_intersect("path", F.collect_list(F.when(marked, F.col("start"))).over(W.partitionBy("page"))))
    return rows.withColumn(name, F.when(marked, F.col("start")).otherwise(around) if itself else around)


def first_rung(rows: DataFrame, ladder: list[Column], name: str) -> DataFrame:
    """``rows`` with the rung of the ladder that an element matches, where it is the first that anything on its page matches; else null."""
    rung = F.lit(None).cast("int")
    for n, rule in reversed(list(enumerate(ladder))):
        rung = F.when(rule, n).otherwise(rung)
    return rows.withColumn("_rung", rung).withColumn(name, F.when(F.col("_rung") == F.min("_rung").over(W.partitionBy("page")), F.col("_rung"))).drop("_rung")


def first(value: Column, where: Column) -> Column:
    """An aggregate: the value of the first element, in page order, for which something holds."""
    return F.min_by(value, F.when(where, F.col("start")))


def in_order(value: Column, where: Column) -> Column:
    """An aggregate: the values of all elements for which something holds, in page order."""
    return F.transform(F.array_sort(F.collect_list(F.when(where, F.struct(F.col("start"), value.alias("value"))))), lambda x: x["value"])
