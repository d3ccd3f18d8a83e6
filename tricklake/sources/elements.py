"""Pages as a table of elements, for markup as it comes: any order of attributes, missing end tags, tables in tables.

A page's tags are read once by the standard reader with a stack of what is open; where an element begins and ends, what holds it and which table row it stands in are columns,
so the rest is joins and aggregates. A page is read in one task, in time and memory in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values of the markup: elements without an end, what a beginning ends, and where that stops
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDS = {"tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "thead": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "tfoot": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "li": {"li"}, "p": {"p"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
FENCES = {"table", "ul", "ol", "dl", "select"}
#: A text belongs to the innermost open element of each of these classes.
TEXTS = ({"td", "th"}, {"a"}, {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "title", "caption", "option", "dt", "dd"})

SCHEMA = "page_id {}, seq int, end int, depth int, parent int, tag string, attrs map<string,string>, row int, text string"


class _Elements(HTMLParser):
    """rows: [seq, end, depth, parent, tag, attributes, row, texts]; an element ends before the seq that follows its last descendant."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[list] = []
        self.feed(html)
        self.close()
        self._leave(0)

    def _leave(self, at: int) -> None:
        for x in self.open[at:]:
            x[1] = len(self.rows)
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ends, i = ENDS.get(tag, ()), len(self.open) - 1
        last = None
        while ends and i >= 0 and self.open[i][4] not in FENCES:
            last = i if self.open[i][4] in ends else last
            i -= 1
        if last is not None:
            self._leave(last)
        row = next((x[0] for x in reversed(self.open) if x[4] in ("tr", "table")), None)
        row = row if row is not None and self.rows[row][4] == "tr" else None
        seen: dict = {}
        for k, v in attrs:
            seen.setdefault(k, v or "")
        x = [len(self.rows), len(self.rows) + 1, len(self.open), self.open[-1][0] if self.open else None, tag, seen, row, []]
        self.rows.append(x)
        if tag not in VOID:
            self.open.append(x)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][4] == tag:
                return self._leave(i)
            if self.open[i][4] == "table" and tag in ("tr", "td", "th", "li", "p", "a"):
                return None  # of something outside this table
        return None

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][4] in ("script", "style"):
            return
        left = list(TEXTS)
        for x in reversed(self.open):
            for tags in left:
                if x[4] in tags:
                    x[7].append(data)
                    left.remove(tags)
                    break
            if not left:
                return


def elements(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) -> a row an element: seq (its place), end (the place after its last descendant), depth, parent, tag, attrs, row (the table row that holds it, none across a table in a cell) and text.

    text, with single blanks, is what stands in a cell, an anchor or a block (see TEXTS) and not in another of its kind inside; null for other elements. An element without an end tag ends where
    the next of its kind or its holder ends. Null and empty pages have no rows. Other columns are ignored.
    """
    kept = set().union(*TEXTS)

    def table(batch: pa.RecordBatch, at: list[int], part: list[list]) -> pa.RecordBatch:
        cols = list(zip(*part))
        text = [" ".join("".join(x[7]).split()) if x[4] in kept else None for x in part]
        return pa.RecordBatch.from_arrays([
            batch["page_id"].take(pa.array(at, pa.int32())), *(pa.array(cols[c], pa.int32()) for c in range(4)), pa.array(cols[4], pa.string()), pa.array([list(x.items()) for x in cols[5]], pa.map_(pa.string(), pa.string())),
            pa.array(cols[6], pa.int32()), pa.array(text, pa.string()),
        ], ["page_id", "seq", "end", "depth", "parent", "tag", "attrs", "row", "text"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []  # small pages go together, large ones in parts
            for i, html in enumerate(batch["html"].to_pylist()):
                found += _Elements(html).rows if html else []
                at += [i] * (len(found) - len(at))
                if len(found) >= 5000:
                    for lo in range(0, len(found), 5000):
                        yield table(batch, at[lo : lo + 5000], found[lo : lo + 5000])
                    at, found = [], []
            if found:
                yield table(batch, at, found)

    return pages.select("page_id", "html").mapInArrow(rows, SCHEMA.format(pages.schema["page_id"].dataType.simpleString()))


def table_rows(found: DataFrame) -> DataFrame:
    """elements -> (page_id, pos, c, hrefs): a row of a table with its cells' texts in order and the addresses of the anchors in it; a row inside a cell is a row of its own."""
    inside = found.where("row is not null and tag in ('td', 'th', 'a')")
    cells, links = F.col("tag").isin("td", "th"), F.col("tag") == "a"
    listed = lambda what, value: F.transform(F.sort_array(F.collect_list(F.when(what, F.struct("seq", value.alias("v"))))), lambda x: x["v"])
    return inside.groupBy("page_id", F.col("row").alias("pos")).agg(listed(cells, F.col("text")).alias("c"), listed(links & F.col("attrs")["href"].isNotNull(), F.col("attrs")["href"]).alias("hrefs"))


def anchors(found: DataFrame) -> DataFrame:
    """(page_id, pos, href, text) of the anchors with an address, in order."""
    a = found.where((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull())
    return a.select("page_id", F.col("seq").alias("pos"), F.col("attrs")["href"].alias("href"), "text")


def inside(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Structural join: (page_id, outer, inner) of the inner elements that lie in an outer one, at any depth."""
    o = outer.select("page_id", F.col("seq").alias("outer"), "end")
    return o.join(inner.select("page_id", F.col("seq").alias("inner")), "page_id").where((F.col("inner") > F.col("outer")) & (F.col("inner") < F.col("end"))).select("page_id", "outer", "inner")
