"""Elements of pages whose markup is not tidy."""

from pyspark.sql import functions as F

from tricklake.sources import documents as D
from tricklake.sources import elements as E

PAGE = """<!DOCTYPE html><html lang=en><head><title>A &amp; B</title><script>var x = "<td>no</td>";</script><style>td{}</style></head><body>
<TABLE class='x' id=t1><tr CLASS="r"><th>Name<th>Links
<tr><td>one <b>bold</b> <td><a title="t" href='/clubs/7'>club</a> <a href=/details/12>go<br>on</a>
<tr><td>outer<table><tr><td>in 1<td>in 2<tr><td>in 3</table>after<td>last</tr>
</table><ul><li>a<li>b <ul><li>b1</ul><li>c</ul><p>first<p>second <a>none</a> <!-- <td>hidden</td> --></div></body>"""


def found(spark, *htmls):
    return E.elements(spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string"))


def test_rows_and_cells(spark):
    rows = sorted(map(tuple, E.table_rows(found(spark, PAGE)).select("pos", "c", "hrefs").collect()))
    assert [(c, h) for _, c, h in rows] == [(["Name", "Links"], []), (["one bold", "club goon"], ["/clubs/7", "/details/12"]), (["outerafter", "last"], []), (["in 1", "in 2"], []), (["in 3"], [])]


def test_tree(spark):
    rows = {r.seq: r for r in found(spark, PAGE).collect()}
    by = lambda tag: [rows[k] for k in sorted(rows) if rows[k].tag == tag]
    assert by("html")[0].attrs == {"lang": "en"} and by("table")[0].attrs == {"class": "x", "id": "t1"} and by("title")[0].text == "A & B"
    assert [x.text for x in by("li")] == ["a", "b", "b1", "c"] and [x.text for x in by("p")] == ["first", "second none"]
    for r in rows.values():  # an element lies in its parent, one deeper
        assert r.parent is None and r.depth == 0 or (rows[r.parent].seq < r.seq and r.end <= rows[r.parent].end and r.depth == rows[r.parent].depth + 1)
    assert len(by("td")) == 7 and len(by("tr")) == 5 and by("br")[0].end == by("br")[0].seq + 1
    assert by("table")[1].row is None or rows[by("table")[1].row].tag == "tr"
    df = found(spark, PAGE)
    deep = E.inside(df.where("tag = 'table'"), df.where("tag = 'td'")).groupBy("outer").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(r.n for r in deep.collect()) == [3, 7]


def test_links_and_tables_by_elements(spark):
    pages = spark.createDataFrame([(0, PAGE)], "page_id long, html string")
    assert [(r.href, r.text) for r in D.links(pages).collect()] == [("/clubs/7", "club"), ("/details/12", "goon")]
    assert [tuple(r) for r in D.result_links(pages).select("n", "label", "club").collect()] == [(12, "one bold, club goon", "7")]
    info = "<table><tr><td>Event name:<td><td>Cup<tr><td>event  NAME:<td>x<td>second<tr><td>two<td>cells</table>"
    assert D.info_table(spark.createDataFrame([(1, info), (2, "none")], "page_id long, html string")).orderBy("page_id").collect() == [(1, {"event_name_": "Cup"}), (2, {})]


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    odd = [None, "", "no tags", "<", "<td", "</td></tr></table>", "<td>cell without a row", "<a href=x>open", deep, "<tr><td>" * 2000, "<p a=1 a=2>&nbsp;é&#233;</p>", "<script>never ends <td>"]
    rows = found(spark, *odd).collect()
    of = lambda i: sorted((r for r in rows if r.page_id == i), key=lambda r: r.seq)
    assert not any(of(i) for i in (0, 1, 2, 5)) and len(of(8)) == 3000 and len(of(9)) == 4000
    assert [r.text for r in of(6)] == ["cell without a row"] and [r.text for r in of(7)] == ["open"] and of(10)[0].attrs == {"a": "1"} and of(10)[0].text == "éé" and [r.tag for r in of(11)] == ["script"]
    assert max(r.depth for r in of(9)) == 1
