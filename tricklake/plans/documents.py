"""Queries JSN1 to JSN7 and WEB1 to WEB8 and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import canonical as N
from ..sources import documents as D
from ..sources import pages as G
from ..sources.folders import shared_folder as folder

Q, O = {}, {}


def reg(name, run, sql, *ctes):
    Q[name] = run
    O[name] = X.oracle(sql, *ctes) if ctes else sql


# a nested document a customer: nation and region inside, orders as a list
SCHEMA = "id long, name string, place struct<nation:string,region:struct<name:string,no:int>>, orders array<struct<id:long,price:string,day:string,tags:array<string>>>"


def document_texts(spark, sf):
    """(id, j): the documents as JSON text."""
    t = lambda n: X.table(spark, sf, n)
    o = t("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.regexp_replace(F.col("o_totalprice").cast("decimal(15,2)").cast("string"), "\\.", ",").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.array("o_orderstatus", "o_orderpriority").alias("tags")))).alias("orders"))
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    j = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.struct(F.col("n_name").alias("nation"), F.struct(F.col("r_name").alias("name"), F.col("r_regionkey").alias("no")).alias("region")).alias("place"), "orders"))
    return c.select(F.col("c_custkey").alias("id"), j.alias("j"))


def documents(spark, sf):
    return document_texts(spark, sf).select(F.from_json("j", SCHEMA).alias("d")).select("d.*")


BASE = "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
PRICE = "o_totalprice::DECIMAL(15, 2)"
reg("jsn1_flatten", lambda s, d: D.repair_numbers(D.flatten(D.explode_structs(documents(s, d), "orders", "order")), ["order_price", "name"]).select("id", "name", "place_nation", "place_region_name", "place_region_no", "order_price"),
    f"SELECT c_custkey AS id, c_name AS name, n_name AS place_nation, r_name AS place_region_name, r_regionkey AS place_region_no, {PRICE}::DOUBLE AS order_price {BASE} LEFT JOIN orders ON o_custkey = c_custkey")
reg("jsn2_explode_structs", lambda s, d: D.explode_structs(documents(s, d).select("id", "orders"), "orders", "order").drop("order_tags"), f"SELECT c_custkey AS id, o_orderkey AS order_id, replace({PRICE}::VARCHAR, '.', ',') AS order_price, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM customer LEFT JOIN orders ON o_custkey = c_custkey")


def as_text(spark, sf):
    o = X.table(spark, sf, "orders").select("o_orderkey", F.array(F.struct(F.lit(None).cast("string").alias("ewScore"), F.col("o_custkey").alias("nsScore"), F.lit(" ").alias("ewNote"), (F.col("o_orderkey") % 100).alias("nsNote"), F.lit(2).alias("count"))).alias("f"))
    return o.select("o_orderkey", D.scores_text(F.concat("f", "f")).alias("t"))


reg("jsn3_scores_text", as_text, "SELECT o_orderkey, x || '; ' || x AS t FROM (SELECT o_orderkey, '[EW=-/NS=' || o_custkey || ', -/' || o_orderkey % 100 || ', n=2]' AS x FROM orders)")


reg("jsn4_record_paths", lambda s, d: (lambda t: t["orders"].select("orders_no", "price", "day").unionByName(t["customers"].select(F.lit(-1).alias("orders_no"), F.col("name").alias("price"), F.lit("").alias("day"))))(D.relational(documents(s, d).withColumnRenamed("id", "doc"), {"customers": "", "orders": "orders"}, "doc")),
    f"SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS orders_no, replace({PRICE}::VARCHAR, '.', ',') AS price, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT -1, c_name, '' FROM customer")


def walked(spark, sf):
    """Every field of every object, whatever the shape; each fifth document has its orders under digit keys."""
    d = document_texts(spark, sf)
    as_map = F.to_json(F.struct(F.map_from_entries(F.transform(F.from_json("j", SCHEMA)["orders"], lambda o, i: F.struct(i.cast("string"), F.struct(o["id"].alias("id"), o["price"].alias("price"), o["day"].alias("day"), o["tags"].alias("tags"))))).alias("orders")))
    j = F.when((F.col("id") % 5 == 0) & F.from_json("j", SCHEMA)["orders"].isNotNull(), as_map).otherwise(F.col("j"))
    rows = D.walk_variants(d.select("id", F.parse_json(j).alias("v")), "id", "v", folder(spark, "walk"))
    return rows.select("doc", "tbl", "id", "parent", "field", "value")


reg("jsn5_walk", walked, f"""
WITH o AS (SELECT o_custkey::VARCHAR AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, * FROM orders JOIN customer ON c_custkey = o_custkey),
d AS (SELECT *, c_custkey % 5 = 0 AND c_custkey IN (SELECT o_custkey FROM orders) AS bare {BASE}), k AS (SELECT c_custkey::VARCHAR AS c, * FROM d)
SELECT c AS doc, 'root' AS tbl, c AS id, NULL AS parent, unnest(CASE WHEN bare THEN [NULL] ELSE ['id', 'name'] END) AS field, unnest(CASE WHEN bare THEN [NULL] ELSE [c, c_name] END) AS value FROM k
UNION ALL SELECT c, 'place', c, c, 'nation', n_name FROM k WHERE NOT bare
UNION ALL SELECT c, 'region', c, c, unnest(['name', 'no']), unnest([r_name, r_regionkey::VARCHAR]) FROM k WHERE NOT bare
UNION ALL SELECT c, 'orders', c || '-' || i, c, unnest(['id', 'price', 'day']), unnest([o_orderkey::VARCHAR, replace({PRICE}::VARCHAR, '.', ','), strftime(o_orderdate, '%Y-%m-%d')]) FROM o
UNION ALL SELECT c, 'tags', c || '-' || i || '-' || unnest([0, 1]), c || '-' || i, 'value', unnest([o_orderstatus, o_orderpriority]) FROM o""")
reg("jsn6_newest", lambda s, d: D.newest(X.table(s, d, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], "ts", ["event_id"]).select("user_id", "event_id").unionByName(D.orphans(X.table(s, d, "orders"), X.table(s, d, "customer").where("c_custkey % 3 > 0"), "o_custkey", "c_custkey").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("event_id"))),
    "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0)")
reg("jsn7_leaf_paths", lambda s, d: D.leaf_paths(documents(s, d), "id").where("value is not null"),
    f"""SELECT c_custkey AS id, unnest(['name', 'place.nation', 'place.region.name', 'place.region.no']) AS path, unnest([c_name, n_name, r_name, r_regionkey::VARCHAR]) AS value {BASE} UNION ALL
  SELECT o_custkey, 'orders[' || i || '].' || unnest(['id', 'price', 'day', 'tags[0]', 'tags[1]']), unnest([o_orderkey::VARCHAR, replace({PRICE}::VARCHAR, '.', ','), strftime(o_orderdate, '%Y-%m-%d'), o_orderstatus, o_orderpriority]) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders JOIN customer ON c_custkey = o_custkey)""")

pages = lambda s, d: X.table(s, d, "pages")


def made(spark, sf):
    """Pages with a script object, a results table and an info table, made from orders: one page a customer."""
    o = X.table(spark, sf, "orders")
    row = F.concat(F.lit("<tr><td>"), F.col("o_orderkey").cast("string"), F.lit("</td><td> <b>"), F.col("o_orderpriority"), F.lit("</b></td><td>"), F.concat_ws(",", (F.col("o_orderkey") % 100).cast("string"), F.lit("5")), F.lit('</td><td>x</td><td>y</td><td><a href="/r/details/'), F.col("o_orderkey").cast("string"), F.lit('">go</a> <a href="/clubs/'), (F.col("o_orderkey") % 9).cast("string"), F.lit('">c</a></td></tr>\n'))
    by = o.groupBy(F.col("o_custkey").alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", row.alias("r")))).alias("rows"), F.count(F.lit(1)).alias("n"))
    body = F.array_join(F.transform("rows", lambda x, i: F.concat(F.when(i == 0, "<tr><th>North / South</th></tr>").when(i == 1, "<tr><th>East/West</th></tr>").otherwise(""), x["r"])), "")
    info = F.concat(F.lit("<table><tr><td>Event Name:</td><td></td><td>E"), F.col("page_id").cast("string"), F.lit("</td></tr><tr><td>Place</td><td>:</td><td>Here</td></tr></table>"))
    script = F.concat(F.lit('<script>var data = {"id": '), F.col("page_id").cast("string"), F.lit(',\n "n": '), F.col("n").cast("string"), F.lit("};</script>"))
    return by.select("page_id", F.concat(F.lit("<html>"), F.when(F.col("page_id") % 4 > 0, script).otherwise(""), F.lit("<table>"), body, F.lit("</table>"), info).alias("html"))


reg("web1_embedded_json", lambda s, d: made(s, d).select("page_id", D.embedded_json(F.col("html"), "id long, n long").alias("j")).select("page_id", "j.id", "j.n"), "SELECT o_custkey AS page_id, CASE WHEN o_custkey % 4 > 0 THEN o_custkey END AS id, CASE WHEN o_custkey % 4 > 0 THEN count(*) END AS n FROM orders GROUP BY o_custkey")
reg("web2_page_links", lambda s, d: D.links(pages(s, d)).select("page_id", "href", "text"), """SELECT page_id, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_replace(a, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS text
  FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<a [^>]*>.*?</a>')) AS a FROM pages)""")
reg("web2_result_links", lambda s, d: D.result_links(made(s, d)), "SELECT o_custkey AS page_id, o_orderkey::INTEGER AS n, concat_ws(', ', o_orderkey, o_orderpriority, (o_orderkey % 100) || ',5', 'x', 'go c') AS label, (o_orderkey % 9)::VARCHAR AS club FROM orders")


def tables(spark, sf):
    """A results table a customer; its columns stand in one of three orders under one of several titles, some rows are no results."""
    o = X.table(spark, sf, "orders")
    k, form = F.col("o_orderkey"), F.col("o_custkey") % 3
    value = {"place": F.when(k % 7 == 0, "-").otherwise((k % 50).cast("string")), "pair": (k % 90).cast("string"), "name": F.concat(F.lit("<b>A &amp; "), F.col("o_orderpriority"), F.lit("</b>")), "points": F.when(k % 11 == 0, "").otherwise(F.concat((k % 300).cast("string"), F.lit(",5"))), "score": (k % 100).cast("string")}
    orders_of = [("place", "pair", "name", "points", "score"), ("name", "score", "place", "points", "pair"), ("pair", "points", "place", "name", "score")]
    titles = [{"place": "Pos", "pair": "No", "name": "Players", "points": "MPs", "score": "Score%"}, {"place": "Position", "pair": "Pair", "name": "Players", "points": "Matchpoints", "score": "Score"}, {"place": "pos", "pair": "no", "name": "Players", "points": "mp", "score": "Score"}]
    tr = lambda cells, tag: F.concat(F.lit("<tr>"), *[x for c in cells for x in (F.lit(f"<{tag}> "), c, F.lit(f" </{tag}>"))], F.lit("</tr>\n"))
    pick = lambda f: F.when(form == 0, f(0)).when(form == 1, f(1)).otherwise(f(2))
    row = pick(lambda i: tr([value[c] for c in orders_of[i]], "td"))
    by = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", row.alias("r")))).alias("rows"))
    head = pick(lambda i: tr([F.lit(titles[i][c]) for c in orders_of[i]], "th"))
    section = lambda t: F.lit(f"<tr><td>{t}</td></tr>")
    body = F.array_join(F.transform("rows", lambda x, i: F.concat(F.when(i == 0, F.concat(section("North / South"), head)).when(i == 2, F.concat(section("East / West"), head)).otherwise(""), x["r"], F.lit("<tr><td>9</td></tr>"))), "")
    return by.select(F.col("o_custkey").alias("page_id"), F.concat(F.lit("<table>"), body, F.lit("</table>")).alias("html"))


reg("web3_results_table", lambda s, d: D.results_table(tables(s, d)), """SELECT o_custkey AS page_id, CASE WHEN r <= 2 THEN 'NS' ELSE 'EW' END AS section, (o_orderkey % 50)::INTEGER AS place, (o_orderkey % 90)::INTEGER AS pair, 'A & ' || o_orderpriority AS name, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey % 300 + 0.5 END AS points, (o_orderkey % 100)::DOUBLE AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE o_orderkey % 7 > 0""")
reg("web4_info_table", lambda s, d: D.info_table(made(s, d)).select("page_id", F.col("m")["event_name_"].alias("event"), F.col("m")["place"].alias("place")), "SELECT DISTINCT o_custkey AS page_id, 'E' || o_custkey AS event, 'Here' AS place FROM orders")


def freq_pages(spark, sf):
    o = X.table(spark, sf, "orders")
    lines = F.concat_ws("\n", F.when(F.col("o_orderkey") % 23 == 0, "bad").otherwise((F.col("o_orderkey") % 40 * 10).cast("string")), F.lit("3"), F.lit("1,5"), F.lit("2.5"))
    by = o.groupBy(F.col("o_custkey").alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", lines.alias("l")))).alias("l"))
    return by.select("page_id", F.concat(F.lit("h\nh\nh\nh\n"), F.array_join(F.transform("l", lambda x: x["l"]), "\n")).alias("text"))


reg("web5_frequency_lines", lambda s, d: D.frequency_lines(freq_pages(s, d), "text"),
    """SELECT o_custkey AS page_id, (o_orderkey % 40 * 10)::INTEGER AS Score, 3 AS Frequency, 1.5 AS Matchpoints_NS, 2.5 AS Matchpoints_EW FROM
  (SELECT *, min(CASE WHEN o_orderkey % 23 = 0 THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS bad FROM orders) WHERE bad IS NULL OR o_orderkey < bad QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey % 40 ORDER BY o_orderkey) = 1""")
TX = lambda x: f"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'gs'), '\\s+', ' ', 'g'))"
PARA = "regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1)"
reg("web6_page_summary", lambda s, d: D.page_summary(pages(s, d)),
    f"""SELECT page_id, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang, {TX("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title, {TX("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS heading, len({PARA})::INTEGER AS n_paragraphs,
  len(regexp_extract_all(html, '<li[ >]'))::INTEGER AS n_items, len(regexp_extract_all(array_to_string(list_transform({PARA}, lambda x: {TX('x')}), ' '), '\\S+'))::INTEGER AS n_words FROM pages""")
# pages of the French provider, made from orders: a customer is a page, its orders are the rows
WEEK = ["Lundi", "Mardi", "Mercredi"]
DATE = lambda: F.concat(F.element_at(F.array(*[F.lit(x) for x in WEEK]), (F.col("o_custkey") % 3 + 1).cast("int")), F.lit(" "), (F.col("o_custkey") % 28 + 1).cast("string"), F.lit(" Juillet 2024"))
DATE_SQL = f"{WEEK}[o_custkey % 3 + 1] || ' ' || o_custkey % 28 + 1 || ' Juillet 2024'"
EVENT = lambda: F.concat(F.lit("Simultané du Roy n°"), F.col("o_custkey").cast("string"))


def of_orders(spark, sf, row, page, url):
    """One page a customer: page(rows joined) with a row for each order."""
    o = X.table(spark, sf, "orders")
    by = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", row(F.col("o_orderkey")).alias("r")))).alias("rows"), F.count(F.lit(1)).alias("n"))
    return by.select(F.col("o_custkey").alias("page_id"), url.alias("url"), page(F.array_join(F.transform("rows", lambda x: x["r"]), "\n")).alias("html"))


def cat(*parts):
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


URL = lambda: cat("https://r.example/?p=x&tr=", F.col("o_custkey"), "&cl=", F.col("o_custkey") % 97)
reg("web6_tournaments", lambda s, d: G.tournaments(of_orders(s, d, lambda k: cat(F.when(k % 9 > 0, cat('<div class="col-4 p-0 text-left h5"> ', F.when(k % 5 == 0, F.lit("bientôt")).otherwise(cat("le Lundi ", k % 28 + 1, " Mai 2023")), "</div>")).otherwise(""), '<a class="x" href="?p=clubs&res=sim&tr=', k, '"><b>T ', k % 10, "</b></a>"), lambda b: cat("<html>", b, "</html>"), URL())),
    """SELECT d.page_id, CASE WHEN d.k % 5 > 0 THEN 'Lundi ' || d.k % 28 + 1 || ' Mai 2023' END AS Date, a.k::VARCHAR AS Tournament_ID, 'T ' || a.k % 10 AS Tournament_Name FROM
  (SELECT o_custkey AS page_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders WHERE o_orderkey % 9 > 0) d JOIN
  (SELECT o_custkey AS page_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) a ON a.page_id = d.page_id AND a.i = d.i""")
reg("web6_clubs", lambda s, d: G.clubs(of_orders(s, d, lambda k: F.when(F.col("o_custkey") % 4 == 0, cat("cl=", k % 3)).otherwise(cat('<a href="?p=club&res=sim&tr=1&cl=', k, '">Club de ', k % 7, "</a>")), lambda b: cat("<h1>", EVENT(), "</h1><p>", DATE(), "</p>", b), URL())),
    f"""SELECT page_id, Date, Tournament_ID, Event_Name, Club_ID, Club_Name FROM (SELECT o_custkey AS page_id, {DATE_SQL} AS Date, o_custkey::VARCHAR AS Tournament_ID, 'Simultané du Roy n°' || o_custkey AS Event_Name, o_orderkey::VARCHAR AS Club_ID, 'Club de ' || o_orderkey % 7 AS Club_Name FROM orders WHERE o_custkey % 4 > 0
  UNION ALL SELECT DISTINCT o_custkey, {DATE_SQL}, o_custkey::VARCHAR, 'Simultané du Roy n°' || o_custkey, (o_orderkey % 3)::VARCHAR, 'Club ' || o_orderkey % 3 FROM orders WHERE o_custkey % 4 = 0)""")


def ranking_row(k):
    cells = [k % 60, cat(k % 100, ",25"), cat(k % 300, ".5"), F.when(k % 3 == 0, "").otherwise((k % 9).cast("string"))]
    numbers = cat(*[x for c in cells for x in ('<div class="col-3 h6">', c, "</div>")])
    link = F.when(k % 10 == 0, F.lit("no link")).otherwise(cat('<a href="?p=route&sc=', F.element_at(F.array(*map(F.lit, "ABC")), (k % 3 + 1).cast("int")), "&eq=", k % 40, '">DUPONT', k % 5, "&nbsp;-&nbsp;MARTIN</a>"))
    return cat('<div class="row text-center raye p-0 py-1"><div class="col-md-5">', numbers, '</div><div class="col-md-7"><div class="d-none d-sm-block">', k, " - ", k + 1, "</div>", link, "</div></div>")


reg("web6_ranking", lambda s, d: G.ranking(of_orders(s, d, ranking_row, lambda b: cat("<h1>", EVENT(), '</h1><div class="col-4 p-0 text-left h5"> ', DATE(), ' </div><div class="col p-0 py-2 h3">', F.col("n"), " paires - ", F.col("n") % 3, " clubs</div>", b), URL())),
    f"""SELECT o_custkey AS page_id, (o_orderkey % 60)::INTEGER AS Rank, o_orderkey % 100 + 0.25 AS Percent, o_orderkey % 300 + 0.5 AS Points, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 9 END::DOUBLE AS Bonus, o_orderkey::VARCHAR AS Player1_ID, (o_orderkey + 1)::VARCHAR AS Player2_ID, 'DUPONT' || o_orderkey % 5 AS Player1_Name, 'MARTIN' AS Player2_Name,
  ['A', 'B', 'C'][o_orderkey % 3 + 1] AS Section, (o_orderkey % 40)::VARCHAR AS Team_Number, 'Simultané du Roy n°' || o_custkey AS Event_Name, {DATE_SQL} AS Date, n AS Team_Count, n % 3 AS Club_Count, o_custkey::VARCHAR AS Event_ID, (o_custkey % 97)::VARCHAR AS Club_ID FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE o_orderkey % 10 > 0""")
FR = ["SA", "P", "♥", "K", "T"]


def route_row(k):
    """A round's opponents before every third board; a contract and a lead for each board, in the order of the board numbers, which is that of the orders."""
    foe = F.when(k % 3 == 0, cat('<div class="row"><div class="col adv"><b>', F.when(k % 2 == 0, "NS").otherwise("EO"), "</b> ", k % 50, " DURAND-B - PETIT (", k % 90 + 10, ",50 %)</div></div>\n")).otherwise("")
    board = cat('<div class="row"><div class="col-1"><a href="#">', k, '</a></div><div class="col-2 text-right"> ', F.when(k % 13 == 0, F.lit("Score")).otherwise((k % 900 - 400).cast("string")), ' </div><div class="col-4 text-right">', k % 200, ",5 (", k % 100, ",25 %)</div></div>\n")
    called = cat('<div class="col contrat">', F.element_at(F.array(*map(F.lit, "NESO")), (k % 4 + 1).cast("int")), " : ", k % 7 + 1, F.element_at(F.array(*map(F.lit, FR)), (k % 5 + 1).cast("int")), F.when(k % 3 == 0, "=").when(k % 3 == 1, "+1").otherwise("-2"), "</div>", '<div class="col entame">', F.element_at(F.array(*map(F.lit, ["♠R", "♥ 10", "♦D", "♣V"])), (k % 4 + 1).cast("int")), "</div>\n")
    return cat(foe, board, F.when(k % 13 == 0, "").otherwise(called))


reg("web6_route", lambda s, d: G.route(of_orders(s, d, route_row, lambda b: cat("<h1>", EVENT(), "</h1><h2>LEROY - MOREL (EO", F.col("o_custkey") % 300, " B)</h2>", b), URL())),
    f"""SELECT o_custkey AS page_id, k::INTEGER AS Board, (k % 900 - 400)::INTEGER AS Score, k % 200 + 0.5 AS Matchpoints, k % 100 + 0.25 AS Percentage, ['N', 'E', 'S', 'W'][k % 4 + 1] AS Declarer, k % 7 + 1 || ['N', 'S', 'H', 'D', 'C'][k % 5 + 1] || ['N', 'E', 'S', 'W'][k % 4 + 1] AS Contract, [0, 1, -2][k % 3 + 1]::INTEGER AS Result, ['SK', 'H10', 'DQ', 'CJ'][k % 4 + 1] AS Lead,
  'LEROY - MOREL' AS Pair_Names, 'EW' AS Pair_Direction, o_custkey % 300 AS Pair_Number, 'B' AS Section, 'Simultané du Roy n°' || o_custkey AS Event_Name, o_custkey::VARCHAR AS Tournament_ID, (o_custkey % 97)::VARCHAR AS Club_ID, CASE f % 2 WHEN 0 THEN 'NS' WHEN 1 THEN 'EW' END AS Opponent_Pair_Direction, f % 50 AS Opponent_Pair_Number, CASE WHEN f IS NOT NULL THEN 'DURAND-B - PETIT' END AS Opponent_Pair_Names
  FROM (SELECT *, o_orderkey AS k, max(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f FROM orders) WHERE k % 13 > 0""")


def board_pages(spark, sf):
    """One page a deal, with the hands in the pages' order and French honours."""
    x = X.deals(spark, sf)
    k, n = F.col("deal_id"), F.col("deal_id") % 36 + 1
    hands = F.split(F.substring("PBN", F.lit(3), F.length("PBN")), " ")
    suits = F.flatten(F.array(*[F.split(hands[i], "\\.", -1) for i in (0, 3, 1, 2)]))
    cards = F.array_join(F.transform(suits, lambda c: F.concat(F.lit('<div class="flex-grow-1 ms-3 gros">&nbsp;'), F.when(c == "", "-").otherwise(F.translate(c, "KQJ", "RDV")), F.lit("</div>"))), "\n")
    kind = F.when(k % 5 == 0, F.lit("&nbsp;SA")).otherwise(cat('<span class="', F.element_at(F.array(*map(F.lit, ["pique", "coeur", "carreau", "trefle"])), (k % 4 + 1).cast("int")), '">s</span>'))
    html = cat('<div class="col p-0 h2">Simultané n°', k % 9, '</div><div class="col p-0 h3">Leroy&nbsp;-&nbsp;Morel&nbsp;(', k % 77, "&nbsp;C)</div>", F.when(k % 17 == 0, "").otherwise(cat('<div class="col-8 p-0 h2">Donne ', n, "</div>")), '<div class="col-4">Top = ', k % 30, '</div><div class="col-4">Donneur : ',
               F.element_at(F.array(*map(F.lit, ["Nord", "Est", "Sud", "Ouest", "?"])), (k % 5 + 1).cast("int")), '</div><div class="col-4">Vulnérabilité : ', F.element_at(F.array(*map(F.lit, ["Personne", "Nord-Sud", "Est-Ouest", "Tous"])), (k % 4 + 1).cast("int")), '</div><span class="gros">Contrat (', F.element_at(F.array(*map(F.lit, "NESO")), (k % 4 + 1).cast("int")), ") : ", k % 7 + 1, kind, "</span><br>",
               "<p>Entame : ♥ D — x</p><p>Résultat : ", F.when(k % 3 == 0, F.lit("=")).otherwise(cat("-", k % 5)), '</p><div class="col">contre <span class="paires">EO&nbsp;: BON - JEAN-LE (', k % 55, '&nbsp;C)</span></div><div class="row colorise"><div class="col-3"> ', k % 700 - 300, " </div></div>", cards)
    return x.select(k.alias("page_id"), cat("https://r.example/?p=d&tr=", k % 99, "&cl=", k % 98).alias("url"), html.alias("html"))


reg("web6_boards", lambda s, d: G.boards(board_pages(s, d)), """SELECT deal_id AS page_id, (deal_id % 36 + 1)::INTEGER AS Board, PBN, (deal_id % 30)::INTEGER AS MP_Top, CASE WHEN deal_id % 5 < 4 THEN substr('NESW', (deal_id % 5 + 1)::INTEGER, 1) ELSE substr('NESW', (deal_id % 36 % 4 + 1)::INTEGER, 1) END AS Dealer, ['None', 'N_S', 'E_W', 'Both'][deal_id % 4 + 1] AS Vul, substr('NESW', (deal_id % 4 + 1)::INTEGER, 1) AS Declarer, 'HQ' AS Lead,
  deal_id % 7 + 1 || CASE WHEN deal_id % 5 = 0 THEN 'N' ELSE substr('SHDC', (deal_id % 4 + 1)::INTEGER, 1) END || substr('NESW', (deal_id % 4 + 1)::INTEGER, 1) AS Contract, CASE WHEN deal_id % 3 = 0 THEN 0 ELSE -(deal_id % 5) END::INTEGER AS Result, (deal_id % 700 - 300)::INTEGER AS Score, 'Simultané n°' || deal_id % 9 AS Event_Name, 'Leroy - Morel' AS Team_Name, deal_id % 77 AS Pair_Number, 'C' AS Section,
  (deal_id % 99)::VARCHAR AS Tournament_ID, (deal_id % 98)::VARCHAR AS Club_ID, 'EW' AS Opponent_Pair_Direction, deal_id % 55 AS Opponent_Pair_Number, 'BON - JEAN-LE' AS Opponent_Pair_Names, 'C' AS Opponent_Pair_Section FROM deals WHERE deal_id % 17 > 0""", "deals")
reg("web7_url_ids", lambda s, d: pages(s, d).select("page_id", *D.url_ids(F.col("url"))),
    "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '/([a-z]{2})/\\d+', 1) AS lang, try_cast(regexp_extract(url, '/[a-z]{2}/(\\d+)', 1) AS INTEGER) AS number, try_cast(regexp_extract(url, '[?&]page=(\\d+)', 1) AS INTEGER) AS page FROM pages")
MONTH = {int(v): k for k, v in N.FRENCH_MONTHS.items()}
reg("web8_translations", lambda s, d: X.table(s, d, "orders").select("o_orderkey", N.french_date(F.concat_ws(" ", F.dayofmonth("o_orderdate").cast("string"), F.element_at(F.array(*[F.lit(MONTH[i]) for i in range(1, 13)]), F.month("o_orderdate")), F.year("o_orderdate").cast("string"))).alias("day"), N.french_contract(F.concat((F.col("o_orderkey") % 9).cast("string"), F.element_at(F.array(*[F.lit(x) for x in ("SA", "p", "C", "k", "Tx")]), (F.col("o_orderkey") % 5 + 1).cast("int"))), F.lit("O")).alias("contract")),
    "SELECT o_orderkey, o_orderdate::DATE AS day, CASE WHEN o_orderkey % 9 BETWEEN 1 AND 7 THEN o_orderkey % 9 || ['N', 'S', 'H', 'D', 'CX'][o_orderkey % 5 + 1] || 'W' END AS contract FROM orders")
