"""Nested JSON and stored web pages as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.canonical import keep_first
from . import elements as E
from .folders import remove


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Struct columns, however deep, as columns a_b_c; arrays and maps stay."""

    def leaves(schema: T.StructType, path: list[str]):
        for f in schema.fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, [*path, f.name])
            else:
                yield F.col(".".join(f"`{p}`" for p in [*path, f.name])).alias(sep.join([*path, f.name]))

    return df.select(*leaves(df.schema, []))


def repair_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns all of whose values are numbers (decimal comma or point) become double; the others stay. One aggregate decides for all."""
    as_number = lambda c: F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")
    bad = df.agg(*[F.count(F.when(F.col(c).isNotNull() & as_number(F.col(c)).isNull(), 1)).alias(c) for c in columns]).first()
    return df.withColumns({c: as_number(F.col(c)) for c in columns if bad[c] == 0})


def explode_structs(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """A column of struct lists -> one row an element (null and empty lists keep their row) with fields prefix_name; an all-null text column is only dropped."""
    kind = df.schema[column].dataType
    rest = [c for c in df.columns if c != column]
    if isinstance(kind, T.ArrayType):
        df = df.select(*rest, F.explode_outer(column).alias(column))
        kind = kind.elementType
    if not isinstance(kind, T.StructType):
        return df.select(*rest)
    return df.select(*rest, *[F.col(f"{column}.{f}").alias(f"{prefix}_{f}") for f in kind.names])


def scores_text(column: Column) -> Column:
    """List of {ewScore, nsScore, ewNote, nsNote, count} as [EW=../NS=.., ../.., n=..] joined by ; with blanks as -."""
    show = lambda x: F.when(F.trim(F.coalesce(x.cast("string"), F.lit(""))) == "", "-").otherwise(x.cast("string"))
    one = lambda x: F.concat(F.lit("[EW="), show(x["ewScore"]), F.lit("/NS="), show(x["nsScore"]), F.lit(", "), show(x["ewNote"]), F.lit("/"), show(x["nsNote"]), F.lit(", n="), show(x["count"]), F.lit("]"))
    return F.array_join(F.transform(column, one), "; ")


def relational(df: DataFrame, paths: dict[str, str], key: str) -> dict[str, DataFrame]:
    """One table a record path (dots go down through lists), each with the document's key and the position of every list on the way."""
    out = {}
    for name, path in paths.items():
        t, ids, steps = df, [key], path.split(".") if path else []
        for i, step in enumerate(steps):
            source = step if i == 0 else f"x.{step}"
            t = t.select(*ids, F.posexplode(source).alias(f"{step}_no", "x"))
            ids.append(f"{step}_no")
        if steps:
            simple = [f.name for f in t.schema["x"].dataType.fields if not isinstance(f.dataType, (T.ArrayType, T.StructType))]
            out[name] = t.select(*ids, *[F.col(f"x.{f}") for f in simple])
        else:
            out[name] = t.select(key, *[f.name for f in t.schema.fields if f.name != key and not isinstance(f.dataType, (T.ArrayType, T.StructType))])
    return out


def walk(df: DataFrame, key: str) -> dict[str, DataFrame]:
    """Tables of any document, from the schema alone: every list of structs opens a table whose id is its parent's id, a dash and the position."""
    out: dict[str, DataFrame] = {}

    def visit(t: DataFrame, name: str, fields: list[T.StructField], at: str):
        simple = [f.name for f in fields if not isinstance(f.dataType, (T.ArrayType, T.StructType)) and f.name != key]
        out[name] = t.select("id", *(["parent"] if "parent" in t.columns else []), *[F.col(f"{at}{f}") for f in simple])
        for f in fields:
            if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                child = t.select(F.col("id").alias("parent"), F.posexplode(f"{at}{f.name}").alias("_i", "x")).withColumn("id", F.concat_ws("-", "parent", F.col("_i").cast("string")))
                visit(child, f.name, f.dataType.elementType.fields, "x.")

    visit(df.withColumn("id", F.col(key).cast("string")), "root", df.schema.fields, "")
    return out


def walk_variants(docs: DataFrame, doc: str, value: str, folder: str, primary_keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc, tbl, id, parent, field, value as text) of documents whose shape differs from row to row: docs has a key and a VARIANT of parse_json.

    An object is a row of the table that its own key names (root at the top); an object inside it is a row of its own table under the same id. A list's elements have the id of what holds the list, a dash
    and the position; an object all of whose keys are digits counts as a list with those keys for positions. Elements that are no objects have the field `value`. If an object
    has one of primary_keys (a number or text), that is its id. parent is the id of the row above, null at the top; an object without plain fields has one row with a null field. A null
    document has no rows, and a JSON null the value null. Each level of nesting is one step over all documents, and a table below folder. Objects meet their
    fields in a merge join: keys that compress well would be taken for a table to broadcast.
    """
    spark = docs.sparkSession
    names = ["doc", "tbl", "id", "parent"]
    front = docs.select(F.col(doc).cast("string").alias("doc"), F.lit("root").alias("tbl"), F.col(doc).cast("string").alias("id"), F.lit(None).cast("string").alias("parent"), F.col(value).alias("v")).where("v is not null")
    digits = F.forall(F.json_object_keys(F.to_json("v")), lambda k: k.rlike("^[0-9]+$"))
    kind = lambda v: F.substring(F.schema_of_variant(v), 1, 5)
    own = F.coalesce(*[F.try_variant_get("v", f"$.{k}", "string") for k in primary_keys], F.col("id")) if primary_keys else F.col("id")
    schema, step = "doc string, tbl string, id string, parent string, field string, value string", 0
    while True:
        front = front.withColumn("kind", F.when(kind(F.col("v")) == "OBJEC", F.when(digits & (F.length(F.to_json("v")) > 2), "map").otherwise("object")).when(kind(F.col("v")) == "ARRAY", "list").otherwise("plain"))
        front = front.withColumn("id", F.when(F.col("kind") == "object", own).otherwise(F.col("id")))
        front.write.parquet(f"{folder}/front-{step}")
        front = spark.read.parquet(f"{folder}/front-{step}")
        view = f"front_{uuid.uuid4().hex}"
        front.createOrReplaceTempView(view)
        parts = spark.sql(f"SELECT f.doc, f.tbl, f.id, f.parent, f.kind, x.pos, x.key, x.value AS v FROM {view} f, LATERAL variant_explode(f.v) x WHERE f.kind <> 'plain'")
        plain = ~kind(F.col("v")).isin("OBJEC", "ARRAY")
        fields = parts.where((F.col("kind") == "object") & plain).select(*names, F.col("key").alias("field"), F.col("v").cast("string").alias("value"))
        elements = front.where("kind = 'plain'").select(*names, F.lit("value").alias("field"), F.col("v").cast("string").alias("value"))
        rows = front.where("kind = 'object'").select(*names, F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"))
        rows = rows.join(fields.select("doc", "tbl", "id").distinct().hint("merge"), ["doc", "tbl", "id"], "left_anti").select(*names, "field", "value")
        fields.unionByName(elements).unionByName(rows).write.parquet(f"{folder}/rows/{step}")
        spark.catalog.dropTempView(view)
        inside = F.col("kind") == "object"
        place = F.concat_ws("-", "id", F.coalesce("key", F.col("pos").cast("string")))
        front = parts.where(~inside | ~plain).select(
            "doc", F.when(inside, F.col("key")).otherwise(F.col("tbl")).alias("tbl"), F.when(inside, F.col("id")).otherwise(place).alias("id"), F.when(inside, F.col("id")).otherwise(F.col("parent")).alias("parent"), "v"
        )
        step += 1
        if not spark.read.parquet(f"{folder}/front-{step - 1}").where("kind <> 'plain'").limit(1).count():
            break
    for i in range(step):
        remove(spark, f"{folder}/front-{i}")
    return spark.read.schema(schema).parquet(*[f"{folder}/rows/{i}" for i in range(step)])


def walked_table(rows: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """One table of walk_variants with the given fields as columns."""
    return rows.where(F.col("tbl") == name).groupBy("doc", "id", "parent").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])


def newest(rows: DataFrame, keys: list[str], updated: str, ties: list[str]) -> DataFrame:
    """Insert-or-update: of each key the row updated last; ties by further columns, largest first."""
    return keep_first(rows, keys, [F.col(updated).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in ties]])


def orphans(child: DataFrame, parent: DataFrame, foreign: str, primary: str) -> DataFrame:
    """Rows whose foreign key has no parent; null keys are no orphans."""
    return child.where(F.col(foreign).isNotNull()).join(parent.select(F.col(primary).alias(foreign)), foreign, "left_anti")


def leaf_paths(df: DataFrame, key: str) -> DataFrame:
    """(key, path, value) of every leaf, list positions in the path."""
    out = None

    def visit(t: DataFrame, kind, at: str, prefix: Column):
        nonlocal out
        for f in kind.fields:
            name = F.concat(prefix, F.lit(f.name))
            if isinstance(f.dataType, T.StructType):
                visit(t, f.dataType, f"{at}{f.name}.", F.concat(name, F.lit(".")))
            elif isinstance(f.dataType, T.ArrayType):
                items = t.select("_key", name.alias("_p"), F.posexplode(f"{at}{f.name}").alias("_i", "x")).withColumn("_p", F.concat("_p", F.lit("["), F.col("_i").cast("string"), F.lit("]")))
                if isinstance(f.dataType.elementType, T.StructType):
                    visit(items, f.dataType.elementType, "x.", F.concat("_p", F.lit(".")))
                else:
                    add(items.select("_key", "_p", F.col("x").cast("string").alias("value")))
            elif f.name != "_key":
                add(t.select("_key", name.alias("_p"), F.col(f"{at}{f.name}").cast("string").alias("value")))

    def add(part):
        nonlocal out
        out = part if out is None else out.unionByName(part)

    body = df.withColumnRenamed(key, "_key")
    visit(body, body.schema, "", F.lit(""))
    return out.select(F.col("_key").alias(key), F.col("_p").alias("path"), "value")


def embedded_json(html: Column, schema: str) -> Column:
    """The object assigned as `var data = {...};`, parsed; null where there is none or it is broken."""
    text = F.regexp_extract(html, r"(?s)var\s+data\s*=\s*(\{.*?\});", 1)
    return F.from_json(F.when(text != "", text), schema)


def all_matches(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def text_of(html: Column) -> Column:
    """Without tags, white space single."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"\s+", " "))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, text) of every anchor with an address."""
    return E.anchors(E.elements(pages))


def result_links(pages: DataFrame) -> DataFrame:
    """Rows of tables with an anchor .../details/<n>: n (once a page, descending), cells 0, 1, 2, 3 and 5 joined, club id of the row's club link."""
    rows = E.table_rows(E.elements(pages))
    of = lambda pattern: F.get(F.filter(F.transform("hrefs", lambda h: F.regexp_extract(h, pattern, 1)), lambda x: x != ""), F.lit(0))
    df = rows.withColumns({"n": of(r"/details/(\d+)").try_cast("int"), "club": F.coalesce(of(r"/clubs/(\d+)"), F.lit(""))}).where("n is not null")
    label = F.concat_ws(", ", *[F.try_element_at("c", F.lit(i + 1)) for i in (0, 1, 2, 3, 5)])
    return keep_first(df.withColumn("label", label), ["page_id", "n"], [F.col("pos")]).select("page_id", "n", "label", "club")


# fixed values: header texts of the columns of a results table, first match wins
HEADERS = {"place": ("pos", "position"), "pair": ("no", "pair"), "name": ("players",), "points": ("matchpoints", "mp", "mps"), "score": ("score%", "score")}


def results_table(pages: DataFrame) -> DataFrame:
    """Table rows under section headers (North / South, East / West): section, place, pair, name, points, score.

    A row whose cells name the players and the score gives the columns of the rows after it, by HEADERS. Rows before any header,
    with too few cells or whose place is no number are skipped, as are those whose pair, points or score is no number; empty points and scores are 0.
    """
    df = E.table_rows(E.elements(pages)).where(F.size("c") > 0)
    whole, low = F.array_join("c", " "), F.transform("c", F.lower)
    head = F.when(whole.rlike(r"(?i)north\s*/\s*south"), "NS").when(whole.rlike(r"(?i)east\s*/\s*west"), "EW")
    titles = F.contains(whole, F.lit("Players")) & F.contains(whole, F.lit("Score"))
    # places from 1; 0 where no alias is there
    place = lambda names: F.coalesce(*[F.when(F.array_contains(low, n), F.array_position(low, F.lit(n)).cast("int")) for n in names], F.lit(0))
    at = F.when(titles, F.struct(*[place(names).alias(k) for k, names in HEADERS.items()]))
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # a page's rows
    df = df.withColumns({"section": F.last(head, ignorenulls=True).over(w), "at": F.last(at, ignorenulls=True).over(w), "other": head.isNotNull() | titles})
    df = df.where(~F.coalesce("other", F.lit(False)) & F.col("section").isNotNull() & (F.least(*[F.col(f"at.{k}") for k in HEADERS]) > 0) & (F.greatest(*[F.col(f"at.{k}") for k in HEADERS]) <= F.size("c")))
    cell = lambda k: F.get("c", F.col(f"at.{k}") - 1)
    number = lambda k: F.when(cell(k) == "", 0.0).otherwise(F.replace(cell(k), F.lit(","), F.lit(".")).try_cast("double"))
    out = df.select("page_id", "section", F.when(cell("place").rlike(r"^\d+$"), cell("place").try_cast("int")).alias("place"), cell("pair").try_cast("int").alias("pair"), cell("name").alias("name"), number("points").alias("points"), number("score").alias("score"))
    return out.where("place is not null and pair is not null and points is not null and score is not null")


def info_table(pages: DataFrame) -> DataFrame:
    """(page_id, m): a map of a page's three-column table rows, label in lower case with _ for blanks -> value of the third cell; the first of equal labels counts. Pages without such rows have an empty map."""
    rows = E.table_rows(E.elements(pages)).where(F.size("c") == 3)
    rows = rows.select("page_id", "pos", F.regexp_replace(F.lower(F.col("c")[0]), r"[\s:]+", "_").alias("k"), F.col("c")[2].alias("v"))
    first = rows.groupBy("page_id", "k").agg(F.min_by("v", "pos").alias("v"))
    maps = first.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    return pages.select("page_id").join(maps, "page_id", "left").select("page_id", F.coalesce("m", F.create_map().cast("map<string,string>")).alias("m"))


def frequency_lines(pages: DataFrame, text: str, header: int = 4) -> DataFrame:
    """After the header lines, groups of four: score, count, NS and EW points; the first bad group ends the page; first of each score."""
    lines = pages.select("page_id", F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).where(F.col("pos") >= header)
    g = F.floor((F.col("pos") - header) / 4)
    cell = lambda i: F.max(F.when((F.col("pos") - header) % 4 == i, F.trim("line")))
    rows = lines.groupBy("page_id", g.alias("g")).agg(*[cell(i).alias(f"c{i}") for i in range(4)])
    number = lambda c: F.replace(F.col(c), F.lit(","), F.lit(".")).try_cast("double")
    rows = rows.select("page_id", "g", F.col("c0").try_cast("int").alias("Score"), F.col("c1").try_cast("int").alias("Frequency"), number("c2").alias("Matchpoints_NS"), number("c3").alias("Matchpoints_EW"))
    good = F.coalesce(F.col("Score").between(-2000, 2000) & F.col("Frequency").between(0, 100) & F.col("Matchpoints_NS").isNotNull() & F.col("Matchpoints_EW").isNotNull(), F.lit(False))
    bad = rows.where(~good).groupBy("page_id").agg(F.min("g").alias("bad"))
    rows = rows.join(bad, "page_id", "left").where(F.col("bad").isNull() | (F.col("g") < F.col("bad")))
    return keep_first(rows, ["page_id", "Score"], ["g"]).drop("g", "bad")


def page_summary(pages: DataFrame) -> DataFrame:
    """Per page: language, title, first heading, numbers of paragraphs and list items, words of the paragraphs."""
    html = F.col("html")
    paragraphs = F.transform(all_matches(html, r"(?s)<p[^>]*>(.*?)</p>"), text_of)
    return pages.select(
        "page_id", F.regexp_extract(html, r'<html[^>]*lang="([^"]*)"', 1).alias("lang"), text_of(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)).alias("title"), text_of(F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1)).alias("heading"),
        F.size(paragraphs).alias("n_paragraphs"), F.size(all_matches(html, r"(<li[ >])")).alias("n_items"), F.regexp_count(F.array_join(paragraphs, " "), F.lit(r"\S+")).alias("n_words"),
    )


def url_ids(url: Column) -> list[Column]:
    """Host, language part and number of a page's address, and the page parameter of its query."""
    return [F.regexp_extract(url, r"^https?://([^/]+)", 1).alias("host"), F.regexp_extract(url, r"/([a-z]{2})/\d+", 1).alias("lang"), F.regexp_extract(url, r"/[a-z]{2}/(\d+)", 1).try_cast("int").alias("number"), F.regexp_extract(url, r"[?&]page=(\d+)", 1).try_cast("int").alias("page")]
