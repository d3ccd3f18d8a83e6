"""The query surface: free SQL over a table, macros, named query sets, member search."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MACROS = {"Player_Direction": "NESW", "Partner_Direction": "NESW", "Pair_Direction": ("NS", "EW"), "Opponent_Pair_Direction": ("NS", "EW")}
DISPLAY = ("BidLvl", "Result", "Score_NS", "Score_EW", "Tricks", "MP_Top")


def expand_macros(sql: str, values: dict[str, str]) -> str:
    """Replace {Name} by its value, inside identifiers too; only the four names, and only values of the game, are allowed."""
    for name, value in values.items():
        if name not in MACROS or value not in tuple(MACROS[name]):
            raise ValueError(f"{name} = {value!r} is no macro value")
        sql = sql.replace("{" + name + "}", value)
    if left := re.findall(r"\{(\w+)\}", sql):
        raise ValueError(f"no value for {left}")
    return sql


def run_sql(df: DataFrame, sql: str, macros: dict[str, str] | None = None, view: str = "self", **args) -> DataFrame:
    """Free SQL over df as the view self; a text without FROM gets one, "self" in quotes is the view too. args are bound as values."""
    sql = expand_macros(sql, macros or {}).strip().rstrip(";").replace(f'"{view}"', view)
    if not re.search(r"\bselect\b", sql, re.I):
        sql = f"SELECT * {sql}" if re.match("from", sql, re.I) else f"SELECT * FROM {view} {sql}"
    elif not re.search(r"\bfrom\b", sql, re.I):
        sql = f"FROM {view} {sql}"
    session = df.sparkSession
    name = f"{view}_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    try:
        return session.sql(re.sub(rf"\b{view}\b", name, sql), args=args or None)
    finally:
        session.catalog.dropTempView(name)  # the result holds the plan, not the name


def try_sql(df: DataFrame, sql: str, **kw) -> tuple[DataFrame | None, str]:
    """The result, or the error's text: a wrong query is reported and not raised."""
    try:
        return run_sql(df, sql, **kw), ""
    except Exception as e:  # noqa: BLE001  whatever the parser or analyser says is for the user
        return None, str(e).strip().splitlines()[0]


def run_report(df: DataFrame, prompts: list[tuple[str, list[str]]], macros: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Named queries in order: title and number -> result."""
    return {f"{title} {i}": run_sql(df, sql, macros) for title, queries in prompts for i, sql in enumerate(queries, 1)}


def display_casts(df: DataFrame, columns: tuple = DISPLAY) -> DataFrame:
    """Lenient integer casts of the display columns; what isn't a number gives null."""
    return df.withColumns({c: F.col(c).try_cast("int") for c in columns if c in df.columns})


def search_members(df: DataFrame, query: str, id_column: str, name_column: str) -> DataFrame:
    """People by id (digits) or by part of the name, in either case."""
    query = query.strip()
    if query.isdigit():
        return df.where(F.col(id_column).cast("string") == query)
    return df.where(F.contains(F.lower(name_column), F.lit(query.lower())))
