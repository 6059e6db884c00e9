"""Nested and textual sources: JSON maps, embedded JSON, TSV edges, XML menus, calendars of issues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import correct_regex


def explode_nested(df: DataFrame, column: str, levels: Sequence[str], leaf: str, ref_format: str) -> DataFrame:
    """A JSON text of nested maps as rows: a column for each level's key, the leaf, and a reference made of the keys."""
    kind = "string"
    for _ in levels:
        kind = f"map<string,{kind}>"
    out = df.select(F.from_json(column, kind).alias("_m"))
    names: list[str] = []
    for level in levels:
        out = out.select(*names, F.explode("_m").alias(level, "_m"))
        names.append(level)
    return out.select(*names, F.col("_m").alias(leaf), F.format_string(ref_format, *names).alias("ref"))


def json_rows(df: DataFrame, key: str, column: str, schema: str) -> DataFrame:
    """The JSON array that stands in a free text, as rows."""
    found = F.regexp_extract(F.col(column), r"(?s)\[.*\]", 0)
    return df.select(key, F.explode(F.from_json(found, f"array<struct<{', '.join(p.strip().replace(' ', ':', 1) for p in schema.split(','))}>>")).alias("r")).select(key, "r.*")


def articles_from_json(df: DataFrame, key: str, column: str, fields: Sequence[str], rules: Sequence[tuple[str, str]], defaults: Mapping[str, str]) -> DataFrame:
    """{"articles": [{field: text}]} as rows, each field corrected by the rules, with defaults: key, no, fields."""
    schema = "articles array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>"
    rows = df.select(key, F.posexplode(F.from_json(column, schema)["articles"]).alias("no", "a"))
    fixed = lambda f: F.coalesce(correct_regex(F.col(f"a.{f}"), rules)[0], F.lit(defaults.get(f)))
    return rows.select(key, "no", *[fixed(f).alias(f) for f in fields])


def tsv_edges(lines: DataFrame, codes: DataFrame, column: str = "value") -> DataFrame:
    """Edges of 'from<TAB>to<TAB>votes' lines: comments, blanks, short lines, negative or other votes and unknown codes drop out, as do self edges.

    codes: (code, id).
    """
    parts = F.split(column, "\t")
    rows = lines.filter(~F.col(column).startswith("#") & (F.trim(column) != "")).filter(F.size(parts) >= 3)
    rows = rows.select(F.trim(F.get(parts, 0)).alias("a"), F.trim(F.get(parts, 1)).alias("b"), F.trim(F.get(parts, 2)).try_cast("int").alias("votes")).filter("votes >= 0")
    named = rows.join(codes.select(F.col("code").alias("a"), F.col("id").alias("src")), "a").join(codes.select(F.col("code").alias("b"), F.col("id").alias("dst")), "b")
    return named.filter("src <> dst").select("src", "dst", "votes")


def read_tsv_edges(spark: SparkSession, path: str, codes: DataFrame) -> DataFrame:
    return tsv_edges(spark.read.text(path), codes)


_ITEM = "struct<_name:string,_link:string,_display:string>"
_MENU = f"item array<struct<_name:string,_link:string,_display:string,item:array<struct<_name:string,_link:string,_display:string,item:array<{_ITEM}>>>>>"


def xml_menu(df: DataFrame, key: str, column: str) -> DataFrame:
    """Menus of up to three levels with base64 names and URL-encoded links: key, depth, title, link; hidden items drop out."""
    root = df.select(key, F.from_xml(column, _MENU).alias("m")).select(key, F.explode("m.item").alias("a"))
    two = root.select(key, F.explode("a.item").alias("a"))
    three = two.select(key, F.explode("a.item").alias("a"))
    part = lambda d, depth: d.select(key, F.lit(depth).alias("depth"), F.decode(F.unbase64("a._name"), "UTF-8").alias("title"), F.url_decode("a._link").alias("link"), F.col("a._display").alias("display"))
    return part(root, 1).unionByName(part(two, 2)).unionByName(part(three, 3)).filter("coalesce(display, 'Y') <> 'N'").drop("display")


def issue_month(issue: Column, base: int = 433, year: int = 2020, month: int = 2) -> Column:
    """The month 'yyyy-MM' of a monthly issue, counted from a known one."""
    m = F.lit(year * 12 + month - 1) + issue - base
    return F.format_string("%04d-%02d", F.floor(m / 12), F.pmod(m, F.lit(12)) + 1)


def month_issue(label: Column, base: int = 433, year: int = 2020, month: int = 2) -> Column:
    """The issue of a label with 'yyyy-MM' in it; null without one."""
    y, m = (F.nullif(F.regexp_extract(label, r"(\d{4})-(\d{1,2})", k), F.lit("")).cast("int") for k in (1, 2))
    return y * 12 + m - 1 - (year * 12 + month - 1) + base
