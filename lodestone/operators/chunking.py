"""Chunkers: texts and timed segments to ordered pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_pack
from .relational import string_ordered


def chunk_windows(df: DataFrame, key: str, text: str, size: int = 500, overlap: int = 100) -> DataFrame:
    """Windows of `size` characters, each beginning size - overlap after the last, until one reaches the end: key, chunk_index, start_char, text."""
    step, n = size - overlap, F.length(text)
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step) * step).cast("int")
    rows = df.filter(F.length(text) > 0).select(key, F.col(text).alias("_t"), F.posexplode(F.sequence(F.lit(0), last, F.lit(step))).alias("chunk_index", "start_char"))
    return rows.select(key, "chunk_index", "start_char", F.expr(f"substring(_t, start_char + 1, {size})").alias("text"))


def chunk_units(df: DataFrame, group: str, order: str, text: str, size: int = 500, overlap: int = 100) -> DataFrame:
    """chunk_windows over the units of each group, joined by spaces, with the first and last unit that a chunk covers."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(order)
    units = df.filter(F.col(text).isNotNull()).withColumn("_end", F.sum(F.length(text) + 1).over(w)).withColumn("_begin", F.col("_end") - F.length(text) - 1)
    whole = df.groupBy(group).agg(string_ordered(text, [order, text], " ").alias("text"))
    chunks = chunk_windows(whole, group, "text", size, overlap).withColumn("_stop", F.col("start_char") + F.length("text"))
    covered = chunks.join(units.select(group, F.col(order).alias("_unit"), "_begin", "_end"), group).filter("_begin < _stop and _end - 1 > start_char")
    return covered.groupBy(group, "chunk_index", "start_char", "text").agg(F.min("_unit").alias("first_unit"), F.max("_unit").alias("last_unit"), F.concat(F.col(group).cast("string"), F.lit("-"), F.lpad(F.col("chunk_index").cast("string"), 4, "0")).alias("chunk_id"))


def _map_text(df: DataFrame, key: str, text: str, cut) -> DataFrame:
    """key, chunk_index, text of what cut(text) gives for each row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, index, out = [], [], []
            for i, t in enumerate(b.column(text).to_pylist()):
                pieces = cut(t or "")
                keys += [i] * len(pieces)
                index += range(len(pieces))
                out += pieces
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(keys, pa.int64())), pa.array(index, pa.int32()), pa.array(out, pa.string())], [key, "chunk_index", "text"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, chunk_index int, text string")


_SENTENCE = re.compile(r"[.!?。！？][\"'”’)]*\s|\n")


def sentence_cuts(text: str, size: int = 500, ratio: float = 0.2, look: float = 0.4, least: int = 50, boundaries: str | re.Pattern | Sequence[str] = _SENTENCE) -> list[str]:
    """Pieces of up to `size` characters that end at a sentence's end (a match of boundaries) in the last `look` of the window where there is one.

    Of several patterns, an earlier one wins over a later one wherever it matches; of one pattern the last match counts. The next piece
    begins ratio * size before the cut. A piece under `least` characters joins the one before.
    """
    text, ranks = text.strip(), [re.compile(b) for b in ([boundaries] if isinstance(boundaries, str | re.Pattern) else boundaries)]
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            floor = start + int(size * (1 - look))
            end = next((ends[-1] for rank in ranks if (ends := [m.end() for m in rank.finditer(text, floor, end)])), end)
        piece = text[start:end].strip()
        if piece and len(piece) < least and out:
            out[-1] = f"{out[-1]} {piece}"
        elif piece:
            out.append(piece)
        if end >= len(text):
            break
        start = max(end - int(size * ratio), start + 1)
    return out


def chunk_sentences(df: DataFrame, key: str, text: str, size: int = 500, ratio: float = 0.2, boundaries: str | Sequence[str] = _SENTENCE.pattern) -> DataFrame:
    """sentence_cuts() of each row: key, chunk_index, text."""
    return _map_text(df, key, text, lambda t: sentence_cuts(t, size, ratio, boundaries=boundaries))


def period_cuts(text: str, size: int = 500, ratio: float = 0.2, least: int = 50) -> list[str]:
    """Pieces that end behind the last period or line break, where that is past the window's middle; pieces of up to `least` characters go."""
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            stop = max(text.rfind(".", start, end), text.rfind("\n", start, end))
            if stop > start + size // 2:
                end = stop + 1
        piece = text[start:end].strip()
        if len(piece) > least:
            out.append(piece)
        if end >= len(text):
            break
        start = max(end - int(size * ratio), start + 1)
    return out


def chunk_period(df: DataFrame, key: str, text: str, size: int = 500, ratio: float = 0.2) -> DataFrame:
    return _map_text(df, key, text, lambda t: period_cuts(t, size, ratio))


def pack_sentences(df: DataFrame, key: str, text: str, size: int = 500, least: int = 50) -> DataFrame:
    """Whole sentences packed to `size` characters, without overlap; pieces of up to `least` characters go."""
    sentences = F.filter(F.transform(F.split(F.col(text), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(key, F.posexplode(fold_pack(sentences, size, " ", least)).alias("chunk_index", "text"))


def pack_paragraphs(df: DataFrame, key: str, text: str, size: int = 1000) -> DataFrame:
    """Paragraphs packed to `size` characters; longer ones are split into sentences first; the whole text where nothing results."""
    parts = F.flatten(F.transform(F.split(F.col(text), r"\n+"), lambda p: F.when(F.length(p) > size, F.split(p, r"(?<=[.!?])\s+")).otherwise(F.array(p))))
    packed = fold_pack(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), size, "\n")
    return df.select(key, F.posexplode(F.when(F.size(packed) > 0, packed).otherwise(F.array(F.col(text)))).alias("chunk_index", "text"))


def pack_segments(df: DataFrame, key: str, order: str, start: str, end: str, text: str, size: int = 500, overlap_words: int = 10) -> DataFrame:
    """Timed segments packed to `size` characters: key, chunk_index, text, start_s, end_s. A chunk begins with the last words of the one before."""

    def pack(t: pa.Table) -> pa.Table:
        rows = t.sort_by(order).to_pylist()
        out, buf, since = [], "", None
        for r in rows:
            word = (r[text] or "").strip()
            if buf and len(buf) + 1 + len(word) > size:
                out.append((buf, since, until))  # noqa: F821
                buf, since = " ".join(buf.split()[-overlap_words:]), r[start]
            buf = f"{buf} {word}".strip()
            since = r[start] if since is None else since
            until = r[end]  # noqa: F841
        if buf:
            out.append((buf, since, until))
        k = t.column(key)[0].as_py()
        return pa.table({key: pa.array([k] * len(out), t.schema.field(key).type), "chunk_index": pa.array(range(len(out)), pa.int32()), "text": pa.array([x[0] for x in out], pa.string()), "start_s": pa.array([x[1] for x in out], pa.float64()), "end_s": pa.array([x[2] for x in out], pa.float64())})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, order, start, end, text).groupBy(key).applyInArrow(pack, f"{key} {kind}, chunk_index int, text string, start_s double, end_s double")


def reassemble(df: DataFrame, key: str, order: str, text: str, probe: int = 50, most: int = 150) -> DataFrame:
    """Texts put together from overlapping chunks: where the last `probe` characters so far stand in the first `most` of the next, what they end is left out."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])

    def step(acc, x):
        at = F.position(F.substring(acc, -probe, probe), F.substring(x, 1, most))
        return F.when(acc == "", x).when(at > 0, F.concat(acc, F.substring(x, at + probe, F.length(x)))).otherwise(F.concat(acc, F.lit("\n"), x))

    return df.groupBy(key).agg(F.aggregate(parts, F.lit(""), step).alias("text"), F.count("*").alias("chunks"))


def split_marked(df: DataFrame, key: str, text: str, markers: Sequence[str], least: int = 100) -> DataFrame:
    """Texts split at the first marker pattern that occurs; parts of more than `least` characters, or the whole text: key, part_no, text."""
    parts = F.array(F.col(text))
    for m in reversed(markers):
        parts = F.when(F.col(text).rlike(m), F.split(F.col(text), m)).otherwise(parts)
    good = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) > least)
    return df.select(key, F.posexplode(F.when(F.size(good) > 0, good).otherwise(F.array(F.trim(text)))).alias("part_no", "text"))


def split_headers(df: DataFrame, key: str, text: str, header: str = r"\n(?=[A-ZÉÈÀ][^\n]{0,60}\n)") -> DataFrame:
    """Sections at header lines: key, part_no, title (first line), text (rest)."""
    rows = df.select(key, F.posexplode(F.split(F.col(text), header)).alias("part_no", "section"))
    return rows.select(key, "part_no", F.trim(F.split_part("section", F.lit("\n"), F.lit(1))).alias("title"), F.trim(F.when(F.contains("section", F.lit("\n")), F.expr("substring(section, instr(section, '\\n') + 1)")).otherwise(F.lit(""))).alias("text"))


def parse_sections(df: DataFrame, key: str, text: str, types: Sequence[tuple[str, str]], split: str = r"\n---+\n", least: int = 10) -> DataFrame:
    """Labelled sections ('Type: x', 'Title: y', 'Content: z'): key, section_no, section_type, title, content, confidence (0.9 for a known type, else 0.7)."""
    field = lambda name: F.trim(F.regexp_extract("section", rf"(?i){name}:[ \t]*([^\n]*)", 1))
    raw = F.lower(field("type"))
    kind = F.lit("other")
    for word, name in reversed(types):
        kind = F.when(F.contains(raw, F.lit(word)), name).otherwise(kind)
    rows = df.select(key, F.posexplode(F.split(F.col(text), split)).alias("section_no", "section"))
    out = rows.select(key, "section_no", kind.alias("section_type"), field("title").alias("title"), F.trim(F.regexp_extract("section", r"(?is)content:\s*(.*)$", 1)).alias("content"))
    return out.filter(F.length("content") >= least).withColumn("confidence", F.when(F.col("section_type") != "other", 0.9).otherwise(0.7))


def page_chunk(df: DataFrame, key: str, title: str, text: str, rules: Sequence[tuple[str, Sequence[str]]], cap: int = 4000) -> DataFrame:
    """One chunk a page: type by ordered rules, entities (words in capitals) in front, markdown stripped, at most `cap` characters."""
    from ..functions.text import classify, strip_markdown

    names = F.slice(F.array_distinct(F.filter(F.split(F.col(text), r"[^\p{L}\p{N}]+"), lambda w: w.rlike(r"^[A-Z][a-z]{4,}$"))), 1, 5)
    body = F.concat_ws("\n", F.col(title), F.concat(F.lit("Names: "), F.array_join(names, ", ")), strip_markdown(text))
    return df.select(key, classify(text, rules, "general").alias("section_type"), F.substring(body, 1, cap).alias("text"))


def parse_lines(df: DataFrame, key: str, text: str, patterns: Sequence[str]) -> DataFrame:
    """(label, value) of each line by the first pattern (two groups) that matches: key, line_no, label, value."""
    rows = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    hit = lambda g: F.coalesce(*[F.when(F.col("line").rlike(p), F.trim(F.regexp_extract("line", p, g))) for p in patterns])
    return rows.select(key, "line_no", hit(1).alias("label"), hit(2).alias("value")).filter("label is not null")
