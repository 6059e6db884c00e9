"""Column functions over texts: tokens, rank, references, times, URLs."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(_c(c)), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def match_terms(text: Column | str, query: str, mode: str = "all", substring: bool = True) -> Column:
    """All (or any) terms of the query are tokens of the text, or, with substring, the query stands in it."""
    terms = list(dict.fromkeys(query.lower().split()))
    hits = [F.array_contains(tokens(text), t) for t in terms]
    out = reduce((lambda a, b: a & b) if mode == "all" else (lambda a, b: a | b), hits)
    return out | F.contains(F.lower(_c(text)), F.lit(query.lower())) if substring else out


def keyword_rank(text: Column | str, query: str) -> Column:
    """(1 / terms) * sum of ln(1 + tf) over (1 + ln(1 + tokens)): 0 or more."""
    terms = list(dict.fromkeys(query.lower().split()))
    t = tokens(text)
    tf = [F.log1p(F.size(F.filter(t, lambda x, w=w: x == w)).cast("double")) for w in terms]
    return reduce(lambda a, b: a + b, tf) / len(terms) / (1 + F.log1p(F.size(t).cast("double")))


def classify(text: Column | str, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The first rule (label, keywords) of which any keyword stands in the text."""
    low = F.lower(_c(text))
    hit = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return reduce(lambda acc, r: F.when(hit(r[1]), r[0]).otherwise(acc), reversed(rules), F.lit(default))


def tag(text: Column | str, tags: Mapping[str, Sequence[str]], n: int = 3) -> Column:
    """The first n tags, in dictionary order, of which any keyword stands in the text."""
    low = F.lower(_c(text))
    each = [F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), F.lit(name)) for name, words in tags.items()]
    return F.slice(F.array_compact(F.array(*each)), 1, n)


#: Delimiters that pair up around a span in one line; underscores only at the edges of words.
PAIRED = ("***", "**", "*", "___", "__", "_", "~~", "`")


def paired(delimiters: Sequence[str] = PAIRED) -> tuple[str, int]:
    """One pattern for a span between equal delimiters that doesn't hold their character, and its number of groups, of which one is the span."""
    edge = lambda d: r"\b" if d[0] == "_" else ""
    return "|".join(f"{edge(d)}{re.escape(d)}([^{d[0]}\\n]+){re.escape(d)}{edge(d)}" for d in delimiters), len(delimiters)


#: What a line can begin with: quote marks, then a heading, a rule over the whole line, or a list mark.
QUOTE, HEADING, RULE, ITEM = r"^(?:>[ \t]?)+", r"^#{1,6}[ \t]+", r"^(?:-{3,}|\*{3,}|_{3,})[ \t]*$", r"^[ \t]*[-*+][ \t]+"


def strip_markdown(c: Column | str) -> Column:
    """The text without quote marks, headings' marks, rules and paired delimiters (also one pair within another); list marks become "- ", more than one empty line becomes one."""
    pattern, groups = paired()
    span = "".join(f"${k + 1}" for k in range(groups))

    def line(x: Column) -> Column:
        own = F.regexp_replace(x, QUOTE, "")
        return F.when(own.rlike(RULE), "").when(own.rlike(HEADING), F.regexp_replace(own, HEADING, "")).otherwise(F.regexp_replace(own, ITEM, "- "))

    lines = F.array_join(F.transform(F.split(_c(c), "\n"), line), "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(lines, pattern, span), pattern, span), r"\n{3,}", "\n\n"))


REFERENCE = r"^\s*(.+?)\s+(\d+):(\d+)(?:-(\d+))?\s*$"


def parse_ref(c: Column | str) -> Column:
    """'Book c:v[-w]' as (book, chapter, lo, hi); null where it is none. hi is lo without a range."""
    part = lambda k: F.nullif(F.regexp_extract(_c(c), REFERENCE, k), F.lit(""))
    n = lambda k: F.try_cast(part(k), "int") if hasattr(F, "try_cast") else part(k).try_cast("int")
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("book"), n(2).alias("chapter"), n(3).alias("lo"), F.coalesce(n(4), n(3)).alias("hi")))


def ref_variants(book: Column, chapter: Column, verse: Column, short: Column) -> Column:
    """Spellings of a reference: long and short name, with and without a space."""
    rest = F.concat(chapter.cast("string"), F.lit(":"), verse.cast("string"))
    return F.array_distinct(F.array_compact(F.array(*[F.concat(n, F.lit(sep), rest) for n in (book, short) for sep in (" ", "")])))


def convert_code(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """'Abc.1.2' or 'Abc.1.2-Abc.1.4' in the other code system ('Xyz 1:2', 'Xyz 1:2-4'); null where the code is unknown."""
    names = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    a, b = F.split_part(_c(c), F.lit("-"), F.lit(1)), F.nullif(F.split_part(_c(c), F.lit("-"), F.lit(2)), F.lit(""))
    part = lambda x, k: F.nullif(F.split_part(x, F.lit("."), F.lit(k)), F.lit(""))
    head = F.concat(F.element_at(names, part(a, 1)), F.lit(" "), part(a, 2), F.lit(":"), part(a, 3))
    same = (part(a, 1) == part(b, 1)) & (part(a, 2) == part(b, 2))
    return F.when(b.isNull(), head).when(same, F.concat(head, F.lit("-"), part(b, 3)))


def bucket(c: Column | str, bounds: Sequence[tuple[float, str]], default: str) -> Column:
    """The label of the first bound that the value reaches; bounds from high to low."""
    return reduce(lambda acc, b: F.when(_c(c) >= b[0], b[1]).otherwise(acc), reversed(bounds), F.lit(default))


def clamp_norm(c: Column | str, most: float = 300) -> Column:
    return F.round(F.least(_c(c), F.lit(most)) / most, 2)


def extract_mentions(c: Column | str, patterns: Sequence[str]) -> Column:
    """Distinct matches of all patterns, pattern by pattern."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(_c(c), F.lit(p), F.lit(0)) for p in patterns])))


def correct_regex(c: Column | str, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The text after all rules in order, and a log 'found -> to' of the first match of each that changed something."""
    out, log = _c(c), []
    for pattern, to in rules:
        found = F.nullif(F.regexp_extract(out, pattern, 0), F.lit(""))
        log.append(F.when(found.isNotNull(), F.concat(found, F.lit(" -> "), F.lit(to))))
        out = F.regexp_replace(out, pattern, to)
    return out, F.array_compact(F.array(*log))


def validation_score(text: Column | str, issues: Column) -> Column:
    """1 - issues * 50 / length, between 0 and 1."""
    n = F.length(_c(text))
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - issues * 50.0 / n))).otherwise(F.lit(0.0))


def bad_numbers(c: Column | str) -> Column:
    """Numbers of more than nine digits, and dates m/d with an impossible month or day."""
    long = F.regexp_extract_all(_c(c), F.lit(r"\d{10,}"), F.lit(0))
    dates = F.filter(F.regexp_extract_all(_c(c), F.lit(r"\b\d{1,2}/\d{1,2}\b"), F.lit(0)), lambda x: (F.split_part(x, F.lit("/"), F.lit(1)).cast("int") > 12) | (F.split_part(x, F.lit("/"), F.lit(2)).cast("int") > 31) | (F.split_part(x, F.lit("/"), F.lit(1)).cast("int") == 0))
    return F.concat(long, dates)


def ending(c: Column | str) -> Column:
    """reporter (a by-line ends the text), continued (it asks to read on, or stops in mid-sentence), normal, unknown."""
    t = F.trim(_c(c))
    return (
        F.when(t.rlike(r"(?i)(reporter|by [A-Z]\w+)[ .]*$"), "reporter")
        .when(t.rlike(r"(?i)(continued|to be continued)[ .]*$|[,;:-]$"), "continued")
        .when(t.rlike(r"[.!?]$"), "normal")
        .otherwise("unknown")
    )


def spoken(c: Column | str, pause: bool = False) -> Column:
    """For reading aloud: no symbols beyond the basic plane, 'c:v' in words, 'author - title' as 'author in the book title', white space squeezed; pause: a line break behind each sentence."""
    out = F.regexp_replace(_c(c), r"[\x{10000}-\x{10FFFF}☀-➿]", "")
    out = F.regexp_replace(out, r"(\d+):(\d+)-(\d+)", "chapter $1 verses $2 to $3")
    out = F.regexp_replace(out, r"(\d+):(\d+)", "chapter $1 verse $2")
    out = F.regexp_replace(out, r"(\p{L}{2})[ \t\r\n]+[-–—][ \t\r\n]+(\p{L})", "$1 in the book $2")
    out = F.regexp_replace(out, r"[ \t\r\n]+", " ")
    return F.trim(F.regexp_replace(out, r"\. ", ".\n") if pause else out)


def fmt_time(seconds: Column | str) -> Column:
    """mm:ss, from an hour on hh:mm:ss."""
    s = F.floor(_c(seconds)).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.concat_ws(":", two(h), two(m), two(r))).otherwise(F.concat_ws(":", two(m), two(r)))


def parse_time(c: Column | str) -> Column:
    """Seconds of mm:ss or hh:mm:ss; null for anything else."""
    parts = F.transform(F.split(_c(c), ":"), lambda x: x.try_cast("long"))
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 60 + x)
    return F.when(_c(c).rlike(r"^\d+:\d{2}(:\d{2})?$"), value)


def url_id(c: Column | str, patterns: Sequence[str]) -> Column:
    """The first group of the first pattern that matches."""
    return F.coalesce(*[F.nullif(F.regexp_extract(_c(c), p, 1), F.lit("")) for p in patterns])


ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)"


def origin(url: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(url), ORIGIN, 1), F.lit(""))


def host(url: Column | str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def resolve_url(link: Column | str, base: Column | str) -> Column:
    """An absolute URL without fragment; null for mail, phone and script links and for fragments alone."""
    folder = F.regexp_replace(F.regexp_replace(_c(base), r"[?#].*$", ""), r"(://[^/]+)(/.*?)?[^/]*$", "$1$2")
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    scheme = F.regexp_extract(_c(base), r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    whole = lambda u: (
        F.when((u == "") | u.rlike(r"(?i)^(javascript|mailto|tel|data):"), F.lit(None))
        .when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), u)
        .when(u.startswith("//"), F.concat(scheme, u))
        .when(u.startswith("/"), F.concat(origin(base), u))
        .otherwise(F.concat(folder, u))
    )
    # a lambda's variable is computed once, a column's expression in each branch
    return F.get(F.transform(F.array(F.regexp_replace(F.trim(_c(link)), r"#.*$", "")), whole), 0)


def same_host(url: Column | str, base: Column | str) -> Column:
    bare = lambda h: F.regexp_replace(h, r"^www\.", "")
    return bare(host(url)) == bare(host(base))


def with_page(url: Column | str, page: Column, name: str = "page") -> Column:
    """The URL with a page parameter, replaced where there is one; a fragment stays behind it."""
    u, p, fragment = F.regexp_replace(_c(url), "#.*$", ""), page.cast("string"), F.regexp_extract(_c(url), "#.*$", 0)
    has = u.rlike(rf"[?&]{name}=")
    paged = F.when(has, F.regexp_replace(u, F.lit(rf"([?&]{name}=)[^&]*"), F.concat(F.lit("$1"), p))).otherwise(F.concat(u, F.when(F.contains(u, F.lit("?")), "&").otherwise("?"), F.lit(f"{name}="), p))
    return F.concat(paged, fragment)


def content_hash(c: Column | str) -> Column:
    return F.sha2(_c(c), 256)


def label(c: Column | str, mapping: Mapping[str, str], default: Column | None = None) -> Column:
    found = F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), _c(c).cast("string"))
    return F.coalesce(found, default if default is not None else _c(c).cast("string"))


def fold_pack(parts: Column, size: int, sep: str, least: int = 0) -> Column:
    """Packs strings in order into pieces of at most `size` characters (a longer part is a piece of its own); pieces of up to `least` characters go."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        joined = F.when(acc["open"] == "", x).otherwise(F.concat(acc["open"], F.lit(sep), x))
        fits = (F.length(joined) <= size) | (acc["open"] == "")
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), F.when(fits, joined).otherwise(x).alias("open"))

    out = F.aggregate(parts, empty, step, lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))
    return F.filter(out, lambda x: F.length(x) > least) if least else out
