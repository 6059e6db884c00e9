"""Filters, joins, aggregates, order-dependent operators and set operations on any tables.

All take DataFrames and column names and give a lazy DataFrame. Ties are always broken by a key, so results are stable.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir

# --- filters ------------------------------------------------------------------------------------------------------

_COMPARE = {
    "eq": lambda c, v: c == v,
    "neq": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)),
    "is_null": lambda c, v: c.isNull() if v else c.isNotNull(),
}


def where(df: DataFrame, *conditions: tuple[str, str, object]) -> DataFrame:
    """Chained comparisons (column, operator, value)."""
    return reduce(lambda d, c: d.filter(_COMPARE[c[1]](F.col(c[0]), c[2])), conditions, df)


def where_given(df: DataFrame, **equal: object) -> DataFrame:
    """Equality filters for the arguments that are given; None sets no filter."""
    return where(df, *[(k, "eq", v) for k, v in equal.items() if v is not None])


def where_default(df: DataFrame, column: str, value: object, default: object) -> DataFrame:
    """Rows of a version; a null column means the default version."""
    return df.filter(F.coalesce(F.col(column), F.lit(default)) == F.lit(value))


def contains_any(df: DataFrame, columns: Sequence[str], text: str, limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Case-insensitive substring in any of the columns; with a limit, the first rows by `order`."""
    found = df.filter(reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), F.lit(text.lower())) for c in columns]))
    return found.orderBy(*order).limit(limit) if limit else found


def has_alias(df: DataFrame, array: str, value: str) -> DataFrame:
    return df.filter(F.array_contains(array, value))


def since_months(df: DataFrame, column: str, months: int | None, now: str, fmt: str = "yyyyMMdd") -> DataFrame:
    """Rows whose date string lies within `months` of now; unparseable ones drop out. None keeps all."""
    if months is None:
        return df
    return df.filter(F.try_to_timestamp(F.col(column), F.lit(fmt)) >= F.add_months(F.to_date(F.lit(now)), -months))


def overlapping(segments: DataFrame, key: str, start: str, end: str, text: str, a: float, b: float) -> DataFrame:
    """Texts of the segments that overlap [a, b), in order, per key; `until` is the largest end, at most b."""
    s, e = F.col(start), F.col(end)
    hit = ((s >= a) & (s < b)) | ((e > a) & (e <= b)) | ((s <= a) & (e >= b))
    found = segments.filter(hit)
    return found.groupBy(key).agg(string_ordered(text, [start, end, text], " ").alias("text"), F.count("*").alias("segments"), F.least(F.max(end), F.lit(b)).alias("until"))


def contained(segments: DataFrame, start: str, end: str, a: float, b: float) -> DataFrame:
    return segments.filter((F.col(start) >= a) & (F.col(end) <= b))


def between_either(df: DataFrame, column: str, a: int, b: int) -> DataFrame:
    """a..b in either order."""
    return df.filter(F.col(column).between(min(a, b), max(a, b)))


def without(df: DataFrame, column: str, sentinels: Sequence[object]) -> DataFrame:
    return df.filter(~F.col(column).isin(list(sentinels)))


def first_nonempty(*columns: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns])


# --- joins --------------------------------------------------------------------------------------------------------


def full_outer_scores(a: DataFrame, b: DataFrame, key: str, score_a: str, score_b: str) -> DataFrame:
    """Two candidate lists as one, missing scores 0."""
    return a.join(b, key, "full_outer").select(key, F.coalesce(score_a, F.lit(0.0)).alias(score_a), F.coalesce(score_b, F.lit(0.0)).alias(score_b))


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Each edge once in both directions; other columns as they are."""
    back = edges.withColumns({src: F.col(dst), dst: F.col(src)})
    return edges.unionByName(back)


def both_ends_in(edges: DataFrame, nodes: DataFrame, node: str = "id", src: str = "src", dst: str = "dst") -> DataFrame:
    ids = nodes.select(node).distinct()
    return edges.join(ids.withColumnRenamed(node, src), src, "left_semi").join(ids.withColumnRenamed(node, dst), dst, "left_semi")


def processed_or_pending(items: DataFrame, key: str, *done: DataFrame) -> DataFrame:
    """items with `processed`: whether any of the sources has the key."""
    keys = reduce(DataFrame.unionByName, [d.select(key) for d in done]).distinct().withColumn("processed", F.lit(True))
    return items.join(keys, key, "left").withColumn("processed", F.coalesce("processed", F.lit(False)))


def lookup_first(items: DataFrame, key: str, value: str, *sources: DataFrame) -> DataFrame:
    """value from the first source that has the key, and its number."""
    out = items
    for k, s in enumerate(sources):
        out = out.join(s.select(key, F.col(value).alias(f"_{k}")), key, "left")
    names = [f"_{k}" for k in range(len(sources))]
    which = reduce(lambda acc, k: F.when(F.col(names[k]).isNotNull(), k).otherwise(acc), reversed(range(len(names))), F.lit(None))
    return out.withColumn(value, F.coalesce(*names)).withColumn("source_no", which.cast("int")).drop(*names)


def range_concat(refs: DataFrame, units: DataFrame, key: str, lo: str, hi: str, no: str, text: str, sep: str = " ") -> DataFrame:
    """refs (key, lo, hi) with the texts of units lo..hi of the key, labelled and in order. Refs without units drop out."""
    joined = refs.join(units.select(F.col(key), F.col(no).alias("_no"), F.col(text).alias("_text")), key).filter(F.col("_no").between(F.col(lo), F.col(hi)))
    label = F.format_string("[%d] %s", "_no", "_text")
    return joined.groupBy(key, lo, hi).agg(string_ordered(label, ["_no", "_text"], sep).alias("text"), F.count("*").alias("units"))


def latest_child(parents: DataFrame, children: DataFrame, key: str, ts: str, value: str, tie: str, condition: Column) -> DataFrame:
    """All parents, with the value and time of their latest child that fulfils the condition."""
    last = children.filter(condition).groupBy(key).agg(F.max_by(F.struct(value, ts), F.struct(ts, tie)).alias("_last"))
    return parents.join(last, key, "left").select(*parents.columns, F.col(f"_last.{value}").alias(value), F.col(f"_last.{ts}").alias(ts))


#: Members of an event that are paired in one task, roughly; more are dealt over blocks, and pairs of blocks are joined.
MEMBERS = 1024
#: Rows of a task where rows are few bytes, so that partitions by bytes would hold too many; tasks at most.
PER_TASK, TASKS = 1 << 19, 1 << 14


def parts_of(rows: float) -> int:
    """How many partitions so many narrow rows are dealt over."""
    return int(min(TASKS, max(1, -(-rows // PER_TASK))))


def coparticipants(bridge: DataFrame, member: str, event: str) -> DataFrame:
    """Distinct pairs of members that share an event, in both directions. Each event gives a pair once, and a hot event's pairs of blocks are keys of their own."""
    rows = bridge.select(F.col(event).alias("event"), F.col(member).alias("m")).filter("event is not null and m is not null")
    total = rows.groupBy("event").agg(F.count("*").cast("double").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).first()
    few, many = parts_of(total[0]), parts_of(total[0] + total[1])
    rows = rows.repartition(few, "event").distinct()
    blocks = rows.groupBy("event").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "event").withColumn("block", F.pmod(F.xxhash64("m"), F.col("blocks")).cast("int"))
    a = dealt.select("event", F.col("m").alias("a"), F.col("block").alias("low"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("high"))
    b = dealt.select("event", F.col("m").alias("b"), F.explode(F.sequence(F.lit(0), "block")).alias("low"), F.col("block").alias("high"))
    key = ["event", "low", "high"]
    pairs = a.repartition(many, *key).join(b.repartition(many, *key), key).filter("low < high or a < b")
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).repartition(many, "a", "b").distinct()
    return once.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))


def even_join(a: DataFrame, b: DataFrame, key: str, id: str) -> DataFrame:
    """a join b on the key, in tasks of about PER_TASK rows of the result: a key's rows of b are dealt by a hash of `id`, its rows of a copied to each part."""
    count = lambda df, name: df.groupBy(key).agg(F.count("*").cast("double").alias(name))
    sizes = count(a, "_a").join(count(b, "_b"), key).select(key, (F.col("_a") * F.col("_b")).alias("_rows"))
    parts = parts_of(sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0.0))).first()[0] + 1)
    salts = sizes.select(key, F.ceil(F.col("_rows") / PER_TASK).cast("int").alias("_salts"))
    left = a.join(salts, key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    right = b.join(salts, key).withColumn("_salt", F.pmod(F.xxhash64(id), F.col("_salts")).cast("int")).drop("_salts")
    return left.repartition(parts, key, "_salt").join(right.repartition(parts, key, "_salt"), [key, "_salt"]).drop("_salt")


#: Words up to this length are found by deletion variants, longer ones by segments.
SHORT = 24


def nearest_name(names: DataFrame, name: str, vocabulary: DataFrame, word: str, distance: int = 2) -> DataFrame:
    """The vocabulary's word with the smallest edit distance up to `distance`, exact ones first, then by word.

    Candidates come from equi-joins, not from a product, and their number of rows a string doesn't grow with its length: see
    close_pairs(). All candidates are compared exactly.
    """
    n = names.select(F.col(name).alias("name")).distinct()
    v = vocabulary.select(F.col(word).alias("word")).distinct()
    pairs = close_pairs(n, v, distance).withColumn("distance", F.levenshtein("name", "word", distance)).filter("distance >= 0")
    return pairs.groupBy("name").agg(F.min(F.struct("distance", "word")).alias("m")).select("name", F.col("m.word").alias("word"), F.col("m.distance").alias("distance"))


def close_pairs(names: DataFrame, words: DataFrame, distance: int) -> DataFrame:
    """name, word: every pair within the edit distance, and some others.

    Words up to SHORT: two strings within d edits have a common string under d deletions each. Longer words are cut into d + 1
    segments, one of which d edits leave whole, at most d places away; names look for each segment of each length in question.
    """
    d, size = distance, lambda c: F.length(c)
    variants = lambda df, c, most: df.filter(size(c) <= most).select(c, F.explode(deletions(F.col(c), d)).alias("variant"))
    few = variants(names, "name", SHORT + d).join(variants(words, "word", SHORT), "variant").select("name", "word")
    each = lambda df, **of: reduce(lambda x, kv: x.withColumn(kv[0], F.explode(F.array(*map(F.lit, kv[1])))), of.items(), df)
    spread = range(-d, d + 1)
    base, plain = F.floor(F.col("size") / (d + 1)).cast("int"), d + 1 - F.col("size") % (d + 1)  # the first `plain` segments have the base length, the others one more
    start, length = F.col("i") * base + F.greatest(F.col("i") - plain, F.lit(0)), base + (F.col("i") >= plain).cast("int")
    long = each(words.filter(size("word") > SHORT).withColumn("size", size("word")), i=range(d + 1))
    long = long.select("word", "size", "i", F.xxhash64(F.substring("word", start + 1, length)).alias("segment"))
    asked = each(names, more=spread, i=range(d + 1), shift=spread).withColumn("size", size("name") + F.col("more")).filter(F.col("size") > SHORT)
    asked = asked.withColumn("at", start + F.col("shift")).filter((F.col("at") >= 0) & (F.col("at") + length <= size("name")))
    asked = asked.select("name", "size", "i", F.xxhash64(F.substring("name", F.col("at") + 1, length)).alias("segment")).distinct()
    return few.unionByName(asked.join(long, ["size", "i", "segment"]).select("name", "word")).distinct()


def deletions(text: Column, distance: int) -> Column:
    """The text and all that is left of it after up to `distance` deletions."""
    drop = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    out = F.array(text)
    for _ in range(distance):
        longer = F.filter(out, lambda t: F.length(t) > 0)
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(longer, drop))))
    return out


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased text, padded with two spaces before and one behind."""
    t = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3))))


def similar_by_trigram(names: DataFrame, name: str, queries: DataFrame, query: str, least: float = 0.5, k: int = 5) -> DataFrame:
    """For each query the k names with the greatest trigram similarity above `least`."""
    pairs = trigram_candidates(names, name, queries, query, least)
    shared = F.size(F.array_intersect("q", "g"))
    found = pairs.withColumn("similarity", shared / (F.size("q") + F.size("g") - shared)).filter(F.col("similarity") > least)
    return topk_per(found.select("query", "name", "similarity"), ["query"], [F.desc("similarity"), F.asc("name")], k)


def trigram_candidates(names: DataFrame, name: str, queries: DataFrame, query: str, least: float) -> DataFrame:
    """query, name and their trigrams q and g: all pairs above the similarity, and some others.

    Such pairs share one of their rarest trigrams: those that are left when as many as the similarity asks for are taken from
    the frequent end. So common trigrams join nothing, and texts of too different a size aren't paired.
    """
    n = names.select(F.col(name).alias("name")).filter("name is not null").distinct().withColumn("g", trigrams(F.col("name")))
    q = queries.select(F.col(query).alias("query")).filter("query is not null").distinct().withColumn("q", trigrams(F.col("query")))
    often = n.select(F.explode("g").alias("t")).groupBy("t").agg(F.count("*").alias("often"))

    def rarest(df: DataFrame, own: str, grams: str) -> DataFrame:
        each = df.select(own, F.size(grams).alias("n"), F.explode(grams).alias("t")).join(often, "t", "left")
        order = F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "t")))
        kept = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1
        rows = each.groupBy(own, "n").agg(order.alias("o")).select(own, "n", F.explode(F.slice("o", F.lit(1), F.least(kept, F.col("n")).cast("int"))).alias("o"))
        return rows.select(own, F.col("n").alias(f"n_{own}"), F.col("o.t").alias("t"))

    both = rarest(q, "query", "q").join(rarest(n, "name", "g"), "t")
    sized = both.filter((F.col("n_name") >= F.col("n_query") * least) & (F.col("n_query") >= F.col("n_name") * least))
    return sized.select("query", "name").distinct().join(q, "query").join(n, "name")


# --- aggregates ---------------------------------------------------------------------------------------------------


def string_ordered(value: Column | str, order: Sequence[str], sep: str) -> Column:
    """Ordered string aggregate."""
    value = F.col(value) if isinstance(value, str) else value
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"o{k}") for k, o in enumerate(order)], value.alias("_v"))))
    return F.array_join(F.transform(rows, lambda r: r["_v"]), sep)


def completion(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """total, done, pending and percent of non-null values per key; percent is null for no rows."""
    out = df.groupBy(*keys).agg(F.count("*").alias("total"), F.count(column).alias("done"))
    return out.withColumn("pending", F.col("total") - F.col("done")).withColumn("percent", F.round(100.0 * F.col("done") / F.nullif(F.col("total"), F.lit(0)), 2))


def status_counts(df: DataFrame, status: str, values: Sequence[str]) -> DataFrame:
    """One row: the total and a count for each status, 0 where there is none."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == v).alias(v) for v in values])


def child_counts(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """parents with the number of rows of each child table; children are counted before the join."""
    for name, child in children.items():
        parents = parents.join(child.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return parents


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def length_stats(df: DataFrame, text: str, short: int = 100, long: int = 3000) -> DataFrame:
    n = F.length(text)
    return df.agg(F.count(text).alias("n"), F.round(F.avg(n), 6).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"), F.count_if(n < short).alias("short"), F.count_if(n > long).alias("long"))


def duplicates(df: DataFrame, key: str, member: str) -> DataFrame:
    """Groups of more than one row: their size, members in order, and how many are too many."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(member)), lambda x: x.cast("string")), ",").alias("members")).filter("n > 1").withColumn("surplus", F.col("n") - 1)


# --- order-dependent ----------------------------------------------------------------------------------------------


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    return topk_per(df, keys, order, 1)


def topk_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of each key; Spark keeps k rows a key before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_no", F.row_number().over(w)).filter(F.col("_no") <= k).drop("_no")


def ranked(df: DataFrame, score: str, key: str, name: str = "rank") -> DataFrame:
    """Rows numbered from the greatest score on, ties by key (nulls last, smallest key first).

    Ranges of rows are sorted and numbered in tasks of their own, and each adds the rows of the ranges before it: no window
    holds the table or a common score; the one over all ranges has a row for each task.
    """
    path = f"{shared_dir(df.sparkSession)}/ranked-{uuid.uuid4().hex}"
    order = [F.col(score).desc_nulls_last(), F.col(key).asc_nulls_last()]
    sorted_ = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    sorted_.write.parquet(path)
    rows = df.sparkSession.read.schema(sorted_.schema).parquet(path)
    counts = rows.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = counts.select("_range", (F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).alias("_before"))
    own = rows.withColumn("_no", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return own.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_no")).drop("_before", "_no", "_range")


def mark_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "keep") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def capped_union(df: DataFrame, group: str, key: str, order: Sequence[Column | str], total: int) -> DataFrame:
    """At most ceil(total / groups) rows a group, each key once (first group wins), then at most `total` rows."""
    groups = df.select(group).distinct().agg(F.count("*").alias("_groups"))
    w = Window.partitionBy(group).orderBy(*order)
    capped = df.withColumn("_no", F.row_number().over(w)).crossJoin(F.broadcast(groups)).filter(F.col("_no") <= F.ceil(F.lit(total) / F.col("_groups")))
    once = first_per(capped.drop("_groups"), [key], [group, "_no"])
    return once.orderBy(group, "_no", key).limit(total).drop("_no")


def rebase(segments: DataFrame, group: str, piece: str, idx: str, start: str, end: str, seconds: float) -> DataFrame:
    """Segments of consecutive pieces of each group on one time line: piece i is shifted by i * seconds, ids are counted anew from 0."""
    no = F.row_number().over(Window.partitionBy(group).orderBy(piece, idx)) - 1
    shift = F.col(piece) * seconds
    return segments.select(group, no.cast("long").alias("no"), piece, idx, (shift + F.col(start)).alias("start_at"), (shift + F.col(end)).alias("end_at"))


def merge_transcripts(segments: DataFrame, group: str, piece: str, idx: str, end: str, text: str, seconds: float) -> DataFrame:
    """Each group's pieces as one: the text joined in order, the number of segments and the duration (the latest end of a shifted piece)."""
    return segments.groupBy(group).agg(string_ordered(text, [piece, idx], " ").alias(text), F.count("*").alias("segments"), F.max(F.col(piece) * seconds + F.col(end)).alias("duration"))


def islands(df: DataFrame, keys: Sequence[str], order: str, begins: Column, name: str = "island") -> DataFrame:
    """Numbers the runs of rows that each begin where `begins` holds (the first row always does)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(name, F.sum(F.when(begins | (F.row_number().over(w) == 1), 1).otherwise(0)).over(w))


def merge_short(df: DataFrame, key: str, order: str, text: str, n: int = 200, sep: str = "\n") -> DataFrame:
    """Rows with fewer than n characters join the row before."""
    return islands(df, [key], order, F.length(text) >= n).groupBy(key, "island").agg(F.min(order).alias(order), string_ordered(text, [order], sep).alias(text), F.count("*").alias("parts"))


def merge_continued(df: DataFrame, keys: Sequence[str], order: str, begins: Column, text: str, sep: str = "\n\n", mark: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Pages that go on where the one before ends, as one row: keys, island, first and last page, pages, text, and the last page's columns of `carry`.

    A mark stands between pages, with `sep` on both sides: where it goes on can be seen in the text.
    """
    runs = islands(df, keys, order, begins).groupBy(*keys, "island")
    sep = f"{sep}{mark}{sep}" if mark else sep
    return runs.agg(*[F.max_by(c, order).alias(c) for c in carry], F.min(order).alias(f"first_{order}"), F.max(order).alias(f"last_{order}"), F.count("*").alias("pages"), string_ordered(text, [order], sep).alias(text))


def detect_boundary(df: DataFrame, key: str, idx: str, a: Column, b: Column, c: Column, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Per key: last row with a; first later row with b (start); first later row with c (end). Where one is missing, floor(n * low) and floor(n * high)."""
    rows = df.select(key, F.col(idx).alias("_i"), a.alias("_a"), b.alias("_b"), c.alias("_c"))
    w = Window.partitionBy(key)
    rows = rows.withColumn("_la", F.coalesce(F.max(F.when(F.col("_a"), F.col("_i"))).over(w), F.lit(-1)))
    rows = rows.withColumn("_s", F.min(F.when(F.col("_b") & (F.col("_i") > F.col("_la")), F.col("_i"))).over(w))
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.first("_s").alias("_s"), F.min(F.when(F.col("_c") & (F.col("_i") > F.col("_s")), F.col("_i"))).alias("_e"))
    found = F.col("_s").isNotNull() & F.col("_e").isNotNull()
    part = lambda x: F.floor(F.col("n") * x)
    return out.select(key, F.when(found, F.col("_s")).otherwise(part(low)).cast("long").alias("start_idx"), F.when(found, F.col("_e")).otherwise(part(high)).cast("long").alias("end_idx"), found.alias("detected"))


def last_turns(df: DataFrame, conversation: str, turn: str, n: int = 10) -> DataFrame:
    return topk_per(df, [conversation], [F.desc(turn)], n)


# --- sorts --------------------------------------------------------------------------------------------------------


def ranked_lookup(df: DataFrame, column: str, text: str, score: str, key: str, k: int = 50) -> DataFrame:
    """Rows that contain the text: equal ones first, then those that begin with it, then by score."""
    c, q = F.lower(F.col(column)), text.lower()
    quality = F.when(c == q, 0).when(c.startswith(q), 1).otherwise(2)
    return df.filter(F.contains(c, F.lit(q))).withColumn("match", quality).orderBy("match", F.desc(score), key).limit(k)


def top(df: DataFrame, order: Sequence[Column | str], k: int, condition: Column | None = None) -> DataFrame:
    return (df.filter(condition) if condition is not None else df).orderBy(*order).limit(k)


def overfetch(df: DataFrame, order: Sequence[Column | str], condition: Column, k: int, factor: int = 3, compat: bool = False) -> DataFrame:
    """The first k rows that fulfil the condition; compat looks at the first factor * k rows only."""
    rows = df.orderBy(*order).limit(k * factor) if compat else df
    return rows.filter(condition).orderBy(*order).limit(k)


# --- sets ---------------------------------------------------------------------------------------------------------


def tagged_union(name: str, parts: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [d.withColumn(name, F.lit(tag)) for tag, d in parts.items()])


def union_first(keys: Sequence[str], order: Sequence[str], *parts: DataFrame) -> DataFrame:
    """Union in which the first part that has a key wins."""
    rows = reduce(DataFrame.unionByName, [d.withColumn("_part", F.lit(k)) for k, d in enumerate(parts)])
    return first_per(rows, keys, ["_part", *order]).drop("_part")


def new_only(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key).distinct(), key, "left_anti")
