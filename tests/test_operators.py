"""Operators on hand-made rows: what SQL can't say, properties, and odd input."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import chunking as C
from lodestone.operators import graph as G
from lodestone.operators import relational as R
from lodestone.operators import retrieval as H
from lodestone.operators import vector as V
from lodestone.sources import html, html_tree, nested, sinks
from lodestone.streaming import ingest as K


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- graphs -------------------------------------------------------------------------------------------------------


def test_bfs_gives_shortest_depths(spark):
    rnd = random.Random(3)
    pairs = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(60)}
    edges = spark.createDataFrame([(a, b, 1, 0.5) for a, b in pairs if a != b], "src long, dst long, type int, strength double")
    got = {r["id"]: r["depth"] for r in G.bfs(edges, spark.createDataFrame([(0,)], "id long"), 4, None).collect()}
    want, frontier = {0: 0}, {0}
    for d in range(1, 5):
        frontier = {y for x in frontier for a, b in pairs if a != b for y in ((b,) if a == x else (a,) if b == x else ())} - set(want)
        want |= {x: d for x in frontier}
    assert got == want


def test_nest_makes_orphans_roots(spark):
    df = spark.createDataFrame([("a", None, "A", 1), ("b", "a", "B", 2), ("c", "b", "C", 1), ("d", "zz", "D", 1), ("e", "a", "E", 1)], "id string, parent string, name string, ord int")
    assert rows(G.nest(df, "id", "parent", "name", "ord")) == [("a", "A(E,B(C))"), ("d", "D")]


# --- chunkers -----------------------------------------------------------------------------------------------------


def test_windows_cover_the_text(spark):
    text = "".join(random.Random(1).choice("abc ") for _ in range(2345))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x" * 500), (5, "y" * 501)], "id int, text string")
    got = {}
    for r in C.chunk_windows(df, "id", "text").orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append((r["start_char"], r["text"]))
    assert "".join(t if s == 0 else t[100:] for s, t in got[1]) == text
    assert 2 not in got and 3 not in got and len(got[4]) == 1 and [s for s, _ in got[5]] == [0, 400]


def test_sentence_cuts():
    text = " ".join(f"Sentence number {i} is here." for i in range(60))
    pieces = C.sentence_cuts(text)
    assert all(len(p) <= 500 for p in pieces) and all(p.endswith(".") for p in pieces)
    assert pieces[0].startswith("Sentence number 0") and pieces[-1].endswith("59 is here.")
    assert all(p in text for p in pieces)
    assert C.sentence_cuts("") == [] and C.sentence_cuts("short") == ["short"]
    assert len(C.sentence_cuts("z" * 1200)) == 3
    assert C.sentence_cuts("a" * 60 + "|" + "b" * 60, 100, 0, boundaries=r"\|") == ["a" * 60 + "|", "b" * 60]


def test_period_cuts_drop_short_pieces():
    assert C.period_cuts("x" * 50) == [] and C.period_cuts("x" * 51) == ["x" * 51]
    assert C.period_cuts("a" * 300 + "." + "b" * 400)[0] == "a" * 300 + "."


def test_packers(spark):
    df = spark.createDataFrame([(1, "One is here. Two is here. " * 40), (2, "tiny."), (3, None)], "id int, text string")
    packed = [r["text"] for r in C.pack_sentences(df, "id", "text", 100, 10).filter("id = 1").collect()]
    assert all(len(p) <= 100 for p in packed) and " ".join(packed) == ("One is here. Two is here. " * 40).strip()
    assert C.pack_sentences(df, "id", "text").filter("id = 2").count() == 0
    assert [r["text"] for r in C.pack_paragraphs(df, "id", "text").filter("id = 2").collect()] == ["tiny."]


def test_segments_keep_words_and_times(spark):
    df = spark.createDataFrame([("v", i, 30.0 * i, 30.0 * i + 20, f"word{i} " * 20) for i in range(12)], "k string, no int, s double, e double, t string")
    got = C.pack_segments(df, "k", "no", "s", "e", "t").orderBy("chunk_index").collect()
    assert all(len(r["text"]) <= 500 + 80 for r in got) and got[0]["start_s"] == 0 and got[-1]["end_s"] == 350
    assert got[1]["text"].split()[:10] == got[0]["text"].split()[-10:]


def test_reassemble_undoes_windows(spark):
    rnd = random.Random(8)
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(400))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert C.reassemble(C.chunk_windows(df, "id", "text"), "id", "chunk_index", "text").first()["text"] == text


def test_boundary_of_a_timeline(spark):
    """Opening, then a talk's first and last words; without them 20 % and 80 %."""
    words = ["hymn", "prayer", "talk begins", "text", "text", "text", "closing hymn", "end"]
    df = spark.createDataFrame([("a", i, w) for i, w in enumerate(words)] + [("b", i, "text") for i in range(10)], "k string, i int, t string")
    c = lambda w: F.contains("t", F.lit(w))
    got = {r["k"]: r for r in R.detect_boundary(df, "k", "i", c("prayer"), c("begins"), c("closing")).collect()}
    assert (got["a"]["start_idx"], got["a"]["end_idx"], got["a"]["detected"]) == (2, 6, True)
    assert (got["b"]["start_idx"], got["b"]["end_idx"], got["b"]["detected"]) == (2, 8, False)


# --- retrieval ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")


def test_hybrid_without_keywords_is_vector_order(spark, vectors):
    df = vectors.withColumn("text", F.lit("the text"))
    q = vectors.filter("id < 3").select(F.col("id").alias("query_id"), F.lit("absent").alias("text"), "embedding")
    a = rows(H.hybrid(df, q, 5, 1.0, 0.0).select("query_id", "id"))
    assert a == rows(V.vector_topk_batch(vectors, vectors.filter("id < 3"), 5).select("query_id", "id"))


def test_zero_vectors_have_no_similarity(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None)], "id long, embedding array<double>")
    assert rows(V.vector_topk(df, [1.0, 0.0]).select("id")) == [(2,)]
    assert rows(V.vector_topk_batch(df, df.filter("id = 2"), 5).select("id")) == [(2,)]


# --- functions ----------------------------------------------------------------------------------------------------


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("s, text", [(59, "00:59"), (61, "01:01"), (3600, "01:00:00"), (0, "00:00")])
def test_times(spark, s, text):
    assert one(spark, X.fmt_time("s"), s=s) == text and one(spark, X.parse_time("t"), t=text) == s
    assert one(spark, X.parse_time("t"), t="1:2:3:4") is None


@pytest.mark.parametrize(
    "link, base, want",
    [("/a", "https://h.org/x/y", "https://h.org/a"), ("b.html", "https://h.org/x/y.html", "https://h.org/x/b.html"), ("//c.org/d", "http://h.org", "http://c.org/d"), ("mailto:x@y", "http://h.org", None), ("#top", "http://h.org", None), ("https://z.org/#a", "http://h.org", "https://z.org/")],
)
def test_resolve(spark, link, base, want):
    assert one(spark, X.resolve_url("l", "b"), l=link, b=base) == want


@pytest.mark.parametrize("url", ["https://v.example/watch?v=abcdefghijk", "https://v.example/watch?x=1&v=abcdefghijk", "https://s.example/abcdefghijk", "https://v.example/embed/abcdefghijk"])
def test_one_id_from_many_urls(spark, url):
    assert one(spark, X.url_id("u", [r"[?&]v=([\w-]{11})", r"/(?:embed/)?([\w-]{11})$"]), u=url) == "abcdefghijk"


def test_references(spark):
    r = one(spark, X.parse_ref("r"), r="1 Some Book 3:4-7")
    assert (r["book"], r["chapter"], r["lo"], r["hi"]) == ("1 Some Book", 3, 4, 7)
    assert one(spark, X.parse_ref("r"), r="nothing") is None
    assert one(spark, X.convert_code("r", {"Abc": "Alpha"}), r="Abc.1.2-Abc.1.4") == "Alpha 1:2-4"
    assert one(spark, X.convert_code("r", {"Abc": "Alpha"}), r="Zzz.1.2") is None


def test_endings_and_speech(spark):
    assert [one(spark, X.ending("t"), t=t) for t in ("done.", "to be continued", "said, by Anna", "and then,", "x")] == ["normal", "continued", "reporter", "continued", "unknown"]
    assert one(spark, X.spoken("t"), t="Read  3:16-18 \U0001f600 now") == "Read chapter 3 verses 16 to 18 now"


def test_fuzzy_names_like_brute_force(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 6))) for _ in range(60)]
    names = spark.createDataFrame([(w,) for w in words[:30]], "name string")
    vocabulary = spark.createDataFrame([(w,) for w in words[30:]], "word string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = {a: min((distance(a, b), b) for b in words[30:]) for a in words[:30]}
    assert {r["name"]: (r["distance"], r["word"]) for r in R.nearest_name(names, "name", vocabulary, "word").collect()} == {a: m for a, m in want.items() if m[0] <= 2}


# --- pages --------------------------------------------------------------------------------------------------------


def test_contacts_tell_fax_from_phone(spark):
    page = spark.createDataFrame([(1, "http://h", '<p>Tel +49 30 1234567, Fax: +49 30 7654321</p><a href="mailto:a@b.de?x">m</a> 12'), (2, "u", None), (3, "u", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html.page_contacts(page).collect()}
    assert (got[1]["phones"], got[1]["faxes"], got[1]["emails"]) == ("+49 30 1234567", "+49 30 7654321", "a@b.de")


def test_navigation_depths(spark):
    menu = '<ul><li><a href="/a">A</a><ul><li><a href="/b">B</a></li><li><a href="/a">again</a></li></ul></li></ul><a href="/no">no</a>'
    got = rows(html.page_navigation(html_tree.parse(spark.createDataFrame([(1, menu), (2, None)], "page_id long, html string"), ["page_id"])))
    assert got == [(1, 0, "/a", "A", 1, None), (1, 1, "/b", "B", 2, "/a")]


def test_members_fall_back(spark):
    page = spark.createDataFrame([(1, "<i>Ann (chair)</i>")], "page_id long, html string")
    known = spark.createDataFrame([("Bo", "x")], "name string, role string")
    assert rows(html.mine_members(page, [r"<i>(\w+) \((\w+)\)</i>"], known)) == [("Bo", "x")]
    assert rows(html.mine_members(page, [r"<i>(\w+) \((\w+)\)</i>"], known, 1)) == [("Ann", "chair")]


def test_tsv_edges_drop_bad_lines(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("# head\n\na\tb\t5\na\ta\t1\na\tb\nb\ta\t-1\nb\ta\tx\na\tzz\t1\n")
    codes = spark.createDataFrame([("a", 1), ("b", 2)], "code string, id int")
    assert rows(nested.read_tsv_edges(spark, f"file://{tmp_path}/e.tsv", codes)) == [(1, 2, 5)]


@pytest.mark.parametrize("issue, month", [(433, "2020-02"), (432, "2020-01"), (431, "2019-12"), (444, "2021-01")])
def test_calendar(spark, issue, month):
    assert one(spark, nested.issue_month(F.col("i")), i=issue) == month and one(spark, nested.month_issue(F.col("m")), m=f"No. {month}") == issue


# --- state --------------------------------------------------------------------------------------------------------

EVENTS = [(i, f"2024-01-01 00:{i % 60:02d}:00", f"u{i % 5}", f"text {i % 7}", float(i)) for i in range(40)]
EVENT = "no long, ts string, user string, content string, value double"


def test_upsert_twice_is_upsert_once(spark):
    target = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, no int")
    change = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, no int")
    once = sinks.upsert(target, change, ["id"], ["no"])
    assert rows(once) == rows(sinks.upsert(once, change, ["id"], ["no"])) == [(1, "a", 0), (2, "d", 2), (3, "e", 1)]


def test_backfill_embeds_only_what_lacks_a_vector(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, " ", None), (3, "x", [1.0]), (4, None, None)], "id int, text string, v array<double>")
    got = sinks.backfill_embeddings(df, "id", "text", "v", sinks.hashing_embedder(8)).collect()
    assert [r["id"] for r in got] == [1] and math.isclose(sum(x * x for x in got[0]["v"]), 1)


@pytest.mark.parametrize("files, per_trigger", [(1, None), (4, 1)])
def test_streams_give_the_same_in_one_batch_and_in_many(spark, tmp_path, files, per_trigger):
    events = spark.createDataFrame(EVENTS, EVENT).withColumn("ts", F.col("ts").cast("timestamp"))
    source = f"file://{tmp_path}/in"
    for k in range(files):
        events.filter(f"no % {files} = {k}").coalesce(1).write.mode("append").parquet(source)
    schema = events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    stream = lambda: K.stream_files(spark, source, schema, per_trigger=per_trigger)
    query, table = K.run_upserts(stream(), f"file://{tmp_path}/c1", f"file://{tmp_path}/table", ["user"], ["ts", "no"])
    query.awaitTermination()
    assert rows(table.read().select("user", "no")) == sorted((f"u{u}", max(i for i in range(40) if i % 5 == u)) for u in range(5))
    K.run_to_table(K.dedup_stream(stream(), "ts", "content"), f"file://{tmp_path}/c2", f"file://{tmp_path}/once").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/once").select("content").count() == 7


def test_batch_window_counts_are_the_streams(spark, tmp_path):
    events = spark.createDataFrame(EVENTS, EVENT).withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    schema = events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    query = K.windowed_counts(K.stream_files(spark, f"file://{tmp_path}/in", schema), "ts", "user", "10 minutes").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.table("counts")) == rows(K.windowed_counts(events, "ts", "user", "10 minutes"))


def test_observation_counts(spark):
    df, seen = K.observe_progress(spark.range(10), "n", F.count("*").alias("rows"))
    df.collect()
    assert seen.get["rows"] == 10


# --- round 2 ------------------------------------------------------------------------------------------------------


def test_rebase_numbers_anew_and_sums_up(spark):
    seg = spark.createDataFrame([("a", 0, 0, 0.0, 9.0, "x"), ("a", 0, 1, 9.0, 20.0, "y"), ("a", 1, 0, 1.0, 5.0, "z"), ("b", 0, 0, 0.0, 2.0, "w")], "g string, piece int, idx int, s double, e double, t string")
    got = R.rebase(seg, "g", "piece", "idx", "s", "e", 60.0).select("g", "no", "start_at", "end_at")
    assert rows(got) == [("a", 0, 0.0, 9.0), ("a", 1, 9.0, 20.0), ("a", 2, 61.0, 65.0), ("b", 0, 0.0, 2.0)]
    assert rows(R.merge_transcripts(seg, "g", "piece", "idx", "e", "t", 60.0)) == [("a", "x y z", 3, 65.0), ("b", "w", 1, 2.0)]


def test_a_better_ending_wins_over_a_later_one():
    text = "a" * 55 + " ends well. " + "b" * 12 + "\n" + "c" * 60
    one, two = ([p[-5:] for p in C.sentence_cuts(text, 90, 0, boundaries=b)][0] for b in ([r"[.]\s", r"\n"], [r"\n", r"[.]\s"]))
    assert (one, two) == ("well.", "bbbbb")
    assert C.sentence_cuts(text, 90, 0, boundaries=r"\n") == C.sentence_cuts(text, 90, 0, boundaries=[r"none", r"\n"])


def test_merged_pages_carry_the_last_flags(spark):
    pages = spark.createDataFrame([("a", 1, "one", False, True), ("a", 2, "two", True, True), ("a", 3, "three", True, False), ("a", 4, "new", False, True)], "issue string, page int, text string, goes_on boolean, more boolean")
    got = R.merge_continued(pages, ["issue"], "page", ~F.col("goes_on"), "text", mark="[continued]", carry=["more"]).orderBy("first_page").select("text", "more", "pages")
    assert [tuple(r) for r in got.collect()] == [("one\n\n[continued]\n\ntwo\n\n[continued]\n\nthree", False, 3), ("new", True, 1)]


def test_continued_pages_join(spark):
    pages = spark.createDataFrame([("a", 1, "one", False), ("a", 2, "goes on", True), ("a", 3, "new", False)], "issue string, page int, text string, goes_on boolean")
    got = R.merge_continued(pages, ["issue"], "page", ~F.col("goes_on"), "text").select("first_page", "last_page", "pages", "text")
    assert rows(got) == [(1, 2, 2, "one\n\ngoes on"), (3, 3, 1, "new")]


def test_ranks_are_those_of_one_window(spark):
    rnd = random.Random(2)
    df = spark.createDataFrame([(k, rnd.randrange(6) / 4) for k in range(300)], "id int, score double")
    want = {i: n for n, (_, i) in enumerate(sorted((-s, i) for i, s in rows(df)), 1)}
    assert {r["id"]: r["rank"] for r in R.ranked(df, "score", "id").collect()} == want


def test_trees_deeper_than_any_limit(spark):
    chain = spark.createDataFrame([(k, None if k == 0 else k - 1, f"n{k}") for k in range(70)], "id int, parent int, name string")
    assert G.tree_walk(chain, "id", "parent").agg(F.max("depth")).first()[0] == 69
    assert G.tree_paths(chain, "id", "parent", "name").count() == 70
    for f in (lambda: G.tree_walk(chain, "id", "parent", 30), lambda: G.tree_paths(chain, "id", "parent", "name", 30)):
        with pytest.raises(ValueError):
            f()


def test_marks_and_speech(spark):
    assert one(spark, X.strip_markdown("t"), t="## Head\n***a*** and _b_ ~~c~~ `d` e_f_g\n* x\n+ y\n> z\n---\n\n\n\nend") == "Head\na and b c d e_f_g\n- x\n- y\nz\n\nend"
    assert one(spark, X.strip_markdown("t"), t="> > # Quoted\n> - item **one _two_**\n***\n*a* `x` __init__ a__b__c\n1. kept\n#no heading") == "Quoted\n- item one two\n\na x init a__b__c\n1. kept\n#no heading"
    assert one(spark, X.spoken("t", pause=True), t="Ann Lee - Prayer. Next 3:4.") == "Ann Lee in the book Prayer.\nNext chapter 3 verse 4."
    assert one(spark, X.with_page("u", F.lit(2)), u="http://h/a#top") == "http://h/a?page=2#top"
    assert one(spark, X.with_page("u", F.lit(2)), u="http://h/a?page=7&x=1#p") == "http://h/a?page=2&x=1#p"


def test_keyword_search_finds_substrings(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the unbroken line"), (2, "broken lines here"), (3, "line broken"), (4, None)], "id int, text string")
    queries = spark.createDataFrame([(0, "broken line", [1.0]), (1, "zzz", [1.0]), (2, "", [1.0]), (3, "oken", [1.0])], "query_id int, text string, embedding array<double>")
    for most in (4096, 1):
        monkeypatch.setattr("lodestone.operators.phrases.PHRASES", most)
        assert {(r["query_id"], r["id"]) for r in H.keyword_topk_batch(docs, queries, 5, substring=True).collect()} == {(0, 1), (0, 2), (0, 3), (3, 1), (3, 2), (3, 3)}
    assert {(r["query_id"], r["id"]) for r in H.keyword_topk_batch(docs, queries, 5).collect()} == {(0, 3)}


def test_postfilter_before_and_after_the_limit(spark):
    docs = spark.createDataFrame([(k, "w", "en" if k % 2 else "fr", [1.0, k / 10]) for k in range(10)], "id int, text string, lang string, embedding array<double>")
    queries = spark.createDataFrame([(0, "w", [1.0, 0.0])], "query_id int, text string, embedding array<double>")
    ids = lambda compat: [r["id"] for r in H.postfilter(docs, queries, 3, F.col("lang") == "en", compat=compat).collect()]
    assert len(ids(False)) == 3 and all(i % 2 for i in ids(False)) and len(ids(True)) < 3


def test_no_folder_on_a_cluster_is_an_error():
    from types import SimpleNamespace

    away = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://h:7077"))
    with pytest.raises(RuntimeError):
        sinks.shared_dir(away)
    away.sparkContext.master = "local[2]"
    assert sinks.shared_dir(away).startswith("file://")


def test_the_library_stands_without_its_training_part(monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "lodestone.llm", None)
    assert not any(n.startswith("op") or n == "pipeline" for n in __spark_entry__.queries()) and __spark_entry__.oracle_sql()


def test_expand_search_counts_a_repeated_term_each_time(spark):
    """Two equal words have ceil(10 / 2) rows each by a list that holds every row twice: three rows, as in SQL."""
    df = spark.createDataFrame([(i, "aa bb") for i in range(8)], "id long, text string")
    queries = spark.createDataFrame([(1, "aa aa"), (2, "bb"), (3, "the the")], "query_id long, text string")
    got = {(r["query_id"], r["id"]) for r in H.expand_search(df, queries, {"the": ["aa", "zz"]}).collect()}
    assert got == {(1, i) for i in range(3)} | {(2, i) for i in range(8)} | {(3, 0), (3, 1)}


def test_first_rows_of_phrases(spark, monkeypatch):
    """Against brute force: rows out of order, repeated and null ids, null texts, several passes, and looks within a batch."""
    from lodestone.operators import phrases

    rnd = random.Random(5)
    words = ["ab", "bc", "abc", "q", "é", "zz"]
    data = [(rnd.choice([None, *range(60)]), rnd.choice([None, "".join(rnd.choice("abcé") for _ in range(rnd.randrange(9))) + rnd.choice(["", "", "q"])])) for _ in range(300)]
    df = spark.createDataFrame(data, "key long, body string").repartition(3)
    asked = spark.createDataFrame([(w,) for w in [*words, "", None, "ab"]], "p string")
    order = lambda i: (i is not None, i)
    want = sorted(((i, w) for w in words for i in sorted((i for i, t in data if t and w in t), key=order)[:4]), key=repr)
    for first, look in ((1 << 16, 256), (2, 7), (1, 1)):
        monkeypatch.setattr(phrases, "FIRST", first)
        monkeypatch.setattr(phrases, "LOOK", look)
        assert rows(phrases.first_holding(df, asked, 4, "key", "body", "p")) == want
    assert rows(phrases.first_holding(df.limit(0), asked, 4, "key", "body", "p")) == [] == rows(phrases.first_holding(df, asked.limit(0), 4, "key", "body", "p"))


def test_expand_search_brings_k_rows_a_term_to_the_queries(spark, monkeypatch):
    """Not each row that holds the term, of which there would be one for each query."""
    seen = []
    monkeypatch.setattr(H, "first_holding", lambda *a, f=H.first_holding: seen.append(f(*a)) or seen[-1])
    df = spark.createDataFrame([(i, f"aa {'bb' if i % 2 else ''}") for i in range(500)], "id long, text string")
    queries = spark.createDataFrame([(i, "aa bb") for i in range(100)], "query_id long, text string")
    assert sorted(map(tuple, H.expand_search(df, queries, {"x": ["y"]}).select("query_id", "id").collect())) == [(q, i) for q in range(100) for i in (0, 1, 2, 3, 4, 5, 7, 9)]
    assert seen[0].count() == 20
