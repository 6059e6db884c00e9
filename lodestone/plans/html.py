"""Queries over pages. `rich` rewrites each page's own menu, title and headings into the forms that the jobs look for; the SQL does the same and parses the whole page."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import html as H
from ..sources import html_tree
from ..session import shared_dir
from .registry import Tables as T
from .registry import query

#: (pattern, replacement) in order; $1 is the first group. Menu items get a board, a dated entry, an image, links and a table row of their own.
_REWRITES = [
    (
        r'<li><a href="/([^"]*)">[^<]*</a></li>',
        '<li><a href="/$1">$1</a><a href="/board/list?id=$1">Board $1</a><a href="/board/view/$1.html">2024-01-15</a><img src="/img/$1.jpg">'
        '<a href="https://social.example.org/$1">S</a><a href="/files/$1.pdf">F</a><span onclick="window.open(\'/pop/$1\')">x</span><i>$1 (editor)</i></li>'
        "<tr><td>$1 meeting</td><td>Monday</td><td>10:00</td><td>Hall $1</td></tr>",
    ),
    (r"(?s)<ul>(.*?)</ul>", '<ol start="3">$1</ol><a href="mailto:info@mail.example.com">Mail</a><p>Tel +49 30 1234567 Fax +49 30 7654321</p>'),
    (r"(?s)<title>(.*?)</title>", '<title>$1</title><meta name="description" content="$1">'),
    (r'(/board/view/[a-hA-H][^"]*\.html)">2024-01-15', '$1">2024-03-01'),
    (r'(/board/view/[i-pI-P][^"]*\.html)">2024-01-15', '$1">2023-12-31'),
    (r'(/board/view/[^"a-zA-Z][^"]*\.html)">2024-01-15', '$1">2024-02-31'),
]


def rich(t: T) -> DataFrame:
    """page_id, url, html: rewritten, with a number and a month in the heading."""
    html = F.col("html")
    for pattern, to in _REWRITES:
        html = F.regexp_replace(html, pattern, to)
    head = F.concat(F.lit("<h1>No. "), F.col("page_id").cast("string"), F.lit(" 2024-0"), (F.col("page_id") % 9 + 1).cast("string"), F.lit(" "))
    return t.pages.select("page_id", "url", F.replace(html, F.lit("<h1>"), head).alias("html"))


def nodes(pages: DataFrame) -> DataFrame:
    """The node table of the pages; written once, so that a query with several looks at it parses no page twice."""
    path = f"{shared_dir(pages.sparkSession)}/nodes-{uuid.uuid4().hex}"
    found = html_tree.parse(pages)
    found.write.parquet(path)
    return pages.sparkSession.read.schema(found.schema).parquet(path)


def _rich() -> str:
    html = "html"
    for pattern, to in _REWRITES:
        html = f"regexp_replace({html}, '{pattern}', '{to.replace(chr(39), chr(39) * 2).replace('$1', chr(92) + '1')}', 'g')"
    return f"rich AS (SELECT page_id, url, replace({html}, '<h1>', '<h1>No. ' || page_id || ' 2024-0' || (page_id % 9 + 1) || ' ') AS html FROM pages)"


_RICH = _rich()
_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"


def _text(raw: str) -> str:
    """A text or attribute value with its character references resolved."""
    return f"replace(replace({raw}, '&quot;', '\"'), '&amp;', '&')"


def _strip(html: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({html}, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


def _links(pattern: str) -> str:
    """m (page_id, url, pos, raw, link): the first groups of a pattern in order, and these as absolute URLs without fragment."""
    u = "regexp_replace(trim(raw), '#.*$', '')"
    link = f"CASE WHEN {u} = '' OR regexp_matches({u}, '(?i)^(javascript|mailto|tel|data):') THEN NULL WHEN regexp_matches({u}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {u} ELSE {_ORIGIN} || {u} END"
    return f"x AS (SELECT page_id, url, regexp_extract_all(html, '{pattern}', 1) AS f FROM rich), y AS (SELECT page_id, url, unnest(range(0, len(f)))::int AS pos, unnest(f) AS raw FROM x), m AS (SELECT page_id, url, pos, raw, {link} AS link FROM y)"


@query(rf"""WITH {_RICH}, l AS (SELECT page_id, regexp_extract_all(unnest(regexp_extract_all(html, '(?s)<ol start="3">(.*?)</ol>', 1)), '(?s)<li[^>]*>(.*?)</li>', 1) AS f FROM rich),
i AS (SELECT page_id, unnest(range(0, len(f)))::int + 3 AS no, unnest(f) AS item FROM l) SELECT page_id, no, {_strip("item")} AS text FROM i""")
def html_list_items(s: SparkSession, d: str) -> DataFrame:
    return H.html_list_items(nodes(rich(T(s, d))))


@query(rf"""WITH {_RICH}, x AS (SELECT page_id, regexp_extract_all(html, '/view/([^"]+)\.html">\d{{4}}-\d{{2}}-\d{{2}}<', 1) AS f, regexp_extract_all(html, '/view/[^"]+\.html">(\d{{4}}-\d{{2}}-\d{{2}})<', 1) AS g FROM rich),
y AS (SELECT page_id, unnest(range(0, len(f))) AS pos, unnest(f) AS id, unnest(g) AS date FROM x) SELECT page_id, id, date FROM y WHERE try_cast(date AS date) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id, date ORDER BY pos) = 1""")
def html_listing_records(s: SparkSession, d: str) -> DataFrame:
    return H.html_listing(html_tree.parse(rich(T(s, d)), tags=["a"]), r"/view/(.+)\.html$")


@query(f"""WITH {_RICH}, {_links('<img [^>]*src="([^"]+)"')} SELECT page_id, pos, link AS image FROM m""")
def html_img_urls(s: SparkSession, d: str) -> DataFrame:
    return H.html_images(nodes(rich(T(s, d))))


@query(rf"""WITH {_RICH} SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="(/board/view/[^"]+)"', 1)) AS link FROM rich""")
def html_detail_links(s: SparkSession, d: str) -> DataFrame:
    return H.html_detail_links(html_tree.parse(rich(T(s, d)), tags=["a"]), ["^/detail/.", "^/board/view/."])


@query(rf"""WITH {_RICH}, h AS (SELECT page_id, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS h, list_filter(regexp_extract_all(html, '<img src="([^"]+)"', 1), lambda x: NOT contains(x, 'der')) AS f FROM rich)
SELECT page_id, regexp_extract(h, '(\d{{4}})[-/.](\d{{1,2}})', 1)::int AS year, regexp_extract(h, '(\d{{4}})[-/.](\d{{1,2}})', 2)::int AS month, regexp_extract(h, '(?i)(?:no\.|issue)\s*(\d+)', 1)::int AS issue, CASE WHEN len(f) > 0 THEN array_to_string(f, ',') END AS images FROM h""")
def html_detail_fields(s: SparkSession, d: str) -> DataFrame:
    pages = rich(T(s, d))
    return H.html_detail_fields(pages, nodes(pages), [("image", "src"), ("img", "src")], "der")


@query(rf'''WITH {_RICH} SELECT page_id, nullif(trim({_text("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")}), '') AS title, nullif({_text("""regexp_extract(html, '<meta name="description" content="([^"]*)"', 1)""")}, '') AS description,
nullif(regexp_extract(html, '<meta name="keywords" content="([^"]*)"', 1), '') AS keywords, nullif(regexp_extract(html, '<meta property="og:image" content="([^"]*)"', 1), '') AS og_image, nullif(regexp_extract(html, '<meta charset="([^"]*)"', 1), '') AS charset,
nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS lang, nullif(regexp_extract(html, '<link rel="icon" href="([^"]*)"', 1), '') AS favicon, nullif(regexp_extract(html, '<meta name="viewport" content="([^"]*)"', 1), '') AS viewport FROM rich''')
def page_metadata(s: SparkSession, d: str) -> DataFrame:
    pages = rich(T(s, d))
    return H.page_metadata(pages, nodes(pages))


_PHONE = r"\+?\d[\d() .-]{7,18}\d"


def _first(items: str, n: int) -> str:
    """The first n distinct ones in order, joined."""
    return f"array_to_string(list_filter({items}, lambda w, i: list_position({items}, w) = i)[1:{n}], ',')"


@query(rf"""WITH {_RICH}, b AS (SELECT page_id, regexp_replace(regexp_replace(html, 'href="(?:tel|mailto):([^"?]*)[^"]*"', '> \1 <', 'g'), '<[^>]*>', ' ', 'g') AS t FROM rich),
n AS (SELECT page_id, t, list_filter(regexp_extract_all(t, '(?is)(.{{0,10}}{_PHONE})', 1), lambda x: length(regexp_replace(regexp_extract(x, '({_PHONE})$', 1), '\D', '', 'g')) BETWEEN 9 AND 15) AS n FROM b),
p AS (SELECT page_id, t, list_transform(list_filter(n, lambda x: NOT contains(lower(x), 'fax')), lambda x: trim(regexp_extract(x, '({_PHONE})$', 1))) AS p, list_transform(list_filter(n, lambda x: contains(lower(x), 'fax')), lambda x: trim(regexp_extract(x, '({_PHONE})$', 1))) AS f,
regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS m FROM n) SELECT page_id, {_first('p', 5)} AS phones, {_first('f', 5)} AS faxes, {_first('m', 3)} AS emails FROM p""")
def page_contacts(s: SparkSession, d: str) -> DataFrame:
    return H.page_contacts(rich(T(s, d)))


@query(rf"""WITH {_RICH} SELECT page_id, 'social' AS platform, regexp_extract(html, 'href="([^"]*//social\.example\.org/[^"]*)"', 1) AS link FROM rich WHERE regexp_matches(html, 'href="[^"]*//social\.example\.org/')""")
def page_social(s: SparkSession, d: str) -> DataFrame:
    return H.page_social(nodes(rich(T(s, d))), {"social": r"//social\.example\.org/", "video": r"//video\.example\.org/"})


@query(rf"""WITH {_RICH}, {_links('(?:src|href)="([^"]*)"')}, k AS (SELECT page_id, pos, link, lower(link) AS u, regexp_matches(lower(link), '\.(png|jpe?g|gif|webp|svg)(\?|$)') AS image FROM m)
SELECT page_id, pos, CASE WHEN image AND contains(u, 'logo') THEN 'logo' WHEN image AND contains(u, 'banner') THEN 'banner' WHEN image THEN 'gallery' WHEN regexp_matches(u, '\.(mp4|webm|mov)(\?|$)|/embed/') THEN 'video' ELSE 'document' END AS kind, link
FROM k WHERE image OR regexp_matches(u, '\.(mp4|webm|mov|pdf|docx?|xlsx?|pptx?|hwp)(\?|$)|/embed/')""")
def page_media(s: SparkSession, d: str) -> DataFrame:
    return H.page_media(nodes(rich(T(s, d))))


@query(rf"""WITH {_RICH}, x AS (SELECT page_id, regexp_extract_all(html, '(?s)<tr[^>]*>(.*?)</tr>', 1) AS f FROM rich), y AS (SELECT page_id, unnest(range(0, len(f)))::int AS pos, unnest(f) AS line FROM x),
c AS (SELECT page_id, pos, list_transform(regexp_extract_all(line, '(?s)<t[dh][^>]*>(.*?)</t[dh]>', 1), lambda z: {_strip("z")}) AS c FROM y),
n AS (SELECT page_id, pos, coalesce(c[1], '') AS name, coalesce(c[2], '') AS day, coalesce(c[3], '') AS time, coalesce(c[4], '') AS place FROM c WHERE contains(lower(c[1]), 'meeting')),
o AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY page_id, name, day ORDER BY pos) = 1) SELECT page_id, name, day, time, place FROM o QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 20""")
def page_schedule(s: SparkSession, d: str) -> DataFrame:
    return H.page_schedule(nodes(rich(T(s, d))), ["meeting"])


@query(rf"""WITH m AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS title FROM pages)
SELECT page_id, {_ORIGIN} || href AS link, trim(title) AS title, CASE WHEN regexp_matches({_ORIGIN} || href, '/[A-Z]') THEN 'section' ELSE 'page' END AS kind FROM m WHERE starts_with(href, '/')""")
def page_links(s: SparkSession, d: str) -> DataFrame:
    return H.page_links(html_tree.parse(T(s, d).pages, tags=["a"]), [("/[A-Z]", "section")]).select("page_id", "link", "title", "kind")


_ANCHOR = r'<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>'


@query(rf"""WITH {_RICH}, x AS (SELECT page_id, url, regexp_extract_all(html, '{_ANCHOR}', 1) AS f, regexp_extract_all(html, '{_ANCHOR}', 2) AS g FROM rich), y AS (SELECT page_id, url, unnest(range(0, len(f))) AS pos, unnest(f) AS raw, trim(unnest(g)) AS title FROM x),
l AS (SELECT page_id, pos, {_ORIGIN} || regexp_replace(raw, '#.*$', '') AS link, title FROM y WHERE starts_with(raw, '/')) SELECT page_id, link, title FROM l WHERE regexp_matches(link, '/board/list|bo_table=') QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY pos) = 1""")
def page_boards(s: SparkSession, d: str) -> DataFrame:
    return H.page_boards(html_tree.parse(rich(T(s, d)), tags=["a"]), [r"/board/list", r"bo_table="])


@query(rf"""WITH {_RICH}, x AS (SELECT page_id, url, regexp_extract_all(html, 'window\.open\(''([^'']+)''', 1) AS f FROM rich), y AS (SELECT page_id, url, unnest(range(0, len(f))) AS p, unnest(f) AS raw FROM x),
z AS (SELECT page_id, url, raw, min(p) AS p FROM y GROUP BY ALL) SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY p) - 1)::int AS pos, {_ORIGIN} || regexp_replace(raw, '#.*$', '') AS link FROM z""")
def page_popups(s: SparkSession, d: str) -> DataFrame:
    return H.page_popups(rich(T(s, d)))


@query(rf"""WITH u AS (SELECT page_id, regexp_extract(html, '(?s)<ul>(.*?)</ul>', 1) AS body FROM pages), x AS (SELECT page_id, regexp_extract_all(body, '{_ANCHOR}', 1) AS f, regexp_extract_all(body, '{_ANCHOR}', 2) AS g FROM u),
y AS (SELECT page_id, unnest(range(0, len(f))) AS pos, unnest(f) AS href, trim(unnest(g)) AS title FROM x), z AS (SELECT * FROM y WHERE href <> '' QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1)::int AS no, href, title, 1 AS depth, NULL::varchar AS parent FROM z""")
def page_navigation(s: SparkSession, d: str) -> DataFrame:
    return H.page_navigation(nodes(T(s, d).pages))


_NO_CODE = "regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g')"


@query(rf"""WITH b AS (SELECT page_id, lower(html) AS h, html, length({_strip(_NO_CODE)}) AS n FROM pages)
SELECT page_id, nullif(regexp_extract(html, '(?i)http-equiv="refresh"[^>]*url=([^"''>]+)', 1), '') AS meta_redirect, n < 200 AND regexp_matches(h, 'enter|intro') AS is_intro, regexp_matches(h, '<i?frame') AND n < 100 AS is_frame_only,
nullif(regexp_extract(html, '["'']([^"'']*menu[^"'']*\.xml)["'']', 1), '') AS xml_menu, concat_ws(',', CASE WHEN contains(h, 'track(') THEN 'tracker' END, CASE WHEN contains(h, '<article') THEN 'article' END) AS technologies,
regexp_matches(h, 'type="password"|/login') AS has_login, regexp_matches(h, 'name="viewport"|//m\.') AS is_mobile FROM b""")
def page_flags(s: SparkSession, d: str) -> DataFrame:
    return H.page_flags(T(s, d).pages, {"tracker": r"track\(", "article": "<article"})


@query(r"""WITH b AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages),
m AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(t, '([A-Z][a-z]{9,12})tion', 1)) AS term, 'event' AS category FROM b UNION SELECT DISTINCT page_id, unnest(regexp_extract_all(t, '([a-z]{6,10})keit', 1)), 'place' FROM b)
SELECT term, category, min(page_id) AS first_page, count(*) AS pages FROM m GROUP BY ALL""")
def mine_dictionary(s: SparkSession, d: str) -> DataFrame:
    return H.mine_terms(T(s, d).pages, {"event": "([A-Z][a-z]{9,12})tion", "place": "([a-z]{6,10})keit"})


@query(r"""WITH b AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages), m AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(t, '([A-Z][a-z]{5,12})heit', 1)) AS term FROM b)
SELECT term, count(*) AS pages, CASE WHEN contains(lower(term), 'sch') THEN 'school' WHEN contains(lower(term), 'ver') THEN 'board' ELSE 'other' END AS department FROM m GROUP BY term""")
def mine_organisation(s: SparkSession, d: str) -> DataFrame:
    terms = H.mine_terms(T(s, d).pages, {"department": "([A-Z][a-z]{5,12})heit"})
    return H.categorise(terms, "term", [("sch", "school"), ("ver", "board")]).select("term", "pages", "department")


@query(r"""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS title FROM pages) SELECT page_id, trim(title) AS title FROM m WHERE contains(lower(title), 'the') OR contains(lower(title), 'und')""")
def find_pages_keyword(s: SparkSession, d: str) -> DataFrame:
    return H.find_pages(html_tree.links(html_tree.parse(T(s, d).pages, tags=["a"])), ["the", "und"]).select("page_id", "title")


@query(rf"""WITH {_RICH}, x AS (SELECT page_id, regexp_extract_all(html, '<i>(\w+) \((\w+)\)</i>', 1) AS f, regexp_extract_all(html, '<i>(\w+) \((\w+)\)</i>', 2) AS g FROM rich),
y AS (SELECT page_id, unnest(range(0, len(f))) AS pos, unnest(f) AS name, unnest(g) AS role FROM x) SELECT name, role FROM y QUALIFY row_number() OVER (PARTITION BY name ORDER BY page_id, pos) = 1""")
def mine_members(s: SparkSession, d: str) -> DataFrame:
    t = T(s, d)
    known = t.customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"))
    return H.mine_members(rich(t), [r"<b>(Dr\. \w+) \((\w+)\)</b>", r"<i>(\w+) \((\w+)\)</i>"], known)
