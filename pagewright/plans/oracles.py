"""DuckDB SQL for the queries of ``registry``, over common table expressions of its own."""

from __future__ import annotations

from pagewright.functions.text import SUFFIXES
from pagewright.operators.entities import KINDS
from pagewright.operators.keywords import GENERIC, STOPWORDS
from pagewright.operators.regions import FOOTER_PHONE as _FOOTER_PHONE
from pagewright.operators.regions import LABEL_ACTIONS, LABEL_COMMON, LABEL_PHONE, LABEL_PROMOTION
from pagewright.plans.site_oracles import site_oracles

_FETCH = """flog AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS site, url,
    CASE WHEN page_id % 29 = 7 THEN 404 WHEN page_id % 31 = 11 THEN 503 WHEN page_id % 97 = 13 THEN 410 ELSE 200 END AS status,
    120 + (page_id * 7919) % 3700 AS load_time_ms, 20 + (page_id * 104729) % 180 AS ttfb_ms,
    CASE WHEN page_id % 5 = 0 THEN 'js' ELSE 'raw' END AS render_mode, octet_length(encode(html)) AS content_length_bytes FROM pages)"""


def _plain(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim(regexp_replace({x}, '[\\x00-\\x20]+', ' ', 'g'))"


_A = r"""<a\s[^>]*href="([^"#][^"]*)"[^>]*>((?:[^<]|<[^/][^>]*>|</[^a][^>]*>)*)</a>"""
_H = r"<(h[1-6])(?:\s[^>]*)?>((?:[^<]|<[^/][^>]*>|</[^h][^>]*>)*)</h[1-6]>"
_P = r"<p(?:\s[^>]*)?>((?:[^<]|<[^/p][^>]*>|</[^p][^>]*>)*)"
_RESOLVE = r"""CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h
    WHEN starts_with(h, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || h
    WHEN starts_with(h, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) || h
    ELSE regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '[^/]*$', '') || h END"""
_PARSED = rf"""body AS (SELECT page_id, url, html, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) AS site,
    regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g') AS body FROM pages),
heads AS (SELECT page_id, site, url, unnest(regexp_extract_all(body, '{_H}', 1)) AS tag, unnest(regexp_extract_all(body, '{_H}', 2)) AS raw, generate_subscripts(regexp_extract_all(body, '{_H}', 1), 1) AS i FROM body),
headings AS (SELECT page_id, site, url, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, tag, {_plain('raw')} AS text FROM heads WHERE {_plain('raw')} <> ''),
paras AS (SELECT page_id, site, url, unnest(regexp_extract_all(body, '{_P}', 1)) AS raw, generate_subscripts(regexp_extract_all(body, '{_P}', 1), 1) AS i FROM body),
paragraphs AS (SELECT page_id, site, url, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, {_plain('raw')} AS text FROM paras WHERE length({_plain('raw')}) > 20),
anchors AS (SELECT page_id, site, url, unnest(regexp_extract_all(body, '{_A}', 1)) AS h, unnest(regexp_extract_all(body, '{_A}', 2)) AS raw, generate_subscripts(regexp_extract_all(body, '{_A}', 1), 1) - 1 AS pos FROM body),
links AS (SELECT page_id, site, url, pos, href, label, CASE WHEN lower(regexp_extract(href, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) = site THEN 'internal' ELSE 'external' END AS kind
    FROM (SELECT *, split_part({_RESOLVE}, '#', 1) AS href, {_plain('raw')} AS label FROM anchors)),
imgs AS (SELECT page_id, len(regexp_extract_all(body, '<img\s([^>]*)>', 1)) AS n_images FROM body),
pt AS (SELECT page_id, count(*) AS n_paragraphs, string_agg(text, ' ' ORDER BY pos) AS text, arg_min(text, pos) AS first_p FROM paragraphs GROUP BY 1),
hd AS (SELECT page_id, count(*) AS n_headings, arg_min(text, pos) FILTER (WHERE tag = 'h1') AS h1 FROM headings GROUP BY 1),
lk AS (SELECT page_id, count(*) AS n_links, count(*) FILTER (WHERE kind = 'internal') AS n_internal, bool_or(starts_with(href, 'http://')) AS insecure FROM links GROUP BY 1),
parsed AS (SELECT b.page_id, b.url, b.site, {_plain("regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)")} AS title, h1,
    coalesce(CASE WHEN length(first_p) > 200 THEN left(first_p, 200) || '...' ELSE first_p END, '') AS description,
    CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, ' ')) END AS words, coalesce(n_links, 0) AS n_links, coalesce(n_internal, 0) AS n_internal, n_images, coalesce(insecure, false) AS insecure,
    len(regexp_extract_all(regexp_extract(html, '(?s)<nav[^>]*>(.*?)</nav>', 1), '{_A}', 1)) AS nav_links, trim(regexp_extract(html, '(?s)<footer[^>]*>(.*?)</footer>', 1)) <> '' AS footer,
    coalesce(n_paragraphs, 0) AS n_paragraphs, coalesce(n_headings, 0) AS n_headings
    FROM body b LEFT JOIN pt USING (page_id) LEFT JOIN hd USING (page_id) LEFT JOIN lk USING (page_id) LEFT JOIN imgs USING (page_id))"""


def _any(words: str) -> str:
    return "(" + " OR ".join(f"contains(lower(url), '{w}')" for w in words.split()) + ")"


_TYPE = f"""CASE WHEN {_any('login signin sign-in account checkout privacy terms legal cookie auth register signup sign-up dashboard')} THEN 'utility'
    WHEN {_any('contact location find-us findus about-us aboutus')} THEN 'contact'
    WHEN {_any('shop category catalog products listings collection browse store')} AND ((cards >= 8 AND n_paragraphs <= 3) OR (cards >= 4 AND n_paragraphs <= 2)) THEN 'catalog'
    WHEN {_any('/product/ /item/ /p/ /products/ /shop/')} AND words >= 50 AND cards <= 4 THEN 'product'
    WHEN {_any('blog news article post /story/ /stories/')} AND ((words > 600 AND n_paragraphs > 5) OR (words > 300 AND n_paragraphs > 3 AND n_headings >= 2)) THEN 'article'
    WHEN {_any('gallery photos images media portfolio video')} AND words < 200 AND n_paragraphs <= 2 THEN 'media_gallery'
    WHEN words < 400 AND n_paragraphs <= 6 AND n_headings >= 2 THEN 'landing' ELSE 'generic' END"""
_FLAGS = f"""typed AS (SELECT *, {_TYPE} AS page_type FROM (SELECT p.*, f.status, f.load_time_ms, f.content_length_bytes, f.status IN (404, 410) OR f.status BETWEEN 500 AND 599 AS bad,
    CASE WHEN n_images >= 8 AND n_internal >= 8 THEN least(n_images // 2, n_internal // 2) WHEN n_images >= 4 AND n_internal >= 4 THEN least(n_images // 3, n_internal // 3) ELSE 0 END AS cards
    FROM parsed p JOIN flog f USING (page_id))),
flags AS (SELECT *, title = '' AS missing_title, description = '' AS missing_description, h1 IS NULL AS missing_h1, false AS noindex, true AS no_viewport,
    starts_with(url, 'https://') AND insecure AS mixed_content, length(url) - length(replace(url, '/', '')) > 4 AS deep_url,
    CASE WHEN bad THEN NULL WHEN page_type = 'article' AND words < 300 THEN 'very_thin' WHEN page_type = 'article' AND words < 600 THEN 'thin' WHEN page_type = 'landing' AND words < 80 THEN 'very_thin'
        WHEN page_type IN ('landing', 'generic') AND words < 150 AND NOT (page_type = 'generic' AND words < 50) THEN 'thin' WHEN page_type = 'generic' AND words < 50 THEN 'very_thin'
        WHEN page_type IN ('catalog', 'product') AND words < 10 THEN 'thin' END AS thin FROM typed),
bad_links AS (SELECT l.site, l.url, l.href, l.label, s.status FROM links l JOIN (SELECT DISTINCT url, status FROM flog WHERE status IN (404, 410) OR status BETWEEN 500 AND 599) s ON l.href = s.url WHERE l.kind = 'internal')"""
_ALL = f"WITH {_FETCH}, {_PARSED}, {_FLAGS}"
_F = f"WITH {_FETCH}"
_P_ = f"WITH {_PARSED}"
_CONS = "CASE WHEN {n} < 5 OR {m} <= 0 THEN 'unknown' WHEN {s} / {m} > 0.4 THEN 'unstable' WHEN {s} / {m} > 0.2 THEN 'moderate' ELSE 'stable' END"
_SAMPLES = "samples AS (SELECT *, load_time_ms + 37 * sample_no AS load_ms FROM flog, (SELECT unnest([0, 1, 2]) AS sample_no))"
_AGG = """agg AS (SELECT site, url, count(*) AS n, avg(load_ms) AS mean_load, median(load_ms) AS median_load, min(load_ms) AS min_load, max(load_ms) AS max_load, coalesce(stddev_samp(load_ms), 0) AS stdev_load,
    avg(ttfb_ms) AS avg_ttfb, arg_min(render_mode, sample_no) AS render_mode FROM samples {where} GROUP BY site, url)"""

def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_NAV_LABEL = f"""CASE WHEN label = '' OR regexp_matches(label, '{LABEL_PHONE}') OR regexp_matches(lower(label), '{LABEL_ACTIONS}') THEN false WHEN regexp_matches(lower(label), '^({LABEL_COMMON})$') THEN true
    WHEN length(label) >= 5 AND regexp_matches(lower(label), '{LABEL_PROMOTION}') THEN false WHEN length(label) >= 5 AND len(string_split(label, ' ')) <= 5 THEN true
    ELSE length(label) >= 3 AND length(regexp_replace(label, '[^a-zA-Z]', '', 'g')) >= 2 END"""
_ARTICLES = rf"""articles AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) AS site_name, url, CASE WHEN length(h1) > 10 THEN h1 WHEN length(title) > 10 THEN title END AS title,
    CASE WHEN length(content) > 100 THEN content ELSE '' END AS content FROM (SELECT page_id, url, {_plain("regexp_extract(b, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS h1, {_plain("regexp_extract(b, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
        {_plain("regexp_extract(b, '(?is)<article[^>]*>(.*?)</article>', 1)")} AS content FROM (SELECT *, regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g') AS b FROM pages)))"""
_KINDS = f"kinds AS (SELECT site, url, kind FROM parsed, (VALUES {', '.join(f"('{k}', '{w}')" for k, w in KINDS.items())}) v(kind, named_by) WHERE regexp_matches(lower(url || chr(10) || title), named_by))"

def _sim(texts: str) -> str:
    """Common table expressions ``sim`` and ``reps`` of texts given as (id, site, text)."""
    return rf"""tx AS ({texts}), sw AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')) AS w FROM tx),
sh AS (SELECT id, w, count(*) AS n, ('0x' || right(md5(w), 16))::UBIGINT AS h FROM sw GROUP BY ALL),
sv AS (SELECT id, i, sum(CASE WHEN (h >> i::UBIGINT) & 1 = 1 THEN n ELSE -n END) AS s FROM sh, (SELECT unnest(range(64)) AS i) GROUP BY ALL),
sb AS (SELECT id, sum(CASE WHEN s > 0 THEN CASE WHEN i = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << i::INT) END ELSE 0 END)::BIGINT AS simhash FROM sv GROUP BY id),
sim AS (SELECT tx.id, tx.site, coalesce(simhash, 0) AS simhash FROM tx LEFT JOIN sb USING (id)), reps AS (SELECT site, simhash, min(id) AS first, count(*) AS members FROM sim GROUP BY ALL)"""


_SIM_DOCS = _sim("SELECT doc_id AS id, source AS site, text FROM documents WHERE text <> ''")
_SIM_PAGES = _sim("SELECT p.page_id AS id, p.site, p.title || chr(10) || left(coalesce(pt.text, ''), 1000) AS text FROM parsed p LEFT JOIN pt USING (page_id) WHERE trim(p.title || coalesce(pt.text, '')) <> ''")
_NEAR = "bit_count(xor({a}, {b})) <= 12"
_CLAIMS = r"""claims AS (SELECT site, 'Name' AS field, title AS value, url FROM flags WHERE title <> '' UNION ALL SELECT site, 'Tagline', description, url FROM flags WHERE description <> ''),
by_source AS (SELECT site, field, value, url, count(*) AS n FROM claims GROUP BY ALL),
facts AS (SELECT site, 'Business' AS category, 'Profile' AS subcategory, field, 'text' AS type, value, 0.8::DOUBLE AS confidence, sum(n)::BIGINT AS mentions, count(*) AS sources, array_to_string(list_sort(list(url))[1:3], ' ') AS first_sources
    FROM by_source GROUP BY site, field, value),
truth AS (SELECT *, row_number() OVER (PARTITION BY site, field ORDER BY sources DESC, mentions DESC, value) = 1 AS chosen FROM facts)"""
_OVERRIDES = """kinds AS (SELECT ['article', 'landing', 'catalog', 'product', 'media_gallery', 'contact', 'utility', 'generic', 'homepage'] AS k),
overrides AS (SELECT page_id, k[page_id % 9 + 1] AS page_type, DATE '2024-01-01' + (page_id % 20)::INT AS set_at, 0 AS seq FROM pages, kinds WHERE page_id % 4 = 1
    UNION ALL SELECT page_id, k[(page_id + 3) % 9 + 1], DATE '2024-01-05' + (page_id % 15)::INT, 1 FROM pages, kinds WHERE page_id % 6 = 1),
valid AS (SELECT page_id, set_at, arg_max(page_type, seq) AS page_type FROM overrides WHERE page_type <> 'homepage' GROUP BY ALL)"""
_ARRIVALS = r"""arrivals AS (SELECT site AS run, page_id, 1700000000 + page_id % 997 AS t, title, CASE WHEN p = '' THEN '/' ELSE p END AS path, url, status, words, n_images AS media, load_time_ms, content_length_bytes,
        CASE WHEN page_id % 2 = 0 THEN page_type END AS page_type FROM (SELECT *, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) AS p FROM flags)),
    both_times AS (SELECT * FROM arrivals UNION ALL SELECT * REPLACE (t + 3600 AS t, 304 AS status, NULL AS page_type) FROM arrivals WHERE page_id % 3 = 0)"""

_GOOD_TITLE = r"""(length({x}) >= 5 AND NOT regexp_matches({x}, '\([0-9]{{3}}\)\s*[0-9]{{3}}-[0-9]{{4}}|[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}}|[0-9]{{3}}\.[0-9]{{3}}\.[0-9]{{4}}')
    AND NOT regexp_matches(lower({x}), 'call us at|contact us|get a quote|free|click here|learn more|read more|view more|shop now|buy now|sign up|subscribe|follow us|like us|share|download|sale|special offer')
    AND length(regexp_replace({x}, '[^a-zA-Z]', '', 'g')) >= 3)"""
_COMPANY = r"""(length({x}) > 30 OR len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')) >= 3
    OR regexp_matches(lower({x}), '\b(inc|llc|ltd|corp|corporation|company|co\.|group|solutions|services|systems|technologies|tech|exterior|interior|construction|building|roofing|siding|landscaping|maintenance|upkeep|northshore|north shore|southshore|south shore|eastside|westside)\b'))"""
_HOME = r"trim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/') IN ('', 'index', 'index.html', 'home')"
_ISSUES = """per_page AS (SELECT url, count(*) AS broken FROM bad_links GROUP BY url), pf AS (SELECT f.*, coalesce(b.broken, 0) AS broken FROM flags f LEFT JOIN per_page b USING (url)),
found AS (SELECT site, url, 'missing_title' AS issue, NULL AS note FROM pf WHERE missing_title UNION ALL SELECT site, url, 'missing_description', NULL FROM pf WHERE missing_description UNION ALL SELECT site, url, 'missing_h1', NULL FROM pf WHERE missing_h1
    UNION ALL SELECT site, url, CASE WHEN page_type NOT IN ('article', 'landing', 'generic') THEN 'low_text_catalog' WHEN thin = 'thin' THEN 'thin_content' ELSE 'very_thin_content' END, words || ' words (' || page_type || ')' FROM pf WHERE thin IS NOT NULL
    UNION ALL SELECT site, url, 'slow_pages', load_time_ms || ' ms' FROM pf WHERE load_time_ms > 1500 UNION ALL SELECT site, url, 'very_slow_pages', load_time_ms || ' ms' FROM pf WHERE load_time_ms > 3000
    UNION ALL SELECT site, url, 'deep_urls', NULL FROM pf WHERE deep_url UNION ALL SELECT site, url, 'mixed_content', NULL FROM pf WHERE mixed_content
    UNION ALL SELECT p.site, p.url, 'no_viewport', NULL FROM pf p JOIN body b USING (page_id) WHERE NOT regexp_matches(lower(b.html), '<meta[^>]*viewport')
    UNION ALL SELECT p.site, p.url, 'noindex', NULL FROM pf p JOIN body b USING (page_id) WHERE regexp_matches(lower(b.html), '<meta[^>]*robots[^>]*noindex')
    UNION ALL SELECT site, url, 'broken_links', broken || ' links' FROM pf WHERE broken > 0 UNION ALL SELECT site, url, 'error_pages', 'status ' || status FROM pf WHERE bad),
issue_urls AS (SELECT site, issue, url, min(note) AS note FROM found GROUP BY ALL)"""

_SCORES = r"""fo AS (SELECT page_id, regexp_extract(html, '(?s)<footer[^>]*>(.*?)</footer>', 1) AS f, regexp_matches(lower(html), '<meta[^>]*viewport') AS viewport, regexp_matches(lower(html), '<meta[^>]*robots[^>]*noindex') AS robots FROM body),
bp AS (SELECT url, count(*) AS broken FROM bad_links GROUP BY url), fl AS (SELECT f.*, fo.*, coalesce(broken, 0) AS broken, page_type IN ('article', 'landing', 'generic') AS imp FROM flags f JOIN fo USING (page_id) LEFT JOIN bp USING (url)),
uq AS (SELECT site, 100 * count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM reps b WHERE b.site = a.site AND b.first < a.first AND bit_count(xor(a.simhash, b.simhash)) <= 12)) / sum(members) AS uniq FROM reps a GROUP BY site),
ct AS (SELECT site, count(*) AS n, count(*) FILTER (WHERE missing_title) AS no_title, count(*) FILTER (WHERE missing_description) AS no_desc, count(*) FILTER (WHERE missing_h1) AS no_h1, count(*) FILTER (WHERE broken > 0) AS broken_pages, sum(broken) AS broken_links,
    count(*) FILTER (WHERE robots) AS noindex_pages, count(*) FILTER (WHERE NOT viewport) AS no_viewport_pages, count(*) FILTER (WHERE mixed_content) AS mixed, count(*) FILTER (WHERE deep_url) AS deep, count(*) FILTER (WHERE bad) AS bad_pages,
    count(*) FILTER (WHERE imp AND thin = 'very_thin') AS vthin, count(*) FILTER (WHERE imp AND thin = 'thin') AS thinp, count(*) FILTER (WHERE NOT imp AND thin IS NOT NULL) AS low_text, count(*) FILTER (WHERE imp) AS important,
    avg(words) FILTER (WHERE imp) AS awi, avg(words) AS aw, avg(load_time_ms) AS avg_load, quantile_cont(load_time_ms, 0.9) AS p90, count(*) FILTER (WHERE load_time_ms > 1500) AS slow, count(*) FILTER (WHERE load_time_ms > 3000) AS vslow,
    max(content_length_bytes) / 1024 AS kb, max(nav_links) AS nav, sum(n_internal) AS internal, count(*) FILTER (WHERE n_internal > 0) AS linked, bool_or(starts_with(url, 'https://')) AS https, bool_or(starts_with(url, 'http://')) AS http,
    bool_or(regexp_matches(f, '@[A-Za-z0-9-]+\.[A-Za-z]{2,}|[0-9]{3}\)?[-. ]?[0-9]{3}[-. ]?[0-9]{4}|(facebook|twitter|instagram|linkedin|youtube|tiktok|pinterest|github)\.com')) AS footer, sum(n_headings) AS heads,
    count(*) FILTER (WHERE n_headings > 0 OR title <> '') AS headed FROM fl GROUP BY site),
sc AS (SELECT *, coalesce(uniq, 100) AS u, coalesce(awi, aw) AS w, CASE WHEN important > 0 THEN important ELSE n END AS d, internal / n AS per FROM ct LEFT JOIN uq USING (site)),
parts AS (SELECT *, greatest(0, 100 - 10 * (no_title / n >= 0.1)::INT - 10 * (no_title / n > 0.3)::INT - 10 * (no_desc / n >= 0.1)::INT - 10 * (no_desc / n > 0.3)::INT - 5 * (no_h1 / n >= 0.1)::INT - 10 * (no_h1 / n > 0.3)::INT
        - 5 * (broken_pages > 0)::INT - 10 * (broken_pages > 10)::INT - 5 * (noindex_pages / n > 0.3)::INT) AS seo,
    greatest(0, 100 - 5 * (avg_load > 1000)::INT - 10 * (avg_load > 2000)::INT - 5 * (p90 > 2000)::INT - 10 * (p90 > 3000)::INT - 5 * (slow > 0)::INT - 5 * (slow > 3)::INT - 10 * (vslow > 0)::INT - 5 * (kb > 1024)::INT - 10 * (kb > 2048)::INT) AS performance,
    greatest(0, 100 - 10 * (vthin / d > 0.1)::INT - 10 * (vthin / d > 0.3)::INT - 5 * (thinp / d > 0.2)::INT - 10 * (thinp / d > 0.4)::INT - 5 * (w < 200)::INT - 10 * (w < 100)::INT) AS c0,
    greatest(0, 100 - 15 * (nav = 0)::INT - 10 * (NOT footer)::INT - 5 * (bad_pages > 0)::INT - 10 * (bad_pages > 5)::INT - 5 * (deep > 0)::INT - 10 * (NOT https)::INT - 5 * (mixed > 0)::INT - 5 * (no_viewport_pages / n > 0.3)::INT) AS s0,
    0.5 * (CASE WHEN aw <= 0 THEN 0 WHEN aw < 100 THEN aw / 100 * 30 WHEN aw < 300 THEN 30 + (aw - 100) / 200 * 40 WHEN aw <= 2000 THEN 70 + (aw - 300) / 1700 * 30 ELSE 100 END)::DOUBLE + 0.3::DOUBLE * u
        + 0.2::DOUBLE * (headed / n * 60 + least(heads / n / 5, 1) * 40) AS depth,
    round(greatest(0, least(100, 0.4::DOUBLE * (CASE WHEN per < 0.5 THEN 0 WHEN per < 2 THEN per / 0.5 * 50 WHEN per < 5 THEN 50 + (per - 2) / 3 * 50 ELSE 100 END) + 0.3::DOUBLE * (linked / n * 100) + 0.3::DOUBLE * least(per / 10 * 100, 100))), 2) AS crawl,
    CASE WHEN n <= 5 AND nav = 0 THEN 'single_page' WHEN nav >= 5 THEN 'multi_section' WHEN nav > 0 THEN 'simple_nav' WHEN internal > n * 3 THEN 'implicit_content_links' WHEN n > 20 AND nav < 3 THEN 'app_style' ELSE 'none_detected' END AS nav_type FROM sc),
graded AS (SELECT *, round_even(0.7::DOUBLE * c0 + 0.3::DOUBLE * least(100, depth), 0)::INT AS content, round_even(0.8::DOUBLE * s0 + 0.2::DOUBLE * crawl, 0)::INT AS structure FROM parts),
issues AS (SELECT site, n AS pages, unnest(['missing_title', 'missing_description', 'missing_h1', 'noindex', 'very_thin_content', 'thin_content', 'low_text_catalog', 'low_average_words', 'slow_average', 'slow_p90', 'very_slow_pages', 'slow_pages', 'heavy_page', 'no_modern_images',
        'no_navigation', 'no_footer_contact', 'deep_urls', 'http_only', 'mixed_content', 'no_viewport', 'broken_links', 'error_pages']) AS issue,
    unnest(['seo', 'seo', 'seo', 'seo', 'content', 'content', 'content', 'content', 'performance', 'performance', 'performance', 'performance', 'performance', 'performance', 'structure', 'structure', 'structure', 'structure', 'structure', 'structure', 'structure', 'structure']) AS category,
    unnest([no_title, no_desc, no_h1, noindex_pages, vthin, thinp, low_text, n * (w < 200 AND important > 0)::INT, n * (avg_load > 2000)::INT, n * (p90 > 3000)::INT, vslow, slow, n * (kb > 1500)::INT, n, n * (nav = 0)::INT, n * (NOT footer)::INT, CASE WHEN deep > n * 0.2 THEN deep ELSE 0 END,
        n * (http AND NOT https)::INT, CASE WHEN https THEN mixed ELSE 0 END, no_viewport_pages, broken_pages, bad_pages])::BIGINT AS affected,
    unnest([CASE WHEN no_title / n > 0.2 THEN 'high' ELSE 'medium' END, CASE WHEN no_desc / n > 0.2 THEN 'high' ELSE 'medium' END, CASE WHEN no_h1 / n > 0.1 THEN 'medium' ELSE 'low' END, 'medium', 'high', 'medium', 'low', 'low', 'high', 'high', 'high', 'medium', 'medium', 'low',
        'high', 'medium', 'low', 'high', 'medium', 'medium', CASE WHEN broken_links > 10 THEN 'high' ELSE 'medium' END, 'high']) AS severity FROM sc),
site_issues AS (SELECT * FROM issues WHERE affected > 0), main_site AS (SELECT site AS mine FROM ct ORDER BY n DESC, site LIMIT 1)"""

_WORDS_OF = r"string_split(trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), ' ')"
_PHRASES = rf"""nv AS (SELECT site, url, unnest(regexp_extract_all(regexp_extract(body, '(?s)<nav[^>]*>(.*?)</nav>', 1), '{_A}', 2)) AS raw FROM body),
located AS (SELECT site, url, 'title' AS place, 10 AS weight, title AS text FROM parsed UNION ALL SELECT site, url, tag, CASE tag WHEN 'h1' THEN 8 ELSE 6 END, text FROM headings WHERE tag IN ('h1', 'h2')
    UNION ALL SELECT site, url, 'slug', 5, regexp_replace(coalesce(list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '')[-1], ''), '\.[A-Za-z0-9]+$', '') FROM parsed
    UNION ALL SELECT site, url, 'nav', 7, {_plain('raw')} FROM nv),
win AS (SELECT site, url, place, weight, list_filter(w[i:i + n - 1], lambda x: NOT list_contains([{_quoted(STOPWORDS)}], x)) AS kept
    FROM (SELECT site, url, place, weight, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, {_WORDS_OF.format(x='text')} AS w FROM located), (SELECT unnest([2, 3]) AS n))),
phrases AS (SELECT site, url, place, weight, array_to_string(kept, ' ') AS phrase FROM win WHERE len(kept) >= 2 AND length(array_to_string(kept, ' ')) >= 4 AND NOT regexp_matches(array_to_string(kept, ' '), '^[0-9 ]+$')),
scored AS (SELECT site, phrase, count(DISTINCT url) AS pages, (sum(weight) + 3 * (count(DISTINCT url) >= 2)::INT + 2 * bool_or(place IN ('title', 'h1', 'h2'))::INT + (len(string_split(phrase, ' ')) = 3)::INT)::BIGINT AS score FROM phrases GROUP BY site, phrase)"""
_SERVICES = "service services solutions consulting support maintenance repair installation design development marketing advertising sales training education"

ORACLES = {
    "phrase_scores": f"{_P_}, {_PHRASES} SELECT * FROM scored",
    "phrase_scores_v2": f"""{_P_}, {_PHRASES} SELECT site, phrase, count(*) AS occurrences, count(*) FILTER (WHERE place <> 'slug') AS important, count(DISTINCT url) AS pages, 2 * count(*) FILTER (WHERE place <> 'slug') + count(*) AS score FROM phrases
        WHERE len(list_filter(string_split(phrase, ' '), lambda x: x NOT IN ('company', 'platform', 'service', 'services', 'solution', 'solutions', 'product', 'products', 'tools', 'tool', 'support', 'systems', 'business', 'team'))) > 0 GROUP BY site, phrase""",
    "comparison_tables": f"""{_ALL}, {_SIM_PAGES}, {_SCORES}, st AS (SELECT site, avg(load_time_ms) AS avg_load, median(load_time_ms) AS median_load, quantile_cont(load_time_ms, 0.9) AS p90_load, avg(content_length_bytes) / 1024 AS avg_kb, max(content_length_bytes) / 1024 AS max_kb,
            sum(words) AS words, avg(words) AS avg_words, sum(n_images) AS media, count(*) AS pages FROM flags GROUP BY site)
        SELECT unnest([{', '.join(["'score'"] * 5 + ["'performance'"] * 5 + ["'content'"] * 4)}]) AS section, unnest(['overall', 'performance', 'seo', 'content', 'structure', 'avg_load', 'median_load', 'p90_load', 'avg_kb', 'max_kb', 'words', 'avg_words', 'media', 'pages']) AS metric, g.site,
            unnest([round_even((seo + performance + content + structure) / 4, 0), performance, seo, content, structure, st.avg_load, median_load, p90_load, avg_kb, max_kb, words, avg_words, media, st.pages]::DOUBLE[]) AS value FROM graded g JOIN st ON st.site = g.site""",
    "issue_page_counts": f"""{_ALL}, {_SIM_PAGES}, {_SCORES}, st AS (SELECT site, avg(words) AS mean, count(*) FILTER (WHERE status >= 400) AS error_pages, count(*) FILTER (WHERE words > 600) AS long_form_pages FROM flags GROUP BY site)
        SELECT site, n AS pages, noindex_pages, no_viewport_pages, error_pages, long_form_pages, floor(n * (CASE WHEN mean >= 600 THEN 0.8 WHEN mean >= 300 THEN 0.4 WHEN mean > 0 THEN 0.1 ELSE 0 END)::DOUBLE)::BIGINT AS long_form_estimate, false AS no_robots, false AS no_sitemap FROM ct JOIN st USING (site)""",
    "rollup_services": f"""{_P_}, k AS (SELECT p.page_id, p.site, unnest(string_split('{_SERVICES}', ' ')) AS k, lower(pt.text) AS t FROM parsed p JOIN pt USING (page_id)),
        s AS (SELECT k.site, page_id, k, arg_min(h.text, h.pos) AS service FROM k JOIN headings h USING (page_id) WHERE contains(t, k) AND contains(lower(h.text), k) GROUP BY ALL)
        SELECT site, service, count(*) AS pages, least(1, count(*) / 10)::DOUBLE AS confidence, row_number() OVER (PARTITION BY site ORDER BY count(*) DESC, service)::INT AS rank FROM s GROUP BY site, service QUALIFY rank <= 10""",
    "site_scores": f"""{_ALL}, {_SIM_PAGES}, {_SCORES} SELECT site, n AS pages, seo::INT AS seo, performance::INT AS performance, least(100, depth) AS content_depth, crawl AS crawlability, nav_type, avg_load, no_h1, content, structure,
        round_even((seo + performance + content + structure) / 4, 0)::INT AS overall FROM graded""",
    "site_issues": f"{_ALL}, {_SIM_PAGES}, {_SCORES} SELECT * FROM site_issues",
    "top_issues": f"""{_ALL}, {_SIM_PAGES}, {_SCORES} SELECT *, row_number() OVER (PARTITION BY site ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, affected DESC, issue)::INT AS rank FROM site_issues QUALIFY rank <= 5""",
    "comparison_rows": f"""{_ALL}, {_SIM_PAGES}, {_SCORES}, m AS (SELECT site, nav_type, unnest(['overall', 'seo', 'performance', 'content', 'structure', 'avg_load', 'content_depth', 'crawlability', 'missing_h1', 'nav_type']) AS metric,
            unnest([round_even((seo + performance + content + structure) / 4, 0), seo, performance, content, structure, avg_load, least(100, depth), crawl, (no_h1 > 0)::INT, NULL]::DOUBLE[]) AS v, unnest([5, 3, 3, 3, 3, 200, 5, 10, 0.5, NULL]::DOUBLE[]) AS close FROM graded),
        j AS (SELECT o.site, o.metric, p.v AS primary_value, o.v AS competitor_value, p.v - o.v AS difference, CASE WHEN o.metric = 'nav_type' THEN p.nav_type ELSE '' END AS primary_name, CASE WHEN o.metric = 'nav_type' THEN o.nav_type ELSE '' END AS competitor_name, o.close,
            CASE WHEN o.metric IN ('avg_load', 'missing_h1') THEN o.v - p.v ELSE p.v - o.v END AS good, CASE WHEN o.metric = 'avg_load' THEN 1000 ELSE 10 END AS far FROM m p JOIN main_site ON p.site = mine JOIN m o ON o.metric = p.metric AND o.site <> p.site),
        d AS (SELECT *, CASE WHEN metric = 'nav_type' THEN CASE WHEN primary_name = competitor_name THEN 'neutral' ELSE 'different' END WHEN abs(good) <= close THEN 'neutral' WHEN good > 0 THEN 'better' ELSE 'worse' END AS direction FROM j WHERE metric <> 'missing_h1' OR difference <> 0)
        SELECT site, metric, primary_value, competitor_value, difference, primary_name, competitor_name, direction, CASE WHEN direction = 'neutral' THEN 'similar' WHEN abs(good) >= far AND metric <> 'nav_type' THEN 'much ' || direction ELSE direction END AS verdict FROM d""",
    "opportunities": f"""{_ALL}, {_SIM_PAGES}, {_SCORES}, st AS (SELECT site, sum(words) AS words, avg(words) AS avg_words, sum(n_images) AS media, count(*) FILTER (WHERE status >= 400) AS errors FROM flags GROUP BY site),
        a AS (SELECT g.*, st.*, round_even((seo + performance + g.content + g.structure) / 4, 0) AS overall FROM graded g JOIN st USING (site)), p AS (SELECT a.* FROM a JOIN main_site ON site = mine), o AS (SELECT a.* FROM a JOIN main_site ON site <> mine)
        SELECT p.site, x.opportunity FROM p, (SELECT unnest(['words_by_half', 'words_by_a_fifth', 'load', 'p90', 'overall', 'seo', 'performance', 'structure', 'avg_words', 'pages', 'media', 'errors', 'page_size']) AS opportunity, unnest(range(1, 14)) AS i) x
        WHERE [(SELECT bool_or(o.words > 1.5 * p.words) FROM o), (SELECT bool_or(o.words > 1.2 * p.words AND o.words <= 1.5 * p.words) FROM o), p.avg_load > 1.2 * (SELECT min(avg_load) FROM o), p.p90 > 1.3 * (SELECT min(p90) FROM o), p.overall < (SELECT max(overall) FROM o) - 10,
            p.seo < (SELECT max(seo) FROM o) - 10, p.performance < (SELECT max(performance) FROM o) - 10, p.structure < (SELECT max(structure) FROM o) - 10, p.avg_words < 0.8 * (SELECT max(avg_words) FROM o), p.n < 0.7 * (SELECT max(n) FROM o), p.media < 0.7 * (SELECT max(media) FROM o),
            p.errors > (SELECT max(errors) FROM o), p.kb > 1.5 * (SELECT avg(kb) FROM o)][x.i]""",
    "extract_main_text": rf"""WITH a AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) AS site, regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS x FROM pages),
        b AS (SELECT page_id, site, unnest(x) AS raw, generate_subscripts(x, 1) AS i FROM a), c AS (SELECT page_id, i, {_plain('raw')} AS text FROM b WHERE {_plain('raw')} <> '')
        SELECT page_id, site, coalesce(string_agg(text, chr(10) ORDER BY i), '') AS main_text, coalesce(sum(len(string_split(text, ' '))), 0)::INT AS words, count(text)::INT AS blocks FROM a LEFT JOIN c USING (page_id) GROUP BY page_id, site""",
    "page_titles": f"""{_P_} SELECT page_id, url, CASE WHEN {_GOOD_TITLE.format(x='title')} THEN title WHEN h1 IS NOT NULL AND {_GOOD_TITLE.format(x='h1')} AND NOT ({_HOME} AND {_COMPANY.format(x='h1')}) THEN h1 WHEN {_HOME} THEN 'Home' ELSE '' END AS page_title,
        CASE WHEN {_GOOD_TITLE.format(x='title')} THEN 'title' WHEN h1 IS NOT NULL AND {_GOOD_TITLE.format(x='h1')} AND NOT ({_HOME} AND {_COMPANY.format(x='h1')}) THEN 'h1' WHEN {_HOME} THEN 'home' ELSE 'none' END AS origin FROM parsed""",
    "brands": f"""{_P_} SELECT site, nullif(title, '') AS name, NULL::VARCHAR AS logo, NULL::VARCHAR AS evidence FROM parsed QUALIFY row_number() OVER (PARTITION BY site ORDER BY {_HOME} DESC, length(url), title <> '' DESC, title DESC) = 1""",
    "issue_urls": f"{_ALL}, {_ISSUES} SELECT * FROM issue_urls",
    "issue_examples": f"""{_ALL}, {_ISSUES}, r AS (SELECT *, row_number() OVER (PARTITION BY site, issue ORDER BY url) AS i FROM issue_urls)
        SELECT site, issue, count(*) AS affected, string_agg(CASE WHEN i <= 3 THEN url || coalesce(' (' || note || ')', '') END, '; ' ORDER BY i) AS examples, greatest(count(*) - 3, 0) AS more FROM r GROUP BY ALL""",
    "near_duplicate_pairs": f"WITH {_SIM_DOCS} SELECT a.site, least(a.first, b.first) AS a, greatest(a.first, b.first) AS b, bit_count(xor(a.simhash, b.simhash))::INT AS distance FROM reps a JOIN reps b ON a.site IS NOT DISTINCT FROM b.site AND a.first < b.first AND {_NEAR.format(a='a.simhash', b='b.simhash')}",
    "near_duplicate_members": f"WITH {_SIM_DOCS} SELECT s.site, s.id, r.first FROM sim s JOIN reps r ON s.site IS NOT DISTINCT FROM r.site AND s.simhash = r.simhash",
    "dedup_greedy": f"""WITH RECURSIVE {_SIM_DOCS}, o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY id) AS i FROM sim),
        g AS (SELECT site, i, id, [simhash] AS held, true AS kept FROM o WHERE i = 1 UNION ALL
            SELECT site, i, id, CASE WHEN near THEN held ELSE list_append(held, simhash) END, NOT near FROM (SELECT o.*, g.held, len(list_filter(g.held, lambda k: {_NEAR.format(a='k', b='o.simhash')})) > 0 AS near FROM g JOIN o ON o.site IS NOT DISTINCT FROM g.site AND o.i = g.i + 1))
        SELECT site, id, kept FROM g""",
    "unique_content_ratio": f"""{_P_}, {_SIM_PAGES} SELECT site, sum(members)::BIGINT AS pages, count(*) FILTER (WHERE NOT later) AS unique_pages, count(*) FILTER (WHERE NOT later) / sum(members) * 100 AS unique_ratio
        FROM (SELECT *, EXISTS (SELECT 1 FROM reps b WHERE b.site = a.site AND b.first < a.first AND {_NEAR.format(a='a.simhash', b='b.simhash')}) AS later FROM reps a) GROUP BY site""",
    "truth_table": f"{_ALL}, {_CLAIMS} SELECT * FROM truth",
    "confident_claims": f"{_ALL}, {_CLAIMS} SELECT * FROM truth WHERE confidence > 0.5 AND confidence <= 0.8",
    "confidence_summary": f"""{_ALL}, {_CLAIMS} SELECT site, count(*) AS total, count(*) FILTER (WHERE confidence > 0.8) AS high, count(*) FILTER (WHERE confidence > 0.5 AND confidence <= 0.8) AS medium, count(*) FILTER (WHERE confidence <= 0.5) AS low,
        round(avg(confidence), 2) AS average, count(*) FILTER (WHERE NOT chosen) AS contradicted, count(*) FILTER (WHERE category = 'Business') AS business, count(*) FILTER (WHERE category = 'Assets') AS assets FROM truth GROUP BY site""",
    "override_page_type": f"""{_ALL}, {_OVERRIDES} SELECT p.page_id, coalesce(v.page_type, p.page_type) AS page_type, p.page_type AS inferred_type, strftime(v.set_at, '%Y-%m-%d') AS set_at, v.page_type IS NOT NULL AS overridden
        FROM (SELECT *, DATE '2024-01-15' AS run_at FROM flags) p ASOF LEFT JOIN valid v ON p.page_id = v.page_id AND p.run_at >= v.set_at""",
    "page_index": f"""{_ALL}, {_ARRIVALS}, l AS (SELECT run, page_id, arg_max(b, t) AS v, min(t) AS first, count(*) AS n FROM both_times b GROUP BY ALL)
        SELECT run, page_id, v.title AS title, v.path AS path, v.url AS url, v.status::INT AS status, v.words AS words, v.media AS media, v.load_time_ms AS load_time_ms, v.content_length_bytes AS content_length_bytes,
        CASE WHEN n = 1 THEN coalesce(v.page_type, 'generic') ELSE v.page_type END AS page_type, row_number() OVER (PARTITION BY run ORDER BY first, page_id)::INT AS position FROM l""",
    "recent_blocks": "SELECT user_id AS site, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS rank, event_id, ts, '/' || event_id AS url FROM events WHERE event_type = 'error' QUALIFY rank <= 10",
    "active_blocks": "SELECT user_id AS site, event_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3 DAYS PRECEDING AND CURRENT ROW) AS active FROM events WHERE event_type = 'error'",
    "site_stats": f"""{_ALL} SELECT site, count(*) AS pages, sum(words)::BIGINT AS words, avg(words) AS avg_words, sum(n_images)::BIGINT AS media, sum(n_links)::BIGINT AS links, sum(n_internal)::BIGINT AS internal_links,
        avg(load_time_ms) AS avg_load, median(load_time_ms) AS median_load, quantile_cont(load_time_ms, 0.9) AS p90_load, quantile_cont(load_time_ms, 0.95) AS p95_load, count(*) FILTER (WHERE load_time_ms > 1500) AS slow, count(*) FILTER (WHERE load_time_ms > 3000) AS very_slow,
        avg(content_length_bytes) / 1024 AS avg_kb, max(content_length_bytes) / 1024 AS max_kb, count(*) FILTER (WHERE bad) AS bad_pages, count(*) FILTER (WHERE status >= 400) AS error_pages, count(*) FILTER (WHERE missing_title) / count(*) AS missing_title, count(*) FILTER (WHERE missing_h1) / count(*) AS missing_h1 FROM flags GROUP BY site""",
    "url_functions": r"""SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) AS host, CASE WHEN p = '' THEN '/' ELSE p END AS path, len(list_filter(string_split(p, '/'), lambda s: s <> ''))::INT AS segments,
        split_part(url, '#', 1) AS light, left(md5(url), 12) AS pid FROM (SELECT *, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) AS p FROM pages)""",
    "parse_pages": f"{_P_} SELECT page_id, site, title, h1, description, words::INT AS words, n_links::INT AS n_links, n_internal::INT AS n_internal, n_images::INT AS n_images, nav_links::INT AS nav_links, n_paragraphs::INT AS n_paragraphs, n_headings::INT AS n_headings FROM parsed",
    "page_links": f"{_P_} SELECT site, url, pos::INT AS pos, href, label, kind FROM links",
    "page_headings": f"{_P_} SELECT site, url, pos::INT AS pos, tag, text FROM headings",
    "page_paragraphs": f"{_P_} SELECT site, url, pos::INT AS pos, text FROM paragraphs",
    "page_flags": f"{_ALL} SELECT page_id, page_type, cards::BIGINT AS cards, bad, missing_title, missing_description, missing_h1, noindex, no_viewport, mixed_content, deep_url, thin FROM flags",
    "page_type_breakdown": f"{_ALL} SELECT site, page_type, count(*) AS pages FROM flags GROUP BY ALL",
    "load_time_stats": f"""{_F} SELECT *, {_CONS.format(n='n', m='mean', s='stdev')} AS consistency FROM (SELECT site, avg(load_time_ms) AS mean, median(load_time_ms) AS median, quantile_cont(load_time_ms, 0.75) AS p75, quantile_cont(load_time_ms, 0.9) AS p90,
        min(load_time_ms)::DOUBLE AS min, max(load_time_ms)::DOUBLE AS max, coalesce(stddev_samp(load_time_ms), 0) AS stdev, count(*) AS n FROM flog WHERE status = 200 GROUP BY site)""",
    "sample_aggregate": f"{_F}, {_SAMPLES}, {_AGG.format(where='')} SELECT * FROM agg",
    "performance_summary": f"""{_F}, {_SAMPLES}, {_AGG.format(where='WHERE status = 200')} SELECT *, {_CONS.format(n='pages', m='mean', s='stdev')} AS consistency FROM (SELECT site, count(*) AS pages, avg(mean_load) AS mean, quantile_cont(mean_load, 0.9) AS p90,
        coalesce(stddev_samp(mean_load), 0) AS stdev, avg(mean_load) FILTER (WHERE render_mode = 'raw') AS raw_mean, avg(mean_load) FILTER (WHERE render_mode = 'js') AS js_mean,
        arg_min(url, (mean_load, url)) AS fastest, arg_max(url, (mean_load, url)) AS slowest FROM agg GROUP BY site)""",
    "status_histogram": f"{_F} SELECT site, status::VARCHAR AS status, count(*) AS pages FROM flog GROUP BY ALL",
    "overview_stats": f"""{_ALL} SELECT site, count(*) AS pages, count(*) FILTER (WHERE status = 200) AS ok, count(*) FILTER (WHERE status >= 400) AS failed, avg(load_time_ms) AS avg_load, min(load_time_ms) AS fastest, max(load_time_ms) AS slowest,
        count(*) FILTER (WHERE missing_title) AS no_title, count(*) FILTER (WHERE words < 50) AS few_words, count(*) FILTER (WHERE n_images = 0) AS no_media FROM flags GROUP BY site""",
    "error_rollup": f"{_F} SELECT site, status, errors, errors * 100 / pages AS rate FROM (SELECT site, status, count(*) AS errors FROM flog WHERE status IN (404, 410) OR status BETWEEN 500 AND 599 GROUP BY ALL) JOIN (SELECT site, count(*) AS pages FROM flog GROUP BY site) USING (site)",
    "block_pages": f"""{_F}, r AS (SELECT page_id, CASE WHEN status IN (403, 409, 423, 429, 503) THEN 'http_status_' || status WHEN regexp_matches(lower(left(html, 4096)), 'robot or human|are you a robot|bot detection|captcha|unusual traffic|access denied') THEN 'captcha_content' END AS reason
        FROM pages JOIN flog USING (page_id)) SELECT * FROM r WHERE reason IS NOT NULL""",
    "status_map": f"""{_F}, d AS (SELECT site, url, arg_max(CASE WHEN page_id % 6 = 0 THEN 301 WHEN page_id % 10 = 4 THEN 410 ELSE status END, page_id) AS status FROM flog WHERE page_id % 2 = 0 GROUP BY ALL)
        SELECT site, url, coalesce(d.status, i.status) AS status FROM (SELECT site, url, arg_max(status, page_id) AS status FROM flog GROUP BY ALL) i LEFT JOIN d USING (site, url)""",
    "crawl_quality": rf"""{_ALL}, fo AS (SELECT page_id, regexp_extract(html, '(?s)<footer[^>]*>(.*?)</footer>', 1) AS f FROM body), bl AS (SELECT site, count(*) AS n FROM bad_links GROUP BY site),
        q AS (SELECT site, count(*) AS pages_crawled, count(DISTINCT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1)) AS unique_paths, round_even(avg(load_time_ms), 0)::INT AS avg_load, round_even(quantile_cont(load_time_ms, 0.9), 0)::INT AS p90_load,
            count(*) FILTER (WHERE page_type = 'catalog') AS catalog_pages, count(*) FILTER (WHERE page_type = 'article') AS article_pages, count(*) FILTER (WHERE page_type = 'landing') AS landing_pages, count(*) FILTER (WHERE page_type = 'utility') AS utility_pages,
            count(*) FILTER (WHERE status = 404) AS pages_404, count(*) FILTER (WHERE thin IS NOT NULL AND page_type IN ('article', 'landing', 'generic')) AS thin_important, count(*) FILTER (WHERE thin IS NOT NULL AND page_type IN ('catalog', 'product')) AS thin_catalog,
            max(nav_links) > 0 AS nav_found, bool_or(regexp_matches(f, '<a\s[^>]*href|@[A-Za-z0-9-]+\.[A-Za-z]{{2,}}|[0-9]{{3}}\)?[-. ]?[0-9]{{3}}[-. ]?[0-9]{{4}}')) AS footer_found FROM flags JOIN fo USING (page_id) GROUP BY site)
        SELECT q.*, coalesce(n, 0) AS broken_links, pages_crawled - unique_paths AS duplicates, CASE WHEN pages_crawled < 10 OR NOT nav_found OR pages_404 / pages_crawled * 100 > 25 THEN 'BAD'
            WHEN thin_important / pages_crawled * 100 > 20 OR pages_crawled - unique_paths > pages_crawled * 0.1 OR (article_pages + landing_pages = 0 AND pages_crawled > 5) THEN 'WARNING' ELSE 'GOOD' END AS overall_health FROM q LEFT JOIN bl USING (site)""",
    "broken_internal_links": f"{_ALL} SELECT * FROM bad_links",
    "uncrawled_links": f"{_ALL} SELECT site, href, count(*) AS links FROM links WHERE kind = 'internal' AND href NOT IN (SELECT url FROM flog) GROUP BY ALL",
    "pages_with_broken": f"{_ALL} SELECT site, url FROM flog WHERE url IN (SELECT url FROM bad_links)",
    "link_degree": f"""{_ALL}, e AS (SELECT DISTINCT url AS src, href AS dst FROM links WHERE kind = 'internal' AND href <> url)
        SELECT DISTINCT site, url, (SELECT count(*) FROM e WHERE src = url) AS out_degree, (SELECT count(*) FROM e WHERE dst = url) AS in_degree FROM flog""",
    "nav_rollup": f"""{_P_}, n AS (SELECT site, href, count(*) AS frequency, arg_max(label, (url, pos)) AS label FROM links WHERE kind = 'internal' AND label <> '' GROUP BY ALL HAVING count(*) > 1)
        SELECT *, row_number() OVER (PARTITION BY site ORDER BY frequency DESC, href)::INT AS rank FROM n QUALIFY rank <= 20""",
    "exact_duplicates": "SELECT * FROM (SELECT sha1(coalesce(text, '')) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1) WHERE copies > 1",
    "simhash64": r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS w FROM documents),
        h AS (SELECT doc_id, w, count(*) AS n, ('0x' || right(md5(w), 16))::UBIGINT AS h FROM w GROUP BY ALL),
        v AS (SELECT doc_id, i, sum(CASE WHEN (h >> i::UBIGINT) & 1 = 1 THEN n ELSE -n END) AS s FROM h, (SELECT unnest(range(64)) AS i) GROUP BY ALL),
        b AS (SELECT doc_id, sum(CASE WHEN s > 0 THEN CASE WHEN i = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << i::INT) END ELSE 0 END)::BIGINT AS simhash FROM v GROUP BY doc_id)
        SELECT d.doc_id, coalesce(simhash, 0) AS simhash FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN b USING (doc_id)""",
    "rollup_emails": r"""SELECT source, count(DISTINCT email) AS emails, count(*) AS mentions FROM (SELECT source, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b', 0))) AS email FROM documents) GROUP BY source""",
    "rollup_wordcounts": f"""{_P_} SELECT site, CASE WHEN words < 100 THEN '0-99' WHEN words < 500 THEN '100-499' WHEN words < 1000 THEN '500-999' WHEN words < 2000 THEN '1000-1999' WHEN words < 5000 THEN '2000-4999' ELSE '5000+' END AS bucket,
        count(*) AS pages, avg(words) AS avg_words, min(words)::INT AS min_words, max(words)::INT AS max_words FROM parsed GROUP BY ALL""",
    "rollup_top_paths": f"""{_F}, p AS (SELECT site, array_to_string(string_split(url, '/')[1:4], '/') AS path, count(*) AS pages FROM flog GROUP BY ALL)
        SELECT site, path, pages, pages * 100 / sum(pages) OVER (PARTITION BY site) AS percent, row_number() OVER (PARTITION BY site ORDER BY pages DESC, path)::INT AS rank FROM p QUALIFY rank <= 20""",
    "business_profile": f"""{_P_}, t AS (SELECT site, title, count(*) AS n FROM parsed WHERE title <> '' GROUP BY ALL), b AS (SELECT site, arg_min(title, (-n, title)) AS name, max(n) AS name_pages FROM t GROUP BY site),
        s AS (SELECT site, array_to_string(list_sort(list(url))[1:3], ' ') AS sources FROM parsed GROUP BY site) SELECT site, sources, name, name_pages FROM s LEFT JOIN b USING (site)""",
    "nav_nodes": rf"""{_P_}, p AS (SELECT page_id, site, url, unnest(regexp_extract_all(nav, '<ul\b|</ul>|{_A}', 0)) AS piece, generate_subscripts(regexp_extract_all(nav, '<ul\b|</ul>|{_A}', 0), 1) - 1 AS pos
            FROM (SELECT *, regexp_extract(body, '(?s)<nav[^>]*>(.*?)</nav>', 1) AS nav FROM body)),
        d AS (SELECT *, CASE WHEN sum(CASE piece WHEN '<ul' THEN 1 WHEN '</ul>' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) > 1 THEN 2 ELSE 1 END AS level, regexp_extract(piece, '{_A}', 1) AS h, {_plain(f"regexp_extract(piece, '{_A}', 2)")} AS label FROM p),
        n AS (SELECT page_id, site, pos, level, split_part({_RESOLVE}, '#', 1) AS href, label FROM d WHERE starts_with(piece, '<a') AND {_NAV_LABEL})
        SELECT page_id, site, pos::INT AS pos, level, CASE WHEN level = 2 THEN last_value(CASE WHEN level = 1 THEN href END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos) END AS parent, href, label
        FROM n QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1""",
    "footer_contacts": rf"""{_P_}, f AS (SELECT page_id, site, {_plain("regexp_extract(body, '(?s)<footer[^>]*>(.*?)</footer>', 1)")} AS t FROM body)
        SELECT page_id, site, nullif(regexp_extract(t, '[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{{2,}}\b', 0), '') AS email,
        nullif(concat({', '.join(f"regexp_extract(t, '{_FOOTER_PHONE}', {i})" for i in (1, 2, 3, 4))}), '') AS phone FROM f""",
    "business_pages": f"{_P_}, {_KINDS} SELECT * FROM kinds",
    "extract_items": f"""{_P_}, {_KINDS} SELECT site, kind, left(md5(left(md5(f.url), 12) || '_' || f.text), 8) AS item_id, f.text AS title, 0.8::DOUBLE + CASE WHEN length(f.text) > 10 THEN 0.1::DOUBLE ELSE 0 END AS confidence, f.url AS url
        FROM (SELECT site, kind, min({{'url': url, 'pos': pos, 'text': text}}) AS f FROM headings JOIN kinds USING (site, url)
            WHERE kind IN ('service', 'product', 'menu') AND length(text) >= 3 AND lower(text) NOT IN ('home', 'about', 'contact') GROUP BY site, kind, lower(text))""",
    "extract_policies": f"""{_P_} SELECT site, url, title, CASE WHEN contains(s, 'privacy') THEN 'privacy' WHEN contains(s, 'terms') THEN 'terms' ELSE 'policy' END AS policy, 0.8::DOUBLE AS confidence
        FROM (SELECT *, lower(url || chr(10) || title) AS s FROM parsed) WHERE regexp_matches(s, 'privacy|terms|policy|legal|disclaimer')""",
    "primary_nav_guess": f"""{_P_} SELECT site, CASE WHEN title = '' THEN upper(left(s[1], 1)) || lower(substr(s[1], 2)) ELSE title END AS label, url, row_number() OVER (PARTITION BY site ORDER BY url)::INT AS rank
        FROM (SELECT *, list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM parsed) WHERE len(s) = 1 QUALIFY rank <= 7""",
    "single_word_scores": rf"""{_P_}, t AS (SELECT site, 3 AS weight, title AS text FROM parsed UNION ALL SELECT site, CASE tag WHEN 'h1' THEN 2 ELSE 1 END, text FROM headings WHERE tag IN ('h1', 'h2')),
        w AS (SELECT site, weight, unnest(string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), ' ')) AS w FROM t),
        s AS (SELECT site, weight, CASE WHEN length(w) <= 3 THEN w {' '.join(f"WHEN ends_with(w, '{x}') AND length(w) > {len(x) + 2} THEN left(w, length(w) - {len(x)})" for x in SUFFIXES)} ELSE w END AS word
            FROM w WHERE length(w) > 2 AND w NOT IN ({_quoted(STOPWORDS)}))
        SELECT site, word, sum(weight)::BIGINT AS score, count(*) AS occurrences FROM s WHERE word NOT IN ({_quoted(GENERIC)}) GROUP BY ALL""",
    "extract_articles": f"""WITH {_ARTICLES} SELECT page_id, site_name, url, title, content, NULL::VARCHAR AS author, NULL::VARCHAR AS publish_date,
        CASE WHEN content = '' THEN 0 ELSE len(string_split(content, ' ')) END::INT AS word_count, title IS NOT NULL AND content <> '' AS success FROM articles""",
    "article_batch_summary": f"WITH {_ARTICLES} SELECT site_name, count(*) FILTER (WHERE title IS NOT NULL AND content <> '') AS successful, count(*) AS total FROM articles GROUP BY 1",
    "bandwidth_adjusted_load": f"{_F} SELECT page_id, load_time_ms + content_length_bytes * 8 / 5000000.0::DOUBLE * 1000 AS load_ms FROM flog",
    "progress_counts": "SELECT user_id AS site, count(*) AS visited, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id",
    "load_time_windows": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, user_id AS site, count(*) AS n, avg(value) AS mean_load, max(value) AS max_load FROM events GROUP BY ALL",
}
ORACLES["focus_keywords"] = f"""WITH ones AS ({ORACLES["single_word_scores"]}), phr AS ({ORACLES["phrase_scores"]}),
    c AS (SELECT site, phrase, pages, score, 0 AS single FROM phr UNION ALL SELECT site, word, 0, score, 1 FROM
        (SELECT * FROM ones QUALIFY row_number() OVER (PARTITION BY site ORDER BY score DESC, word) <= 40) WHERE length(word) >= 3 AND NOT regexp_matches(word, '^[0-9]+$'))
    SELECT site, phrase, pages, score, row_number() OVER (PARTITION BY site ORDER BY single, score DESC, pages DESC, phrase)::INT AS rank FROM c QUALIFY rank <= 20"""
ORACLES |= site_oracles(_PARSED, _RESOLVE)
