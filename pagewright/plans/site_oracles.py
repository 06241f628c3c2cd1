"""DuckDB SQL for queries over media, documents and the link graph of sites; words and patterns are written here anew."""

from __future__ import annotations

#: How deep and how many pages of a site a crawl goes.
_DEPTH, _PAGES = 5, 400


def _attribute(name: str) -> str:
    return f"""regexp_extract(t, '(?:^|\\s){name}="([^"]*)"', 1)"""


def _pixels(name: str) -> str:
    return f"try_cast(nullif(regexp_extract({_attribute(name)}, '^\\s*([0-9]{{1,6}})(?:px)?$', 1), '') AS INTEGER)"


_EDGES = "edges AS (SELECT site, url AS src, href AS dst, min(pos) AS pos FROM links WHERE kind = 'internal' AND href <> url GROUP BY ALL)"
_STARTS = "starts AS (SELECT site, min(split_part(url, '#', 1)) AS url FROM body GROUP BY site)"
_WALK = f"""{_EDGES}, {_STARTS}, walk AS (SELECT site, url, 0 AS depth FROM starts UNION
    SELECT w.site, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.site = w.site AND e.src = w.url WHERE w.depth < {_DEPTH}),
reached AS (SELECT site, url, min(depth)::INT AS depth FROM walk GROUP BY ALL)"""


def _level(k: int) -> str:
    """Pages that the queue meets first at depth k, behind those of the levels before."""
    return f"""found{k} AS (SELECT e.site, e.dst AS url, min(l.position * 1000000000 + e.pos) AS came FROM level{k - 1} l JOIN edges e ON e.site = l.site AND e.src = l.url GROUP BY ALL),
new{k} AS (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY came, url) AS rank FROM found{k} ANTI JOIN seen{k - 1} USING (site, url)),
level{k} AS (SELECT n.site, n.url, {k} AS depth, n.rank + s.so_far AS position FROM new{k} n JOIN (SELECT site, max(position) AS so_far FROM seen{k - 1} GROUP BY 1) s USING (site) WHERE n.rank + s.so_far <= {_PAGES}),
seen{k} AS (FROM seen{k - 1} UNION ALL FROM level{k})"""


_HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)"
#: The parts of an address, phone patterns, kinds of streets.
_EMAIL = r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b"
_STREET = r"(?i)[0-9]+\s+[A-Za-z\s]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Way|Circle|Cir|Court|Ct)"
_PHONES = [
    r"\+?1?[-.\s]?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})",
    r"\+?[0-9]{1,4}[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,4}",
    r"\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}",
]
_DIGITS = [f"list_transform(regexp_extract_all(text, '{p}', 0), lambda x: regexp_replace(x, '[^0-9+]', '', 'g'))" for p in _PHONES]


def site_oracles(parsed: str, resolve: str) -> dict[str, str]:
    """``parsed``: the common table expressions of parsed pages; ``resolve``: target ``h`` of a page ``url`` as an absolute URL."""
    p = f"WITH {parsed}"
    images = rf"""tags AS (SELECT site, url, unnest(regexp_extract_all(body, '<img\s([^>]*)>', 1)) AS t, generate_subscripts(regexp_extract_all(body, '<img\s([^>]*)>', 1), 1) - 1 AS pos FROM body),
    shown AS (SELECT site, url, pos, {_attribute('src')} AS h, {_attribute('alt')} AS alt, {_pixels('width')} AS width, {_pixels('height')} AS height FROM tags WHERE {_attribute('src')} <> ''),
    images AS (SELECT site, url, img_url, min(pos)::INT AS pos, arg_min(alt, pos) AS alt, min(struct_pack(pos := pos, w := width)).w AS width, min(struct_pack(pos := pos, h := height)).h AS height,
        regexp_matches(lower(img_url), '\.gif([?#]|$)') AS gif FROM (SELECT *, {resolve} AS img_url FROM shown) GROUP BY site, url, img_url)"""
    return {
        "page_images": f"{p}, {images} SELECT * FROM images",
        "rollup_images": f"{p}, {images} SELECT site, count(*) AS images, count(DISTINCT img_url) AS distinct_images, count(*) FILTER (WHERE trim(alt) = '') AS no_alt FROM images GROUP BY site",
        "image_domains": f"""{p}, {images} SELECT *, row_number() OVER (PARTITION BY site ORDER BY images DESC, domain)::INT AS rank FROM (SELECT site,
            coalesce(nullif(lower({_HOST.replace('(url', '(img_url')}), ''), 'unknown') AS domain, count(*) AS images FROM images GROUP BY ALL) QUALIFY rank <= 10""",
        "media_roles": f"""{p}, {images}, one AS (SELECT site, lower(img_url) AS i, arg_min(lower(alt), (url, pos)) AS a FROM images GROUP BY site, img_url)
            SELECT site, CASE WHEN regexp_matches(i, 'logo') THEN 'logo' WHEN regexp_matches(i, 'hero|banner|header') THEN 'hero' WHEN regexp_matches(i, 'team|staff|person') THEN 'team' WHEN regexp_matches(i, 'product|service') THEN 'product'
                WHEN regexp_matches(a, 'logo|brand') THEN 'logo' WHEN regexp_matches(a, 'hero|banner|header') THEN 'hero' WHEN regexp_matches(a, 'team|staff|person') THEN 'team' WHEN regexp_matches(a, 'product|service') THEN 'product'
                ELSE 'content' END AS role, count(*) AS images FROM one GROUP BY ALL""",
        "page_videos": rf"""{p}, tags AS (SELECT site, url, unnest(regexp_extract_all(body, '<(?:iframe|video)\b[^>]*>(?:\s*<source\s[^>]*>)?', 0)) AS t, generate_subscripts(regexp_extract_all(body, '<(?:iframe|video)\b[^>]*>(?:\s*<source\s[^>]*>)?', 0), 1) AS i FROM body),
            v AS (SELECT site, url, i, regexp_extract(t, '\ssrc="([^"]*)"', 1) AS h, CASE WHEN starts_with(t, '<iframe') THEN 'embed' ELSE 'mp4' END AS kind FROM tags),
            n AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY i) - 1 AS pos FROM v WHERE h <> '')
            SELECT site, url, {resolve} AS video_url, min(pos)::INT AS pos, arg_min(kind, pos) AS kind FROM n GROUP BY ALL""",
        "page_jsonld": rf"""{p}, j AS (SELECT site, url, unnest(regexp_extract_all(html, '<script[^>]*type="application/ld\+json"[^>]*>([^<]*)</script>', 1)) AS p,
                generate_subscripts(regexp_extract_all(html, '<script[^>]*type="application/ld\+json"[^>]*>([^<]*)</script>', 1), 1) - 1 AS pos FROM body)
            SELECT site, url, pos::INT AS pos, CASE WHEN json_valid(p) THEN json_extract_string(p, '$."@type"') END AS type, trim(p) AS payload FROM j WHERE json_valid(p)""",
        "hero_content": f"""{p}, {images}, best AS (SELECT url, arg_min({resolve}, (-coalesce(width, 0) * coalesce(height, 0), pos)) AS image FROM (SELECT url, h, pos, width::BIGINT AS width, height FROM shown) GROUP BY url),
            hh AS (SELECT page_id, arg_min(text, pos) AS any_head, arg_min(text, pos) FILTER (WHERE tag = 'h1') AS h1 FROM headings GROUP BY 1),
            pp AS (SELECT page_id, string_agg(text, chr(10) ORDER BY pos) AS text FROM paragraphs WHERE pos < 2 GROUP BY 1)
            SELECT b.site, b.url, coalesce(hh.h1, any_head, '') AS heading, coalesce(pp.text, '') AS text, image FROM body b LEFT JOIN hh USING (page_id) LEFT JOIN pp USING (page_id) LEFT JOIN best ON best.url = b.url""",
        "page_files": rf"""{p} SELECT site, url, href, type, CASE WHEN label = '' THEN 'Download ' || upper(type) ELSE label END AS label
            FROM (SELECT *, regexp_extract(lower(href), '\.(pdf|doc|docx|xls|xlsx|csv|txt|zip|rar)$', 1) AS type FROM links) WHERE type <> ''""",
        "social_links": f"""{p} SELECT DISTINCT site, url, CASE {' '.join(f"WHEN contains(lower(href), '{d}') THEN '{p}'" for p, d in (('facebook', 'facebook.com'), ('twitter', 'twitter.com'), ('x', '//x.com'), ('instagram', 'instagram.com'),
            ('linkedin', 'linkedin.com'), ('youtube', 'youtube.com'), ('tiktok', 'tiktok.com'), ('pinterest', 'pinterest.com'), ('github', 'github.com')))} END AS platform, href FROM links WHERE platform IS NOT NULL""",
        "extract_faqs": f"{p} SELECT site, url, text, 0.6::DOUBLE AS confidence FROM headings WHERE contains(text, '?') AND length(text) > 10",
        "rollup_content_types": rf"""WITH t AS (SELECT lower({_HOST}) AS site, lower(regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '\.([A-Za-z0-9]+)$', 1)) AS x FROM pages),
            c AS (SELECT site, CASE WHEN x IN ('pdf', 'docx', 'json', 'csv') THEN x WHEN x IN ('png', 'jpg', 'jpeg', 'gif', 'webp', 'svg') THEN 'image' WHEN x = 'txt' THEN 'text' ELSE 'html' END AS content_type, count(*) AS pages FROM t GROUP BY ALL)
            SELECT *, pages * 100 / sum(pages) OVER (PARTITION BY site) AS percent, row_number() OVER (PARTITION BY site ORDER BY pages DESC, content_type) = 1 AS most_common FROM c""",
        "rollup_contacts": rf"""WITH found AS (SELECT source, list_distinct(regexp_extract_all(text, '{_EMAIL}', 0)) AS e,
                list_distinct(list_filter(list_transform({_DIGITS[0]}, lambda x: right(x, 10)) || {_DIGITS[1]} || {_DIGITS[2]}, lambda x: length(x) >= 10)) AS p,
                list_distinct(regexp_extract_all(text, '{_STREET}', 0) || regexp_extract_all(text, '{_STREET},\s*[A-Za-z\s]+,\s*[A-Z]{{2}}\s+[0-9]{{5}}', 0)) AS a FROM documents),
            v AS (SELECT source, 'email' AS kind, unnest(e) AS value FROM found UNION ALL SELECT source, 'phone', unnest(p) FROM found UNION ALL SELECT source, 'address', unnest(a) FROM found)
            SELECT source, kind, count(DISTINCT value) AS distinct_values, count(*) AS mentions FROM v GROUP BY ALL""",
        "json_profile": """SELECT event_id AS id, CASE WHEN props IS NULL OR NOT json_valid(props) THEN 'invalid' WHEN json_type(props) = 'OBJECT' THEN 'object' WHEN json_type(props) = 'ARRAY' THEN 'array' ELSE 'scalar' END AS kind,
            length(props)::INT AS size, coalesce(CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN array_to_string(json_keys(props)[1:5], ',') END, '') AS first_keys FROM events""",
        "reachable_within": f"WITH RECURSIVE {parsed}, {_WALK} SELECT * FROM reached",
        "follow_links": f"""WITH RECURSIVE {parsed}, {_WALK} SELECT l.site, l.url, l.pos::INT AS pos, l.href, r.depth, CASE WHEN depth > 3 THEN 0
            WHEN regexp_matches(lower(label), 'login|signup|register|advertisement|popup|cookie|privacy|terms|contact|about') THEN 0
            WHEN regexp_matches(lower(label), 'news|article|story|report|breaking|update|politics|world|business|sports|entertainment') THEN 2 ELSE 1 END AS priority FROM links l JOIN reached r USING (site, url)""",
        "crawl_order": f"""{p}, {_EDGES}, {_STARTS}, level0 AS (SELECT site, url, 0 AS depth, 1 AS position FROM starts), seen0 AS (FROM level0),
            {', '.join(_level(k) for k in range(1, _DEPTH + 1))} SELECT site, url, depth::INT AS depth, position::INT AS position FROM seen{_DEPTH}""",
    }
