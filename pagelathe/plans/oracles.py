"""DuckDB SQL with the results of the named queries."""

from __future__ import annotations

# Fixed values. They are stated here again, apart from the engine, so that a wrong one there shows.
BLOCK_TAGS = ("a", "author", "div", "font", "h1", "h2", "h3", "h4", "h5", "h6", "map", "p", "span", "table", "tag", "time")
IGNORED = (
    "applet", "bdo", "button", "caption", "fieldset", "frameset", "iframe", "legend", "like", "like-box", "math", "menu", "noframes", "noscript",
    "object", "optgroup", "option", "plusone", "script", "select", "style", "svg", "textarea", "var", "xmp",
)
IGNORED_VOID = ("area", "base", "basefont", "input", "link", "param")
CLASS_TOKENS = (
    "menu", "widget", "nav", "top", "content", "breadcrumb", "block", "title", "button", "header", "ss", "post", "tag", "line", "foot", "para", "link", "published", "date",
    "modif", "article", "click", "body", "card", "timestamp", "comment", "meta", "alt", "time", "depth", "author", "tool", "keyword", "url", "name",
)
TAG_INDEX = ("div", "h1", "h2", "h3", "h4", "h5", "h6", "html", "p", "span", "table", "author")
NAME_WORDS = "author|name|publisher|contribute|label"
BYLINE_WORDS = "By |記者|編輯|eporte|文| and "
DATE_CHARACTERS = "[0-9一二三四五六七八九月年日]"
SENTENCE_MARKS = "[.。,，]"
SUFFIXES = ("co.jp", "co.uk", "com.au", "com.br", "com.tw", "org.uk")
ENTITIES = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))

_NAMES = "h[1-6]|" + "|".join(t for t in BLOCK_TAGS if t[0] != "h")
_WS = r"[ \t\n\r\f\x0B]+"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def unescape(e: str) -> str:
    for name, char in ENTITIES:
        e = f"replace({e}, {_q(name)}, {_q(char)})"
    return e


def _clean(e: str) -> str:
    e = f"regexp_replace({e}, '(?s)<!--.*?-->', '', 'g')"
    for tag in IGNORED:
        e = f"regexp_replace({e}, '(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>', ' ', 'g')"
    e = f"regexp_replace({e}, '(?i)<(?:{'|'.join(IGNORED_VOID)})(?:[\\s/][^>]*)?>', ' ', 'g')"
    return f"regexp_replace({e}, '<[!?][^>]*>', '', 'g')"


def blanks(e: str) -> str:
    return f"trim(regexp_replace({e}, '{_WS}', ' ', 'g'))"


def _visible(e: str) -> str:
    return blanks(unescape(f"regexp_replace({e}, '<[^>]*>', ' ', 'g')"))


def _pieces(e: str) -> str:
    return f"len(string_split_regex({e}, '[^A-Za-z0-9]+'))"


def _attribute(name: str) -> str:
    return f"""lower(array_to_string(regexp_extract_all(s, '(?i)<[a-z][^>]*?\\s{name}\\s*=\\s*["'']([^"'']*)["'']', 1), ' '))"""


# Pieces between block tags, with a sentinel before each tag; blocks are those with text.
_BLOCKS = f"""
WITH cut AS (
  SELECT page_id, string_split(regexp_replace({_clean('html')}, '(?i)<({_NAMES})([\\s/>])', chr(1) || '<\\1\\2', 'g'), chr(1)) AS ps FROM pages
), piece AS (
  SELECT page_id, unnest(ps) AS s, unnest(range(1, len(ps) + 1)) AS i FROM cut
), seen AS (
  SELECT page_id, i, s, {_visible('s')} AS text, lower(regexp_extract(s, '(?i)^<({_NAMES})[\\s/>]', 1)) AS start_tag FROM piece WHERE s <> ''
), tagged AS (
  SELECT *, (len(regexp_extract_all(s, '<[A-Za-z]')) - CASE WHEN start_tag = '' THEN 0 ELSE 1 END)::BIGINT AS tags, len(regexp_extract_all(s, '(?i)<a[\\s/>]'))::BIGINT AS anchors,
         count(*) FILTER (WHERE text <> '') OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp FROM seen
), b AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, s, text, start_tag, tags AS tagcount, anchors, {_attribute('id')} AS css_id, {_attribute('class')} AS css_class,
         coalesce((SELECT sum(e.tags) FROM tagged e WHERE e.page_id = t.page_id AND e.grp = t.grp AND e.text = ''), 0)::BIGINT AS since_last,
         1.0 / {_pieces('text')} AS link_density, ceil(strlen(text) / 80.0)::INT AS lines
  FROM tagged t WHERE text <> ''
), d AS (
  SELECT *, CASE WHEN lines <= 1 THEN {_pieces('text')}::DOUBLE
                 ELSE len(string_split_regex(array_to_string(list_transform(range((lines - 1) * 80), lambda k: CASE WHEN substr(hex(encode(text)), (2 * k + 1)::BIGINT, 1) IN ('2','3','4','5','6','7') THEN chr(('0x' || substr(hex(encode(text)), (2 * k + 1)::BIGINT, 2))::INT) ELSE '|' END), ''), '[^A-Za-z0-9]+'))::DOUBLE / (lines - 1) END AS text_density
  FROM b
)
"""
# Without the byte-exact density, which is costly
PLAIN = _BLOCKS[: _BLOCKS.index(", d AS (")] + "\n"
_HOST = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)"
_URL = f"""
  SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) AS scheme, lower({_HOST}) AS h,
         regexp_replace(regexp_extract(url, '^[^?#]*?://[^/?#]*([^?#]*)', 1), '/+', '/', 'g') AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query, regexp_extract(url, '(#.*)$', 1) AS fragment FROM pages
"""
_FILLED = "list_filter(string_split(query, '&'), lambda x: regexp_matches(x, '=.'))"
_NORMAL = f"""scheme || '://' || regexp_replace(h, ':(?:80|443)$', '') || path
  || CASE WHEN len({_FILLED}) = 0 THEN '' ELSE '?' || array_to_string(list_sort({_FILLED}), '&') END || CASE WHEN fragment = '#' THEN '' ELSE fragment END"""
_FLAGS = " || ".join(f"contains(css_class, '{t}')::INT::VARCHAR" for t in CLASS_TOKENS)
_CSS = "(CASE WHEN css_id = '' THEN '' ELSE css_id || ' ' END || CASE WHEN css_class = '' THEN '' ELSE css_class || ' ' END)"
_RATIO = "strlen(text) / greatest(tagcount, 1)::DOUBLE"
_SMOOTH = [0.00013383062461474178, 0.004431861620031266, 0.05399112742070441, 0.24197144565660075, 0.3989434693560978]
_TAPS = ", ".join(f"({k}, {_SMOOTH[4 - abs(k)]!r}::DOUBLE)" for k in range(-4, 5))
_WORDS = lambda c: f"string_split({blanks(f'lower({c})')}, ' ')"

ORACLES = {
    "page_clean_text": f"SELECT page_id, {_visible(_clean('html'))} AS text FROM pages",
    "blocks": PLAIN + "SELECT page_id, pos, text FROM b",
    "block_density": _BLOCKS + "SELECT page_id, pos, round(link_density::DOUBLE, 6) AS link_density, round(text_density, 6) AS text_density FROM d",
    "block_start_tags": PLAIN + "SELECT start_tag, count(*) AS n_blocks, count(DISTINCT page_id) AS n_pages FROM b GROUP BY 1",
    "block_tagcount": PLAIN + "SELECT page_id, pos, tagcount, since_last, anchors FROM b",
    "block_css": PLAIN + "SELECT page_id, pos, css_id, css_class FROM b",
    "css_flags": PLAIN + f"SELECT page_id, pos, {_FLAGS} AS flags FROM b",
    "text_flags": PLAIN + f"""SELECT page_id, pos, concat_ws(',', regexp_matches({_CSS}, '{NAME_WORDS}')::INT, regexp_matches(text, '{BYLINE_WORDS}')::INT,
        contains(text, '／')::INT, coalesce(list_position({list(TAG_INDEX)}, start_tag), 0), length({_CSS}), regexp_matches(text, '{DATE_CHARACTERS}')::INT,
        regexp_matches(text, '{SENTENCE_MARKS}')::INT, length(text)) AS numbers FROM b""",
    "density_neighbours": _BLOCKS + """SELECT page_id, pos, round(coalesce(lag(link_density) OVER w, 0)::DOUBLE, 6) AS prev_link, round(coalesce(lag(text_density) OVER w, 0), 6) AS prev_text,
        round(link_density::DOUBLE, 6) AS link, round(text_density, 6) AS text, round(coalesce(lead(link_density) OVER w, 0)::DOUBLE, 6) AS next_link, round(coalesce(lead(text_density) OVER w, 0), 6) AS next_text
        FROM d WINDOW w AS (PARTITION BY page_id ORDER BY pos)""",
    "tag_ratio_delta": PLAIN + f""", x AS (SELECT page_id, pos, {_RATIO} AS r FROM b)
        SELECT page_id, pos, round(r, 6) AS ratio, round(abs(coalesce(avg(r) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING),
               avg(r) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) - r), 6) AS delta FROM x""",
    "tag_ratio_smooth": PLAIN + f""", x AS (SELECT page_id, pos, {_RATIO} AS r, count(*) OVER (PARTITION BY page_id) AS n FROM b),
        y AS (SELECT *, abs(coalesce(avg(r) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), avg(r) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) - r) AS dx FROM x),
        taps AS (SELECT y.page_id, y.pos, w, ((y.pos + k) % (2 * n) + 2 * n) % (2 * n) AS p, n FROM y, (VALUES {_TAPS}) AS t(k, w))
        SELECT taps.page_id, taps.pos, round(sum(w * y.r), 5) AS ratio, round(sum(w * y.dx), 5) AS delta
        FROM taps JOIN y ON y.page_id = taps.page_id AND y.pos = CASE WHEN p < taps.n THEN p ELSE 2 * taps.n - 1 - p END GROUP BY ALL""",
    "dom_blocks": PLAIN + "SELECT page_id, pos, start_tag, text FROM b",
    "block_softmax": _BLOCKS + """, m AS (SELECT page_id, pos, exp(text_density / 10 - max(text_density / 10) OVER (PARTITION BY page_id)) AS e FROM d)
        SELECT page_id, pos, round(e / sum(e) OVER (PARTITION BY page_id), 6) AS p FROM m""",
    "topk_blocks": PLAIN + """, r AS (SELECT page_id, pos, strlen(text) AS bytes, row_number() OVER (PARTITION BY page_id ORDER BY strlen(text) DESC, pos) AS rank FROM b)
        SELECT page_id, pos, bytes, rank FROM r WHERE rank <= 3""",
    "page_content": PLAIN + """SELECT p.page_id, string_agg(b.text, chr(10) ORDER BY b.pos) FILTER (WHERE len(string_split(b.text, ' ')) >= 10) AS content FROM pages p LEFT JOIN b ON b.page_id = p.page_id GROUP BY 1""",
    "page_title": f"""WITH t AS (SELECT page_id, regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1\\s*>', 1) AS hs, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1) AS ti FROM pages),
        v AS (SELECT page_id, len(hs) AS n, {_visible("coalesce(hs[1], '')")} AS h1, {_visible('ti')} AS tt FROM t),
        c AS (SELECT *, regexp_extract(tt, '^(.+)\\s+[-|]\\s+.*$', 1) AS cut FROM v)
        SELECT page_id, CASE WHEN n = 1 AND h1 <> '' THEN h1 WHEN cut <> '' THEN cut WHEN tt <> '' THEN tt ELSE nullif(h1, '') END AS title FROM c""",
    "title_suffix_split": f"""WITH t AS (SELECT page_id, {_visible("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1)")} AS t FROM pages)
        SELECT page_id, regexp_extract(t, '^(.+)\\s+[-|]\\s+(.*)$', 1) AS head, regexp_extract(t, '^(.+)\\s+[-|]\\s+(.*)$', 2) AS site FROM t""",
    "url_host": f"""WITH h AS (SELECT page_id, nullif({_HOST}, '') AS host FROM pages), l AS (SELECT *, string_split(lower(regexp_replace(host, ':\\d+$', '')), '.') AS ls FROM h)
        SELECT page_id, host, CASE WHEN len(ls) > 2 AND array_to_string(ls[-2:], '.') IN {SUFFIXES} THEN array_to_string(ls[-3:], '.') ELSE array_to_string(ls[-2:], '.') END AS domain FROM l""",
    "url_normalized": f"WITH u AS ({_URL}) SELECT page_id, {_NORMAL} AS url FROM u",
    "url_valid": f"""SELECT page_id, regexp_matches(url, '^https?://') AND length({_HOST}) >= 5 AND NOT (starts_with({_HOST}, 'www.') AND length({_HOST}) < 8) AS valid FROM pages""",
    "url_date_override": """SELECT o_orderkey, make_date((2000 + o_orderkey % 25)::INT, (1 + o_orderkey % 12)::INT,
        least(1 + o_orderkey % 31, day(last_day(make_date((2000 + o_orderkey % 25)::INT, (1 + o_orderkey % 12)::INT, 1))))::INT) AS day FROM orders""",
    "entity_unescape": f"SELECT page_id, md5({unescape('html')}) AS digest, length({unescape('html')}) AS n_chars FROM pages",
    "whitespace_trim": f"SELECT doc_id, md5({blanks('text')}) AS digest, md5(nullif({blanks('text')}, '')) AS line FROM documents",
    "link_inventory": """WITH l AS (SELECT page_id, trim(unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1)), '"''') AS href FROM pages)
        SELECT href, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM l GROUP BY 1""",
    "tags_split": """WITH t AS (SELECT trim(unnest(string_split(replace(p_name, ' ', ','), ','))) AS tag FROM part) SELECT tag, count(*) AS n_parts FROM t WHERE tag <> '' GROUP BY 1""",
    "tags_normalized": """WITH t AS (SELECT p_partkey, regexp_replace(trim(regexp_replace(p_name || ', "' || p_brand || '", , (' || p_type || ')', '\\s+', ' ', 'g')), '["'']', '', 'g') AS t FROM part)
        SELECT p_partkey, array_to_string(list_filter(string_split(t, ', '), lambda x: x <> ''), ', ') AS tags FROM t""",
    "author_blacklist_anti": """SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM customer x WHERE x.c_acctbal < 0 AND lower(x.c_name) = lower(c.c_name))""",
    "author_filter": """SELECT s_suppkey, s_name || '; Writer ' || s_suppkey AS authors FROM supplier""",
    "meta_coalesce": "SELECT event_id, coalesce(json_extract_string(props, '$.page'), event_type) AS label FROM events",
    "json_props": "WITH k AS (SELECT unnest(json_keys(props)) AS key FROM events) SELECT key, count(*) AS n FROM k GROUP BY 1",
    "token_prf": f"""WITH x AS (SELECT doc_id, list_distinct({_WORDS('d.text')}) AS p, list_distinct({_WORDS('b.text')}) AS a FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id),
        r AS (SELECT doc_id, len(list_intersect(p, a)) / len(p)::DOUBLE AS p, len(list_intersect(p, a)) / len(a)::DOUBLE AS r FROM x)
        SELECT doc_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM r""",
    "token_prf_multiset": f"""WITH j AS (SELECT doc_id, {_WORDS('d.text')} AS p, {_WORDS('b.text')} AS a FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id),
        p AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(p) AS t FROM j) GROUP BY ALL), a AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(a) AS t FROM j) GROUP BY ALL),
        h AS (SELECT p.doc_id, sum(least(p.n, a.n)) AS h FROM p JOIN a ON p.doc_id = a.doc_id AND p.t = a.t GROUP BY 1),
        r AS (SELECT j.doc_id, coalesce(h.h, 0) / len(p)::DOUBLE AS p, coalesce(h.h, 0) / len(a)::DOUBLE AS r FROM j LEFT JOIN h ON h.doc_id = j.doc_id)
        SELECT doc_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM r""",
    "edit_distance": "SELECT n.n_nationkey, damerau_levenshtein(n.n_name, p.n_name) AS distance FROM nation n JOIN nation p ON p.n_nationkey = n.n_nationkey - 1",
    "author_normalize": "SELECT n_nationkey, 'Jane Doe; ' || upper(n_name[1]) || lower(regexp_extract(n_name, '^([A-Za-z]+)', 1))[2:] AS authors FROM nation",
    "boilerplate_lines": PLAIN + "SELECT text, count(*) AS n_blocks, count(DISTINCT page_id) AS n_pages FROM b GROUP BY 1 HAVING count(DISTINCT page_id) > 1",
    "lang_block_stats": "SELECT lang, source, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY ROLLUP (lang, source)",
    "doc_quality_features": "SELECT quality, lang, count(*) AS n_docs, round(avg(strlen(text)), 4) AS mean_bytes FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2",
    "host_pages": f"WITH u AS ({_URL}), n AS (SELECT {_HOST} AS host, page_id FROM pages), m AS (SELECT page_id, {_NORMAL} AS u FROM u) SELECT host, count(*) AS n_pages, count(DISTINCT u) AS n_urls FROM n JOIN m USING (page_id) GROUP BY 1",
}
