"""DuckDB SQL of the registered queries, written from the URLs' shapes and not from the functions."""

from __future__ import annotations

_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
_PATH = "regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1)"
_SEARCH = "regexp_extract(url, '(\\?[^#]+)', 1)"
_HASH = "regexp_extract(url, '(#.+)$', 1)"
_ORIGIN = "regexp_extract(url, '^https?://[^/?#]+')"
_NO_HASH = "regexp_replace(url, '#.*$', '')"

_ORDER = """(SELECT o_orderkey, CASE o_orderkey % 8
  WHEN 0 THEN 'https://h' || o_orderkey || '.example/' || o_orderkey WHEN 1 THEN 'http://' WHEN 2 THEN '//h' || o_orderkey || '/x'
  WHEN 3 THEN 'mailto:u' || o_orderkey || '@example.com' WHEN 4 THEN 'http://exa mple' || o_orderkey || '/' WHEN 5 THEN 'http://1.2.3.' || (o_orderkey % 300)
  WHEN 6 THEN 'http://h:' || o_orderkey ELSE 'x' || o_orderkey END AS t FROM orders)"""
_VALID = "CASE o_orderkey % 8 WHEN 0 THEN true WHEN 3 THEN true WHEN 5 THEN o_orderkey % 300 < 256 WHEN 6 THEN o_orderkey < 65536 ELSE false END"
_VALID_BASE = "CASE o_orderkey % 8 WHEN 1 THEN false WHEN 4 THEN false WHEN 5 THEN o_orderkey % 300 < 256 WHEN 6 THEN o_orderkey < 65536 ELSE true END"


def _path_encoded(x: str) -> str:
    """What the path set leaves alone, after everything was encoded."""
    out = f"url_encode({x})"
    for c in "!$&'()*+,/:;=@[]|":
        out = f"replace({out}, '%{ord(c):02X}', '{c if c != chr(39) else chr(39) * 2}')"
    return f"replace({out}, '%25', '%')"


def _fragment_encoded(x: str) -> str:
    out = f"url_encode({x})"
    for c in "!#$&'()*+,/:;=?@[\\]^{|}":
        out = f"replace({out}, '%{ord(c):02X}', '{c if c != chr(39) else chr(39) * 2}')"
    return f"replace({out}, '%25', '%')"


def _nation(x: str) -> str:
    return f"n_name || '{x}'"


_PARAMS = "list_value(struct_pack(k := 'b', v := CAST(o_orderkey % 7 AS VARCHAR)), struct_pack(k := 'a', v := 'x y'), struct_pack(k := 'c', v := ''), struct_pack(k := 'a', v := 'A' || o_orderkey), struct_pack(k := '', v := 'e'), struct_pack(k := 'z', v := '%zz'))"

_LINES = f"""SELECT CASE WHEN {_VALID} THEN CASE o_orderkey % 8 WHEN 0 THEN 'h' || o_orderkey || '.example' WHEN 3 THEN '' WHEN 5 THEN '1.2.3.' || (o_orderkey % 300) ELSE 'h' || CASE WHEN o_orderkey = 80 THEN '' ELSE ':' || o_orderkey END END ELSE 'Invalid URL: ' || t END AS value, count(*) AS n
        FROM {_ORDER} GROUP BY 1"""

ORACLE_SQL: dict[str, str] = {
    "host_counts": f"SELECT {_HOST} AS hostname, count(*) AS n FROM pages GROUP BY 1",
    "url_components": f"""SELECT page_id, url AS href, split_part(url, ':', 1) || ':' AS protocol, '' AS username, '' AS password, {_HOST} AS host, {_HOST} AS hostname, '' AS port,
        {_PATH} AS pathname, {_SEARCH} AS search, {_HASH} AS hash, {_ORIGIN} AS origin FROM pages""",
    "url_struct": f"""SELECT page_id, url AS href, CASE split_part(url, ':', 1) WHEN 'http' THEN 0 ELSE 2 END AS scheme_type, 0 AS host_type, false AS has_opaque_path, {_HOST} AS raw_host,
        CASE WHEN {_SEARCH} <> '' THEN substr({_SEARCH}, 2) END AS raw_query, CASE WHEN {_HASH} <> '' THEN substr({_HASH}, 2) END AS raw_fragment FROM pages""",
    "url_offsets": f"""SELECT page_id, CAST(instr(url, ':') AS BIGINT) AS at_protocol_end, CAST(instr(url, ':') + 2 AS BIGINT) AS at_username_end, CAST(instr(url, ':') + 2 AS BIGINT) AS at_host_start,
        CAST(length({_ORIGIN}) AS BIGINT) AS at_host_end, CAST(-1 AS BIGINT) AS at_port, CAST(length({_ORIGIN}) AS BIGINT) AS at_pathname_start,
        CAST(instr(url, '?') - 1 AS BIGINT) AS at_search_start, CAST(instr(url, '#') - 1 AS BIGINT) AS at_hash_start, true AS consistent FROM pages""",
    "url_predicates": f"""SELECT page_id, true AS special, false AS credentials, true AS hostname, false AS empty_hostname, false AS has_port, contains(url, '?') AS has_search, contains(url, '#') AS has_hash,
        strlen(url) AS size, strlen({_PATH}) AS path_size, CASE WHEN url LIKE 'https:%' THEN 443 ELSE 80 END AS port_by_default, true AS dns_ok FROM pages""",
    "can_parse_filter": f"SELECT o_orderkey % 8 AS kind, {_VALID} AS valid, count(*) AS n FROM orders GROUP BY 1, 2",
    "can_parse_with_base": f"SELECT o_orderkey % 8 AS kind, {_VALID_BASE} AS valid, count(*) AS n FROM orders GROUP BY 1, 2",
    "invalid_urls": f"SELECT o_orderkey, t FROM {_ORDER} WHERE NOT ({_VALID})",
    "normalize_mixed": "SELECT c_custkey, 'http://Us%20er:P%40w@shop' || (c_custkey % 50) || '.example.com/a/c/%C3%A9?q=a%20b%27#x%20y%60' AS href FROM customer",
    "resolve_links": f"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1)) AS link, generate_subscripts(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1), 1) - 1 AS position FROM pages),
        p AS (SELECT *, split_part(link, '#', 1) AS before, CASE WHEN contains(link, '#') THEN substr(link, instr(link, '#') + 1) END AS fragment FROM l)
        SELECT page_id, position, link, {_ORIGIN} || {_path_encoded("split_part(before, '?', 1)")} || CASE WHEN contains(before, '?') THEN '?' || substr(before, instr(before, '?') + 1) ELSE '' END
          || CASE WHEN fragment IS NOT NULL THEN '#' || {_fragment_encoded("fragment")} ELSE '' END AS href FROM p""",
    "resolve_references": f"""WITH b AS (SELECT page_id, url, {_ORIGIN} AS o, {_PATH} AS p FROM pages), d AS (SELECT *, regexp_replace(p, '[^/]*$', '') AS folder FROM b),
        u AS (SELECT *, CASE WHEN folder = '/' THEN '/' ELSE regexp_replace(folder, '[^/]+/$', '') END AS up FROM d)
        SELECT page_id, 0 AS kind, o || up || 'up' AS href FROM u UNION ALL SELECT page_id, 1, o || p || '?only=query' FROM u UNION ALL SELECT page_id, 2, {_NO_HASH} || '#only-fragment' FROM u
        UNION ALL SELECT page_id, 3, split_part(url, ':', 1) || '://other.example/p' FROM u UNION ALL SELECT page_id, 4, o || folder || 'b' FROM u UNION ALL SELECT page_id, 5, o || folder || 'sub/x' FROM u
        UNION ALL SELECT page_id, 6, {_NO_HASH} FROM u UNION ALL SELECT page_id, 7, 'ftp://f.example/' FROM u""",
    "params_explode": f"""WITH q AS (SELECT page_id, string_split(substr({_SEARCH}, 2), '&') AS parts FROM pages WHERE {_SEARCH} <> '')
        SELECT page_id, i - 1 AS position, split_part(parts[i], '=', 1) AS key, split_part(parts[i], '=', 2) AS value FROM (SELECT page_id, parts, unnest(generate_series(1, len(parts))) AS i FROM q)""",
    "params_read": """SELECT o_orderkey, 6 AS n, 'x y' AS first_a, CAST(NULL AS VARCHAR) AS missing, 'x y|A' || o_orderkey AS all_a, true AS has_c, o_orderkey % 7 = 3 AS has_b3, 'b|a|c|a||z' AS keys,
        (o_orderkey % 7) || '|x y||A' || o_orderkey || '|e|%zz' AS vals FROM orders""",
    "params_edit": """SELECT o_orderkey, 'b=' || b || '&a=x+y&c=&a=A' || o_orderkey || '&=e&z=%25zz' AS written, 'b=' || b || '&a=new+value&c=&=e&z=%25zz' AS set_a,
        'b=' || b || '&a=x+y&c=&a=A' || o_orderkey || '&=e&z=%25zz&y=1' AS set_y, 'b=' || b || '&a=x+y&c=&a=A' || o_orderkey || '&=e&z=%25zz&b=%C3%A9' AS appended, 'b=' || b || '&c=&=e&z=%25zz' AS removed,
        'b=' || b || '&c=&a=A' || o_orderkey || '&=e&z=%25zz' AS removed_one, '=e&a=x+y&a=A' || o_orderkey || '&b=' || b || '&c=&z=%25zz' AS ordered FROM (SELECT o_orderkey, o_orderkey % 7 AS b FROM orders)""",
    "strip_tracking": f"""WITH q AS (SELECT page_id, url, {_SEARCH} AS s FROM pages), l AS (SELECT *, array_to_string(list_filter(string_split(substr(s, 2), '&'), lambda x: NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid|msclkid)(=|$)')), '&') AS kept FROM q)
        SELECT page_id, CASE WHEN s = '' OR kept = substr(s, 2) THEN url ELSE replace(url, s, CASE WHEN kept = '' THEN '' ELSE '?' || kept END) END AS href FROM l""",
    "canonical_dedup": "SELECT 'https://h' || (user_id % 10) || '.example/p/' || (event_id % 50) AS canonical, count(*) AS n_copies, min(event_id) AS event_id FROM events GROUP BY 1",
    "host_top": f"SELECT * FROM (SELECT {_HOST} AS hostname, page_id, row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) AS rank FROM pages) WHERE rank <= 2",
    "scheme_host_rollup": f"SELECT protocol, hostname, count(*) AS n, grouping(protocol, hostname) AS level FROM (SELECT split_part(url, ':', 1) || ':' AS protocol, {_HOST} AS hostname FROM pages) GROUP BY ROLLUP (protocol, hostname)",
    "hosts_allowed": f"SELECT page_id, url FROM pages WHERE NOT regexp_matches({_HOST}, 'spam|adult|pills')",
    "hosts_blocked": f"SELECT page_id, url FROM pages WHERE regexp_matches({_HOST}, 'spam|adult|pills')",
    "href_set_operations": f"""WITH a AS (SELECT DISTINCT {_HOST} AS hostname FROM pages WHERE url LIKE 'http:%'), b AS (SELECT DISTINCT {_HOST} AS hostname FROM pages WHERE url LIKE 'https:%')
        SELECT hostname, 'both' AS side FROM a WHERE hostname IN (SELECT hostname FROM b) UNION ALL SELECT hostname, 'plain' FROM a WHERE hostname NOT IN (SELECT hostname FROM b)
        UNION ALL SELECT hostname, 'secure' FROM b WHERE hostname NOT IN (SELECT hostname FROM a) UNION ALL SELECT hostname, 'any' FROM (SELECT * FROM a UNION SELECT * FROM b)""",
    "pattern_test": "SELECT page_id, regexp_matches(url, '^https?://[^/?#]*\\.example\\.[^./?#]+/(en|de)/[^?#]*') AS matches FROM pages",
    "pattern_exec": f"""SELECT page_id, regexp_extract({_HOST}, '^([^.]+)\\.', 1) AS sub, regexp_extract({_PATH}, '^/([^/]+)/', 1) AS lang, regexp_extract({_PATH}, '^/[^/]+/(\\d+)', 1) AS id, substr({_SEARCH}, 2) AS search
        FROM pages WHERE regexp_matches({_PATH}, '^/[^/]+/\\d+(\\.html)?/?$')""",
    "pattern_router": f"""SELECT page_id, 'english' AS pattern_id FROM pages WHERE {_PATH} LIKE '/en/%' UNION ALL SELECT page_id, 'secure' FROM pages WHERE url LIKE 'https://%'
        UNION ALL SELECT page_id, 'feed' FROM pages WHERE regexp_matches({_SEARCH}, '^\\?utm_source=.+$') UNION ALL SELECT page_id, 'top' FROM pages WHERE lower({_HASH}) = '#top'
        UNION ALL SELECT page_id, 'spam' FROM pages WHERE {_ORIGIN} = 'https://spam-farm.example.org' UNION ALL SELECT page_id, 'pills' FROM pages WHERE {_ORIGIN} = 'https://www.cheap-pills.example.com' AND regexp_matches({_PATH}, '^/[^/]+/.*$')""",
    "set_parts": f"""WITH p AS (SELECT page_id, url, split_part(url, ':', 1) AS s, {_HOST} AS h, substr(url, length({_ORIGIN}) + 1) AS r, {_PATH} AS p, {_SEARCH} AS q, {_HASH} AS f FROM pages)
        SELECT page_id, s || '://' || h || ':8080' || r AS with_port, s || '://new.example:99' || r AS with_host, s || '://xn--tda.example' || r AS with_hostname, 'ftp://' || h || r AS with_protocol, s || '://a%20b@' || h || r AS with_username,
          s || '://:p%3Aw@' || h || r AS with_password, s || '://' || h || '/y%20z' || q || f AS with_pathname, s || '://' || h || p || '?q=1%202' || f AS with_search, s || '://' || h || p || q || '#a%20b' AS with_hash FROM p""",
    "set_refused": """SELECT page_id, false AS ok_port, false AS ok_hostname, false AS ok_protocol, false AS ok_host, false AS ok_href, url AS href_port, url AS href_hostname, url AS href_protocol, url AS href_host, url AS href_href FROM pages""",
    "clear_parts": f"SELECT page_id, url AS no_port, replace(url, {_SEARCH}, '') AS no_search, {_NO_HASH} AS no_hash, {_NO_HASH} AS without_hash FROM pages",
    "percent_codecs": """SELECT n_nationkey, n_name || ' a/b?c=d&e~*''"<>`{}|^%C3%A9%41%zz+' AS c0_control, e || '%20a/b?c=d&e~*''%22%3C%3E%60{}|^%C3%A9%41%zz+' AS fragment, e || '%20a/b?c=d&e~*''%22%3C%3E`{}|^%C3%A9%41%zz+' AS query,
        e || '%20a/b?c=d&e~*%27%22%3C%3E`{}|^%C3%A9%41%zz+' AS special_query, e || '%20a/b%3Fc=d&e~*''%22%3C%3E%60%7B%7D|%5E%C3%A9%41%zz+' AS path, e || '%20a%2Fb%3Fc%3Dd&e~*''%22%3C%3E%60%7B%7D%7C%5E%C3%A9%41%zz+' AS userinfo,
        n_name || ' a%2Fb%3Fc%3Dd%26e%7E*%27%22%3C%3E%60%7B%7D%7C%5E%C3%A9%2541%25zz%2B' AS www_form, n_name || ' a/b?c=d&e~*''"<>`{}|^éA%zz+' AS decoded, replace(n_name, ' ', '+') || '+a%2Fb%3Fc%3Dd%26e%7E*%27%22%3C%3E%60%7B%7D%7C%5E%C3%A9%2541%25zz%2B' AS form,
        n_name || ' a/b?c=d&e~*''"<>`{}|^éA%zz ' AS from_form FROM (SELECT *, replace(n_name, ' ', '%20') AS e FROM nation)""",
    "ipv4_normalize": """WITH v AS (SELECT c_custkey, CAST((CAST(c_custkey AS HUGEINT) * 2654435761) % 4294967296 AS BIGINT) AS v FROM customer), d AS (SELECT *, (v // 16777216) || '.' || (v // 65536 % 256) || '.' || (v // 256 % 256) || '.' || (v % 256) AS a FROM v)
        SELECT c_custkey, a AS decimal, a AS hexadecimal, a AS octal, a AS two_parts, a AS direct, v AS back FROM d""",
    "ipv6_hosts": "SELECT s_suppkey, CASE WHEN s_suppkey = 0 THEN '[2001:db8::1]' ELSE '[2001:db8::' || lower(to_hex(s_suppkey)) || ':0:0:1]' END AS short, '[::ffff:102:' || lower(to_hex(768 + s_suppkey % 256)) || ']' AS mapped, CAST(NULL AS VARCHAR) AS wrong FROM supplier",
    "idna_domains": """SELECT r_regionkey, t.* FROM region, (VALUES (0, 'Bücher.Example', 'xn--bcher-kva.example', 'bücher.example'), (1, 'faß.de', 'xn--fa-hia.de', 'faß.de'), (2, 'xn--mnchen-3ya.de', 'xn--mnchen-3ya.de', 'münchen.de'),
        (3, '日本語。jp', 'xn--wgv71a119e.jp', '日本語.jp'), (4, 'EXAMPLE.com', 'example.com', 'example.com'), (5, 'ab' || chr(173) || 'c.de', 'abc.de', 'abc.de'), (6, 'a' || chr(8800) || 'b.com', 'xn--ab-miv.com', 'a' || chr(8800) || 'b.com'),
        (7, chr(768) || 'a.de', NULL, NULL), (8, 'xn--a', 'xn--a', 'xn--a'), (9, '%41.com', 'a.com', 'a.com')) t(i, domain, ascii, readable)""",
    "dns_lengths": """SELECT p_partkey, p_partkey % 70 BETWEEN 1 AND 63 AND p_partkey % 6 > 0 AND (p_partkey % 70) + 1 + greatest(0, 61 * (p_partkey % 6) - 1) + 4 <= 253 AS ok FROM part""",
    "file_urls": f"SELECT p_partkey, 'file:///data/' || {_path_encoded('p_brand')} || '/x%3F' || p_partkey || '%23' AS href FROM part",
    "opaque_urls": "SELECT c_custkey, 'data:text/plain, ' || c_mktsegment || ' %20?q#' || c_custkey AS href, 'text/plain, ' || c_mktsegment || ' %20' AS pathname, 'null' AS origin, true AS opaque FROM customer",
    "length_limit": "SELECT page_id, strlen(url) <= 40 AS fits, CASE WHEN strlen(url) <= 40 THEN url END AS href FROM pages",
    "line_parts": _LINES,
    "sql_functions": f"""SELECT page_id, {_HOST} AS hostname, true AS valid, {_PATH} AS pathname, CASE WHEN regexp_matches(url, '[?&]ref=') THEN regexp_extract(url, '[?&]ref=([^&#]*)', 1) END AS ref, 2 AS n_fixed FROM pages""",
    "window_hosts": "SELECT strftime(ts, '%Y-%m-%d') AS day, 'h' || (user_id % 5) || '.example' AS hostname, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_hosts": f"SELECT {_HOST} AS hostname, count(*) AS n FROM pages GROUP BY 1",
    "stream_windows": """WITH h AS (SELECT date_trunc('hour', ts) AS h, 'h' || (user_id % 5) || '.example' AS hostname, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT strftime(h, '%Y-%m-%d %H') AS hour, hostname, n FROM h WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)""",
    "approx_distinct_hosts": f"SELECT split_part(url, ':', 1) || ':' AS protocol, count(DISTINCT {_HOST}) AS n, true AS near FROM pages GROUP BY 1",
    "dump_and_diagram": f"""WITH p AS (SELECT page_id, url, {_SEARCH} AS s, {_HASH} AS f, length(url) AS n, instr(url, ':') AS a, instr(url, ':') + 2 AS h, length({_ORIGIN}) AS e, instr(url, '?') - 1 AS q, instr(url, '#') - 1 AS x, {_HOST} AS host, {_PATH} AS path FROM pages
        ), m AS (SELECT *, list_filter([a, h, e, q, x], lambda v: v >= 0) AS v FROM p
        ), l AS (SELECT *, [struct_pack(at := x, name := 'hash_start', number := ''), struct_pack(at := q, name := 'search_start', number := ' ' || q), struct_pack(at := e, name := 'pathname_start', number := ' ' || e), struct_pack(at := e, name := 'host_end', number := ' ' || e),
          struct_pack(at := h, name := 'host_start', number := ' ' || h), struct_pack(at := h, name := 'username_end', number := ' ' || h), struct_pack(at := a, name := 'protocol_end', number := ' ' || a)] AS rows FROM m)
        SELECT page_id, chr(123) || chr(10) || array_to_string(list_filter([chr(9) || '"buffer":"' || url || '"', chr(9) || '"protocol":"' || split_part(url, ':', 1) || ':"', chr(9) || '"host":"' || host || '"', chr(9) || '"path":"' || path || '"', chr(9) || '"opaque path":false',
          CASE WHEN q >= 0 THEN chr(9) || '"query":"' || s || '"' END, CASE WHEN x >= 0 THEN chr(9) || '"fragment":"' || f || '"' END, chr(9) || '"protocol_end":' || a, chr(9) || '"username_end":' || h, chr(9) || '"host_start":' || h, chr(9) || '"host_end":' || e,
          chr(9) || '"port":null', chr(9) || '"pathname_start":' || e, chr(9) || '"search_start":' || CASE WHEN q >= 0 THEN CAST(q AS VARCHAR) ELSE 'null' END, chr(9) || '"hash_start":' || CASE WHEN x >= 0 THEN CAST(x AS VARCHAR) ELSE 'null' END], lambda y: y IS NOT NULL), ',' || chr(10)) || chr(10) || chr(125) AS dump,
          url || ' [' || n || ' bytes]' || chr(10) || array_to_string(list_transform(generate_series(0, n - 1), lambda i: CASE WHEN list_contains(v, i) THEN '|' ELSE ' ' END), '') || chr(10)
          || array_to_string(list_transform(list_filter(rows, lambda r: r.at >= 0), lambda r: array_to_string(list_transform(generate_series(0, r.at - 1), lambda i: CASE WHEN list_contains(v, i) THEN '|' ELSE ' ' END), '') || '`' || repeat('-', n - r.at - 1) || ' ' || r.name || r.number || chr(10)), '')
          || CASE WHEN x < 0 THEN 'note: hash omitted' || chr(10) ELSE '' END || CASE WHEN q < 0 THEN 'note: search omitted' || chr(10) ELSE '' END AS diagram FROM l""",
    "files_of_lines": _LINES,
    "invalid_lines_report": f"""WITH r AS (SELECT CAST(sum(strlen(t)) AS BIGINT) AS n_bytes, count(*) AS n_lines, count(*) FILTER (NOT ({_VALID})) AS n_invalid FROM {_ORDER})
        SELECT 'Invalid URL: ' || t AS value, n_bytes, n_lines, n_invalid FROM {_ORDER}, r WHERE NOT ({_VALID})""",
    "dumped_lines": """SELECT 'http://h/' || n_nationkey || '?a=%27{}&b=%C3%A9\\#%3C%22%60' AS href, '#%3C%22%60' AS hash, false AS raw_tab FROM nation""",
    "url_credentials": """SELECT c_custkey, 'https://' || CASE k WHEN 1 THEN 'u@' WHEN 2 THEN 'u:p@' WHEN 3 THEN ':p@' ELSE '' END || 'h' || c_custkey || '/' AS href, k IN (1, 2, 3) AS any_of_them, k IN (1, 2) AS name, k IN (2, 3) AS password, k IN (2, 3) AS with_password
        FROM (SELECT c_custkey, c_custkey % 5 AS k FROM customer)""",
    "opaque_edits": """SELECT c_custkey, 'x' || c_custkey || ' %20' AS pathname, 'data:x' || c_custkey || ' %20' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '?q' END AS no_hash,
        'data:x' || c_custkey || ' %20' || CASE WHEN c_custkey % 2 = 0 THEN '#f' ELSE '' END AS no_search, 'data:x' || c_custkey || ' %20' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '?q' END AS empty_hash FROM customer""",
    "pattern_components": f"SELECT page_id, regexp_matches({_HOST}, '\\.example\\.[^.]+$') AND regexp_matches({_PATH}, '^/(en|de)/') AS matches FROM pages",
    "pattern_base": f"""SELECT page_id, {_ORIGIN} = 'https://spam-farm.example.org' AND {_PATH} LIKE '/en/%' AS beside, {_ORIGIN} = 'https://spam-farm.example.org' AND {_PATH} LIKE '/en/%' AS below FROM pages""",
    "pattern_structured": """SELECT o_orderkey, o_orderkey % 3 > 0 AS matches, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey AS VARCHAR) END AS n, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey || '/y%20z' END AS rest FROM orders""",
    "library_version": "SELECT r_regionkey, '0.1.0' AS version FROM region",
    "pattern_getters": """SELECT * FROM (VALUES (0, 'https', '*', '*', '*.example.com', '', '/books/:id(\\d+)', '*', '*', true), (1, '*', '*', '*', '*', '*', '/a{/b}?/*', '*', '*', false),
        (2, '*', '*', '*', '{*.}?x.org', '80', '*', '*', '*', false), (3, 'http', '*', '*', '*', '', '*', 'q=:q', '*', false), (4, 'http{s}?', '*', '*', 'h', '', '/p', ':a=b', '(x|y)+', true),
        (5, 'https', '*', '*', 'e.org', '', '/f/c/:d', '*', '*', false), (6, '*', '*', '*', 'xn--tda.de', '*', '/%C3%BC%20b', '*', '*', false)) t(i, protocol, username, password, hostname, port, pathname, search, hash, groups)""",
    "text_predicates": """WITH t(i, t) AS (VALUES (0, ''), (1, 'a' || chr(9) || 'b'), (2, 'é'), (3, 'a b'), (4, 'a%b'), (5, 'http'), (6, '9a'), (7, '123'), (8, '0xfF'), (9, 'beef'), (10, 'a.1'), (11, '1.2.3.4'), (12, '01.2.3.4'), (13, '1.2.3.256'), (14, '.'),
          (15, '%2E.'), (16, 'C:'), (17, 'c|'), (18, 'a-b.c')), b AS (SELECT *, string_split(t, '.') AS l FROM t)
        SELECT r_regionkey, i, array_to_string(list_transform([contains(t, chr(9)) OR contains(t, chr(10)) OR contains(t, chr(13)), strlen(t) = length(t), regexp_matches(t, '[\\x00\\t\\n\\r #/:<>?@\\[\\]\\\\^|]'),
          strlen(t) <> length(t) OR regexp_matches(t, '[\\x00-\\x20\\x7f#/:<>?@\\[\\]\\\\^|%]'), regexp_full_match(t, '[A-Za-z][A-Za-z0-9+.-]*'), t <> '' AND ltrim(t, '0123456789') = '', t <> '' AND ltrim(lower(t), '0123456789abcdef') = '',
          regexp_full_match(l[len(l)], '[0-9]+|0x[0-9a-f]*') OR l[len(l)] = '' AND len(l) > 1 AND regexp_full_match(l[len(l) - 1], '[0-9]+|0x[0-9a-f]*'),
          len(l) = 4 AND list_bool_and(list_transform(l, lambda x: coalesce(CAST(try_cast(x AS USMALLINT) AS VARCHAR) = x AND try_cast(x AS USMALLINT) < 256, false))),
          lower(replace(lower(t), '%2e', '.')) IN ('.', '..'), regexp_full_match(t, '[A-Za-z][:|]')], lambda x: CASE WHEN x THEN '1' ELSE '0' END), '') AS holds FROM region, b""",
}
