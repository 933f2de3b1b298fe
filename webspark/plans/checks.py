"""SQL checks of the registered queries, for DuckDB on the same tables.

The checks are written on their own: characters and list steps where the library uses patterns over
tokens, as-of joins where it uses windows, plain windows where it numbers in two levels.
"""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote

from webspark.functions.domains import BUILT_IN, BUILT_IN_RULES, SuffixRules
from webspark.plans import inputs
from webspark.plans.catalog import AS_OF, BODY_LIMIT, PAGE_DATA_TEXT, QUEUED_AT, SEED, SPARSE, bad_lines

UNRESERVED = "[A-Za-z0-9._~-]"
IN_PATH = r"[A-Za-z0-9._~:/@!$&''()*+,;=\[\]-]"
REFERENCE = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?:(//)([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)
USERINFO = "([A-Za-z0-9._~!$&''()*+,;=:-]|%[0-9A-Fa-f]{2})*"
HOST = r"(\[[0-9A-Fa-f:.%]*\]|([^\x00-\x20#%/:?@\[\\\]^`{|}\x7f]|%[89A-Fa-f][0-9A-Fa-f])*)"
IPV4 = r"((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)"


def ascii_name(host: str) -> str:
    """A host in ASCII after Python's own Unicode data and Punycode codec."""
    text = unquote(host.lower(), errors="replace").lower()
    wide = (unicodedata.normalize("NFKC", c) if unicodedata.east_asian_width(c) in "FH" else c for c in text)
    text = unicodedata.normalize("NFC", "".join(wide)).replace("\u3002", ".")
    if re.search(r"[\x00-\x20#%/:?@\[\\\]^`{|}\x7f\ufffd]", text):
        return host.lower()
    return ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in text.split("."))


def _foreign_hosts() -> list[str]:
    """Hosts of the URL forms that are not ASCII."""
    hosts = (f.split("//", 1)[-1].split("/")[0].split("@")[-1].split(":")[0] for f in inputs.URL_FORMS)
    return [h for h in hosts if not h.isascii() or "%C" in h]


def _ascii(host: str) -> str:
    """``host``, with or without port, in lower case and ASCII."""
    names = {h.lower(): ascii_name(h) for h in _foreign_hosts()}
    pairs = ", ".join(f"'{h}': '{n}'" for h, n in names.items())
    name = f"lower(regexp_replace({host}, ':[0-9]*$', ''))"
    return f"coalesce(MAP {{{pairs}}}[{name}] || regexp_extract({host}, ':[0-9]*$'), lower({host}))"


def _bad_escape(x: str) -> str:
    return (
        f"(len(regexp_extract_all({x}, '%')) <> len(regexp_extract_all({x}, '%[0-9A-Fa-f]{{2}}')))"
    )


def _recode(text: str, allowed: str, space: str) -> str:
    """Every character or escape of ``text`` in its tidy form."""
    return f"""array_to_string(list_transform(regexp_extract_all({text}, '(?s)%[0-9A-Fa-f]{{2}}|.'),
      lambda t: CASE
        WHEN len(t) = 3 THEN CASE
          WHEN coalesce(regexp_full_match(chr(TRY_CAST('0x' || t[2:] AS INT)), '{allowed}'), false)
            THEN chr(TRY_CAST('0x' || t[2:] AS INT))
          WHEN t = '%20' THEN '{space}' ELSE upper(t) END
        WHEN t = ' ' THEN '{space}'
        WHEN regexp_full_match(t, '{allowed}') THEN t
        ELSE url_encode(t) END), '')"""


def _bytes(text: str) -> str:
    return f"""array_to_string(list_transform(regexp_extract_all({text}, '(?s)%[0-9A-Fa-f]{{2}}|.'),
      lambda t: CASE WHEN len(t) = 3 THEN upper(t[2:]) WHEN t = '+' THEN '20' ELSE hex(t) END), '')"""


def _text(s: str, a: str, p: str, q: str) -> str:
    return f"""(CASE WHEN {s} <> '' THEN {s} || ':' ELSE '' END
      || CASE WHEN {a} <> '' OR ({s} <> '' AND starts_with({p}, '/')) THEN '//' || {a} ELSE '' END
      || {p} || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END)"""


def _url_steps(x: str, source: str, column: str) -> str:
    """Common table expressions that add to ``source`` the normal and canonical form of ``column``:
    {x}_ok, {x}_s, {x}_a, {x}_p, {x}_q, {x}_normal, {x}_canonical. The last one is named {x}."""
    query = f"""array_to_string(list_transform(list_sort(list_transform(
      list_filter(string_split({x}_q0, '&'),
        lambda y: y <> '' AND NOT contains(y, ';') AND NOT {_bad_escape('y')}),
      lambda y, i: {{'k': {_bytes("string_split(y, '=')[1]")}, 'i': i,
        't': {_recode("string_split(y, '=')[1]", f'({UNRESERVED}|[+])', '+')} || '=' ||
             {_recode("array_to_string(string_split(y, '=')[2:], '=')", f'({UNRESERVED}|[+])', '+')}
      }})), lambda z: z.t), '&')"""
    # An escaped plus sign must stay escaped in a query, unlike a plain one.
    query = query.replace(
        "regexp_full_match(chr(TRY_CAST('0x' || t[2:] AS INT)), '([A-Za-z0-9._~-]|[+])')",
        "regexp_full_match(chr(TRY_CAST('0x' || t[2:] AS INT)), '[A-Za-z0-9._~-]')",
    )
    return f"""
{x}1 AS (SELECT *, regexp_extract({column}, '{REFERENCE}', ['s','l','a','p','q','f']) AS {x}_m
  FROM {source}),
{x}2 AS (SELECT *, lower({x}_m.s) AS {x}_s0, {x}_m.q AS {x}_q0,
    CASE WHEN {x}_m.s = '' AND starts_with({column}, '///') THEN '' ELSE {x}_m.a END AS {x}_a0,
    CASE WHEN {x}_m.s = '' AND starts_with({column}, '///') THEN '//' || {x}_m.a || {x}_m.p
      ELSE {x}_m.p END AS {x}_p0 FROM {x}1),
{x}3 AS (SELECT *,
    {x}_s0 <> '' AND {x}_m.l = '' AND {x}_p0 <> '' AND NOT starts_with({x}_p0, '/') AS {x}_opaque,
    list_last(string_split({x}_a0, '@')) AS {x}_h0 FROM {x}2),
{x}4 AS (SELECT *,
    {column} IS NOT NULL AND NOT (regexp_matches({column}, '[\\x00-\\x1f\\x7f]')
      OR ({x}_s0 = '' AND {x}_m.l = '' AND contains(split_part({x}_p0, '/', 1), ':'))
      OR NOT regexp_full_match({x}_a0, '({USERINFO}(@{USERINFO})*@)?{HOST}(:[0-9]*)?')
      OR (NOT {x}_opaque AND {_bad_escape(f'{x}_p0')}) OR {_bad_escape(f'{x}_m.f')}) AS {x}_valid,
    left({x}_a0, len({x}_a0) - len({x}_h0)) || CASE
      WHEN {x}_s0 = 'http' AND ends_with({x}_h0, ':80') THEN {_ascii(f'{x}_h0[:-4]')}
      WHEN {x}_s0 = 'https' AND ends_with({x}_h0, ':443') THEN {_ascii(f'{x}_h0[:-5]')}
      ELSE {_ascii(f'{x}_h0')} END AS {x}_a,
    array_to_string(list_reduce(
      list_transform(string_split({_recode(f'{x}_p0', IN_PATH, '%20')}, '/'), lambda y: [y]),
      lambda acc, y: CASE WHEN y[1] = '.' THEN acc
        WHEN y[1] = '..' THEN acc[1:len(acc) - 1] ELSE list_concat(acc, y) END,
      []::VARCHAR[]), '/') AS {x}_dotless FROM {x}3),
{x}5 AS (SELECT *, CASE WHEN {x}_opaque THEN {x}_p0 ELSE
      regexp_replace(regexp_replace(CASE WHEN {x}_a0 <> '' AND {x}_p0 <> '' THEN '/' ELSE '' END
        || {x}_dotless, '/+', '/', 'g'), '/$', '') END AS {x}_p1 FROM {x}4),
{x}6 AS (SELECT *,
    {x}_s0 = '' AND {x}_a0 = '' AND contains(split_part({x}_p1, '/', 1), ':') AS {x}_again,
    regexp_extract({x}_p1, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS {x}_s1 FROM {x}5),
{x}7 AS (SELECT *, {x}_valid AND NOT ({x}_again AND {x}_s1 = '') AS {x}_ok,
    CASE WHEN {x}_again THEN lower({x}_s1) ELSE {x}_s0 END AS {x}_s,
    CASE WHEN {x}_again THEN {x}_p1[len({x}_s1) + 2:] ELSE {x}_p1 END AS {x}_p,
    {query} AS {x}_q FROM {x}6),
{x} AS (SELECT *,
    CASE WHEN {x}_ok THEN {_text(f'{x}_s0', f'{x}_a', f'{x}_p1', f'{x}_q0')} END AS {x}_normal,
    CASE WHEN {x}_ok THEN {_text(f'{x}_s', f'{x}_a', f'{x}_p', f'{x}_q')} END AS {x}_canonical
  FROM {x}7)"""


def _resolve_step(name: str, source: str, b: str, r: str) -> str:
    """Adds ``link`` and ``root``: {r} resolved on {b}, both made by :func:`_url_steps`."""
    text = _text(f"{r}_s", f"{r}_a", f"{r}_p", f"{r}_q")
    authority = f"CASE WHEN {r}_a <> '' THEN '//' || {r}_a ELSE '' END"
    return f"""
{name}1 AS (SELECT *, CASE
      WHEN {r}_p = '' THEN {b}_p WHEN starts_with({r}_p, '/') THEN {r}_p
      ELSE array_to_string(list_append(string_split({b}_p, '/')[:-2], {r}_p), '/') END AS {name}_p,
    CASE WHEN {r}_p = '' AND {r}_q = '' THEN {b}_q ELSE {r}_q END AS {name}_q FROM {source}),
{name} AS (SELECT *,
    CASE WHEN NOT {b}_ok OR NOT {r}_ok THEN NULL WHEN {r}_s <> '' THEN {text}
      WHEN {r}_a <> '' THEN {b}_s || ':' || {text}
      ELSE {b}_s || '://' || {b}_a
        || CASE WHEN {name}_p <> '' AND NOT starts_with({name}_p, '/') THEN '/' ELSE '' END
        || {name}_p || CASE WHEN {name}_q <> '' THEN '?' || {name}_q ELSE '' END END AS link,
    CASE WHEN NOT {b}_ok OR NOT {r}_ok THEN NULL WHEN {r}_s <> '' THEN {r}_s || ':' || {authority}
      WHEN {r}_a <> '' THEN {b}_s || ':' || {authority} ELSE {b}_s || '://' || {b}_a END AS root
  FROM {name}1)"""


def _forms() -> str:
    forms = ", ".join(inputs.forms_sql())
    return f"""
form0 AS (SELECT page_id, url AS base, split_part(url, ':', 1) AS scheme,
    regexp_extract(url, '//([^/?#]*)', 1) AS host,
    regexp_extract(url, '//[^/?#]*([^?#]*)', 1) AS path FROM pages),
form1 AS (SELECT page_id, base, [{forms}] AS us FROM form0),
forms AS (SELECT page_id, base, unnest(us) AS u, (generate_subscripts(us, 1) - 1)::INT AS form
  FROM form1)"""


# The list of :func:`inputs.suffix_list`, with rules in both forms.
LISTED = SuffixRules.parse(
    [*BUILT_IN_RULES.split(), *inputs.PRIVATE_RULES, *(ascii_name(r) for r in inputs.PRIVATE_RULES if not r.isascii())]
)


def _domain_step(name: str, source: str, host: str, listed: SuffixRules = BUILT_IN) -> str:
    """Adds ``effective``: public suffix and one label of ``host``, empty when there is none."""
    kinds = {"plain": listed.plain, "wild": listed.wildcard, "except": listed.exception}
    rules = ", ".join(f"('{r}', '{k}')" for k, rs in kinds.items() for r in sorted(rs))
    return f"""
{name}_rules(rule, kind) AS (VALUES {rules}),
{name}_hosts AS (SELECT DISTINCT {host} AS h, string_split({host}, '.') AS labels FROM {source}
  WHERE {host} IS NOT NULL),
{name}_found AS (SELECT h, labels, arg_max(size, (kind = 'except')::INT * 1000 + size) AS best,
    bool_or(kind = 'except') AS excepted
  FROM (SELECT h, labels, kind, len(string_split(rule, '.')) + (kind = 'wild')::INT AS size
    FROM {name}_hosts JOIN {name}_rules ON h = rule OR ends_with(h, '.' || rule))
  WHERE size <= len(labels) GROUP BY ALL),
{name}_domains AS (SELECT h, CASE
    WHEN h = '' OR list_contains(labels, '') OR len(labels) = 1 THEN ''
    WHEN len(labels) <= n THEN ''
    ELSE array_to_string(labels[len(labels) - n:], '.') END AS effective
  FROM (SELECT a.h, a.labels, coalesce(f.best - f.excepted::INT, 1) AS n
    FROM {name}_hosts a LEFT JOIN {name}_found f USING (h))),
{name} AS (SELECT s.*, d.effective FROM {source} s LEFT JOIN {name}_domains d ON s.{host} = d.h)"""


def _reasons(name: str, source: str, listed: SuffixRules = BUILT_IN) -> str:
    """Adds ``reason`` to a table with ``link``."""
    return f"""
{name}0 AS (SELECT *, regexp_extract(link, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS link_scheme,
    regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*@)?([^/?#]*)', 2) AS link_host
  FROM {source} WHERE link IS NOT NULL),{_domain_step(name + '1', name + '0', 'link_host', listed)},
{name} AS (SELECT *, CASE WHEN link_scheme NOT IN ('http', 'https') THEN 'scheme'
    WHEN effective = '' THEN 'empty_host' WHEN contains(link_host, ':') THEN 'port' END AS reason
  FROM {name}1)"""


def _hrefs() -> str:
    return r"""
tags AS (SELECT page_id, url, list_filter(regexp_extract_all(html,
    '(?is)<!--.*?-->|<(?:script\b.*?</script|style\b.*?</style|title\b.*?</title)\s*>|<[a-z/][^>]*>'),
    lambda t: regexp_matches(t, '(?is)^<a\s.*\shref\s*=|^<a\shref\s*=')) AS found FROM pages),
hrefs AS (SELECT page_id, url, (generate_subscripts(found, 1) - 1)::INT AS pos,
    replace(replace(replace(replace(replace(
      regexp_extract(unnest(found), '(?is)\shref\s*=\s*"([^"]*)"', 1),
      '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS href FROM tags)"""


def _links() -> str:
    """``links`` (page_id, url, pos, link, root), repeats included, no filter."""
    return (
        f"WITH {_hrefs()},{_url_steps('b', 'hrefs', 'url')},{_url_steps('r', 'b', 'href')},"
        f"{_resolve_step('z', 'r', 'b', 'r')},\nlinks AS (SELECT page_id, url, pos, link, root"
        " FROM z WHERE link IS NOT NULL)"
    )


def _kept(link: str) -> str:
    """``kept`` (page_id, url, link, first): links after dedup and filter."""
    return (
        f"{_links()},\ndistinct_links AS (SELECT page_id, url, {link} AS link, min(pos) AS first"
        f" FROM links GROUP BY ALL),{_reasons('kept0', 'distinct_links')},"
        "\nkept AS (SELECT page_id, url, link, first FROM kept0 WHERE reason IS NULL)"
    )


def _resolved_forms() -> str:
    return (
        f"WITH {_forms()},{_url_steps('b', 'forms', 'base')},{_url_steps('r', 'b', 'u')},"
        f"{_resolve_step('z', 'r', 'b', 'r')}"
    )


def _host_of_pages() -> str:
    return "regexp_extract(url, '//([^/?#]*)', 1)"


def _requests() -> str:
    return f"""
asked AS (SELECT page_id, url, {_host_of_pages()} AS host,
    CASE WHEN page_id % 11 = 0 THEN NULL ELSE '10.0.0.' || (page_id % 7) END AS ip,
    TIMESTAMP '{inputs.START}' + to_minutes(page_id * 2 + 11 + page_id % 17) AS asked_at
  FROM pages)"""


def _dns() -> str:
    return f"""
dns AS (SELECT {_host_of_pages()} AS host, page_id AS n,
    CASE WHEN page_id % 9 = 0 THEN NULL WHEN page_id % 15 = 0 THEN []::VARCHAR[]
      ELSE ['10.1.0.' || (page_id % 250), '10.2.0.1'] END AS ips,
    CASE WHEN page_id % 2 = 0 THEN 'c.' || {_host_of_pages()} ELSE '' END AS cname,
    TIMESTAMP '{inputs.START}' + to_minutes(page_id * 2) AS observed_at,
    CASE WHEN page_id % 9 = 0 THEN 'no such host' END AS error FROM pages)"""


SITE = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
PATH = "regexp_extract(url, '//[^/?#]*([^?#]*)', 1)"
# The rules of every robots file of the inputs, read by hand.
VERDICT = (
    f"CASE WHEN ends_with({SITE}, 'example.net') THEN starts_with(url, 'https') "
    f"WHEN regexp_matches({PATH}, '^/.*/4.*7$') THEN false "
    f"ELSE NOT starts_with({PATH}, '/en/') OR starts_with({PATH}, '/en/4') END"
)
ADDRESS = "coalesce(ip, '<nil>')"
ID = "('0x' || left(md5(url), 15))::BIGINT"
TLD = "regexp_extract(url, '//[^/?#]*?([a-z]+[.][a-z]+)(?:[/?#]|$)', 1)"


def _site_row(visited: str = "false", message: str = "''", queued_at: str = "NULL::VARCHAR") -> str:
    return (
        f"{ID} AS id, url, {visited} AS visited, {TLD} AS tld, {queued_at} AS queued_at, "
        f"false AS success, {message} AS message, NULL::VARCHAR AS ip, '' AS cname"
    )


KNOWN = "starts_with(url, 'https:')"
ENGLISH = "contains(url, '/en/')"


def _imported() -> str:
    return (
        f"{_kept('link')},\nbatch AS (SELECT link AS url FROM kept UNION ALL SELECT url FROM pages),"
        f"\nfresh AS (SELECT DISTINCT url FROM batch WHERE url NOT IN "
        f"(SELECT url FROM pages WHERE {KNOWN}))"
    )


def _records() -> str:
    return """
recs AS (SELECT url, true AS ok, '' AS msg, page_id * 2 + 1 AS seq FROM pages WHERE page_id % 5 <> 0
  UNION ALL SELECT url, false, 'failed: timeout ' || page_id, page_id * 2 FROM pages
    WHERE page_id % 5 = 0 OR page_id % 3 = 0),
last_recs AS (SELECT regexp_replace(url, '#.*$', '') AS url, arg_max(ok, seq) AS ok,
  arg_max(msg, seq) FILTER (NOT ok) AS msg FROM recs GROUP BY 1)"""


def checks() -> dict[str, str]:
    """Query name to SQL."""
    forms = f"WITH {_forms()}"
    norm = f"{forms},{_url_steps('x', 'forms', 'u')}"
    resolved = _resolved_forms()
    reasons = f"{resolved},{_reasons('y', 'z')}"
    ok_ip = "(SELECT string_split(v, chr(9)) AS f, * FROM lines)"
    raw_m = f"regexp_extract(u, '{REFERENCE}', ['s','l','a','p','q','f'])"
    authority = "CASE WHEN m.s = '' AND starts_with(u, '///') THEN '' ELSE m.a END"
    host = f"list_last(string_split({authority}, '@'))"
    site = f"""(CASE WHEN regexp_matches({host}, '[^\\x00-\\x7F]|%[89A-Fa-f]')
    THEN left({authority}, len({authority}) - len({host})) || {_ascii(host)} ELSE {authority} END)"""
    frontier0 = f"SELECT DISTINCT url FROM pages WHERE {KNOWN}"
    record_links = f"""{_kept('link')},
j AS (SELECT page_id, string_agg(link, ' ' ORDER BY first) AS links FROM kept GROUP BY page_id)
SELECT url, md5(CASE WHEN page_id % 5 = 0 THEN '' ELSE html END) AS body_md5, page_id % 5 <> 0 AS success,
  CASE WHEN page_id % 5 = 0 THEN '' ELSE coalesce(links, '') END AS links
FROM pages LEFT JOIN j USING (page_id)"""
    import_pages = f"""WITH {_records()},
known AS ({frontier0})
SELECT {ID} AS id, url, ok IS NOT NULL OR {ENGLISH} AS visited, {TLD} AS tld,
  CASE WHEN ok IS NULL THEN '{QUEUED_AT}' END AS queued_at, coalesce(ok, false) AS success,
  coalesce(msg, CASE WHEN url IN ({frontier0}) THEN 'failed: before' ELSE '' END) AS message,
  NULL::VARCHAR AS ip, '' AS cname FROM known FULL JOIN last_recs USING (url)"""
    import_resolutions = f"""WITH known AS (SELECT DISTINCT url FROM pages WHERE {KNOWN}),
res AS (SELECT regexp_replace(url, '[?].*$', '') AS url, max(page_id) AS n FROM pages GROUP BY 1)
SELECT {ID} AS id, url, {ENGLISH} AS visited, {TLD} AS tld, NULL::VARCHAR AS queued_at,
  false AS success, CASE WHEN n IS NULL THEN 'failed: before' WHEN n % 7 = 0 THEN 'no such host'
  ELSE '' END AS message, CASE WHEN n % 7 <> 0 THEN '10.3.0.' || (n % 250) END AS ip, '' AS cname
FROM known LEFT JOIN res USING (url)"""
    unmatched = f"""SELECT page_id AS seq, regexp_replace(url, '[?].*$', '') AS url,
  CASE WHEN page_id % 7 = 0 THEN '' ELSE '10.3.0.' || (page_id % 250) END AS ip
FROM pages WHERE regexp_replace(url, '[?].*$', '') NOT IN ({frontier0})"""
    return {
        "links_per_site": f"""{_kept('link')}
SELECT regexp_extract(link, '^([a-z]+://[^/?#]*)', 1) AS site, count(DISTINCT link) AS links
FROM kept GROUP BY 1""",
        "read_url_list": "SELECT url FROM pages",
        "numbered_urls": "SELECT (row_number() OVER (ORDER BY page_id) - 1) * 2 AS seq, url FROM pages",
        "fetch_order": f"""WITH {_requests()}
SELECT row_number() OVER (ORDER BY page_id) - 1 AS seq, url, {ADDRESS} AS address,
  row_number() OVER (PARTITION BY {ADDRESS} ORDER BY page_id) - 1 AS position,
  row_number() OVER (PARTITION BY {ADDRESS} ORDER BY page_id) - 1 AS start_after FROM asked""",
        "parse_fetch_hints": f"""WITH lines AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url
  WHEN 1 THEN url || chr(9) || '10.0.0.' || (page_id % 256) WHEN 2 THEN url || chr(9) || 'bad'
  WHEN 3 THEN url || chr(9) || '10.0.0.1' || chr(9) || 'z'
  ELSE url || chr(9) || '2001:db8::' || (page_id % 10) END AS v FROM pages)
SELECT page_id, CASE WHEN len(f) = 2 THEN f[1] ELSE v END AS url,
  CASE WHEN len(f) = 2 AND (regexp_full_match(f[2], '{IPV4}')
    OR regexp_full_match(f[2], '[0-9a-f:]*:[0-9a-f:]*')) THEN f[2] END AS ip FROM {ok_ip}""",
        "read_page_records": """SELECT 'record' AS kind, url AS text,
  md5(CASE WHEN page_id % 5 = 0 THEN '' ELSE html END) AS body_md5,
  CASE WHEN page_id % 5 = 0 THEN -1 ELSE 200 END::INT AS status_code,
  '2024-01-01 00:00:00' AS time, page_id % 5 <> 0 AS success,
  CASE WHEN page_id % 5 = 0 THEN 'failed: timeout' ELSE '' END AS message FROM pages
UNION ALL SELECT 'bad', unnest([""" + ", ".join(bad_lines("Data", PAGE_DATA_TEXT)) + """]), NULL, NULL, NULL, NULL, NULL
FROM pages""",
        "read_resolutions": """SELECT regexp_replace(url, '[?].*$', '') AS text,
  CASE WHEN page_id % 7 <> 0 THEN '10.3.0.' || (page_id % 250) END AS ip, '' AS cname,
  CASE WHEN page_id % 7 = 0 THEN 'no such host' ELSE '' END AS message
FROM pages
UNION ALL SELECT unnest([""" + ", ".join(bad_lines("Url", '"x"')) + """]), NULL, NULL, NULL FROM pages""",
        "page_record_json": """SELECT url, md5(CASE WHEN page_id % 5 = 0 THEN '' ELSE html END) AS body_md5,
  CASE WHEN page_id % 5 = 0 THEN -1 ELSE 200 END::INT AS status_code, page_id % 5 <> 0 AS success,
  CASE WHEN page_id % 5 = 0 THEN 'failed: timeout' ELSE '' END AS message, true AS null_links
FROM pages""",
        "page_records": f"""SELECT url, md5(html) AS body_md5, '{inputs.STAMP}' AS time,
  '200 OK' AS status, 200::INT AS status_code, 'HTTP/1.1' AS proto, true AS success, '' AS message
FROM pages""",
        "normalize_url": f"{norm}\nSELECT page_id, form, x_normal AS normal FROM x",
        "canonicalize_url": f"{norm}\nSELECT page_id, form, x_canonical AS canonical FROM x",
        "site_root": f"""{forms}, p AS (SELECT *, {raw_m} AS m FROM forms)
SELECT page_id, form, CASE WHEN m.s <> '' THEN lower(m.s) || ':' ELSE '' END
  || CASE WHEN {authority} <> '' THEN '//' || {site} ELSE '' END AS root FROM p""",
        "robots_url": f"""{forms}, p AS (SELECT *, {raw_m} AS m FROM forms)
SELECT page_id, form, CASE WHEN m.s <> '' THEN lower(m.s) || '://' || {site}
  WHEN {authority} <> '' THEN '//' || {site} ELSE '' END || '/robots.txt' AS robots FROM p""",
        "registered_domain": f"""{norm},
hosts AS (SELECT *, CASE WHEN x_ok THEN list_last(string_split(x_a, '@')) END AS x_host FROM x),
{_domain_step('dom', 'hosts', 'x_host')}
SELECT page_id, form, CASE WHEN regexp_full_match(x_host, '{IPV4}') THEN x_host ELSE effective END
  AS domain FROM dom""",
        "registered_domain_table": f"""{norm},
hosts AS (SELECT *, CASE WHEN x_ok THEN list_last(string_split(x_a, '@')) END AS x_host FROM x),
{_domain_step('dom', 'hosts', 'x_host', LISTED)}
SELECT page_id, form, CASE WHEN regexp_full_match(x_host, '{IPV4}') THEN x_host ELSE effective END
  AS domain FROM dom""",
        "resolve_reference": f"{resolved}\nSELECT page_id, form, link FROM z",
        "strip_query": f"""{norm}
SELECT page_id, form, split_part(x_normal, '?', 1) AS stripped FROM x WHERE x_normal IS NOT NULL""",
        "url_parts": f"""{forms}, p AS (SELECT *, {raw_m} AS m FROM forms),
h AS (SELECT *, {authority} AS authority, list_last(string_split({authority}, '@')) AS hp FROM p)
SELECT page_id, form, lower(m.s) AS scheme, authority,
  CASE WHEN contains(authority, '@') THEN left(authority, len(authority) - len(hp) - 1) ELSE '' END
    AS userinfo,
  regexp_replace(hp, ':[0-9]*$', '') AS host, regexp_extract(hp, ':([0-9]*)$', 1) AS port,
  m.p AS path, m.q AS query, m.f AS fragment FROM h""",
        "filter_scheme": f"""{reasons}
SELECT page_id, form, link FROM y WHERE reason IS DISTINCT FROM 'scheme'""",
        "filter_domain": f"{reasons}\nSELECT page_id, form, link FROM y WHERE effective <> ''",
        "filter_port": f"{reasons}\nSELECT page_id, form, link FROM y WHERE NOT contains(link_host, ':')",
        "filter_links": f"{reasons}\nSELECT page_id, form, link FROM y WHERE reason IS NULL",
        "filter_links_table": f"{resolved},{_reasons('y', 'z', LISTED)}\nSELECT page_id, form, link FROM y WHERE reason IS NULL",
        "reject_reasons": f"""{reasons}
SELECT coalesce(reason, 'kept') AS reason, count(*) AS links FROM y GROUP BY 1""",
        "extract_hrefs": f"WITH {_hrefs()}\nSELECT url, pos, href FROM hrefs",
        "resolve_links": f"{_links()}\nSELECT url, pos, link FROM links",
        "extract_links": f"{_kept('link')}\nSELECT url, link FROM kept",
        "extract_roots": f"{_kept('root')}\nSELECT url, link FROM kept",
        "page_dedup": f"""{_links()},
d AS (SELECT page_id, url, link, min(pos) AS first FROM links GROUP BY ALL)
SELECT url, (row_number() OVER (PARTITION BY page_id ORDER BY first) - 1)::INT AS pos, link FROM d""",
        "dedup_stats": f"""{_links()},
n AS (SELECT page_id, count(*) AS links, count(*) - count(DISTINCT link) AS removed FROM links
  GROUP BY page_id)
SELECT url, coalesce(links, 0) AS links, coalesce(removed, 0) AS removed
FROM pages LEFT JOIN n USING (page_id)""",
        "pages_with_links": f"""{_kept('link')},
j AS (SELECT page_id, string_agg(link, ' ' ORDER BY first) AS links FROM kept GROUP BY page_id)
SELECT page_id, url, coalesce(links, '') AS links FROM pages LEFT JOIN j USING (page_id)""",
        "record_links": record_links,
        "failed_records": """SELECT url, '' AS body, (-1)::INT AS status_code, true AS no_header,
  false AS success, 'failed: timeout' AS message FROM pages""",
        "limit_body": f"""WITH cut AS (SELECT page_id, html,
  list_max(list_filter(range(0, {BODY_LIMIT + 1}), lambda k: strlen(left(html, k)) <= {BODY_LIMIT}))
    AS k FROM pages)
SELECT page_id, left(html, k) || CASE WHEN strlen(html) > {BODY_LIMIT}
  THEN repeat(chr(65533), {BODY_LIMIT} - strlen(left(html, k))) ELSE '' END AS html FROM cut""",
        "apply_robots": f"""SELECT url,
  CASE WHEN NOT ({VERDICT}) THEN 'failed: Blocked by robots' END AS message FROM pages""",
        "robots_targets": f"""SELECT DISTINCT {SITE} AS site, {SITE} || '/robots.txt' AS robots_url
FROM pages""",
        "robots_rules": f"""WITH sites AS (SELECT DISTINCT {SITE} AS site FROM pages),
rules(kind, agent, pattern, allow) AS (VALUES (0, '*', '/en/', false), (0, '*', '/en/4', true),
  (0, '*', '/*/4*7$', false), (0, 'other', '/', false), (1, '*', '', true), (2, '*', NULL, false))
SELECT site, agent, pattern, allow FROM sites JOIN rules ON kind = CASE
  WHEN NOT ends_with(site, 'example.net') THEN 0 WHEN starts_with(site, 'https') THEN 1 ELSE 2 END""",
        "robots_allowed": f"SELECT url, {VERDICT} AS allowed FROM pages",
        "attach_address": f"""WITH {_requests()},{_dns()},
newest AS (SELECT * FROM dns QUALIFY row_number() OVER (PARTITION BY host ORDER BY n DESC) = 1)
SELECT page_id, url, CASE WHEN error IS NULL THEN ips[1] END AS ip,
  CASE WHEN error IS NULL THEN cname END AS cname,
  CASE WHEN error IS NOT NULL THEN error WHEN len(ips) = 0 THEN 'No results' ELSE '' END AS message
FROM asked LEFT JOIN newest USING (host)""",
        "address_asof": f"""WITH {_requests()},{_dns()},
good AS (SELECT * FROM dns WHERE error IS NULL AND len(ips) > 0),
answers AS (SELECT * FROM dns WHERE error IS NULL),
s1 AS (SELECT a.*, g.ips AS g_ips, g.cname AS g_cname, g.observed_at >= a.asked_at - INTERVAL 20 MINUTE AS g_hit
  FROM asked a ASOF LEFT JOIN good g ON a.host = g.host AND a.asked_at >= g.observed_at),
served AS (SELECT s1.page_id, s1.url, CASE WHEN g_hit THEN g_ips ELSE n.ips END AS ips,
    CASE WHEN g_hit THEN g_cname ELSE n.cname END AS cname,
    coalesce(g_hit, false) OR n.observed_at >= s1.asked_at - INTERVAL 20 MINUTE AS hit
  FROM s1 ASOF LEFT JOIN answers n ON s1.host = n.host AND s1.asked_at >= n.observed_at)
SELECT page_id, url, CASE WHEN hit THEN ips[1] END AS ip, CASE WHEN hit THEN cname END AS cname,
  CASE WHEN hit THEN CASE WHEN len(ips) = 0 THEN 'No results' ELSE '' END END AS message
FROM served""",
        "hosts_to_resolve": f"""WITH {_requests()},{_dns()}
SELECT DISTINCT host FROM asked WHERE host NOT IN (SELECT host FROM dns WHERE error IS NULL
  AND len(ips) > 0 AND observed_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 20 MINUTE
  AND TIMESTAMP '{AS_OF}')""",
        "group_by_address": f"""WITH {_requests()}
SELECT {ADDRESS} AS address, count(*) AS requests, min(page_id) AS first, max(page_id) AS last
FROM asked GROUP BY 1""",
        "run_batches": f"""WITH asked AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN NULL
  ELSE '10.0.0.' || ((page_id // 3) % 7) END AS ip FROM pages),
marked AS (SELECT page_id, ip, lag(ip) OVER (ORDER BY page_id) AS before FROM asked)
SELECT (page_id - 100) * {SPARSE} AS place, ip, (sum(CASE WHEN before IS NOT NULL AND ip IS DISTINCT FROM before THEN 1 ELSE 0
  END) OVER (ORDER BY page_id))::BIGINT AS batch FROM marked""",
        "politeness_plan": f"""WITH {_requests()}
SELECT (page_id - 100) * {SPARSE} AS place, url, {ADDRESS} AS address,
  row_number() OVER (PARTITION BY {ADDRESS} ORDER BY page_id) - 1 AS position,
  row_number() OVER (PARTITION BY {ADDRESS} ORDER BY page_id) - 1 AS start_after FROM asked""",
        "pending_stats": f"""WITH {_requests()}
SELECT {ADDRESS} AS address, count(*) AS pending FROM asked GROUP BY 1""",
        "pending_totals": f"""WITH {_requests()}
SELECT count(DISTINCT {ADDRESS}) AS workers, count(*) AS urls FROM asked""",
        "new_sites": f"SELECT {_site_row()} FROM pages",
        "import_links": f"""{_imported()}
SELECT {_site_row(ENGLISH)} FROM ({frontier0}) UNION ALL SELECT {_site_row()} FROM fresh""",
        "import_links_new": f"{_imported()}\nSELECT url FROM fresh",
        "import_links_filtered": f"{_imported()}\nSELECT url FROM fresh",
        "import_pages": import_pages,
        "import_pages_file": import_pages,
        "import_resolutions": import_resolutions,
        "import_resolutions_file": import_resolutions,
        "import_resolutions_unmatched": unmatched,
        "next_urls": f"""SELECT url FROM ({frontier0}) WHERE NOT {ENGLISH}
ORDER BY md5('{SEED}' || url), url LIMIT 10""",
        "mark_queued": f"""WITH listed AS (SELECT DISTINCT url FROM pages WHERE page_id % 10 <> 0)
SELECT {_site_row(ENGLISH, queued_at=f"CASE WHEN url IN (SELECT url FROM listed) THEN '{QUEUED_AT}' END")}
FROM ({frontier0})""",
        "mark_queued_requests": f"""WITH {_requests()}
SELECT url || chr(9) || coalesce(ip, '') AS value FROM asked""",
        "frontier_unique": f"""{_imported()}
SELECT url, count(*) AS rows FROM batch GROUP BY url HAVING count(*) > 1""",
        "frontier_store": f"""{_imported()},{_records()},
known AS ({frontier0} UNION ALL SELECT url FROM fresh)
SELECT {ID} AS id, url, ok IS NOT NULL OR ({KNOWN} AND {ENGLISH} AND url IN ({frontier0})) AS visited,
  {TLD} AS tld, NULL::VARCHAR AS queued_at, coalesce(ok, false) AS success,
  coalesce(msg, '') AS message, NULL::VARCHAR AS ip, '' AS cname
FROM known FULL JOIN last_recs USING (url) WHERE NOT starts_with(url, 'http:')""",
        "stream_extract": f"{_kept('link')}\nSELECT url, link FROM kept",
        "stream_frontier": f"""{_kept('link')},
known AS ({frontier0}),
fresh AS (SELECT DISTINCT link AS url FROM kept WHERE link NOT IN (SELECT url FROM known))
SELECT url, {ENGLISH} AS visited, {TLD} AS tld FROM known
UNION ALL SELECT url, false, {TLD} FROM fresh""",
        "stream_record_links": record_links,
        "stream_import_pages": import_pages,
        "stream_import_resolutions": f"""SELECT 'row' AS kind, url, ip, message FROM ({import_resolutions})
UNION ALL SELECT 'unmatched', url, ip, CASE WHEN seq % 7 = 0 THEN 'no such host' ELSE '' END FROM ({unmatched})""",
        "stream_mark_queued": f"""WITH {_requests()}
SELECT 'row' AS kind, url AS value FROM ({frontier0}) WHERE url IN (SELECT url FROM pages WHERE page_id % 10 <> 0)
UNION ALL SELECT 'request', url || chr(9) || coalesce(ip, '') FROM asked
UNION ALL SELECT 'short', 'short ' || url FROM pages""",
        "stream_dedup": f"{_kept('link')}\nSELECT DISTINCT link FROM kept",
        "stream_stats": f"""WITH {_requests()}
SELECT {ADDRESS} AS address, count(*) AS pending FROM asked GROUP BY 1""",
        "stream_address": f"""WITH {_requests()},{_dns()},
served AS (SELECT a.page_id, arg_max(g.ips, g.observed_at)[1] AS ip FROM asked a JOIN dns g
  ON a.host = g.host AND g.error IS NULL AND len(g.ips) > 0
  AND a.asked_at BETWEEN g.observed_at AND g.observed_at + INTERVAL 20 MINUTE GROUP BY a.page_id)
SELECT page_id, url, served.ip FROM asked LEFT JOIN served USING (page_id)""",
    }
