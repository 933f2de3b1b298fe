"""URL columns: split, normalise, canonicalise, resolve (RFC 3986), all as native expressions.

Public functions take the name of a text column, or SQL text of an expression, and return a column;
nothing here leaves the JVM. Text that is not a URL gives null, so callers drop it with
``isNotNull``. Functions that end in ``_sql`` return SQL text, to build larger expressions from.

Inside, a URL is worked on in three steps, each from a struct to a struct of
``(scheme, authority, path, query)`` with empty text for absent parts: :func:`raw_sql` splits,
:func:`normal_sql` normalises, :func:`canonical_sql` orders the query. A single URL goes through
them with :func:`let`, an array of URLs with :func:`each`.

A URL such as ``mailto:a@example.com`` has a scheme, no authority and a path that does not start
with a slash; it is never normalised beyond its scheme.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webspark.functions.binding import case, each, group, let, lit, matches, not_null, struct, sub, tokens
from webspark.functions.idna import ascii_authority_sql

# Character classes, escapes, default ports and patterns of the URL grammar.
PATH_LITERALS = r"A-Za-z0-9._~:/@!$&'()*+,;=\[\]\-"
UNRESERVED = r"A-Za-z0-9._~\-"
PATH_LITERAL_ESCAPE = (
    r"(?i)%(2[146789A-F]|3[0-9ABD]|40|4[1-9A-F]|5[0-9ABDF]|6[1-9A-F]|7[0-9AE])"
)
UNRESERVED_ESCAPE = r"(?i)%(2[DE]|3[0-9]|4[1-9A-F]|5[0-9AF]|6[1-9A-F]|7[0-9AE])"
BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
CONTROL = r"[\x00-\x1f\x7f]"
SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
# A text of three slashes without a scheme is a path; with a scheme it is an empty authority.
PARTS = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?"
    r"(?:(?://(?!/)|(?<=:)//)([^/?#]*))?"
    r"([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)
# What is not decoded when a URL is read: the query, and all but the fragment of mailto: and the like.
# Group 1 is the text before the query.
UNREAD = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:(?!/)[^#]*|([^?#]*)\?[^#]*)"
HOST_CHARACTER = r"(?:[^\x00-\x20#%/:?@\[\\\]^`{|}\x7f]|%[89A-Fa-f][0-9A-Fa-f])"
AUTHORITY = (
    r"^(?:[A-Za-z0-9._~!$&'()*+,;=:%@\-]*@)?"
    rf"(?:\[[0-9A-Fa-f:.%]*\]|{HOST_CHARACTER}*)"
    r"(?::[0-9]*)?$"
)
SITE_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?([^/?#@]*)"
DEFAULT_PORTS = {"http": "80", "https": "443"}
# A rooted path that is normal as it stands but for one trailing slash.
PLAIN_PATH = rf"^(?:/[{UNRESERVED}:@!$&'()*+,;=]*)*$"
DOT_OR_EMPTY_SEGMENT = r"(?:^|/)(?:\.|/)"


# A URL that is canonical as it stands but for one trailing slash: rooted path, lower-case host
# without port, no query, nothing to encode, no dot segment.
PLAIN_URL = (
    r"^(?:https?://[a-z0-9.\-]+)?"
    r"(?:/[A-Za-z0-9_~:@!$&'()*+,;=\-][A-Za-z0-9._~:@!$&'()*+,;=\-]*+)*+/?\z"
)


# --- splitting ---------------------------------------------------------------------------------


def raw_sql(url: str) -> str:
    """Struct of the text as written, scheme lower-cased, host in ASCII. A URL may not hold control characters
    nor, in path or fragment, malformed escapes.

    Most URLs are plain; one test finds them, cheap text functions split them, and ``done`` lets them
    pass the later steps as they are.
    """
    origin = f"if(startswith({url}, '/'), '', substring_index({url}, '/', 3))"
    plain = struct(
        scheme=f"if(startswith({url}, 'h'), substring_index({url}, ':', 1), '')",
        authority=f"substr({origin}, instr({origin}, '//') + 2)",
        path=f"trim(TRAILING '/' FROM substr({url}, length({origin}) + 1))",
        query="''",
        malformed="false",
        done="true",
    )
    parts = struct(
        scheme=f"lower({group(url, PARTS, 1)})",
        authority=ascii_authority_sql(group(url, PARTS, 2)),
        path=group(url, PARTS, 3),
        query=group(url, PARTS, 4),
        malformed=f"{matches(url, CONTROL)} OR {matches(sub(url, UNREAD, '$1'), BAD_ESCAPE)}",
        done="false",
    )
    return case((matches(url, PLAIN_URL), plain), default=parts)


def _host(authority: str) -> str:
    """Host with its port, without user information."""
    return f"substring_index({authority}, '@', -1)"


def url_parts(url: str) -> Column:
    """Struct (scheme, authority, userinfo, host, port, path, query, fragment) of any text.

    Parts are as written except for the lower-cased scheme; absent parts are empty. ``port`` has
    no colon.
    """
    authority = group(url, PARTS, 2)
    parts = struct(
        scheme=f"lower({group(url, PARTS, 1)})",
        authority=authority,
        userinfo=group(authority, r"^(.*)@"),
        host=sub(_host(authority), r":[0-9]*$", ""),
        port=group(_host(authority), r":([0-9]*)$"),
        path=group(url, PARTS, 3),
        query=group(url, PARTS, 4),
        fragment=group(url, PARTS, 5),
    )
    return F.expr(case((f"({url}) IS NOT NULL", parts)))


# --- normalising -------------------------------------------------------------------------------


def _is_opaque(p: str) -> str:
    return f"({p}.scheme != '' AND {p}.authority = '' AND {matches(f'{p}.path', '^[^/]')})"


def _colon_in_first_segment(p: str) -> str:
    return f"({p}.scheme = '' AND {p}.authority = '' AND {matches(f'{p}.path', '^[^/]*:')})"


def tidy_path_sql(path: str) -> str:
    """Upper-case escapes, undo the needless ones, escape what may not stand in a path.

    Works token by token on the bytes as escaped, so escapes that are not UTF-8 survive.
    """
    pattern = rf"(%[0-9A-Fa-f]{{2}}|[{PATH_LITERALS}]+|[^{PATH_LITERALS}%]+)"

    def token(t: str) -> str:
        return case(
            (matches(t, f"^[{PATH_LITERALS}]"), t),
            (matches(t, PATH_LITERAL_ESCAPE), f"decode(unhex(substr({t}, 2)), 'UTF-8')"),
            (f"startswith({t}, '%')", f"upper({t})"),
            default=f"replace(url_encode({t}), '+', '%20')",
        )

    return f"array_join({each(tokens(path, pattern), 'ws_t', token)}, '')"


def _normal_path(p: str) -> str:
    """``..`` at the top of a path removes its leading slash, which a host brings back."""
    segments = f"""aggregate(
        split({tidy_path_sql(f'{p}.path')}, '/'), cast(array() AS array<string>),
        (ws_acc, ws_s) -> CASE
            WHEN ws_s = '.' THEN ws_acc
            WHEN ws_s = '..' THEN slice(ws_acc, 1, greatest(size(ws_acc) - 1, 0))
            ELSE concat(ws_acc, array(ws_s)) END)"""
    rooted = f"concat(if({p}.authority != '', '/', ''), array_join({segments}, '/'))"
    plain = (
        f"{matches(f'{p}.path', PLAIN_PATH)} AND NOT {matches(f'{p}.path', DOT_OR_EMPTY_SEGMENT)}"
    )
    return sub(case((plain, f"{p}.path"), default=sub(rooted, "/{2,}", "/")), "/$", "")


def _normal_authority(p: str) -> str:
    """Lower-cased host without the default port of the scheme; user information as written."""
    ports = [(f"{p}.scheme = '{s}'", f"':{n}$'") for s, n in DEFAULT_PORTS.items()]
    port = case(*ports, default="''")
    return (
        f"concat({group(f'{p}.authority', '^(.*@)')}, "
        f"regexp_replace(lower({_host(f'{p}.authority')}), {port}, ''))"
    )


def normal_sql(p: str) -> str:
    """Struct of :func:`normalize_url` from the struct of :func:`raw_sql`."""
    valid = (
        f"NOT {p}.malformed AND NOT {_colon_in_first_segment(p)} "
        f"AND ({p}.authority = '' OR {matches(f'{p}.authority', AUTHORITY)})"
    )
    parts = struct(
        scheme=f"{p}.scheme",
        authority=f"if({p}.authority = '', '', {_normal_authority(p)})",
        path=f"if({p}.path = '' OR {_is_opaque(p)}, {p}.path, {_normal_path(p)})",
        query=f"{p}.query",
        done="false",
    )
    as_is = struct(**{f: f"{p}.{f}" for f in ("scheme", "authority", "path", "query", "done")})
    return case((f"{p}.done", as_is), (valid, parts))


def _is_readable(p: str) -> str:
    """A normal URL is read again as text: a colon that has surfaced in the first segment of a bare
    path (``./a:b``, ``a%3Ab``) now ends a scheme, or is an error when no scheme stands before it."""
    return (
        f"({p} IS NOT NULL AND "
        f"(NOT {_colon_in_first_segment(p)} OR {matches(f'{p}.path', SCHEME)}))"
    )


def compose_sql(p: str) -> str:
    """Text of a struct of parts (RFC 3986 section 5.3)."""
    slashes = f"{p}.authority != '' OR ({p}.scheme != '' AND startswith({p}.path, '/'))"
    return (
        f"concat({_scheme_prefix(p)}, if({slashes}, concat('//', {p}.authority), ''), "
        f"{p}.path, if({p}.query = '', '', concat('?', {p}.query)))"
    )


def _normal(url: str) -> str:
    return let(case((f"({url}) IS NOT NULL", raw_sql(url))), "ws_r", normal_sql)


def normalize_sql(url: str) -> str:
    return let(_normal(url), "ws_n", lambda p: case((_is_readable(p), compose_sql(p))))


def normalize_url(url: str) -> Column:
    """Lower-case scheme and host, tidy escapes of the path, drop the default port, dot segments,
    repeated slashes, one trailing slash, an empty query and the fragment. The query is untouched."""
    return F.expr(normalize_sql(url))


# --- canonical query ---------------------------------------------------------------------------


def _component(text: str) -> str:
    """A query key or value decoded and encoded again; null when an escape is malformed."""
    pattern = rf"(%[0-9A-Fa-f]{{2}}|[+{UNRESERVED}]+|[^+{UNRESERVED}%]+)"

    def token(t: str) -> str:
        return case(
            (matches(t, rf"^[+{UNRESERVED}]"), t),
            (f"{t} = '%20'", "'+'"),
            (matches(t, UNRESERVED_ESCAPE), f"decode(unhex(substr({t}, 2)), 'UTF-8')"),
            (f"startswith({t}, '%')", f"upper({t})"),
            default=f"replace(url_encode({t}), '*', '%2A')",
        )

    encoded = f"array_join({each(tokens(text, pattern), 'ws_t', token)}, '')"
    return case((f"NOT {matches(text, BAD_ESCAPE)}", encoded))


def _decoded_hex(text: str) -> str:
    """Hex of the decoded bytes of a query component: sorts as the decoded text does by bytes."""

    def token(t: str) -> str:
        return case(
            (f"startswith({t}, '%')", f"upper(substr({t}, 2))"),
            (f"{t} = '+'", "'20'"),
            default=f"hex(encode({t}, 'UTF-8'))",
        )

    return f"array_join({each(tokens(text, r'(%[0-9A-Fa-f]{2}|[+]|[^%+]+)'), 'ws_t', token)}, '')"


def canonical_query_sql(query: str) -> str:
    key, value = "substring_index(ws_q, '=', 1)", sub("ws_q", "^[^=]*=?", "")
    pair = struct(
        sort=_decoded_hex(key),
        i="ws_i",
        text=case(
            (
                "ws_q != '' AND NOT contains(ws_q, ';')",
                f"concat({_component(key)}, '=', {_component(value)})",
            )
        ),
    )
    pairs = f"sort_array(transform(split({query}, '&'), (ws_q, ws_i) -> {pair}))"
    plain = rf"^[{UNRESERVED}+]+=[{UNRESERVED}+]*$"
    return case(
        (f"{query} = '' OR {matches(query, plain)}", query),
        default=f"array_join({pairs}.text, '&')",
    )


def canonical_query(query: str) -> Column:
    """Pairs sorted by decoded key, values of one key in their order, each part re-encoded.

    ``a`` becomes ``a=``, a space ``+``; empty pairs and pairs that hold ``;`` or a malformed
    escape are dropped.
    """
    return F.expr(canonical_query_sql(query))


def canonical_sql(p: str) -> str:
    """Struct of :func:`canonicalize_url` from the struct of :func:`normal_sql`."""
    surfaced = _colon_in_first_segment(p)
    parts = struct(
        scheme=case((surfaced, f"lower({group(f'{p}.path', SCHEME)})"), default=f"{p}.scheme"),
        authority=f"{p}.authority",
        path=case((surfaced, sub(f"{p}.path", SCHEME, "")), default=f"{p}.path"),
        query=canonical_query_sql(f"{p}.query"),
    )
    as_is = struct(**{f: f"{p}.{f}" for f in ("scheme", "authority", "path", "query")})
    return case((f"{p}.done", as_is), (_is_readable(p), parts))


def canonical_of_sql(url: str) -> str:
    """Struct form of :func:`canonicalize_url`."""
    return let(_normal(url), "ws_n", canonical_sql)


def canonical_array_sql(urls: str) -> str:
    """Canonical structs of an array of texts; texts that are no URL are dropped."""
    normal = each(each(urls, "ws_u", raw_sql), "ws_r", normal_sql)
    return not_null(each(normal, "ws_n", canonical_sql))


def canonicalize_url(url: str) -> Column:
    """:func:`normalize_url` with a canonical query (:func:`canonical_query`)."""
    return F.expr(canonicalize_sql(url))


def canonicalize_sql(url: str) -> str:
    return let(
        canonical_of_sql(url), "ws_c", lambda p: case((f"{p} IS NOT NULL", compose_sql(p)))
    )


# --- derived URLs ------------------------------------------------------------------------------


def _scheme_prefix(p: str) -> str:
    return f"if({p}.scheme != '', concat({p}.scheme, ':'), '')"


def _root(p: str) -> str:
    return f"concat({_scheme_prefix(p)}, if({p}.authority != '', concat('//', {p}.authority), ''))"


def site_root_sql(url: str) -> str:
    scheme = f"lower({group(url, '^([A-Za-z][A-Za-z0-9+.-]*:)?')})"
    return f"concat({scheme}, {sub(ascii_authority_sql(group(url, PARTS, 2)), '^(?=.)', '//')})"


def site_root(url: str) -> Column:
    """Scheme, user information and host with port; path, query and fragment dropped. A host outside ASCII is
    in its ASCII form."""
    return F.expr(site_root_sql(url))


def robots_url(url: str) -> Column:
    """Address of the robots file of the URL's site."""
    root = site_root_sql(url)
    # A scheme without a host still gets its slashes once a path follows.
    return F.expr(f"concat({sub(root, '^([A-Za-z][A-Za-z0-9+.-]*:)$', '$1//')}, '/robots.txt')")


def strip_query(url: str) -> Column:
    """:func:`normalize_url` without the query."""
    return F.expr(strip_query_sql(url))


def strip_query_sql(url: str) -> str:
    return sub(normalize_sql(url), r"\?.*$", "")


def url_host_sql(url: str) -> str:
    return let(
        _normal(url), "ws_n", lambda p: case((_is_readable(p), _host(f"{p}.authority")))
    )


def url_host(url: str) -> Column:
    """Lower-cased host of the normalised URL with any port that is not the scheme's default."""
    return F.expr(url_host_sql(url))


def url_hostname_sql(url: str) -> str:
    return sub(url_host_sql(url), r":[0-9]*$", "")


def url_hostname(url: str) -> Column:
    """:func:`url_host` without port."""
    return F.expr(url_hostname_sql(url))


def authority_host_sql(url: str) -> str:
    """Host with port as it stands in the text (no normalising), empty when there is none."""
    return group(url, SITE_HOST)


def url_scheme_sql(url: str) -> str:
    return f"lower({group(url, SCHEME)})"


def robots_path(url: str) -> Column:
    """Path the robots rules are matched against: escapes tidied, ``/`` when empty, no query."""
    return F.expr(sub(tidy_path_sql(group(url, PARTS, 3)), "^$", "/"))


# --- resolution --------------------------------------------------------------------------------


def resolved_sql(base: str, ref: str) -> str:
    """RFC 3986 section 5.2 on two canonical structs, as text. Canonical paths hold no dot
    segments, so merging them makes none."""
    merged = case(
        (f"startswith({ref}.path, '/')", f"{ref}.path"),
        (f"{ref}.path = '' AND startswith({base}.path, '/')", f"{base}.path"),
        default=sub(
            f"if({ref}.path = '', {base}.path, "
            f"concat({group(f'{base}.path', '^(.*/)')}, {ref}.path))",
            "^(?=[^/])",
            "/",
        ),
    )
    query_text = case(
        (f"{ref}.query != ''", f"concat('?', {ref}.query)"),
        (f"{ref}.path = '' AND {base}.query != ''", f"concat('?', {base}.query)"),
        default="''",
    )
    slashes = (
        f"{base}.authority != '' OR "
        f"({base}.scheme != '' AND ({base}.path != '' OR {ref}.path != ''))"
    )
    return case(
        (f"{ref}.scheme != ''", compose_sql(ref)),
        (f"{ref}.authority != ''", f"concat({_scheme_prefix(base)}, {compose_sql(ref)})"),
        (
            f"{_is_opaque(base)} AND {ref}.path = ''",
            f"concat({_scheme_prefix(base)}, {base}.path, {query_text})",
        ),
        default=f"concat({_scheme_prefix(base)}, "
        f"if({slashes}, concat('//', {base}.authority), ''), {merged}, {query_text})",
    )


def resolved_root_sql(base: str, ref: str) -> str:
    """Site root of :func:`resolved_sql`."""
    return case(
        (f"{ref}.scheme != ''", _root(ref)),
        (f"{ref}.authority != ''", f"concat({_scheme_prefix(base)}, {_root(ref)})"),
        default=_root(base),
    )


def resolve_reference(base: str, ref: str) -> Column:
    """Resolve a reference on the URL of its page; both are canonicalised first, so the page's
    trailing slash does not count. Null when either is no URL."""
    both = struct(base=canonical_of_sql(base), ref=canonical_of_sql(ref))
    return F.expr(
        let(
            both,
            "ws_b",
            lambda b: case(
                (
                    f"{b}.base IS NOT NULL AND {b}.ref IS NOT NULL",
                    resolved_sql(f"{b}.base", f"{b}.ref"),
                )
            ),
        )
    )
