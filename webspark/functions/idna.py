"""Names outside ASCII as hosts: width folding, canonical composition (NFC) and Punycode (RFC 3492).

Everything is SQL text over native array functions, shallow on purpose: each level of lambdas costs the
analyzer passes over the whole plan. Composition is one fold over the characters of a host. Punycode needs no
fold over a label, since each number it writes, and the bias of that number, follow from the places of two
characters. Only hosts that hold a character or an escape outside ASCII take these steps; others pass with one
test. The character tables come from Python's Unicode data when the module is imported, and travel as single
text literals.

Composition joins a character with the marks after it, in any order that gives one character. Marks that
stand in an order other than canonical and compose with nothing stay so, and single letters of Hangul are not
joined to syllables.
"""

from __future__ import annotations

import unicodedata

from webspark.functions.binding import case, each, group, let, lit, matches, sub

# The parameters of Punycode, and the prefix of an encoded label.
BASE, T_MIN, T_MAX, SKEW, DAMP, INITIAL_BIAS, INITIAL_N = 36, 1, 26, 38, 700, 72, 128
PREFIX = "xn--"
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"

# A character, or the escape of a byte, outside ASCII.
FOREIGN = r"[^\x00-\x7F]|%[89A-Fa-f][0-9A-Fa-f]"
# What a host may not hold once it is folded.
FORBIDDEN = r"[\x00-\x20#%/:?@\[\\\]^`{|}\x7f�]"
LABEL_END = r"[.。]"

# Beyond these there is no character with a composition, a combining class or a width.
_LAST = 0x2FA1E
_CHARACTER = r"(?s)(.)"


def _tables() -> tuple[str, str, str, str]:
    """Characters that fold to one other, what they fold to, pairs that compose, and combining classes. Records
    begin with one sign and separate key and value by another; where a search finds nothing, the text in front
    makes the value empty."""
    single, folded, composed, classes, marks, bases = [], [], [], [], set(), []
    for code in range(0xA0, _LAST):
        c = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        rule, canonical = unicodedata.decomposition(c), unicodedata.normalize("NFC", c)
        if rule.startswith(("<wide>", "<narrow>")):
            single.append(c)
            folded.append(chr(int(rule.split()[1], 16)))
        elif rule and not rule.startswith("<"):
            if canonical != c and len(canonical) == 1:
                single.append(c)
                folded.append(canonical)
            elif canonical == c and len(rule.split()) == 2:
                bases.append(c)
                marks.add(chr(int(rule.split()[1], 16)))
                composed.append((*(chr(int(x, 16)) for x in rule.split()), c))
        if unicodedata.combining(c):
            classes.append(f"\x01{c}\x02{unicodedata.combining(c)}")
    # A composed character and a mark that belongs before its own.
    known = {a + b for a, b, _ in composed}
    for a in bases:
        for b in marks:
            joined = unicodedata.normalize("NFC", a + b)
            if len(joined) == 1 and a + b not in known:
                composed.append((a, b, joined))
    pairs = "".join(f"\x01{a}{b}\x02{c}" for a, b, c in composed)
    return "".join(single), "".join(folded), f"---{pairs}\x01", f"--{''.join(classes)}\x01"


SINGLE, FOLDED, COMPOSED, CLASSES = _tables()


def _value(key: str, length: int, table: str) -> str:
    """Value of a key of ``length`` characters, empty without one."""
    at = f"locate(concat('\\u0001', {key}, '\\u0002'), {lit(table)})"
    return f"substring_index(substr({lit(table)}, {at} + {length + 2}), '\\u0001', 1)"


def _characters(text: str) -> str:
    return f"regexp_extract_all({text}, {lit(_CHARACTER)}, 1)"


def nfc_sql(text: str) -> str:
    """Composition: a character joins the last one that is no mark, unless a mark of its class or a higher
    one stands between them."""
    characters = (
        f"transform({_characters(text)}, ws_c -> "
        f"named_struct('c', ws_c, 'k', cast(concat('0', {_value('ws_c', 1, CLASSES)}) AS int)))"
    )
    # State: text before the last character that is no mark, that character, the marks kept since, the
    # class of the last of these (-1: none). A blank stands for no character yet.
    start = "named_struct('t', '', 's', ' ', 'm', '', 'l', -1)"
    pair = f"if(ws_a.l < ws_z.k, {_value('ws_a.s, ws_z.c', 2, COMPOSED)}, '')"
    step = case(
        (f"{pair} != ''", f"named_struct('t', ws_a.t, 's', {pair}, 'm', ws_a.m, 'l', ws_a.l)"),
        ("ws_z.k = 0", "named_struct('t', concat(ws_a.t, ws_a.s, ws_a.m), 's', ws_z.c, 'm', '', 'l', -1)"),
        default="named_struct('t', ws_a.t, 's', ws_a.s, 'm', concat(ws_a.m, ws_z.c), 'l', ws_z.k)",
    )
    whole = "substr(concat(ws_a.t, ws_a.s, ws_a.m), 2)"
    return f"aggregate({characters}, {start}, (ws_a, ws_z) -> {step}, ws_a -> {whole})"


def _biases(ds: str) -> str:
    """``(d, s, r)`` of numbers ``(d, h)``: the bias after each is that of ``s`` halved by steps ``r`` times."""
    halved = f"if(ws_j = 0, ws_x.d div {DAMP}, ws_x.d div 2)"
    damped = f"transform({ds}, (ws_x, ws_j) -> named_struct('d', ws_x.d, 's', {halved}, 'h', ws_x.h))"
    whole = f"transform({damped}, ws_x -> named_struct('d', ws_x.d, 's', ws_x.s + ws_x.s div ws_x.h))"
    limit, step = ((BASE - T_MIN) * T_MAX) // 2 + 1, BASE - T_MIN
    times = "6"
    for r in range(5, -1, -1):
        times = f"if(ws_x.s < {limit * step**r}L, {r}, {times})"
    return f"transform({whole}, ws_x -> named_struct('d', ws_x.d, 's', ws_x.s, 'r', {times}))"


def _bias_after(x: str) -> str:
    powers = ", ".join(f"{(BASE - T_MIN) ** r}L" for r in range(7))
    d = f"({x}.s div array({powers})[{x}.r])"
    return f"({BASE}L * {x}.r + ({BASE - T_MIN + 1} * {d}) div ({d} + {SKEW}))"


def _number(delta: str, bias: str) -> str:
    """A number of variable length."""

    def digit(d: str) -> str:
        return f"substr('{DIGITS}', cast({d} AS int) + 1, 1)"

    t = f"greatest({T_MIN}L, least({T_MAX}L, ws_i * {BASE} - {bias}))"
    step = case(
        ("ws_q.q < 0", "ws_q"),
        (f"ws_q.q < {t}", f"named_struct('q', -1L, 'o', concat(ws_q.o, {digit('ws_q.q')}))"),
        default=f"named_struct('q', (ws_q.q - {t}) div ({BASE} - {t}), "
        f"'o', concat(ws_q.o, {digit(f'{t} + (ws_q.q - {t}) % ({BASE} - {t})')}))",
    )
    return f"aggregate(sequence(1L, 16L), named_struct('q', {delta}, 'o', ''), (ws_q, ws_i) -> {step}, ws_q -> ws_q.o)"


def punycode_sql(label: str) -> str:
    """Punycode of a text, without prefix: its ASCII characters, then the places of the others.

    The others are inserted by code and place. The number of one is the distance from the one before it:
    every code passed over counts a place more than there are characters by then, and of the same code the
    characters up to its place that are there already count."""
    codes = f"transform({_characters(label)}, ws_c -> cast(ascii(ws_c) AS bigint))"

    def inserted(cs: str) -> str:
        before = f"cast(size(filter(slice({cs}, 1, ws_p), ws_y -> ws_y <= ws_c)) AS bigint)"
        each_one = f"transform({cs}, (ws_c, ws_p) -> named_struct('c', ws_c, 'p', ws_p, 'b', if(ws_c < 128, 0L, {before})))"
        return f"array_sort(filter({each_one}, ws_y -> ws_y.c >= 128))"

    def numbers(xs: str) -> str:
        last = f"{xs}[ws_j - 1]"
        there = f"(char_length({label}) - size({xs}) + ws_j + 1L)"
        n, i = f"if(ws_j = 0, {INITIAL_N}L, {last}.c)", f"if(ws_j = 0, 0L, {last}.b + 1)"
        return (
            f"transform({xs}, (ws_x, ws_j) -> named_struct('d', (ws_x.c - {n}) * {there} + ws_x.b - {i}, 'h', {there}))"
        )

    def written(ds: str) -> str:
        bias = f"if(ws_j = 0, {INITIAL_BIAS}L, {_bias_after(f'{ds}[ws_j - 1]')})"
        with_bias = f"transform({ds}, (ws_x, ws_j) -> named_struct('d', ws_x.d, 'b', {bias}))"
        return f"array_join(transform({with_bias}, ws_w -> {_number('ws_w.d', 'ws_w.b')}), '')"

    basic = f"regexp_replace({label}, {lit('[^\\x00-\\x7F]')}, '')"
    digits = let(_biases(let(let(codes, "ws_cs", inserted), "ws_xs", numbers)), "ws_ds", written)
    return f"concat({basic}, if({basic} = '', '', '-'), {digits})"


def ascii_host_sql(host: str) -> str:
    """A host without port, in lower case, as the ASCII name it is looked up by. Escapes of bytes are read
    first. A host that would hold a sign no host may have stays as it is."""
    read = f"try_url_decode(replace({host}, '+', '%2B'))"
    folded = f"translate(lower({read}), {lit(SINGLE)}, {lit(FOLDED)})"

    def label(x: str) -> str:
        return case((matches(x, r"[^\x00-\x7F]"), f"concat('{PREFIX}', {punycode_sql(x)})"), default=x)

    def named(x: str) -> str:
        labels = f"array_join({each(f'split({x}, {lit(LABEL_END)})', 'ws_l', label)}, '.')"
        return case((f"{x} IS NULL OR {matches(x, FORBIDDEN)}", f"lower({host})"), default=labels)

    def composed(x: str) -> str:
        return let(case((matches(x, r"\p{M}"), nfc_sql(x)), default=x), "ws_name", named)

    return case((foreign(host), let(folded, "ws_fold", composed)), default=f"lower({host})")


def foreign(text: str) -> str:
    """The text holds a character or escape outside ASCII."""
    return matches(text, FOREIGN)


def ascii_authority_sql(authority: str) -> str:
    """User information as written, the host as :func:`ascii_host_sql`, the port; an authority whose host is
    in ASCII as it is."""
    host = f"substring_index({authority}, '@', -1)"
    name = ascii_host_sql(sub(host, ":[0-9]*$", ""))
    whole = f"concat({group(authority, '^(.*@)')}, {name}, {group(host, '(:[0-9]*)$')})"
    return case((foreign(host), whole), default=authority)
