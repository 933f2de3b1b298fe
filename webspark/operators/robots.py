"""Robots policy (RFC 9309) as tables: targets, rules and a join.

A site's rules stay together in one row when requests meet them, so the join neither multiplies
requests by rules nor needs an aggregation after it; a site that holds a large share of the requests
is split by the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webspark.functions.binding import case, each, let, lit, struct, sub, tidy_lines, tokens
from webspark.functions.urls import robots_path, robots_url, site_root, tidy_path_sql
from webspark.operators.fetched import failed_columns, failed_records
from webspark.operators.joins import lookup

# The agent's name, the failure text, and the line forms of a robots file.
AGENT = "Smith"
BLOCKED = "Blocked by robots"
GROUPS = r"(?i)((?:user-?agent:[^\n]*\n)++(?:(?:dis)?allow:[^\n]*\n)*+)"
AGENT_LINE = r"(?i)user-?agent:([^\n]*)\n"
RULE_LINE = r"(?i)((?:dis)?allow:[^\n]*)\n"
MEANT_LINES = r"(?i)^(?:user-?agent|allow|disallow)\s*:"


def robots_targets(requests: DataFrame, url: str = "url") -> DataFrame:
    """(site, robots_url): one robots file per site of the request list. The distinct combines
    within each task first, so a site that fills the list is shuffled once per task."""
    return requests.select(
        site_root(url).alias("site"), robots_url(url).alias("robots_url")
    ).distinct()


def parse_robots(bodies: DataFrame, site: str = "site", body: str = "body") -> DataFrame:
    """(site, agent, pattern, allow) of robots files, agents in lower case.

    Groups are found inside the body's row (successive ``user-agent`` lines and the rules after
    them), so nothing is shuffled or ordered across rows. A null body, a file that could not be
    read, gives one rule for all agents with a null pattern that forbids everything. An agent whose
    groups hold no rule keeps a row with an empty pattern: it still shadows the ``*`` group.
    """
    text = tidy_lines(body, MEANT_LINES)
    agents = each(tokens("ws_g", AGENT_LINE), "ws_a", lambda a: f"lower(trim({a}))")
    rules = each(
        tokens("ws_g", RULE_LINE),
        "ws_r",
        lambda r: struct(
            pattern=tidy_path_sql(f"trim({sub(r, '^[^:]*:', '')})"),
            allow=f"NOT startswith(lower({r}), 'd')",
        ),
    )
    none = f"array({struct(pattern=lit(''), allow='true')})"
    group = struct(
        agents=agents,
        rules=let(
            f"filter({rules}, ws_x -> ws_x.pattern != '')",
            "ws_found",
            lambda found: f"if(size({found}) = 0, {none}, {found})",
        ),
    )
    unreadable = struct(
        agents="array('*')",
        rules=f"array({struct(pattern='cast(NULL AS string)', allow='false')})",
    )
    groups = case(
        (f"{body} IS NULL", f"array({unreadable})"),
        default=f"transform({tokens(text, GROUPS)}, ws_g -> {group})",
    )
    return (
        bodies.select(F.col(site).alias("site"), F.expr(f"inline({groups})"))
        .select("site", F.explode("agents").alias("agent"), "rules")
        .select("site", "agent", F.expr("inline(rules)"))
    )


# A rule with a star, with an end mark or without a pattern (a file that could not be read) is walked.
_WALKED = "(ws_r.pattern IS NULL OR contains(ws_r.pattern, '*') OR endswith(ws_r.pattern, '$'))"


def _index(allow: bool) -> str:
    """SQL of the plain patterns among ``mine`` with one verdict: in order, their lengths from the longest,
    and the powers of two by which a search in them steps."""
    plain = f"ws_r.allow = {allow} AND NOT {_WALKED} AND ws_r.pattern != ''"
    patterns = f"sort_array(array_distinct(transform(filter(mine, ws_r -> {plain}), ws_r -> ws_r.pattern)))"
    powers = "transform(sequence(30, 0, -1), ws_k -> shiftleft(1, ws_k))"
    return let(
        patterns,
        "ws_ps",
        lambda ps: struct(
            patterns=ps,
            lengths=f"sort_array(array_distinct(transform({ps}, ws_x -> length(ws_x))), false)",
            steps=f"filter({powers}, ws_k -> ws_k <= size({ps}))",
        ),
    )


def _site_rules(rules: DataFrame, agent: str) -> DataFrame:
    """(site, site_rules): rules of the group for ``agent``; plain ones as an index for either verdict, the
    others in a list, best match first. A site's rules are one file's, so the row is bounded by the file."""
    name = agent.lower()
    mine = rules.filter(
        (F.col("agent") == "*") | ((F.col("agent") != "") & F.startswith(F.lit(name), F.col("agent")))
    )
    rule = F.struct(
        F.when(F.col("agent") == "*", 0).otherwise(F.length("agent")).alias("rank"),
        F.coalesce(F.length("pattern"), F.lit(0)).alias("size"),
        F.col("allow"),
        F.col("pattern"),
    )
    found = mine.groupBy("site").agg(F.sort_array(F.collect_set(rule), asc=False).alias("found"))
    best = found.select("site", F.expr("filter(found, ws_r -> ws_r.rank = found[0].rank)").alias("mine"))
    indexed = struct(
        allow=_index(True), deny=_index(False), walked=f"filter(mine, ws_r -> {_WALKED})"
    )
    return best.select("site", F.expr(indexed).alias("site_rules"))


def _longest_plain(index: str, path: str) -> str:
    """SQL length of the longest pattern of an index that begins the path, null without one. The beginnings of
    the path with the lengths of patterns are looked for by binary search, the longest first. As the lengths
    of different patterns add up to the file, there are few of them: the square root of it at most."""
    place = (
        f"aggregate({index}.steps, 0, (ws_at, ws_step) -> "
        f"if(get({index}.patterns, ws_at + ws_step - 1) <= ws_key, ws_at + ws_step, ws_at))"
    )
    stands = let(f"left({path}, ws_n)", "ws_key", lambda k: f"coalesce(get({index}.patterns, {place} - 1) = {k}, false)")
    lengths = f"filter({index}.lengths, ws_n -> ws_n <= length({path}))"
    return f"aggregate({lengths}, cast(NULL AS int), (ws_best, ws_n) -> if(ws_best IS NULL AND {stands}, ws_n, ws_best))"


def _rule_matches(path: str) -> str:
    """SQL test of one walked rule ``ws_r`` on a path: ``*`` stands for any text, a last ``$`` for the end.

    Patterns come from strangers, so they are no regular expressions: the pieces between the stars are
    looked for one after the other, each at the first place after the one before, which decides such
    patterns exactly in one walk along the path.
    """
    body = "if(endswith(ws_r.pattern, '$'), left(ws_r.pattern, length(ws_r.pattern) - 1), ws_r.pattern)"

    def after(piece: str, place: str) -> str:
        """Place after the first ``piece`` from ``place`` on, 0 without one."""
        found = let(
            f"locate({piece}, {path}, {place})",
            "ws_at",
            lambda at: f"if({at} = 0, 0, {at} + length({piece}))",
        )
        return case((f"{place} = 0", "0"), (f"{piece} = ''", place), default=found)

    def walked(pieces: str) -> str:
        start = f"if(startswith({path}, {pieces}[0]), length({pieces}[0]) + 1, 0)"
        middle = f"slice({pieces}, 2, greatest(size({pieces}) - 2, 0))"
        last = f"{pieces}[size({pieces}) - 1]"
        place = f"aggregate({middle}, {start}, (ws_p, ws_q) -> {after('ws_q', 'ws_p')})"
        ends = "endswith(ws_r.pattern, '$')"
        fits = f"endswith({path}, {last}) AND length({path}) - length({last}) + 1 >= "
        return case(
            (f"size({pieces}) = 1", f"if({ends}, {path} = {last}, {start} > 0)"),
            default=let(
                place,
                "ws_e",
                lambda e: f"{e} > 0 AND if({ends}, {fits} {e}, {after(last, e)} > 0)",
            ),
        )

    return case(
        ("ws_r.pattern IS NULL", "true"),
        ("ws_r.pattern = ''", "false"),
        default=let(f"split({body}, '[*]')", "ws_pieces", walked),
    )


def with_robots_verdict(
    requests: DataFrame, rules: DataFrame, agent: str = AGENT, url: str = "url"
) -> DataFrame:
    """Requests with one more column, ``allowed``.

    The longest matching pattern wins, an allow wins a tie, no match allows; the query is not
    looked at. A site without rules is open, a site whose file could not be read is closed.
    """
    path = "robots_path"
    walked = f"try_element_at(filter(site_rules.walked, ws_r -> {_rule_matches(path)}), 1)"
    fitting = ", ".join(
        [
            let(walked, "ws_w", lambda w: f"if({w} IS NULL, NULL, {struct(size=f'{w}.size', allow=f'{w}.allow')})"),
            *(
                let(
                    _longest_plain(f"site_rules.{kind}", path),
                    "ws_size",
                    lambda n, kind=kind: f"if({n} IS NULL, NULL, {struct(size=n, allow=str(kind == 'allow'))})",
                )
                for kind in ("allow", "deny")
            ),
        ]
    )
    verdict = f"greatest({fitting}).allow"
    return (
        lookup(requests.withColumn("site", site_root(url)), _site_rules(rules, agent), ["site"])
        .withColumn("robots_path", robots_path(url))
        .withColumn("allowed", F.coalesce(F.expr(verdict), F.lit(True)))
        .drop("site", "site_rules", "robots_path")
    )


def robots_allowed(
    requests: DataFrame, rules: DataFrame, agent: str = AGENT, url: str = "url"
) -> DataFrame:
    """(url, allowed) of every request."""
    return with_robots_verdict(requests.select(url), rules, agent, url)


def judge_robots(
    requests: DataFrame,
    rules: DataFrame,
    agent: str = AGENT,
    url: str = "url",
    failed_at: Column | None = None,
) -> DataFrame:
    """Requests with ``allowed`` and ``record``, the failed record of a blocked request, null of any
    other. One table, so that a sink that splits it judges once."""
    judged = with_robots_verdict(requests, rules, agent, url)
    record = F.struct(*failed_columns(BLOCKED, failed_at, url))
    return judged.withColumn("record", F.when(~F.col("allowed"), record))


def apply_robots(
    requests: DataFrame,
    rules: DataFrame,
    agent: str = AGENT,
    ignore: bool = False,
    url: str = "url",
    failed_at: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(requests that may be fetched, failed records of the blocked ones); ``ignore`` passes all. Whoever
    needs both should write :func:`judge_robots` and split that."""
    if ignore:
        return requests, failed_records(requests.limit(0), BLOCKED, failed_at, url)
    judged = judge_robots(requests, rules, agent, url, failed_at)
    return (
        judged.filter("allowed").drop("allowed", "record"),
        judged.filter("NOT allowed").select("record.*"),
    )
