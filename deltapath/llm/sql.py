"""DuckDB SQL of the operators' queries that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op9_exact_dedup"] = r"""
WITH n AS (
    SELECT doc_id, length(coalesce(text, '')) AS n_cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha
    FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY sha ORDER BY n_cp DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY sha) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY sha ORDER BY n_cp DESC, doc_id) AS kept,
       sha AS text_sha256
FROM n
"""

ORACLE["op4_line_dedup"] = r"""
WITH parts AS (
    SELECT doc_id, source, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
    SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS nr FROM parts
), boilerplate AS (
    SELECT line FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
    GROUP BY line HAVING count(DISTINCT coalesce('s' || source, '')) >= 6
), marked AS (
    SELECT l.doc_id, l.nr, l.line, b.line IS NOT NULL AS gone FROM lines l LEFT JOIN boilerplate b ON l.line = b.line
), left_over AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
           coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (WHERE NOT gone), '') AS text
    FROM marked GROUP BY doc_id
)
SELECT p.doc_id, CASE WHEN p.text = '' THEN 0 ELSE l.n_lines END AS n_lines, l.n_removed, length(l.text) AS n_chars, sha256(l.text) AS text_sha256
FROM parts p JOIN left_over l ON p.doc_id = l.doc_id
"""

# CRC-32 of a number's decimal digits, bit by bit: -1 stands for one step of the shift register.
_CRC32 = """xor(4294967295, list_reduce(
        [4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END))"""


def _leaf(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def _tree(name: str, base: str) -> str:
    """Nodes (k, level, i, h, n) of the trees whose leaves ``base`` gives as (k, i, h, n)."""
    return f"""{name} AS (
    SELECT k, 0 AS level, i, h, n FROM ({base})
    UNION ALL
    SELECT k, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 7) // 8 FROM {name} WHERE n > 1 GROUP BY k, level, i // 8
)"""


def _folded(name: str, nodes: str, base: str) -> str:
    """Per row (rid, k): hashes on the way up through the nodes, seen and original; ``proof`` collects the siblings."""
    return f"""{name} AS (
    SELECT rid, k, 0 AS level, i, seen, proof FROM ({base})
    UNION ALL
    SELECT f.rid, f.k, f.level + 1, f.i // 8,
           sha256(string_agg(CASE WHEN t.i = f.i THEN f.seen ELSE t.h END, '' ORDER BY t.i)),
           any_value(f.proof) || coalesce(string_agg(CASE WHEN t.i <> f.i THEN t.h END, '' ORDER BY t.i), '')
    FROM {name} f JOIN {nodes} t ON t.k = f.k AND t.level = f.level AND t.i // 8 = f.i // 8
    WHERE t.n > 1 GROUP BY f.rid, f.k, f.level, f.i
)"""


ORACLE["op11_merkle_manifest"] = f"""
WITH RECURSIVE hashed AS (
    SELECT doc_id, coalesce('l' || lang, '') AS k, {_leaf("text")} AS h,
           CASE WHEN {_CRC32} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other
    FROM documents
), leaves AS (
    SELECT row_number() OVER () AS rid, doc_id, k, h, coalesce(other, h) AS seen,
           row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY k) AS n
    FROM hashed
), {_tree("nodes", "SELECT k, i, h, n FROM leaves")}, {_tree("upper_nodes", "SELECT '' AS k, row_number() OVER (ORDER BY k) - 1 AS i, h, count(*) OVER () AS n FROM nodes WHERE n = 1")},
subroots AS (
    SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS i FROM nodes WHERE n = 1
), {_folded("lower_fold", "nodes", "SELECT rid, k, i, seen, '' AS proof FROM leaves")},
in_subroot AS (
    SELECT rid, k, arg_max(seen, level) AS seen, arg_max(proof, level) AS proof FROM lower_fold GROUP BY rid, k
), {_folded("upper_fold", "upper_nodes", "SELECT s.rid, '' AS k, r.i, s.seen, s.proof FROM in_subroot s JOIN subroots r ON r.k = s.k")},
whole AS (
    SELECT rid, arg_max(seen, level) AS folded, arg_max(proof, level) AS proof FROM upper_fold GROUP BY rid
)
SELECT l.doc_id, l.h AS leaf, r.h AS subroot, t.h AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = t.h AS verified
FROM leaves l JOIN subroots r ON r.k = l.k JOIN whole w ON w.rid = l.rid, (SELECT h FROM upper_nodes WHERE n = 1) t
"""
