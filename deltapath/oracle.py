"""Reference SQL (DuckDB dialect) for every registered query.

The graphs are common table expressions over the same tables; shortest
distances use a keyed recursive CTE that keeps, per vertex, the best distance
so far and feeds only strict improvements back (DuckDB ``USING KEY``);
hop-staged distances use a plain recursive CTE with an aggregate per stage.
Each query string starts with ``WITH RECURSIVE`` followed by only the CTEs it
needs, in dependency order.
"""

from __future__ import annotations

SOURCE = 0
MAX_HOPS = 10
TREE_DEGREE = 3

_BASE = {
    "g_tree": (
        [],
        """g_tree(src, dst, w) AS (
  SELECT 0::BIGINT, (1 + r_regionkey)::BIGINT, (r_regionkey + 1)::DOUBLE FROM region UNION ALL
  SELECT (1 + n_regionkey)::BIGINT, (10 + n_nationkey)::BIGINT, (n_nationkey % 7 + 1)::DOUBLE FROM nation UNION ALL
  SELECT (10 + c_nationkey)::BIGINT, 100000 + c_custkey, (c_custkey % 11 + 1)::DOUBLE FROM customer UNION ALL
  SELECT 100000 + o_custkey, 10000000 + o_orderkey, (o_orderkey % 13 + 1)::DOUBLE FROM orders)""",
    ),
    "g_ps": (
        [],
        """g_ps(src, dst, w) AS (SELECT src, dst, min(w) FROM (
  SELECT l_partkey * 2 + 1 AS src, l_suppkey * 2 AS dst, l_quantity AS w FROM lineitem UNION ALL
  SELECT l_suppkey * 2, l_partkey * 2 + 1, l_quantity FROM lineitem) GROUP BY ALL)""",
    ),
    "g_ps_unit": (["g_ps"], "g_ps_unit(src, dst, w) AS (SELECT src, dst, 1.0::DOUBLE FROM g_ps)"),
    "tr": (
        [],
        """tr AS (SELECT event_id, user_id AS src,
  lead(user_id) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS dst,
  floor(value) + 1 AS w FROM events)""",
    ),
    "tr2": (["tr"], "tr2 AS (SELECT * FROM tr WHERE dst IS NOT NULL AND src <> dst)"),
    "cut": ([], "cut AS (SELECT max(event_id) * 9 // 10 AS c FROM events)"),
    "g_ev": (["tr2", "cut"], "g_ev(src, dst, w) AS (SELECT src, dst, min(w) FROM tr2, cut WHERE event_id <= c GROUP BY ALL)"),
    "g_tr": (["tr2"], "g_tr(src, dst, w) AS (SELECT src, dst, min(w) FROM tr2 GROUP BY ALL)"),
    "upd_raw": (
        ["tr2", "cut"],
        "upd_raw(src, dst, w, seq) AS (SELECT src, dst, w, event_id FROM tr2, cut WHERE event_id > c)",
    ),
    "upd": (["upd_raw"], "upd(src, dst, w) AS (SELECT src, dst, arg_max(w, seq) FROM upd_raw GROUP BY ALL)"),
    "g_ev_upd": (
        ["g_ev", "upd"],
        "g_ev_upd(src, dst, w) AS (SELECT e.src, e.dst, coalesce(u.w, e.w) FROM g_ev e LEFT JOIN upd u USING (src, dst))",
    ),
    "g_ev_new": (["g_ev", "upd"], "g_ev_new AS (SELECT u.* FROM upd u ANTI JOIN g_ev e USING (src, dst))"),
    "g_ev_all": (
        ["g_ev_upd", "g_ev_new"],
        "g_ev_all(src, dst, w) AS (SELECT * FROM g_ev_upd UNION ALL SELECT * FROM g_ev_new)",
    ),
    "g_ev_ins": (
        ["g_ev", "g_ev_new"],
        "g_ev_ins(src, dst, w) AS (SELECT * FROM g_ev UNION ALL SELECT * FROM g_ev_new)",
    ),
}


def _sssp_cte(graph: str) -> tuple[list[str], str]:
    return (
        [graph],
        f"""r_{graph}(v, d) USING KEY (v) AS (
  SELECT {SOURCE}::BIGINT, 0.0::DOUBLE
  UNION
  SELECT e.dst, min(r.d + e.w) FROM r_{graph} r JOIN {graph} e ON r.v = e.src
  LEFT JOIN recurring.r_{graph} q ON q.v = e.dst
  GROUP BY e.dst HAVING min(r.d + e.w) < coalesce(min(q.d), 'infinity'::DOUBLE))""",
    )


def _verts_cte(graph: str) -> tuple[list[str], str]:
    return ([graph], f"verts_{graph}(v) AS (SELECT src FROM {graph} UNION SELECT dst FROM {graph})")


def _dist_cte(graph: str) -> tuple[list[str], str]:
    """Every vertex (and the source) with its distance, NULL when unreachable."""
    return (
        [f"verts_{graph}", f"r_{graph}"],
        f"""dist_{graph}(v, d) AS (SELECT a.v, r.d FROM
  (SELECT v FROM verts_{graph} UNION SELECT {SOURCE}::BIGINT) a LEFT JOIN r_{graph} r ON r.v = a.v)""",
    )


def _hops_cte(graph: str) -> tuple[list[str], str]:
    return (
        [graph],
        f"""h_{graph}(v, k, d) AS (
  SELECT {SOURCE}::BIGINT, 0, 0.0::DOUBLE
  UNION ALL
  SELECT e.dst, max(h.k) + 1, min(h.d + e.w) FROM h_{graph} h JOIN {graph} e ON h.v = e.src
  WHERE h.k < {MAX_HOPS} GROUP BY e.dst)""",
    )


def _memo_cte(graph: str) -> tuple[list[str], str]:
    return (
        [graph, f"r_{graph}"],
        f"memo_{graph}(dst, src, msg) AS (SELECT e.dst, e.src, r.d + e.w FROM {graph} e JOIN r_{graph} r ON r.v = e.src)",
    )


def _lookup(name: str) -> tuple[list[str], str]:
    if name in _BASE:
        return _BASE[name]
    for prefix, fn in (("r_", _sssp_cte), ("verts_", _verts_cte), ("dist_", _dist_cte), ("h_", _hops_cte), ("memo_", _memo_cte)):
        if name.startswith(prefix):
            return fn(name[len(prefix):])
    return _EXTRA[name]


def _step_ctes(old: str, new: str, end: str) -> dict[str, tuple[list[str], str]]:
    """One memo step from the fixpoint on graph ``old`` with the edges of ``new``; ``end`` is appended to the names."""
    st, cand, chg, merged = f"st{end}", f"cand{end}", f"chg{end}", f"merged{end}"
    return {
        st: ([f"verts_{new}", f"r_{old}"], f"{st}(v, d) AS (SELECT a.v, r.d FROM verts_{new} a LEFT JOIN r_{old} r ON r.v = a.v)"),
        cand: ([new, f"r_{old}"], f"{cand}(dst, src, msg) AS (SELECT e.dst, e.src, r.d + e.w FROM {new} e JOIN r_{old} r ON r.v = e.src)"),
        chg: (
            [cand, f"memo_{old}"],
            f"""{chg}(dst, src, msg) AS (SELECT c.dst, c.src, c.msg FROM {cand} c
  LEFT JOIN memo_{old} o ON o.dst = c.dst AND o.src = c.src WHERE o.msg IS DISTINCT FROM c.msg)""",
        ),
        merged: (
            [f"memo_{old}", chg],
            f"""{merged}(dst, src, msg) AS (SELECT coalesce(c.dst, o.dst), coalesce(c.src, o.src), coalesce(c.msg, o.msg)
  FROM memo_{old} o FULL JOIN {chg} c ON o.dst = c.dst AND o.src = c.src)""",
        ),
        f"stepped{end}": (
            [chg, merged, st],
            f"""stepped{end}(v, d) AS (SELECT m.dst, CASE WHEN m.dst = {SOURCE} THEN 0.0::DOUBLE ELSE min(m.msg) END
  FROM {merged} m WHERE m.dst IN (SELECT dst FROM {chg}) AND m.dst IN (SELECT v FROM {st}) GROUP BY m.dst)""",
        ),
    }


_EXTRA = {
    **_step_ctes("g_ev", "g_ev_all", "_ev"),
    "disturbed": (
        ["memo_g_ev", "memo_g_ev_all"],
        """disturbed(v) AS (SELECT DISTINCT coalesce(o.dst, n.dst) FROM memo_g_ev o
  FULL JOIN memo_g_ev_all n ON o.dst = n.dst AND o.src = n.src WHERE o.msg IS DISTINCT FROM n.msg)""",
    ),
    "last_upd": (
        ["upd_raw"],
        "last_upd(src, dst, w) AS (SELECT arg_max(src, seq), arg_max(dst, seq), arg_max(w, seq) FROM upd_raw)",
    ),
}


def _resolve(names: list[str]) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        deps, _ = _lookup(n)
        for d in deps:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return order


def sql(ctes: list[str], body: str) -> str:
    parts = [_lookup(n)[1] for n in _resolve(ctes)]
    return "WITH RECURSIVE\n" + ",\n".join(parts) + "\n" + body


def _edges(g: str) -> str:
    return sql([g], f"SELECT src, dst, w AS weight FROM {g}")


ORACLE: dict[str, str] = {
    "scan_edge_text": _edges("g_tree"),
    "graph_from_text": sql(
        ["verts_g_tree"],
        f"SELECT v, CASE WHEN v = {SOURCE} THEN 0.0::DOUBLE END AS d FROM (SELECT v FROM verts_g_tree UNION SELECT {SOURCE}::BIGINT)",
    ),
    "scan_updates": sql(["upd_raw"], "SELECT src, dst, w AS weight, seq FROM upd_raw"),
    "nary_tree": f"""WITH numbered AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT p.k AS src, c.k AS dst, 1.0::DOUBLE AS weight FROM numbered c JOIN numbered p ON p.i = (c.i - 1) // {TREE_DEGREE} WHERE c.i > 0""",
    "vertices_from_edges": sql(["verts_g_ps"], "SELECT v FROM verts_g_ps"),
    "init_state": sql(
        ["verts_g_ps"],
        f"SELECT v, CASE WHEN v = {SOURCE} THEN 0.0::DOUBLE END AS d FROM (SELECT v FROM verts_g_ps UNION SELECT {SOURCE}::BIGINT)",
    ),
    "merge_vertices": sql(["st_ev"], "SELECT v, d FROM st_ev"),
    "triplets": sql(
        ["g_ps", "r_g_ps"],
        """SELECT e.src, e.dst, e.w AS weight, a.d AS src_d, b.d AS dst_d FROM g_ps e
  LEFT JOIN r_g_ps a ON a.v = e.src LEFT JOIN r_g_ps b ON b.v = e.dst""",
    ),
    "reset_flags": sql(["dist_g_ps"], "SELECT v, d, 0 AS disturbed FROM dist_g_ps"),
    "candidate_messages": sql(["memo_g_ps"], "SELECT dst, src, msg FROM memo_g_ps"),
    "aggregate_messages": sql(["memo_g_ps"], "SELECT dst AS v, min(msg) AS msg FROM memo_g_ps GROUP BY dst"),
    "memo_table": sql(["memo_g_ps"], "SELECT dst, src, msg FROM memo_g_ps"),
    "min_message": sql(
        ["memo_g_ps"],
        f"SELECT dst AS v, CASE WHEN dst = {SOURCE} THEN 0.0::DOUBLE ELSE min(msg) END AS d FROM memo_g_ps GROUP BY dst",
    ),
    "changed_messages": sql(["chg_ev"], "SELECT dst, src, msg FROM chg_ev"),
    "merge_memo": sql(["merged_ev"], "SELECT dst, src, msg FROM merged_ev"),
    "vertex_step": sql(["stepped_ev"], "SELECT v, d FROM stepped_ev"),
    "merge_state": sql(
        ["st_ev", "stepped_ev"],
        "SELECT a.v, CASE WHEN s.v IS NOT NULL THEN s.d ELSE a.d END AS d FROM st_ev a LEFT JOIN stepped_ev s ON s.v = a.v",
    ),
    "active_frontier": sql(
        ["st_ev", "stepped_ev"], "SELECT s.v, s.d FROM stepped_ev s JOIN st_ev a ON a.v = s.v WHERE s.d IS DISTINCT FROM a.d"
    ),
    "affected_sources": sql(
        ["upd_raw", "verts_g_ev"], "SELECT DISTINCT src AS v FROM upd_raw WHERE src IN (SELECT v FROM verts_g_ev)"
    ),
    "pregel_min": sql(["dist_g_ps"], "SELECT v, d FROM dist_g_ps"),
    "pregel_memo": sql(["memo_g_ps"], "SELECT dst, src, msg FROM memo_g_ps"),
    "pregel_memo_after_update": sql(["dist_g_ev_all"], "SELECT v, d FROM dist_g_ev_all"),
    "update_edge": sql(
        ["g_ev", "last_upd"],
        "SELECT e.src, e.dst, coalesce(u.w, e.w) AS weight FROM g_ev e LEFT JOIN last_upd u ON u.src = e.src AND u.dst = e.dst",
    ),
    "update_edge_batch": _edges("g_ev_upd"),
    "create_edges": _edges("g_ev_ins"),
    "edge_union_all": sql(["g_ev", "upd"], "SELECT src, dst, w AS weight FROM g_ev UNION ALL SELECT src, dst, w FROM upd"),
    "upsert_edges": _edges("g_ev_all"),
    "sssp": sql(["dist_g_ps"], "SELECT v, d FROM dist_g_ps"),
    "sssp_tree": sql(["dist_g_tree"], "SELECT v, d FROM dist_g_tree"),
    "sssp_events": sql(["dist_g_tr"], "SELECT v, d FROM dist_g_tr"),
    "hop_count": sql(["dist_g_ps_unit"], "SELECT v, d FROM dist_g_ps_unit"),
    "sssp_after_update": sql(["dist_g_ev_upd"], "SELECT v, d FROM dist_g_ev_upd"),
    "sssp_after_insert": sql(["dist_g_ev_ins"], "SELECT v, d FROM dist_g_ev_ins"),
    "hop_distances": sql(["h_g_ps"], "SELECT v, k, d FROM h_g_ps WHERE k >= 1"),
    "last_stage_distance": sql(["h_g_ps"], "SELECT v, arg_max(d, k) AS d FROM h_g_ps WHERE k >= 1 GROUP BY v"),
    "stage_message_counts": sql(["h_g_ps"], "SELECT k, count(*) AS n FROM h_g_ps WHERE k >= 1 GROUP BY k"),
    "stage_messages": sql(
        ["h_g_ps", "g_ps"],
        f"SELECT e.dst, e.src, h.k + 1 AS k, h.d + e.w AS msg FROM h_g_ps h JOIN g_ps e ON h.v = e.src WHERE h.k < {MAX_HOPS}",
    ),
    "hop_distances_after_update": sql(["h_g_ev_upd"], "SELECT v, k, d FROM h_g_ev_upd WHERE k >= 1"),
    "disturbed_vertices": sql(["disturbed"], "SELECT v FROM disturbed"),
    "disturbed_flags": sql(
        ["dist_g_ev_all", "disturbed"],
        "SELECT s.v, s.d, CASE WHEN x.v IS NULL THEN 0 ELSE 1 END AS disturbed FROM dist_g_ev_all s LEFT JOIN disturbed x ON x.v = s.v",
    ),
    "count_disturbed": sql(["disturbed"], "SELECT count(*) AS n FROM disturbed"),
    "sink_distances": sql(["dist_g_tree"], "SELECT v, d FROM dist_g_tree"),
    "sink_state": sql(
        ["dist_g_tree", "g_tree", "memo_g_tree"],
        """SELECT 'state' AS kind, v AS a, NULL::BIGINT AS b, d AS x FROM dist_g_tree
  UNION ALL SELECT 'edge', src, dst, w FROM g_tree UNION ALL SELECT 'memo', dst, src, msg FROM memo_g_tree""",
    ),
    "stream_updates": sql(["upd_raw"], "SELECT src, dst, w AS weight, seq FROM upd_raw"),
    "stream_sssp": sql(["dist_g_ev_all"], "SELECT v, d FROM dist_g_ev_all"),
}
