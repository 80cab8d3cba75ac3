"""The relations in SQL for a second engine, over the star-schema tables.

PRELUDE defines the projected logs; each query is a WITH RECURSIVE statement on top of it.
"""

from tracemill.functions.scalars import DARK_TEXT, EVENT_MARGIN_NS, LIGHT_TEXT, LUMINANCE, LUMINANCE_THRESHOLD, PALETTES

PRELUDE = """
operates AS (
  SELECT worker, id, addr, name FROM (SELECT unnest(range(4))::BIGINT AS worker), (
    SELECT (r_regionkey + 1)::BIGINT AS id, [(r_regionkey + 1)::BIGINT] AS addr, r_name AS name FROM region
    UNION ALL SELECT (100 + n_nationkey)::BIGINT, [(n_regionkey + 1)::BIGINT, (n_nationkey + 1)::BIGINT], n_name FROM nation
    UNION ALL SELECT (1000 + s_suppkey)::BIGINT, [(n_regionkey + 1)::BIGINT, (n_nationkey + 1)::BIGINT, (s_suppkey + 1)::BIGINT], s_name
      FROM supplier JOIN nation ON s_nationkey = n_nationkey)),
sup AS (
  SELECT [(n_regionkey + 1)::BIGINT, (n_nationkey + 1)::BIGINT] AS addr, (s_suppkey + 1)::BIGINT AS op, (n_nationkey + 1)::BIGINT AS n,
    lead(s_suppkey + 1) OVER w AS after, lag(s_suppkey + 1) OVER w AS before
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WINDOW w AS (PARTITION BY n_nationkey ORDER BY s_suppkey)),
near AS (
  SELECT [(n_regionkey + 1)::BIGINT] AS addr, (n_nationkey + 1)::BIGINT AS n,
    lead(n_nationkey + 1) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::BIGINT AS after FROM nation),
chan AS (
  SELECT 10 * op + 1 AS id, addr, op AS source_op, coalesce(after, 0)::BIGINT AS target_op FROM sup
  UNION ALL SELECT 10 * n + 2, addr, 0::BIGINT, op FROM sup WHERE before IS NULL
  UNION ALL SELECT 10 * n + 3, addr, n, after FROM near WHERE after IS NOT NULL),
ev AS (
  SELECT event_id AS seq, epoch_us(ts) * 1000 AS t, user_id % 4 AS worker, 1000 + (user_id // 4) % (SELECT count(*) FROM supplier) AS operator, event_type AS e, value, ts
  FROM events),
slot AS (
  SELECT worker, operator, e, t, lag(t) OVER w AS pt, lag(e) OVER w AS pe FROM ev WHERE e IN ('view', 'signup', 'click', 'error')
  WINDOW w AS (PARTITION BY worker, operator ORDER BY seq)),
act AS (SELECT worker, operator, pt AS start_ns, greatest(0, t - pt) AS duration_ns FROM slot WHERE e IN ('click', 'error') AND pe IN ('view', 'signup')),
summ AS (
  SELECT worker, operator, max(duration_ns) AS max_ns, min(duration_ns) AS min_ns, sum(duration_ns)::BIGINT AS total_ns, (sum(duration_ns) // count(*))::BIGINT AS average_ns, count(*) AS count
  FROM act GROUP BY 1, 2),
agg AS (
  SELECT operator, max(max_ns) AS max_ns, min(min_ns) AS min_ns, (sum(total_ns) // count(*))::BIGINT AS total_ns, (sum(average_ns) // count(*))::BIGINT AS average_ns, sum(count)::BIGINT AS count
  FROM summ GROUP BY 1),
dif AS (
  SELECT seq, t, worker, operator, CASE e WHEN 'purchase' THEN 'Batch' WHEN 'error' THEN 'Drop' ELSE 'Merge' END AS kind, floor(value * 100)::BIGINT AS size,
    floor(value)::BIGINT % 16 AS scale, e FROM ev WHERE e IN ('purchase', 'signup', 'click', 'error')),
arr AS (
  SELECT worker, operator, max(size) AS max_size, min(size) AS min_size, count(*) FILTER (e = 'purchase') AS batches FROM dif WHERE e IN ('purchase', 'click') GROUP BY 1, 2),
aggarr AS (SELECT operator, max(max_size) AS max_size, min(min_size) AS min_size, (sum(batches) // count(*))::BIGINT AS batches FROM arr GROUP BY 1),
ops AS (SELECT id, addr, name FROM operates WHERE worker = 0),
par AS (SELECT DISTINCT addr[1:len(addr) - 1] AS addr FROM ops),
leaf AS (SELECT * FROM ops WHERE addr NOT IN (SELECT addr FROM par)),
scope AS (SELECT * FROM ops WHERE addr IN (SELECT addr FROM par)),
base AS (SELECT id AS cid, addr || [source_op] AS sa, addr || [target_op] AS ta FROM chan),
into_(sa, ta, path) AS (
  SELECT sa, ta, [cid] FROM base UNION ALL SELECT r.sa, b.ta, r.path || [b.cid] FROM into_ r JOIN base b ON b.sa = r.ta || [0::BIGINT]),
both_(sa, ta, path) AS (
  SELECT sa, ta, path FROM into_ UNION ALL SELECT b.sa, r.ta, [b.cid] || r.path FROM both_ r JOIN base b ON b.ta = r.sa || [0::BIGINT]),
plain AS (
  SELECT cid AS channel, sa AS source_addr, ta AS target_addr FROM base
  WHERE sa[-1] <> 0 AND ta[-1] <> 0 AND sa NOT IN (SELECT addr FROM scope) AND ta NOT IN (SELECT addr FROM scope)),
crossing AS (SELECT DISTINCT path[1] AS channel, sa AS source_addr, ta AS target_addr FROM both_ WHERE len(path) >= 2 AND ta NOT IN (SELECT addr FROM scope)),
channel AS (SELECT 'Normal' AS channel_kind, * FROM plain UNION SELECT 'ScopeCrossing', * FROM crossing),
edge AS (
  SELECT channel_kind, channel, s.id AS source_id, s.name AS source_name, t.id AS target_id, t.name AS target_name, source_addr, target_addr
  FROM channel JOIN leaf s ON s.addr = source_addr JOIN ops t ON t.addr = target_addr),
rt AS (
  SELECT worker, min(t) AS start_ns, max(t) AS end_ns FROM (SELECT worker, t FROM ev UNION ALL SELECT worker, 0 FROM operates) GROUP BY 1),
shape AS (
  SELECT id, addr, (SELECT count(DISTINCT 0) FROM base WHERE ta = addr) AS inputs, (SELECT count(DISTINCT 0) FROM base WHERE sa = addr) AS outputs FROM ops)
"""


#: The dense projection: PRELUDE with other operators, ports and events.
DENSE = PRELUDE
for _old, _new in (
    ("n_name FROM nation\n", "n_name FROM nation WHERE n_nationkey % 5 <> 3\n"),
    ("base AS (SELECT id AS cid, addr || [source_op] AS sa, addr || [target_op] AS ta FROM chan)", "base AS (SELECT id AS cid, addr || [source_op] AS sa, id % 3 AS sp, addr || [target_op] AS ta, id % 2 AS tp FROM chan)"),
    ("into_(sa, ta, path)", "into_(sa, sp, ta, tp, path)"), ("SELECT sa, ta, [cid] FROM base", "SELECT sa, sp, ta, tp, [cid] FROM base"),
    ("SELECT r.sa, b.ta, r.path || [b.cid] FROM into_ r JOIN base b ON b.sa = r.ta || [0::BIGINT]", "SELECT r.sa, r.sp, b.ta, b.tp, r.path || [b.cid] FROM into_ r JOIN base b ON b.sa = r.ta || [0::BIGINT] AND b.sp = r.tp"),
    ("both_(sa, ta, path)", "both_(sa, sp, ta, tp, path)"), ("SELECT sa, ta, path FROM into_", "SELECT sa, sp, ta, tp, path FROM into_"),
    ("SELECT b.sa, r.ta, [b.cid] || r.path FROM both_ r JOIN base b ON b.ta = r.sa || [0::BIGINT]", "SELECT b.sa, b.sp, r.ta, r.tp, [b.cid] || r.path FROM both_ r JOIN base b ON b.ta = r.sa || [0::BIGINT] AND b.tp = r.sp"),
    ("slot AS (\n  SELECT worker, operator, e, t, lag(t) OVER w AS pt, lag(e) OVER w AS pe FROM ev WHERE e IN ('view', 'signup', 'click', 'error')\n",
     """sched AS (
  SELECT seq, t, worker, operator, e IN ('view', 'signup') AS opens, e = 'error' AS ends FROM ev WHERE e <> 'purchase'
  UNION ALL SELECT seq, t, worker, 100 + (operator - 1000) % 25, seq % 2 = 0, false FROM ev WHERE e = 'purchase'
  UNION ALL SELECT seq, t, worker, 1 + (operator - 1000) % 5, false, true FROM ev WHERE e = 'error'),
life AS (
  SELECT worker, operator, 0::BIGINT AS birth_ns, greatest(0, arg_min(t, seq))::BIGINT AS death_ns FROM sched JOIN operates USING (worker) WHERE ends AND id = operator GROUP BY 1, 2),
slot AS (
  SELECT worker, operator, opens, t, lag(t) OVER w AS pt, lag(opens) OVER w AS pe FROM sched
"""),
    ("FROM slot WHERE e IN ('click', 'error') AND pe IN ('view', 'signup')", "FROM slot WHERE NOT opens AND pe"),
):
    if _old not in DENSE:
        raise ValueError(_old)
    DENSE = DENSE.replace(_old, _new)


def text(array: str) -> str:
    """An array of numbers as `[1, 2, 3]`."""
    return f"('[' || array_to_string({array}, ', ') || ']')"


def query(body: str, extra: str = "") -> str:
    return f"WITH RECURSIVE {PRELUDE.strip()}{', ' + extra if extra else ''}\n{body}"


def dense(body: str, extra: str = "") -> str:
    """A statement on the dense projection."""
    return f"WITH RECURSIVE {DENSE.strip()}{', ' + extra if extra else ''}\n{body}"


def stack(name: str, source: str) -> str:
    """LIFO pairing of source (worker, ref, seq, t, a in start, stop, end) as a fold that carries the open starts; result
    table `name`."""
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY worker, ref ORDER BY seq) AS n FROM {source}),
{name}_f(worker, ref, n, seq, t, opened, closed) AS (
  SELECT worker, ref, 0::BIGINT, 0::BIGINT, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM (SELECT DISTINCT worker, ref FROM {source})
  UNION ALL
  SELECT s.worker, s.ref, s.n, s.seq, s.t,
    CASE s.a WHEN 'start' THEN f.opened || [s.t] WHEN 'stop' THEN f.opened[1:len(f.opened) - 1] ELSE []::BIGINT[] END,
    CASE s.a WHEN 'start' THEN []::BIGINT[] WHEN 'stop' THEN f.opened[len(f.opened):len(f.opened)] ELSE f.opened END
  FROM {name}_f f JOIN {name}_n s ON s.worker = f.worker AND s.ref = f.ref AND s.n = f.n + 1),
{name} AS (SELECT worker, ref AS ref_id, o AS start_ns, greatest(0, t - o) AS duration_ns, seq AS closed FROM (SELECT *, unnest(closed) AS o FROM {name}_f))"""


_ACTIVE = (
    "active AS (SELECT worker, operator AS ref, seq, t, CASE e WHEN 'error' THEN 'end' WHEN 'click' THEN 'stop' ELSE 'start' END AS a FROM ev WHERE e <> 'purchase'), "
    + stack("active_line", "active")
)
_MERGES = (
    "merging AS (SELECT worker, operator AS ref, seq, t, CASE e WHEN 'error' THEN 'end' WHEN 'click' THEN 'stop' ELSE 'start' END AS a FROM dif WHERE e <> 'purchase'), "
    + stack("merge_line", "merging")
)
#: All kinds of the dense engine log; a reference is the kind and, if it has one, the number.
_ALL = (
    """every AS (
  SELECT worker, 'Activation:' || operator AS ref, seq, t, CASE WHEN ends THEN 'end' WHEN opens THEN 'start' ELSE 'stop' END AS a FROM sched
  UNION ALL SELECT worker, ['Application', 'Message', 'Progress', 'Input', 'Parked'][seq % 6] || ':' || CASE WHEN seq % 6 = 1 THEN ((operator - 1000) % 10)::VARCHAR ELSE '' END, seq, t,
    CASE WHEN e IN ('view', 'signup') THEN 'start' ELSE 'stop' END FROM ev WHERE e <> 'error' AND seq % 6 > 0), """
    + stack("all_line", "every")
)
_KIND_AND_REF = "worker, split_part(ref_id, ':', 1) AS kind, nullif(split_part(ref_id, ':', 2), '')::BIGINT AS ref_id"
_SHORT = (
    """shorting AS (
  SELECT worker, operator AS ref, seq, t, CASE e WHEN 'error' THEN 'end' WHEN 'click' THEN 'stop' ELSE 'start' END AS a FROM dif WHERE e <> 'purchase'
  UNION ALL SELECT worker, operator, seq, t, 'stop' FROM ev WHERE e = 'view' AND seq % 3 = 0), """
    + stack("short_line", "shorting")
)
_ADDR = text("addr")


def colors(position: str, palette: str = "inferno") -> str:
    """SQL of fill and text colours at a position, from the palette's anchors."""
    anchors = PALETTES[palette]
    last = len(anchors) - 1
    points = [[int(a[k : k + 2], 16) for a in anchors] for k in (1, 3, 5)]
    x = f"(greatest(0.0, least(1.0, {position})) * {last})"
    at = f"least(floor({x})::INT, {last - 1})"
    r, g, b = (f"round({p}[{at} + 1] + ({p}[{at} + 2] - {p}[{at} + 1]) * ({x} - {at}))::INT" for p in points)
    weights = " + ".join(f"{w} * ({c} / 255.0)" for w, c in zip(LUMINANCE, (r, g, b), strict=True))
    return f"printf('#%02X%02X%02X', {r}, {g}, {b}) AS fill_color, CASE WHEN {weights} >= {LUMINANCE_THRESHOLD} THEN '{DARK_TEXT}' ELSE '{LIGHT_TEXT}' END AS text_color"


def heat(value: str, high: str, low: str) -> str:
    return f"CASE WHEN {value} > 0 AND {high} > 0 AND {low} > 0 AND {high} <> {low} THEN (log2({value}) - log2({low})) / (log2({high}) - log2({low})) ELSE 0.0 END"

#: Query name: SQL.
QUERIES = {
    "activations": query("SELECT * FROM act"),
    "lifespans": """
SELECT o_orderkey % 4 AS worker, o_orderkey AS operator, epoch_us(o_orderdate) * 1000 AS birth_ns,
  epoch_us(o_orderdate) * 1000 + greatest(0, (epoch_us(max(l_shipdate)) - epoch_us(o_orderdate)) * 1000) AS death_ns
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate""",
    "timeline_events": dense(f"SELECT {_KIND_AND_REF}, start_ns, duration_ns, 1::BIGINT AS collapsed_events FROM all_line", _ALL),
    "merge_timeline": dense("SELECT worker, 'Merge' AS kind, ref_id, start_ns, duration_ns, 1::BIGINT AS collapsed_events FROM short_line", _SHORT),
    "worker_timeline": dense(
        f"SELECT {_KIND_AND_REF}, start_ns, duration_ns, 1::BIGINT AS collapsed_events FROM all_line UNION ALL SELECT worker, 'Merge', ref_id, start_ns, duration_ns, 1 FROM short_line", _ALL + ", " + _SHORT
    ),
    "collapse_events": query(
        """SELECT worker, kind, ref_id, start_ns, max(duration) AS duration_ns, max(events)::BIGINT AS collapsed_events FROM fold GROUP BY worker, kind, ref_id, start_ns, opened""",
        _ACTIVE + ", " + _MERGES + """,
known AS (SELECT worker, 'Activation' AS kind, ref_id, start_ns, duration_ns, closed FROM active_line UNION ALL SELECT worker, 'Merge', ref_id, start_ns, duration_ns, closed FROM merge_line),
turn AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY closed, start_ns, kind, ref_id, duration_ns) AS n FROM known),
fold(worker, n, kind, ref_id, start_ns, duration, events, opened) AS (
  SELECT worker, n, kind, ref_id, start_ns, duration_ns, 1, n FROM turn WHERE n = 1
  UNION ALL
  SELECT t.worker, t.n, t.kind, t.ref_id, CASE WHEN joins THEN f.start_ns ELSE t.start_ns END, CASE WHEN joins THEN f.duration + t.duration_ns ELSE t.duration_ns END,
    CASE WHEN joins THEN f.events + 1 ELSE 1 END, CASE WHEN joins THEN f.opened ELSE t.n END
  FROM fold f JOIN turn t ON t.worker = f.worker AND t.n = f.n + 1, LATERAL (SELECT f.kind = t.kind AND f.ref_id = t.ref_id
    AND greatest(0, f.start_ns - MARGIN) <= t.start_ns + t.duration_ns AND f.start_ns + f.duration + MARGIN >= t.start_ns AS joins))""".replace("MARGIN", str(EVENT_MARGIN_NS)),
    ),
    "operator_summation": query("SELECT * FROM summ"),
    "aggregated_summation": query("SELECT * FROM agg"),
    "arrangement_stats": query("SELECT * FROM arr"),
    "aggregated_arrangements": query("SELECT * FROM aggarr"),
    "spline_levels": query("SELECT worker, operator, t AS event_ns, scale, size AS complete_size FROM dif WHERE e = 'click'"),
    "arrangement_ids": query("SELECT DISTINCT worker, operator FROM dif"),
    "arrangements_by_size": query(f"SELECT a.*, total_ns, name, {_ADDR} AS addr FROM aggarr a JOIN agg USING (operator) LEFT JOIN ops ON id = operator"),
    "operators_by_total_runtime": query(
        f"SELECT g.*, name, {_ADDR} AS addr, inputs::INT AS inputs, outputs::INT AS outputs, max_size, min_size, batches "
        "FROM agg g LEFT JOIN ops ON ops.id = operator LEFT JOIN shape USING (id, addr) LEFT JOIN aggarr USING (operator)"
    ).replace("SELECT g.*, name", "SELECT g.operator, max_ns, g.min_ns, g.total_ns, g.average_ns, g.count, name"),
    "workers": query("SELECT DISTINCT worker FROM (SELECT worker FROM operates UNION ALL SELECT worker FROM ev WHERE e <> 'purchase')"),
    "dataflows": query(f"SELECT {_ADDR} AS addr FROM scope WHERE len(addr) = 1"),
    "leaf_operators": query(f"SELECT {_ADDR} AS addr FROM leaf"),
    "subgraphs": query(f"SELECT {_ADDR} AS addr, id, name FROM scope"),
    "subgraph_ids": query("SELECT DISTINCT o.worker, o.id AS operator FROM operates o JOIN scope USING (addr)"),
    "nodes": query(f"SELECT {_ADDR} AS addr, id, name FROM leaf"),
    "raw_operators": query(f"SELECT id, {_ADDR} AS addr, name FROM ops"),
    "raw_channels": dense(f"SELECT id, {_ADDR} AS addr, source_op, id % 3 AS source_port, target_op, id % 2 AS target_port FROM chan"),
    "channel_scopes": query(f"SELECT worker, chan.id AS channel, {text('chan.addr')} AS addr FROM chan, (SELECT unnest(range(4)) AS worker)"),
    "dataflow_ids": query("SELECT worker, id AS operator FROM operates WHERE len(addr) = 1"),
    "addr_ids": query(f"SELECT worker, {_ADDR} AS addr, id AS operator FROM operates"),
    "name_lookup": query("SELECT worker, id AS operator, name FROM operates"),
    "addr_lookup": query(f"SELECT worker, id AS operator, {_ADDR} AS addr FROM operates"),
    "distinct_channels": query("SELECT DISTINCT channel FROM channel"),
    "total_runtime": query("SELECT * FROM rt"),
    "program_overview": query(
        "SELECT (SELECT count(*) FROM rt) AS workers, (SELECT count(*) FROM scope WHERE len(addr) = 1) AS dataflows, (SELECT count(*) FROM leaf) AS operators, "
        "(SELECT count(*) FROM scope) AS subgraphs, (SELECT count(DISTINCT channel) FROM channel) AS channels, (SELECT count(*) FROM (SELECT DISTINCT worker, operator FROM dif)) AS arrangements, "
        "(SELECT sum(greatest(0, end_ns - start_ns)) // count(*) FROM rt)::BIGINT AS total_runtime_ns"
    ),
    "worker_report": query(
        "SELECT worker, (SELECT count(*) FROM scope WHERE len(addr) = 1) AS dataflows, (SELECT count(*) FROM leaf) AS operators, (SELECT count(*) FROM scope) AS subgraphs, "
        "(SELECT count(*) FROM chan) AS channels, (SELECT count(DISTINCT operator) FROM dif WHERE dif.worker = rt.worker) AS arrangements, greatest(0, end_ns - start_ns) AS runtime_ns FROM rt"
    ),
    "worker_report_compat": query(
        "SELECT worker, (SELECT count(*) FROM scope WHERE len(addr) = 1) AS dataflows, (SELECT count(*) FROM leaf) AS operators, (SELECT count(*) FROM scope) AS subgraphs, "
        "(SELECT count(DISTINCT channel) FROM channel) AS channels, (SELECT count(DISTINCT operator) FROM dif WHERE dif.worker = rt.worker) AS arrangements, "
        "(greatest(0, end_ns - start_ns) // (SELECT count(*) FROM rt))::BIGINT AS runtime_ns FROM rt"
    ),
    "runtime_bounds": query("SELECT min(total_ns) AS min_total_ns, max(total_ns) AS max_total_ns FROM summ"),
    "channels_normal": query(f"SELECT channel, {text('source_addr')} AS source_addr, {text('target_addr')} AS target_addr FROM plain"),
    "channels_crossing": query(f"SELECT channel, {text('source_addr')} AS source_addr, {text('target_addr')} AS target_addr FROM crossing"),
    "rewired_channels": query(f"SELECT channel_kind, channel, {text('source_addr')} AS source_addr, {text('target_addr')} AS target_addr FROM channel"),
    "edges": query(f"SELECT channel_kind, channel, source_id, source_name, target_id, target_name, {text('source_addr')} AS source_addr, {text('target_addr')} AS target_addr FROM edge"),
    "html_edges": query(f"SELECT source_id, target_id, channel, {text('source_addr')} AS source_addr, {text('target_addr')} AS target_addr, channel_kind FROM edge"),
    "graph_orphans": dense(
        f"SELECT {_ADDR} AS addr FROM (SELECT addr FROM par WHERE len(addr) > 0 UNION SELECT source_addr FROM channel UNION SELECT target_addr FROM channel) x WHERE addr NOT IN (SELECT addr FROM ops)"
    ),
    "pruned_edges": dense(
        f"SELECT channel_kind, channel, source_id, source_name, target_id, target_name, {text('source_addr')} AS source_addr, {text('target_addr')} AS target_addr FROM edge "
        "WHERE source_addr NOT IN (SELECT addr FROM scope) AND target_addr NOT IN (SELECT addr FROM scope)"
    ),
    "operator_shapes": dense(
        f"SELECT id, {_ADDR} AS addr, (SELECT coalesce({text('list_sort(list(DISTINCT tp))')}, '[]') FROM base WHERE ta = addr) AS inputs, "
        f"(SELECT coalesce({text('list_sort(list(DISTINCT sp))')}, '[]') FROM base WHERE sa = addr) AS outputs FROM ops"
    ),
    "dataflow_stats": dense(
        f"""SELECT * FROM (SELECT id, {_ADDR} AS addr, worker,
  (SELECT count(*) FROM ops o WHERE len(o.addr) > len(d.addr) AND o.addr[1:len(d.addr)] = d.addr) AS operators,
  (SELECT count(*) FROM scope o WHERE len(o.addr) > len(d.addr) AND o.addr[1:len(d.addr)] = d.addr) AS subgraphs,
  (SELECT count(*) FROM chan o WHERE len(o.addr) > len(d.addr) AND o.addr[1:len(d.addr)] = d.addr) AS channels, birth_ns, death_ns
FROM operates d JOIN life USING (worker) WHERE len(addr) = 1 AND life.operator = id) WHERE operators > 0 AND subgraphs > 0 AND channels > 0"""
    ),
    "dense_activations": dense("SELECT * FROM act"),
    "dense_lifespans": dense("SELECT * FROM life"),
    "dense_edges": dense(f"SELECT channel_kind, channel, source_id, source_name, target_id, target_name, {text('source_addr')} AS source_addr, {text('target_addr')} AS target_addr FROM edge"),
    "dataflow_stats_outer": query(
        f"""SELECT id, {_ADDR} AS addr, worker,
  (SELECT count(*) FROM ops o WHERE len(o.addr) > len(d.addr) AND o.addr[1:len(d.addr)] = d.addr) AS operators,
  (SELECT count(*) FROM scope o WHERE len(o.addr) > len(d.addr) AND o.addr[1:len(d.addr)] = d.addr) AS subgraphs,
  (SELECT count(*) FROM chan o WHERE len(o.addr) > len(d.addr) AND o.addr[1:len(d.addr)] = d.addr) AS channels,
  NULL::BIGINT AS birth_ns, NULL::BIGINT AS death_ns
FROM operates d WHERE len(addr) = 1"""
    ),
    "topk_runtime": query("SELECT operator, total_ns, rank() OVER (ORDER BY total_ns DESC)::INT AS rank FROM agg QUALIFY rank <= 10"),
    "topk_arrangement": query(
        "SELECT operator, max_size, min_size, rank() OVER (ORDER BY max_size DESC)::INT AS rank FROM agg JOIN aggarr USING (operator) WHERE max_size > 0 QUALIFY rank <= 10"
    ),
    "topk_batches": query(
        "SELECT operator, rank() OVER (ORDER BY total_ns DESC)::INT AS rank, batches FROM agg JOIN aggarr USING (operator) WHERE batches > 0 QUALIFY rank <= 10"
    ),
    "activation_scatter": query(
        "SELECT operator, rank, worker, start_ns, duration_ns FROM act JOIN (SELECT operator, rank() OVER (ORDER BY total_ns DESC)::INT AS rank FROM agg QUALIFY rank <= 10) USING (operator)"
    ),
    "compaction": query("SELECT scale, count(*) AS merges FROM dif WHERE e = 'click' GROUP BY 1"),
    "operator_tree": query(f"SELECT id AS operator, {_ADDR} AS addr, name, total_ns FROM ops LEFT JOIN agg ON operator = id"),
    "nested_activations": query(
        "SELECT operator, string_agg(worker || ':' || w, ';' ORDER BY worker) AS workers FROM ("
        "SELECT operator, worker, string_agg(start_ns || '+' || duration_ns, ',' ORDER BY start_ns, duration_ns) AS w FROM act GROUP BY 1, 2) GROUP BY 1"
    ),
    "spline_lists": query(
        "SELECT worker, operator, string_agg(t || '/' || size || '/' || scale, ',' ORDER BY t, size, scale) AS spline_levels FROM dif WHERE e = 'click' GROUP BY 1, 2"
    ),
    "aggregated_activations": query(
        "SELECT id AS operator, coalesce(string_agg(start_ns || '+' || duration_ns, ',' ORDER BY start_ns, duration_ns), '') AS activations FROM ops LEFT JOIN act ON operator = id GROUP BY 1"
    ),
    "progress_messages": """
SELECT l_orderkey % 4 AS worker, (1000 + l_suppkey)::BIGINT AS operator, (l_linenumber - 1)::BIGINT AS port, l_orderkey % 145 AS channel, l_orderkey % 2 = 0 AS is_send,
  sum(floor(l_quantity)::BIGINT)::BIGINT AS messages FROM lineitem GROUP BY ALL""",
    "reachability_fold": """
SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'SourceUpdate' ELSE 'TargetUpdate' END AS kind, l_suppkey AS node, l_linenumber::BIGINT AS port,
  sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END)::BIGINT AS diff FROM lineitem GROUP BY ALL HAVING diff <> 0""",
    "vega_nodes": dense(
        f"""SELECT g.operator, name, {_ADDR} AS addr, g.count AS activations, g.total_ns, g.average_ns, g.max_ns, g.min_ns, max_size, min_size, batches,
  CASE WHEN ops.id IN (SELECT id FROM scope) THEN 'Subgraph' ELSE 'Node' END AS node_kind,
  (SELECT count(*) FROM summ s WHERE s.operator = g.operator) AS workers, (SELECT count(*) FROM act a WHERE a.operator = g.operator) AS durations,
  (SELECT string_agg(concat_ws('/', s.worker, s.count, s.total_ns, max_size, batches), ';' ORDER BY s.worker) FROM summ s LEFT JOIN arr USING (worker, operator) WHERE s.operator = g.operator) AS per_worker,
  (SELECT string_agg(start_ns || '+' || duration_ns, ',' ORDER BY start_ns, duration_ns) FROM act a WHERE a.operator = g.operator) AS activation_durations
FROM agg g JOIN ops ON ops.id = g.operator LEFT JOIN aggarr USING (operator)"""
    ),
    "html_nodes": query(
        f"""SELECT s.operator, {_ADDR} AS addr, name, s.count AS activations, s.total_ns, s.max_ns, s.min_ns, s.average_ns, s.count, max_size, min_size, batches, {colors(heat('s.total_ns', 'hi', 'lo'))}
FROM summ s JOIN leaf ON id = s.operator LEFT JOIN arr USING (worker, operator), (SELECT max(total_ns) AS hi, min(total_ns) AS lo FROM summ) WHERE worker = 0"""
    ),
    "html_subgraphs": dense(
        f"SELECT s.operator, {_ADDR} AS addr, name, s.count, s.total_ns, s.max_ns, s.min_ns, s.average_ns, {colors(heat('s.total_ns', 's.max_ns', 's.min_ns'))} FROM summ s JOIN scope ON id = s.operator WHERE worker = 0"
    ),
    "palette_sample": f"SELECT position, fill_color AS color FROM (SELECT i / 10.0::DOUBLE AS position, {colors('i / 10.0::DOUBLE')} FROM range(10) r(i))",
    "html_nodes_stats": query(
        f"""SELECT s.operator, {_ADDR} AS addr, name, s.count AS activations, s.total_ns, max_size, min_size, batches
FROM summ s JOIN leaf ON id = s.operator LEFT JOIN arr USING (worker, operator) WHERE worker = 0"""
    ),
    "heat_position": query(
        "SELECT worker, operator, round(CASE WHEN hi <> lo AND total_ns > 0 AND lo > 0 THEN (log2(total_ns) - log2(lo)) / (log2(hi) - log2(lo)) ELSE 0 END, 6) AS position "
        "FROM summ, (SELECT max(total_ns) AS hi, min(total_ns) AS lo FROM summ)"
    ),
    "luminance": "SELECT p_partkey, round(0.2126 * (p_partkey % 256) / 255.0 + 0.7152 * (p_partkey // 7 % 256) / 255.0 + 0.0722 * (p_partkey // 13 % 256) / 255.0, 6) AS luminance, "
    "printf('#%02X%02X%02X', p_partkey % 256, p_partkey // 7 % 256, p_partkey // 13 % 256) AS color FROM part",
    "granulate_5ms": "SELECT event_id, epoch_us(ts) * 1000 AS t_ns, (epoch_us(ts) * 1000 // 5000000 + 1) * 5000000 AS bucket_ns FROM events",
    "format_addr": query(f"SELECT worker, id, {_ADDR} AS addr, {text('addr[1:len(addr) - 1]')} AS parent, addr[-1] AS last, len(addr) = 1 AS top_level FROM operates"),
    "human_duration": """
WITH d AS (SELECT o_orderkey, o_orderkey * 1234567891 AS ns FROM orders),
p AS (SELECT *, ns // 1000000000 AS s, ns % 1000000000 AS n FROM d)
SELECT o_orderkey, ns, CASE WHEN ns = 0 THEN '0s' ELSE concat_ws(' ',
  CASE WHEN s // 31557600 > 0 THEN s // 31557600 || 'year' || CASE WHEN s // 31557600 > 1 THEN 's' ELSE '' END END,
  CASE WHEN s % 31557600 // 2630016 > 0 THEN s % 31557600 // 2630016 || 'month' || CASE WHEN s % 31557600 // 2630016 > 1 THEN 's' ELSE '' END END,
  CASE WHEN s % 31557600 % 2630016 // 86400 > 0 THEN s % 31557600 % 2630016 // 86400 || 'day' || CASE WHEN s % 31557600 % 2630016 // 86400 > 1 THEN 's' ELSE '' END END,
  CASE WHEN s % 31557600 % 2630016 % 86400 // 3600 > 0 THEN s % 31557600 % 2630016 % 86400 // 3600 || 'h' END,
  CASE WHEN s % 31557600 % 2630016 % 86400 % 3600 // 60 > 0 THEN s % 31557600 % 2630016 % 86400 % 3600 // 60 || 'm' END,
  CASE WHEN s % 31557600 % 2630016 % 86400 % 60 > 0 THEN s % 31557600 % 2630016 % 86400 % 60 || 's' END,
  CASE WHEN n // 1000000 > 0 THEN n // 1000000 || 'ms' END, CASE WHEN n // 1000 % 1000 > 0 THEN n // 1000 % 1000 || 'us' END, CASE WHEN n % 1000 > 0 THEN n % 1000 || 'ns' END) END AS text
FROM p""",
    # generic operators on the star schema
    "map": "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem",
    "filter": "SELECT * FROM supplier WHERE s_acctbal > 0",
    "filter_map": "SELECT s_suppkey AS id, upper(s_name) AS name FROM supplier WHERE s_acctbal > 0",
    "flat_map": "SELECT n_nationkey, unnest(range(1, n_regionkey + 2))::INT AS step FROM nation",
    "split_left": "SELECT o_orderkey AS id, o_totalprice AS price FROM orders",
    "split_right": "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders",
    "filter_split_left": "SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 1000",
    "filter_split_right": "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'",
    "flat_split_left": "SELECT n_nationkey, unnest(range(0, n_regionkey + 1))::INT AS step FROM nation",
    "flat_split_right": "SELECT n_nationkey, unnest(range(0, n_nationkey + 1))::INT AS step FROM nation",
    "keys": "SELECT o_custkey FROM orders",
    "negate": "SELECT l_orderkey, -l_linenumber AS diff FROM lineitem",
    "join_map": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_where": "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > c_acctbal",
    "semi_join": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "anti_join": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "left_outer_default": "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    "prefix_join": query(f"SELECT DISTINCT {text('s.addr')} AS ancestor, {text('o.addr')} AS addr FROM ops o JOIN scope s ON len(o.addr) > len(s.addr) AND o.addr[1:len(s.addr)] = s.addr"),
    "union_all": "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer",
    "union_distinct": "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer",
    "bag_difference": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "intersect_by_key": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)",
    "count_total": "SELECT l_suppkey, count(*) AS count FROM lineitem GROUP BY 1",
    "distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "threshold": "SELECT l_suppkey, (count(*) // 2)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING n > 0",
    "consolidate": "SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END)::BIGINT AS diff FROM orders GROUP BY 1 HAVING diff <> 0",
    "snapshot": "SELECT o_custkey FROM orders GROUP BY 1 HAVING sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END) > 0",
    "reduce_collect": "SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS line_numbers FROM lineitem GROUP BY 1",
    "sort_by": "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1",
    "hierarchical_reduce": "SELECT l_returnflag, sum(l_linenumber::BIGINT)::BIGINT AS total FROM lineitem GROUP BY 1",
    "hierarchical_sort_by": "SELECT o_custkey, string_agg((o_orderkey % 100)::VARCHAR, ',' ORDER BY o_orderkey % 100) AS orders FROM orders GROUP BY 1",
    "compact_held": """
WITH h AS (SELECT o_orderkey % 50 AS own_ns, o_custkey % 3 AS record, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS diff, greatest(o_orderkey % 50, o_orderkey % 50 * 3 - 40) AS release_ns FROM orders)
SELECT release_ns, own_ns, record, sum(diff)::BIGINT AS diff, CASE WHEN release_ns < 60 THEN 1 ELSE count(*) END::BIGINT AS rows FROM h GROUP BY 1, 2, 3 HAVING release_ns >= 60 OR sum(diff) <> 0""",
    "held_due": "SELECT o_orderkey, o_custkey, greatest(o_custkey, o_orderkey % 1000) AS release_ns FROM orders WHERE greatest(o_custkey, o_orderkey % 1000) < 500",
    "map_in_place": "SELECT c_custkey, lower(c_name) AS c_name FROM customer",
    "map_timed": "SELECT o_orderdate, o_orderkey AS id, year(o_orderdate)::INT AS year FROM orders",
    "filter_map_timed": "SELECT o_orderdate, o_orderkey AS id FROM orders WHERE year(o_orderdate) > 1995",
    "escape_label": "SELECT c_custkey, c_name || '\\\\' || c_mktsegment AS label FROM customer",
    "debug_duration": "SELECT o_orderkey, CASE WHEN ns >= 1000000000 THEN ns // 1000000000 || CASE WHEN ns % 1000000000 = 0 THEN '' ELSE '.' || rtrim(lpad((ns % 1000000000)::VARCHAR, 9, '0'), '0') END || 's' WHEN ns >= 1000000 THEN ns // 1000000 || CASE WHEN ns % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad((ns % 1000000)::VARCHAR, 6, '0'), '0') END || 'ms' "
    "WHEN ns >= 1000 THEN ns // 1000 || CASE WHEN ns % 1000 = 0 THEN '' ELSE '.' || rtrim(lpad((ns % 1000)::VARCHAR, 3, '0'), '0') END || 'µs' ELSE ns || 'ns' END AS text FROM (SELECT o_orderkey, o_orderkey * 1500 AS ns FROM orders)",
    "extend_addr": query(f"SELECT id, {text('addr || [id, 7::BIGINT]')} AS addr FROM ops"),
    "from_seconds": "SELECT s_suppkey, CASE WHEN floor(s_acctbal) >= 0 THEN floor(s_acctbal)::BIGINT * 1000000000 ELSE 0 END AS ns FROM supplier",
    "unsigned_ids": "SELECT o_orderkey, -1 - o_orderkey AS signed, true AS back FROM orders",
    "optional_aggregate": "SELECT o_custkey, max(o_orderkey) FILTER (o_orderstatus = 'F') AS latest FROM orders GROUP BY 1",
    "epoch_lattice": "SELECT o_orderkey, greatest(o_orderkey, o_custkey) AS join_system, greatest(o_custkey, o_orderkey % 7) AS join_data, least(o_orderkey, o_custkey) AS meet_system, "
    "least(o_custkey, o_orderkey % 7) AS meet_data, o_orderkey <= o_custkey AND o_custkey <= o_orderkey % 7 AS less_equal FROM orders",
    # streams
    "stream_activations": query("SELECT * FROM act"),
    "stream_lifespans": query(
        "SELECT worker, operator, pt AS birth_ns, greatest(pt, t) AS death_ns FROM (SELECT worker, operator, e, t, lag(t) OVER w AS pt, lag(e) OVER w AS pe FROM ev WHERE e IN ('signup', 'error') "
        "WINDOW w AS (PARTITION BY worker, operator ORDER BY seq)) WHERE e = 'error' AND pe = 'signup'"
    ),
    "stream_timeline": query("SELECT worker, 'Activation' AS kind, ref_id, start_ns, duration_ns, 1::BIGINT AS collapsed_events FROM active_line", _ACTIVE),
    "stream_summation": query(
        "SELECT worker, operator, max(size) AS max_size, min(size) AS min_size, sum(size)::BIGINT AS total, count(*) AS count FROM dif WHERE e = 'purchase' GROUP BY 1, 2"
    ),
    "stream_total_runtime": query("SELECT worker, min(t) AS start_ns, max(t) AS end_ns FROM ev GROUP BY 1"),
    "stream_session": query(
        """SELECT worker, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS "end", count(*) AS events FROM (
  SELECT worker, ts, sum(opens) OVER (PARTITION BY worker ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM (
    SELECT worker, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY worker ORDER BY ts) + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS opens FROM ev)) GROUP BY worker, n"""
    ),
    "stream_gated": query("SELECT seq, t AS time_ns, worker, operator FROM ev"),
    "stream_late": query("SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS start, count(*) AS events FROM ev GROUP BY 1"),
    "stream_tumbling": query("SELECT worker, (t // 5000000 + 1) * 5000000 AS bucket_ns, count(*) AS events FROM ev GROUP BY 1, 2"),
}
