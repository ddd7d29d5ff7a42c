"""Graph tables, randomisation and deterministic selections."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, resample, rewire, selection
from ..plans.session import saved
from .registry import query, r6

# Classes that play the source and the target roles of the bipartite sub-graph.
SOURCE_CLASSES = ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5", "Brand#6", "Brand#7", "Brand#8"]
TARGET_CLASSES = ["Brand#9", "Brand#10", "Brand#11", "Brand#12", "Brand#13", "Brand#14"]


def _in(names):
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


SIGN = "CASE WHEN {0}.transmitter = 'gaba' THEN -1 ELSE 1 END"
KEPT = f""", kept AS (SELECT pre, post, contacts, {SIGN.format("s")} AS sign, s.type AS source_type, s.class AS source_class,
    s.transmitter, d.type AS target_type, d.class AS target_class FROM edges JOIN nodes s ON pre = s.id JOIN nodes d ON post = d.id),
 typed AS (SELECT *, CASE WHEN source_class IN {_in(SOURCE_CLASSES)} THEN source_type ELSE 'non-source' END AS source_role,
    CASE WHEN target_class IN {_in(TARGET_CLASSES)} THEN target_type ELSE 'non-target' END AS target_role FROM kept)"""


@query("graph_import", "edges nodes", """, flagged AS (SELECT e.*, s.id IS NOT NULL AND d.id IS NOT NULL AS kept
    FROM edges e LEFT JOIN nodes s ON pre = s.id LEFT JOIN nodes d ON post = d.id)
SELECT count(*) AS source_edges, CAST(sum(contacts) AS BIGINT) AS source_contacts, count(*) FILTER (kept) AS edges,
  CAST(sum(contacts) FILTER (kept) AS BIGINT) AS contacts, count(*) FILTER (NOT kept) AS excluded_edges,
  CAST(coalesce(sum(contacts) FILTER (NOT kept), 0) AS BIGINT) AS excluded_contacts,
  count(*) FILTER (kept AND contacts = 1) AS weak_edges, count(*) FILTER (kept AND pre = post) AS self_edges,
  (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM nodes WHERE transmitter IN ('acetylcholine,gaba', 'dopamine'))
    AS uncertain_nodes, (SELECT count(*) FROM nodes WHERE transmitter = 'gaba') AS negative_nodes FROM flagged""")
def _(t):
    return graph.import_report(t.edges(), t.nodes())


@query("import_gates", "edges all_nodes", """, source AS (SELECT pre, post, CASE WHEN pre % 11 = 2 AND post % 7 = 1 THEN 0 WHEN post % 97 = 3
    THEN 5000000000 ELSE contacts END AS contacts FROM edges UNION ALL SELECT pre, post, NULL FROM edges WHERE post % 53 = 1),
 listed AS (SELECT CASE WHEN id % 89 = 5 THEN -id ELSE id END AS id FROM all_nodes UNION ALL SELECT id FROM all_nodes WHERE id % 43 = 5),
 pairs AS (SELECT pre, post, count(*) AS n FROM source GROUP BY ALL), ids AS (SELECT id, count(*) AS n FROM listed GROUP BY ALL)
SELECT count(*) FILTER (n > 1) AS repeated_pairs, CAST(sum(n - 1) AS BIGINT) AS surplus_edges,
  (SELECT count(*) FROM source WHERE contacts IS NULL OR contacts < 1 OR contacts > 4294967295) AS bad_contacts,
  (SELECT count(*) FROM ids WHERE n > 1) AS repeated_ids, (SELECT count(*) FROM listed WHERE id < 0) AS bad_ids FROM pairs""")
def _(t):
    edges = t.edges().select("pre", "post", "contacts")
    wrong = F.expr("CASE WHEN pre % 11 = 2 AND post % 7 = 1 THEN 0 WHEN post % 97 = 3 THEN 5000000000 ELSE contacts END")
    source = edges.withColumn("contacts", wrong).unionByName(edges.where("post % 53 = 1").withColumn("contacts", F.lit(None).cast("long")))
    ids = t.all_nodes().select("id")
    listed = ids.selectExpr("CASE WHEN id % 89 = 5 THEN -id ELSE id END AS id").unionByName(ids.where("id % 43 = 5"))
    return graph.import_gates(source, listed)


@query("annotation_align", "all_nodes nodes", """, raw AS (SELECT id, type, CASE WHEN id % 17 = 3 THEN 'x' ELSE class END AS class,
    CASE WHEN id % 19 = 4 THEN NULL ELSE transmitter END AS transmitter FROM all_nodes WHERE id % 31 <> 9
    UNION ALL SELECT id, type, class, transmitter FROM all_nodes WHERE id % 43 = 5),
 side AS (SELECT id, count(*) AS copies, min(type) AS type, min(class) AS class, min(transmitter) AS transmitter FROM raw GROUP BY id),
 joined AS (SELECT n.*, copies, r.type AS t2, r.class AS c2, r.transmitter AS m2 FROM nodes n LEFT JOIN side r ON r.id = n.id)
SELECT 'missing' AS check, count(*) FILTER (copies IS NULL) AS rows FROM joined
UNION ALL SELECT 'repeated', count(*) FILTER (copies > 1) FROM joined
UNION ALL SELECT 'type', count(*) FILTER (copies IS NOT NULL AND coalesce(type, '') <> coalesce(t2, '')) FROM joined
UNION ALL SELECT 'class', count(*) FILTER (copies IS NOT NULL AND coalesce(class, '') <> coalesce(c2, '')) FROM joined
UNION ALL SELECT 'transmitter', count(*) FILTER (copies IS NOT NULL AND coalesce(transmitter, '') <> coalesce(m2, '')) FROM joined""")
def _(t):
    nodes = t.all_nodes().select("id", "type", "class", "transmitter")
    raw = nodes.where("id % 31 <> 9").withColumns({
        "class": F.expr("CASE WHEN id % 17 = 3 THEN 'x' ELSE class END"),
        "transmitter": F.expr("CASE WHEN id % 19 = 4 THEN NULL ELSE transmitter END"),
    }).unionByName(nodes.where("id % 43 = 5"))
    return graph.annotation_align(t.nodes(), raw, ["type", "class", "transmitter"])


@query("reconcile", "all_nodes nodes", """, listed AS (SELECT CASE WHEN id % 29 = 1 THEN 'x' || id WHEN id % 47 = 2 THEN CAST(id + 1
    AS VARCHAR) ELSE CAST(id AS VARCHAR) END AS id_text, CASE WHEN id % 37 = 6 THEN 'OTHER' ELSE type END AS kind FROM all_nodes),
 numbered AS (SELECT *, TRY_CAST(id_text AS BIGINT) AS id FROM listed)
SELECT id_text, kind, CASE WHEN l.id IS NULL THEN 'invalid_id' WHEN count(*) OVER (PARTITION BY l.id) > 1 THEN 'duplicate'
  WHEN n.id IS NULL THEN 'unmatched' WHEN n.type <> kind THEN 'type_mismatch'
  WHEN kind = 'PROMO' AND n.class <> 'Brand#1' THEN 'class_mismatch' ELSE 'matched' END AS state
FROM numbered l LEFT JOIN nodes n ON n.id = l.id""")
def _(t):
    listed = t.all_nodes().selectExpr(
        "CASE WHEN id % 29 = 1 THEN concat('x', id) WHEN id % 47 = 2 THEN cast(id + 1 AS STRING) ELSE cast(id AS STRING) END "
        "AS id_text", "CASE WHEN id % 37 = 6 THEN 'OTHER' ELSE type END AS kind")
    return graph.reconcile(listed, t.nodes(), {"PROMO": "Brand#1"})


@query("role_edges", "edges nodes", f"""{KEPT}
SELECT pre, post, CASE WHEN target_class IN ('Brand#9', 'Brand#10', 'Brand#11') THEN 'home' ELSE 'away' END AS channel,
  contacts * sign AS weight
FROM kept WHERE source_class IN {_in(SOURCE_CLASSES)} AND target_class IN {_in(TARGET_CLASSES)}""")
def _(t):
    nodes = t.nodes()
    sources = nodes.where(F.col("class").isin(SOURCE_CLASSES))
    channel = F.when(F.col("class").isin(TARGET_CLASSES[:3]), "home").otherwise("away")
    targets = nodes.where(F.col("class").isin(TARGET_CLASSES)).withColumn("channel", channel)
    rows = graph.role_edges(graph.retained(t.edges(), nodes), sources, targets, "channel")
    return rows.select("pre", "post", "channel", (F.col("contacts") * F.col("sign")).alias("weight"))


_TOTALS = """SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(ic) AS BIGINT) AS in_contacts,
  CAST(sum(oc) AS BIGINT) AS out_contacts, CAST(sum(isg) AS BIGINT) AS in_signed, CAST(sum(osg) AS BIGINT) AS out_signed FROM (
  SELECT post AS id, 1 AS i, 0 AS o, contacts AS ic, 0 AS oc, contacts * sign AS isg, 0 AS osg FROM {0}
  UNION ALL SELECT pre, 0, 1, 0, contacts, 0, contacts * sign FROM {0}) GROUP BY id"""


@query("node_totals", "edges nodes", f"{KEPT} {_TOTALS.format('kept')}")
def _(t):
    return graph.node_totals(graph.retained(t.edges(), t.nodes()))


def _typed(t):
    """Retained edges with type, class and role columns of both ends."""
    sign, _ = text.token_sign(F.col("transmitter"))
    return graph.with_ends(
        t.edges(), t.nodes(),
        [sign.alias("sign"), F.col("type").alias("source_type"), F.col("class").alias("source_class"), "transmitter"],
        [F.col("type").alias("target_type"), F.col("class").alias("target_class")])


@query("type_summary", "edges nodes", f"""{KEPT}, c AS (SELECT *, CASE WHEN target_class IN {_in(TARGET_CLASSES)} THEN 'home'
    ELSE 'away' END AS channel FROM kept)
SELECT source_type AS type, {", ".join(f"count(*) FILTER (channel = '{c}') AS {c}_edges, CAST(coalesce(sum(contacts) FILTER "
  f"(channel = '{c}'), 0) AS BIGINT) AS {c}_contacts, count(*) FILTER (channel = '{c}' AND sign > 0) AS {c}_eligible"
  for c in ("home", "away"))} FROM c GROUP BY source_type""")
def _(t):
    rows = _typed(t).withColumn("channel", F.when(F.col("target_class").isin(TARGET_CLASSES), "home").otherwise("away"))
    return graph.type_summary(rows.withColumnRenamed("source_type", "type"), ["home", "away"], F.col("sign") > 0)


@query("target_summary", "edges nodes", f"""{KEPT}
SELECT target_type AS type, post, count(*) AS incoming_edges, CAST(sum(contacts) AS BIGINT) AS incoming_contacts,
  count(*) FILTER (source_class IN {_in(SOURCE_CLASSES)}) AS subset_edges, CAST(coalesce(sum(contacts) FILTER (source_class IN
  {_in(SOURCE_CLASSES)}), 0) AS BIGINT) AS subset_contacts FROM kept GROUP BY GROUPING SETS ((target_type), (target_type, post))""")
def _(t):
    return graph.target_summary(_typed(t).withColumnRenamed("target_type", "type"), F.col("source_class").isin(SOURCE_CLASSES))


@query("input_breakdown", "edges nodes", f"""{KEPT}, n AS (SELECT post, nullif(source_class, 'Brand#1') AS source_class,
    transmitter, sign, source_type, contacts FROM kept)
SELECT post, source_class, transmitter, source_type, CAST(GROUPING(post, source_class, transmitter, source_type) AS BIGINT) AS grain,
  count(*) AS edges, CAST(sum(contacts) AS BIGINT) AS contacts, CAST(sum(contacts * sign) AS BIGINT) AS signed
FROM n GROUP BY GROUPING SETS ((post, source_class), (post, transmitter), (post, source_type))""")
def _(t):
    rows = _typed(t).withColumn("source_class", F.expr("nullif(source_class, 'Brand#1')"))
    return graph.input_breakdown(rows, [["post", "source_class"], ["post", "transmitter"], ["post", "source_type"]])


@query("annotation_groups", "nodes", """
SELECT type, nullif(class, 'Brand#7') AS class, CASE WHEN size < 20 THEN 'L' WHEN size < 35 THEN 'R' END AS side, count(*) AS cells
FROM nodes GROUP BY ALL""")
def _(t):
    return t.nodes().selectExpr(
        "type", "nullif(class, 'Brand#7') AS class", "CASE WHEN size < 20 THEN 'L' WHEN size < 35 THEN 'R' END AS side",
    ).groupBy("type", "class", "side").agg(F.count("*").alias("cells"))


@query("contact_scope", "edges nodes", f"""{KEPT}, sources AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'home' ELSE 'away' END AS channel
    FROM nodes WHERE type = 'PROMO'),
 targets AS (SELECT id FROM nodes WHERE class IN {_in(TARGET_CLASSES)}),
 per_target AS (SELECT channel, post, count(*) AS n, sum(contacts) AS contacts FROM kept JOIN sources ON pre = sources.id
    JOIN targets ON post = targets.id GROUP BY ALL)
SELECT channel, sources, count(post) AS by_any, count(*) FILTER (n = sources) AS by_all, CAST(coalesce(sum(contacts), 0) AS BIGINT)
  AS contacts, (SELECT count(*) FROM targets) - count(post) AS by_none
FROM (SELECT channel, count(*) AS sources FROM sources GROUP BY channel) LEFT JOIN per_target USING (channel) GROUP BY ALL""")
def _(t):
    nodes = t.nodes()
    sources = nodes.where("type = 'PROMO'").select(
        "id", F.expr("CASE WHEN id % 2 = 0 THEN 'home' ELSE 'away' END").alias("channel"))
    targets = nodes.where(F.col("class").isin(TARGET_CLASSES)).select("id")
    return graph.contact_scope(graph.retained(t.edges(), nodes), sources, targets)


_INSIDE = """, inside AS (SELECT pre, post, contacts FROM edges WHERE pre IN (SELECT id FROM nodes) AND post IN (SELECT id FROM nodes))"""


@query("row_normalize", "edges nodes", f"""{_INSIDE}
SELECT post, pre, {r6("contacts / sum(contacts) OVER (PARTITION BY post)")} AS share FROM inside WHERE pre <> post""")
def _(t):
    return graph.row_normalize(t.edges(), t.nodes()).select("post", "pre", F.round("share", 6).alias("share"))


@query("row_normalize_audit", "edges nodes", f"""{_INSIDE}
SELECT count(*) FILTER (pre <> post) AS pairs, count(*) FILTER (pre = post) AS self_pairs,
  (SELECT count(*) FROM nodes) - count(DISTINCT CASE WHEN pre <> post THEN post END) AS empty_rows FROM inside""")
def _(t):
    return graph.row_normalize_audit(t.edges(), t.nodes())


@query("pair_groups", "edges nodes", f"""{KEPT}
SELECT source_type, target_type, row_number() OVER (ORDER BY source_type, target_type) - 1 AS group_id, edges
FROM (SELECT source_type, target_type, count(*) AS edges FROM kept WHERE target_class IN {_in(TARGET_CLASSES)} GROUP BY ALL)""")
def _(t):
    rows = _typed(t).where(F.col("target_class").isin(TARGET_CLASSES))
    return graph.pair_groups(rows, ["source_type", "target_type"])


def _strata(t):
    return graph.with_strata(t.edges(), t.nodes(), SOURCE_CLASSES, TARGET_CLASSES)


@query("strata", "edges nodes", f"""{KEPT}
SELECT contacts, sign, source_role, target_role, count(*) AS edges FROM typed GROUP BY ALL""")
def _(t):
    return _strata(t).groupBy(*graph.STRATUM).agg(F.count("*").alias("edges"))


SEED, SWEEPS = 11, 5
_S = ", ".join(graph.STRATUM)
def _sweep_sql(number, before):
    """One sweep as SQL over the state CTE ``before`` (pre, post, origin, stratum columns)."""
    i = number
    same = " AND ".join(f"a.{c} = b.{c}" for c in graph.STRATUM)
    return f""", ranked{i} AS (SELECT {_S}, pre, post, origin, row_number() OVER (PARTITION BY {_S} ORDER BY
    md5(concat_ws(':', '{SEED}', '{i}', pre, origin)), pre, origin) - 1 AS k FROM {before} WHERE pre <> origin),
 pairs{i} AS (SELECT a.*, b.pre AS pre2, b.post AS post2, b.origin AS origin2 FROM ranked{i} a JOIN ranked{i} b ON {same}
   AND a.k % 2 = 0 AND b.k = a.k + 1),
 proposed{i} AS (SELECT pre, post2 AS new FROM pairs{i} UNION ALL SELECT pre2, post FROM pairs{i}),
 clash{i} AS (SELECT pre, new FROM proposed{i} GROUP BY ALL HAVING count(*) > 1 UNION SELECT pre, post FROM {before}),
 accepted{i} AS (SELECT p.* FROM pairs{i} p WHERE pre <> post2 AND pre2 <> post AND pre <> pre2 AND post <> post2
   AND NOT EXISTS (SELECT 1 FROM clash{i} c WHERE c.pre = p.pre AND c.new = p.post2)
   AND NOT EXISTS (SELECT 1 FROM clash{i} c WHERE c.pre = p.pre2 AND c.new = p.post)),
 moves{i} AS (SELECT pre, origin, post2 AS post FROM accepted{i} UNION ALL SELECT pre2, origin2, post FROM accepted{i}),
 state{i + 1} AS (SELECT t.pre, coalesce(m.post, t.post) AS post, t.origin, {_S}, t.fixed FROM {before} t
           LEFT JOIN moves{i} m ON m.pre = t.pre AND m.origin = t.origin)"""


_START = f"{KEPT}, state0 AS (SELECT pre, post, post AS origin, {_S}, pre = post AS fixed FROM typed)"
_SWEEP = f"{_START}{_sweep_sql(0, 'state0')}, after AS (SELECT * FROM state1)"
_SWEEPS = f"{_START}{''.join(_sweep_sql(i, f'state{i}') for i in range(SWEEPS))}, after AS (SELECT * FROM state{SWEEPS})"


def _one_sweep(t):
    return rewire.sweep(saved(rewire.start(_strata(t)), "edges"), SEED, 0)


@query("rewire", "edges nodes", f"{_SWEEP} SELECT pre, origin, post, {_S} FROM after")
def _(t):
    return _one_sweep(t).select("pre", "origin", "post", *graph.STRATUM)


@query("rewire_invariants", "edges nodes", f"""{_SWEEPS}, old AS ({_TOTALS.format("typed")}), new AS ({_TOTALS.format("after")})
SELECT count(*) AS nodes, {", ".join(f"count(*) FILTER (o.{c} IS DISTINCT FROM n.{c}) AS {c}" for c in
  ("in_degree", "out_degree", "in_contacts", "out_contacts", "in_signed", "out_signed"))},
  (SELECT count(*) FROM (SELECT 1 FROM after GROUP BY pre, post HAVING count(*) > 1)) AS repeated_edges,
  (SELECT count(*) FROM after WHERE pre = post) - (SELECT count(*) FROM typed WHERE pre = post) AS new_self_edges,
  (SELECT count(*) FROM (SELECT {_S}, count(*) FROM typed GROUP BY ALL EXCEPT SELECT {_S}, count(*) FROM after GROUP BY ALL))
    AS changed_strata
FROM old o FULL JOIN new n USING (id)""")
def _(t):
    before = saved(_strata(t), "before")
    return rewire.invariants(before, rewire.rewire(before, SEED, SWEEPS))


@query("change_report", "edges nodes", f"""{_SWEEP}
SELECT {_S}, count(*) AS edges, count(*) FILTER (post <> origin) AS changed, count(*) FILTER (fixed) AS self_edges
FROM after GROUP BY GROUPING SETS ((), ({_S}))""")
def _(t):
    return rewire.change_report(_one_sweep(t))


@query("rewire_sweeps", "edges nodes", f"{_SWEEPS} SELECT pre, origin, post, {_S} FROM after")
def _(t):
    return rewire.rewire(_strata(t), SEED, SWEEPS).select("pre", "origin", "post", *graph.STRATUM)


@query("rewire_report", "edges nodes", f"{_SWEEPS} " + " UNION ALL ".join(
    f"SELECT {i} AS sweep, (SELECT count(*) FROM pairs{i}) AS proposed, (SELECT count(*) FROM accepted{i}) AS accepted" for i in range(SWEEPS)))
def _(t):
    return rewire.rewire_report(_strata(t), SEED, SWEEPS)


@query("edge_scale", "edges nodes", f"""{KEPT}
SELECT pre, post, CAST(CASE WHEN target_type = 'ECONOMY' THEN 0 WHEN transmitter = 'acetylcholine,gaba' THEN -abs(w) ELSE w END AS DOUBLE)
  AS weight FROM (SELECT *, contacts * sign * CASE WHEN source_type = 'PROMO' THEN 0.5 ELSE 1 END::DOUBLE AS w FROM kept)""")
def _(t):
    mixed = text.only_tokens(F.col("transmitter"), ["acetylcholine", "gaba"]) & F.col("transmitter").contains(",")
    factor = F.when(F.col("source_type") == "PROMO", 0.5).otherwise(1.0)
    return graph.edge_scale(_typed(t), factor, F.col("target_type") == "ECONOMY", mixed)


@query("topk_inputs", "edges nodes", f"""{KEPT}
SELECT post, rank, pre, contacts FROM (SELECT *, row_number() OVER (PARTITION BY post ORDER BY contacts DESC, pre) AS rank FROM kept)
WHERE rank <= 20""")
def _(t):
    return graph.top_inputs(graph.retained(t.edges(), t.nodes()), 20).select("post", "rank", "pre", "contacts")


_CATEGORY = f"CASE WHEN class IN {_in(SOURCE_CLASSES[:2])} THEN 'source' WHEN class IN {_in(TARGET_CLASSES[:2])} THEN 'target' ELSE 'other' END"


def _even(source, group, size):
    """Rows of ``source`` at positions floor(i * (n - 1) / (k - 1)) by id."""
    by = f"PARTITION BY {group}" if group else ""
    return f"""(SELECT * FROM (SELECT *, row_number() OVER ({by} ORDER BY id) - 1 AS pos, count(*) OVER ({by}) AS n FROM {source})
      WHERE n <= ({size}) OR pos IN (SELECT CAST(floor(i.range * (n - 1) / (({size}) - 1)) AS BIGINT) FROM range(100000) i
      WHERE i.range < ({size})))"""


_SAMPLE = f""", cat AS (SELECT *, {_CATEGORY} AS category FROM nodes),
 covered AS (SELECT id FROM {_even("(SELECT * FROM cat WHERE category <> 'other')", "category", "32")}),
 rest AS (SELECT id FROM {_even("(SELECT * FROM cat WHERE id NOT IN (SELECT id FROM covered))", "", "600 - (SELECT count(*) FROM covered)")}),
 sample AS (SELECT id FROM covered UNION ALL SELECT id FROM rest)"""


def _sample(t):
    category = text.category([(F.col("class").isin(SOURCE_CLASSES[:2]), "source"),
                              (F.col("class").isin(TARGET_CLASSES[:2]), "target")], "other")
    return graph.graph_sample(t.nodes(), category, 32, 600)


@query("graph_sample", "nodes", f"""{_SAMPLE}, box AS (SELECT min(size) AS a, max(size) AS b, min(price) AS c, max(price) AS d
    FROM nodes JOIN sample USING (id))
SELECT id, category, {r6("(size - (a + b) / 2) / greatest((b - a) / 2, (d - c) / 2, 1)")} AS x,
  {r6("(price - (c + d) / 2) / greatest((b - a) / 2, (d - c) / 2, 1)")} AS y
FROM cat JOIN sample USING (id), box""")
def _(t):
    points = _sample(t).select("id", "category", F.col("size").cast("double").alias("x"), F.col("price").alias("y"))
    out = graph.normalised(points, ["x", "y"])
    return out.select("id", "category", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("strong_edges", "edges nodes", f"""{_SAMPLE}
SELECT pre, post, contacts FROM edges WHERE contacts >= 1 AND pre IN (SELECT id FROM sample) AND post IN (SELECT id FROM sample)
ORDER BY contacts DESC, pre DESC, post DESC LIMIT 3500""")
def _(t):
    return graph.strong_edges(t.edges(), _sample(t), 1, 3500)


@query("pathway_support", "edges nodes", f"""{KEPT}
SELECT source_type, target_type, count(*) AS pairs, CAST(sum(contacts) AS BIGINT) AS contacts, count(DISTINCT pre) AS sources
FROM kept GROUP BY ALL""")
def _(t):
    return graph.pathway_support(_typed(t))


@query("node_atlas", "edges nodes", f"""{KEPT}, roles AS (SELECT id, concat_ws(';', CASE WHEN class IN {_in(SOURCE_CLASSES)} THEN 'source' END,
    CASE WHEN class IN {_in(TARGET_CLASSES)} THEN 'target' END, CASE WHEN transmitter = 'dopamine' THEN 'teaching' END) AS roles FROM nodes),
 support AS (SELECT pre, count(*) FILTER (target_class IN {_in(TARGET_CLASSES[:3])}) AS home_edges,
    count(*) FILTER (target_class IN {_in(TARGET_CLASSES[3:])}) AS away_edges FROM kept GROUP BY pre)
SELECT id, roles, coalesce(home_edges, 0) AS home_edges, coalesce(away_edges, 0) AS away_edges
FROM roles LEFT JOIN support ON pre = id WHERE roles <> ''""")
def _(t):
    roles = [("source", F.col("class").isin(SOURCE_CLASSES)), ("target", F.col("class").isin(TARGET_CLASSES)),
             ("teaching", F.col("transmitter") == "dopamine")]
    support = _typed(t).withColumn("channel", F.when(F.col("target_class").isin(TARGET_CLASSES[:3]), "home").when(
        F.col("target_class").isin(TARGET_CLASSES[3:]), "away"))
    return graph.node_atlas(t.nodes(), roles, support, ["home", "away"])


PHASES = [("pre_onset", 0, 480), ("stimulus", 480, 960), ("post", 960, 1440)]
_FAMILY = "CASE WHEN starts_with(type, 'ECO') THEN 'economy' WHEN starts_with(type, 'PRO') THEN 'promotion' ELSE 'other' END"
_ARRIVALS = f""", emissions AS (SELECT DISTINCT CAST(ts AS DATE) AS trial, unit AS node, hour(ts) * 60 + minute(ts) AS step FROM trials),
 reversed AS (SELECT post AS pre, pre AS post, contacts, {_FAMILY} AS family FROM edges JOIN all_nodes ON post = id),
 landed AS (SELECT trial, r.post AS node, step + 9 AS due, family, count(*) AS edge_events, sum(contacts) AS contact_events
   FROM emissions e JOIN reversed r ON r.pre = e.node GROUP BY ALL),
 judged AS (SELECT l.*, p.step AS previous, h.step AS here FROM landed l
   ASOF LEFT JOIN emissions p ON p.trial = l.trial AND p.node = l.node AND p.step < l.due
   LEFT JOIN emissions h ON h.trial = l.trial AND h.node = l.node AND h.step = l.due),
 totals AS (SELECT trial, CASE WHEN due < 480 THEN 'pre_onset' WHEN due < 960 THEN 'stimulus' WHEN due < 1440 THEN 'post' ELSE 'beyond' END
   AS phase, family, CASE WHEN due >= 1440 THEN 'pending' WHEN previous IS NULL OR due >= previous + 11 THEN CASE WHEN here IS NOT NULL
   THEN 'same_step' ELSE 'accepted' END ELSE 'rejected' END AS status, sum(edge_events) AS edge_events, sum(contact_events)
   AS contact_events FROM judged GROUP BY ALL)"""


def _arrivals(t):
    emissions = t.trials().select(F.col("ts").cast("date").alias("trial"), F.col("unit").alias("node"),
                                  (F.hour("ts") * 60 + F.minute("ts")).alias("step")).distinct()
    family = text.label_family(F.col("type"), [("ECO", "economy"), ("PRO", "promotion")])
    named = t.all_nodes().select("id", family.alias("family"))
    edges = t.edges().join(named, F.col("post") == F.col("id")).select(
        F.col("post").alias("pre"), F.col("pre").alias("post"), "contacts", "family")
    return graph.edge_arrivals(emissions, edges, PHASES, 1440)


@query("edge_arrivals", "trials edges all_nodes", f"""{_ARRIVALS}
SELECT phase, family, status, count(*) AS trials, {r6("avg(edge_events)")} AS mean, {r6("stddev_samp(edge_events)")} AS sd,
  CAST(sum(contact_events) AS BIGINT) AS contacts FROM totals GROUP BY ALL""")
def _(t):
    by = ["phase", "family", "status"]
    rows = graph.mean_over_trials(_arrivals(t), by, "edge_events", {"contacts": "contact_events"})
    return rows.select(*by, "trials", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "contacts")


@query("hash_topn", sql="""
SELECT key, rank, item FROM (SELECT c_name AS key, item, row_number() OVER (PARTITION BY c_name ORDER BY
  sha256(concat_ws(':', 'identity-01', c_name, item)), item) AS rank FROM customer, (SELECT DISTINCT p_brand AS item FROM part))
WHERE rank <= 4""")
def _(t):
    keys = t.read("customer").select(F.col("c_name").alias("key"))
    items = t.read("part").select(F.col("p_brand").alias("item"))
    return selection.hash_top(keys, "key", items, "item", 4, "identity-01")


@query("interleave", sql="""
WITH k AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'L' ELSE 'R' END AS side, row_number() OVER (PARTITION BY p_partkey % 2
    ORDER BY sha256(concat_ws(':', 'contact-01', p_partkey))) AS k FROM part),
 shortest AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM k GROUP BY side))
SELECT (k - 1) * 2 + CASE side WHEN 'R' THEN 2 ELSE 1 END AS position, p_partkey, side FROM k, shortest WHERE k <= n""")
def _(t):
    rows = t.read("part").select("p_partkey", F.expr(
        "CASE WHEN p_partkey % 2 = 0 THEN 'L' ELSE 'R' END").alias("side"))
    return selection.interleave(rows, "p_partkey", "side", ["L", "R"], "contact-01")


@query("slot_assign", "edges all_nodes", """, strength AS (SELECT name, sum(contacts) AS strength FROM edges JOIN all_nodes ON post = id GROUP BY name),
 kept AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY strength, name) AS s FROM strength),
 dealt AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS r, n // 5 AS per FROM kept WHERE s > n % 5)
SELECT name, CAST(strength AS BIGINT) AS strength, CAST(r % 5 AS INTEGER) AS feature, round(CASE WHEN per > 1 THEN -1.5 + (r // 5) * 3.0 /
  (per - 1) ELSE 0 END, 6) + 0.0 AS centre FROM dealt""")
def _(t):
    ports = t.all_nodes().select(F.col("id").alias("post"), "name")
    strength = t.edges().join(ports, "post").groupBy("name").agg(F.sum("contacts").alias("strength"))
    out = selection.slot_assign(strength, "name", "strength", 5)
    return out.withColumn("centre", F.round("centre", 6))


@query("even_sample", "games", """, placed AS (SELECT game_id, sport, row_number() OVER (PARTITION BY sport ORDER BY start_time, game_id) - 1
    AS pos, count(*) OVER (PARTITION BY sport) AS n FROM games WHERE outcome IS NOT NULL)
SELECT DISTINCT game_id, sport FROM placed JOIN range(16) i ON pos = CAST(floor(i.range * (n - 1) / 15) AS BIGINT)""")
def _(t):
    rows = t.games().where("outcome is not null").select("game_id", "sport", "start_time")
    return graph.even_sample(rows, ["sport"], [F.col("start_time"), F.col("game_id")], F.lit(16)).select("game_id", "sport")


@query("block_shuffle", "games", """, coded AS (SELECT game_id, outcome, sport, CAST(date_trunc('week', start_time) AS DATE) AS week FROM games
    WHERE outcome IS NOT NULL),
 a AS (SELECT *, row_number() OVER (PARTITION BY sport, week ORDER BY md5(concat_ws(':', '991', 'place', game_id)), game_id) AS k FROM coded),
 b AS (SELECT *, row_number() OVER (PARTITION BY sport, week ORDER BY md5(concat_ws(':', '991', 'source', game_id)), game_id) AS k FROM coded)
SELECT a.sport, a.week, a.game_id, b.game_id AS from_key, b.outcome AS shuffled_outcome FROM a JOIN b USING (sport, week, k)""")
def _(t):
    from ..functions.fixtures import week_start
    rows = t.games().where("outcome is not null").select("game_id", "outcome", "sport", week_start(F.col("start_time")).alias("week"))
    return resample.block_shuffle(rows, ["sport", "week"], "game_id", "991", ["outcome"])


@query("panel_slice", "games", """
SELECT game_id, seed_set, condition, game_id * 1000 + salt AS seed FROM (SELECT game_id FROM games WHERE sport = 'baseball'
  ORDER BY start_time, game_id LIMIT 8 OFFSET 4), (VALUES ('base', 0), ('alt', 500)) s(seed_set, salt),
  (VALUES ('frozen'), ('untaught'), ('home'), ('away')) c(condition)""")
def _(t):
    rows = t.games().where("sport = 'baseball'").select("game_id", "start_time")
    return selection.panel_slice(rows, [F.col("start_time"), F.col("game_id")], "game_id", 4, 8, {"base": 0, "alt": 500},
                                 ["frozen", "untaught", "home", "away"])


@query("schedule_expand", sql="""
SELECT c_custkey, i.range AS cycle FROM customer JOIN range(6) i ON i.range < least(6, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 8 ELSE 6 END)""")
def _(t):
    retired = F.expr("CASE WHEN c_custkey % 3 > 0 THEN cast(c_custkey % 8 AS INT) END")
    return selection.schedule_expand(t.read("customer"), "c_custkey", 6, retired)
