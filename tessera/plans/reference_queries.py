"""Queries over name relations, candidates, guarded paths and node support, on tables derived from parts and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import hierarchy, relations

from .name_queries import case, quoted
from .registry import query
from .stand_ins import table

# Columns as SQL that Spark and DuckDB both take.
K = "CAST(p_partkey AS STRING)"
#: Every tenth part has the name of the one before it.
SCIENCE = "'taxon ' || CAST(CASE WHEN p_partkey % 10 = 1 THEN p_partkey - 1 ELSE p_partkey END AS STRING)"
ACTIVE = "p_partkey % 13 <> 0 AND p_partkey % 11 <> 0"
RECORDS = ["p_partkey AS record", f"CASE WHEN p_partkey % 7 = 3 THEN 'unknown ' || {K} ELSE {SCIENCE} END AS scientific_name", "p_name || ' ' || p_brand AS phrase", f"{case('p_partkey', *quoted('usage', 'domestic_form', 'usage', 'usage', 'usage'))} AS entity_kind"]
TAXA = ["p_partkey AS taxon", f"{SCIENCE} AS scientific_name"]
_REL = f"""rec AS (SELECT {', '.join(RECORDS)} FROM part), taxa AS (SELECT {', '.join(TAXA)} FROM part WHERE {ACTIVE}),
t AS (SELECT scientific_name, count(DISTINCT taxon) AS targets, min(taxon) AS sole FROM taxa GROUP BY 1),
pr AS (SELECT record, scientific_name, list_transform(string_split(phrase, ' '), lambda x: lower(x)) AS terms, entity_kind, CASE WHEN targets = 1 THEN sole END AS taxon,
  CASE WHEN targets IS NULL THEN 'no_active_taxon' WHEN targets > 1 THEN 'ambiguous_taxon' ELSE 'projected' END AS reason FROM rec LEFT JOIN t USING (scientific_name)),
mf AS (SELECT * FROM pr WHERE reason = 'projected'),
nm AS (SELECT DISTINCT record, entity_kind, unnest(list_append(terms, lower(scientific_name))) AS name FROM mf),
look AS (SELECT name, count(*) AS expected, count(e.taxon) AS relations, count(DISTINCT e.taxon) AS taxa, coalesce(bool_or(entity_kind = 'domestic_form' AND e.taxon IS NOT NULL), false) AS domestic
  FROM nm LEFT JOIN (SELECT record, taxon FROM mf WHERE record % 97 <> 5) e USING (record) GROUP BY 1)"""
_STATUS = "CASE WHEN coalesce(expected, 0) > coalesce(relations, 0) THEN 'incomplete' WHEN coalesce(relations, 0) = 0 THEN 'none' WHEN domestic THEN 'domestic_form' WHEN taxa = 1 THEN 'single' ELSE 'several' END"


def _projected(spark, d):
    p = table(spark, d, "part")
    records = p.selectExpr(*RECORDS).withColumn("terms", F.split("phrase", " ")).drop("phrase")
    return relations.project_relations(records, p.filter(ACTIVE).selectExpr(*TAXA))


def _looked_up(spark, d, names):
    manifest = _projected(spark, d).filter("reason = 'projected'")
    return relations.relation_lookup(names, manifest, manifest.filter("record % 97 <> 5").select("record", "taxon"))


@query("jn32_projected_relations", f"WITH {_REL} SELECT record, taxon, reason, array_to_string(terms, ',') AS terms, (SELECT count(*) FROM mf)::BIGINT AS written, (SELECT count(*) FROM mf) = (SELECT count(*) FROM pr) AS complete FROM pr")
def jn32(spark, d):
    p = _projected(spark, d)
    total = p.agg(F.count_if(F.col("reason") == "projected").alias("written"), F.count("*").alias("records"))
    return p.select("record", "taxon", "reason", F.array_join("terms", ",").alias("terms")).crossJoin(F.broadcast(total)).select("record", "taxon", "reason", "terms", "written", (F.col("written") == F.col("records")).alias("complete"))  # one row of counts


@query("jn24_name_relations", f"WITH {_REL} SELECT name, relations::BIGINT AS relations, (expected - relations)::BIGINT AS missing, {_STATUS} AS status FROM look")
def jn24(spark, d):
    names = relations.by_name(_projected(spark, d).filter("reason = 'projected'"), []).distinct()
    return _looked_up(spark, d, names)


@query("q19_name_relation_lookup", f"WITH {_REL}, q AS (SELECT DISTINCT lower(x) AS name FROM (SELECT scientific_name AS x FROM rec UNION ALL SELECT p_type FROM part UNION ALL SELECT p_brand FROM part)) SELECT name, coalesce(relations, 0)::BIGINT AS relations, coalesce(expected - relations, 0)::BIGINT AS missing, {_STATUS} AS status FROM q LEFT JOIN look USING (name)")
def q19(spark, d):
    p = table(spark, d, "part").selectExpr(RECORDS[1], "p_type", "p_brand")
    names = p.select(F.explode(F.array(*[F.lower(c) for c in ("scientific_name", "p_type", "p_brand")])).alias("name")).distinct()
    return _looked_up(spark, d, names)


# Nodes of four ranks with labels; some labels end in the name of another rank, some names have a rank that they cannot have.
_LETTERS = "translate({0}, '0123456789', 'abcdefghij')"
_EPITHET = _LETTERS.format("CAST(CASE WHEN p_partkey % 10 = 1 THEN p_partkey - 1 ELSE p_partkey END AS STRING)")
_FAMILY = f"'Brand' || {_LETTERS.format('substr(p_brand, 7)')}"
_GENUS = "upper(substr(p_name, 1, 1)) || substr(p_name, 2, 2) || " + _LETTERS.format("substr(p_brand, 7)")
_SPECIES = f"{_GENUS} || ' ' || {_EPITHET}"
NODES = (
    ("order", "p_type", "upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2))", "lower(p_type) || ' order'", "p_type <> 'PROMO'"),
    ("family", "p_brand", _FAMILY, f"lower(p_brand) || {case('p_size', *quoted(' family', ' family', ' genus'))}", "substr(p_brand, 7) <> '13'"),
    ("species", K, f"CASE WHEN p_partkey % 50 = 9 THEN {_GENUS} || {_EPITHET} ELSE {_SPECIES} END", f"p_name || ' ' || CAST(p_partkey - p_partkey % 3 AS STRING)", ACTIVE),
)
_NODE_COLS = [[f"'{rank}:' || {key} AS taxon", f"'{rank}' AS rank", f"{name} AS scientific_name", f"{label} AS label", f"{ok} AS active"] for rank, key, name, label, ok in NODES]
_SURFACE = case("p_partkey", NODES[2][2], NODES[2][3], f"replace({NODES[2][3]}, ' ', '  ')", NODES[0][2], NODES[1][3], NODES[0][3], _FAMILY, f"'Nothing ' || {_EPITHET}", "'no label'", NODES[2][2], f"{_SPECIES} || ' minor'")
_Q06 = f"""WITH nodes AS ({' UNION '.join(f"SELECT DISTINCT {', '.join(c)} FROM part" for c in _NODE_COLS)}), s AS (SELECT p_partkey AS id, {_SURFACE} AS surface FROM part),
live AS (SELECT * FROM nodes WHERE active), sn AS (SELECT scientific_name, count(*) AS n, min(taxon) AS taxon,
  bool_or(NOT CASE len(string_split(scientific_name, ' ')) WHEN 1 THEN rank IN ('order', 'family', 'genus') WHEN 2 THEN rank = 'species' WHEN 3 THEN rank = 'subspecies' ELSE false END) AS wrong FROM live GROUP BY 1),
lb AS (SELECT regexp_replace(label, '\\s+', '', 'g') AS key, count(DISTINCT (taxon, rank, scientific_name, label)) AS n, min((taxon, rank, scientific_name, label)) AS o FROM nodes GROUP BY 1),
lv AS (SELECT rank, scientific_name, count(*) AS nodes, min(taxon) AS live FROM live GROUP BY 1, 2),
a AS (SELECT id, surface, CASE WHEN n IS NULL OR wrong THEN 'not_found' WHEN n > 1 THEN 'ambiguous' END AS reason, taxon FROM s LEFT JOIN sn ON sn.scientific_name = s.surface WHERE regexp_matches(surface, '^[A-Z][a-z]+( [a-z]+){{0,2}}$')),
b AS (SELECT id, surface, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' WHEN regexp_extract(o[4], ' (order|family|genus)$', 1) NOT IN ('', o[2]) THEN 'label_rank_conflict' WHEN coalesce(nodes, 0) <> 1 OR live <> o[1] THEN 'not_found' END AS reason, o[1] AS taxon
  FROM s LEFT JOIN lb ON lb.key = regexp_replace(surface, '\\s+', '', 'g') LEFT JOIN lv ON lv.rank = o[2] AND lv.scientific_name = o[3] WHERE NOT regexp_matches(surface, '^[A-Z][a-z]+( [a-z]+){{0,2}}$'))
SELECT id, surface, reason, CASE WHEN reason IS NULL THEN taxon END AS taxon FROM (SELECT * FROM a UNION ALL SELECT * FROM b)"""


@query("q06_taxon_candidates", _Q06)
def q06(spark, d):
    p = table(spark, d, "part")
    nodes = p.selectExpr(*_NODE_COLS[0]).distinct()
    for cols in _NODE_COLS[1:]:
        nodes = nodes.unionByName(p.selectExpr(*cols).distinct())
    return relations.taxon_candidates(p.selectExpr("p_partkey AS id", f"{_SURFACE} AS surface"), nodes)


# A hierarchy of parts, brand groups and types, whose nodes and edges pass a guard or not.
_GRP = "p_type || '|' || p_brand"
_PATH_NODES = [("'p:' || " + K, ACTIVE), (f"'g:' || {_GRP}", "substr(p_brand, 7) <> '24'"), ("'o:' || p_type", "p_type <> 'SMALL'")]
_PATH_EDGES = [("'p:' || " + K, f"'g:' || {_GRP}", "p_partkey % 19 <> 0"), (f"'g:' || {_GRP}", "'o:' || p_type", "p_brand <> 'Brand#11'")]
_EDGES_SQL = " UNION ".join(f"SELECT DISTINCT {c} AS child, {p} AS parent, {ok} AS ok FROM part" for c, p, ok in _PATH_EDGES)
_FLT07 = f"""WITH RECURSIVE n AS ({' UNION '.join(f'SELECT DISTINCT {x} AS node, {ok} AS ok FROM part' for x, ok in _PATH_NODES)}), g AS (SELECT node FROM n WHERE ok),
e AS (SELECT child, parent FROM ({_EDGES_SQL}) WHERE ok AND child IN (SELECT node FROM g) AND parent IN (SELECT node FROM g)),
w AS (SELECT node, node AS ancestor, 0 AS depth FROM (SELECT child AS node FROM e UNION SELECT parent FROM e) UNION ALL SELECT w.node, e.parent, w.depth + 1 FROM w JOIN e ON e.child = w.ancestor WHERE w.depth < 4)
SELECT * FROM w"""


@query("flt07_path_guard", _FLT07)
def flt07(spark, d):
    p = table(spark, d, "part")
    one = lambda xs, names: [p.selectExpr(*[f"{x} AS {n}" for x, n in zip(t, names, strict=True)]).distinct() for t in xs]
    (a, b, c), (x, y) = one(_PATH_NODES, ("node", "ok")), one(_PATH_EDGES, ("child", "parent", "ok"))
    return relations.guarded_ancestors(a.unionByName(b).unionByName(c), x.unionByName(y))


# Active taxa, a crosswalk and tips with evidence from lines; each rule of the mapping is broken by some keys.
_XK = "CAST(CASE WHEN p_partkey % 31 = 2 THEN p_partkey - 1 ELSE p_partkey END AS STRING)"
_ACTIVE_COLS = ["p_partkey AS taxon", f"{SCIENCE} AS scientific_name", f"'c' || CAST(CASE WHEN p_partkey % 37 = 5 THEN p_partkey - 1 ELSE p_partkey END AS STRING) AS concept", f"'bird ' || {K} AS english"]
_CROSS_COLS = [f"CASE WHEN p_partkey % 41 = 3 THEN 'source ' || CAST(p_partkey - 1 AS STRING) ELSE 'source ' || {K} END AS source_name", f"CASE WHEN p_partkey % 23 = 4 THEN 'old ' || {SCIENCE} ELSE {SCIENCE} END AS current_name", f"'c' || {_XK} AS concept",
  f"CASE WHEN p_partkey % 29 = 6 THEN 'other' ELSE 'bird ' || {K} END AS english", "CASE WHEN p_partkey % 17 = 7 THEN 'form' ELSE 'species' END AS category", f"'n' || CAST(CASE WHEN p_partkey % 43 = 8 THEN p_partkey - 1 ELSE p_partkey END AS STRING) AS number"]
_CONSTRAINTS, _STUDY = ("st3", "st7"), "'st' || CAST(l_suppkey % 20 AS STRING)"
_TIPS = "SELECT p_partkey AS k, count(l_suppkey) > 0 AS evidence FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_suppkey % 20 NOT IN (3, 7) AND l_suppkey % 20 <> 11 AND l_returnflag = 'R' AND l_quantity > 40) ON l_partkey = p_partkey WHERE p_partkey % 19 <> 9 GROUP BY 1"
_MAP = f"""act AS (SELECT {', '.join(_ACTIVE_COLS)} FROM part), cw AS (SELECT {', '.join(_CROSS_COLS)} FROM part), tips AS (SELECT 'source_' || k AS tip, evidence FROM ({_TIPS})),
x AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY concept) AS same_concept, count(*) OVER (PARTITION BY source_name) AS same_source, count(*) OVER (PARTITION BY number) AS same_number FROM cw) WHERE same_concept = 1),
a AS (SELECT *, count(*) OVER (PARTITION BY taxon) AS same_taxon, count(*) OVER (PARTITION BY scientific_name) AS same_name, count(*) OVER (PARTITION BY concept) AS same_active FROM act),
mp AS (SELECT a.taxon, a.scientific_name, x.source_name, CASE WHEN same_taxon > 1 OR same_name > 1 THEN 'ambiguous_active_identity' WHEN x.source_name IS NULL THEN 'no_unique_crosswalk_concept'
  WHEN category <> 'species' OR current_name IS DISTINCT FROM a.scientific_name OR same_source > 1 THEN 'changed_or_ambiguous_source_identity' WHEN same_number <> 1 THEN 'ambiguous_source_identity'
  WHEN same_active > 1 THEN 'ambiguous_concept' WHEN x.english IS DISTINCT FROM a.english THEN 'mismatched_english_identity' WHEN tip IS NULL THEN 'absent_from_phylogeny_only' WHEN NOT evidence THEN 'no_nonconstraint_tip_evidence' END AS reason
  FROM a LEFT JOIN x ON x.concept = a.concept LEFT JOIN tips ON tips.tip = replace(x.source_name, ' ', '_'))"""


def _mapping(spark, d):
    p = table(spark, d, "part")
    lines = table(spark, d, "lineitem").filter("l_suppkey % 20 NOT IN (3, 7, 11) AND l_returnflag = 'R' AND l_quantity > 40").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("some", F.lit(True))
    tips = p.filter("p_partkey % 19 <> 9").join(lines, "p_partkey", "left").select(F.expr(f"'source_' || {K}").alias("tip"), F.coalesce("some", F.lit(False)).alias("evidence"))
    return relations.phylogeny_mapping(p.selectExpr(*_ACTIVE_COLS), p.selectExpr(*_CROSS_COLS), tips)


@query("jn30_phylogeny_mapping", f"WITH {_MAP} SELECT taxon, reason, CASE WHEN reason IS NULL THEN source_name END AS source_name FROM mp")
def jn30(spark, d):
    return _mapping(spark, d)


_SUPPORT = """ann AS (SELECT DISTINCT 'g:' || p_type || '|' || p_brand AS node, l_suppkey % 20 AS study, l_suppkey AS source, CASE WHEN l_returnflag = 'A' THEN 'conflicts' ELSE 'supports' END AS kind FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 49
  UNION SELECT DISTINCT 'o:' || p_type, l_suppkey % 20, l_suppkey, CASE WHEN l_returnflag = 'N' THEN 'conflicts' ELSE 'supports' END FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_discount > 0.09),
sup AS (SELECT node, count(DISTINCT source) FILTER (kind = 'supports' AND study <> 11) AS supporting, count(DISTINCT source) FILTER (kind = 'conflicts') AS conflicting FROM ann WHERE study NOT IN (3, 7) GROUP BY 1 HAVING count(DISTINCT source) FILTER (kind = 'supports' AND study <> 11) > 0)"""


@query("q17_ancestor_arrays", f"""WITH {_MAP}, {_SUPPORT}, u AS (SELECT p_partkey AS taxon, unnest(['o:' || p_type, 'g:' || p_type || '|' || p_brand]) AS node, unnest([1, 2]) AS pos FROM part)
SELECT mp.taxon, mp.reason, CASE WHEN mp.reason IS NULL THEN string_agg(u.node, ',' ORDER BY pos) END AS ancestors, CASE WHEN mp.reason IS NULL THEN count(sup.node)::BIGINT END AS supported, CASE WHEN mp.reason IS NULL THEN coalesce(sum(sup.conflicting), 0)::BIGINT END AS conflicting
FROM mp JOIN u ON u.taxon = mp.taxon LEFT JOIN sup ON sup.node = u.node GROUP BY 1, 2""")
def q17(spark, d):
    p = table(spark, d, "part")
    edges = p.select(F.col("p_partkey").cast("string").alias("child"), F.expr(f"'g:' || {_GRP}").alias("parent")).unionByName(p.select(F.expr(f"'g:' || {_GRP}").alias("child"), F.expr("'o:' || p_type").alias("parent")).distinct())
    li = table(spark, d, "lineitem").join(p.select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand"), "l_partkey")
    study = F.expr(_STUDY).alias("study")
    a = li.filter("l_quantity > 49").select(F.expr(f"'g:' || {_GRP}").alias("node"), study, F.col("l_suppkey").alias("source"), F.when(F.col("l_returnflag") == "A", "conflicts").otherwise("supports").alias("kind"))
    b = li.filter("l_discount > 0.09").select(F.expr("'o:' || p_type").alias("node"), study, F.col("l_suppkey").alias("source"), F.when(F.col("l_returnflag") == "N", "conflicts").otherwise("supports").alias("kind"))
    listed = table(spark, d, "supplier").filter("s_suppkey % 20 <> 11").select(F.col("s_suppkey").alias("source"))
    support = relations.node_support(a.unionByName(b), listed, list(_CONSTRAINTS))
    up = hierarchy.ancestors(edges, 2).filter("depth > 0").withColumnRenamed("node", "taxon").join(support.withColumnRenamed("node", "ancestor"), "ancestor", "left").select("taxon", "ancestor", "depth", "supporting", "conflicting")
    per = up.groupBy("taxon").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "ancestor")), asc=False), lambda x: x["ancestor"]), ",").alias("ancestors"), F.count("supporting").alias("supported"), F.coalesce(F.sum("conflicting"), F.lit(0)).alias("conflicting"))
    j = _mapping(spark, d).withColumn("key", F.col("taxon").cast("string")).join(per.withColumnRenamed("taxon", "key"), "key")
    only = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return j.select("taxon", "reason", only("ancestors"), only("supported"), only("conflicting"))
