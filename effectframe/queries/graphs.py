"""Gene-term graph, hold-out, walks and node vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from effectframe.constants import CURATED_EVIDENCE
from effectframe.functions import text
from effectframe.operators import graph, metrics, walks
from effectframe.plans import genes as gene_plans
from effectframe.queries import standins as S
from effectframe.queries.base import query, table
from effectframe.session import cut_lineage

_HUB = 60


def _edges(spark, folder):
    terms, genes = S.graph_inputs(spark, folder)
    return graph.build_graph(terms, genes)


GAF_SQL = """WITH rows AS (
      SELECT s_name AS gene, 'GO:' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS term, l_returnflag,
        l_linestatus, l_linenumber, s_nationkey
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    )
    SELECT gene, term, count(*) AS n FROM rows
    WHERE l_returnflag <> 'R' AND l_linestatus = 'F' AND s_nationkey <> 0 AND l_linenumber IN (1, 2, 3)
    GROUP BY 1, 2"""


def gaf_lines(spark, folder):
    """One annotation line per order line."""
    lines, suppliers = table(spark, folder, "lineitem"), table(spark, folder, "supplier")
    joined = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    number = F.col("l_linenumber")
    fields = [
        F.lit("DB"),
        F.lit("ID"),
        F.concat(F.lit(" "), "s_name"),
        F.when(F.col("l_returnflag") == "R", "NOT|enables").otherwise("enables"),
        F.concat(F.lit("GO:"), F.lpad(F.col("l_partkey").cast("string"), 7, "0")),
        F.lit("REF"),
        F.when(number == 1, "IDA").when(number == 2, "EXP").when(number == 3, "TAS").otherwise("IEA"),
        F.lit(""),
        F.when(F.col("l_linestatus") == "F", "F").otherwise("C"),
        F.lit("name"),
        F.lit("synonym"),
        F.lit("protein"),
        F.when(F.col("s_nationkey") == 0, "taxon:10090").otherwise("taxon:9606|taxon:10090"),
    ]
    return joined.select(F.concat_ws("\t", *fields).alias("value"))


@query("gaf_edges", GAF_SQL)
def gaf_edges(spark, folder):
    gaf = gaf_lines(spark, folder)
    edges = graph.gene_term_edges(gaf, evidence=CURATED_EVIDENCE, aspects=["P", "F"])
    return edges.groupBy("gene", "term").agg(F.count(F.lit(1)).alias("n"))


@query(
    "term_edges",
    """SELECT 'GO:' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS child,
      'GO:' || lpad(CAST(p_size AS VARCHAR), 7, '0') AS parent
    FROM part WHERE p_type <> 'SMALL'""",
)
def term_edges(spark, folder):
    part = table(spark, folder, "part")
    raw = part.select(
        F.concat(F.lit("http://x/GO_"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("sub"),
        F.when(F.col("p_type") == "SMALL", "part_of").otherwise("IS_A").alias("pred"),
        F.concat(F.lit("http://x/GO:"), F.lpad(F.col("p_size").cast("string"), 7, "0")).alias("obj"),
    )
    return graph.term_term_edges(raw)


@query(
    "term_ids",
    """SELECT l_partkey, l_suppkey, CASE WHEN l_partkey < 1000 THEN NULL ELSE 'GO:' || (l_partkey + 1000000) END AS term, count(*) AS n
    FROM lineitem GROUP BY 1, 2, 3""",
)
def term_ids(spark, folder):
    raw = F.when(F.col("l_partkey") < 1000, F.concat(F.lit("GO_"), "l_partkey")).otherwise(
        F.concat(F.lit("x/GO_"), F.col("l_partkey") + 1000000)
    )
    lines = table(spark, folder, "lineitem")
    named = lines.select("l_partkey", "l_suppkey", text.normalize_term_id(raw).alias("term"))
    return named.groupBy("l_partkey", "l_suppkey", "term").agg(F.count(F.lit(1)).alias("n"))


@query("graph_build", f"WITH {S.EDGES_SQL} SELECT src, dst FROM edges")
def graph_build(spark, folder):
    return _edges(spark, folder)


@query("degree", f"WITH {S.EDGES_SQL} SELECT node, degree FROM degree")
def degree(spark, folder):
    return graph.degrees(_edges(spark, folder))


@query(
    "edge_index",
    f"WITH {S.EDGES_SQL} SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges",
)
def edge_index(spark, folder):
    return graph.symmetric(_edges(spark, folder))


_PRUNED_SQL = f"""{S.EDGES_SQL},
hubs AS (SELECT node FROM degree WHERE node LIKE 'T::%' AND degree >= {_HUB}),
pruned AS (
  SELECT src, dst FROM edges
  WHERE src NOT IN (SELECT node FROM hubs) AND dst NOT IN (SELECT node FROM hubs)
)"""


@query("hub_prune", f"WITH {_PRUNED_SQL} SELECT src, dst FROM pruned")
def hub_prune(spark, folder):
    terms, genes = S.graph_inputs(spark, folder)
    return graph.build_graph(terms, genes, prune_term_degree=_HUB)


@query(
    "isolates",
    f"""WITH {_PRUNED_SQL}
    SELECT node FROM degree WHERE node NOT IN (SELECT src FROM pruned UNION ALL SELECT dst FROM pruned)""",
)
def isolates(spark, folder):
    terms, genes = S.graph_inputs(spark, folder)
    pruned = graph.build_graph(terms, genes, prune_term_degree=_HUB)
    return graph.isolated_nodes(_edges(spark, folder), pruned)


_HOLDOUT_SQL = f"""{S.EDGES_SQL},
mixed AS (
  SELECT src, dst, src AS gene FROM edges WHERE src LIKE 'G::%' AND dst LIKE 'T::%'
),
held AS (
  SELECT src, dst FROM (
    SELECT src, dst, row_number() OVER (PARTITION BY gene ORDER BY md5('0|' || src || '|' || dst), src, dst) AS r,
      count(*) OVER (PARTITION BY gene) AS n FROM mixed)
  WHERE r <= greatest(1, round_even(n * CAST(0.1 AS DOUBLE), 0))
)"""


@query(
    "edge_holdout",
    f"""WITH {_HOLDOUT_SQL}
    SELECT src, dst, held.src IS NOT NULL AS held_out FROM edges LEFT JOIN held USING (src, dst)""",
)
def edge_holdout(spark, folder):
    return graph.mark_held_out(cut_lineage(_edges(spark, folder)))


_STEPS = 5
_STEP_SQL = ",\n".join(
    f"""w{k} AS (
  SELECT w.walk, a.neighbor AS node, a.neighbor_degree AS degree FROM w{k - 1} w
  JOIN adj a ON a.node = w.node
    AND a.idx = ('0x' || substr(md5('0:' || w.walk || ':{k}'), 1, 12))::BIGINT % w.degree
)"""
    for k in range(1, _STEPS)
)
_UNION_SQL = " UNION ALL ".join(
    f"SELECT walk, {k} AS step, node FROM w{k}" for k in range(_STEPS)
)


_WALKS_SQL = f"""{S.EDGES_SQL},
    ways AS (SELECT src AS node, dst AS neighbor FROM edges UNION ALL SELECT dst, src FROM edges),
    adj AS (
      SELECT b.node, neighbor, d.degree AS neighbor_degree,
        row_number() OVER (PARTITION BY b.node ORDER BY md5(b.node || '|' || neighbor), neighbor) - 1 AS idx
      FROM ways b JOIN degree d ON d.node = neighbor
    ),
    w0 AS (SELECT node || '#' || i AS walk, node, degree FROM degree, unnest([0, 1]) AS u(i)),
    {_STEP_SQL}"""


@query("random_walks", f"WITH {_WALKS_SQL} {_UNION_SQL}")
def random_walks(spark, folder):
    found = walks.random_walks(cut_lineage(_edges(spark, folder)), _STEPS, 2)
    return found.select("walk", F.posexplode("nodes").alias("step", "node"))


@query(
    "walk_embeddings",
    f"""WITH {_WALKS_SQL},
    steps AS ({_UNION_SQL}),
    met AS (
      SELECT x.node AS a, y.node AS b FROM steps x JOIN steps y
      ON x.walk = y.walk AND x.step <> y.step AND abs(x.step - y.step) <= 3
    ),
    counts AS (SELECT a, b, count(*) AS n FROM met GROUP BY 1, 2),
    sizes AS (SELECT a, sum(n) AS total FROM counts GROUP BY 1),
    weighed AS (
      SELECT c.a, ('0x' || substr(md5(c.b), 1, 8))::BIGINT AS digest,
        CAST(round(greatest(ln(CAST(n AS DOUBLE) * (SELECT sum(n) FROM counts)
          / (CAST(s.total AS DOUBLE) * CAST(t.total AS DOUBLE))), 0.0) * 1e6) AS BIGINT) AS w
      FROM counts c JOIN sizes s ON s.a = c.a JOIN sizes t ON t.a = c.b
    ),
    slots AS (
      SELECT a, (digest // 2) % 16 AS slot, sum(CASE WHEN digest % 2 = 0 THEN w ELSE -w END) AS w FROM weighed GROUP BY 1, 2
    )
    SELECT substr(n.a, 4) AS gene, CAST(d AS INTEGER) AS dim,
      round(CAST(CAST(coalesce(s.w, 0) / 1e6 AS FLOAT) AS DOUBLE), 4) AS x
    FROM (SELECT DISTINCT a FROM counts WHERE a LIKE 'G::%') n CROSS JOIN unnest(range(16)) AS u(d)
    LEFT JOIN slots s ON s.a = n.a AND s.slot = d""",
)
def walk_embeddings(spark, folder):
    found = walks.random_walks(cut_lineage(_edges(spark, folder)), _STEPS, 2)
    genes = walks.gene_vectors(walks.context_vectors(found, dim=16, context=3))
    dims = genes.select("gene", F.posexplode("vec").alias("dim", "x"))
    return dims.withColumn("x", F.round(F.col("x").cast("double"), 4))


@query("skip_gram_genes")
def skip_gram_genes(spark, folder):
    """Skip-gram training is iterative: rows only."""
    found = walks.random_walks(cut_lineage(_edges(spark, folder)), _STEPS, 2)
    genes = walks.gene_vectors(walks.skip_gram_vectors(found, dim=16, context=3))
    return genes.select("gene", F.size("vec").alias("dim"))


@query("skip_gram_links")
def skip_gram_links(spark, folder):
    """How well vectors trained without the held-out edges tell them from pairs without an edge: rows only."""
    train, held = graph.hold_out_edges(cut_lineage(_edges(spark, folder)))
    found = walks.random_walks(train, 10, 2)
    nodes = cut_lineage(walks.skip_gram_vectors(found, dim=16, context=3, epochs=2, lr=0.05, blocks=4))
    scored = cut_lineage(gene_plans.link_scores(nodes, held, train))
    areas = metrics.curve_areas(scored, "linked", "score")
    sizes = scored.agg(F.count("*").alias("pairs"), F.sum("linked").cast("long").alias("linked"))
    return sizes.crossJoin(areas.select(F.round("roc_auc", 6).alias("roc_auc"), F.round("avg_precision", 6).alias("avg_precision")))
