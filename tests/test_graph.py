import gzip
import hashlib
import json
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from effectframe.operators import ranks, graph, walks
from effectframe.plans import genes
from effectframe.sources.tables import read_gene_term_edges, read_term_edges


def gaf(symbol="A", qualifier="enables", term="GO:0000001", evidence="IDA", aspect="F", taxon="taxon:9606"):
    return "\t".join(["DB", "ID", symbol, qualifier, term, "REF", evidence, "", aspect, "n", "s", "protein", taxon, "d"])


def test_read_annotation_file(spark, tmp_path):
    lines = [
        "!gaf-version: 2.2",
        gaf("KEEP"),
        gaf("DOUBLE", taxon="taxon:9606|taxon:10090"),
        "\t".join(gaf("SHORT").split("\t")[:12]),
        gaf("NOT", qualifier="NOT|enables"),
        gaf("C", aspect="C"),
        gaf("MOUSE", taxon="taxon:10090"),
        gaf("IEA", evidence="IEA"),
        gaf(" ", term="GO:0000002"),
        gaf("X", term="MF:1"),
    ]
    path = tmp_path / "a.gaf.gz"
    with gzip.open(path, "wt") as f:
        f.write("\n".join(lines) + "\n")
    got = {r["gene"] for r in read_gene_term_edges(spark, str(path), curated_only=True).collect()}
    assert got == {"KEEP", "DOUBLE"}
    every = {r["gene"] for r in read_gene_term_edges(spark, str(path), aspects=None).collect()}
    assert every == {"KEEP", "DOUBLE", "C", "IEA"}


def test_read_ontology(spark, tmp_path):
    edges = [
        {"sub": "http://o/GO_0000001", "pred": "is_a", "obj": "http://o/GO_0000002"},
        {"sub": "http://o/GO_0000001", "pred": "BFO_part_of", "obj": "http://o/GO_0000003"},
        {"sub": "http://o/GO_1", "pred": "is_a", "obj": "http://o/GO_0000002"},
        {"sub": "GO:0000004", "pred": None, "obj": "GO:0000002"},
    ]
    path = tmp_path / "go.json"
    path.write_text(json.dumps({"graphs": [{"edges": edges}, {"id": "none"}]}, indent=1))
    assert [tuple(r) for r in read_term_edges(spark, str(path)).collect()] == [("GO:0000001", "GO:0000002")]


def edge_frame(spark, pairs):
    return spark.createDataFrame(pairs, "gene string, term string")


def test_build_prune_and_isolates(spark):
    gene_edges = edge_frame(spark, [("A", "T1"), ("A", "T1"), ("B", "T1"), ("B", "T2"), ("C", "GO:0008150")])
    full = graph.build_graph(None, gene_edges)
    assert full.count() == 3
    pruned = graph.build_graph(None, gene_edges, prune_term_degree=2)
    assert [tuple(r) for r in pruned.collect()] == [("G::B", "T::T2")]
    assert {r[0] for r in graph.isolated_nodes(full, pruned).collect()} == {"G::A", "T::T1"}
    listed = graph.build_graph(None, gene_edges, drop_roots=False, blacklist=["T1"])
    assert {tuple(r) for r in listed.collect()} == {("G::B", "T::T2"), ("G::C", "T::GO:0008150")}
    assert graph.symmetric(pruned).count() == 2 and graph.nodes(pruned).count() == 2


@pytest.fixture(scope="module")
def hub(spark):
    """One term next to every gene, and a private term per gene."""
    pairs = [(f"g{i}", "HUB") for i in range(60)] + [(f"g{i}", f"t{i}") for i in range(60)]
    return graph.build_graph(None, edge_frame(spark, pairs)).cache()


def test_hold_out(spark):
    pairs = [("one", "t0")] + [("many", f"t{i}") for i in range(25)]
    edges = graph.build_graph(None, edge_frame(spark, pairs))
    train, held = graph.hold_out_edges(edges)
    taken = Counter(r["src"] for r in held.collect())
    assert taken == {"G::one": 1, "G::many": 2}
    assert train.count() + held.count() == edges.count()
    assert train.join(held, ["src", "dst"]).isEmpty()


def test_adjacency_is_dense(hub):
    rows = graph.adjacency(hub).toPandas()
    for _, part in rows.groupby("node"):
        assert sorted(part["idx"]) == list(range(len(part)))


def test_walks_follow_edges_and_repeat(hub):
    links = defaultdict(set)
    for a, b in hub.collect():
        links[a].add(b)
        links[b].add(a)
    first = {r["walk"]: r["nodes"] for r in walks.random_walks(hub, 11, 2, seed=5).collect()}
    again = {r["walk"]: r["nodes"] for r in walks.random_walks(hub, 11, 2, seed=5).collect()}
    assert first == again and len(first) == 2 * len(links)
    assert all(len(n) == 11 for n in first.values())
    assert all(b in links[a] for n in first.values() for a, b in zip(n, n[1:]))
    from_hub = Counter(b for n in first.values() for a, b in zip(n, n[1:]) if a == "T::HUB")
    assert len(from_hub) > 40


def test_vectors(spark, hub):
    vecs = genes.gene_vectors(hub, dim=8, epochs=1, walk_length=5, walks_per_node=1, context=2)
    rows = vecs.collect()
    assert {r["gene"] for r in rows} == {f"g{i}" for i in range(60)}
    assert all(len(r["vec"]) == 8 for r in rows)
    counted = genes.gene_vectors(hub, dim=8, walk_length=5, walks_per_node=1, context=2, skip_gram=False).collect()
    assert {r["gene"] for r in counted} == {f"g{i}" for i in range(60)}


def test_context_vectors_by_brute_force(spark):
    found = [("w1", ["a", "b", "c", "a"]), ("w2", ["b", "b", "d"]), ("w3", ["e"])]
    frame = spark.createDataFrame(found, "walk string, nodes array<string>")
    got = {r["node"]: r["vec"] for r in walks.context_vectors(frame, 4, 2).collect()}
    n = Counter((x, y) for _, w in found for i, x in enumerate(w) for j, y in enumerate(w) if i != j and abs(i - j) <= 2)
    size = Counter()
    for (x, _), k in n.items():
        size[x] += k
    for x in size:
        vec = [0.0] * 4
        for (a, b), k in n.items():
            if a == x:
                digest = int(hashlib.md5(b.encode()).hexdigest()[:8], 16)
                weight = max(0.0, math.log(k * sum(n.values()) / (size[a] * size[b])))
                vec[digest // 2 % 4] += weight if digest % 2 == 0 else -weight
        assert got[x] == pytest.approx(vec, abs=1e-5)
    assert set(got) == set(size)


def test_sweep_picks_the_best_trial(spark):
    lines = [gaf(f"g{i}", term=f"GO:{i % 2:07d}") for i in range(30)]
    lines += [gaf(f"g{i}", term=f"GO:{100 + i:07d}") for i in range(30)]
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    terms = spark.createDataFrame([("GO:0000100", "GO:0000001")], "child string, parent string")
    rows = spark.range(60).select(
        F.col("id").cast("string").alias("variation_key"),
        F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("dna"),
        F.concat(F.lit("g"), F.col("id") % 30).alias("gene"),
        (F.col("id") % 2).cast("int").alias("_y"),
    )
    setting = dict(
        dim=4, epochs=1, walk_len=4, ctx_size=2, walks_per_node=2, curated_only=True,
        no_term_edges=False, drop_roots=True, prune_term_degree=1000,
    )
    table, best = genes.sweep(rows, rows, frame, terms, [setting])
    assert table.count() == 1 and best["trial"] == 0
    assert set(best["scores"]) >= {"delta_roc", "delta_pr", "dna_roc", "both_pr"}
    assert len(list(genes.grid({"dim": [4, 8], "epochs": [1]}))) == 2
    vecs = genes.refit(best["setting"] | setting, frame, terms)
    assert vecs.filter("size(vec) = 4").count() > 0
    with pytest.raises(ValueError):
        genes.sweep(rows, rows, frame, terms, [setting | {"batch_size": 2}])
    with pytest.raises(ValueError):
        genes.sweep(rows, rows, frame, terms, [])


def _fake_sweep(monkeypatch, fail_after=None):
    """A sweep whose trials cost nothing and note what runs; scores follow from dim and epochs."""
    ran = []

    def gain(train, val, vecs, dim):
        if fail_after is not None and len(ran) >= fail_after:
            raise RuntimeError("lost")
        ran.append((dim, vecs))
        return {"delta_roc": dim * 0.01 + vecs * 0.0001, "delta_pr": -float(dim)}

    monkeypatch.setattr(genes, "graph_from_lines", lambda *a, **k: None)
    monkeypatch.setattr(genes.graph, "hold_out_edges", lambda *a: (None, None))
    monkeypatch.setattr(genes, "gene_vectors", lambda e, dim, epochs, *a, **k: epochs)
    monkeypatch.setattr(genes, "probe_gain", gain)
    return ran


def _settings(dims, epochs=8):
    rest = dict(
        walk_len=4, ctx_size=2, walks_per_node=2, curated_only=True, no_term_edges=False, drop_roots=True,
        prune_term_degree=None,
    )
    return [dict(dim=d, epochs=epochs, **rest) for d in dims]


def test_sweep_goes_on_after_a_loss(spark, tmp_path, monkeypatch):
    rows, folder = spark.range(1), str(tmp_path / "trials")
    with monkeypatch.context() as m:
        first = _fake_sweep(m, fail_after=2)
        with pytest.raises(RuntimeError, match="lost"):
            genes.sweep(rows, rows, rows, rows, _settings([2, 9, 4, 5]), folder=folder)
        assert [d for d, _ in first] == [2, 9]
    with monkeypatch.context() as m:
        second = _fake_sweep(m)
        table, best = genes.sweep(rows, rows, rows, rows, _settings([2, 9, 4, 5]), folder=folder)
        assert [d for d, _ in second] == [4, 5]
        whole, other = genes.sweep(rows, rows, rows, rows, _settings([2, 9, 4, 5]))
        assert sorted(map(str, table.collect())) == sorted(map(str, whole.collect())) and best == other
        assert best["trial"] == 1 and spark.read.parquet(folder).count() == 4
        # Another seed or another number of epochs is another trial.
        del second[:]
        genes.sweep(rows, rows, rows, rows, _settings([2]), folder=folder, seed=1)
        genes.sweep(rows, rows, rows, rows, _settings([2], epochs=3), folder=folder)
        assert len(second) == 2


def test_sweep_at_once_and_by_halves(spark, monkeypatch):
    rows = spark.range(1)
    ran = _fake_sweep(monkeypatch)
    one, best = genes.sweep(rows, rows, rows, rows, _settings(range(2, 10)))
    many, again = genes.sweep(rows, rows, rows, rows, _settings(range(2, 10)), at_once=4)
    assert best == again and sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    del ran[:]
    table, best = genes.sweep(rows, rows, rows, rows, _settings(range(2, 10)), halvings=2)
    assert [e for _, e in ran] == [2] * 8 + [4] * 4 + [8] * 2
    assert best["trial"] == 7 and best["setting"]["epochs"] == "8" and table.count() == 14
    for wrong in ({"at_once": 0}, {"halvings": -1}):
        with pytest.raises(ValueError, match="at least"):
            genes.sweep(rows, rows, rows, rows, _settings([2]), **wrong)


def test_walks_do_not_depend_on_how_neighbours_are_packed(spark, monkeypatch):
    """The adjacency was a row per neighbour, all of them read at every step."""
    edges = spark.createDataFrame([("hub", f"n{i}") for i in range(9)] + [("n1", "n2")], "src string, dst string")
    found = []
    for size in (64, 2):
        monkeypatch.setattr(walks, "CHUNK", size)
        found.append(sorted((r["walk"], r["nodes"]) for r in walks.random_walks(edges, 6, 3).collect()))
    assert found[0] == found[1] and len(found[0]) == 30


def test_small_groups_are_ranked_in_one_piece(spark):
    """Each group was cut into so many buckets that the table of buckets was as long as the rows."""
    rows = [("large", i) for i in range(300)] + [(f"g{i % 40}", i) for i in range(120)] + [(None, 1)]
    df = spark.createDataFrame(rows, "g string, x long")
    ranked = ranks.hash_rank(df, F.col("x").cast("string"), ["x"], "r", ["g"])
    assert "__large" in ranked._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["g"], r["x"]): r["r"] for r in ranked.collect()}
    groups: dict[str, list] = {}
    for g, x in rows[:-1]:
        groups.setdefault(g, []).append((hashlib.md5(str(x).encode()).hexdigest(), x))
    want = {(g, x): n for g, items in groups.items() for n, (_, x) in enumerate(sorted(items), 1)}
    assert got == want


def test_graphs_of_all_settings_are_those_of_each(spark):
    line = lambda s, q, t, e, a="F", x="taxon:9606": "\t".join(["DB", "ID", s, q, t, "R", e, "", a, "n", "s", "p", x])
    root = genes.graph.C.ROOT_TERMS[0]
    rows = [
        line("A", "", "GO:1", "IEA"), line("A", "", "GO:1", "IDA"), line("B", "", "GO:2", "IEA"), line("B", "NOT|x", "GO:3", "IDA"),
        line("C", "", root, "IDA"), line(" D", "", "GO:1", "EXP", "C"), line("E", "", "GO:1", " IDA "), line("E", "", "GO:1", "IDA", x="taxon:1"), "! x",
    ]
    lines = spark.createDataFrame([(r,) for r in rows], "value string")
    terms = spark.createDataFrame([("GO:1", "GO:2"), ("GO:2", "GO:1"), ("GO:2", root), ("GO:4", "GO:4")], "child string, parent string")
    settings = {
        "all": {}, "curated": {"curated_only": True}, "genes": {"no_term_edges": True}, "roots": {"drop_roots": False},
        "pruned": {"prune_term_degree": 3}, "few": {"prune_term_degree": 2, "drop_roots": False},
    }
    found = genes.graphs_from_lines(lines, terms, settings).collect()
    for name, options in settings.items():
        want = {tuple(r) for r in genes.graph_from_lines(lines, terms, **options).select("src", "dst").collect()}
        got = [(r.src, r.dst) for r in found if name in r.settings]
        assert set(got) == want and len(got) == len(want), name


def _neighbours(edges):
    found = defaultdict(list)
    for a, b in edges:
        for node, other in ((a, b), (b, a)):
            found[node].append((hashlib.md5(f"{node}|{other}".encode()).hexdigest(), other))
    return {node: [other for _, other in sorted(ways)] for node, ways in found.items()}


def test_walks_step_by_digest_whatever_rows_hubs_have(spark, monkeypatch):
    """An edge end went through four shuffles, once with its digest; now it is a name in a row of its node."""
    edges = [("hub", f"n{i}") for i in range(40)] + [("n1", "n2"), ("n3", "n3"), ("n4", "n5"), ("n4", "n5")]
    ways = _neighbours(edges)
    given = spark.createDataFrame([*edges, (None, "x"), ("y", None)], "src string, dst string")
    want = {}
    for walk, node in ((f"{n}#{i}", n) for n in ways for i in range(2)):
        path = [node]
        for step in range(1, 11):
            draw = int(hashlib.md5(f"3:{walk}:{step}".encode()).hexdigest()[:12], 16)
            path.append(ways[path[-1]][draw % len(ways[path[-1]])])
        want[walk] = path
    for chunk, most, ends in ((64, 1 << 16, 1_000_000), (2, 4, 10), (1, 1, 1_000_000)):
        monkeypatch.setattr(walks, "CHUNK", chunk)
        monkeypatch.setattr(graph, "ROW_NEIGHBOURS", most)
        monkeypatch.setattr(graph, "PARTITION_ENDS", ends)
        table, hubs = graph.packed_adjacency(given, chunk)
        assert table.filter("node = 'hub'").count() > 1 if most < 40 else hubs.isEmpty()
        assert {r["walk"]: r["nodes"] for r in walks.random_walks(given, 11, 2, seed=3).collect()} == want


def test_a_step_of_walks_shuffles_the_walkers_only(spark, hub):
    """The stored adjacency was shuffled and sorted again, as an adaptive plan forgets how it was placed."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = walks.random_walks(hub, 4, 1)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("Sort [") == 3
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert len({r["walk"] for r in found.collect()}) == found.count() == 121


def test_context_counts_by_brute_force(spark):
    found = [("w1", ["a", "b", "c", "a", "a"]), ("w2", ["b", "b", "d", None]), ("w3", ["e"]), ("w4", [None, "a", None])]
    frame = spark.createDataFrame(found, "walk string, nodes array<string>")
    want = Counter((x, y) for _, w in found for i, x in enumerate(w) for j, y in enumerate(w) if i != j and abs(i - j) <= 2)
    rows = walks.context_counts(frame, 2).collect()
    assert {(r["a"], r["b"]): r["n"] for r in rows} == want and len(rows) == len(want)
    once = walks.pair_counts(frame, 2).collect()
    assert len(once) == len({frozenset(p) for p in want})


def test_ranks_know_the_size_of_their_group(spark):
    """Hold-out sent all ranked rows through a second shuffle to meet the sizes of their groups."""
    rows = [("large", i) for i in range(300)] + [(f"g{i % 40}", i) for i in range(120)] + [(None, 1)]
    df = spark.createDataFrame(rows, "g string, x long")
    size = Counter(g for g, _ in rows)
    for more in ({}, {"hex_digits": 1}):
        got = ranks.hash_rank(df.filter("g is not null"), F.col("x").cast("string"), ["x"], "r", ["g"], size_col="n", **more).collect()
        assert {(r["g"], r["n"]) for r in got} == {(g, n) for g, n in size.items() if g}
        assert Counter((r["g"], r["r"]) for r in got) == Counter((g, i) for g, n in size.items() if g for i in range(1, n + 1))


def test_held_out_edges_are_marked_once(spark):
    """Training and held-out edges were each worked out from the whole graph, digests going through the shuffles."""
    edges = graph.build_graph(None, edge_frame(spark, [(f"g{i}", f"t{j}") for i in range(4) for j in range(12)]))
    for side in graph.hold_out_edges(edges):
        assert "Exchange" not in side._jdf.queryExecution().executedPlan().toString()
    plan = graph.mark_held_out(edges)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning(__gene") :]
    assert "unhex(md5" in plan and "unhex(md5" not in below
