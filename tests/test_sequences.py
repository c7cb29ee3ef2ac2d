import hashlib
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from effectframe.functions.text import sanitize_dna
from effectframe.operators import sequences, windows
from effectframe.queries import standins
from effectframe.queries.sequences import window_rows
from effectframe.sources import fasta

ONE = "ACGTACGTACGGGTTTNNRACCA"
TWO = "TTTTTTTTTTAC"
LOCI = [
    ("a", "NC_1.1", 12, "GG", "T"),
    ("b", "NC_1.1", 2, "C", "G"),
    ("c", "NC_1.1", 22, "C", "CA"),
    ("d", "NC_1.1", 3, "A", "G"),
    ("e", "NC_9.1", 5, "A", "G"),
    ("f", "NC_1.1", 500, "A", "G"),
]
SCHEMA = (
    "VariationID string, ChromosomeAccession string, PositionVCF long, "
    "ReferenceAlleleVCF string, AlternateAlleleVCF string"
)


@pytest.fixture(scope="module")
def reference(tmp_path_factory):
    path = tmp_path_factory.mktemp("fa") / "ref.fa"
    wrapped = "\n".join(ONE[i : i + 10] for i in range(0, len(ONE), 10))
    path.write_text(f">NC_1.1 first contig\n{wrapped}\n>NC_2.1\r\n{TWO}\r\n")
    return str(path)


@pytest.mark.parametrize("bin_size,halo", [(8192, 2048), (16, 8), (4, 2)])
def test_windows_from_fasta(spark, reference, bin_size, halo):
    bins = fasta.read_reference_bins(spark, reference, bin_size, halo).cache()
    lengths = {r[0]: r[1] for r in windows.contig_lengths(bins, bin_size).collect()}
    assert lengths == {"NC_1.1": len(ONE), "NC_2.1": len(TWO)}
    cut = windows.variant_windows(
        spark.createDataFrame(LOCI, SCHEMA), bins, 4, bin_size=bin_size, halo=halo
    )
    kept = {
        r["VariationID"]: (r["dna_ref_seq"], r["dna_alt_seq"], r["dna_window_start"], r["dna_window_end"])
        for r in windows.kept_windows(cut).collect()
    }
    assert kept == {
        "a": ("TACGGGTTTN", "TACGTTTTN", 8, 17),
        "b": ("ACGTAC", "AGGTAC", 1, 6),
        "c": ("NNACCA", "NNACCAA", 18, 26),
    }
    why = {r["VariationID"]: r["reject_reason"] for r in windows.rejected_variants(cut, bins).collect()}
    assert why["d"] == windows.MISMATCH and why["e"] == "contig missing"
    assert why["f"] in (windows.OUTSIDE, windows.MISMATCH)


def test_fasta_over_many_splits(spark, tmp_path):
    """Contigs which begin, end and run through file splits keep their positions."""
    rng = random.Random(7)
    contigs = {f"c{i}": "".join(rng.choices("ACGTN", k=n)) for i, n in enumerate((3, 900, 1, 2500, 40))}
    lines = []
    for name, seq in contigs.items():
        lines.append(f">{name} text")
        step = rng.choice((7, 60, 61))
        lines += [seq[i : i + step] for i in range(0, len(seq), step)]
    path = tmp_path / "many.fa"
    path.write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    opened = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        pieces = fasta.sequence_pieces(spark, str(path)).toPandas()
        bins = fasta.read_reference_bins(spark, str(path), 128, 32).toPandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", opened)
    for name, part in pieces.groupby("contig"):
        assert "".join(part.sort_values("start")["bases"]) == contigs[name]
    for _, r in bins.iterrows():
        low = r["bin"] * 128
        assert r["bases"] == contigs[r["contig"]][low : low + 160]


def test_windows_match_plain_slicing(spark):
    """Brute force over a third of all variants on one spot, long alleles included."""
    rng = random.Random(3)
    contigs = {f"k{i}": "".join(rng.choices("ACGT", k=200 + 37 * i)) for i in range(4)}
    loci = []
    for i in range(240):
        name = "k2" if i % 3 == 0 else f"k{i % 4}"
        pos = 77 if i % 3 == 0 else rng.randint(1, len(contigs[name]))
        size = rng.choice((1, 1, 2, 40, 90))
        loci.append((f"v{i}", name, pos, contigs[name][pos - 1 : pos - 1 + size], rng.choice(("A", "GT", ""))))
    frame = spark.createDataFrame([(c, 0, s) for c, s in contigs.items()], "contig string, start long, bases string")
    bins = windows.bins_from_pieces(frame, 32, 16)
    cut = windows.variant_windows(spark.createDataFrame(loci, SCHEMA), bins, 5, bin_size=32, halo=16)
    got = {r["VariationID"]: (r["dna_ref_seq"], r["dna_alt_seq"]) for r in cut.collect()}
    for key, name, pos, ref, alt in loci:
        seq, start = contigs[name], max(1, pos - 5)
        ref_seq = seq[start - 1 : pos + len(ref) - 1 + 5]
        rel = pos - start
        assert got[key] == (ref_seq, ref_seq[:rel] + alt + ref_seq[rel + len(ref) :])


def test_bins_reject_wide_halo(spark):
    with pytest.raises(ValueError):
        windows.bins_from_pieces(spark.createDataFrame([("a", 0, "A")], "contig string, start long, bases string"), 8, 9)


def test_protein_fastas(spark, tmp_path):
    wt, mt = tmp_path / "wt.fa", tmp_path / "mt.fa"
    wt.write_text(">ENSP1.2 x\nMK\nT\n>ENSP1.3\nZZ\n>XP_7\nA\n")
    mt.write_text(">ENSP1.2:p.Arg1=\nMK\n>ENSP1.2:p.Arg1=\nMQ\n>ENSP2.1:c.1A>G\nM\n")
    got = {tuple(r) for r in fasta.read_wild_type_proteins(spark, str(wt)).collect()}
    assert got == {("ENSP1", "MKT"), ("XP_7", "A")}
    got = sorted(map(tuple, fasta.read_mutant_proteins(spark, str(mt)).collect()))
    assert got == [("ENSP1", "p.Arg1=", "MK"), ("ENSP1", "p.Arg1=", "MQ"), ("ENSP2", None, "M")]


def test_kmers(spark):
    df = spark.createDataFrame([("ABCDE",), ("AB",), ("",), ("a😀b😀c",)], "s string")
    got = [r[0] for r in df.select(sequences.kmers(F.col("s"), 3)).collect()]
    assert got == [["ABC", "BCD", "CDE"], ["AB"], [""], ["a😀b", "😀b😀", "b😀c"]]


def pairs(spark):
    rows = [(i, "ACGTACGT", "ACGTACGA" if i % 2 else "ACGTACGT") for i in range(6)]
    return spark.createDataFrame(rows, "id int, ref string, alt string")


def test_effects_through_builtin_encoder(spark):
    out = sequences.effect_vectors(pairs(spark), "ref", "alt", sequences.kmer_encoder(3, 16))
    for r in out.collect():
        norm = sum(x * x for x in r["vec"]) ** 0.5
        assert len(r["vec"]) == 16 and abs(norm - (1.0 if r["id"] % 2 else 0.0)) < 1e-5


def test_encoder_of_any_size(spark):
    df = spark.createDataFrame([("x", "ACGTACGTTT"), ("y", "AC")], "seq_id string, seq string")
    for dim in (8, 200):
        vecs = {r[0]: r[1] for r in sequences.kmer_encoder(3, dim)(df).collect()}
        assert all(len(v) == dim and abs(sum(v) - 1) < 1e-6 for v in vecs.values())


def test_windows_keep_rows_without_position_or_allele(spark):
    bins = windows.bins_from_pieces(spark.createDataFrame([("k", 0, "ACGT" * 30)], "contig string, start long, bases string"), 32, 16)
    rows = [("a", "k", 5, "A", "C"), ("a", "k", 5, "A", "C"), (None, "k", 5, "A", "G"), ("b", "k", None, "A", "C"), ("c", "k", 5, None, "C"), ("d", "k", 5, "A", None), ("e", None, 5, "A", "C"), ("f", "k", 1, "ACGT" * 25, "A"), ("f", "k", 1, "ACGT" * 25, "T")]
    cut = windows.variant_windows(spark.createDataFrame(rows, SCHEMA), bins, 3, bin_size=32, halo=16)
    got = sorted(((r.VariationID, r.reject_reason, r.dna_alt_seq) for r in cut.collect()), key=str)
    tail = "ACG"
    want = [("a", None, "CGTCCGT"), ("a", None, "CGTCCGT"), (None, None, "CGTGCGT"), ("b", "no position", None), ("c", "no reference allele", None)]
    want += [("d", "no alternate allele", None), ("e", "position outside contig", None), ("f", None, "A" + tail), ("f", None, "T" + tail)]
    assert got == sorted(want, key=str)


def test_plug_in_encoder(spark):
    def letters(batches):
        for b in batches:
            vec = [[float(s.count(c)) for c in "ACGT"] for s in b["seq"]]
            yield pd.DataFrame({"seq_id": b["seq_id"], "vec": vec})

    out = sequences.effect_vectors(pairs(spark), "ref", "alt", sequences.pandas_encoder(letters))
    got = {r["id"]: [round(x, 4) for x in r["vec"]] for r in out.collect()}
    assert got[0] == [0, 0, 0, 0] and got[1] == [0.7071, 0, 0, -0.7071]


def test_pooling(spark):
    tokens = spark.createDataFrame(
        [("s", 0, "a"), ("s", 1, "b"), ("s", 2, "b"), ("t", 0, "b")], "key string, pos int, token string"
    )
    table = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 3.0])], "token string, vec array<float>")
    mean = {r[0]: r[1] for r in sequences.pool_tokens(tokens, table, "key").collect()}
    assert mean == {"s": [1.0, 2.0], "t": [0.0, 3.0]}
    first = {r[0]: r[1] for r in sequences.pool_tokens(tokens, table, "key", "cls").collect()}
    assert first == {"s": [3.0, 0.0], "t": [0.0, 3.0]}


def test_first_occurrence_and_sanitize(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y")], "id int, s string")
    got = {r["s"]: (r["first_key"], r["n_rows"]) for r in sequences.first_occurrence(df, "id", "s").collect()}
    assert got == {"x": (1, 2), "y": (2, 1)}
    assert df.select(sanitize_dna(F.lit("ryA"))).first()[0] == "NNA"


def test_texts_are_encoded_where_they_stand(spark):
    """Tokens as rows filled hash maps with (digest, token) of all texts of a task."""
    letters = "ACGTé漢😀 \n" + "".join(chr(300 + i) for i in range(1500))
    draw = random.Random(3)
    texts = ["", "A", "é😀"] + ["".join(draw.choices(letters, k=n)) for n in (4, 5, 40, 3000)] + ["ACGT" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")
    for k, dim in ((1, 8), (4, 16), (7, 16)):
        encoded = sequences.kmer_encoder(k, dim)(df)
        plan = encoded._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Aggregate" not in plan
        for i, vec in encoded.collect():
            text = texts[i]
            tokens = [text[j : j + k] for j in range(len(text) - k + 1)] or [text]
            slots = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim for t in tokens]
            assert vec == pytest.approx([slots.count(d) / len(slots) for d in range(dim)], rel=1e-6)


def test_a_rejected_variant_meets_its_contig_once(spark):
    """A contig whose beginning stood in the bins twice doubled its rejected variants."""
    bins = windows.bins_from_pieces(spark.createDataFrame([("k", 0, "ACGT" * 30)], "contig string, start long, bases string"), 32, 16)
    rows = [("a", "k", 5, "G", "C"), ("b", "z", 5, "A", "C"), ("c", "k", 1, "A", "C"), ("d", None, 1, "A", "C")]
    cut = windows.variant_windows(spark.createDataFrame(rows, SCHEMA).withColumn("contig", F.lit("own")), bins, 3, bin_size=32, halo=16)
    cut = cut.unionByName(windows.variant_windows(spark.createDataFrame(rows, SCHEMA), bins, 3, bin_size=32, halo=16).withColumn("contig", F.lit("own")))
    found = windows.rejected_variants(cut, bins.unionByName(bins)).select("VariationID", "reject_reason").collect()
    assert sorted(map(tuple, found)) == sorted([("a", windows.MISMATCH), ("b", "contig missing"), ("d", "contig missing")] * 2)
    assert windows.kept_windows(cut).count() == 2


def test_window_rows_cuts_windows_once(spark, tmp_path):
    """Every use of the windows read, placed and joined all loci again, and once more to find their contigs."""
    lines = [(o, n, p, 7, float(q), "ANR"[n % 3]) for o in range(90) for n in range(1, 4) for p, q in ((o % 5, n), (900, 2))]
    lines += lines[:6] + [(91, None, None, None, None, None)]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string"
    spark.createDataFrame(lines, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    docs = [(i, "ACGT" * 40, 160) for i in range(4)] + [(4, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = window_rows(spark, str(tmp_path))
        plan = found._jdf.queryExecution().executedPlan().toString()
        loci_plan = standins.loci(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        got = {r["kind"]: r["n"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Loci, loci that are met, loci that lack something.
    assert plan.count("FileScan parquet [l_") == 3 and "BroadcastHashJoin" in loci_plan
    times = Counter((o, n, p, q) for o, n, p, _, q, _ in lines)
    lacking = sum(o % 97 == 0 or o % 89 == 1 or o % 83 == 2 or n is None for o, n, _, _, _, _ in lines)
    assert got == {"loci": len(lines), "kept or rejected": sum(n * n for n in times.values()), "without position or allele": lacking}


def test_few_texts_are_met_without_a_shuffle_of_rows(spark):
    """All rows were shuffled by digest, twice, to meet the vectors of a handful of texts."""
    rows = spark.createDataFrame([(i, "ACGT" * (i % 3 + 1), None if i % 5 == 0 else "ACGA") for i in range(40)], "id long, ref string, alt string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        every, few = (sequences.effect_vectors(rows, "ref", "alt", sequences.kmer_encoder(2, 8), few=n) for n in (7, 8))
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (every, few)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plans[0] and "SortMergeJoin" not in plans[1]
    assert sorted(map(str, every.collect())) == sorted(map(str, few.collect())) and few.count() == 40


def test_requests_on_unknown_contigs_are_not_shuffled(spark):
    bins = windows.bins_from_pieces(spark.createDataFrame([("k", 0, "ACGT" * 30)], "contig string, start long, bases string"), 32, 16).cache()
    rows = [("k", 3, 8), ("k", 20, 90), ("z", 3, 8), ("z", 3, 8), ("z", 0, 500), (None, 3, 8), ("k", None, 8), ("k", 500, 510)]
    found = windows.fetch_slices(spark.createDataFrame(rows, "contig string, start long, stop long"), bins, 32, 16)
    text = "ACGT" * 30
    want = [(*r, text[r[1] : r[2]] if r[0] == "k" and r[1] is not None and r[1] < 128 else None) for r in rows]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    assert "bitmap_construct_agg" in found._jdf.queryExecution().optimizedPlan().toString()
