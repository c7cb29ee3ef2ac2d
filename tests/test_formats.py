"""Byte ranges, block compression, formats by name and the offset index, against plain reading."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from effectframe.operators import windows
from effectframe.sources import fasta, fasta_index, files, formats, tables
from effectframe.sources.files import ByteRange

LINES = ["first", "", "a\tb", "x" * 70_000, "", "last but one", "é" * 500, "end"]


def blocked(lines, step=65280, end=b"\n"):
    text = b"".join(line.encode() + end for line in lines)
    return b"".join(files.packed_block(text[i : i + step]) for i in range(0, len(text), step)) + files.packed_block(b"")


def test_blocks_are_gzip_members():
    data = blocked(LINES, 1000)
    assert gzip.decompress(data) == "".join(f"{x}\n" for x in LINES).encode()
    noise = random.Random(1).randbytes(files.BLOCK)
    assert gzip.decompress(files.packed_block(noise)) == noise
    with pytest.raises(ValueError, match="at most"):
        files.packed_block(noise + b"x")


@pytest.mark.parametrize("kind", ["plain", "blocks"])
def test_every_cut_gives_every_line_once(tmp_path, kind):
    """Brute force over all places where a file can be cut in two, and over even cuts."""
    lines = ["one", "", "three words here", "z" * 90, "", "", "tail"]
    path = tmp_path / "cut.txt"
    path.write_bytes(blocked(lines, 7) if kind == "blocks" else "\n".join(lines).encode())
    size = path.stat().st_size
    assert files.kind_of(str(path)) == kind
    for at in range(1, size):
        parts = [ByteRange(str(path), 0, at, kind), ByteRange(str(path), at, size, kind)]
        assert [line for p in parts for line in files.own_lines(p)] == lines
    for step in (1, 2, 3, 17, 40):
        parts = files.byte_ranges(str(path), step)
        assert [line for p in parts for line in files.own_lines(p)] == lines


def test_magic_inside_a_block_is_no_block(tmp_path):
    """Text that holds a whole compressed block, kept uncompressed, does not mislead the search."""
    inner = files.packed_block(b"inner\n")
    noise = random.Random(2).randbytes(3000)
    text = noise.replace(b"\n", b" ") + inner + noise.replace(b"\n", b"") + b"\nnext\n"
    outer = files.packed_block(text, 0)
    path = tmp_path / "nested.gz"
    path.write_bytes(outer + files.packed_block(b"more\n") + files.packed_block(b""))
    assert inner in outer
    for step in (100, 999, len(outer) - 1):
        lines = [line for p in files.byte_ranges(str(path), step) for line in files.own_lines(p)]
        assert lines[-2:] == ["next", "more"] and len(lines) == text.count(b"\n") + 1


def test_damaged_blocks_raise(tmp_path):
    data = bytearray(blocked(["abc", "def"]))
    data[20] ^= 255
    path = tmp_path / "bad.gz"
    path.write_bytes(bytes(data))
    with pytest.raises(ValueError, match="damaged"):
        list(files.own_lines(ByteRange(str(path), 0, len(data), "blocks")))
    path.write_bytes(blocked(["abc"])[:30])
    with pytest.raises(ValueError, match="no whole block"):
        list(files.own_lines(ByteRange(str(path), 0, 30, "blocks")))
    path.write_bytes(gzip.compress(b"abc\n" * 100)[:-9])
    with pytest.raises(ValueError, match="cut off"):
        list(files.own_lines(files.byte_ranges(str(path), 5)[0]))


def test_bgzf_written_and_read_by_many_tasks(spark, tmp_path):
    formats.register(spark)
    folder = str(tmp_path / "lines")
    values = [(f"{i} {'w' * (i % 50)}" if i % 9 else "" if i % 2 else None,) for i in range(5000)]
    df = spark.createDataFrame(values, "value string").repartition(3)
    df.write.format("bgzf").mode("append").save(folder)
    found = files.data_files(folder)
    assert 1 <= len(found) <= 3 and all(files.kind_of(p) == "blocks" for p, _ in found)
    read = spark.read.format("bgzf").option("range_bytes", 2000).load(f"file:{folder}")
    assert read.rdd.getNumPartitions() > 8
    assert sorted(r[0] for r in read.collect()) == sorted(v[0] or "" for v in values)
    spark.createDataFrame([("only",)], "value string").write.format("bgzf").mode("overwrite").save(folder)
    assert [r[0] for r in spark.read.format("bgzf").load(folder).collect()] == ["only"]
    assert not [p for p in (tmp_path / "lines").iterdir() if p.name.startswith("_")]


def test_folder_without_files_is_an_empty_table(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "none").mkdir()
    for name in ("bgzf", "gaf", "fasta"):
        assert spark.read.format(name).load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="FileNotFound"):
        spark.read.format("gaf").load(str(tmp_path / "absent")).count()
    with pytest.raises(Exception, match="text columns"):
        spark.read.format("gaf").schema("nothing string").load(str(tmp_path / "none")).count()


def test_variant_blocks_equal_plain_gzip(spark, tmp_path):
    from effectframe import constants as C

    names = [*C.VARIANT_COLUMNS, "Other"]
    rng = random.Random(4)
    rows = ["\t".join(rng.choice(["", "na", "12", 'say ""x""', '"quoted ""text"""', "-"]) for _ in names) for _ in range(700)]
    lines = ["\t".join(names), *rows]
    (tmp_path / "plain.txt.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    (tmp_path / "blocks.gz").write_bytes(blocked(lines, 3000))
    plain = tables.read_variants(spark, str(tmp_path / "plain.txt.gz"))
    many = tables.read_variants(spark, str(tmp_path / "blocks.gz"), blocks=True)
    assert many.schema.names == plain.schema.names and many.dtypes == plain.dtypes
    assert sorted(map(str, many.collect())) == sorted(map(str, plain.collect()))
    raw = tables.read_block_table(spark, str(tmp_path / "blocks.gz"), range_bytes=1500)
    assert raw.rdd.getNumPartitions() > 3 and raw.count() == plain.count()
    one = tables.read_block_table(spark, str(tmp_path / "plain.txt.gz"))
    assert one.rdd.getNumPartitions() == 1 and one.count() == plain.count()


@pytest.mark.parametrize("kind", ["plain", "blocks"])
def test_fasta_records_over_range_ends(spark, tmp_path, kind):
    formats.register(spark)
    rng = random.Random(5)
    lines, want = ["lost before the first header"], []
    for i in range(60):
        seq = "".join(rng.choices("ACGT", k=rng.choice((0, 1, 59, 61, 400))))
        lines += [f">r{i}\tsome  text {i}", *[seq[k : k + 60] + " " for k in range(0, len(seq), 60)]]
        want.append((f"r{i}", f"some  text {i}", seq))
    lines += [">", "AC", "> spaced", "GG"]
    path = tmp_path / "r.fa"
    path.write_bytes(blocked(lines, 333, b"\r\n") if kind == "blocks" else "\r\n".join(lines).encode())
    for step in (40, 100, 1 << 20):
        read = spark.read.format("fasta").option("range_bytes", step).load(str(path))
        assert sorted(map(tuple, read.collect())) == sorted(want)
    ids = spark.read.format("fasta").schema("id string").option("range_bytes", 100).load(str(path))
    assert ids.columns == ["id"] and sorted(r[0] for r in ids.collect()) == sorted(w[0] for w in want)
    if kind == "plain":
        plain = fasta.read_records(spark, str(path)).select("id", "seq")
        same = {(w[0], w[2]) for w in want}
        assert same <= set(map(tuple, plain.collect()))


def test_gaf_by_name(spark, tmp_path):
    formats.register(spark)
    rng = random.Random(6)
    lines = ["!gaf-version: 2.2"]
    for i in range(400):
        fields = ["DB", f"I{i}", rng.choice(["", f" G{i % 30}"]), rng.choice(["enables", "NOT|enables", ""])]
        fields += [rng.choice([f"GO:{i % 40:07d}", "X:1"]), "REF", rng.choice(["IDA", "IEA", "EXP"]), ""]
        fields += [rng.choice("PFC"), "n", "s", "protein", rng.choice(["taxon:9606", "taxon:9606|taxon:1", "taxon:10090"])]
        lines.append("\t".join(fields[: 12 if i % 50 == 0 else 13] + ["20200101"] * (i % 3 == 0 and i % 50 != 0)))
    path = tmp_path / "g.gaf.gz"
    path.write_bytes(blocked(lines, 500))
    for curated, aspects in ((False, ("P", "F")), (True, None)):
        a = tables.read_gene_term_edges(spark, str(path), curated_only=curated, aspects=aspects)
        b = tables.read_annotation_edges(spark, str(path), curated_only=curated, aspects=aspects)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) != []
    whole = spark.read.format("gaf").option("range_bytes", 300).load(str(path))
    assert whole.columns == list(formats.GAF_COLUMNS) and whole.count() == 392
    assert whole.filter("date is not null").count() < 392 and whole.filter("form is not null").count() == 0


def genome(path, rng, sizes=(3, 900, 60, 2500, 120, 0, 61), step=60, end="\n"):
    contigs = {f"c{i}": "".join(rng.choices("ACGTN", k=n)) for i, n in enumerate(sizes)}
    lines = []
    for name, seq in contigs.items():
        lines += [f">{name} text", *[seq[i : i + step] for i in range(0, len(seq), step)]]
    path.write_bytes((end.join(lines) + end).encode())
    return contigs


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("step", [23, 64, 1000, 1 << 20])
def test_index_at_any_range(spark, tmp_path, end, step):
    path = tmp_path / "g.fa"
    contigs = genome(path, random.Random(8), end=end)
    rows = {r["contig"]: r for r in fasta_index.fasta_index(spark, str(path), step).collect()}
    assert {k: r["length"] for k, r in rows.items()} == {k: len(v) for k, v in contigs.items()}
    text = path.read_bytes()
    for name, seq in contigs.items():
        if seq:
            r = rows[name]
            assert text[r["offset"] : r["offset"] + 1].decode() == seq[0]
            assert r["line_bases"] == min(60, len(seq)) and r["line_width"] == r["line_bases"] + len(end)


@pytest.mark.parametrize("step", [20, 1 << 20])
@pytest.mark.parametrize("body", ["AAAA\nCC\nGGGG", "AAAA\n\nCCCC", "AAAA\nCCCCC", "AAAA\r\nCCCC\nGGGG", "\nAAAA"])
def test_uneven_lines_raise(spark, tmp_path, body, step):
    path = tmp_path / "u.fa"
    path.write_bytes(f">good\nACGT\nAC\n\n>bad\n{body}\n>last\nAC\n".encode())
    with pytest.raises(ValueError, match="contigs bad"):
        fasta_index.fasta_index(spark, str(path), step)


def test_compressed_reference_has_no_index(spark, tmp_path):
    path = tmp_path / "g.fa.gz"
    path.write_bytes(blocked([">a", "ACGT"]))
    with pytest.raises(ValueError, match="plain files"):
        fasta_index.fasta_index(spark, str(path))


def test_indexed_slices_equal_plain_slicing(spark, tmp_path):
    """Brute force with a third of all requests on one spot, nulls, unknown contigs and places outside."""
    rng = random.Random(9)
    contigs = genome(tmp_path / "g.fa", rng, (700, 3000, 45, 0))
    asked = []
    for i in range(400):
        name = rng.choice(["c0", "c1", "c2", "c3", "c9"])
        a = rng.randrange(-3, 3100)
        asked.append((i, name, a, a + rng.choice((-1, 0, 1, 60, 300))) if i % 3 else (i, "c1", 100, 200))
    asked += [(900, None, 1, 2), (901, "c0", None, 4), (902, "c0", 4, None), (903, "c0", 0, 700), (903, "c0", 0, 700)]
    df = spark.createDataFrame(asked, "id long, contig string, start long, stop long")
    index = fasta_index.fasta_index(spark, str(tmp_path / "g.fa"), 500)
    out = fasta_index.indexed_slices(df, index).select("id", "contig", "start", "stop", "bases")

    def plain(_, name, a, b):
        seq = contigs.get(name, "")
        return None if None in (a, b) or not 0 <= a < len(seq) else seq[a : max(a, b)]

    key = [(*map(str, r), plain(*r)) for r in asked]
    assert sorted(map(str, key)) == sorted(str((*map(str, r[:4]), r[4])) for r in out.collect())
    with pytest.raises(ValueError, match="names of the result"):
        fasta_index.indexed_slices(df.withColumn("bases", F.lit("x")), index)


def test_indexed_windows_equal_bins_and_read_little(spark, tmp_path):
    rng = random.Random(10)
    path = str(tmp_path / "g.fa")
    contigs = genome(tmp_path / "g.fa", rng, (400_000, 900, 300_000))
    loci = []
    for i in range(120):
        name = f"c{i % 3}"
        pos = rng.randrange(1, min(len(contigs[name]), 60_000) + 5)
        ref = contigs[name][pos - 1 : pos + rng.choice((0, 1, 3))] or "A"
        loci.append((str(i), name, pos, ref if i % 7 else "ACGT", rng.choice(["A", "", "GTT", None])))
    loci += [("x", "c9", 5, "A", "C"), ("y", "c0", None, "A", "C"), ("z", None, 4, "A", "C")]
    schema = "VariationID string, ChromosomeAccession string, PositionVCF long, ReferenceAlleleVCF string, AlternateAlleleVCF string"
    variants = spark.createDataFrame(loci, schema)
    index = fasta_index.fasta_index(spark, path)
    counter = spark.sparkContext.accumulator(0)
    found = fasta_index.indexed_windows(variants, index, 50, counter)
    kept = windows.kept_windows(found).collect()
    asked = sum(len(r["dna_ref_seq"]) for r in kept)
    assert 0 < counter.value < 120 * (asked / len(kept) + fasta_index.GAP) < sum(map(len, contigs.values())) * 3
    assert counter.value <= 3 * 62_000
    bins = fasta.read_reference_bins(spark, path, 64, 32)
    other = windows.variant_windows(variants, bins, 50, 64, 32)
    assert sorted(map(str, kept)) == sorted(map(str, windows.kept_windows(other).collect()))
    why = windows.rejected_variants(found, fasta_index.known_contigs(index)).select("VariationID", "reject_reason")
    reasons = {r[0]: r[1] for r in why.collect()}
    assert len(reasons) + len(kept) == len(loci)
    assert reasons["x"] == "contig missing" and reasons["y"] == windows.NO_POSITION
