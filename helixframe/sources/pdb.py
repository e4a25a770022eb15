"""PDB text to typed tables. A line table is (pdb_id, line_no, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import constants as C
from .. import dims
from ..session import stored


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of every file under ``path``; gzip is transparent."""
    whole = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/.]+)\.[^/]*$", 1).alias("pdb_id"), "value")
    return whole.select("pdb_id", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def cut(start: int, end: int) -> F.Column:
    """Trimmed fixed-width field, 1-based inclusive columns."""
    return F.trim(F.substring("value", start, end - start + 1))


def atoms(lines: DataFrame, first_model: bool = True) -> DataFrame:
    """ATOM and HETATM rows; rows with unreadable coordinates are skipped.

    The ends of first models are stored first, so that their true size decides how lines meet them: few do not make all lines travel.
    """
    if first_model:
        stop = stored(lines.filter(F.col("value").startswith("ENDMDL")).groupBy("pdb_id").agg(F.min("line_no").alias("stop")))
        lines = lines.join(stop, "pdb_id", "left").filter(F.coalesce(F.col("line_no") < F.col("stop"), F.lit(True)))
    num = lambda a, b: F.expr(f"try_cast(trim(substring(value, {a}, {b - a + 1})) AS double)")
    rec = lines.filter(F.col("value").startswith("ATOM") | F.col("value").startswith("HETATM"))
    return rec.select(
        "pdb_id", "line_no", cut(1, 6).alias("record"), cut(13, 16).alias("atom"), cut(18, 20).alias("res"),
        F.substring("value", 22, 1).alias("chain"), cut(23, 26).alias("resseq"), num(31, 38).alias("x"),
        num(39, 46).alias("y"), num(47, 54).alias("z"), cut(77, 78).alias("element"),
    ).filter("x is not null and y is not null and z is not null")


def first_per(df: DataFrame, keys: list[str], *keep: str) -> DataFrame:
    """First row of each key in line order, as one aggregate."""
    return df.groupBy(*keys).agg(F.min("line_no").alias("line_no"), F.min_by(F.struct(*keep), "line_no").alias("r")).select(*keys, "line_no", "r.*")


def ca_trace(atom: DataFrame) -> DataFrame:
    """First CA per residue with its letter and index in order of appearance."""
    ca = atom.filter("record = 'ATOM' and atom = 'CA'").join(F.broadcast(dims.aa3_dim(atom.sparkSession)), "res")
    one = first_per(ca, ["pdb_id", "chain", "resseq"], "aa", "x", "y", "z")
    return one.withColumn("idx", F.row_number().over(W.partitionBy("pdb_id", "chain").orderBy("line_no")) - 1)


def na_trace(atom: DataFrame, kind: str) -> DataFrame:
    """First C1' per nucleotide, modified bases mapped to their parent."""
    dim = dims.na3_dim(atom.sparkSession).filter(F.col("kind") == kind).drop("kind")
    c1 = atom.filter(F.col("atom").isin("C1'", "C1*")).join(F.broadcast(dim), "res")
    return first_per(c1, ["pdb_id", "chain", "resseq"], "base", "is_modified", "x", "y", "z")


def list_chains(atom: DataFrame) -> DataFrame:
    first = atom.groupBy("pdb_id", "chain").agg(F.min("line_no").alias("line_no"))
    return first.withColumn("ord", F.row_number().over(W.partitionBy("pdb_id").orderBy("line_no")) - 1)


def first_valid_chain(trace: DataFrame, lo: int = 50, hi: int = 150) -> DataFrame:
    n = trace.filter(F.trim("chain") != "").groupBy("pdb_id", "chain").agg(F.count("*").alias("n"))
    return n.filter(F.col("n").between(lo, hi)).groupBy("pdb_id").agg(F.min("chain").alias("chain"))


def header_flags(lines: DataFrame) -> DataFrame:
    """Ensemble and neutron flags of each file; its header ends at the first coordinate record."""
    up = F.upper("value")
    first = F.col("value").startswith("ATOM") | F.col("value").startswith("HETATM")
    at = lines.filter(first).groupBy("pdb_id").agg(F.min("line_no").alias("body"))
    head = F.coalesce(F.col("line_no") < F.col("body"), F.lit(True))
    g = lines.join(at, "pdb_id", "left").groupBy("pdb_id").agg(
        F.max((up.contains("EXPDTA") & head).cast("int")).alias("e"), F.max((up.contains("NMR") & head).cast("int")).alias("m"),
        F.count_if(up.contains("ENDMDL")).alias("ends"), F.count_if(up.startswith("MODEL ") & (F.col("line_no") > 0)).alias("models"),
        F.max((up.startswith("EXPDTA") & up.contains("NEUTRON")).cast("int")).alias("neutron"))
    return g.select("pdb_id", (((F.col("e") == 1) & (F.col("m") == 1)) | (F.col("ends") >= 2) | (F.col("models") >= 2)).alias("is_ensemble"),
                    (F.col("neutron") == 1).alias("is_neutron"))


def ss_records(lines: DataFrame) -> DataFrame:
    """HELIX and SHEET records as intervals (chain, start, end, kind)."""
    h, s = F.col("value").startswith("HELIX"), F.col("value").startswith("SHEET")
    pick = lambda a, b: F.expr(f"try_cast(trim(CASE WHEN value LIKE 'HELIX%' THEN {a} ELSE {b} END) AS int)")
    return lines.filter(h | s).select(
        "pdb_id", "line_no", F.when(h, "H").otherwise("E").alias("kind"),
        F.when(h, F.substring("value", 20, 1)).otherwise(F.substring("value", 22, 1)).alias("chain"),
        pick("substring(value, 22, 4)", "substring(value, 23, 4)").alias("start"),
        pick("substring(value, 34, 4)", "substring(value, 34, 4)").alias("end"))


def label_residues(trace: DataFrame, records: DataFrame) -> DataFrame:
    """Observed label per residue: the last covering record wins, default coil."""
    r = records.withColumn("resseq", F.explode(F.sequence("start", "end"))).groupBy("pdb_id", "chain", "resseq").agg(
        F.max_by("kind", "line_no").alias("kind")).withColumn("resseq", F.col("resseq").cast("string"))
    return trace.join(r, ["pdb_id", "chain", "resseq"], "left").withColumn("kind", F.coalesce("kind", F.lit("C")))


def heavy(atom: DataFrame) -> DataFrame:
    return atom.filter(~F.col("atom").startswith("H"))


def centroids(df: DataFrame) -> DataFrame:
    return df.groupBy("pdb_id", "res", "chain", "resseq").agg(*[F.avg(k).alias(k) for k in "xyz"], F.count("*").alias("n_atoms"))


def het_groups(atom: DataFrame) -> DataFrame:
    """Ligands: HETATM groups of at least three heavy atoms outside the skip lists."""
    skip = [*C.SKIP_HET, *C.PTM3, *C.AA3]
    return centroids(heavy(atom).filter((F.col("record") == "HETATM") & ~F.col("res").isin(*skip))).filter("n_atoms >= 3")


def metal_sites(atom: DataFrame) -> DataFrame:
    return atom.filter((F.col("record") == "HETATM") & F.col("res").isin(*C.METALS))


def ptm_groups(atom: DataFrame) -> DataFrame:
    return centroids(heavy(atom).join(F.broadcast(dims.ptm_dim(atom.sparkSession)), "res")).join(
        F.broadcast(dims.ptm_dim(atom.sparkSession)), "res")


def sidechain_atoms(atom: DataFrame) -> DataFrame:
    """Heavy side-chain atoms and the N, CA, C, O frame of every residue, a row per atom with its place.

    ``part`` is 'side' or 'frame'; of a frame atom that is given more than once the last counts, side-chain atoms are all kept. ``idx`` numbers
    a chain's residues in order of appearance; those without CA are in no trace and have none. A residue has the letter of its first line.
    """
    side, frame = ~F.col("atom").isin(*C.BACKBONE), F.col("atom").isin(*C.FRAME)
    res = W.partitionBy("pdb_id", "chain", "resseq")
    a = heavy(atom).filter("record = 'ATOM'").join(F.broadcast(dims.aa3_dim(atom.sparkSession)), "res").repartition("pdb_id", "chain")
    # by atom first: its order serves the residues as well, so that rows are sorted once for both
    a = a.withColumn("last", F.max("line_no").over(W.partitionBy("pdb_id", "chain", "resseq", "atom")))
    a = a.withColumns({"aa": F.min_by("aa", "line_no").over(res), "first": F.min("line_no").over(res), "whole": F.bool_or(F.col("atom") == "CA").over(res)})
    place = F.dense_rank().over(W.partitionBy("pdb_id", "chain", "whole").orderBy("first")) - 1
    a = a.withColumn("idx", F.when(F.col("whole"), place)).filter(side | (frame & (F.col("line_no") == F.col("last"))))
    return a.select("pdb_id", "chain", "resseq", "idx", "aa", F.when(side, "side").otherwise("frame").alias("part"), "atom", "line_no", "x", "y", "z")


def sidechain_centroids(atom: DataFrame) -> DataFrame:
    """Mean heavy side-chain atom per residue that has a CA, else the CA itself."""
    a = heavy(atom).filter((F.col("record") == "ATOM") & F.col("res").isin(*C.AA3))
    side, ca = ~F.col("atom").isin(*C.BACKBONE), F.col("atom") == "CA"
    g = a.groupBy("pdb_id", "chain", "resseq").agg(
        *[F.avg(F.when(side, F.col(k))).alias(f"s{k}") for k in "xyz"], F.max_by(F.struct(*"xyz"), F.when(ca, F.col("line_no"))).alias("ca"))
    return g.filter("ca is not null").select("pdb_id", "chain", "resseq", *[F.coalesce(f"s{k}", f"ca.{k}").alias(k) for k in "xyz"])


def hydrogen_atoms(atom: DataFrame) -> DataFrame:
    """H and D atoms under one name; the H row wins over its D twin, the later H over the earlier."""
    a = atom.filter((F.col("record") == "ATOM") & F.col("res").isin(*C.AA3) & F.col("atom").rlike("^[HD]|^[0-9].*H"))
    d = F.col("atom").startswith("D")
    name = F.when(d, F.concat(F.lit("H"), F.substring("atom", 2, 10))).otherwise(F.col("atom"))
    pick = F.struct((~d).cast("int"), F.when(d, -F.col("line_no")).otherwise(F.col("line_no")))
    return a.groupBy("pdb_id", "chain", "resseq", name.alias("name")).agg(F.max_by(F.struct(*"xyz"), pick).alias("p")).select(
        "pdb_id", "chain", "resseq", "name", "p.*")


def pdb_lines(points: DataFrame) -> DataFrame:
    """CA records of a model as PDB text lines."""
    return points.select(F.format_string("%-6s%5d %-4s %3s %s%4d    %8.3f%8.3f%8.3f%22s%2s", F.lit("ATOM"), F.col("idx") + 1, F.lit(" CA "),
                                         F.col("res"), F.col("chain"), F.col("idx") + 1, "x", "y", "z", F.lit(""), F.lit("C")).alias("value"))
