"""Sequence, alignment and manifest readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.residues import clean_sequence


def fasta_records(texts: DataFrame, keep_insertions: bool = True) -> DataFrame:
    """(file, text) to (file, ord, accession, seq). The id is the second | field, else the first token.

    With ``keep_insertions`` off, lower-case letters are dropped instead of upper-cased.
    """
    r = texts.select("file", F.posexplode(F.split("text", "(^|\n)>")).alias("ord", "rec")).filter(F.length(F.trim("rec")) > 0)
    head = F.split("rec", "\n")[0]
    fields = F.split(head, r"\|")
    acc = F.when(F.size(fields) > 1, fields[1]).otherwise(F.split(head, r"\s+")[0])
    body = F.regexp_replace("rec", r"^[^\n]*\n?", "")
    if keep_insertions:
        seq = clean_sequence(body)
    else:
        seq = F.regexp_replace(F.regexp_replace(body, r"\s", ""), "[a-z]", "")
    return r.select("file", "ord", acc.alias("accession"), seq.alias("seq"))


def read_fasta(texts: DataFrame, min_length: int = 20) -> DataFrame:
    return fasta_records(texts).filter(F.length("seq") >= min_length)


def read_a3m(texts: DataFrame) -> DataFrame:
    return fasta_records(texts, keep_insertions=False)


def read_stockholm(texts: DataFrame) -> DataFrame:
    """Two-token lines outside comments; blocks are joined in order per name."""
    lines = texts.select("file", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    tok = F.split(F.trim("line"), r"\s+")
    body = lines.filter(~F.col("line").startswith("#") & ~F.col("line").startswith("//") & (F.size(tok) == 2))
    g = body.select("file", "ln", tok[0].alias("name"), tok[1].alias("chunk")).groupBy("file", "name").agg(
        F.array_sort(F.collect_list(F.struct("ln", "chunk"))).alias("c"))
    return g.select("file", F.col("name").alias("accession"), F.array_join(F.col("c.chunk"), "").alias("seq"))


def sniff_format(file, text) -> F.Column:
    """By suffix first (gzip ignored), then by the header."""
    f = F.lower(F.regexp_replace(file, r"\.gz$", ""))
    return (F.when(f.rlike(r"\.(sto|stk|stockholm)$"), "stockholm").when(f.rlike(r"\.(a3m|fa|fasta|faa)$"), "a3m")
            .when(F.ltrim(text).startswith("# STOCKHOLM"), "stockholm").otherwise("a3m"))


def read_msa(texts: DataFrame) -> DataFrame:
    """Union of the readers, each on the files of its format."""
    t = texts.withColumn("fmt", sniff_format(F.col("file"), F.col("text")))
    a = read_a3m(t.filter("fmt = 'a3m'")).select("file", "accession", "seq")
    return a.unionByName(read_stockholm(t.filter("fmt = 'stockholm'")))


def content_hash_check(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, content) against (file, sha256): status per manifest entry."""
    h = files.select("file", F.sha2("content", 256).alias("actual"))
    j = manifest.join(h, "file", "left")
    return j.select("file", F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("sha256"), "ok").otherwise("changed").alias("status"))
