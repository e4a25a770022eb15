"""Query registry and the tables the registered queries derive from the inputs."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.common import rounded  # noqa: F401
from ..functions.residues import clean_sequence
from ..session import ship_package
from ..operators.sequences import spread, spread_if_few  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def shipped(fn):
    """A query that first sees to it that the executors have this package."""
    @wraps(fn)
    def run(spark, *args, **kwargs):
        ship_package(spark)
        return fn(spark, *args, **kwargs)

    return run


def query(key: str, sql: str | None = None):
    """Register a query with its SQL equivalent."""
    def register(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = shipped(fn)
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def with_(*ctes: str) -> str:
    seen: list[str] = []
    for c in ctes:
        if c not in seen:
            seen.append(c)
    return "WITH " + ",\n".join(seen) + "\n"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(name_or_col, alias: str | None = None, digits: int = 6):
    out = rounded(name_or_col, digits)
    if alias is None and isinstance(name_or_col, str):
        alias = name_or_col
    return out.alias(alias) if alias else out


def R(expr: str, alias: str, digits: int = 6) -> str:
    """SQL twin of ``r6``."""
    return f"round(({expr})::DOUBLE,{digits})+0::DOUBLE AS {alias}"


def cl(name: str) -> str:
    """A constant as a SQL literal."""
    return num(getattr(C, name) if isinstance(name, str) else name)


def num(x) -> str:
    """Float literal that DuckDB reads as DOUBLE, not DECIMAL."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


LETTERS26 = "abcdefghijklmnopqrstuvwxyz"
BASES26 = "ACGTACGTACGTACGTACGTACGUNN"

DNA = f"""dna AS (SELECT doc_id AS seq_id, translate(lower(regexp_replace(text,'[^A-Za-z]','','g')),
 '{LETTERS26}','{BASES26}') AS seq FROM documents)"""
UP = "dnau AS (SELECT seq_id, replace(seq,'U','T') AS seq FROM dna)"
CODONS = """codons AS (SELECT seq_id, unnest(regexp_extract_all(seq,'...')) AS codon,
 unnest(range(len(regexp_extract_all(seq,'...')))) AS k FROM dnau)"""
CODON_DIM = "codon_dim(codon,aa) AS (VALUES " + ",".join(
    f"('{a}{b}{c}','{C.GENETIC_CODE[16 * i + 4 * j + k]}')"
    for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")
) + ")"
PROTEIN = """protein AS (SELECT doc_id AS seq_id,
 upper(regexp_replace(text,'[^ARNDCQEGHILKMFPSTWYVarndcqeghilkmfpstwyv]','','g')) AS seq FROM documents)"""
CHAINS = """chains AS (SELECT item_id AS seq_id,
 upper(regexp_replace(text,'[^ARNDCQEGHILKMFPSTWYVarndcqeghilkmfpstwyv]','','g')) AS seq FROM benchmark)"""
TURNS = """turns AS (SELECT conv_id*1000+turn AS seq_id,
 upper(regexp_replace(text,'[^ARNDCQEGHILKMFPSTWYVarndcqeghilkmfpstwyv]','','g')) AS seq FROM conversations)"""


def residues_sql(source: str, name: str = "res") -> str:
    """Long residue table of a sequence CTE, 0-based positions."""
    return (f"{name} AS (SELECT seq_id, n, unnest(range(n)) AS pos, unnest(regexp_extract_all(seq,'.')) AS aa "
            f"FROM (SELECT seq_id, seq, length(seq) AS n FROM {source}))")


def _vals(v):
    if isinstance(v, float):
        return num(v)
    return "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else repr(v))


AA0 = "aa0(aa,c,p,v,aromatic,branch,hetero,detail,element,vdw,polar,kd,pkr) AS (VALUES " + ",".join(
    "(" + ",".join(_vals(x) for x in (
        aa, *C.AA_WORDS[aa], *C.ELEMENT[C.AA_WORDS[aa][7]], float(C.HYDRO[aa]), C.PKR.get(aa))) + ")"
    for aa in C.AA20
) + ")"
P, E_, G, PI_ = (num(x) for x in (C.PHI, C.E, C.GAMMA, C.PI))
AA = f"""{AA0},
aa1 AS (SELECT *, (p+v+branch+aromatic+detail)/5.0::DOUBLE AS spin, c+hetero/{P}+detail/({P}*{P}) AS charge,
 pow({P},-p)*exp(v/{PI_})*(CASE WHEN aromatic<>0 THEN {P} ELSE 1 END)*(CASE WHEN branch>0 THEN sqrt({P}) ELSE 1 END)
 *(CASE WHEN hetero<0 THEN 1/{P} ELSE 1 END)*(CASE WHEN hetero>0 AND aa IN ('C','M') THEN exp({G}/{PI_}) ELSE 1 END)
 *exp(detail/({PI_}*{P})) AS hydro,
 {PI_}*{E_}*pow({P},v)*pow({P},0.5*abs(aromatic))*(CASE WHEN branch>0 THEN sqrt({P}) WHEN branch<0 THEN 1/{P} ELSE 1 END)
 *(CASE WHEN hetero>0 THEN exp(1/{PI_}) WHEN hetero<0 AND aa<>'G' THEN exp(-1/({PI_}*{P})) ELSE 1 END)
 *(CASE WHEN aa='G' THEN 1/{P} ELSE 1 END)*pow({P},detail/{PI_}) AS volume,
 {G}*exp(abs(c)+p+1.0+0.5*abs(aromatic)) AS mu,
 CASE WHEN aa IN ('D','E','C','Y') THEN (CASE WHEN {num(C.PH)}>pkr THEN -1.0 ELSE 0.0 END)
  WHEN aa IN ('K','R') THEN (CASE WHEN {num(C.PH)}<pkr THEN 1.0 ELSE 0.0 END)
  WHEN aa='H' THEN 1.0/(1.0+pow(10.0,{num(C.PH)}-pkr)) ELSE 0.0 END::DOUBLE AS q,
 CASE aa WHEN 'P' THEN 1/{P} WHEN 'G' THEN 1/{E_} ELSE {P}-p/({PI_}*{P})-abs(c)/({PI_}*{PI_}) END AS ra,
 CASE aa WHEN 'P' THEN 1/{P} WHEN 'G' THEN 1/{E_} ELSE exp((v-p)/{PI_}) END AS rb,
 CASE aa WHEN 'P' THEN 1/{P} WHEN 'G' THEN 1/{E_} ELSE
  exp((v-p+greatest(branch,0)+abs(aromatic)+abs(hetero)/{P})/{PI_}) END AS rbx,
 CASE aa WHEN 'P' THEN {P} WHEN 'G' THEN {E_} ELSE exp((p-v+abs(c)/{P})/{PI_}) END AS rc FROM aa0),
aa AS (SELECT *, ra/(ra+rb+rc) AS p_alpha, rb/(ra+rb+rc) AS p_beta, rc/(ra+rb+rc) AS p_coil,
 ra/(ra+rbx+rc) AS p_alpha_x, rbx/(ra+rbx+rc) AS p_beta_x, rc/(ra+rbx+rc) AS p_coil_x FROM aa1)"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("seq_id"), "text")
    return spread_if_few(d, "seq_id")


def dna(spark: SparkSession, sf: str) -> DataFrame:
    letters = F.lower(F.regexp_replace("text", "[^A-Za-z]+", ""))
    return documents(spark, sf).select("seq_id", F.translate(letters, LETTERS26, BASES26).alias("seq"))


def protein(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("seq_id", clean_sequence("text").alias("seq"))


def chains(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "benchmark")
    return d.select(F.col("item_id").alias("seq_id"), clean_sequence("text").alias("seq"))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "conversations")
    return d.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq_id"),
                    clean_sequence("text").alias("seq"))
