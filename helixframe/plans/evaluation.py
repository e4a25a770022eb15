"""Evaluation and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions.common import freeze
from ..operators import evaluate as EV
from ..operators import pairs as PR
from ..operators.ranking import quantiles, with_quantiles
from ..session import stored
from .base import R, num, query, r6, table, with_
from .pairs import EV as EVSQL
from .pairs import P1, P3, chain_sql, scored
from .structures import PTS, points

SS = """ss AS (SELECT l_suppkey AS g, CASE l_returnflag WHEN 'A' THEN 'H' WHEN 'N' THEN 'E' ELSE 'C' END AS obs, CASE l_linenumber%3 WHEN 0 THEN 'H' WHEN 1 THEN 'E' ELSE 'C' END AS pred FROM lineitem)"""


def ss(spark, sf):
    f, n = F.col("l_returnflag"), F.col("l_linenumber") % 3
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("g"), F.when(f == "A", "H").when(f == "N", "E").otherwise("C").alias("obs"),
        F.when(n == 0, "H").when(n == 1, "E").otherwise("C").alias("pred"))


REC = {k: f"count(*) FILTER (obs='{k}' AND pred='{k}')/nullif(count(*) FILTER (obs='{k}'),0)::DOUBLE" for k in "HEC"}


@query("confusion", with_(SS) + "SELECT g, count(*) AS total, " + ",".join(
    f"count(*) FILTER (obs='{a}' AND pred='{b}') AS n_{a}{b}" for a in "HEC" for b in "HEC") + "," + R(
    "count(*) FILTER (obs=pred)/count(*)::DOUBLE", "accuracy") + "," + R("(" + "+".join(REC.values()) + ")/3", "macro_recall") + " FROM ss GROUP BY g")
def confusion(spark, sf):
    return EV.confusion(ss(spark, sf), ["g"]).select("g", "total", *[F.col(a + b).alias(f"n_{a}{b}") for a in "HEC" for b in "HEC"],
                                                     r6("accuracy"), r6("macro_recall"))


ACC = "acc AS (SELECT g, avg(CASE WHEN obs=pred THEN 1.0 ELSE 0 END) AS a FROM ss GROUP BY g)"
POIS = []
_c, _p = 0.0, 0.36787944117144233
for _k in range(20):
    _c += _p
    POIS.append(f"WHEN u<{_c!r} THEN {_k}")
    _p /= _k + 1


@query("bootstrap_ci", with_(SS, ACC) + f""", w AS (SELECT b, a, CASE {" ".join(POIS)} ELSE 20 END AS w FROM (SELECT b, a, ((g*7919+b*104729+g*b%99991)%1000003*48271%1000003+0.5::DOUBLE)/1000003.0::DOUBLE AS u FROM acc, range(2000) t(b))),
 m AS (SELECT b, sum(a*w)/nullif(sum(w),0)::DOUBLE AS m FROM w GROUP BY b), md AS (SELECT b, median(a) AS m FROM (SELECT b, a, unnest(range(w)) AS k FROM w) GROUP BY b)
SELECT {R('quantile_cont(m,0.025)', 'lo')}, {R('quantile_cont(m,0.975)', 'hi')}, count(m) AS draws, (SELECT {R('quantile_cont(m,0.025)', 'x')} FROM md) AS median_lo, (SELECT {R('quantile_cont(m,0.975)', 'x')} FROM md) AS median_hi FROM m""")
def bootstrap_ci(spark, sf):
    acc = ss(spark, sf).groupBy("g").agg(F.avg((F.col("obs") == F.col("pred")).cast("double")).alias("value")).withColumnRenamed("g", "id")
    acc = stored(acc)
    median = EV.bootstrap_ci(acc, 2000, stat="median").select(F.struct(r6("lo"), r6("hi"))).scalar()
    return EV.bootstrap_ci(acc, 2000).select(r6("lo"), r6("hi"), "draws", median["lo"].alias("median_lo"), median["hi"].alias("median_hi"))


@query("permutation_enrichment", with_(SS, ACC) + f""", pc AS MATERIALIZED (SELECT g, s_nationkey AS kind, s_acctbal>5000 AS picked, (rank() OVER (ORDER BY a)-1)/count(*) OVER ()::DOUBLE AS pct FROM acc JOIN supplier ON s_suppkey=g),
 f AS (SELECT count(*) FILTER (picked) AS k, avg(pct) FILTER (picked) AS obs FROM pc),
 n AS (SELECT t, avg(pct) AS m FROM (SELECT t, pct, row_number() OVER (PARTITION BY t ORDER BY (g*7919+t*104729+g*t%6007)%100003, g) AS r FROM pc, range(20000) x(t)), f WHERE r<=k GROUP BY t),
 pl AS (SELECT kind, pct, row_number() OVER (PARTITION BY kind ORDER BY g)-1 AS o, count(*) OVER (PARTITION BY kind) AS size FROM pc),
 s AS (SELECT t, avg(pl.pct) AS m FROM (SELECT g, pc.kind, t, (g*48271+t*104729+7)%2147483647*69621%2147483647%z.size AS o FROM pc JOIN (SELECT DISTINCT kind, size FROM pl) z USING (kind), range(20000) x(t) WHERE picked) d JOIN pl USING (kind,o) GROUP BY t)
SELECT max(k) AS n_set, {R('max(obs)', 'observed')}, {R('avg(CASE WHEN round(m,12)>=round(obs,12) THEN 1.0 ELSE 0 END)', 'p_value')},
 {R('(SELECT avg(CASE WHEN round(m,12)>=round(obs,12) THEN 1.0 ELSE 0 END) FROM s, f)', 'p_same_kind')} FROM n, f""")
def permutation_enrichment(spark, sf):
    """Suppliers of a high balance; a supplier's kind is its nation."""
    acc = ss(spark, sf).groupBy("g").agg(F.avg((F.col("obs") == F.col("pred")).cast("double")).alias("value"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("g"), F.col("s_nationkey").alias("kind"), (F.col("s_acctbal") > 5000).alias("picked"))
    v = acc.join(s, "g").select(F.col("g").alias("id"), "value", "kind", "picked")
    return EV.permutation_enrichment(v).select("n_set", *[r6(k) for k in ("observed", "p_value", "p_same_kind")])


@query("spearman", f"""WITH r AS (SELECT l_suppkey AS g, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity)+(count(*) OVER (PARTITION BY l_suppkey,l_quantity)-1)/2.0::DOUBLE AS rx,
 rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice)+(count(*) OVER (PARTITION BY l_suppkey,l_extendedprice)-1)/2.0::DOUBLE AS ry FROM lineitem) SELECT g, {R('corr(rx,ry)', 'spearman')} FROM r GROUP BY g""")
def spearman(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))
    return EV.spearman(d, ["g"], "a", "b").select("g", r6("spearman"))


@query("pearson", chain_sql(P1, P3) + f"SELECT seq_id, {R('coalesce(corr(m,1/distance),0)', 'proximity')}, {R('coalesce(corr(loc,1/distance),0)', 'locality')} FROM pm GROUP BY seq_id")
def pearson(spark, sf):
    inv = 1 / F.col("distance")
    return scored(spark, sf).groupBy("seq_id").agg(r6(EV.pearson(F.col("m"), inv), "proximity"), r6(EV.pearson(F.col("locality"), inv), "locality"))


SEPC = """sc AS (SELECT seq_id, m-avg(m) OVER w AS a, 1/distance-avg(1/distance) OVER w AS b, count(*) OVER w AS k FROM pm WINDOW w AS (PARTITION BY seq_id, sep))"""


@query("separation_pearson", chain_sql(P1, P3, SEPC) + f"SELECT seq_id, {R('sum(a*b)/sqrt(sum(a*a)*sum(b*b))', 'pearson')} FROM sc WHERE k>=2 GROUP BY seq_id")
def separation_pearson(spark, sf):
    p = scored(spark, sf).select("seq_id", "sep", "m", (1 / F.col("distance")).alias("truth"))
    return EV.centred_pearson(p, ["seq_id"], "sep", "m", "truth").select("seq_id", r6("pearson"))


ABL = """ab AS (SELECT seq_id, mask, sep, (CASE WHEN mask&1<>0 THEN loc ELSE 0 END)+(CASE WHEN mask&2<>0 THEN chemistry ELSE 0 END)+(CASE WHEN mask&4<>0 THEN helix ELSE 0 END)+(CASE WHEN mask&8<>0 THEN sheet ELSE 0 END) AS s, 1/distance AS t
 FROM pm, range(1,16) r(mask) WHERE sep>=6),
ac AS (SELECT seq_id, mask, s-avg(s) OVER w AS a, t-avg(t) OVER w AS b, count(*) OVER w AS k FROM ab WINDOW w AS (PARTITION BY seq_id, mask, sep)),
ap AS (SELECT seq_id, mask, CASE WHEN sqrt(sum(a*a)*sum(b*b))<1e-9 THEN 0 ELSE sum(a*b)/sqrt(sum(a*a)*sum(b*b)) END AS r FROM ac WHERE k>=2 GROUP BY ALL)"""


@query("channel_ablation", chain_sql(P1, P3, ABL) + f"SELECT mask::INT AS mask, {R('median(r)', 'median')}, {R('min(r)', 'worst')} FROM ap GROUP BY mask")
def channel_ablation(spark, sf):
    p = scored(spark, sf).select("seq_id", "sep", "distance", "locality", "chemistry", "helix", "sheet")
    return EV.channel_ablation(p, ["locality", "chemistry", "helix", "sheet"]).select("mask", r6("median"), r6("worst"))


@query("channel_validation", chain_sql(P1, P3, SEPC) + f"""SELECT c.item_id AS seq_id, length(regexp_replace(text,'[^ARNDCQEGHILKMFPSTWYVarndcqeghilkmfpstwyv]','','g')) AS length,
 'ok' AS status, {R('max(r)', 'pearson')} FROM benchmark c JOIN (SELECT seq_id, sum(a*b)/sqrt(sum(a*a)*sum(b*b)) AS r FROM sc WHERE k>=2 GROUP BY seq_id) s ON s.seq_id=c.item_id GROUP BY c.item_id, text""")
def channel_validation(spark, sf):
    """Fixed score on a holdout whose chain lengths must match the manifest."""
    from .base import chains

    manifest = chains(spark, sf).select("seq_id", F.length("seq").cast("bigint").alias("expected"))
    p = scored(spark, sf).select("seq_id", F.col("n").alias("len"), "sep", "m", (1 / F.col("distance")).alias("truth"))
    r = EV.centred_pearson(p, ["seq_id", "len"], "sep", "m", "truth").join(manifest, "seq_id")
    return r.select("seq_id", F.col("expected").alias("length"), F.when(F.col("len") == F.col("expected"), "ok").otherwise("length_changed").alias("status"), r6("pearson"))


@query("nearest_pairs_recall", chain_sql(P1) + f""", nr AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY round(distance,9), i, j) AS k FROM p0 WHERE sep>={C.GATE})
SELECT seq_id, count(*) FILTER (distance<8) AS n_native, {R('count(*) FILTER (distance<8 AND k<=greatest(n//2,1))/greatest(count(*) FILTER (distance<8),1)::DOUBLE', 'recall')} FROM nr GROUP BY seq_id""")
def nearest_pairs_recall(spark, sf):
    from ..operators.ranking import top_n
    from .pairs import chain_pairs

    p = PR.native_distance(chain_pairs(spark, sf, gate=C.GATE)).select("seq_id", "n", "i", "j", "distance")
    p = freeze(p.withColumns({"score": -F.round("distance", 9), "half": F.greatest(F.floor(F.col("n") / 2), F.lit(1))}))
    best = top_n(p, ["seq_id"], "score", "half", ["i", "j"]).groupBy("seq_id").agg(F.count_if(F.col("distance") < 8).alias("hits"))
    nat = p.groupBy("seq_id").agg(F.count_if(F.col("distance") < 8).alias("n_native"))
    return nat.join(best, "seq_id").select("seq_id", "n_native", r6(F.col("hits") / F.greatest("n_native", F.lit(1)), "recall"))


@query("distance_wall", chain_sql(P1, P3) + f"""SELECT seq_id, distance<8 AS is_contact, count(*) AS n, {R(f'coalesce(corr(least(3.8/greatest(m,1e-9),{num(C.CONTACT*C.PHI**2)}),distance),0)', 'corr')}, {R(f'avg(abs(least(3.8/greatest(m,1e-9),{num(C.CONTACT*C.PHI**2)})-distance))', 'mae', 4)} FROM pm GROUP BY ALL""")
def distance_wall(spark, sf):
    pred = F.least(C.CA_CA / F.greatest(F.col("m"), F.lit(1e-9)), F.lit(C.CONTACT * C.PHI**2))
    return scored(spark, sf).withColumn("pred", pred).groupBy("seq_id", (F.col("distance") < 8).alias("is_contact")).agg(
        F.count("*").alias("n"), r6(EV.pearson("pred", "distance"), "corr"), r6(F.avg(F.abs(F.col("pred") - F.col("distance"))), "mae", 4))


BINS = [("backbone_sep1_2", 1, 2), ("helix_period_3_4_7", 3, 4), ("helix_period_3_4_7", 7, 7), ("mid_range_5_12", 5, 12), ("long_range_contacts", 13, None)]


@query("bin_error_stats", chain_sql(P1) + f""", er AS (SELECT sep, 3.8*pow(sd,1/pi())-distance AS err FROM p0), bn(bin,lo,hi) AS (VALUES {",".join(f"('{a}',{b},{'NULL' if c is None else c})" for a, b, c in BINS)})
SELECT bin, count(*) AS n_pairs, {R('avg(abs(err))', 'mean_abs')}, {R('median(abs(err))', 'median_abs')}, {R('quantile_cont(abs(err),0.9)', 'p90_abs')}, {R('median(err)', 'signed_median')}
 FROM er JOIN bn ON sep>=lo AND (hi IS NULL OR sep<=hi) GROUP BY bin""")
def bin_error_stats(spark, sf):
    from .pairs import chain_pairs

    p = PR.native_distance(chain_pairs(spark, sf))
    e = p.select("sep", (C.CA_CA * F.pow(F.col("sep").cast("double"), F.lit(1 / C.PI)) - F.col("distance")).alias("err"))
    return EV.bin_error_stats(e, BINS).select("bin", "n_pairs", *[r6(k) for k in ("mean_abs", "median_abs", "p90_abs", "signed_median")])


CASES = """cs AS (SELECT l_orderkey AS id, l_shipdate, l_returnflag||l_linestatus AS category, l_extendedprice/10000 AS a, l_quantity/5 AS b FROM lineitem)"""
HEAD = f"""count(*) AS n, {R('median(a)', 'median_a')}, {R('median(b)', 'median_b')}, count(*) FILTER (a<b) AS wins_a, count(*) FILTER (a<=b+1.5) AS within_15, count(*) FILTER (a<2) AS sub_2"""


def cases(spark, sf):
    return table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("category"),
                                               (F.col("l_extendedprice") / 10000).alias("a"), (F.col("l_quantity") / 5).alias("b"))


def head(df, keys, *more):
    """Counts and exact medians of both sides per key."""
    a, b = F.col("a"), F.col("b")
    out = with_quantiles(df, keys, {"median_a": ("a", 0.5), "median_b": ("b", 0.5)}, F.count("*").alias("n"),
                         F.count_if(a < b).alias("wins_a"), F.count_if(a <= b + 1.5).alias("within_15"), F.count_if(a < 2).alias("sub_2"), *more)
    return out.withColumns({k: r6(k) for k in ("median_a", "median_b")})


@query("head_to_head", with_(CASES) + f"SELECT {HEAD}, {R('avg(a-b)', 'mean_gap')} FROM cs")
def head_to_head(spark, sf):
    return head(cases(spark, sf), [], r6(F.avg(F.col("a") - F.col("b")), "mean_gap"))


@query("category_summary", with_(CASES) + f"SELECT category, {HEAD} FROM cs GROUP BY ROLLUP(category)")
def category_summary(spark, sf):
    c = cases(spark, sf)
    return head(c, ["category"]).unionByName(head(c, []).withColumn("category", F.lit(None).cast("string")))


@query("best_routing", f"""WITH r AS (SELECT l_suppkey%6 AS routing, median(l_extendedprice) AS m FROM lineitem GROUP BY 1) SELECT routing, {R('m', 'median', 3)}, row_number() OVER (ORDER BY m, routing) AS place FROM r""")
def best_routing(spark, sf):
    from pyspark.sql import Window as W

    r = quantiles(table(spark, sf, "lineitem").withColumn("routing", F.col("l_suppkey") % 6), ["routing"], {"m": ("l_extendedprice", 0.5)})
    # six routings at most, so one ordered window is enough
    return r.select("routing", r6("m", "median", 3), F.row_number().over(W.orderBy("m", "routing")).cast("bigint").alias("place"))


@query("gate_checks", with_(CASES) + f""", m AS (SELECT count(*)>=100 AS g1, median(a)<=median(b) AS g2, count(*) FILTER (a<2)/count(*)::DOUBLE>=0.1 AS g3 FROM cs)
SELECT name, required, CASE WHEN ok THEN 'pass' WHEN required THEN 'fail' ELSE 'warn' END AS status FROM (SELECT 'volume' AS name, true AS required, g1 AS ok FROM m UNION ALL SELECT 'median', true, g2 FROM m UNION ALL SELECT 'sub_2', false, g3 FROM m)""")
def gate_checks(spark, sf):
    m = with_quantiles(cases(spark, sf), [], {"ma": ("a", 0.5), "mb": ("b", 0.5)}, (F.count("*") >= 100).alias("g1"),
                       (F.count_if(F.col("a") < 2) / F.count("*") >= 0.1).alias("g3")).withColumn("g2", F.col("ma") <= F.col("mb"))
    rows = m.selectExpr("stack(3, 'volume', true, g1, 'median', true, g2, 'sub_2', false, g3) as (name, required, ok)")
    return rows.select("name", "required", F.when(F.col("ok"), "pass").when(F.col("required"), "fail").otherwise("warn").alias("status"))


@query("coverage_board", with_(CASES) + """, j AS (SELECT category, CASE WHEN median(a)<2 THEN 'missing' WHEN median(a)<5 THEN 'covered' ELSE 'partial' END AS status FROM cs GROUP BY category)
SELECT status, count(*) AS n, string_agg(category,',' ORDER BY category) AS jobs FROM j GROUP BY status""")
def coverage_board(spark, sf):
    j = quantiles(cases(spark, sf), ["category"], {"m": ("a", 0.5)})
    j = j.withColumn("status", F.when(F.col("m") < 2, "missing").when(F.col("m") < 5, "covered").otherwise("partial"))
    return j.groupBy("status").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("category")), ",").alias("jobs"))


@query("error_modes", """WITH p AS (SELECT l_suppkey AS protein, sum(l_quantity) AS quantity, sum(l_discount)*500 AS discount, sum(l_tax)*600 AS tax FROM lineitem GROUP BY 1),
 l AS (SELECT protein, unnest(['quantity','discount','tax']) AS mode, unnest([quantity,discount,tax]) AS score FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY protein ORDER BY round(score,6) DESC, mode) AS k FROM l)
SELECT mode, sum(1+CASE WHEN k=1 THEN 2 ELSE 0 END)::BIGINT AS votes, """ + R("avg(score)", "mean_score", 4) + " FROM r GROUP BY mode")
def error_modes(spark, sf):
    from pyspark.sql import Window as W

    p = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("protein")).agg(
        F.sum("l_quantity").alias("q"), (F.sum("l_discount") * 500).alias("d"), (F.sum("l_tax") * 600).alias("t"))
    long = p.selectExpr("protein", "stack(3, 'quantity', q, 'discount', d, 'tax', t) as (mode, score)")
    first = F.row_number().over(W.partitionBy("protein").orderBy(F.desc(F.round("score", 6)), "mode")) == 1
    return long.withColumn("p", first).groupBy("mode").agg(F.sum(F.when(F.col("p"), 3).otherwise(1)).alias("votes"), r6(F.avg("score"), "mean_score", 4))


@query("hotspots", with_(PTS) + """, e AS (SELECT p.target, p.model, p.idx, sqrt(pow(p.x-q.x,2)+pow(p.y-q.y,2)+pow(p.z-q.z,2)) AS err FROM pts p JOIN pts q ON q.target=p.target AND q.idx=p.idx AND q.model=0 WHERE p.model>0),
 h AS (SELECT *, quantile_cont(err,0.8) OVER (PARTITION BY target, model) AS thr, row_number() OVER (PARTITION BY target, model ORDER BY round(err,9) DESC, idx) AS k FROM e)
SELECT target, model, count(*) AS n_hot, count(*) FILTER (idx<3 OR idx>=18) AS n_ends FROM h WHERE k<=5 AND err>=thr GROUP BY target, model""")
def hotspots(spark, sf):
    from ..functions.common import dist
    from ..operators import structures as ST
    from ..operators.ranking import top_n

    p = points(spark, sf)
    m = ST.match_points(p.filter("model > 0").select("target", "model", "idx", "x", "y", "z"), p.filter("model = 0").select("target", "idx", "x", "y", "z"), ["target", "idx"])
    e = m.select("target", "model", "idx", dist("p", "q").alias("err")).withColumn("score", F.round("err", 9))
    thr = quantiles(e, ["target", "model"], {"thr": ("err", 0.8)})
    top = top_n(e, ["target", "model"], "score", 5, ["idx"]).join(thr, ["target", "model"]).filter("err >= thr")
    return top.groupBy("target", "model").agg(F.count("*").alias("n_hot"), F.count_if((F.col("idx") < 3) | (F.col("idx") >= 18)).alias("n_ends"))


@query("parity_compare", """WITH a AS (SELECT l_suppkey AS key, avg(l_quantity) AS va FROM lineitem WHERE l_suppkey%17<>3 GROUP BY 1), b AS (SELECT l_suppkey AS key, avg(l_quantity+CASE WHEN l_suppkey%5=0 THEN 0.01 ELSE 0 END) AS vb FROM lineitem WHERE l_suppkey%13<>2 GROUP BY 1)
SELECT coalesce(a.key,b.key) AS key, CASE WHEN va IS NULL THEN 'missing_left' WHEN vb IS NULL THEN 'missing_right' WHEN abs(va-vb)<=1e-6 THEN 'ok' ELSE 'differs' END AS status FROM a FULL JOIN b ON a.key=b.key""")
def parity_compare(spark, sf):
    li = table(spark, sf, "lineitem")
    a = li.filter("l_suppkey % 17 <> 3").groupBy(F.col("l_suppkey").alias("key")).agg(F.avg("l_quantity").alias("value"))
    shift = F.when(F.col("l_suppkey") % 5 == 0, 0.01).otherwise(0.0)
    b = li.filter("l_suppkey % 13 <> 2").groupBy(F.col("l_suppkey").alias("key")).agg(F.avg(F.col("l_quantity") + shift).alias("value"))
    return EV.parity_compare(a, b, 1e-6).select("key", "status")


@query("holdout_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag='R')")
def holdout_anti_join(spark, sf):
    seen = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(seen, "o_orderkey", "left_anti")


PN = chain_sql(P1, P3, EVSQL) + ", prd AS (SELECT seq_id, i, j FROM rk WHERE rank<=n), nat AS (SELECT seq_id, i, j FROM p0 WHERE sep>=7 AND distance<8) "


def predicted_native(spark, sf):
    s = scored(spark, sf)
    return (PR.top_contacts(s).select("seq_id", "i", "j"), s.filter((F.col("sep") >= C.GATE) & (F.col("distance") < 8)).select("seq_id", "i", "j"))


@query("set_union", PN + "SELECT * FROM prd UNION SELECT * FROM nat")
def set_union(spark, sf):
    p, n = predicted_native(spark, sf)
    return p.unionByName(n).distinct()


@query("set_intersect", PN + "SELECT * FROM prd INTERSECT SELECT * FROM nat")
def set_intersect(spark, sf):
    p, n = predicted_native(spark, sf)
    return p.join(n, ["seq_id", "i", "j"], "left_semi")


@query("set_except", PN + "SELECT * FROM prd EXCEPT SELECT * FROM nat")
def set_except(spark, sf):
    p, n = predicted_native(spark, sf)
    return p.join(n, ["seq_id", "i", "j"], "left_anti")


@query("dedupe_first", "SELECT l_orderkey, l_linenumber, min(l_partkey) AS first_part FROM lineitem GROUP BY ALL")
def dedupe_first(spark, sf):
    """First row per key in input order; here the order is the part number."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("first_part"))


@query("metadata_select", "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_type='ECONOMY' AND p_size BETWEEN 5 AND 30 AND p_retailprice<950 ORDER BY p_partkey")
def metadata_select(spark, sf, page: int = 0, size: int | None = None):
    """Entries by method, length range and resolution, sorted by id; with ``size``, one page."""
    p = table(spark, sf, "part").filter("p_type = 'ECONOMY' and p_size between 5 and 30 and p_retailprice < 950")
    p = p.select("p_partkey", "p_size", "p_retailprice").orderBy("p_partkey")
    return p if size is None else p.offset(page * size).limit(size)


REASON = "CASE WHEN text IS NULL OR length(text)<200 THEN 'too_short' WHEN n_chars<>length(text) THEN 'unaligned' WHEN lang='de' THEN 'excluded' END"


@query("reject_reasons", f"SELECT coalesce({REASON},'kept') AS reason, count(*) AS n FROM documents GROUP BY 1")
def reject_reasons(spark, sf):
    """First matching skip reason per record, counted."""
    n = F.length("text")
    reason = (F.when(F.col("text").isNull() | (n < 200), "too_short").when(F.col("n_chars") != n, "unaligned").when(F.col("lang") == "de", "excluded"))
    return table(spark, sf, "documents").groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


COF = "cof(res,typical,expected) AS (VALUES ('R',['1-URGENT','2-HIGH'],3),('A',['3-MEDIUM'],2),('N',['5-LOW','4-NOT SPECIFIED'],4))"


@query("cofactor_consistency", with_(COF) + """, o AS (SELECT l_orderkey, l_returnflag AS res, count(*) AS observed, max(o_orderpriority) AS ligand FROM lineitem JOIN orders ON o_orderkey=l_orderkey GROUP BY 1,2)
SELECT res, count(*) AS n_sites, count(*) FILTER (list_contains(typical,ligand)) AS typical_ligand, count(*) FILTER (observed=expected) AS coordination_ok FROM o JOIN cof USING (res) GROUP BY res""")
def cofactor_consistency(spark, sf):
    """Observed ligands against the typical list, observed against expected coordination."""
    o = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("l_orderkey", F.col("l_returnflag").alias("res")).agg(
        F.count("*").alias("observed"), F.collect_set("o_orderpriority").alias("ligands"))
    dim = spark.sql("SELECT * FROM VALUES ('R', array('1-URGENT','2-HIGH'), 3), ('A', array('3-MEDIUM'), 2), ('N', array('5-LOW','4-NOT SPECIFIED'), 4) AS t(res, typical, expected)")
    j = o.join(F.broadcast(dim), "res")
    return j.groupBy("res").agg(F.count("*").alias("n_sites"), F.count_if(F.arrays_overlap("ligands", "typical")).alias("typical_ligand"),
                                F.count_if(F.col("observed") == F.col("expected")).alias("coordination_ok"))


DMS = """d AS (SELECT p_partkey%40 AS gene, CASE WHEN p_size>25 THEN 'live' ELSE 'static' END AS src, p_brand AS name, p_size AS s, p_size+p_partkey%40 AS e FROM part),
d1 AS (SELECT * FROM d WHERE e-s+1>=20), lv AS (SELECT gene, bool_or(src='live') AS live FROM d1 GROUP BY gene), dr AS (SELECT d1.gene, name, s, e FROM d1 JOIN lv USING (gene) WHERE (src='live')=live)"""


def resolved(spark, sf):
    d = table(spark, sf, "part").select((F.col("p_partkey") % 40).alias("gene"), F.when(F.col("p_size") > 25, "live").otherwise("static").alias("src"),
                                        F.col("p_brand").alias("name"), F.col("p_size").alias("s"), (F.col("p_size") + F.col("p_partkey") % 40).alias("e"))
    d = d.filter(F.col("e") - F.col("s") + 1 >= 20)
    live = d.groupBy("gene").agg(F.bool_or(F.col("src") == "live").alias("live"))
    return d.join(live, "gene").filter((F.col("src") == "live") == F.col("live")).select("gene", "name", "s", "e")


@query("domain_resolve", with_(DMS) + "SELECT gene, name, s, e, count(*) AS n FROM dr GROUP BY ALL")
def domain_resolve(spark, sf):
    return resolved(spark, sf).groupBy("gene", "name", "s", "e").agg(F.count("*").alias("n"))


@query("domain_coverage", with_(DMS) + """, cv AS (SELECT DISTINCT l_suppkey%40 AS gene, l_partkey%2000+1 AS pos FROM lineitem), dd AS (SELECT DISTINCT * FROM dr)
SELECT dd.gene, name, s, e, """ + R("count(cv.pos)/(e-s+1)::DOUBLE", "covered") + " FROM dd LEFT JOIN cv ON cv.gene=dd.gene AND cv.pos BETWEEN s AND e GROUP BY dd.gene, name, s, e HAVING count(cv.pos)/(e-s+1)::DOUBLE>=0.5")
def domain_coverage(spark, sf):
    """Domains with at least half of their residues covered; spans are cut to positions first."""
    cv = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 40).alias("gene"), (F.col("l_partkey") % 2000 + 1).alias("pos")).distinct()
    d = resolved(spark, sf).distinct().withColumn("pos", F.explode(F.sequence("s", "e").cast("array<bigint>")))
    j = d.join(cv.withColumn("hit", F.lit(1.0)), ["gene", "pos"], "left")
    g = j.groupBy("gene", "name", "s", "e").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("c"))
    return g.filter("c >= 0.5").select("gene", "name", "s", "e", r6("c", "covered"))
