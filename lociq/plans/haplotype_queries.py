"""Haplotype and linkage queries on the dense stand-in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.operators import genotypes, haplotype, scans
from lociq.plans.fixtures import DENSE, SIGMA, dense_sites, segregating

BY = ["chrom", "win"]
_WIN = "g AS (SELECT sa.*, n, k, daf, (site - 1) // 16 AS win FROM sa JOIN sites USING (chrom, pos, site))"
_STR = "strs AS (SELECT chrom, win, hap, string_agg(CAST(allele AS VARCHAR), '' ORDER BY site) AS h FROM g GROUP BY ALL), cnt AS (SELECT chrom, win, h, count(*) AS c FROM strs GROUP BY ALL)"


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segregating sites in windows of 16 columns."""
    return segregating(spark, sf_dir).withColumn("win", F.floor((F.col("site") - 1) / F.lit(16)))


def garud_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    # windows of 4 sites, so that haplotypes repeat
    return haplotype.garud(segregating(spark, sf_dir).withColumn("win", F.floor((F.col("site") - 1) / F.lit(4))), BY)


def lassi_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return haplotype.lassi_spectrum(segregating(spark, sf_dir).withColumn("win", F.floor((F.col("site") - 1) / F.lit(4))), BY)


def haf_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return haplotype.haf_top(_windows(spark, sf_dir), BY)


def pairwise_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return haplotype.pairwise_moments(_windows(spark, sf_dir), BY)


def ld_zns_omega(spark: SparkSession, sf_dir: str) -> DataFrame:
    sa = genotypes.dense(spark, sf_dir).withColumn("win", F.floor((F.col("site") - 1) / F.lit(16)))
    return haplotype.packed_ld(genotypes.biallelic(genotypes.words(sa, [*BY, "site"])), BY)  # the counts come with the words: the long table is not joined with them


def focal_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return haplotype.focal_statistics(haplotype.focal_pairs(segregating(spark, sf_dir), 10_000))


def raisd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return haplotype.raisd(segregating(spark, sf_dir), 20)


def safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return haplotype.safe(_windows(spark, sf_dir), BY)


def site_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return haplotype.sort_sites(dense_sites(spark, sf_dir)).select("chrom", "site", "k", "rank")


def haplotype_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return haplotype.sort_haplotypes(segregating(spark, sf_dir))


def hamming_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return haplotype.hamming_order(segregating(spark, sf_dir))


def packed_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = genotypes.packed(genotypes.dense(spark, sf_dir))
    return p.select("chrom", "pos", "site", F.array_join("alleles", "").alias("alleles"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genotypes.packed(segregating(spark, sf_dir))


def ihs_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scans.prefix_scan(_packed(spark, sf_dir), scans.ihs, ["daf", "ihs", "delta_ihh"], include_edges=True)
    return out.filter("ihs is not null and not isnan(ihs)")


def nsl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.prefix_scan(_packed(spark, sf_dir), scans.nsl, ["daf", "nsl"])


def hscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scans.prefix_scan(_packed(spark, sf_dir), scans.hscan, ["hscan"])
    return out.select("chrom", "pos", F.round("hscan", 4).alias("hscan"))


def isafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan(_packed(spark, sf_dir), lambda h, pos: scans.isafe(h, pos, 30, 15), {"isafe": "double"})


def lassi_t_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.lassi_scan(_packed(spark, sf_dir), 10, 4, 2)


def h12_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.h12_scan(_packed(spark, sf_dir), 20, 10)


def tiered_h12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.tiered_h12_scan(_packed(spark, sf_dir), 32_050, 60_000)


def isafe_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.isafe_regions(_packed(spark, sf_dir), 20_000, 10, 300, 150)


def beta_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.beta(dense_sites(spark, sf_dir), 10_000)


_WIN4 = _WIN.replace("// 16", "// 4")
_FOCAL_SQL = """round(sum(fa * (1 - fa)) * max(na) / (max(na) - 0.999) / (sum(fd * (1 - fd)) * max(nd) / (max(nd) - 0.999) + 0.001), 6) AS dind,
    round(CAST(coalesce(sum(CASE WHEN c11 * 4 > nd THEN c11 * c11 END), 0) AS DOUBLE) / (max(nd) * max(nd)) / CAST(greatest(count(CASE WHEN c11 * 4 > nd THEN 1 END), 1) AS DOUBLE), 6) AS high_freq,
    round(CAST(coalesce(sum(CASE WHEN c11 * 4 > nd THEN (nd - c11) ** 2 END), 0) AS DOUBLE) / (max(nd) * max(nd)) / CAST(greatest(count(CASE WHEN c11 * 4 > nd THEN 1 END), 1) AS DOUBLE), 6) AS low_freq,
    round(CAST(coalesce(sum(CASE WHEN c11 * 4 < nd THEN (nd - c11) ** 2 END), 0) AS DOUBLE) / (max(nd) * max(nd)) / CAST(greatest(count(CASE WHEN c11 * 4 < nd THEN 1 END), 1) AS DOUBLE), 6) AS low_freq_documented,
    round(CAST(count(*) + count(CASE WHEN fa BETWEEN 1e-7 AND 0.9999999 THEN 1 END) AS DOUBLE) / (count(*) + count(CASE WHEN fd BETWEEN 1e-7 AND 0.9999999 THEN 1 END)), 6) AS s_ratio,
    round(avg(CASE WHEN c11 * na > c01 * nd AND c01 * 4 <= na AND ky * 4 >= nn THEN fd * fd - fa * fa END), 6) AS hapdaf_o,
    round(avg(CASE WHEN c11 * na > c01 * nd AND c01 * 10 <= na AND ky * 10 >= nn THEN fd * fd - fa * fa END), 6) AS hapdaf_s"""
QUERIES = {f.__name__: f for f in (garud_h, lassi_spectrum, haf_top, pairwise_moments, ld_zns_omega, focal_statistics, raisd, safe, site_order, haplotype_order, hamming_order, packed_alleles, ihs_scan, nsl_scan, hscan, isafe, lassi_t_lambda, h12_identity, tiered_h12, isafe_regions, beta_scan)}
_RUNS = """pr AS (SELECT x.chrom, x.hap AS i, y.hap AS j, x.o, x.pos, x.allele AS a, y.allele AS b FROM g x JOIN g y ON x.chrom = y.chrom AND x.o = y.o AND x.hap < y.hap),
        rn AS (SELECT *, coalesce(min(CASE WHEN a <> b THEN o END) OVER (PARTITION BY chrom, i, j ORDER BY o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1, max(o) OVER (PARTITION BY chrom, i, j)) AS xr,
              coalesce(max(CASE WHEN a <> b THEN o END) OVER (PARTITION BY chrom, i, j ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 1) AS xl FROM pr)"""
ORACLES = {
    "nsl_scan": f"""WITH {DENSE}, f AS (SELECT * FROM sites WHERE daf BETWEEN 0.05 AND 0.95), g AS (SELECT sa.chrom, sa.pos, sa.hap, sa.allele, row_number() OVER (PARTITION BY sa.chrom, sa.hap ORDER BY sa.pos) AS o FROM sa JOIN f USING (chrom, pos, site)), {_RUNS},
        m AS (SELECT chrom, pos, avg(CASE WHEN a = 1 THEN xr - xl + 2 END) AS one, avg(CASE WHEN a = 0 THEN xr - xl + 2 END) AS zero FROM rn WHERE a = b GROUP BY ALL)
        SELECT sites.chrom, sites.pos, daf, ln(one / zero) AS nsl FROM sites LEFT JOIN m ON m.chrom = sites.chrom AND m.pos = sites.pos""",
    "ihs_scan": f"""WITH {DENSE}, g AS (SELECT sa.chrom, sa.pos, sa.hap, sa.allele, row_number() OVER (PARTITION BY sa.chrom, sa.hap ORDER BY sa.pos) AS o FROM sa JOIN sites USING (chrom, pos, site)), {_RUNS},
        ps AS (SELECT DISTINCT chrom, o, pos FROM g), fo AS (SELECT ps.chrom, ps.o, ps.pos, daf, n, k FROM ps JOIN sites ON sites.chrom = ps.chrom AND sites.pos = ps.pos WHERE least(daf, 1 - daf) >= 0.05),
        cp AS (SELECT chrom, o, a, xr, xl, count(*) AS c FROM rn WHERE a = b GROUP BY ALL), mc AS (SELECT chrom, o, a, sum(c) AS pairs FROM cp GROUP BY ALL),
        er AS (SELECT cp.chrom, cp.o, a, x.o AS x, x.pos, sum(CASE WHEN xr >= x.o THEN c ELSE 0 END) AS c FROM cp JOIN ps x ON x.chrom = cp.chrom AND x.o > cp.o GROUP BY ALL),
        el AS (SELECT cp.chrom, cp.o, a, x.o AS x, x.pos, sum(CASE WHEN xl <= x.o THEN c ELSE 0 END) AS c FROM cp JOIN ps x ON x.chrom = cp.chrom AND x.o < cp.o GROUP BY ALL),
        e AS (SELECT er.chrom, er.o, er.a, 1 AS side, abs(x - er.o) AS d, pos, c / CAST(pairs AS DOUBLE) AS ehh FROM er JOIN mc USING (chrom, o, a) UNION ALL SELECT el.chrom, el.o, el.a, -1, abs(x - el.o), pos, c / CAST(pairs AS DOUBLE) FROM el JOIN mc USING (chrom, o, a)),
        st AS (SELECT e.*, ps.pos AS p0, coalesce(lag(ehh) OVER w, 1.0) AS before, coalesce(lag(e.pos) OVER w, ps.pos) AS pb, coalesce(min(ehh) OVER (PARTITION BY e.chrom, e.o, a, side ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS lowest FROM e JOIN ps ON ps.chrom = e.chrom AND ps.o = e.o WINDOW w AS (PARTITION BY e.chrom, e.o, a, side ORDER BY d)),
        ih AS (SELECT chrom, o, a, sum(CASE WHEN lowest > 0.05 THEN least(abs(pos - pb), 20000) * (before + ehh) / 2 ELSE 0 END) AS ihh FROM st GROUP BY ALL)
        SELECT fo.chrom, fo.pos, daf, ln(z.ihh / y.ihh) AS ihs, abs(y.ihh - z.ihh) AS delta_ihh FROM fo JOIN ih z ON z.chrom = fo.chrom AND z.o = fo.o AND z.a = 0 JOIN ih y ON y.chrom = fo.chrom AND y.o = fo.o AND y.a = 1 WHERE k > 1 AND n - k > 1""",
    "beta_scan": f"""WITH {DENSE}, {SIGMA}, fo AS (SELECT * FROM sites WHERE CAST(least(k, n - k) AS DOUBLE) / n >= 0.1::DOUBLE), co AS (SELECT DISTINCT n, k AS core FROM fo),
        dd AS (SELECT co.n, core, CAST(i AS BIGINT) AS i, least(core / CAST(co.n AS DOUBLE), 1 - core / CAST(co.n AS DOUBLE)) AS x, least(i / CAST(co.n AS DOUBLE), 1 - i / CAST(co.n AS DOUBLE)) AS y FROM co, range(1, 2000) t(i) WHERE i < co.n),
        d2 AS (SELECT *, ((greatest(x, 0.5 - x) - abs(x - y)) / greatest(x, 0.5 - x)) ** 2 AS d FROM dd),
        om AS (SELECT *, d / sum(d) OVER w AS share, d / sum(d) OVER w - (1.0::DOUBLE / i) / sum(1.0::DOUBLE / i) OVER w AS omega FROM d2 WINDOW w AS (PARTITION BY n, core)),
        va AS (SELECT p.n, p.core, sum(CASE WHEN p.i = q.i THEN p.i * p.omega * p.omega ELSE 0 END) AS al, sum(CASE WHEN p.i = q.i THEN 1 ELSE 2 END * p.i * p.omega * q.i * q.omega * s) AS be FROM om p JOIN om q ON p.n = q.n AND p.core = q.core AND p.i >= q.i JOIN sg ON sg.n = p.n AND sg.i = p.i AND sg.j = q.i GROUP BY ALL),
        b AS (SELECT fo.chrom, fo.pos, fo.n, fo.k AS core, count(*) AS sites, sum(o.k * om.share - 1 / hs.a) AS beta, max(hs.a) AS a1 FROM fo JOIN sites o ON o.chrom = fo.chrom AND o.pos <> fo.pos AND abs(o.pos - fo.pos) <= 5000 JOIN om ON om.n = fo.n AND om.core = fo.k AND om.i = o.k JOIN hs ON hs.m = fo.n GROUP BY ALL)
        SELECT chrom, pos, sites, round(beta, 6) AS beta, round(CASE WHEN al * sites / a1 + be * (sites / a1) ** 2 > 0 THEN beta / sqrt(al * sites / a1 + be * (sites / a1) ** 2) END, 6) AS t FROM b JOIN va ON va.n = b.n AND va.core = b.core""",
    "garud_h": f"""WITH {DENSE}, {_WIN4}, {_STR}, p AS (SELECT chrom, win, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY chrom, win) AS p, row_number() OVER (PARTITION BY chrom, win ORDER BY c DESC, h) AS r FROM cnt),
        a AS (SELECT chrom, win, count(*) AS k, sum(p * p) AS h1, coalesce(max(p) FILTER (r = 1), 0) AS p1, coalesce(max(p) FILTER (r = 2), 0) AS p2, coalesce(max(p) FILTER (r = 3), 0) AS p3 FROM p GROUP BY ALL)
        SELECT chrom, win, k, round(h1, 6) AS h1, round(h1 - p1 * p1 - p2 * p2 + (p1 + p2) ** 2, 6) AS h12, round(h1 - p1 * p1 - p2 * p2 - p3 * p3 + (p1 + p2 + p3) ** 2, 6) AS h123, round((h1 - p1 * p1) / h1, 6) AS h2_h1 FROM a""",
    "lassi_spectrum": f"""WITH {DENSE}, {_WIN4}, {_STR}, r AS (SELECT chrom, win, c, row_number() OVER (PARTITION BY chrom, win ORDER BY c DESC, h) AS r FROM cnt),
        t AS (SELECT chrom, win, sum(c) AS t FROM r WHERE r <= 10 GROUP BY ALL)
        SELECT t.chrom, t.win, CAST(i AS INT) AS rank, round(coalesce(CAST(c AS DOUBLE), 0) / t, 6) AS freq FROM t CROSS JOIN range(1, 11) x(i) LEFT JOIN r ON r.chrom = t.chrom AND r.win = t.win AND r.r = i""",
    "haf_top": f"""WITH {DENSE}, {_WIN}, h AS (SELECT chrom, win, hap, CAST(sum(allele * k) AS DOUBLE) / nullif(max(n) * sum(allele), 0) AS haf FROM g GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY chrom, win ORDER BY haf ASC NULLS LAST, hap) - 1 AS r, count(*) OVER (PARTITION BY chrom, win) AS m FROM h)
        SELECT chrom, win, round(coalesce(sum(haf), 0), 6) AS haf_top FROM r WHERE r >= floor(m * 0.9::DOUBLE) GROUP BY ALL""",
    "pairwise_moments": f"""WITH {DENSE}, {_WIN}, d AS (SELECT x.chrom, x.win, x.hap AS i, y.hap AS j, CAST(sum(abs(x.allele - y.allele)) AS DOUBLE) AS d FROM g x JOIN g y ON x.chrom = y.chrom AND x.win = y.win AND x.site = y.site AND x.hap < y.hap GROUP BY ALL),
        m AS (SELECT *, avg(d) OVER (PARTITION BY chrom, win) AS mean FROM d)
        SELECT chrom, win, round(var_samp(d), 6) AS dist_var, round(avg((d - mean) ** 3) / avg((d - mean) ** 2) ** 1.5, 6) AS dist_skew, round(avg((d - mean) ** 4) / avg((d - mean) ** 2) ** 2 - 3, 6) AS dist_kurtosis FROM m GROUP BY ALL""",
    "ld_zns_omega": f"""WITH {DENSE}, {_WIN}, o AS (SELECT DISTINCT chrom, win, site, n, k, dense_rank() OVER (PARTITION BY chrom, win ORDER BY site) AS o FROM g),
        p AS (SELECT x.chrom, x.win, x.site AS i, y.site AS j, CAST(sum(x.allele * y.allele) AS DOUBLE) AS n11 FROM g x JOIN g y ON x.chrom = y.chrom AND x.win = y.win AND x.hap = y.hap AND x.site < y.site GROUP BY ALL),
        r AS (SELECT p.chrom, p.win, a.o AS oi, b.o AS oj, (n11 / a.n - CAST(a.k AS DOUBLE) * b.k / a.n / a.n) ** 2 / (CAST(a.k AS DOUBLE) / a.n * (1 - CAST(a.k AS DOUBLE) / a.n) * CAST(b.k AS DOUBLE) / a.n * (1 - CAST(b.k AS DOUBLE) / a.n)) AS r2
              FROM p JOIN o a ON a.chrom = p.chrom AND a.win = p.win AND a.site = i JOIN o b ON b.chrom = p.chrom AND b.win = p.win AND b.site = j),
        s AS (SELECT chrom, win, max(oj) AS s, sum(r2) AS total FROM r GROUP BY ALL),
        c AS (SELECT s.chrom, s.win, s, total, l, sum(CASE WHEN oj <= l THEN r2 ELSE 0 END) AS lsum, sum(CASE WHEN oi > l THEN r2 ELSE 0 END) AS rsum FROM s JOIN r ON r.chrom = s.chrom AND r.win = s.win, range(3, 14) t(l) WHERE l < s - 2 GROUP BY ALL),
        om AS (SELECT chrom, win, max((lsum + rsum) / (l * (l - 1) / 2 + (s - l) * (s - l - 1) / 2) / ((total - lsum - rsum) / (l * (s - l)))) AS omega FROM c GROUP BY ALL)
        SELECT s.chrom, s.win, round(total / (s * (s - 1) / 2), 6) AS zns, round(coalesce(omega, 0), 6) AS omega_max FROM s LEFT JOIN om ON om.chrom = s.chrom AND om.win = s.win""",
    "focal_statistics": f"""WITH {DENSE}, g AS (SELECT sa.*, n, k, daf FROM sa JOIN sites USING (chrom, pos, site)),
        c AS (SELECT x.chrom, x.pos AS fpos, y.pos, max(x.k) AS nd, max(x.n) - max(x.k) AS na, max(y.k) AS ky, max(x.n) AS nn, CAST(sum(x.allele * y.allele) AS BIGINT) AS c11, CAST(sum((1 - x.allele) * y.allele) AS BIGINT) AS c01
              FROM g x JOIN g y ON x.chrom = y.chrom AND x.hap = y.hap AND abs(x.pos - y.pos) <= 10000 AND x.pos <> y.pos WHERE x.daf BETWEEN 0.25 AND 0.95 GROUP BY x.chrom, x.pos, y.pos),
        p AS (SELECT *, CAST(c11 AS DOUBLE) / nd AS fd, CAST(c01 AS DOUBLE) / na AS fa FROM c)
        SELECT chrom, fpos, count(*) AS neighbours, {_FOCAL_SQL} FROM p GROUP BY ALL""",
    "raisd": f"""WITH {DENSE}, g AS (SELECT sa.*, n, k FROM sa JOIN sites USING (chrom, pos, site)),
        s0 AS (SELECT chrom, pos, site, n, k, string_agg(CAST(allele AS VARCHAR), '' ORDER BY hap) AS h FROM g GROUP BY ALL),
        s AS (SELECT *, least(h, translate(h, '01', '10')) AS q, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS o, count(*) OVER (PARTITION BY chrom) AS total, max(pos) OVER (PARTITION BY chrom) + 1 - min(pos) OVER (PARTITION BY chrom) AS d FROM s0),
        w AS (SELECT s.*, w, o - w < 10 AS lft FROM s, range(0, 64) t(w) WHERE o >= w AND o < w + 20 AND w + 20 <= total),
        m AS (SELECT *, bool_or(lft) OVER (PARTITION BY chrom, w, q) AS inl, bool_or(NOT lft) OVER (PARTITION BY chrom, w, q) AS inr FROM w),
        a AS (SELECT chrom, w, min(pos) AS p0, max(pos) AS p1, max(d) AS d, max(total) AS total, max(n) AS n, sum(CASE WHEN k = 1 OR k = n - 1 THEN 1 ELSE 0 END) AS edge,
              count(DISTINCT CASE WHEN lft THEN q END) AS pl, count(DISTINCT CASE WHEN NOT lft THEN q END) AS pr, count(DISTINCT CASE WHEN lft AND NOT inr THEN q END) AS el, count(DISTINCT CASE WHEN NOT lft AND NOT inl THEN q END) AS er,
              sum(CASE WHEN lft AND NOT inr THEN 1 ELSE 0 END) AS sl, sum(CASE WHEN NOT lft AND NOT inl THEN 1 ELSE 0 END) AS sr FROM m GROUP BY ALL),
        v AS (SELECT chrom, (p0 + p1) / 2 AS center, CAST(p1 - p0 AS DOUBLE) / (d * 20) * total AS mv, CAST(edge AS DOUBLE) / 20 * list_sum(list_transform(range(1, n), lambda i: 1.0::DOUBLE / i)) AS ms, greatest(CAST(el * sl + er * sr AS DOUBLE) / (pl * pr), 1e-10) AS ml FROM a)
        SELECT chrom, center, round(mv, 6) AS mu_var, round(ms, 6) AS mu_sfs, round(ml, 6) AS mu_ld, round(mv * ms * ml, 6) AS mu FROM v""",
    "safe": f"""WITH {DENSE}, {_WIN}, h AS (SELECT chrom, win, hap, sum(allele * k) AS haf FROM g GROUP BY ALL), t AS (SELECT chrom, win, sum(haf) AS ah, count(DISTINCT haf) AS ak FROM h GROUP BY ALL),
        c AS (SELECT g.chrom, g.win, pos, daf, CAST(sum(haf) AS DOUBLE) AS dh, CAST(count(DISTINCT haf) AS DOUBLE) AS dk FROM g JOIN h ON g.chrom = h.chrom AND g.win = h.win AND g.hap = h.hap WHERE allele = 1 GROUP BY ALL),
        q AS (SELECT c.chrom, c.win, pos, daf, dh / ah AS phi, dk / ak AS kappa FROM c JOIN t ON t.chrom = c.chrom AND t.win = c.win),
        r AS (SELECT *, (phi - kappa) / CASE WHEN kappa * (1 - kappa) = 0 THEN 1 ELSE sqrt(kappa * (1 - kappa)) END AS p1, (phi - kappa) / sqrt(daf * (1 - daf)) AS p2 FROM q),
        u AS (SELECT chrom, win, daf AS nu FROM r QUALIFY row_number() OVER (PARTITION BY chrom, win ORDER BY round(p1, 9) DESC, pos) = 1)
        SELECT r.chrom, r.win, pos, round(phi, 6) AS phi, round(kappa, 6) AS kappa, round(p1 * (1 - nu) + p2 * nu, 6) AS safe FROM r JOIN u ON u.chrom = r.chrom AND u.win = r.win""",
    "site_order": f"WITH {DENSE} SELECT chrom, site, k, CAST(row_number() OVER (PARTITION BY chrom ORDER BY k DESC, site) AS INT) AS rank FROM sites",
    "haplotype_order": f"WITH {DENSE}, o AS (SELECT chrom, hap, CAST(sum(allele) AS BIGINT) AS ones FROM sa JOIN sites USING (chrom, pos, site) GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY chrom ORDER BY ones DESC, hap) AS INT) AS rank FROM o",
    "hamming_order": f"""WITH {DENSE}, g AS (SELECT sa.* FROM sa JOIN sites USING (chrom, pos, site)), s AS (SELECT chrom, hap, string_agg(CAST(allele AS VARCHAR), '' ORDER BY site) AS h FROM g GROUP BY ALL),
        c AS (SELECT chrom, h, count(*) AS c FROM s GROUP BY ALL), t AS (SELECT chrom, h AS ref FROM c QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY c DESC, h DESC) = 1),
        d AS (SELECT s.chrom, hap, CAST(hamming(h, ref) AS BIGINT) AS distance FROM s JOIN t USING (chrom)) SELECT *, CAST(row_number() OVER (PARTITION BY chrom ORDER BY distance, hap) AS INT) AS rank FROM d""",
    "hscan": f"""WITH {DENSE}, g AS (SELECT sa.*, row_number() OVER (PARTITION BY chrom, hap ORDER BY pos) AS o FROM sa JOIN sites USING (chrom, pos, site)),
        d AS (SELECT x.chrom, x.hap AS i, y.hap AS j, x.o, x.pos, x.allele <> y.allele AS ne FROM g x JOIN g y ON x.chrom = y.chrom AND x.pos = y.pos AND x.hap < y.hap),
        r AS (SELECT *, coalesce(min(CASE WHEN ne THEN o END) OVER (PARTITION BY chrom, i, j ORDER BY o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1, max(o) OVER (PARTITION BY chrom, i, j)) AS xr,
              coalesce(max(CASE WHEN ne THEN o END) OVER (PARTITION BY chrom, i, j ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 1) AS xl FROM d),
        p AS (SELECT DISTINCT chrom, o, pos FROM g), n AS (SELECT chrom, max(n) AS n FROM sites GROUP BY chrom)
        SELECT r.chrom, r.pos, round(sum(CASE WHEN xr <> xl THEN a.pos - b.pos - 1 ELSE 0 END) * 2.0::DOUBLE / max(n * (n - 1)), 4) AS hscan FROM r JOIN p a ON a.chrom = r.chrom AND a.o = xr JOIN p b ON b.chrom = r.chrom AND b.o = xl JOIN n ON n.chrom = r.chrom GROUP BY r.chrom, r.pos""",
    "packed_alleles": f"WITH {DENSE} SELECT chrom, pos, site, string_agg(CAST(allele AS VARCHAR), '' ORDER BY hap) AS alleles FROM sa GROUP BY ALL",
}
