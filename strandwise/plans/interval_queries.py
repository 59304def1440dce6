"""Queries over interval algebra and range joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from .roles import BIN, EL, LOCUS, MG, PK, REC, elements, merged, merged_sql, peaks, records, table

LO, HI = LOCUS
QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name], ORACLE[name] = fn, sql
        return fn

    return add


@query("I1_union_merge", f"WITH {REC}, {PK}, {merged_sql('m', 'pk')} SELECT set_id, start, \"end\" FROM m")
def union_merge(spark, d):
    return iv.merge(peaks(spark, d), ["set_id"], bin_width=1 << 16)


SUPPORT = """, ev AS (SELECT set_id, start AS pos, 1 AS d FROM src UNION ALL SELECT set_id, "end", -1 FROM src),
dp AS (SELECT *, sum(d) OVER (PARTITION BY set_id ORDER BY pos, d ROWS UNBOUNDED PRECEDING) AS depth FROM ev),
eg AS (SELECT *, lead(pos) OVER (PARTITION BY set_id ORDER BY pos, d) AS nxt FROM dp WHERE (depth - d < {k} AND depth >= {k}) OR (depth - d >= {k} AND depth < {k}))
SELECT set_id, pos AS start, nxt AS "end" FROM eg WHERE d = 1"""


@query("I2_support_depth", f"WITH {REC}, {PK}, src AS (SELECT * FROM pk WHERE \"end\" > start)" + SUPPORT.format(k=2))
def support_depth(spark, d):
    return iv.support_regions(peaks(spark, d), ["set_id"], 2)


@query("I2_support_distinct_source", f"WITH {REC}, {PK}, {merged_sql('src', 'pk', 'set_id, accession')}" + SUPPORT.format(k=2))
def support_distinct(spark, d):
    return iv.support_regions(peaks(spark, d), ["set_id"], 2, distinct_source="accession")


@query("W2_running_depth", f"WITH {REC}, {PK}, ev AS (SELECT set_id, start AS pos, 1 AS d FROM pk UNION ALL SELECT set_id, \"end\", -1 FROM pk), dp AS (SELECT set_id, sum(d) OVER (PARTITION BY set_id ORDER BY pos, d ROWS UNBOUNDED PRECEDING) AS depth FROM ev) SELECT set_id, CAST(max(depth) AS BIGINT) AS max_depth FROM dp GROUP BY set_id")
def running_depth(spark, d):
    return iv.with_depth(peaks(spark, d), ["set_id"]).groupBy("set_id").agg(F.max("depth").alias("max_depth"))


@query("J2_point_in_merged", f"WITH {MG} SELECT event_id, EXISTS (SELECT 1 FROM mg WHERE rec.pos >= mg.start AND rec.pos < mg.\"end\") AS in_peak FROM rec")
def point_in_merged(spark, d):
    return iv.is_hit(records(spark, d).select("event_id", "pos"), merged(spark, d), BIN, "event_id").select("event_id", "in_peak")


@query("J3_point_element", f"WITH {EL} SELECT event_id, rec.pos, CAST(elem_id AS BIGINT) AS elem_id FROM rec LEFT JOIN el ON rec.pos >= el.start AND rec.pos < el.\"end\"")
def point_element(spark, d):
    found = iv.hits(records(spark, d).select("event_id", "pos"), elements(spark, d), BIN).select("event_id", F.col("elem_id").cast("long").alias("elem_id"))
    return records(spark, d).select("event_id", "pos").join(found, "event_id", "left")


@query("J3_point_element_sweep", ORACLE["J3_point_element"])
def point_element_sweep(spark, d):
    return iv.locate_in_disjoint(records(spark, d).select("event_id", "pos"), elements(spark, d))


@query("J4_point_inclusive", f"WITH {MG} SELECT event_id, EXISTS (SELECT 1 FROM mg WHERE rec.pos >= mg.start AND rec.pos <= mg.\"end\") AS in_peak FROM rec")
def point_inclusive(spark, d):
    return iv.is_hit(records(spark, d).select("event_id", "pos"), merged(spark, d), BIN, "event_id", inclusive=True).select("event_id", "in_peak")


@query("J5_open_in_files", f"WITH {REC}, {PK} SELECT event_id, accession, count(*) AS n FROM rec r JOIN (SELECT * FROM pk WHERE set_id = 'purchase') p ON r.pos >= p.start AND r.pos < p.\"end\" GROUP BY ALL")
def open_in_files(spark, d):
    points = records(spark, d).select("event_id", "pos")
    counts = iv.open_counts(points, peaks(spark, d).where("set_id = 'purchase'"), "accession")
    one, several = iv.places(points, "event_id")
    packed = counts.groupBy("pos").agg(F.collect_list(F.struct("accession", "n")).alias("files"))
    one = one.join(packed, "pos").select("event_id", "times", F.explode("files").alias("f")).select("event_id", "f.accession", (F.col("f.n") * F.col("times")).alias("n"))
    return one.unionByName(several.join(counts, "pos").groupBy("event_id", "accession").agg(F.sum(F.col("n") * F.col("times")).alias("n")))


@query("I11_open_in_list", f"WITH {REC}, {PK} SELECT event_id, count(DISTINCT accession) AS n_open, string_agg(DISTINCT CAST(accession AS VARCHAR), ',' ORDER BY CAST(accession AS VARCHAR)) AS open_in FROM rec r JOIN (SELECT * FROM pk WHERE set_id = 'purchase') p ON r.pos >= p.start AND r.pos < p.\"end\" GROUP BY event_id")
def open_in_list(spark, d):
    points = records(spark, d).select("event_id", "pos")
    counts = iv.open_counts(points, peaks(spark, d).where("set_id = 'purchase'"), "accession")
    one, several = iv.places(points, "event_id")
    files = lambda rows, key: rows.groupBy(key).agg(F.sort_array(F.collect_set(F.col("accession").cast("string"))).alias("files")).select(key, F.size("files").cast("long").alias("n_open"), F.array_join("files", ",").alias("open_in"))
    return one.join(files(counts, "pos"), "pos").select("event_id", "n_open", "open_in").unionByName(files(several.join(counts, "pos"), "event_id"))


SPLIT = f"WITH {MG}, {merged_sql('m2', chr(40) + 'SELECT * FROM pk WHERE set_id = ' + chr(39) + 'view' + chr(39) + chr(41))} "


@query("J6_midpoint_partition", SPLIT + 'SELECT start, "end", EXISTS (SELECT 1 FROM m2 WHERE floor((mg.start + mg."end") / 2) >= m2.start AND floor((mg.start + mg."end") / 2) < m2."end") AS shared FROM mg')
def midpoint_partition(spark, d):
    return iv.split_by_midpoint(merged(spark, d), merged(spark, d, "view").select("start", "end")).select("start", "end", "shared")


@query("I5_partition_invariant", f"WITH p AS ({ORACLE['J6_midpoint_partition']}) SELECT count(*) AS total, count(*) FILTER (shared) AS n_shared, count(*) FILTER (NOT shared) AS n_restricted, CAST(sum(\"end\" - start) AS BIGINT) AS bp FROM p")
def partition_invariant(spark, d):
    return midpoint_partition(spark, d).agg(F.count("*").alias("total"), F.count_if("shared").alias("n_shared"), F.count_if(~F.col("shared")).alias("n_restricted"), F.sum(F.col("end") - F.col("start")).alias("bp"))


COVER = """SELECT set_id, count(*) AS peaks, CAST(sum("end" - start) AS BIGINT) AS bp_unclipped, CAST(sum(greatest(0, least("end", {hi}) - greatest(start, {lo}))) AS BIGINT) AS bp_within_locus,
 CAST(sum("end" - start) - sum(greatest(0, least("end", {hi}) - greatest(start, {lo}))) AS BIGINT) AS overhang_bp, count(*) FILTER (start < {lo} OR "end" > {hi}) AS peaks_crossing_boundary,
 round(sum(greatest(0, least("end", {hi}) - greatest(start, {lo}))) * 100.0 / ({hi} - {lo}), 6) AS pct_of_locus FROM m WHERE "end" > {lo} AND start < {hi} GROUP BY set_id""".format(lo=LO, hi=HI)


@query("A21_clipped_coverage", f"WITH {REC}, {PK}, {merged_sql('m', 'pk')} " + COVER)
def clipped_coverage(spark, d):
    m = union_merge(spark, d).where(iv.overlaps(F.col("start"), F.col("end"), LO, HI))
    return iv.coverage(m, ["set_id"], LO, HI).withColumn("pct_of_locus", F.round("pct_of_locus", 6))


@query("A20_base_pairs", f"WITH {REC}, {PK}, {merged_sql('m', 'pk')} SELECT set_id, CAST(sum(\"end\" - start) AS BIGINT) AS bp FROM m GROUP BY set_id")
def base_pairs(spark, d):
    return union_merge(spark, d).groupBy("set_id").agg(F.sum(F.col("end") - F.col("start")).alias("bp"))


@query("P6_locus_overlap_strict", f"WITH {REC}, {PK} SELECT set_id, count(*) AS n FROM pk WHERE \"end\" > {LO} AND start < {HI} GROUP BY set_id")
def overlap_strict(spark, d):
    return peaks(spark, d).where(iv.overlaps(F.col("start"), F.col("end"), LO, HI)).groupBy("set_id").agg(F.count("*").alias("n"))


@query("P7_locus_overlap_inclusive", f"WITH {REC}, {PK} SELECT set_id, count(*) AS n FROM pk WHERE NOT (\"end\" < {LO} OR start > {HI}) GROUP BY set_id")
def overlap_inclusive(spark, d):
    return peaks(spark, d).where(iv.overlaps(F.col("start"), F.col("end"), LO, HI, inclusive=True)).groupBy("set_id").agg(F.count("*").alias("n"))


@query("I7_distance_to_interval", f"WITH {REC} SELECT event_id, greatest({LO} - pos, pos - {HI}, 0) AS distance FROM rec")
def distance_to_interval(spark, d):
    return records(spark, d).select("event_id", iv.distance(F.col("pos"), LO, HI).alias("distance"))


@query("I8_signed_distance", f"WITH {REC} SELECT event_id, pos - {LO} AS offset_to_start FROM rec")
def signed_distance(spark, d):
    return records(spark, d).select("event_id", (F.col("pos") - LO).alias("offset_to_start"))


@query("I9_centred_window", f"WITH {REC} SELECT event_id, greatest(0, pos - 8192) AS start, greatest(0, pos - 8192) + 16384 AS \"end\" FROM rec")
def centred(spark, d):
    return records(spark, d).withColumn("w", iv.centred_window(F.col("pos"), 16384)).select("event_id", "w.start", "w.end")


@query("I10_window_covers", f"WITH {REC} SELECT event_id, greatest(0, pos - 500000) <= {LO} AND greatest(0, pos - 500000) + 1000000 >= {LO} + 60000 AS covers FROM rec")
def window_covers(spark, d):
    w = records(spark, d).withColumn("w", iv.centred_window(F.col("pos"), 1_000_000))
    return w.select("event_id", ((F.col("w.start") <= LO) & (F.col("w.end") >= LO + 60000)).alias("covers"))


REACH = 500
NEAR = f"""WITH {MG} SELECT event_id, arg_min(m.start, struct_pack(d := m.d, s := m.start)) AS feature, min(m.d) AS distance FROM rec LEFT JOIN LATERAL
 (SELECT start, greatest(mg.start - rec.pos, rec.pos - mg."end", 0) AS d FROM mg WHERE greatest(mg.start - rec.pos, rec.pos - mg."end", 0) <= {REACH}) m ON true GROUP BY event_id"""


@query("J9_nearest_feature", NEAR)
def nearest_feature(spark, d):
    features = merged(spark, d).withColumn("feature", F.col("start"))
    return iv.nearest(records(spark, d).select("event_id", "pos"), features, REACH, "event_id").select("event_id", "feature", "distance")


@query("J10_window_overlap", f"WITH {MG} SELECT event_id, count(*) AS n FROM rec JOIN mg ON mg.start <= rec.pos + 100 AND mg.\"end\" >= rec.pos - 100 GROUP BY event_id")
def window_overlap(spark, d):
    wide = merged(spark, d).select((F.col("start") - 100).alias("start"), (F.col("end") + 100).alias("end"))
    return iv.hits(records(spark, d).select("event_id", "pos"), wide, BIN, inclusive=True).groupBy("event_id").agg(F.count("*").alias("n"))


@query("A25_peak_manifest", f"WITH {REC}, {PK}, raw AS (SELECT accession, count(*) AS raw_intervals FROM pk WHERE set_id = 'purchase' GROUP BY 1), {merged_sql('m', chr(40) + 'SELECT * FROM pk WHERE set_id = ' + chr(39) + 'purchase' + chr(39) + chr(41), 'accession')} SELECT accession, raw_intervals, count(*) AS merged_peaks, CAST(sum(\"end\" - start) AS BIGINT) AS merged_bp FROM m JOIN raw USING (accession) GROUP BY 1, 2")
def peak_manifest(spark, d):
    p = peaks(spark, d).where("set_id = 'purchase'")
    raw = p.groupBy("accession").agg(F.count("*").alias("raw_intervals"))
    m = iv.merge(p, ["accession"], bin_width=1 << 16).groupBy("accession").agg(F.count("*").alias("merged_peaks"), F.sum(F.col("end") - F.col("start")).alias("merged_bp"))
    return raw.join(m, "accession")


@query("J1_left_outer_null_safe", "SELECT o.o_orderkey, l.l_linenumber, l.l_quantity FROM (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') o LEFT JOIN lineitem l ON o.o_orderkey IS NOT DISTINCT FROM l.l_orderkey AND l.l_quantity > 45")
def left_outer_null_safe(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    li = table(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity")
    return o.join(li, F.col("o_orderkey").eqNullSafe(F.col("l_orderkey")), "left").select("o_orderkey", "l_linenumber", "l_quantity")
