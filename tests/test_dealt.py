"""Labelings that are dealt by timeline alike are not dealt again."""

from pyspark.sql import functions as F

from zeitband.functions.text import trimmed
from zeitband.operators import candidates as c
from zeitband.operators import labels, reports
from zeitband.plans.registry import QUERIES
from zeitband.sources.timelines import dealt_parts, parts

ROW = "tid long, seq int, start_ms long, end_ms long, speaker_id string, speaker_label string"


def labeling(spark, shift, n=40):
    rows = [(t, s, 1000 * s, 1000 * s + 900, f"speaker_{(t + s + shift) % 3}", "x") for t in range(n) for s in range(6)]
    return spark.createDataFrame(rows, ROW)


def moves(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" not in line]


def pairs(rows):
    return sorted(map(tuple, rows.collect()), key=str)


def test_meaningful_change_stays_where_it_is_dealt(spark):
    a, b = (labeling(spark, i).repartition(5, "tid") for i in (0, 1))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = c.is_meaningful(a, b)
        assert moves(found) == []
        assert found.filter("meaningful").count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_null_keys_of_two_labelings_do_not_meet(spark):
    rows = [(1, None, 0, 9, "speaker_0", "x"), (1, 1, 0, 9, "speaker_0", "x"), (None, 1, 0, 9, " ", "x")]
    a = spark.createDataFrame(rows, ROW)
    assert pairs(c.is_meaningful(a, a)) == [(1, True), (None, False)]
    assert pairs(c.is_meaningful(a.filter("seq is not null"), a.filter("seq is not null"))) == [(1, False), (None, False)]


def test_commit_moves_verdicts_alone(spark):
    best, given = (labeling(spark, i).repartition(5, "tid") for i in (0, 1))
    raw = labeling(spark, 0).withColumns({x: F.lit(None).cast("string") for x in ("speaker_id", "speaker_label")}).repartition(5, "tid")
    sure = spark.createDataFrame([(t, 0) for t in range(40)], "tid long, speaker int").repartition(5, "tid")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for final in (False, True):
            found = c.commit(raw, best, given, sure, final=final)
            assert len(moves(found)) <= 1
            assert found.count() == 240
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_enrich_stays_where_it_is_dealt(spark):
    """Short timelines: nothing moves or is written between the steps; a long one among them gives what it gives alone."""
    rows = labeling(spark, 0).withColumns({"text": F.lit(" a "), "is_final": F.col("seq") % 4 > 0}).repartition(5, "tid")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = labels.enrich(rows)
        assert moves(found) == []
        assert found.count() == 240
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    long = rows.filter("tid = 3").select(F.lit(99).cast("long").alias("tid"), *[c for c in rows.columns if c != "tid"])
    nowhere = long.withColumn("tid", F.lit(None).cast("long"))
    some = rows.filter("seq < 2").unionByName(long).unionByName(nowhere)
    assert pairs(labels.enrich(some, fewest=2, span=4, span_ms=2500)) == pairs(labels.enrich(some, fewest=2))


def test_white_space_of_any_kind(spark):
    chars = [chr(i) for i in range(1, 0x3100)]
    rows = spark.createDataFrame([(c,) for c in chars], "c string").withColumn("x", F.concat("c", "c", F.lit("a "), "c", F.lit("b\r\n"), "c"))
    assert rows.filter(~trimmed(F.col("x")).eqNullSafe(F.regexp_replace("x", r"(?U)^\s+|\s+$", ""))).count() == 0
    assert rows.filter(trimmed(F.col("c")) == "").count() == 25


def test_report_stays_where_it_is_dealt(spark):
    rows = labeling(spark, 0).withColumn("text", F.when(F.col("seq") == 2, " ").when((F.col("tid") < 39) & (F.col("tid") > 0), F.concat(F.lit("t"), "seq"))).repartition(5, "tid")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = reports.report(rows.withColumn("tid", F.when(F.col("tid") != 5, F.col("tid"))).repartition(5, "tid"), markdown=False)
        assert moves(found) == []
        got = {r["tid"]: r["report"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    length = "\nDauer: 0:05 Min · Sprecher: 3\n"
    head = f"Transkript vom 01.01.70 00:00{length}"
    assert len(got) == 40 and got[None] == head and got[0] == f"Transkript{length}"
    assert got[1] == head + "\nx 00:00:00\nt0\nt1\nt3\nt4\nt5\n"


def test_dealt_parts_are_parts(spark, tmp_path):
    """Parts that are missing or there twice; nothing moves but lines to the names of their part and to their timeline."""
    lines = [(o, n, None if n == 5 else (k + n) % 7, (k * n) % 11, float(n), 1.0, None) for k, o in enumerate([*range(30), None]) for n in range(6)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(0, "a", "b"), (1, "c", "d"), (1, "e", None), (3, None, "f"), (None, "g", "h")], "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    want = pairs(parts(spark, str(tmp_path)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for bytes_ in (before, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bytes_)
        try:
            made = dealt_parts(spark, str(tmp_path))
            assert pairs(made) == want
            assert len(moves(QUERIES["report_text"](spark, str(tmp_path)))) == (2 if bytes_ == "-1" else 1)
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
