"""Text segments and speaker turns of conversation timelines, derived from order lines: one timeline per order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Common table expressions, valid in Spark SQL and DuckDB; ``{lineitem}`` and ``{part}`` name the tables.
VIEWS = """
with b as (
 select l_orderkey as tid, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as seq,
  cast(l_quantity * 100 as bigint) as dur, (l_partkey % 20) * 100 as gap, l_partkey, l_suppkey from {lineitem}),
base as (
 select tid, seq, l_suppkey, l_partkey, dur, cast(sum(dur + gap) over (partition by tid order by seq rows between unbounded preceding and current row) as bigint) as end_ms from b),
v_seg as (
 select tid, seq, end_ms - dur as start_ms, end_ms, case when l_suppkey % 5 = 0 then null else concat('speaker_', cast(l_suppkey % 3 as string)) end as speaker_id,
  concat(p_name, ' ', p_type) as text from base left join {part} on p_partkey = l_partkey),
v_part as (
 select tid, seq, concat(cast(tid as string), '-', cast(seq as string)) as segment_id, greatest(end_ms - dur - (l_suppkey % 4) * 300, 0) as start_ms, end_ms,
  case when l_partkey % 13 = 0 then '  ' when l_partkey % 5 = 0 then concat('  ', p_name, ' ') else concat(p_name, ' ', p_type) end as text,
  case when l_suppkey % 5 = 0 then null when l_suppkey % 11 = 0 then ' ' else concat('speaker_', cast(l_suppkey % 3 + tid % 2 as string)) end as speaker_id,
  case when l_suppkey % 5 = 0 or l_suppkey % 11 = 0 then null when l_partkey % 7 = 0 then 'Sprecher 1' else concat('Sprecher ', cast(l_suppkey % 3 + tid % 2 + 1 as string)) end as speaker_label,
  l_partkey % 11 <> 0 as is_final, l_suppkey % 6 = 0 as is_new
 from base left join {part} on p_partkey = l_partkey),
v_cand as (
 select tid, seq, start_ms, end_ms, case when seq % 4 = 1 or tid % 6 = 0 then null else concat('speaker_', cast((seq + tid) % (1 + tid % 4) as string)) end as speaker_id,
  case when seq % 4 = 1 or tid % 6 = 0 then null else concat('Stimme ', cast((seq + tid) % (1 + tid % 4) as string)) end as speaker_label from v_part where (tid + seq) % 9 <> 0),
v_conf as (select distinct tid, l_suppkey % 3 as speaker from base where l_suppkey % 3 <> tid % 3 and tid % 7 <> 0),
v_turn as (
 select tid, seq as turn_seq, end_ms - dur + ((l_suppkey % 7) - 3) * 400 as start_ms, end_ms + ((l_partkey % 5) - 2) * 400 as end_ms, l_suppkey % 3 as speaker
 from base where l_partkey % 4 <> 0 and end_ms + ((l_partkey % 5) - 2) * 400 > end_ms - dur + ((l_suppkey % 7) - 3) * 400)
"""


#: Rows in a partition of timelines. Spark would size partitions by compressed bytes, of which sorts make twenty times as
#: much in memory.
PARTITION_ROWS = 250_000


def by_timeline(rows: DataFrame, key: str, count: int) -> DataFrame:
    """``rows``, of which there are ``count``, dealt by timeline to as many partitions as they need; windows and groups of
    timelines are made in these."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // PARTITION_ROWS)), key)


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    dealt = by_timeline(lines, "l_orderkey", lines.count())
    return spark.sql(VIEWS + f"select * from {name}", lineitem=dealt, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


#: The views over lines that bring the names of their part with them.
NAMED = VIEWS.replace("l_suppkey from {lineitem}", "l_suppkey, names from {lineitem}").replace("l_partkey, dur, cast(sum", "l_partkey, dur, names, cast(sum")
NAMED = NAMED.replace("left join {part} on p_partkey = l_partkey", "lateral view outer inline(names) p as p_name, p_type")


def dealt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``parts``, and dealt by timeline: names are joined first, so that texts move once, and windows and groups of
    timelines are made where they lie. For what needs texts; they move further than lines alone do."""
    lines, part = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    names = part.groupBy("p_partkey").agg(F.collect_list(F.struct("p_name", "p_type")).alias("names"))
    named = lines.join(names, F.col("l_partkey") == F.col("p_partkey"), "left")
    return spark.sql(NAMED + "select * from v_part", lineitem=by_timeline(named, "l_orderkey", lines.count()))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tid, seq, segment_id, start_ms, end_ms, text, speaker_id and speaker_label (null or blank: unlabeled), is_final and
    is_new; neighbours may overlap."""
    return _view(spark, sf_dir, "v_part")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another labeling of most of ``parts``: tid, seq, start_ms, end_ms, speaker_id, speaker_label."""
    return _view(spark, sf_dir, "v_cand")


def confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tid and speaker of confirmed speakers."""
    return _view(spark, sf_dir, "v_conf")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tid, seq, start_ms, end_ms, speaker_id (null: unlabeled) and text."""
    return _view(spark, sf_dir, "v_seg")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tid, turn_seq, start_ms, end_ms and speaker."""
    return _view(spark, sf_dir, "v_turn")


RECOGNISED = "name string, segments array<struct<start:double,end:double,text:string>>"


def recognised(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The segments that a recogniser wrote as JSON, one document a line, or with ``multi_line`` one a file: name (the
    document's, else the file's), seq (from 1), start_ms, end_ms (from seconds) and text. Broken documents and those
    without segments give none; a segment without a start begins at 0, and without an end lasts no time."""
    rows = spark.read.schema(RECOGNISED).option("multiLine", multi_line).option("mode", "DROPMALFORMED").json(path)
    name = F.coalesce("name", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))
    each = rows.select(name.alias("name"), F.posexplode("segments").alias("i", "s"))
    ms = lambda c: F.round(c * 1000).cast("long")
    start = F.coalesce(ms(F.col("s.start")), F.lit(0))
    return each.select("name", (F.col("i") + 1).alias("seq"), start.alias("start_ms"), F.coalesce(ms(F.col("s.end")), start).alias("end_ms"), F.col("s.text").alias("text"))
