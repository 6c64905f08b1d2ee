"""Quality rules by host, in DataFrame functions alone.

Each document is measured once and the measures are written; rule failures are summed by host (``source``), each
host's failure rate is shrunk towards the rate of all hosts by a beta prior that the hosts' own rates give (method
of moments), and the verdicts are joined back. A document is kept unless

* it fails a base rule (under 50 words, or over half its words in repeated three-word windows), or
* its host is bad (shrunk rate above ``reject_rate``) and the document itself fails a softer rule (symbols, repeated
  lines, odd word lengths), or
* its host is hopeless (shrunk rate above ``block_rate``).

Defined cases: a null text has no words and fails; documents with a null host form one host of their own; repeated
rows count each; an empty table gives an empty result. Names of working columns start with two underscores and
``zb``; a table with a column of such a name is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A host table of up to so many rows (well under 10 MB) is broadcast; a larger one is joined with salted keys.
BROADCAST_HOSTS = 100_000
SALTS = 64
BLANKS = " \t\n\x0b\x0c\r"
MEASURES = ("__zb_words", "__zb_chars", "__zb_symbols", "__zb_dup", "__zb_repeat", "__zb_lines")


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the six measures of each text, all computed inside the row."""
    if taken := [c for c in docs.columns if c.startswith("__zb")]:
        raise ValueError(f"columns {taken} have names kept for working columns")
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " ", -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    cut = docs.withColumns({"__zb_w": words, "__zb_l": lines, "__zb_solid": F.length(F.translate(text, BLANKS, "")), "__zb_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long")})
    # Three-word windows; the last two positions have none.
    windows = F.transform("__zb_w", lambda w, i: F.concat(w, F.lit(" "), F.get("__zb_w", i + 1), F.lit(" "), F.get("__zb_w", i + 2)))
    cut = cut.withColumns({"__zb_g": windows, "__zb_words": F.size("__zb_w").cast("long"), "__zb_lines": F.size("__zb_l").cast("long"), "__zb_dup": (F.size("__zb_l") - F.size(F.array_distinct("__zb_l"))).cast("long"), "__zb_chars": F.col("__zb_solid").cast("long")})
    # Windows found twice stand side by side once sorted; texts whose windows all differ skip the sort.
    once = F.size(F.array_distinct("__zb_g")) >= F.size("__zb_g") - F.when(F.size("__zb_g") >= 2, 1).otherwise(0)
    sorted_ = F.when(once, F.lit(None)).otherwise(F.sort_array(F.filter(F.transform("__zb_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))), lambda x: x["g"].isNotNull())))
    cut = cut.withColumn("__zb_s", sorted_)
    s = F.col("__zb_s")
    same = lambda x, k: F.coalesce(F.get(s, k)["g"] == x["g"], F.lit(False))
    twice = F.filter(F.transform(s, lambda x, k: F.when(same(x, k + 1) | (F.when(k > 0, same(x, k - 1)).otherwise(False)), x["i"])), lambda p: p.isNotNull())
    cut = cut.withColumn("__zb_p", twice)
    covered = F.array_distinct(F.flatten(F.transform("__zb_p", lambda p: F.array(p, p + 1, p + 2))))
    repeat = F.when(F.col("__zb_p").isNull(), 0).otherwise(F.size(covered)).cast("long")
    return cut.withColumn("__zb_repeat", repeat).select(*docs.columns, *MEASURES)


def base_failed() -> Column:
    return (F.col("__zb_words") < 50) | (100 * F.col("__zb_repeat") > 50 * F.col("__zb_words"))


def soft_failed() -> Column:
    """Over a tenth symbols, over 30 % repeated lines, or a mean word length outside 2 to 20."""
    return (10 * F.col("__zb_symbols") > F.col("__zb_chars")) | (10 * F.col("__zb_dup") > 3 * F.col("__zb_lines")) | (F.col("__zb_chars") < 2 * F.col("__zb_words")) | (F.col("__zb_chars") > 20 * F.col("__zb_words"))


def host_key(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit("\x00"))


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """One row per host: documents, failures, and the rate of failure shrunk by the empirical beta prior.

    With m and v the mean and variance of the hosts' raw rates, the prior has weight k = m(1-m)/v - 1, held between
    1 and 10,000, and the shrunk rate is (failures + k m) / (documents + k). The prior is one row, read by the driver.
    """
    failed = (base_failed() | soft_failed()).cast("long")
    hosts = measured.groupBy(host_key(host).alias("__zb_host")).agg(F.count(F.lit(1)).alias("__zb_n"), F.sum(failed).alias("__zb_f"))
    hosts = materialize(hosts, "hosts")
    rate = F.col("__zb_f") / F.col("__zb_n")
    m, v = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    m = m or 0.0
    k = min(10_000.0, max(1.0, m * (1 - m) / v - 1)) if v else 10_000.0
    return hosts.withColumn("__zb_rate", (F.col("__zb_f") + F.lit(k * m)) / (F.col("__zb_n") + F.lit(k)))


def judge(measured: DataFrame, host: str = "source", reject_rate: float = 0.5, block_rate: float = 0.9) -> DataFrame:
    """A measured table with ``__zb_kept``. The table is written once and read twice: for the hosts, and for the
    verdicts on its rows."""
    written = materialize(measured, "measured")
    hosts = host_rates(written, host).select("__zb_host", "__zb_rate")
    rows = written.withColumn("__zb_host", host_key(host))
    if hosts.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(hosts), "__zb_host")
    else:
        salted = hosts.withColumn("__zb_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("__zb_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["__zb_host", "__zb_salt"])
    bad = (F.col("__zb_rate") > reject_rate) & soft_failed() | (F.col("__zb_rate") > block_rate)
    return joined.withColumn("__zb_kept", ~base_failed() & ~bad)


def quality_report(docs: DataFrame, host: str = "source", reject_rate: float = 0.5, block_rate: float = 0.9) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept of each document.
    Texts are measured and dropped before anything is written."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    thin = measure(docs.select("doc_id", "text", F.col(host).alias("host"))).drop("text")
    shown = [F.col(c).alias(n) for c, n in zip(MEASURES, names, strict=False)]
    return judge(thin, "host", reject_rate, block_rate).select("doc_id", *shown, base_failed().alias("base_failed"), F.col("__zb_kept").alias("kept"))


def keep_good(docs: DataFrame, host: str = "source", reject_rate: float = 0.5, block_rate: float = 0.9) -> DataFrame:
    """The documents that pass, with the columns of ``docs``."""
    return judge(measure(docs), host, reject_rate, block_rate).filter("__zb_kept").select(*docs.columns)
