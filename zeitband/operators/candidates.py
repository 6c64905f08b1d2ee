"""Candidate labelings of a transcript against the best one so far: overlay, guarded merge, acceptance, and labels
taken from confirmed speakers.

Rows: tid, seq, start_ms, end_ms, speaker_id, speaker_label and whatever else; (tid, seq) is a segment's key. A null or
blank speaker_id is unlabeled. ``confirmed`` has tid and speaker (a number). Rows with a null key join nothing and stay
as they are; empty tables give empty results; working columns start with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zeitband.functions.text import is_blank, speaker_name, speaker_number
from zeitband.shared import stored

from .labels import label, quality
from .scans import SPAN, carried

KEY = ["tid", "seq"]


def _labels(rows: DataFrame, name: str, blank: bool = False) -> DataFrame:
    """Each segment's id and label as one struct, null where it has none; of repeated keys one. With ``blank``, a blank id
    is one as well."""
    found = F.when(F.col("speaker_id").isNotNull() if blank else label().isNotNull(), F.struct("speaker_id", "speaker_label"))
    return rows.groupBy(*KEY).agg(F.max(found).alias(name))


def _put(rows: DataFrame, found: Column) -> DataFrame:
    """``rows`` with id and label of ``found`` where it is not null."""
    made = rows.withColumn("__put", found)
    return made.withColumns({c: F.when(F.col("__put").isNotNull(), F.col(f"__put.{c}")).otherwise(F.col(c)) for c in ("speaker_id", "speaker_label")}).drop("__put")


def overlay(raw: DataFrame, assigned: DataFrame, blank: bool = False) -> DataFrame:
    """All raw segments, with id and label of the assigned segment of the same key where that is labeled (with ``blank``:
    where it has any id)."""
    return _put(raw.join(_labels(assigned, "__best", blank), KEY, "left"), F.col("__best")).drop("__best")


def speaker_sets(best: DataFrame, candidate: DataFrame) -> DataFrame:
    """tid, and the ids that the best labeling and the candidate have; a timeline of either is there."""
    both = best.select("tid", label().alias("a"), F.lit(None).cast("string").alias("c")).unionByName(candidate.select("tid", F.lit(None).cast("string").alias("a"), label().alias("c")))
    return both.groupBy("tid").agg(F.collect_set("a").alias("best_ids"), F.collect_set("c").alias("candidate_ids"))


def merge_candidate(raw: DataFrame, best: DataFrame, candidate: DataFrame, confirmed: DataFrame, allow_new: bool = False) -> DataFrame:
    """All raw segments, labeled from the candidate and the best labeling.

    Where the best one has two speakers or more and the candidate has fewer, or brings an id that is neither among
    them nor confirmed, only ids of the best labeling are taken over, and its labels stay. Else the candidate's labels
    go before the best ones.
    """
    known = confirmed.groupBy("tid").agg(F.collect_set(F.concat(F.lit("speaker_"), F.col("speaker").cast("string"))).alias("known"))
    sets = speaker_sets(best, candidate).join(known, "tid", "left")
    several = F.size("best_ids") >= 2
    fresh = F.array_except("candidate_ids", F.array_union("best_ids", F.coalesce("known", F.array().cast("array<string>"))))
    strip = F.lit(not allow_new) & several & ((F.size("candidate_ids") < F.size("best_ids")) | (F.size(fresh) > 0))
    guards = sets.select("tid", "best_ids", strip.alias("__strip")).withColumnRenamed("best_ids", "__ids")
    rows = raw.join(_labels(candidate, "__cand"), KEY, "left").join(_labels(best, "__best"), KEY, "left").join(guards, "tid", "left")
    guarded = F.coalesce("__strip", F.lit(False))
    usable = F.when(~guarded | F.array_contains("__ids", F.col("__cand.speaker_id")), F.col("__cand"))
    return _put(rows, F.when(guarded, F.coalesce("__best", usable)).otherwise(F.coalesce(usable, "__best"))).drop("__cand", "__best", "__strip", "__ids")


def accept(best: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row for each timeline of either labeling: tid, accepted, and the rule that decided.

    Rules in order: nothing to lose; labels gone; fewer speakers than two or more; under half the labels; under half
    the labeled time; more speakers with enough labels (and, from one to two, with evidence); as many speakers and no
    fewer labels, or many more for a little less time; as many speakers and worse; anything else.
    """
    b, c = (quality(x).withColumnsRenamed({n: f"{p}_{n}" for n in ("labeled", "unlabeled", "speakers", "labeled_ms")}) for x, p in ((best, "b"), (candidate, "c")))
    both = b.join(c, "tid", "full_outer").join(new_speaker_evidence(best, candidate).select("tid", "has_evidence"), "tid", "left").fillna(0).fillna({"has_evidence": False})
    rule = _rule({k: F.col(k) for k in QUALITIES}, F.col("has_evidence"))
    return both.select("tid", (~F.startswith(rule, F.lit("-"))).alias("accepted"), F.ltrim(rule, F.lit("-")).alias("rule"))


QUALITIES = ("b_labeled", "c_labeled", "b_speakers", "c_speakers", "b_labeled_ms", "c_labeled_ms")


def _rule(n: dict[str, Column], has_evidence: Column) -> Column:
    """The rule that decides on a candidate (c) against the best labeling (b); those that refuse it begin with a dash."""
    first_two = (n["b_speakers"] == 1) & (n["c_speakers"] == 2)
    enough = F.when(first_two, (10 * n["c_labeled"] >= 5 * n["b_labeled"]) & has_evidence).otherwise(10 * n["c_labeled"] >= 7 * n["b_labeled"])
    no_worse = (n["c_labeled"] >= n["b_labeled"]) & (n["c_labeled_ms"] >= n["b_labeled_ms"])
    more = (10 * n["c_labeled"] > 12 * n["b_labeled"]) & (10 * n["c_labeled_ms"] >= 8 * n["b_labeled_ms"])
    return (
        F.when((n["b_labeled"] == 0) & (n["b_speakers"] == 0), "first")
        .when((n["b_labeled"] > 0) & (n["c_labeled"] == 0), "-labelsGone")
        .when((n["b_speakers"] >= 2) & (n["c_speakers"] < n["b_speakers"]), "-fewerSpeakers")
        .when(2 * n["c_labeled"] < n["b_labeled"], "-fewerLabels")
        .when((n["b_labeled_ms"] > 0) & (2 * n["c_labeled_ms"] < n["b_labeled_ms"]), "-lessTime")
        .when((n["c_speakers"] > n["b_speakers"]) & enough, "moreSpeakers")
        .when((n["c_speakers"] == n["b_speakers"]) & no_worse, "noWorse")
        .when((n["c_speakers"] == n["b_speakers"]) & more, "moreLabels")
        .when(n["c_speakers"] == n["b_speakers"], "-worse")
        .otherwise("other")
    )


def new_speaker_evidence(best: DataFrame, candidate: DataFrame, least: int = 2, least_ms: int = 3000) -> DataFrame:
    """tid, and of candidate segments with ids that the best labeling lacks: number, duration, and whether that is
    evidence of a new speaker. Timelines without labels in the best one, or without such segments, are left out."""
    old = best.filter(label().isNotNull()).select("tid", "speaker_id").distinct()
    fresh = candidate.filter(label().isNotNull()).join(old, ["tid", "speaker_id"], "left_anti").join(old.select("tid").distinct(), "tid", "left_semi")
    sums = fresh.groupBy("tid").agg(F.count(F.lit(1)).alias("new_segments"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("new_ms"))
    return sums.withColumn("has_evidence", (F.col("new_segments") >= least) | (F.col("new_ms") >= least_ms))


def speaker_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """tid, speaker_id and whether the speaker is new, lost or kept between two labelings."""
    a, b = (x.filter(label().isNotNull()).select("tid", "speaker_id").distinct() for x in (before, after))
    both = a.withColumn("a", F.lit(True)).join(b.withColumn("b", F.lit(True)), ["tid", "speaker_id"], "full_outer")
    return both.select("tid", "speaker_id", F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "lost").otherwise("kept").alias("state"))


def segment_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Segments that are gone or added between two lists."""
    a, b = before.select(*KEY), after.select(*KEY)
    return a.join(b, KEY, "left_anti").withColumn("state", F.lit("gone")).unionByName(b.join(a, KEY, "left_anti").withColumn("state", F.lit("added")))


def is_meaningful(before: DataFrame, after: DataFrame) -> DataFrame:
    """tid, and whether a labeling says more than the one before: new or changed labels, or more speakers."""
    none, nowhere = F.lit(None).cast("string"), F.col("tid").isNull() | F.col("seq").isNull()
    # Rows of both labelings meet without a join: where both are dealt by timeline, so they stay. Null keys meet nothing.
    side = lambda rows, a, b, n: rows.select(*KEY, a.alias("a"), b.alias("b"), F.when(nowhere, n).alias("__side"))
    both = side(before, label(), none, 1).unionByName(side(after, none, label(), 2)).groupBy(*KEY, "__side").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    number = lambda name: F.size(F.collect_set(name)).alias
    rows = both.groupBy("tid").agg(F.count_if(F.expr("a is null and b is not null")).alias("new"), F.count_if(F.expr("a <> b")).alias("changed"), number("a")("n"), number("b")("m"))
    return rows.select("tid", F.expr("new > 0 or changed > 0 or m > n").alias("meaningful"))


def _with_confirmed(rows: DataFrame, confirmed: DataFrame) -> DataFrame:
    """``rows`` with ``__sure`` (the segment's own speaker is confirmed)."""
    known = confirmed.select("tid", F.col("speaker").cast("int").alias("__n")).distinct().withColumn("__sure", F.lit(True))
    marked = rows.withColumn("__n", speaker_number(F.col("speaker_id"))).join(known, ["tid", "__n"], "left").drop("__n")
    return marked.withColumn("__sure", F.coalesce("__sure", F.lit(False)))


def _own() -> Column:
    return F.struct("seq", "speaker_id", F.coalesce("speaker_label", "speaker_id").alias("speaker_label"))


def nearest_confirmed(rows: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Segments of unconfirmed or no speakers take id and label of the confirmed segments next to them in time, if the
    last that ends by their start and the first that starts from their end on agree, or only one of both is there.

    First and last are meant in list order (seq), not in time: intervals may overlap. Both are running extremes over
    the confirmed segments' ends and starts in order of time, so no pairs are made.
    """
    marked = _with_confirmed(rows, confirmed)
    sure, open_ = marked.filter("__sure"), marked.filter("not __sure")

    def nearest(edge: str, own: str, pick: Column, order: list[Column], name: str) -> DataFrame:
        events = sure.select("tid", F.lit(None).cast("bigint").alias("at"), F.col(edge).alias("t"), F.lit(0).alias("kind"), _own().alias("s")).unionByName(open_.select("tid", F.col("seq").cast("bigint").alias("at"), F.col(own).alias("t"), F.lit(1).alias("kind"), F.lit(None).alias("s")))
        found = pick.over(Window.partitionBy("tid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        return events.withColumn(name, found).filter("kind = 1").groupBy("tid", F.col("at").alias("seq")).agg(F.max(name).alias(name))

    before = nearest("end_ms", "start_ms", F.max("s"), [F.asc("t"), F.asc("kind")], "__before")
    after = nearest("start_ms", "end_ms", F.min("s"), [F.desc("t"), F.asc("kind")], "__after")
    joined = marked.join(before, KEY, "left").join(after, KEY, "left")
    both = F.col("__before").isNotNull() & F.col("__after").isNotNull()
    found = F.when(~both | (F.col("__before.speaker_id") == F.col("__after.speaker_id")), F.coalesce("__before", "__after"))
    return _put(joined, F.when(~F.col("__sure"), found)).drop("__before", "__after", "__sure")


def leading_confirmed(rows: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Segments of unconfirmed or no speakers that end by the start of the earliest confirmed segment take its id and
    label."""
    marked = _with_confirmed(rows, confirmed)
    first = marked.filter("__sure").groupBy("tid").agg(F.min(F.struct("start_ms", "seq", "speaker_id", F.coalesce("speaker_label", "speaker_id").alias("speaker_label"))).alias("__first"))
    joined = marked.join(first, "tid", "left")
    return _put(joined, F.when(~F.col("__sure") & (F.col("end_ms") <= F.col("__first.start_ms")), F.col("__first"))).drop("__first", "__sure")


def live_renumber(rows: DataFrame, prefix: str = "Sprecher ") -> DataFrame:
    """Ids speaker_0, speaker_1, ... in the order of first segments, with their labels. A timeline of one speaker, or
    whose ids are already speaker_0 to speaker_(n-1) in any order, stays as it is, as does one without numbered ids."""
    known = label().isNotNull()
    first = rows.filter(known).groupBy("tid", "speaker_id").agg(F.min("seq").alias("__first"))
    by_speaker = Window.partitionBy("tid")
    numbered = speaker_number(F.col("speaker_id"))
    ranked = first.withColumns({"__rank": F.row_number().over(by_speaker.orderBy("__first")) - 1, "__n": F.count(F.lit(1)).over(by_speaker)})
    in_place = numbered.between(0, F.col("__n") - 1) & (F.col("speaker_id") == F.concat(F.lit("speaker_"), numbered.cast("string")))
    ranked = ranked.withColumns({"__least": F.min(numbered).over(by_speaker), "__clean": F.count_if(in_place).over(by_speaker) == F.col("__n")})
    change = ranked.filter("__n > 1 and __least is not null and not __clean").select("tid", "speaker_id", "__rank")
    put = F.when(F.col("__rank").isNotNull(), F.struct(F.concat(F.lit("speaker_"), F.col("__rank").cast("string")).alias("speaker_id"), speaker_name(F.col("__rank"), prefix).alias("speaker_label")))
    return _put(rows.join(change, ["tid", "speaker_id"], "left"), put).drop("__rank").select(*rows.columns)


def correct_by_voice(rows: DataFrame, matches: DataFrame, least_ms: int = 2000, prefix: str = "Sprecher ") -> DataFrame:
    """Numbered segments of ``least_ms`` at least take the speaker whose confirmed voice they match (``matches``: tid,
    seq, matched), where that is another one."""
    joined = rows.join(matches.select(*KEY, "matched"), KEY, "left")
    number = speaker_number(F.col("speaker_id"))
    other = number.isNotNull() & (F.col("matched") != number) & (F.col("end_ms") - F.col("start_ms") >= least_ms)
    put = F.when(other, F.struct(F.concat(F.lit("speaker_"), F.col("matched").cast("string")).alias("speaker_id"), speaker_name(F.col("matched"), prefix).alias("speaker_label")))
    return _put(joined, put).drop("matched")


def session_ids(candidate: DataFrame, existing: DataFrame, prefix: str = "Sprecher ") -> DataFrame:
    """A candidate of another run in the ids of the labeling that exists.

    Each candidate number takes the id that overlaps it most (ties: the id that its first overlapping pair meets
    first), several may take one id; without overlap, the id that a segment of the same key has; else a new number,
    from the largest there on. Where both sides have equally many speakers, two at least, and some number found no
    existing id, numbers and ids are paired in order instead (ids by first appearance). Timelines without segments or
    without labels on the other side are numbered anew in the same way; those missing there altogether stay.
    """
    from .intervals import overlaps

    numbered = candidate.withColumn("__engine", speaker_number(F.col("speaker_id")))
    engines = numbered.filter("__engine is not null").groupBy("tid", F.col("__engine").alias("engine")).agg(F.min("seq").alias("first_seq"))
    engines = engines.join(existing.select("tid").distinct(), "tid", "left_semi")
    known = existing.filter(label().isNotNull()).select("tid", F.col("seq").alias("r_seq"), "start_ms", "end_ms", F.col("speaker_id").alias("id"))
    ids = known.groupBy("tid", "id").agg(F.min("r_seq").alias("r_seq"))
    met = overlaps(numbered.filter("__engine is not null").select("tid", "seq", F.col("__engine").alias("engine"), "start_ms", "end_ms"), known, "tid")
    votes = met.groupBy("tid", "engine", "id").agg(F.sum("overlap_ms").alias("ms"), F.min(F.struct("seq", "r_seq")).alias("met"))
    voted = votes.groupBy("tid", "engine").agg(F.max_by("id", F.struct("ms", -F.col("met.seq"), -F.col("met.r_seq"))).alias("voted"))
    same = numbered.filter("__engine is not null").join(known.select("tid", F.col("r_seq").alias("seq"), "id"), KEY).groupBy("tid", F.col("__engine").alias("engine")).agg(F.min_by("id", "seq").alias("same"))
    counts = ids.groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(speaker_number(F.col("id"))) + 1, F.lit(0)).alias("free"))
    by_tid = Window.partitionBy("tid")
    found = engines.join(voted, ["tid", "engine"], "left").join(same, ["tid", "engine"], "left").join(counts, "tid", "left").fillna(0, ["n", "free"])
    found = found.withColumn("found", F.coalesce("voted", "same"))
    fresh = F.sum(F.when(F.col("found").isNull(), 1).otherwise(0)).over(by_tid.orderBy("first_seq", "engine").rowsBetween(Window.unboundedPreceding, 0)) - 1
    found = found.withColumns({"m": F.count(F.lit(1)).over(by_tid), "missing": F.count_if(F.col("found").isNull()).over(by_tid), "place": F.row_number().over(by_tid.orderBy("engine")), "made": F.coalesce("found", F.concat(F.lit("speaker_"), (F.greatest("free", "n") + fresh).cast("string")))})
    paired = found.join(ids.withColumn("place", F.row_number().over(by_tid.orderBy("r_seq"))).select("tid", "place", F.col("id").alias("nth")), ["tid", "place"], "left")
    in_order = (F.col("m") == F.col("n")) & (F.col("m") >= 2) & (F.col("missing") > 0)
    stable = paired.select("tid", F.col("engine").alias("__engine"), F.when(in_order, F.col("nth")).otherwise(F.col("made")).alias("__id"))
    put = F.when(F.col("__id").isNotNull(), F.struct(F.col("__id").alias("speaker_id"), speaker_name(F.coalesce(speaker_number(F.col("__id")), F.lit(0)), prefix).alias("speaker_label")))
    return _put(numbered.join(stable, ["tid", "__engine"], "left"), put).select(*candidate.columns)


def merge_rare_speakers(rows: DataFrame, fewest: int = 1, shortest_ms: int = 2000, span: int = SPAN) -> DataFrame:
    """Speakers with ``fewest`` segments or under ``shortest_ms`` in all become the nearest other speaker before their
    first segment, else the nearest one after it."""
    known = label().isNotNull()
    totals = rows.filter(known).groupBy("tid", "speaker_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"), F.min("seq").alias("first_seq"))
    rare = totals.filter((F.col("n") == fewest) | (F.col("ms") < shortest_ms))
    # Of labeled segments: the one before, and the next at which the speaker changes, which is another's.
    runs = rows.filter(known).select("tid", "seq", "speaker_id", "speaker_label")
    own = F.struct("speaker_id", "speaker_label")
    runs = carried(runs, "tid", ["seq"], before={"before": own}, span=span)
    changes = F.when(~F.col("before.speaker_id").eqNullSafe(F.col("speaker_id")), own)
    runs = carried(runs, "tid", ["seq"], after={"after": changes}, span=span)
    firsts = runs.join(rare.select("tid", "speaker_id", F.col("first_seq").alias("seq")), ["tid", "speaker_id", "seq"])
    merged = firsts.select("tid", "speaker_id", F.coalesce("before", "after").alias("__to"))
    named = F.coalesce("__to.speaker_label", F.concat(F.lit("Sprecher "), F.right(F.col("__to.speaker_id"), F.lit(1))))
    put = F.when(F.col("__to").isNotNull(), F.struct(F.col("__to.speaker_id").alias("speaker_id"), named.alias("speaker_label")))
    return _put(rows.join(merged, ["tid", "speaker_id"], "left"), put).drop("__to").select(*rows.columns)


def _by_speaker(sides: dict[str, DataFrame], confirmed: DataFrame) -> DataFrame:
    """tid and ``ids``: of each id of a timeline (null: unlabeled) its segments and their time on each side, and whether
    it is confirmed. A timeline's speakers are few, whatever its length."""
    rows = confirmed.select("tid", F.concat(F.lit("speaker_"), F.col("speaker").cast("string")).alias("id"), F.lit("sure").alias("side"), F.lit(0).cast("long").alias("ms"))
    for name, side in sides.items():
        rows = rows.unionByName(side.select("tid", label().alias("id"), F.lit(name).alias("side"), (F.col("end_ms") - F.col("start_ms")).cast("long").alias("ms")))
    of = lambda name: F.col("side") == name
    sums = [c for name in sides for c in (F.count_if(of(name)).alias(f"{name}_n"), F.coalesce(F.sum(F.when(of(name), F.col("ms"))), F.lit(0)).alias(f"{name}_ms"))]
    ids = rows.groupBy("tid", "id").agg(*sums, F.max(of("sure")).alias("sure"))
    return ids.groupBy("tid").agg(F.collect_list(F.struct(*ids.columns[1:])).alias("ids"))


def _verdicts(sides: dict[str, DataFrame], confirmed: DataFrame) -> DataFrame:
    """tid, and of each timeline: the ids of the best labeling (``__ids``), whether new ones are kept out (``__strip``),
    whether the candidate is accepted (``__accepted``), and if ``kept`` is among the sides, whether that is to be fallen
    back on (``__fallback``)."""
    rows = _by_speaker(sides, confirmed)
    known = F.filter("ids", lambda x: x["id"].isNotNull())
    of = lambda side: F.transform(F.filter(known, lambda x: x[f"{side}_n"] > 0), lambda x: x["id"])
    total = lambda name, among=known: F.aggregate(among, F.lit(0).cast("long"), lambda a, x: a + x[name])
    rows = rows.withColumns({"__ids": of("b"), "__new": of("c"), "__sure": F.transform(F.filter(known, lambda x: x["sure"]), lambda x: x["id"])})
    several, strange = F.size("__ids") >= 2, F.size(F.array_except("__new", F.array_union("__ids", "__sure"))) > 0
    n = {"b_labeled": total("b_n"), "c_labeled": total("c_n"), "b_speakers": F.size("__ids"), "c_speakers": F.size("__new"), "b_labeled_ms": total("b_ms"), "c_labeled_ms": total("c_ms")}
    fresh = F.filter(known, lambda x: (x["c_n"] > 0) & (x["b_n"] == 0))
    evidence = (F.size("__ids") > 0) & (F.size(fresh) > 0) & ((total("c_n", fresh) >= 2) | (total("c_ms", fresh) >= 3000))
    found = {"__strip": several & ((F.size("__new") < F.size("__ids")) | strange), "__accepted": ~F.startswith(_rule(n, evidence), F.lit("-"))}
    if "kept" in sides:
        none = total("c_n", F.col("ids")) == 0
        found["__fallback"] = none & ((total("kept_n") > total("b_n")) | (F.size(of("kept")) > F.size("__ids")))
    return rows.withColumns(found).select("tid", "__ids", *found)


def commit(raw: DataFrame, best: DataFrame, candidate: DataFrame, confirmed: DataFrame, final: bool = False, preserved: DataFrame | None = None) -> DataFrame:
    """The labeling after a candidate came, timeline by timeline: the guarded merge where the candidate says something
    new and is accepted, else the best labeling as it was. In a final run a candidate that would leave a timeline with
    fewer speakers is not taken either, and timelines that the candidate has no segment of fall back on ``preserved``
    (a labeling that was dropped when it came), where that has more labels or more speakers than the best one.

    All segments of a key stand in one wide row, with what each labeling says of them. Unions, groups and windows are by
    timeline or finer, so labelings that are dealt by timeline alike are not dealt again. The verdicts, a row a timeline,
    are written first, so that no task holds the sorts of both.
    """
    sides = {"b": best, "c": candidate} | ({"kept": preserved} if final and preserved is not None else {})
    columns = raw.columns
    wide = raw.select(*KEY, F.struct(*columns).alias("__raw"), *(F.lit(None).cast("struct<speaker_id:string,speaker_label:string>").alias(f"__{s}") for s in sides))
    for name, side in sides.items():
        keyed = side.filter(F.col("tid").isNotNull() & F.col("seq").isNotNull() & label().isNotNull())
        wide = wide.unionByName(keyed.select(*KEY, F.struct("speaker_id", "speaker_label").alias(f"__{name}")), allowMissingColumns=True)
    wide = wide.groupBy(*KEY).agg(F.collect_list("__raw").alias("__raws"), *(F.max(f"__{s}").alias(f"__{s}") for s in sides))
    met = wide.join(stored(_verdicts(sides, confirmed), "verdicts"), "tid", "left")
    guarded = F.coalesce("__strip", F.lit(False))
    usable = F.when(~guarded | F.array_contains("__ids", F.col("__c.speaker_id")), F.col("__c"))
    met = met.withColumn("__merged", F.when(guarded, F.coalesce("__b", usable)).otherwise(F.coalesce(usable, "__b"))).drop("__ids", "__strip", "__c")
    own = F.array_max(F.transform("__raws", lambda r: F.when(~is_blank(r["speaker_id"]), r["speaker_id"])))
    met = met.withColumn("__id", F.when(F.size("__raws") > 0, F.coalesce("__merged.speaker_id", own)))
    a, b, timeline = F.col("__b.speaker_id"), F.col("__id"), Window.partitionBy("tid")
    changed = F.count_if(b.isNotNull() & (a.isNull() | (a != b))).over(timeline)
    n, m = (F.size(F.collect_set(x).over(timeline)) for x in (a, b))
    met = met.withColumns({"__changed": changed, "__n": n, "__m": m})
    takes = F.col("tid").isNotNull() & F.col("__accepted") & ((F.col("__changed") > 0) | (F.col("__m") > F.col("__n")))
    rows = met.withColumn("__taken", takes & (F.col("__m") >= F.col("__n")) if final else takes).withColumn("__raw", F.explode("__raws"))
    put = F.when(F.coalesce("__taken", F.lit(False)), F.col("__merged")).otherwise(F.col("__b"))
    if "kept" in sides:
        put = F.when(F.coalesce("__fallback", F.lit(False)), F.col("__kept")).otherwise(put)
    return _put(rows.select("__raw.*", put.alias("__found")), F.col("__found")).select(*columns)


def preserve(best: DataFrame, dropped: DataFrame) -> DataFrame:
    """Of a labeling that comes too late to be committed, the timelines where it has more labels or more speakers than the
    best one: what a final run may fall back on."""
    b, d = (quality(x).select("tid", F.col("labeled").alias(f"{n}_l"), F.col("speakers").alias(f"{n}_s")) for x, n in ((best, "b"), (dropped, "d")))
    better = d.join(b, "tid", "left").filter("d_l > coalesce(b_l, 0) or d_s > coalesce(b_s, 0)")
    return dropped.join(better.select("tid"), "tid", "left_semi")


def display(raw: DataFrame, assigned: DataFrame, partial: DataFrame) -> DataFrame:
    """What is shown of each timeline: final segments under their labels, neighbours merged, and the partial text that
    is being spoken (``partial``: the columns of ``raw``), in order of start. Assigned ids count even if blank."""
    from .labels import merge_display

    shown = merge_display(overlay(raw, assigned, blank=True))
    waiting = partial.select(*[c for c in shown.columns if c != "n_merged"]).withColumn("n_merged", F.lit(0).cast("long"))
    place = F.row_number().over(Window.partitionBy("tid").orderBy("start_ms", "n_merged", "seq"))
    return shown.unionByName(waiting).withColumn("place", place.cast("long"))


def resolve_turns(turns: DataFrame, confirmed: DataFrame, matches: DataFrame, margin_ms: int = 10) -> DataFrame:
    """A session's turns after its end: speakers without a confirmed voice take the confirmed one that their longest turn
    matches (``matches``: tid, turn_seq, matched), and where that was so, neighbours of one speaker that touch become one turn."""
    from .intervals import coalesce_turns, longest_turns

    known = confirmed.select("tid", F.col("speaker").cast("bigint").alias("speaker")).distinct()
    open_ = turns.join(known, ["tid", "speaker"], "left_anti")
    found = longest_turns(open_, ["tid", "speaker"]).join(matches.select("tid", "turn_seq", "matched"), ["tid", "turn_seq"]).filter("matched is not null")
    to = found.groupBy("tid", "speaker").agg(F.min("matched").cast("bigint").alias("__to"))
    # Timelines where no speaker was matched keep their turns as they are.
    rows = turns.join(to.select("tid").distinct(), "tid", "left_semi").join(to, ["tid", "speaker"], "left").withColumn("speaker", F.coalesce("__to", "speaker")).drop("__to")
    merged = coalesce_turns(rows, margin_ms)
    rest = turns.join(to.select("tid").distinct(), "tid", "left_anti").withColumn("n_merged", F.lit(1).cast("long"))
    return merged.unionByName(rest.select(*merged.columns))
