"""Nulls, ties, repeated rows, clashing names and empty tables in the timeline operators; folds in plain Python."""

import pytest
from pyspark.sql import functions as F

from zeitband.functions.audio import normalized
from zeitband.operators import candidates, dedupe, identity, intervals, labels, metrics, reports, splitting, store
from zeitband.plans.registry import QUERIES
from zeitband.plans.sessions import frames
from zeitband.sources.timelines import parts, segments

FOLDER = "/root/testdata/sf0.001"
SEGMENT = "tid long, seq long, segment_id string, start_ms long, end_ms long, text string, speaker_id string, speaker_label string, is_final boolean, is_new boolean"
ROWS = [
    (1, 1, "a", 0, 900, "eins", None, None, True, False),
    (1, 2, "b", 1000, 2000, "zwei drei", "speaker_0", "Sprecher 1", True, True),
    (1, 2, "b", 1000, 2000, "zwei drei", "speaker_0", "Sprecher 1", True, True),
    (1, 3, "c", 2000, 2000, None, " ", None, True, False),
    (1, 4, "d", 2100, 9000, "vier", "gast", "Gast", False, False),
    (2, 1, "e", 0, 0, "", "speaker_1", None, True, False),
    (None, 1, "f", 0, 1000, "x", "speaker_0", None, True, False),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SEGMENT)


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(1, 1, 500, 2500, 0), (1, 2, 2500, 2400, 1), (1, 3, 2500, 8000, 1), (None, 1, 0, 900, 0)], "tid long, turn_seq long, start_ms long, end_ms long, speaker long")


@pytest.fixture(scope="module")
def confirmed(spark):
    return spark.createDataFrame([(1, 0), (1, 0), (None, 0)], "tid long, speaker long")


ON_ROWS = {
    "smooth_islands": labels.smooth_islands,
    "fill_between": labels.fill_between,
    "inherit_tiny": labels.inherit_tiny,
    "fill_nearest": labels.fill_nearest,
    "fill_leading": labels.fill_leading,
    "renumber": labels.renumber,
    "name_by_appearance": labels.name_by_appearance,
    "live_renumber": candidates.live_renumber,
    "merge_rare_speakers": candidates.merge_rare_speakers,
    "saved_segments": reports.saved_segments,
}
REDUCING = {
    "merge_history": labels.merge_history,
    "merge_display": labels.merge_display,
    "compact_tiny": labels.compact_tiny,
    "enrich": labels.enrich,
    "quality": labels.quality,
    "dedupe_texts": dedupe.dedupe_texts,
    "stage_metrics": metrics.stage_metrics,
    "summaries": reports.summaries,
    "report": lambda r: reports.report(r, markdown=True),
}


@pytest.mark.parametrize("name", [*ON_ROWS, *REDUCING])
def test_rows_with_nulls_ties_and_other_columns(rows, name):
    f = {**ON_ROWS, **REDUCING}[name]
    plain = f(rows)
    want = sorted(map(repr, (tuple(r) for r in plain.collect())))
    assert name in REDUCING or len(want) == len(ROWS)
    clashing = rows.withColumns({c: F.lit("own") for c in ("first", "rank", "block", "label", "gap", "bucket", "n", "place")})
    assert sorted(map(repr, (tuple(r) for r in f(clashing).select(*plain.columns).collect()))) == want
    assert f(rows.limit(0)).collect() == []


TWO = {
    "overlay": lambda r, t, c: candidates.overlay(r, r),
    "merge_candidate": lambda r, t, c: candidates.merge_candidate(r, r, r, c),
    "commit": lambda r, t, c: candidates.commit(r, r, r, c, final=True),
    "accept": lambda r, t, c: candidates.accept(r, r),
    "nearest_confirmed": lambda r, t, c: candidates.nearest_confirmed(r, c),
    "leading_confirmed": lambda r, t, c: candidates.leading_confirmed(r, c),
    "session_ids": lambda r, t, c: candidates.session_ids(r, r),
    "assign_speakers": lambda r, t, c: intervals.assign_speakers(r, t),
    "split_long": lambda r, t, c: splitting.split_long(r.drop("segment_id", "speaker_label", "is_final", "is_new"), t),
    "coverage": lambda r, t, c: metrics.coverage(r, t),
    "mapping": lambda r, t, c: identity.speaker_mapping(t, t, r.selectExpr("tid", "0 as zone_start", "5000 as zone_end").distinct()),
}


@pytest.mark.parametrize("name", TWO)
def test_two_tables(rows, turns, confirmed, name):
    made = TWO[name](rows, turns, confirmed)
    n = made.count()
    assert n >= len(ROWS) or name in ("accept", "coverage", "mapping")
    assert TWO[name](rows.limit(0), turns.limit(0), confirmed.limit(0)).count() == 0
    assert TWO[name](rows, turns.limit(0), confirmed.limit(0)).count() >= 0


def test_timelines_without_turns_keep_their_labels(rows, turns):
    made = intervals.assign_speakers(rows, turns)
    got = {(r["tid"], r["seq"]): (r["reason"], r["speaker_id"]) for r in made.collect()}
    assert got[2, 1] == ("noTurns", "speaker_1") and got[1, 2] == ("label", "speaker_0") and got[1, 4] == ("label", "speaker_1")


def test_nearest_confirmed_goes_by_list_order(spark, confirmed):
    """Of overlapping confirmed segments the later in the list is the one before, not the one that ends last."""
    made = [(1, 1, 0, 5000, "speaker_0", "A"), (1, 2, 100, 900, "speaker_2", "C"), (1, 3, 6000, 7000, None, None), (1, 4, 8000, 9000, "speaker_0", "A")]
    rows = spark.createDataFrame(made, "tid long, seq long, start_ms long, end_ms long, speaker_id string, speaker_label string")
    sure = spark.createDataFrame([(1, 0), (1, 2)], "tid long, speaker long")
    assert candidates.nearest_confirmed(rows, sure).filter("seq = 3").first()["speaker_id"] is None
    assert candidates.nearest_confirmed(rows, confirmed).filter("seq = 3").first()["speaker_label"] == "A"


def test_zone_margin(spark):
    kept = spark.createDataFrame([(1, 1, 0, 4985, 0), (1, 2, 0, 4995, 0), (1, 3, 4000, 6000, 1), (1, 4, 5000, 6000, 1), (2, 5, 0, 9000, 1)], "tid long, turn_seq long, start_ms long, end_ms long, speaker long")
    zones = spark.createDataFrame([(1, 5000, 10_000)], "tid long, zone_start long, zone_end long")
    got = {r["turn_seq"]: r["end_ms"] for r in intervals.replace_interval(kept, kept.limit(0), zones).collect()}
    assert got == {1: 4985, 2: 5000, 3: 5000, 5: 9000}


def test_upsert_of_null_and_tied_keys(spark):
    old = spark.createDataFrame([(None, 1, "a"), (1, 1, "b"), (2, 1, "c")], "k long, o long, v string")
    new = spark.createDataFrame([(None, 5, "x"), (1, 5, "y"), (1, 5, "z"), (1, 4, "zz")], "k long, o long, v string")
    assert {(r["k"], r["v"]) for r in store.upsert(old, new, ["k"], "o").collect()} == {(None, "x"), (1, "z"), (2, "c")}
    assert store.upsert(old.limit(0), new.limit(0), ["k"], "o").count() == 0


def test_broken_documents_and_defaults(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"transcript_id": "a", "segments": [{"segment_id": "s", "seq": 0, "start_ms": 1, "end_ms": 2, "text": "t", "speaker_id": null}]}\n{"broken": \n')
    (tmp_path / "b.json").write_text('{"title": "no id"}\n')
    docs = store.scan_documents(spark, str(tmp_path))
    r = docs.collect()
    assert len(r) == 1 and (r[0]["title"], r[0]["language"], r[0]["status"], r[0]["speaker_count"]) == ("", "de", "finalized", 0) and r[0]["created_at"] > 0
    s = store.document_segments(docs).collect()
    assert len(s) == 1 and s[0]["speaker_id"] is None


def test_dedupe_over_a_table(spark):
    """The fold, written again with another search for the overlap."""
    want = []
    table = segments(spark, FOLDER).collect()
    by = {}
    for r in sorted(table, key=lambda r: (r["tid"], r["seq"])):
        done = by.setdefault(r["tid"], [])
        last = done[-1] if done else None
        text, merged = r["text"], None
        if last and 1 <= r["start_ms"] - last[1] <= 59_999:
            a, b = last[3].split(), text.split()
            la, lb = [w.lower() for w in a], [w.lower() for w in b]
            k = max([k for k in range(2, min(len(a), len(b)) + 1) if la[len(a) - k :] == lb[:k]], default=0)
            common = 0
            while common < min(len(a), len(b)) and la[common] == lb[common]:
                common += 1
            longer = b if len(b) > len(a) else a
            if r["end_ms"] - r["start_ms"] < 500 and len(b) < 2 and r["start_ms"] - last[2] < 1500:
                merged = a + b
            elif k:
                merged = b if k == len(a) and len(b) > k else a + b[k:]
            elif common >= 3 or " ".join(la) in " ".join(lb) or " ".join(lb) in " ".join(la):
                merged = longer
        if merged is None:
            done.append([r["seq"], r["start_ms"], r["end_ms"], text, 1])
        else:
            last[2:] = [max(last[2], r["end_ms"]), " ".join(merged), last[4] + 1]
    want = sorted((t, *x) for t, done in by.items() for x in done)
    got = sorted((r["tid"], r["seq"], r["start_ms"], r["end_ms"], r["text"], r["n_merged"]) for r in QUERIES["dedupe_texts"](spark, FOLDER).collect())
    assert got == want and len(got) < len(table)


def test_enrich_is_its_steps(spark):
    """The chain over one list after the other, in plain Python."""
    by = {}
    for r in sorted((r.asDict() for r in parts(spark, FOLDER).collect()), key=lambda r: (r["tid"], r["seq"])):
        by.setdefault(r["tid"], []).append(r)
    named = lambda r: r["speaker_id"] if (r["speaker_id"] or "").strip() else None
    length = lambda r: r["end_ms"] - r["start_ms"]
    words = lambda r: max(1, len((r["text"] or "").split()))
    want = []
    for tid, rows in by.items():
        if len(rows) >= 3:
            for step in ("island", "between", "tiny"):
                ids = [named(r) for r in rows]
                made = [r["speaker_id"] for r in rows]
                for i, r in enumerate(rows):
                    left, right = (ids[i - 1] if i else None), (ids[i + 1] if i + 1 < len(rows) else None)
                    if step == "island" and left and left == right and ids[i] and ids[i] != left and length(r) <= 2000 and words(r) <= 3:
                        if ids.count(ids[i]) > 1 and 3 * length(r) <= max(length(rows[i - 1]), length(rows[i + 1])):
                            made[i] = left
                    if step == "between" and not ids[i] and left and left == right and (length(r) <= 2000 or words(r) <= 3):
                        made[i] = left
                    if step == "tiny" and not ids[i] and (length(r) <= 800 or len((r["text"] or "").strip()) <= 3):
                        near_left = left if i and 0 <= r["start_ms"] - rows[i - 1]["end_ms"] <= 500 else None
                        near_right = right if i + 1 < len(rows) and 0 <= rows[i + 1]["start_ms"] - r["end_ms"] <= 500 else None
                        made[i] = near_left or near_right or made[i]
                rows = [r | {"speaker_id": m} for r, m in zip(rows, made)]
            done = []
            for r in sorted(rows, key=lambda r: (r["start_ms"], r["seq"])):
                last = done[-1] if done else None
                if last and last["is_final"] and r["is_final"] and named(last) and named(last) == named(r) and 0 <= r["start_ms"] - last["end_ms"] <= 1200:
                    last |= {"end_ms": max(last["end_ms"], r["end_ms"]), "text": f"{last['text'].strip()} {r['text'].strip()}".strip(), "is_final": True}
                else:
                    done.append(dict(r))
            order = {}
            for r in sorted(done, key=lambda r: r["seq"]):
                if named(r):
                    r["speaker_label"] = f"Sprecher {order.setdefault(named(r), len(order) + 1)}"
            rows = done
        want += [(tid, r["seq"], r["start_ms"], r["end_ms"], r["speaker_id"], r["speaker_label"], r["text"]) for r in rows]
    got = [tuple(r) for r in QUERIES["enrich"](spark, FOLDER).select("tid", "seq", "start_ms", "end_ms", "speaker_id", "speaker_label", "text").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_display_holds_partials(spark):
    rows = QUERIES["display"](spark, FOLDER).collect()
    waiting = {(r["tid"], r["seq"]) for r in parts(spark, FOLDER).filter("not is_final").collect()}
    assert {(r["tid"], r["seq"]) for r in rows if not r["n_merged"]} == waiting
    by = {}
    for r in rows:
        by.setdefault(r["tid"], []).append(r)
    for x in by.values():
        x.sort(key=lambda r: r["place"])
        assert [r["place"] for r in x] == list(range(1, len(x) + 1)) and [r["start_ms"] for r in x] == sorted(r["start_ms"] for r in x)


def test_normalized_levels_over_a_table(spark):
    want = {(r["session"], r["seq"]): normalized(r["samples"]) for r in frames(spark, FOLDER).collect()}
    for r in QUERIES["normalized_levels"](spark, FOLDER).collect():
        assert r["rms"] == pytest.approx(float((want[r["session"], r["seq"]].astype("float64") ** 2).mean() ** 0.5), abs=6e-5)


def test_wav_sources(spark):
    from zeitband.shared import new_folder
    from zeitband.sources.audio import read_wav_ranges, read_wavs, write_wavs

    path = new_folder(spark, "wavs")
    rows = spark.createDataFrame([("a", [0.5] * 16_000), ("b", [0.25] * 800), ("c", None)], "name string, samples array<float>")
    assert {tuple(r) for r in write_wavs(rows, path).collect()} == {("a", 32_044), ("b", 1644)}
    assert {r["name"]: len(r["samples"]) for r in read_wavs(spark, path).collect()} == {"a.wav": 16_000, "b.wav": 800}
    ranges = spark.createDataFrame([("a.wav", 100, 200), ("b.wav", 0, 51), ("z.wav", 0, 1)], "name string, start_ms long, end_ms long")
    assert {(r["name"], None if r["samples"] is None else len(r["samples"])) for r in read_wav_ranges(spark, path, ranges).collect()} == {("a.wav", 1600), ("b.wav", None)}
