"""Banks, chunks, matching and recognised texts: examples, plain Python over whole tables, and streams against tables."""

import difflib
import re
import struct
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from zeitband.functions import audio
from zeitband.operators import chunks, identity, metrics, utterances, voices
from zeitband.plans.labelings import local_turns, world_turns, zones
from zeitband.plans.registry import ORACLES, QUERIES
from zeitband.plans.sessions import contacts
from zeitband.shared import new_folder
from zeitband.streaming.utterances import stream_spoken
from zeitband.streaming.voices import stream_contacts

FOLDER = "/root/testdata/sf0.001"
A, B, C = np.eye(3)


# The bank.


def met(*contacts, **limits):
    """The bank after contacts (speaker, embedding, ms), and what the last one gave."""
    bank, done = {}, None
    for speaker, x, ms in contacts:
        done = voices.meet(bank, speaker, x, ms, voices.Limits(**limits))
    return bank, done


def test_first_contact_waits_and_second_confirms():
    bank, done = met((0, A, 3000))
    assert done == (None, False, 0) and bank[0].pending
    bank, done = met((0, A, 3000), (0, A, 3000))
    assert done == (0, False, 0) and bank[0].n == 2 and not bank[0].pending
    bank, done = met((0, A, 3000), (0, [0.5, 0.9, 0.9], 3000), confirm=0.36)
    assert done == (0, False, 0)


def test_long_contact_confirms_at_once_and_short_ones_do_nothing():
    bank, done = met((1, B, 4000), (2, C, 1999))
    assert done == (None, False, None) and bank.keys() == {1} and bank[1].n == 2 and not bank[1].pending
    assert met((1, B, 4000), (5, B, 1999))[1][0] is None and met((1, B, 4000), (5, B, 2000))[1] == (1, False, None)
    assert met((1, B, 4000), (1, None, 9000))[1] == (None, False, None)


def test_unlike_second_contact_replaces_the_first():
    bank, done = met((0, A, 3000), (0, B, 9000))
    assert done == (None, False, 0) and bank[0].pending and (bank[0].mean == B).all()


def test_known_voices_need_more_than_pending_ones():
    near = [0.4, 0.9, 0.0]
    assert met((0, A, 3000), (7, near, 3000))[1] == (0, False, 0)
    bank, done = met((0, A, 4000), (7, near, 3000))
    assert done == (None, False, 7) and bank[7].pending


def test_mean_weighs_all_contacts_and_ties_go_to_known_and_smaller():
    bank, done = met((0, A, 5000), (0, [1.0, 3.0, 0.0], 5000))
    assert done == (None, True, 0) and np.allclose(bank[0].mean, [1, 1, 0]) and bank[0].n == 3
    bank = {9: voices.Voice(A, 2, False), 4: voices.Voice(A, 2, False), 1: voices.Voice(A, 1, True)}
    assert voices.meet(bank, 3, A, 5000, voices.Limits())[0] == 4
    assert voices.cosines(A, [np.zeros(3), np.ones(2)]) == [0.0, 0.0]


def test_bank_over_a_table(spark):
    """Against the same rules written out over plain lists."""
    got = {(r["session"], r["seq"]): tuple(r)[2:] for r in QUERIES["bank_identify_enroll"](spark, FOLDER).collect()}
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    state, want = {}, {}
    for r in sorted(contacts(spark, FOLDER).collect(), key=lambda r: r["seq"]):
        sure, wait = state.setdefault(r["session"], ({}, {}))
        x, matched, done = np.array(r["embedding"]), None, False
        if r["ms"] >= 2000:
            scored = [(cos(x, v), 1, -i, s) for i, (s, (v, _)) in enumerate(sure.items())] + [(cos(x, v), 0, -i, s) for i, (s, v) in enumerate(wait.items())]
            top = max(scored, default=(0.0, 1, 0, None))
            if top[0] > (0.62 if top[1] else 0.35):
                matched = top[3]
                if not top[1]:
                    sure[matched] = ((wait.pop(matched) + x) / 2, 2)
            else:
                s = r["speaker"]
                if s in sure:
                    v, n = sure[s]
                    sure[s], done = ((v * n + x) / (n + 1), n + 1), True
                elif s in wait and cos(wait[s], x) >= 0.35:
                    sure[s], done = ((wait.pop(s) + x) / 2, 2), True
                elif s not in wait and r["ms"] >= 4000:
                    sure[s], done = (x, 2), True
                else:
                    wait[s] = x
        want[r["session"], r["seq"]] = (matched, done, len(sure), len(wait))
    assert got == want and any(m is not None for m, *_ in want.values()) and any(w[3] for w in want.values())


def test_nulls_and_ties_in_contacts(spark):
    rows = [(1, 2, 0, 5000, [1.0, 0.0]), (1, 1, 1, 5000, None), (1, 2, 1, 5000, [0.0, 1.0]), (2, 1, 0, 100, [1.0]), (1, 3, 7, 3000, [0.0, 1.0])]
    made = voices.identify_and_enroll(spark.createDataFrame(rows, "session long, seq long, speaker int, ms long, embedding array<double>"))
    assert sorted(tuple(r) for r in made.filter("session = 1 and seq in (1, 3)").collect()) == [(1, 1, None, False, 0, 0), (1, 3, 1, False, 2, 0)]
    assert voices.identify_and_enroll(made.limit(0).selectExpr("session", "seq", "matched as speaker", "n_pending as ms", "array(1.0D) as embedding")).count() == 0


def test_identify_has_a_threshold_for_pending_voices(spark):
    queries = spark.createDataFrame([(1, 1, [1.0, 0.9]), (1, 2, [0.4, 1.0]), (2, 3, [1.0, 0.0])], "session int, vec_id int, embedding array<double>")
    bank = spark.createDataFrame([(1, 0, [1.0, 0.0], True), (1, 1, [1.0, 0.0], False)], "session int, speaker int, voice array<double>, pending boolean")
    assert {r["vec_id"]: r["speaker"] for r in identity.identify(queries, bank).collect()} == {1: 1, 2: None, 3: None}
    assert {r["vec_id"]: r["speaker"] for r in identity.identify(queries, bank.filter("pending")).collect()} == {1: 0, 2: 0, 3: None}
    assert {r["vec_id"]: r["similarity"] for r in identity.best_confirmed(queries, bank.filter("not pending")).collect()}[3] == 0


# Matching.


def matched(own, world, zone, fragment_ms=400, aggregate_ms=2000):
    """Significant turns of a chunk, the session's number of each of its speakers, and which are new, in plain loops."""
    kept = [t for t in own if t[1] - t[0] >= fragment_ms]
    if not kept:
        for who in dict.fromkeys(t[2] for t in own):
            mine = [t for t in own if t[2] == who]
            if sum(e - s for s, e, _ in mine) >= aggregate_ms:
                kept.append((min(t[0] for t in mine), max(t[1] for t in mine), who))
    long_ = [t for t in world if t[1] - t[0] >= fragment_ms]
    votes = {}
    for s, e, a in kept:
        for ws, we, b in long_:
            ms = min(e, zone[1], we) - max(s, zone[0], ws)
            if ms > 0:
                votes[a, b] = votes.get((a, b), 0) + ms
    mapping = {}
    for (a, b), ms in sorted(votes.items(), key=lambda v: -v[1]):
        if ms >= 300 and a not in mapping and b not in mapping.values():
            mapping[a] = b
    new = [a for a in sorted({t[2] for t in kept}) if a not in mapping]
    top = max((t[2] for t in long_), default=-1)
    return kept, mapping | {a: top + 1 + i for i, a in enumerate(new)}, set(new)


def test_mapping_over_a_table(spark):
    """Fragments, votes, greedy pairs and new numbers of every timeline."""
    zone = {r["tid"]: (r["zone_start"], r["zone_end"]) for r in zones(spark, FOLDER).collect()}
    local, world = {}, {}
    for rows, into in ((local_turns(spark, FOLDER), local), (world_turns(spark, FOLDER), world)):
        for r in sorted(rows.collect(), key=lambda r: r["turn_seq"]):
            into.setdefault(r["tid"], []).append((r["start_ms"], r["end_ms"], r["speaker"]))
    want, turns = {}, set()
    for tid, own in local.items():
        kept, mapping, new = matched(own, world.get(tid, []), zone[tid], aggregate_ms=700)
        want |= {(tid, a): (b, a in new) for a, b in mapping.items()}
        turns |= {(tid, s, e, a, mapping[a]) for s, e, a in kept}
    got = {(r["tid"], r["local"]): (r["speaker"], r["is_new"]) for r in QUERIES["speaker_mapping"](spark, FOLDER).collect()}
    assert got == want and any(n for _, n in want.values()) and not all(n for _, n in want.values())
    assert {(r["tid"], r["start_ms"], r["end_ms"], r["local"], r["speaker"]) for r in QUERIES["reconcile"](spark, FOLDER).collect()} == turns


@pytest.mark.parametrize(
    ("local", "world", "want"),
    [
        ([(15_000, 17_500, 0), (17_500, 21_000, 1)], [(10_000, 17_500, 1), (17_500, 20_000, 0)], {0: (1, False), 1: (0, False)}),
        ([(15_000, 19_000, 0)], [(11_000, 15_400, 3)], {0: (3, False)}),
        ([(15_000, 19_000, 0)], [(11_000, 15_200, 3)], {0: (4, True)}),
        ([(15_000, 18_000, 0), (18_000, 20_000, 1)], [(14_000, 20_000, 7)], {0: (7, False), 1: (8, True)}),
        ([(15_000, 15_390, 0), (16_000, 19_000, 1)], [], {1: (0, True)}),
        ([(15_000 + 500 * i, 15_390 + 500 * i, 2) for i in range(6)], [], {2: (0, True)}),
        ([(15_000 + 500 * i, 15_390 + 500 * i, 2) for i in range(5)], [], {}),
    ],
)
def test_numbers_across_chunks(spark, local, world, want):
    """Permuted back; the vote's gate; the larger vote first; fragments that go, or are put together."""
    frame = lambda rows: spark.createDataFrame([(1, i, *t) for i, t in enumerate(rows)], "tid long, turn_seq long, start_ms long, end_ms long, speaker long")
    zone = spark.createDataFrame([(1, 15_000, 20_000)], "tid long, zone_start long, zone_end long")
    assert {r["local"]: (r["speaker"], r["is_new"]) for r in identity.speaker_mapping(frame(local), frame(world), zone).collect()} == want


def test_chunks_have_no_gaps(spark):
    rows = [(1, i, [float(i)] * 160) for i in range(4200)] + [(2, i, [1.0] * 160) for i in range(900)] + [(3, 0, None), (3, 1, [])]
    made = chunks.chunk_audio(spark.createDataFrame(rows, "session int, seq int, samples array<float>"))
    got = {(r["session"], r["chunk"]): (r["window_start"], r["window_end"], r["overlap_ms"], len(r["samples"]), r["samples"][0]) for r in made.collect()}
    assert got == {(1, 0): (0, 15_000, 0, 240_000, 0.0), (1, 1): (10_000, 30_000, 5000, 320_000, 1000.0), (1, 2): (25_000, 42_000, 5000, 272_000, 2500.0)}


# Texts.


def said(*texts, **rules):
    """What texts (ms, text, is final, ends the session) end, one list a text."""
    now, made, rules = None, [], utterances.Rules(**rules)
    for i, (at, text, final, *ends) in enumerate(texts):
        ended, now = rules.take(now, i, at, text, final, *ends)
        made.append(ended)
    return made, now


def test_forced_end_and_shortest_final():
    made, _ = said((0, "a", False), (0, "a", False), (6000, "a b", False), (6001, "a b c", False), (7000, " ", True), (7000, "x", True))
    assert made == [[], [], [], [(3, 0, 6001, "a b c", "longest")], [], [(5, 7000, 7100, "x", "final")]]


def test_idle_time_and_ends():
    texts = [(0, "a", False), (3000, " ", False), (9000, "a", False), (15_001, "b", False), (15_500, None, False, True)]
    made, now = said(*texts, idle_ms=6000, longest_ms=20_000)
    assert made == [[], [], [], [(0, 0, 0, "a", "idle")], [(3, 15_001, 15_001, "b", "end")]] and now is None
    assert said(*texts, longest_ms=20_000)[0][3] == []


def odd_conversations(spark, folder):
    """``folder`` with conversations whose texts begin and end with tabs, ends of lines and wide blanks, some null as are ids and turns."""
    texts = [None, "\nab", "a\nc", " \t x", "\xa0b ", "ab\n", "ab", "", "\u2028", "\u3000 \u2003", "ab\x1f", "ab", "ab"]
    rows = [(c if (c + t) % 23 else None, t if (c * t) % 29 != 5 else None, "user", texts[(c * 7 + t * t * 3 + c * t) % len(texts)]) for c in range(60) for t in range(30)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["final_utterances", "session_utterances", "stream_utterances"])
def test_utterances_of_odd_texts_like_sql(spark, tmp_path, name):
    folder, con = odd_conversations(spark, tmp_path), duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet/*.parquet'")
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    want = sorted(map(repr, found.fetchall()))
    assert want and sorted(repr(tuple(r)) for r in QUERIES[name](spark, folder).select(*columns).collect()) == want


def stream_of(spark, batches, schema):
    """A stream of one file a batch, in order."""
    path = new_folder(spark, "batches")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{i}")
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path), path


def appended(stream, state):
    """What a run to the end appends; a later run with the same ``state`` goes on."""
    spark, rows = stream.sparkSession, []
    query = stream.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda df, i: rows.extend(tuple(r) for r in df.collect())).start()
    query.awaitTermination()
    return sorted(rows, key=repr)


TEXTS = "session long, seq long, ts_ms long, text string, is_final boolean, is_end boolean"


def test_an_open_partial_is_cut_when_time_has_passed(spark):
    """Session 1 says nothing more: the texts of session 2 move the watermark. Late texts change nothing."""
    batches = [
        [(1, 1, 1000, "a", False, False), (1, 2, 2000, "a b", False, False), (2, 1, 1500, "x", False, None)],
        [(2, 2, 9500, "y", True, False)],  # the watermark is at 8.5 s after this, over 2 s + 6 s
        [(1, 3, 3000, "late", True, False), (2, 3, 10_000, "z", False, False)],
        [(2, 4, 10_500, " ", False, True), (3, 1, 10_600, "open", False, False)],
    ]
    stream, _ = stream_of(spark, batches, TEXTS)
    got = appended(stream_spoken(stream), new_folder(spark, "state"))
    # 9.5 s is over 6 s behind session 2's first text as well.
    assert got == [(1, 2, 1000, 2000, "a b", "idle"), (2, 1, 1500, 1500, "x", "idle"), (2, 2, 9500, 9600, "y", "final"), (2, 3, 10_000, 10_000, "z", "end")]
    table = spark.createDataFrame([r for b in batches for r in b if r[3] != "late"], TEXTS)
    whole = sorted((tuple(r) for r in utterances.spoken(table).collect()), key=repr)
    assert [r for r in whole if r[0] != 3] == [r if r[0] != 1 else (*r[:5], "end") for r in got] and (3, 1, 10_600, 10_600, "open", "end") in whole


def test_a_bank_goes_on_after_a_restart(spark):
    """Half the contacts, then the others in a second run on the same state: as over the whole table."""
    rows = contacts(spark, FOLDER).orderBy("seq").collect()
    schema = contacts(spark, FOLDER).schema
    stream, path = stream_of(spark, [rows[:200]], schema)
    state = new_folder(spark, "state")
    first = appended(stream_contacts(stream), state)
    spark.createDataFrame(rows[200:], schema).coalesce(1).write.parquet(f"{path}/1")
    second = appended(stream_contacts(stream), state)
    want = sorted((tuple(r) for r in voices.identify_and_enroll(contacts(spark, FOLDER)).collect()), key=repr)
    assert len(first) == 200 and sorted(first + second, key=repr) == want


def test_a_bank_begins_with_stored_voices(spark):
    schema = "session long, seq long, speaker int, ms long, embedding array<double>"
    bank = spark.createDataFrame([(1, 5, [1.0, 0.0], 3, False), (1, 6, [0.0, 1.0], 1, True), (2, 7, [1.0, 1.0], 2, False)], "session long, speaker int, mean array<double>, n long, pending boolean")
    stream, _ = stream_of(spark, [[(1, 1, 0, 3000, [0.1, 1.0]), (1, 2, 0, 3000, [1.0, 0.1]), (3, 1, 0, 3000, [1.0, 0.0])]], schema)
    assert appended(stream_contacts(stream, bank=bank), new_folder(spark, "state")) == [(1, 1, 6, False, 2, 0), (1, 2, 5, False, 2, 0), (3, 1, None, False, 0, 1)]


@pytest.mark.parametrize("name", ["stream_bank", "stream_utterances"])
def test_stream_queries_like_tables(spark, name):
    table = {"stream_bank": "bank_identify_enroll", "stream_utterances": "session_utterances"}[name]
    want = sorted((tuple(r) for r in QUERIES[table](spark, FOLDER).collect()), key=repr)
    assert want and sorted((tuple(r) for r in QUERIES[name](spark, FOLDER).collect()), key=repr) == want


def test_word_differences(spark):
    rows = [(1, "Der Hund, er läuft!", "der hund läuft schnell"), (2, "a b c", "a x c"), (3, None, "neu"), (4, "a", None), (5, "", "")]
    made = {r["id"]: r for r in metrics.word_differences(spark.createDataFrame(rows, "id int, reference string, hypothesis string")).collect()}
    assert (made[1]["replaced"], made[1]["deleted"], made[1]["inserted"], made[1]["error_rate"]) == (0, 1, 1, 0.5)
    assert made[2]["replaced_rate"] == round(1 / 3, 6) and made[3]["error_rate"] is None and made[4]["deleted"] == 1 and made[5]["ratio"] == 1
    norm = lambda t: re.sub(r"[^a-zäöüß0-9\s]", " ", (t or "").lower()).split()
    for i, a, b in rows:
        assert made[i]["ratio"] == round(difflib.SequenceMatcher(None, norm(a), norm(b)).ratio(), 6)


# Audio.


def test_normalized_audio():
    quiet = np.tile([0.0005, -0.0005], 800).astype(np.float32) + np.float32(0.05)
    assert np.allclose(np.abs(audio.normalized(quiet)), 0.005, atol=1e-5)
    loud = np.tile([0.2, -0.2], 800).astype(np.float32)
    assert np.allclose(audio.normalized(loud), loud, atol=1e-6)
    peaky = np.zeros(1600, np.float32)
    peaky[::100] = 0.5
    assert np.abs(audio.normalized(peaky)).max() <= 0.99 and len(audio.normalized(np.zeros(0))) == 0
    assert not audio.normalized(np.full(100, 0.3, np.float32)).any()


def test_wav_files(spark, tmp_path):
    x = np.array([0.0, 1.0, -1.0, 0.5, 2.0], np.float32)
    raw = audio.wav_bytes(np.tile(x, 3200))
    assert raw[:4] == b"RIFF" and struct.unpack("<I", raw[40:44])[0] == len(raw) - 44 == 32_000
    assert audio.wav_samples(raw)[:5].tolist() == [0.0, 32767 / 32768, -32767 / 32768, 16383 / 32768, 32767 / 32768]
    assert len(audio.wav_range(raw, 250, 500)) == 4000
    assert audio.wav_range(raw, 500, 500) is None and audio.wav_range(raw, 900, 1100) is None and audio.wav_range(raw, 0, 61_000) is None
    with pytest.raises(ValueError):
        audio.wav_samples(audio.wav_bytes(x, rate=8000))
    (tmp_path / "a.wav").write_bytes(raw)
    rows = spark.read.format("binaryFile").load(str(tmp_path)).select(audio.decode_wav("content").alias("all"), audio.decode_wav_range("content", F.lit(0), F.lit(100)).alias("some"), audio.decode_wav_range("content", F.lit(0), F.lit(0)).alias("none"))
    r = rows.first()
    assert len(r["all"]) == 16_000 and len(r["some"]) == 1600 and r["none"] is None
    back = spark.createDataFrame([([0.5, -0.25],), (None,), ([],)], "x array<float>").select(audio.decode_pcm(audio.encode_pcm("x")).alias("x")).collect()
    assert [r["x"] for r in back] == [[16383 / 32768, -8191 / 32768], None, []]
