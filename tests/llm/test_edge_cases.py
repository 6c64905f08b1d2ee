"""Empty tables, columns with clashing names, nulls, repeated and tied rows, for all ten operators."""

import glob

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from zeitband.llm import decontaminate, host_rules, jaccard, language_id, packing, repeats, secrets, token_counts, token_files, warc
from zeitband.shared import new_folder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
ROWS = [
    (1, LONG, "en", "a", len(LONG)),
    (2, LONG, "en", "a", len(LONG)),
    (2, LONG, "en", "a", len(LONG)),
    (3, None, None, None, None),
    (4, "", "en", None, 0),
    (None, LONG + " more", "en", "b", 10),
    (None, None, None, "b", None),
    (5, " \t\n", None, "b", 3),
    (6, "wort " * 50_000, "de", "b", 250_000),
]
#: Names that the operators use for columns of their own.
CLASHING = ("class", "packed", "chunk", "n", "key", "task", "nth", "tokens", "host", "label", "rep", "salt", "left", "spans", "length", "start", "item", "shard", "payload", "held_out", "file", "position", "component_id", "score", "DOC_ID_")


def clash(df):
    return df.withColumns({name: F.lit("x") for name in CLASHING})


def pages_of(docs):
    return docs.select(F.col("doc_id").alias("page_id"), F.lit("http://x/").alias("url"), F.col("text").alias("html"), *[c for c in docs.columns if c in CLASHING])


def files(docs):
    spark = docs.sparkSession
    path = new_folder(spark, "tokens")
    token_files.write_token_files(docs, path, VOCABULARY, end_id=2)
    return token_files.read_metadata(spark, path).select("doc_id", "start", "n_tokens")


OPERATORS = {
    "op1": lambda docs, items: token_counts.token_counts(docs, VOCABULARY),
    "op2": lambda docs, items: secrets.scan_secrets(docs),
    "op2_redact": lambda docs, items: secrets.redact_secrets(docs).select("doc_id", "text"),
    "op3": lambda docs, items: decontaminate.find_leaks(docs, items),
    "op3_drop": lambda docs, items: decontaminate.drop_leaking(docs, items).select("doc_id", "text"),
    "op4": lambda docs, items: host_rules.quality_report(docs),
    "op4_keep": lambda docs, items: host_rules.keep_good(docs).select("doc_id", "text"),
    "op5": lambda docs, items: repeats.repeated_spans(docs),
    "op6": lambda docs, items: files(docs),
    "op7": lambda docs, items: jaccard.jaccard_components(docs),
    "op7_keep": lambda docs, items: jaccard.keep_one(docs).select("doc_id", "text"),
    "op8": lambda docs, items: packing.pack(docs, VOCABULARY),
    "op9": lambda docs, items: warc.round_trip(pages_of(docs)),
    "op10": lambda docs, items: language_id.identify(docs, rows=50, chars=200, hidden=4, steps=20),
}


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    items = spark.createDataFrame([(1, "seven eight nine ten eleven twelve thirteen fourteen fifteen? sixteen"), (None, None), (2, "")], "item_id long, text string")
    return docs, items


def shown(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(tables, name):
    docs, items = tables
    assert OPERATORS[name](docs.limit(0), items).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_change_nothing(tables, name):
    docs, items = tables
    plain = OPERATORS[name](docs, items)
    # Sequences are numbered task by task, and which texts share a task is not fixed.
    columns = [c for c in plain.columns if c not in ("sequence_id", "start") or name == "op5"]
    want = shown(plain.select(*columns))
    assert shown(OPERATORS[name](clash(docs), clash(items)).select(*columns)) == want
    if name in ("op1", "op2", "op2_redact", "op4", "op5", "op6", "op7", "op9", "op10"):
        assert len(want) == len(ROWS)


def test_an_empty_list_of_items(tables, spark):
    docs, items = tables
    assert decontaminate.find_leaks(docs, items.limit(0)).collect() == [] and decontaminate.drop_leaking(docs, items.limit(0)).count() == len(ROWS)


def test_near_duplicates_with_shared_ids(spark):
    """Rows that share a doc_id are one vertex, and join the classes of their texts."""
    a, b = LONG, LONG.replace("o", "0")
    docs = spark.createDataFrame([(1, a), (7, a), (7, b), (9, b), (11, "quite another text with more than five words")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()} == {1: 1, 7: 1, 9: 1, 11: 11}
    assert sorted(r["doc_id"] for r in jaccard.keep_one(docs).collect()) == [1, 11]
    same = spark.createDataFrame([(7, a), (7, b), (7, b)], "doc_id long, text string")
    assert sorted(r["text"] for r in jaccard.keep_one(same).collect()) == sorted([a, b])


@pytest.mark.parametrize("tile", [3, 8])
def test_components_of_several_tiles(spark, monkeypatch, tile):
    """Chains of near copies that no tile holds whole, against all pairs."""
    import random

    monkeypatch.setattr(jaccard, "TILE", tile)
    rng = random.Random(tile)
    texts = []
    for _ in range(6):
        words = [f"w{rng.randrange(400)}" for _ in range(60)]
        for _ in range(25):
            texts.append(" ".join(words))
            words = list(words)
            words[rng.randrange(60)] = f"w{rng.randrange(400)}"
            if rng.random() < 0.2:
                words = words[5:] + [f"w{rng.randrange(400)}" for _ in range(5)]
    rng.shuffle(texts)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == dict(enumerate(root))


def test_token_file_format(spark, tmp_path):
    """Dictionary and delta encodings, row groups of a set size, page indexes, and reads of columns and rows alone."""
    docs = spark.createDataFrame([(i, " ".join(str((i * 7919 + j * 104729) % 99991) for j in range(200))) for i in range(3000)], "doc_id long, text string")
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs, path, VOCABULARY, end_id=2, row_group_bytes=256 << 10, page_bytes=16 << 10)
    found = [pq.ParquetFile(f) for f in glob.glob(f"{tmp_path}/tokens/*.parquet")]
    assert sum(f.metadata.num_row_groups for f in found) > len(found)
    for f in found:
        group = f.metadata.row_group(0)
        columns = {group.column(i).path_in_schema.split(".")[0]: group.column(i) for i in range(group.num_columns)}
        assert "RLE_DICTIONARY" in columns["tokens"].encodings
        for name in ("doc_id", "n_tokens"):
            assert "DELTA_BINARY_PACKED" in columns[name].encodings and "RLE_DICTIONARY" not in columns[name].encodings
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    rows = spark.read.parquet(path).filter("doc_id = 1234")
    plan = rows.select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,1234)]" in plan and "tokens:array" not in plan
    assert rows.count() == 1


def test_files_are_in_the_order_of_their_tasks(spark):
    names = spark.createDataFrame([("part-100000-x.parquet",), ("part-99999-x.parquet",), ("part-00007-x.parquet",)], "f string")
    assert [r["f"][:8] for r in names.orderBy(token_files.file_number(F.col("f"))).collect()] == ["part-000", "part-999", "part-100"]


def test_other_vocabularies_are_refused():
    from zeitband.llm.chunk_encoder import ChunkEncoder

    for make in (token_counts.TokenCounter, ChunkEncoder):
        with pytest.raises(ValueError):
            make(public_tokenizers.path("byte_bpe_50k.json"))


def test_archives_with_odd_pages(spark):
    rows = [("a:b:c", "http://x/\ny", "same"), ("z", None, "same"), (None, "u", "same"), ("e", "u", None), ("f", "u", ""), ("f", "u", ""), ("long", "u", "ab" * 3_000_000)]
    docs = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(docs).collect()}
    assert got == {("a:b:c", "response", None, 4), ("z", "revisit", "a:b:c", 4), (None, "response", None, 4), ("e", "response", None, 0), ("f", "revisit", "e", 0), ("long", "response", None, 6_000_000)}
    small = {(r["page_id"], r["record_type"]) for r in warc.round_trip(docs, least_bytes=5).collect()}
    assert all(kind == "response" for _, kind in small)
