import pytest

from zeitband.operators.dedupe import continued, dedupe_texts
from zeitband.plans.registry import QUERIES


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("wir gehen nach Hause", "Nach hause und dann", "wir gehen nach Hause und dann"),
        ("wir gehen", "Wir gehen jetzt", "Wir gehen jetzt"),
        ("wir gehen jetzt", "wir gehen jetzt", "wir gehen jetzt"),
        ("eins zwei drei vier", "eins zwei drei fünf sechs", "eins zwei drei fünf sechs"),
        ("eins zwei drei vier fünf", "eins zwei drei sechs", "eins zwei drei vier fünf"),
        ("das ist gut", "gut", "das ist gut"),
        ("das ist", "etwas ganz anderes", None),
        ("das ist", "", "das ist"),
    ],
)
def test_continued(a, b, want):
    made = continued(a.split(), b.split())
    assert made == (None if want is None else want.split())


def test_fold(spark):
    rows = [(1, 1, 0, 1000, "guten Morgen"), (1, 2, 1100, 1300, "ja"), (1, 3, 2000, 4000, "Morgen ja und weiter"), (1, 4, 90_000, 91_000, "und weiter"), (2, 1, 0, 100, None)]
    got = dedupe_texts(spark.createDataFrame(rows, "tid long, seq int, start_ms long, end_ms long, text string")).orderBy("tid", "seq").collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, 4000, "guten Morgen ja und weiter", 3), (1, 4, 90_000, 91_000, "und weiter", 1), (2, 1, 0, 100, None, 1)]


def test_query_keeps_the_count_of_rows(spark):
    folder = "/root/testdata/sf0.001"
    merged = QUERIES["dedupe_texts"](spark, folder).selectExpr("sum(n_merged)").first()[0]
    assert merged == QUERIES["document_round_trip"](spark, folder).count()
