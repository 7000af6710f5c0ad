"""Sources and sinks by round trips, and the jobs from files to files."""

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera import jobs
from tessera.functions.text import comma_list
from tessera.operators import stats
from tessera.sources import readers, writers

REVIEWS = [
    # review, user, business, stars, date, text
    ("r1", "u1", "b1", 5.0, "2017-01-02", "Good soup, good bread"), ("r2", "u1", "b2", 3.0, "2018-05-02", "The soup was cold"),
    ("r3", "u2", "b1", 4.0, "2017-02-02", "bread"), ("r4", "u2", "b2", 2.0, "2017-02-03", ""), ("r5", "u2", "b3", 1.0, "2016-02-03", "rude staff!"),
    ("r6", "u3", "b1", 3.0, "2017-03-02", "soup"), ("r7", "u3", "b2", 1.0, "2017-03-05", "cold bread"), ("r8", "u3", "b1", 2.0, "2019-01-01", "worse soup"),
    ("r9", "u4", "b1", 1.0, "2017-04-02", "bad"), ("r10", "u4", "b2", 5.0, "2017-04-02", "nice staff"),
]
FIELDS = ("review_id", "user_id", "business_id", "stars", "date", "text")
BUSINESSES = [("b1", "Food, Soup", "NV"), ("b2", "Food,,Bars", "AZ"), ("b3", None, "NV"), ("b4", "", "NV")]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    (at / "reviews.json").write_text("\n".join(json.dumps(dict(zip(FIELDS, r, strict=True))) for r in REVIEWS))
    (at / "businesses.json").write_text("\n".join(json.dumps(dict(zip(("business_id", "categories", "state"), b, strict=True))) for b in BUSINESSES))
    (at / "stop.txt").write_text("the\n\twas \n\xa0\n")
    (at / "baskets.csv").write_text("user_id,business_id\n" + "\n".join(f"{u},{b}" for u, b in (("1", "100"), ("1", "97"), ("1", "97"), ("2", "100"), ("2", "97"), ("3", "98"))))
    return at


def _lines(folder) -> list[dict]:
    return [json.loads(x) for f in sorted(folder.glob("part-*")) for x in f.read_text().splitlines()]


def test_readers(spark, files, tmp_path):
    assert readers.reviews(spark, str(files / "reviews.json")).count() == 10
    assert {tuple(r) for r in readers.businesses(spark, str(files / "businesses.json")).collect()} == set(BUSINESSES)
    assert {r.word for r in readers.stop_words(spark, str(files / "stop.txt")).collect()} == {"the", "was", ""}
    rows = readers.basket_csv(spark, str(files / "baskets.csv"), partitions=10)
    assert rows.rdd.getNumPartitions() == 10 and rows.count() == 6
    assert {tuple(r) for r in readers.basket_csv(spark, str(files / "baskets.csv"), swap=True).collect()} == {("100", "1"), ("97", "1"), ("100", "2"), ("97", "2"), ("98", "3")}
    (tmp_path / "bad.json").write_text('{"review_id": "r1"}\nnot json\n')
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.reviews(spark, str(tmp_path / "bad.json")).collect()


def test_points_labels_and_models(spark, tmp_path):
    for name in ("b.txt", "a.txt"):
        (tmp_path / name).write_text("1, 0.5,2\n2,-1e3, 4\n")
    assert [p.rsplit("/", 1)[1] for p in readers.chunk_files(spark, str(tmp_path))] == ["a.txt", "b.txt"]
    assert [tuple(r) for r in readers.points_csv(spark, str(tmp_path / "a.txt")).collect()] == [(1, [0.5, 2.0]), (2, [-1000.0, 4.0])]
    (tmp_path / "labels.json").write_text('{"7": 1, "8": -1}')
    assert {tuple(r) for r in readers.labels(spark, str(tmp_path / "labels.json")).collect()} == {(7, 1), (8, -1)}
    model = spark.createDataFrame([("y", "x", 0.5), ("x", "z", 0.25)], "b1 string, b2 string, sim double")
    writers.json_lines(model, str(tmp_path / "model"))
    assert {tuple(r) for r in readers.item_model(spark, str(tmp_path / "model")).collect()} == {("x", "y", 0.5), ("x", "z", 0.25)}
    writers.json_lines(model.union(model), str(tmp_path / "twice"))
    with pytest.raises(PySparkException, match="pair twice"):
        readers.item_model(spark, str(tmp_path / "twice")).collect()


def test_csv_and_documents(spark, tmp_path):
    writers.csv(spark.createDataFrame([(1, "a,b"), (2, 'q"')], "n int, t string").coalesce(1), str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("part-*")
    assert part.read_text().splitlines() == ["n,t", '1,"a,b"', '2,"q\\""']
    writers.document(str(tmp_path / "d.json"), {"A": 1})
    assert json.loads((tmp_path / "d.json").read_text()) == {"A": 1}
    writers.write_assignment(str(tmp_path / "a.json"), spark.createDataFrame([(10, -1), (9, 2)], "point_id long, cluster_id int"))
    assert (tmp_path / "a.json").read_text() == '{"9": 2, "10": -1}'
    report = {}
    with pytest.raises(ZeroDivisionError), writers.timed(report, "step"):
        1 / 0
    assert report["step"] >= 0


def test_itemset_report_bytes(spark, files, tmp_path):
    at = tmp_path / "report.txt"
    seconds = jobs.frequent_sets(spark, str(files / "baskets.csv"), str(at), 2)
    sections = at.read_bytes().split(b"\r\nFrequent Itemsets:")
    assert sections[0].startswith(b"Candidates:\r\n('100'),('97')") and b"\r\n('100', '97')" in sections[0]
    assert sections[1] == b"\r\n('100'),('97')\r\n('100', '97')"
    assert set(seconds) == {"itemsets", "report"}
    jobs.frequent_sets(spark, str(files / "baskets.csv"), str(at), 1, more_than=2)
    assert at.read_bytes().split(b"Frequent Itemsets:")[1] == b"\r\n('100'),('97')\r\n('100', '97')"
    jobs.frequent_sets(spark, str(files / "baskets.csv"), str(at), 2, case=2)
    assert at.read_bytes().split(b"Frequent Itemsets:")[1] == b"\r\n('1'),('2')\r\n('1', '2')"


def test_review_jobs(spark, files, tmp_path):
    reviews, businesses = str(files / "reviews.json"), str(files / "businesses.json")
    got = jobs.review_statistics(spark, reviews, str(tmp_path / "a.json"), str(files / "stop.txt"), 2017, 2, 2)
    assert got == {"A": 10, "B": 7, "C": 4, "D": [["u2", 3], ["u3", 3]], "E": ["soup", "bread"]}
    assert json.loads((tmp_path / "a.json").read_text()) == got
    got = jobs.category_averages(spark, reviews, businesses, str(tmp_path / "b.json"), 9)
    assert got == {"result": [["Soup", 3.0], ["Food", 2.9], ["", 2.8], ["Bars", 2.8]]}
    got = jobs.partition_report(spark, reviews, str(tmp_path / "c.json"), 3, partitions=5)
    assert got == {"n_partitions": 5, "n_items": [0, 0, 0, 10, 0], "result": [["b1", 5], ["b2", 4]]}
    assert sum(jobs.partition_report(spark, reviews, str(tmp_path / "c.json"), 3)["n_items"]) == 10
    jobs.extract_state(spark, reviews, businesses, str(tmp_path / "nv"), user="user_id")
    rows = [x for f in (tmp_path / "nv").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted(x for x in rows if x != "user_id,business_id") == ["u1,b1", "u2,b1", "u2,b3", "u3,b1", "u3,b1", "u4,b1"]


def test_profile_jobs(spark, files, tmp_path):
    reviews = str(files / "reviews.json")
    jobs.train_profiles(spark, reviews, str(tmp_path / "model"), str(files / "stop.txt"))
    rows = {(r["type"], r["profile_id"]): r["profile_vector"] for r in _lines(tmp_path / "model")}
    assert rows[("business_profile", "b3")] == ["rude", "staff"] and "rude" in rows[("user_profile", "u2")]
    jobs.predict_by_profiles(spark, reviews, str(tmp_path / "model"), str(tmp_path / "out"))
    found = {(r["user_id"], r["business_id"]): r["sim"] for r in _lines(tmp_path / "out")}
    u, b = set(rows[("user_profile", "u2")]), set(rows[("business_profile", "b3")])
    assert found[("u2", "b3")] == pytest.approx(len(u & b) / (len(u) ** 0.5 * len(b) ** 0.5))


@pytest.mark.parametrize("by_items", [True, False])
def test_rating_jobs(spark, files, tmp_path, by_items):
    reviews = str(files / "reviews.json")
    jobs.train_ratings(spark, reviews, str(tmp_path / "model"), by_items)
    model = _lines(tmp_path / "model")
    # u3 rated b1 twice: the later rating counts; then the stars of b1 and b2 have a correlation of -0.4.
    assert all(set(r) == ({"b1", "b2", "sim"} if by_items else {"u1", "u2", "sim"}) for r in model)
    (tmp_path / "test.json").write_text("\n".join(json.dumps({"user_id": u, "business_id": b}) for u, b in (("u1", "b3"), ("u9", "b1"), ("u1", "b9"))))
    jobs.predict_ratings(spark, reviews, str(tmp_path / "test.json"), str(tmp_path / "model"), str(tmp_path / "out"), by_items)
    found = _lines(tmp_path / "out")
    assert found == [{"user_id": "u1", "business_id": "b3", "stars": 4.0}]


def test_jaccard_job(spark, files, tmp_path):
    jobs.jaccard_pairs(spark, str(files / "reviews.json"), str(tmp_path / "out"), 0.9)
    assert [(r["b1"], r["b2"], r["sim"]) for r in _lines(tmp_path / "out")] == [("b1", "b2", 1.0)]


def test_cluster_and_evaluation_jobs(spark, tmp_path):
    (tmp_path / "data").mkdir()
    points = [(i, [float(i % 2 * 50 + i % 7 * 0.1), float(i % 5 * 0.1)]) for i in range(40)]
    (tmp_path / "data" / "p0.txt").write_text("\n".join(",".join(map(str, [p, *x])) for p, x in points))
    state = jobs.cluster_points(spark, str(tmp_path / "data"), 2, str(tmp_path / "found.json"), str(tmp_path / "rounds"), f"file://{tmp_path}/states")
    (part,) = (tmp_path / "rounds").glob("part-*")
    assert part.read_text().splitlines()[0].startswith("round_id,nof_cluster_discard") and len(state.rounds) == 1
    assert len(json.loads((tmp_path / "found.json").read_text())) == 40
    (tmp_path / "truth.json").write_text(json.dumps({str(p): p % 2 for p, _ in points}))
    got = jobs.evaluate(spark, str(tmp_path / "truth.json"), str(tmp_path / "truth.json"))
    assert got == {"nmi": pytest.approx(1.0), "found": [[0, 20], [1, 20]], "truth": [[0, 20], [1, 20]]}


def test_comma_lists_and_null_numbers(spark):
    df = spark.createDataFrame([("A,,B ",), (" x\xa0, y",), ("",)], "t string")
    assert [r.p for r in df.select(comma_list("t").alias("p")).collect()] == [["A", "", "B"], ["x", "y"], [""]]
    dealt = stats.partitioned(spark.createDataFrame([(None,), (7,), (-1,)], "n int"), F.col("n"), 3)
    assert [r.n for r in stats.physical_partition_sizes(dealt).orderBy("partition").collect()] == [1, 1, 1]
