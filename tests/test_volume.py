"""What the finished queries move: counted in rows that go through shuffles."""

from pyspark.sql import functions as F

from tidelog.operators import parse, search
from tidelog.operators.text_index import TextIndex
from tidelog.session import spread

PAGES = "url STRING, title STRING, content STRING, blocked BOOLEAN"


def shuffled(spark, action):
    """Rows that the stages of ``action`` write for others to read."""
    store = spark.sparkContext._jsc.sc().statusStore()
    quantiles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def rows():
        stages = store.stageList(None, False, False, quantiles, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = rows()
    action()
    return rows() - before


def stored(spark, twice):
    texts = [(f"u{i}", "T", " ".join(f"w{(i * j) % 50}" for j in range(200)), False) for i in range(40)]
    return spark.createDataFrame(texts + [("u3", None, "w1 again, w1", False)] * twice, PAGES)


def test_words_of_a_page_are_grouped_in_its_row(spark):
    pages = stored(spark, 1)
    assert shuffled(spark, lambda: search.token_index(pages).write.format("noop").mode("overwrite").save()) < 500
    rows = {(r["token"], r["url"]): r["positions"] for r in search.token_index(pages).collect()}
    assert len(rows) == search.token_index(pages).count()
    words = ["t", *(f"w{(5 * j) % 50}" for j in range(200))]
    assert {t: p for (t, u), p in rows.items() if u == "u5"} == {w: [i for i, x in enumerate(words) if x == w] for w in set(words)}
    # Of several rows with one url all count, as one text each.
    assert rows["again", "u3"] == [1] and rows["w1", "u3"][:2] == [0, 2]


def test_postings_are_written_and_merged_in_place(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"), 4)

    def upkeep():
        index.update(stored(spark, 0))
        index.update(stored(spark, 0).filter("url < 'u2'"))
        index.merge()

    assert index.postings().count() == 0 and shuffled(spark, upkeep) < 1500
    assert index.postings().count() == search.token_index(stored(spark, 0)).count()


def test_pages_are_objects_in_slices(spark, monkeypatch):
    sizes = []
    read = parse._read_slice
    monkeypatch.setattr(parse, "SLICE", 3)
    monkeypatch.setattr(parse, "_read_slice", lambda urls, bodies: sizes.append(len(urls)) or read(urls, bodies))
    rows = [(f"http://a.example/{i}", None if i == 4 else f"<title>t{i}</title><a href='/x{i}'>go</a>") for i in range(8)]
    urls, bodies = (parse.pa.array(column) for column in zip(*rows))
    parts = [parse._read_slice(urls.slice(at, parse.SLICE), bodies.slice(at, parse.SLICE)) for at in range(0, 8, parse.SLICE)]
    assert sizes == [3, 3, 2] and parse.pa.concat_arrays(parts).type == parse.PARSED_ARROW
    got = {r["url"]: (r["title"], [tuple(x) for x in r["links"]]) for r in parse.parse_pages(spark.createDataFrame(rows, "url STRING, html STRING").coalesce(1)).collect()}
    assert got == {u: ((None, []) if h is None else (f"t{i}", [(f"http://a.example/x{i}", "go")])) for i, (u, h) in enumerate(rows)}
    plan = parse.parse_pages(spark.createDataFrame(rows, "url STRING, html STRING"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan


def test_one_file_of_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    dealt = spread(spark.read.parquet(str(tmp_path / "one")), by_file=True)
    assert dealt.select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism
