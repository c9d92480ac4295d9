from tidewater.operators import split_explode, word_count


def test_words_fixture(spark):
    texts = [("Hello Spark  Hello\tDocker",), ("Hello Spark\nCluster",), ("",), ("   ",)]
    df = spark.createDataFrame(texts, "text string")
    got = {r.word: r.n for r in word_count(df).collect()}
    assert got == {"Hello": 3, "Spark": 2, "Docker": 1, "Cluster": 1}


def test_namespaces_not_trimmed(spark):
    df = spark.createDataFrame([("a, b,c",)], "s string")
    got = [(r.pos, r.item) for r in split_explode(df, "s").orderBy("pos").collect()]
    assert got == [(0, "a"), (1, " b"), (2, "c")]


def test_word_count_matches_python(spark, sf_small):
    import re
    from tidewater.sources import read_table
    docs = read_table(spark, sf_small, "documents")
    expect = {}
    for r in docs.select("text").toLocalIterator():
        for w in re.split(r"[ \t\n\r\f]+", r.text):
            if w:
                expect[w] = expect.get(w, 0) + 1
    got = {r.word: r.n for r in word_count(docs).collect()}
    assert got == expect
