from engramma.llm import op7_jaccard as m

WORDS = [" ".join(f"{p}{i}" for i in range(60)) for p in "abcdefg"]
A, B, C, D, E, G, H = WORDS
SCHEMA = "doc_id long, text string, lang string"


def kept(spark, rows):
    got = m.keep_one(spark.createDataFrame([(*r, "en") for r in rows], SCHEMA).repartition(3), k=5, percent=80)
    assert got.columns == ["doc_id", "text", "lang"]
    return sorted(((r.doc_id, r.text) for r in got.collect()), key=str)


def test_other_texts_of_an_id_stay(spark):
    near = A.replace("a30", "x")
    rows = [(1, A), (7, near), (7, B), (7, C), (8, D)]
    assert kept(spark, rows) == sorted([(1, A), (7, B), (7, C), (8, D)], key=str)


def test_one_row_of_copies_stays(spark):
    near = E.replace("e30", "x")
    rows = [(2, A), (2, A), (2, A), (3, B), (3, B.upper()), (None, C), (None, C), (None, D), (4, D), (5, E), (5, near), (6, ""), (6, ""), (None, None), (9, G), (None, H)]
    got = kept(spark, rows)
    assert len(got) == 10
    assert [r for r in got if r[1]].count((2, A)) == 1 and got.count((None, C)) == 1 and (4, D) in got and (None, D) not in got
    assert len([r for r in got if r[0] == 3]) == len([r for r in got if r[0] == 5]) == 1
    assert got.count((6, "")) == 2 and (None, None) in got and (9, G) in got and (None, H) in got


def test_clashing_names_and_many_equal_rows(spark):
    near = A.replace("a30", "x")
    rows = [(2, A, "u", 1)] * 400 + [(3, near, "v", 2), (4, B, "w", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone string, node int").repartition(4)
    got = m.keep_one(df, k=5, percent=80)
    assert got.columns == df.columns and sorted((r.doc_id, r._gone) for r in got.collect()) == [(2, "u"), (4, "w")]


def test_columns_that_have_no_order(spark):
    near = A.replace("a30", "x")
    df = spark.createDataFrame([(2, A, {"b": 1}), (2, A, {"a": 1}), (3, near, {"c": 2}), (4, B, None), (4, B, None)], "doc_id long, text string, tags map<string,int>")
    df = df.selectExpr("*", "parse_json(to_json(tags)) v", "array(tags) many").repartition(3)
    got = m.keep_one(df, k=5, percent=80)
    assert got.dtypes == df.dtypes
    assert sorted((r.doc_id, r.tags, r.many) for r in got.select("doc_id", "tags", "many").collect()) == [(2, {"a": 1}, [{"a": 1}]), (4, None, [None])]
