import duckdb
import pytest

from lociflow.llm.language import fit, label_sql, named_language, segments, tokens

EN = "the second replicate confirms the earlier interpretation of this finding without further evidence from the family"
DE = "die zweite Wiederholung bestätigt die frühere Deutung dieses Befundes ohne weitere Belege aus der Familie"


@pytest.fixture(scope="module")
def model(spark):
    return fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def run(spark, model, texts):
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, segment int")
    out = {}
    for r in segments(df, model).orderBy("doc_id", "segment").collect():
        out.setdefault(r.doc_id, []).append((r.lang, r.n_words))
        assert 0 <= r.confidence <= 1
    return out


def test_labels(spark):
    cases = {"en": "en", "EN-gb": "en", "Deutsch": "de", "pt_BR": "pt", "Français": "fr", "español (ES)": "es", "xx": None, "": None, None: None, "unknown": None, "Nederlands": "nl", "ITA": "it", "Polish": "pl"}
    df = spark.createDataFrame([(k,) for k in cases], "l string").select("l", label_sql("l").alias("x"))
    assert {r.l: r.x for r in df.collect()} == cases == {k: named_language(k) for k in cases}


def test_tokens():
    assert [t for t in tokens("Gene ABC1 is 5 kb.\nchr1\t5\t.\tA\tC\t9\n\nNew")] == [("gene", True, 2), ("is", False, 2), ("kb", False, 1), ("new", True, 1)]
    assert [w for w, _, _ in tokens("ALL WORDS OF THIS TEXT ARE LARGE")] == "all words of this text are large".split()


def test_segments(spark, model):
    got = run(spark, model, [EN, DE, f"{EN}. {DE}.", None, "", "ABC1, DEF2\n5 6", f"{EN}. {EN}".upper(), f"{DE}. " * 500, EN])
    assert [x for x, _ in got[0]] == ["en"] and [x for x, _ in got[1]] == ["de"] and [x for x, _ in got[2]] == ["en", "de"]
    assert not {3, 4, 5} & set(got) and [x for x, _ in got[6]] == ["en"] and got[7] == [("de", 500 * len(DE.split()))] and got[8] == got[0]


def test_no_labels_or_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert fit(empty) is None and segments(empty, None).count() == 0
    assert run(spark, None, [EN]) == {}


def test_held_out_sentences(spark, model):
    rows = duckdb.sql("SELECT text, lang FROM '/root/testdata/sf0.1/documents.parquet' WHERE lang IN ('en', 'de', 'fr', 'es', 'it', 'pt', 'nl', 'pl') AND n_chars > 200 ORDER BY hash(doc_id) LIMIT 400").fetchall()
    got = run(spark, model, [t for t, _ in rows])
    main = [max(got[i], key=lambda s: s[1])[0] if i in got else None for i in range(len(rows))]
    assert sum(a == b for a, (_, b) in zip(main, rows)) > 0.88 * len(rows)  # some labels are wrong
