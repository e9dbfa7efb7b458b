"""Text functions and readers against values derived by hand."""

import pytest
from pyspark.sql import functions as F

from lexispark.functions import text as X
from lexispark.sources import readers, writers


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (X.fix_punctuation, "3.14 saat 11:52 2024", "00.00 saat 00:00 000"),
        (X.turkish_lower, "IİA", "ıia"),
        (X.harden, "mutluluğ", "mutluluk"),
        (X.surface_forms, "ağlE", ["ağlı", "ağla"]),
        (X.stem_cuts, "arabalar", ["ara#balar", "arab#alar", "araba#lar", "arabal#ar", "arabala#r", "arabalar#"]),
        (X.stem_partitions, "arabalar", ["araba#lar", "arabal#ar", "arabala#r", "arabalar"]),
        (X.close_quote, 'a "b', 'a "b"'),
        (X.lex, "Ab, 3/4 (x)!", ["Ab", "NUM", "OPEN", "x", "CLOSE", "!"]),
        (X.characters, "añ", ["a", "ñ", "#"]),
        (X.char_grams, "abcdefg", ["abcde", "bcdef", "cdefg"]),
        (X.suffix_grams, "abcde", ["a", "bcd", "cde", "bcde", "bcde", "bcde", "ab", "cde", "cde", "cde", "cde", "abc", "de", "de", "de", "de", "abcd", "e", "e", "e", "e"]),
        (X.remove_markers, "a#b$ c", "abc"),
        (X.letter_tokens, "One, TWO2 three-four", ["one", "three", "four"]),
    ],
)
def test_values(spark, f, value, want):
    assert one(spark, value, f) == want


def test_arrays(spark):
    d = spark.createDataFrame([(["a", "b", "c", "d", "e"],)], "t array<string>")
    get = lambda c: d.select(c.alias("y")).first().y
    assert get(X.sliding(F.col("t"), 3)) == [["a", "b", "c"], ["b", "c", "d"], ["c", "d", "e"]]
    assert get(X.sliding(F.col("t"), 4, 3)) == [["a", "b", "c", "d"], ["d", "e"]] and get(X.sliding(F.col("t"), 9)) == [list("abcde")]
    assert get(X.left_pad(F.col("t"), 7)) == ["zero", "zero", *"abcde"] and get(X.left_pad(F.col("t"), 2)) == ["a", "b"]
    assert get(X.cartesian(F.array(F.array(F.lit("a1"), F.lit("a2")), F.array(F.lit("b1"), F.lit("b2"))))) == [["a1", "b1"], ["a2", "b1"], ["a1", "b2"], ["a2", "b2"]]


def test_readers(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    e = readers.embeddings_text(spark, file("v.vec", "3 2\nnew york 1 -2.5\nCat 7 7\nCat 0.5 1e-3\nshort 1\n"))
    assert sorted((r.word, r.vec) for r in e.collect()) == [("Cat", [0.5, 0.001]), ("new york", [1.0, -2.5])]
    vocab = spark.createDataFrame([("cat",)], "word string")
    assert [r.word for r in readers.embeddings_text(spark, str(tmp_path / "v.vec"), vocab).collect()] == ["cat"]
    blocks = readers.evaluation_blocks(spark, file("e.json", '{"intrinsic": [{"label": "similarity", "classifier": "C", "semeval": "x", "texts": ["a:b", "c:d", "a:e"]}, {"label": "analogy", "classifier": "D", "text": ["a + b = x + y"]}, {"label": "order", "textA": "q", "targets": ["r", "s"], "classifier": "O"}]}'))
    q = readers.analogy_queries(blocks)
    assert q.filter("block = 0").count() == 4 * 6 and q.filter("block = 1").count() == 6 and q.filter("kind = 'order'").count() == 2
    assert [r.tag for r in readers.slash_tagged(spark, file("pos.txt", "a/N b/c/V\nd/X\n")).orderBy("sent", "pos").collect()] == ["N", "V", "X"]
    ner = readers.column_tagged(spark, file("ner.txt", "A B-P\nb O\n\nc O\n")).orderBy("line_no").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    many = "".join(f"line {k}\n" for k in range(60))
    assert sorted((r.line_no, r.value) for r in readers.numbered_lines(spark, file("many.txt", many)).collect()) == [(k, f"line {k}") for k in range(60)]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.sent, r.word) for r in ner] == [(0, "A"), (0, "b"), (1, "c")]
    con = readers.conllu(spark, file("c.conllu", "# s\n1\tA\ta\tN\n1-2\tx\t_\t_\n\n# s\n1\tB\tb\tV\n")).orderBy("line_no").collect()
    assert [(r.form, r.tag) for r in con] == [("A", "N"), ("B", "V")] and con[0].sent != con[1].sent
    assert readers.ner_json(spark, file("n.json", '{"tokens": ["a", "b"], "tags": ["X", "O"]}\n')).first().text == "a/X b/O"
    assert [(r.text, r.label) for r in readers.sentiment(spark, file("s.txt", "good\tone\t1\nnone\n")).collect()] == [("good\tone", "1")]
    assert readers.sentiment_csv(spark, file("s.csv", 'text,label,extra\n"a, b",1,z\nshort,2\n')).count() == 1
    m = readers.morphology(spark, file("m.txt", "ev:ev|ler:LER\n")).first()
    assert (m.ins, m.outs) == (["ev", "ler"], ["ev", "LER"])
    assert [r.word for r in readers.lexicon_tsv(spark, file("l.tsv", "~kalE&\t_\tN\n")).collect()] == ["kala"]
    assert sorted(r.phrase for r in readers.phrases(spark, file("p.txt", "göz (iyi) atmak: x\n")).collect()) == ["göz at", "göz iyi at"]
    assert readers.four_columns(spark, file("f.txt", "a b x y\nbad line\n")).count() == 1
    assert readers.word_list(spark, file("w.txt", "gitmek\n"), "Verb").first().lemma == "git"
    t = spark.createDataFrame([(["a", "b"], ["x", "y"])], "toks array<string>, lemmas array<string>")
    writers.write_corpus(t, str(tmp_path / "c"))
    writers.write_aligned(t, str(tmp_path / "al"))
    assert readers.corpus(spark, str(tmp_path / "c")).first().text == "a b"
    assert sorted(r.text for r in readers.corpus(spark, str(tmp_path / "al")).collect()) == ["a b", "x y"]
    writers.write_vocabulary(spark.createDataFrame([("Ab cd cd",)], "text string"), str(tmp_path / "vo"))
    assert [r.text for r in readers.corpus(spark, str(tmp_path / "vo")).collect()] == ["cd"]
    writers.write_report(spark.createDataFrame([("c", 1)], "classifier string, n int"), str(tmp_path / "xml"))
    assert spark.read.format("xml").option("rowTag", "RESULT").load(str(tmp_path / "xml")).first().n == 1


def test_folders_literals_and_dumps(spark, tmp_path):
    (tmp_path / "tud").mkdir()
    (tmp_path / "tud" / "a.csv").write_text('"id","s"\n"1","One, two"\n"2","x"\n')
    (tmp_path / "tud" / "b.csv").write_text('"id","s"\n"3","y"\n')
    assert sorted(r.text for r in readers.csv_folder(spark, str(tmp_path / "tud")).collect()) == ["One, two", "x", "y"]
    d = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("c", [3.0])], "word string, v array<double>")
    assert [(r.src, r.dst, r.dst_vec) for r in readers.word_pairs(spark, "is_a", ["a", "b", "c", "z"], d).collect()] == [("a", "b", [2.0])]
    assert sorted(r.word for r in readers.word_collection(spark, "all", ["a", "c", "q"], d).collect()) == ["a", "c"]
    writers.write_words(d.union(d), str(tmp_path / "words"))
    writers.concatenate(spark, [str(tmp_path / "words"), str(tmp_path / "tud")], str(tmp_path / "both"))
    assert readers.corpus(spark, str(tmp_path / "words")).count() == 3 and readers.corpus(spark, str(tmp_path / "both")).count() == 8
    writers.write_parameters(spark, {"MODEL": {"EPOCHS": 3, "RATE": 0.1}, "STATISTICS": {"OOV": 2}}, str(tmp_path / "params"))
    got = {r._LABEL: {p._LABEL: p._VALUE for p in r.PARAM} for r in spark.read.format("xml").option("rowTag", "GROUP").schema("_LABEL string, PARAM array<struct<_LABEL: string, _VALUE: string>>").load(str(tmp_path / "params")).collect()}
    assert got == {"MODEL": {"EPOCHS": "3", "RATE": "0.1"}, "STATISTICS": {"OOV": "2"}}
