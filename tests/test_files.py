"""Readers, writers and column functions."""

import pytest
from pyspark.sql import functions as F

from seqloom.functions import letters as L
from seqloom.operators import alignment as A
from seqloom.operators import metrics as M
from seqloom.plans import model, training
from seqloom.sources import files

CSV = 'homologous group 1,taxon1,firstLetter secondLetter\nhomologous group 1,taxon2,thirdLetter firstLetter\n"homologous group, number 2",taxon3,secondLetter secondLetter\n"homologous group, number 2",taxon1,secondLetter firstLetter\n'
FEATURES = "input,features\nfirstLetter,[ f1v1 f2v1 f3v1 ]\nsecondLetter,[ f1v1 f2v2 f3v1 ]\nthirdLetter,[ f4v1 f5v1 ]\nfourthLetter,[ f4v1 f5v2 ]\n"
FASTA = "; a comment\n>b\nAC-\nG\n\n>a\n.CTG\n"


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return f"file://{tmp_path}/{name}"


def test_read_sequences(spark, tmp_path):
    got = files.read_sequences(spark, put(tmp_path, "s.csv", CSV)).collect()
    assert sorted((r.group_id, r.sequence_id, r.ord, r.letters) for r in got) == [
        ("homologous group 1", "taxon1", 0, ["firstLetter", "secondLetter"]), ("homologous group 1", "taxon2", 1, ["thirdLetter", "firstLetter"]),
        ("homologous group, number 2", "taxon1", 1, ["secondLetter", "firstLetter"]), ("homologous group, number 2", "taxon3", 0, ["secondLetter", "secondLetter"]),
    ]
    again = files.read_sequences(spark, put(tmp_path, "t.csv", CSV + "homologous group 1,taxon1,x\n")).where("sequence_id = 'taxon1' and ord = 0").first()
    assert again.letters == ["x"]


def test_last_row_wins_over_files_of_unlike_size(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    filler = "".join(f"g{i},s,x\n" for i in range(20_000))
    for name, text in (("a.csv", "g,one,a\ng,two,a\n"), ("b.csv", filler + "g,two,b\ng,three,b\n" + filler), ("c.csv", "g,one,c\n"), ("d.csv", "g,zero,d\ng,two,d1 d2\n")):
        (folder / name).write_text(text)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64k", "128m"):  # splits of one file, and many files in a task
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = files.read_sequences(spark, f"file://{folder}").where("group_id = 'g'").orderBy("ord").collect()
            assert [(r.ord, r.sequence_id, r.letters) for r in got] == [(0, "one", ["c"]), (1, "two", ["d1", "d2"]), (2, "three", ["b"]), (3, "zero", ["d"])]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_many_alignments_a_file(spark, tmp_path):
    rows = [(f"g {i}/{c}", s, i) for i in range(150) for c in "ab" for s in ("x", "y")]
    columns = spark.createDataFrame([(a, f"x:{p}", s, p) for a, s, _ in rows for p in range(3)], "aln_id string, column_id string, sequence_id string, pos int")
    sequences = spark.createDataFrame([(a, s, ["A", "C", "GT"[i % 2]]) for a, s, i in rows], "group_id string, sequence_id string, letters array<string>")
    path = f"file://{tmp_path}/fasta"
    files.write_fasta(columns.repartition(3), sequences, path)
    assert len(list((tmp_path / "fasta").glob("part-*"))) < 30
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # records over the bounds of splits
        again, read = files.read_bundled_fasta(spark, path)
        assert sorted(map(tuple, read.collect())) == sorted(map(tuple, columns.collect()))
        assert sorted((r.group_id, r.sequence_id, r.letters) for r in again.collect()) == sorted(map(tuple, sequences.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    with pytest.raises(Exception, match="line break"):
        files.write_bundles(spark.createDataFrame([("a\nb", "x")], "aln_id string, value string"), f"file://{tmp_path}/bad")


@pytest.mark.parametrize("line", ["a,b", "a,b,c,d"])
def test_bad_sequence_rows(spark, tmp_path, line):
    with pytest.raises(Exception, match="three fields"):
        files.read_sequences(spark, put(tmp_path, "s.csv", CSV + line + "\n")).collect()


def test_fasta(spark, tmp_path):
    sequences, columns = files.read_fasta(spark, put(tmp_path, "x.fasta", FASTA))
    assert {r.sequence_id: "".join(r.letters) for r in sequences.collect()} == {"a": "CTG", "b": "ACG"}
    assert {tuple(r)[1:] for r in A.edges_of_alignment(columns).collect()} == {("a", 0, "b", 1), ("a", 2, "b", 2)}
    text = files.fasta_text(columns, sequences).first().value
    _, again = files.read_fasta(spark, put(tmp_path, "y.fasta", text))
    assert {tuple(r)[1:] for r in A.edges_of_alignment(again).collect()} == {("a", 0, "b", 1), ("a", 2, "b", 2)}
    named = columns.withColumn("aln_id", F.lit("x")), sequences.withColumn("group_id", F.lit("x"))
    files.write_fasta(*named, f"file://{tmp_path}/out")
    files.write_alignment_text(*named, f"file://{tmp_path}/txt")
    assert spark.read.text(f"file://{tmp_path}/out").where("value like '>%'").count() == 2
    assert spark.read.text(f"file://{tmp_path}/txt").where("value like '%|a'").count() == 1


@pytest.mark.parametrize(("text", "error"), [("AC\n>a\nAC\n", "before any header"), (">a\nAC\n>a\nAC\n", "repeated id"), (">a\nA1\n", "not a sequence line"), (">a\nAC\n>b\nA\n", "unequal lengths")])
def test_bad_fasta(spark, tmp_path, text, error):
    with pytest.raises(Exception, match=error):
        files.read_fasta(spark, put(tmp_path, "x.fasta", text))[1].collect()


def test_features_and_weights(spark, tmp_path):
    alphabet = spark.createDataFrame([("firstLetter", 0), ("secondLetter", 1), ("thirdLetter", 2)], "letter string, letter_id int")
    path = put(tmp_path, "f.csv", FEATURES)
    assert {r.letter: r.features for r in files.read_letter_features(spark, path, alphabet).collect()} == {"firstLetter": ["f1v1", "f2v1", "f3v1"], "secondLetter": ["f1v1", "f2v2", "f3v1"], "thirdLetter": ["f4v1", "f5v1"]}
    with pytest.raises(ValueError, match="no letter"):
        files.read_letter_features(spark, path, alphabet.limit(0))
    weights = spark.createDataFrame([("a b", -1.5), ("c", 2.0)], "feature string, weight double")
    files.write_weights(weights, f"file://{tmp_path}/w")
    assert [r.feature for r in spark.read.text(f"file://{tmp_path}/w").select(F.split("value", "\t")[0].alias("feature")).collect()] == ["c", "a b"]
    assert {tuple(r) for r in training.init_weights(spark, f"file://{tmp_path}/w").collect()} == {("a b", -1.5), ("c", 2.0)}
    with pytest.raises(Exception, match="repeated feature"):
        files.read_weights(spark, put(tmp_path, "w.txt", "a\t1\n\na\t\t2\n")).collect()
    with pytest.raises(ValueError, match="SAME"):
        training.init_weights(spark, "SAME")
    assert training.regularization_centers(spark, "SAME", weights) is weights


def test_cognate_table(spark):
    letters = spark.createDataFrame([("[a b]", "x"), ("[c]", "y")], "features string, letter string")
    table = spark.createDataFrame([("L1", "[a b][c] note", "-[c]-"), ("L2", "([c])", None)], "lang string, set1 string, set2 string")
    got = files.convert_cognate_table(table, letters, "lang").collect()
    assert [tuple(r) for r in got] == [("set1", "L1", "x y"), ("set1", "L2", "y"), ("set2", "L1", "y")]
    with pytest.raises(Exception, match="no letter"):
        files.convert_cognate_table(spark.createDataFrame([("L1", "[q]")], "lang string, s string"), letters, "lang").collect()


def test_functions(spark):
    row = spark.range(1).select(
        L.parse_edge_literal(F.lit("((1, b), (0, a))")).alias("edge"), L.derivation_to_string(F.array(F.lit(0), F.lit(-1), F.lit(1))).alias("text"),
        L.derivation_invert(F.array(F.lit(1), F.lit(-1)), F.lit(3)).alias("inverse"), L.derivation_is_monotonic(F.array(F.lit(1), F.lit(-1), F.lit(0))).alias("monotone"),
        L.chars_to_letters(F.lit("ab")).alias("chars"), L.f1_score(F.lit(0.0), F.lit(0.0)).alias("f1"), L.derivation_invert(F.array().cast("array<int>"), F.lit(0)).alias("none"),
    ).first()
    assert (tuple(row.edge), row.text, row.inverse, row.monotone, row.chars, row.f1, row.none) == (("a", 0, "b", 1), "[0, X, 1]", [-1, 0, -1], False, ["a", "b"], 0.0, [])
    with pytest.raises(Exception, match="not an edge"):
        spark.range(1).select(L.parse_edge_literal(F.lit("((1,b), (0, a))"))).collect()
    with pytest.raises(Exception, match="no such state"):
        spark.createDataFrame([(3,)], "s int").select(L.collapse_indel_state(F.col("s"))).collect()
    with pytest.raises(Exception, match="boundary"):
        model.build_alphabet(spark.createDataFrame([("g", "s", ["#"])], "group_id string, sequence_id string, letters array<string>")).collect()


def test_render_restricted(spark):
    columns = spark.createDataFrame([("g", "a:0", "a", 0), ("g", "a:0", "b", 0), ("g", "b:1", "b", 1)], "aln_id string, column_id string, sequence_id string, pos int")
    sequences = spark.createDataFrame([("g", "a", ["x"]), ("g", "b", ["yy", "z"])], "group_id string, sequence_id string, letters array<string>")
    rows = {r.sequence_id: r.row for r in files.rendered_rows(columns, sequences).collect()}
    assert rows == {"a": "x \t- \t", "b": "yy\tz \t"}
    only = A.render_alignment(columns, sequences, A.linearize_columns(columns), spark.createDataFrame([("g", "a")], "aln_id string, sequence_id string")).collect()
    assert [(r.sequence_id, r.row) for r in only] == [("a", "x \t")]
    assert M.n_edges(columns).first().n_edges == 1
