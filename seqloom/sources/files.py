"""Readers and writers of sequences, alignments, features and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.letters import GAP
from ..operators.alignment import gapped_to_positions, linearize_columns, render_alignment
from .shared import unpacked
from .views import named_columns


def _need(good, message) -> F.Column:
    """True, or an error with the message."""
    return F.when(good, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, sequence_id, ord, letters) of a CSV without header: group, id, letters
    parted by white space. A row without exactly three fields is an error. Of repeated
    (group, id) the last row counts, at the first one's place; files follow one another by
    their paths, whatever their sizes."""
    schema = "group_id string, sequence_id string, text string, _corrupt string"
    rows = spark.read.schema(schema).csv(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    # A task reads its splits one after another, and the rows of a split in order.
    rows = rows.withColumn("line_no", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")))
    rows = rows.where(_need(F.col("_corrupt").isNull() & F.col("sequence_id").isNotNull(), F.concat(F.lit("not three fields: "), F.coalesce("_corrupt", "group_id"))))
    letters = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")
    return dedupe_sequences(rows.select("group_id", "sequence_id", "line_no", letters.alias("letters")))


def dedupe_sequences(rows: DataFrame) -> DataFrame:
    """One row for each (group_id, sequence_id): the last letters, at the first line's place."""
    one = rows.groupBy("group_id", "sequence_id").agg(F.max_by("letters", "line_no").alias("letters"), F.min("line_no").alias("line_no"))
    return one.select("group_id", "sequence_id", (F.row_number().over(Window.partitionBy("group_id").orderBy("line_no")) - 1).cast("int").alias("ord"), "letters")


def fasta_rows(lines: DataFrame) -> DataFrame:
    """(aln_id, sequence_id, gapped) of lines (aln_id, line_no, line). Blank lines and ; comments
    are skipped; a body may take several lines. Bodies before a header, repeated ids and
    other characters are errors, and so are unequal lengths within an alignment."""
    kept = lines.select("aln_id", "line_no", F.trim("line").alias("line")).where("line <> '' and not startswith(line, ';')")
    by = Window.partitionBy("aln_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.startswith(F.col("line"), F.lit(">"))
    marked = kept.withColumns({"start": F.last(F.when(head, F.col("line_no")), ignorenulls=True).over(by), "id": F.last(F.when(head, F.trim(F.expr("substring(line, 2)"))), ignorenulls=True).over(by)})
    marked = marked.where(_need(F.col("id").isNotNull(), F.concat(F.lit("a line before any header: "), F.col("line"))))
    marked = marked.where(_need(head | F.col("line").rlike(r"^[a-zA-Z.-]*$"), F.concat(F.lit("not a sequence line: "), F.col("line"))))
    body = F.array_sort(F.collect_list(F.when(~head, F.struct("line_no", "line"))))
    rows = marked.groupBy("aln_id", "start", F.col("id").alias("sequence_id")).agg(body.alias("body"))
    rows = rows.select("aln_id", "sequence_id", F.translate(F.array_join(F.transform("body", lambda b: b["line"]), ""), ".", "-").alias("gapped"))
    one, every = Window.partitionBy("aln_id", "sequence_id"), Window.partitionBy("aln_id")
    rows = rows.withColumns({"_n": F.count("*").over(one), "_low": F.min(F.length("gapped")).over(every), "_high": F.max(F.length("gapped")).over(every)})
    rows = rows.where(_need(F.col("_n") == 1, F.concat(F.lit("repeated id "), F.col("sequence_id")))).where(_need(F.col("_low") == F.col("_high"), F.concat(F.lit("unequal lengths in "), F.col("aln_id"))))
    return rows.select("aln_id", "sequence_id", "gapped")


def fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """(aln_id, line_no, line) of files, one alignment a file."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("aln_id"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return text


def alignment_of(gapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequences, columns) of rows (aln_id, sequence_id, gapped)."""
    cells = gapped.select("aln_id", "sequence_id", F.posexplode(F.split("gapped", "")).alias("col", "letter")).where("letter <> ''")
    residues = gapped_to_positions(cells, GAP)
    letters = residues.groupBy("aln_id", "sequence_id").agg(F.array_sort(F.collect_list(F.struct("pos", "letter"))).alias("l"))
    every = gapped.select("aln_id", "sequence_id").join(unpacked(letters), ["aln_id", "sequence_id"], "left")
    sequences = every.select(F.col("aln_id").alias("group_id"), "sequence_id", F.coalesce(F.transform("l", lambda x: x["letter"]), F.array().cast("array<string>")).alias("letters"))
    return sequences, named_columns(residues.select("aln_id", "sequence_id", "pos", "col"), "col")


def read_fasta(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sequences, columns) of aligned FASTA files; aln_id is the file's path."""
    return alignment_of(fasta_rows(fasta_lines(spark, path)))


def rendered_rows(columns: DataFrame, sequences: DataFrame) -> DataFrame:
    return render_alignment(columns, sequences, linearize_columns(columns))


def fasta_text(columns: DataFrame, sequences: DataFrame) -> DataFrame:
    """(aln_id, value): one aligned FASTA text for each alignment, ids in order."""
    rows = rendered_rows(columns, sequences).groupBy("aln_id").agg(F.array_sort(F.collect_list(F.struct("sequence_id", "row"))).alias("rows"))
    return rows.select("aln_id", F.array_join(F.transform("rows", lambda r: F.concat(F.lit(">"), r["sequence_id"], F.lit("\n"), r["row"])), "\n").alias("value"))


def alignment_text(columns: DataFrame, sequences: DataFrame) -> DataFrame:
    """(aln_id, value): a line for each sequence, its row, a bar and its id."""
    rows = rendered_rows(columns, sequences).groupBy("aln_id").agg(F.array_sort(F.collect_list(F.struct("sequence_id", "row"))).alias("rows"))
    return rows.select("aln_id", F.array_join(F.transform("rows", lambda r: F.concat_ws("|", r["row"], r["sequence_id"])), "\n").alias("value"))


#: What stands before each alignment of a file of many; a comment to readers of FASTA.
ALIGNMENT = "; alignment "


def write_bundles(texts: DataFrame, path: str, *by: str) -> None:
    """(aln_id, value) as text files, each of many alignments: as many files as there are
    tasks, in a folder for each value of `by`. An id is one line."""
    one_line = F.when(~F.col("aln_id").contains("\n"), F.col("aln_id")).otherwise(F.raise_error(F.lit("an alignment's id has a line break")).cast("string"))
    rows = texts.select(*by, F.concat(F.lit(ALIGNMENT), one_line, F.lit("\n"), "value").alias("value"))
    (rows.write.partitionBy(*by) if by else rows.write).text(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(aln_id, value) of such files, and the columns of their folders. A file is read in
    splits, one record an alignment."""
    rows = spark.read.option("lineSep", "\n" + ALIGNMENT).text(path).withColumn("value", F.regexp_replace(F.regexp_replace("value", "^" + ALIGNMENT, ""), r"\n\z", ""))
    return rows.select(*(c for c in rows.columns if c != "value"), F.substring_index("value", "\n", 1).alias("aln_id"), F.expr("substring(value, locate('\n', value) + 1)").alias("value"))


def read_bundled_fasta(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sequences, columns) of files of many aligned FASTA texts."""
    lines = read_bundles(spark, path).select("aln_id", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return alignment_of(fasta_rows(lines))


def write_fasta(columns: DataFrame, sequences: DataFrame, path: str) -> None:
    write_bundles(fasta_text(columns, sequences), path)


def write_alignment_text(columns: DataFrame, sequences: DataFrame, path: str) -> None:
    write_bundles(alignment_text(columns, sequences), path)


def write_iteration_outputs(grid: DataFrame, sequences: DataFrame, weights: DataFrame, path: str, iteration: int) -> None:
    """FASTA and text of columns with `threshold`, a folder for each threshold, and the
    weights, of one iteration."""
    keyed = grid.withColumn("aln_id", F.concat_ws("@", "aln_id", F.col("threshold").cast("string"))).drop("threshold")
    thresholds = grid.select("aln_id", "threshold").distinct()
    own = sequences.join(thresholds.withColumnRenamed("aln_id", "group_id"), "group_id").withColumn("group_id", F.concat_ws("@", "group_id", F.col("threshold").cast("string"))).drop("threshold")
    parted = lambda df: df.select(F.element_at(F.split("aln_id", "@"), -1).alias("threshold"), F.regexp_replace("aln_id", "@[^@]*$", "").alias("aln_id"), "value")
    write_bundles(parted(fasta_text(keyed, own)), f"{path}/iteration={iteration}/fasta", "threshold")
    write_bundles(parted(alignment_text(keyed, own)), f"{path}/iteration={iteration}/text", "threshold")
    write_weights(weights, f"{path}/iteration={iteration}/weights")


def read_letter_features(spark: SparkSession, path: str, alphabet: DataFrame) -> DataFrame:
    """(letter, features) of a CSV with header input,features, where features stand as
    [ a b c ]. Letters outside the alphabet are skipped; none left is an error."""
    rows = spark.read.csv(path, header=True, schema="input string, features string")
    parsed = rows.select(F.col("input").alias("letter"), F.filter(F.split(F.regexp_replace("features", r"\[ | \]", ""), r"\s+"), lambda x: x != "").alias("features"))
    known = parsed.join(alphabet.select("letter"), "letter", "left_semi")
    if not known.take(1):
        raise ValueError(f"no letter of {path} is in the alphabet")
    return known


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(feature, weight) of lines `feature TAB weight`; a repeated feature is an error."""
    parts = F.split("value", r"\t+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("feature"), F.trim(parts[1]).cast("double").alias("weight"))
    one = rows.groupBy("feature").agg(F.max("weight").alias("weight"), F.count("*").alias("_n"))
    return one.where(_need(F.col("_n") == 1, F.concat(F.lit("repeated feature "), F.col("feature")))).select("feature", "weight")


def write_weights(weights: DataFrame, path: str) -> None:
    """Tab-separated, the highest weight first."""
    weights.orderBy(F.desc("weight"), "feature").select(F.concat_ws("\t", "feature", F.col("weight").cast("string"))).coalesce(1).write.text(path)


def convert_cognate_table(table: DataFrame, letters: DataFrame, language: str = "") -> DataFrame:
    """(group_id, sequence_id, letters) of a wide table: a row a language (its name in the
    column `language`), a column a cognate set, cells like [f1 f2][f3]. letters:
    (features, letter). Empty cells are dropped; a token without a letter, or a repeated
    key, is an error. The result is sorted."""
    sets = [c for c in table.columns if c != language]
    long = table.select(F.col(f"`{language}`" if language else "``").alias("sequence_id") if language else table[language].alias("sequence_id"), *[table[c] for c in sets])
    cells = long.unpivot("sequence_id", sets, "group_id", "cell").where(F.trim(F.coalesce("cell", F.lit(""))) != "")
    cleaned = F.replace(F.replace(F.regexp_replace(F.regexp_replace("cell", r"\]\s+.*", "]"), r"[()]", ""), F.lit("-["), F.lit("[")), F.lit("]-"), F.lit("]"))
    tokens = F.transform(F.filter(F.split(cleaned, r"\]"), lambda t: F.trim(t) != ""), lambda t: F.concat(F.trim(t), F.lit("]")))
    each = cells.select("group_id", "sequence_id", F.posexplode(tokens).alias("i", "features"))
    found = each.join(letters, "features", "left")
    found = found.where(_need(F.col("letter").isNotNull(), F.concat(F.lit("no letter for "), F.col("features"))))
    words = found.groupBy("group_id", "sequence_id").agg(F.array_sort(F.collect_list(F.struct("i", "letter"))).alias("l"), F.count_if(F.col("i") == 0).alias("_n"))
    words = words.where(_need(F.col("_n") == 1, F.concat(F.lit("repeated "), F.col("group_id"), F.lit(", "), F.col("sequence_id"))))
    return words.select("group_id", "sequence_id", F.array_join(F.transform("l", lambda x: x["letter"]), " ").alias("letters")).orderBy("group_id", "sequence_id")
