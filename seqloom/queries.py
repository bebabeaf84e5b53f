"""One query for each operator, over whole tables, and its SQL where SQL can express it.

Sequences are the orders of a customer, lettered by the return flags of their lines;
`gold` sets them flush left, `guess` flush right. Links of two positions are scored by
a closed formula. Doubles are rounded to 9 digits in both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import letters as L
from .operators import alignment as A
from .operators import construct as C
from .operators import metrics as M
from .plans import model, pairs, training
from .sources import files
from .sources.shared import new_path, saved
from .sources.views import event_sequences, explode_residues, justified, named_columns, order_sequences, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SEQ = """seq AS (
  SELECT CAST(o_custkey AS VARCHAR) AS group_id, CAST(l_orderkey AS VARCHAR) AS sequence_id,
         list(l_returnflag ORDER BY l_linenumber, l_returnflag) AS letters
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_orderkey)"""
RES = SEQ + """, res AS (
  SELECT group_id AS aln_id, sequence_id, n, CAST(i AS INTEGER) AS pos, letters[i + 1] AS letter
  FROM (SELECT *, len(letters) AS n, unnest(range(len(letters))) AS i FROM seq))"""
COLS = RES + """, gold AS (
  SELECT aln_id, first_value(sequence_id || ':' || pos) OVER (PARTITION BY aln_id, pos ORDER BY sequence_id) AS column_id, sequence_id, pos FROM res),
guess AS (
  SELECT aln_id, first_value(sequence_id || ':' || pos) OVER (PARTITION BY aln_id, pos - n ORDER BY sequence_id) AS column_id, sequence_id, pos FROM res)"""


def edges_sql(name: str) -> str:
    return f"""edges_{name} AS (
  SELECT a.aln_id, a.sequence_id AS seq1, a.pos AS pos1, b.sequence_id AS seq2, b.pos AS pos2
  FROM {name} a JOIN {name} b ON a.aln_id = b.aln_id AND a.column_id = b.column_id AND a.sequence_id < b.sequence_id)"""


SCORED = RES + """, scored AS (
  SELECT a.aln_id, a.sequence_id AS seq1, a.pos AS pos1, b.sequence_id AS seq2, b.pos AS pos2,
         round(CASE WHEN a.letter = b.letter THEN 0.9 ELSE 0.4 END - 0.15 * abs(a.pos - b.pos), 9) AS score
  FROM res a JOIN res b ON a.aln_id = b.aln_id AND a.sequence_id < b.sequence_id)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def rounded(c: Column | str) -> Column:
    return F.round(c, 9)


def gold(spark: SparkSession, sf_dir: str, sequences: DataFrame | None = None) -> DataFrame:
    return justified(order_sequences(spark, sf_dir) if sequences is None else sequences)


def guess(spark: SparkSession, sf_dir: str, sequences: DataFrame | None = None) -> DataFrame:
    return justified(order_sequences(spark, sf_dir) if sequences is None else sequences, left=False)


def scored(spark: SparkSession, sf_dir: str, sequences: DataFrame | None = None) -> DataFrame:
    """A score for every two positions of two sequences of a group."""
    r = explode_residues(order_sequences(spark, sf_dir) if sequences is None else sequences)
    side = lambda i: r.select(F.col("group_id").alias("aln_id"), F.col("sequence_id").alias(f"seq{i}"), F.col("pos").alias(f"pos{i}"), F.col("letter").alias(f"l{i}"))
    both = side(1).join(side(2), "aln_id").where("seq1 < seq2")
    score = F.when(F.col("l1") == F.col("l2"), 0.9).otherwise(0.4) - 0.15 * F.abs(F.col("pos1") - F.col("pos2"))
    return both.select("aln_id", "seq1", "pos1", "seq2", "pos2", rounded(score).alias("score"))


def duets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of a customer two by two, each two a group of their own. There two links
    fit together if they keep their order on both sides, which SQL can tell."""
    s = order_sequences(spark, sf_dir)
    return s.withColumn("group_id", F.concat_ws("/", "group_id", F.floor(F.col("ord") / 2).cast("string"))).withColumn("ord", F.col("ord") % 2)


DUETS = SEQ + """, duet AS (SELECT group_id || '/' || ((row_number() OVER (PARTITION BY group_id ORDER BY sequence_id) - 1) // 2) AS aln_id, sequence_id, letters, len(letters) AS n FROM seq),
dres AS (SELECT aln_id, sequence_id, n, CAST(i AS INTEGER) AS pos, letters[i + 1] AS letter FROM (SELECT *, unnest(range(n)) AS i FROM duet)),
dscored AS (
  SELECT a.aln_id, a.sequence_id AS seq1, a.pos AS pos1, b.sequence_id AS seq2, b.pos AS pos2, least(a.n, b.n) AS shorter,
         round(CASE WHEN a.letter = b.letter THEN 0.9 ELSE 0.4 END - 0.15 * abs(a.pos - b.pos), 9) AS score
  FROM dres a JOIN dres b ON a.aln_id = b.aln_id AND a.sequence_id < b.sequence_id)"""


def greedy_sql(where: str) -> str:
    """Links taken best first, of those that pass `where`: (aln_id, k, ..., score)."""
    return f"""WITH RECURSIVE {DUETS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY aln_id ORDER BY score DESC, seq1, pos1, seq2, pos2) AS k FROM dscored WHERE {where}),
greedy AS (SELECT DISTINCT aln_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(a INTEGER, b INTEGER)[]) AS held, false AS taken FROM ranked
  UNION ALL SELECT aln_id, k, CASE WHEN fits THEN list_append(held, {{'a': pos1, 'b': pos2}}) ELSE held END, fits
  FROM (SELECT r.aln_id, r.k, held, pos1, pos2, len([x FOR x IN held IF (x.a - pos1) * (x.b - pos2) <= 0]) = 0 AS fits FROM greedy g JOIN ranked r ON r.aln_id = g.aln_id AND r.k = g.k + 1)),
accepted AS (SELECT r.* FROM greedy g JOIN ranked r ON r.aln_id = g.aln_id AND r.k = g.k WHERE taken)"""


_MERGED = "coalesce(a.seq1 || ':' || a.pos1, d.sequence_id || ':' || d.pos) AS column_id, d.sequence_id, d.pos FROM dres d"
_LINKED = "a.aln_id = d.aln_id AND a.seq2 = d.sequence_id AND a.pos2 = d.pos"


def in_one_alignment(rows: DataFrame) -> DataFrame:
    """All groups as one: sequences have ids of their own."""
    return rows.withColumn("aln_id", F.lit("all"))


def letters_text(df: DataFrame, name: str = "letters") -> DataFrame:
    return df.withColumn(name, F.array_join(name, " "))


def coded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """sequences, alphabet, their pairs, and the number of letters."""
    sequences = order_sequences(spark, sf_dir)
    alphabet = saved(model.build_alphabet(sequences), "alphabet")
    return sequences, alphabet, pairs.sequence_pairs(model.with_letter_ids(sequences, alphabet)), alphabet.count()


def fixed_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("selfsub", 1.5), ("statePair(0,0)", 0.5), ("statePair(1,1)", 0.25)], "feature string, weight double")


def modelled(spark: SparkSession, sf_dir: str, weights: DataFrame | None = None):
    """pairs, model weights and the number of letters."""
    _, alphabet, paired, n = coded(spark, sf_dir)
    table = model.transition_logprobs(model.transition_features(alphabet), weights if weights is not None else training.zero_weights(spark))
    return paired, model.model_weights(table, n), n


def trained(sequences: DataFrame) -> DataFrame:
    """Weights of the sequences' own model, after all rounds of training."""
    return training.train(sequences)[-1].weights


# --- sources and sinks ------------------------------------------------------


@query(f"WITH {SEQ} SELECT group_id, sequence_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY sequence_id) - 1 AS INTEGER) AS ord, array_to_string(letters, ' ') AS letters FROM seq")
def read_sequences(spark, sf_dir):
    path = new_path(spark, "sequences")
    rows = order_sequences(spark, sf_dir).select("group_id", "sequence_id", F.array_join("letters", " "))
    rows.repartition("group_id").sortWithinPartitions("group_id", "sequence_id").write.csv(path)
    return letters_text(files.read_sequences(spark, path))


@query(f"WITH {COLS} SELECT * FROM gold")
def read_fasta(spark, sf_dir):
    s = order_sequences(spark, sf_dir)
    text = files.fasta_text(gold(spark, sf_dir, s), s)
    lines = text.select("aln_id", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return files.alignment_of(files.fasta_rows(lines))[1]


_PADDED = ", padded AS (SELECT group_id AS aln_id, sequence_id, rpad(array_to_string(letters, ''), CAST(max(len(letters)) OVER (PARTITION BY group_id) AS INTEGER), '-') AS r FROM seq)"


@query(f"WITH {SEQ}{_PADDED} SELECT aln_id, string_agg('>' || sequence_id || chr(10) || r, chr(10) ORDER BY sequence_id) AS value FROM padded GROUP BY aln_id")
def write_fasta(spark, sf_dir):
    s = order_sequences(spark, sf_dir)
    path = new_path(spark, "fasta")
    files.write_fasta(gold(spark, sf_dir, s), s, path)
    return files.read_bundles(spark, path)


@query(f"WITH {COLS} SELECT * FROM guess")
def read_written_fasta(spark, sf_dir):
    """Alignments written as files of many and read back."""
    s = order_sequences(spark, sf_dir)
    path = new_path(spark, "fasta")
    files.write_fasta(guess(spark, sf_dir, s), s, path)
    return files.read_bundled_fasta(spark, path)[1]


@query(f"WITH {SEQ}{_PADDED} SELECT aln_id, string_agg(r || '|' || sequence_id, chr(10) ORDER BY sequence_id) AS value FROM padded GROUP BY aln_id")
def write_alignment_text(spark, sf_dir):
    s = order_sequences(spark, sf_dir)
    path = new_path(spark, "text")
    files.write_alignment_text(gold(spark, sf_dir, s), s, path)
    return files.read_bundles(spark, path)


def flag_features(spark, sf_dir) -> DataFrame:
    """Features of each return flag as text: its line states, and its most frequent quantity's parity."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_returnflag").alias("input")).agg(F.concat(F.lit("[ s"), F.min("l_linestatus"), F.lit(" t"), F.max("l_linestatus"), F.lit(" n"), (F.count("*") % 2).cast("string"), F.lit(" ]")).alias("features"))


@query("SELECT l_returnflag AS letter, 's' || min(l_linestatus) || ' t' || max(l_linestatus) || ' n' || (count(*) % 2) AS features FROM lineitem GROUP BY l_returnflag")
def read_letter_features(spark, sf_dir):
    path = new_path(spark, "features")
    flag_features(spark, sf_dir).write.csv(path, header=True)
    return letters_text(files.read_letter_features(spark, path, model.build_alphabet(order_sequences(spark, sf_dir))), "features")


def brand_weights(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.concat(F.lit("brand("), "p_brand", F.lit(")")).alias("feature")).agg(F.sum("p_size").cast("double").alias("weight"))


@query("SELECT 'brand(' || p_brand || ')' AS feature, CAST(sum(p_size) AS DOUBLE) AS weight, CAST(sum(p_size) AS DOUBLE) AS center FROM part GROUP BY p_brand")
def init_weights(spark, sf_dir):
    """Weights to start from, of a file, and the penalty's centers, the same as these."""
    path = new_path(spark, "weights")
    files.write_weights(brand_weights(spark, sf_dir), path)
    start = training.init_weights(spark, path)
    return start.join(training.regularization_centers(spark, "SAME", start).withColumnRenamed("weight", "center"), "feature")


@query("SELECT 'brand(' || p_brand || ')' AS feature, CAST(sum(p_size) AS DOUBLE) AS weight FROM part GROUP BY p_brand")
def read_weights(spark, sf_dir):
    path = new_path(spark, "weights")
    files.write_weights(brand_weights(spark, sf_dir), path)
    return files.read_weights(spark, path)


@query("SELECT CAST(row_number() OVER (ORDER BY sum(p_size) DESC, 'brand(' || p_brand || ')') AS INTEGER) AS line, 'brand(' || p_brand || ')' AS feature, CAST(sum(p_size) AS DOUBLE) AS weight FROM part GROUP BY p_brand")
def write_weights(spark, sf_dir):
    path = new_path(spark, "weights")
    files.write_weights(brand_weights(spark, sf_dir), path)
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim(F.col("value"), F.lit("\n")), "\n")).alias("line", "value"))
    return whole.select((F.col("line") + 1).alias("line"), F.split("value", "\t")[0].alias("feature"), F.split("value", "\t")[1].cast("double").alias("weight"))


_SUPPORT = """letters AS (SELECT DISTINCT l_returnflag AS letter FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
sym AS (SELECT CAST(row_number() OVER (ORDER BY letter) - 1 AS INTEGER) AS id, letter AS name, 'letter' AS kind FROM letters
  UNION ALL SELECT CAST((SELECT count(*) FROM letters) AS INTEGER), '#', 'boundary' UNION ALL SELECT CAST((SELECT count(*) FROM letters) + 1 AS INTEGER), '-', 'gap'),
emitted AS (SELECT a.id AS top_sym, b.id AS bot_sym, a.name AS top_name, b.name AS bot_name,
  CASE WHEN a.kind = b.kind AND a.kind <> 'gap' THEN 0 WHEN a.kind = 'gap' AND b.kind = 'letter' THEN 1 WHEN a.kind = 'letter' AND b.kind = 'gap' THEN 2 END AS state2 FROM sym a, sym b),
support AS (SELECT s.state1, state2, top_sym, bot_sym, top_name, bot_name FROM emitted, (VALUES (0), (1), (2)) s(state1) WHERE state2 IS NOT NULL AND NOT (s.state1 = 2 AND state2 = 1))"""


@query(f"WITH {_SUPPORT} SELECT state1, 0 AS stat, state2, top_sym, bot_sym, round(1.0 / count(*) OVER (PARTITION BY state1), 9) AS probability FROM support")
def export_model_table(spark, sf_dir):
    alphabet = model.build_alphabet(order_sequences(spark, sf_dir))
    got = model.export_model_table(model.transition_logprobs(model.transition_features(alphabet), training.zero_weights(spark)))
    return got.withColumn("probability", rounded("probability"))


@query("""WITH cells AS (SELECT n_name, c_mktsegment, count(*) AS n, sum(CAST(c_acctbal AS BIGINT)) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT c_mktsegment AS group_id, n_name AS sequence_id, 'l' || (n % 4) || ' l' || (abs(s) % 4) AS letters FROM cells""")
def convert_cognate_table(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    token = lambda v: F.concat(F.lit("[f"), (v % 4).cast("string"), F.lit(" g]"))
    # The balance is cut to a whole number as SQL rounds it.
    cell = F.concat(F.lit("("), token(F.count(F.lit(1))), F.lit(")-"), token(F.abs(F.sum(F.rint("c_acctbal").cast("long")))), F.lit(" note"))
    wide = joined.groupBy(F.col("n_name").alias("language")).pivot("c_mktsegment").agg(cell)
    table_of = spark.range(4).select(F.concat(F.lit("[f"), F.col("id").cast("string"), F.lit(" g]")).alias("features"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("letter"))
    return files.convert_cognate_table(wide, table_of, "language")


@query(f"WITH {COLS}, {edges_sql('gold')} SELECT * FROM edges_gold")
def parse_edge_literal(spark, sf_dir):
    e = A.edges_of_alignment(gold(spark, sf_dir))
    text = F.concat(F.lit("(("), F.col("pos2").cast("string"), F.lit(", "), "seq2", F.lit("), ("), F.col("pos1").cast("string"), F.lit(", "), "seq1", F.lit("))"))
    return e.select("aln_id", L.parse_edge_literal(text).alias("e")).select("aln_id", "e.*")


@query(f"""WITH {SEQ}{_PADDED}, t AS (SELECT unnest(['0.0', '0.5']) AS threshold)
SELECT CAST(threshold AS DOUBLE) AS threshold, aln_id, string_agg('>' || sequence_id || chr(10) || r, chr(10) ORDER BY sequence_id) AS fasta, string_agg(r || '|' || sequence_id, chr(10) ORDER BY sequence_id) AS rows FROM padded, t GROUP BY threshold, aln_id""")
def write_iteration_outputs(spark, sf_dir):
    """Both texts of every alignment at two thresholds, read back."""
    s = order_sequences(spark, sf_dir)
    columns = gold(spark, sf_dir, s).withColumn("threshold", F.explode(F.array(F.lit(0.0), F.lit(0.5))))
    path = new_path(spark, "iteration")
    files.write_iteration_outputs(columns, s, brand_weights(spark, sf_dir), path, 0)
    fasta, text = (files.read_bundles(spark, f"{path}/iteration=0/{kind}") for kind in ("fasta", "text"))
    both = fasta.withColumnRenamed("value", "fasta").join(text.withColumnRenamed("value", "rows"), ["threshold", "aln_id"])
    return both.select(F.col("threshold").cast("double").alias("threshold"), "aln_id", "fasta", "rows")


# --- projections, filters, functions ----------------------------------------


@query(f"WITH {RES} SELECT aln_id AS group_id, sequence_id, pos, letter FROM res")
def explode_residue_rows(spark, sf_dir):
    return explode_residues(order_sequences(spark, sf_dir))


@query("SELECT c_custkey, len(c_name) AS n, c_name[1:1] AS first, array_to_string([c_name[i] FOR i IN range(1, len(c_name) + 1)], ' ') AS letters FROM customer")
def chars_to_letters(spark, sf_dir):
    got = table(spark, sf_dir, "customer").select("c_custkey", L.chars_to_letters(F.col("c_name")).alias("letters"))
    return got.select("c_custkey", F.size("letters").cast("long").alias("n"), F.col("letters")[0].alias("first"), F.array_join("letters", " ").alias("letters"))


@query(f"WITH {SCORED} SELECT aln_id, seq1, pos1, seq2, pos2 FROM scored")
def canonical_edges(spark, sf_dir):
    e = scored(spark, sf_dir).select("aln_id", F.col("seq2").alias("seq1"), F.col("pos2").alias("pos1"), F.col("seq1").alias("seq2"), F.col("pos1").alias("pos2"))
    return A.canonical_edges(e)


@query(f"WITH {SEQ} SELECT group_id, sequence_id, array_to_string(letters[2:3], ' ') AS middle, array_to_string(list_append(letters, '#'), ' ') AS extended FROM seq")
def subsequence_and_append(spark, sf_dir):
    s = order_sequences(spark, sf_dir)
    return s.select("group_id", "sequence_id", F.array_join(L.subsequence(F.col("letters"), 1, 3), " ").alias("middle"), F.array_join(L.append_letter(F.col("letters"), "#"), " ").alias("extended"))


@query(f"""WITH {COLS}, kept AS (SELECT * FROM gold WHERE CAST(sequence_id AS BIGINT) % 2 = 0)
SELECT aln_id, first_value(sequence_id || ':' || pos) OVER (PARTITION BY aln_id, column_id ORDER BY sequence_id) AS column_id, sequence_id, pos FROM kept""")
def restrict_alignment(spark, sf_dir):
    s = order_sequences(spark, sf_dir)
    ids = s.where(F.col("sequence_id").cast("long") % 2 == 0).select(F.col("group_id").alias("aln_id"), "sequence_id")
    return A.restrict_alignment(gold(spark, sf_dir, s), ids)


@query(f"WITH {SCORED} SELECT * FROM scored WHERE score > 0.45")
def filter_edges_by_score(spark, sf_dir):
    return A.filter_edges_by_score(scored(spark, sf_dir), 0.45)


@query(f"WITH {SCORED} SELECT CAST(k AS INTEGER) AS k, 1 - pow(2.0, -k) AS threshold, count(aln_id) AS n FROM range(6) g(k) LEFT JOIN scored ON score > 1 - pow(2.0, -k) GROUP BY k")
def threshold_grid(spark, sf_dir):
    return A.threshold_grid(spark, 6).join(scored(spark, sf_dir), F.col("score") > F.col("threshold"), "left").groupBy("k", "threshold").agg(F.count("aln_id").alias("n"))


@query("SELECT l_returnflag AS letter, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY 1")
def validate_letters(spark, sf_dir):
    s = order_sequences(spark, sf_dir)
    return model.validate_letters(s, model.build_alphabet(s).where("letter <> 'R'"))


def derived(spark, sf_dir) -> DataFrame:
    """A derivation for each pair: position y from position y, while the top lasts."""
    s = order_sequences(spark, sf_dir)
    p = pairs.sequence_pairs(s.withColumnRenamed("letters", "ids"))
    return p.select("group_id", "top_id", "bot_id", "top", "bot", F.transform("bot", lambda _, y: F.when(y < F.size("top"), y).otherwise(-1)).alias("ancestors"))


DERIVED = SEQ + """, derived AS (SELECT a.group_id, a.sequence_id AS top_id, b.sequence_id AS bot_id, a.letters AS top, b.letters AS bot,
  [CASE WHEN y < len(a.letters) THEN CAST(y AS INTEGER) ELSE -1 END FOR y IN range(len(b.letters))] AS ancestors
  FROM seq a JOIN seq b ON a.group_id = b.group_id AND a.sequence_id < b.sequence_id)"""


@query(f"""WITH {DERIVED} SELECT group_id, top_id, bot_id, array_to_string([CASE WHEN x < len(bot) THEN x ELSE -1 END FOR x IN range(len(top))], ' ') AS inverted,
  true AS monotonic, least(len(top), len(bot)) < 2 AS reversed_monotonic, '[' || array_to_string([CASE WHEN a < 0 THEN 'X' ELSE CAST(a AS VARCHAR) END FOR a IN ancestors], ', ') || ']' AS shown FROM derived""")
def derivation_functions(spark, sf_dir):
    a = F.col("ancestors")
    return derived(spark, sf_dir).select("group_id", "top_id", "bot_id", F.array_join(L.derivation_invert(a, F.size("top")).cast("array<string>"), " ").alias("inverted"), L.derivation_is_monotonic(a).alias("monotonic"), L.derivation_is_monotonic(F.reverse(a)).alias("reversed_monotonic"), L.derivation_to_string(a).alias("shown"))


@query(f"WITH {DERIVED} SELECT group_id, top_id, bot_id, len(ancestors) AS n, array_to_string(bot, ' ') AS current FROM derived")
def remove_boundary(spark, sf_dir):
    d = derived(spark, sf_dir)
    cut = L.remove_boundary(F.array_append("ancestors", F.size("top")), F.array_append("top", F.lit("#")), F.array_append("bot", F.lit("#")))
    return d.select("group_id", "top_id", "bot_id", cut.alias("d")).select("group_id", "top_id", "bot_id", F.size("d.ancestors").cast("long").alias("n"), F.array_join("d.current_letters", " ").alias("current"))


@query(f"WITH {DERIVED} SELECT group_id AS aln_id, top_id AS seq1, CAST(y AS INTEGER) AS pos1, bot_id AS seq2, CAST(y AS INTEGER) AS pos2 FROM (SELECT *, unnest(range(least(len(top), len(bot)))) AS y FROM derived)")
def derivation_to_edges(spark, sf_dir):
    return pairs.derivation_to_edges(derived(spark, sf_dir))


# --- joins ------------------------------------------------------------------


@query(f"WITH {DERIVED} SELECT group_id, top_id, bot_id, array_to_string(top, ' ') AS top, array_to_string(bot, ' ') AS bot FROM derived")
def sequence_pairs(spark, sf_dir):
    p = pairs.sequence_pairs(order_sequences(spark, sf_dir).withColumnRenamed("letters", "ids"))
    return letters_text(letters_text(p.drop("stat"), "top"), "bot")


@query(f"WITH {SEQ} SELECT DISTINCT a.sequence_id AS id1, b.sequence_id AS id2 FROM seq a JOIN seq b ON a.group_id = b.group_id AND a.sequence_id < b.sequence_id")
def taxa_pairs(spark, sf_dir):
    return pairs.taxa_pairs(order_sequences(spark, sf_dir))


@query(f"WITH {COLS}, {edges_sql('gold')} SELECT * FROM edges_gold")
def edges_of_alignment(spark, sf_dir):
    return A.edges_of_alignment(gold(spark, sf_dir))


@query(f"WITH {COLS}, {edges_sql('gold')} SELECT e.*, a.column_id = b.column_id AS contained FROM edges_gold e JOIN guess a ON a.aln_id = e.aln_id AND a.sequence_id = seq1 AND a.pos = pos1 JOIN guess b ON b.aln_id = e.aln_id AND b.sequence_id = seq2 AND b.pos = pos2")
def contains_edge(spark, sf_dir):
    s = order_sequences(spark, sf_dir)
    return A.contains_edge(guess(spark, sf_dir, s), A.edges_of_alignment(gold(spark, sf_dir, s)))


@query(f"WITH {COLS} SELECT aln_id, column_id, sequence_id, letter FROM gold JOIN res USING (aln_id, sequence_id, pos)")
def char_at(spark, sf_dir):
    s = order_sequences(spark, sf_dir)
    return A.char_at(gold(spark, sf_dir, s), explode_residues(s))


@query(f"WITH {COLS} SELECT aln_id, sequence_id, pos, column_id FROM gold")
def column_of(spark, sf_dir):
    s = order_sequences(spark, sf_dir)
    rows = explode_residues(s).select(F.col("group_id").alias("aln_id"), "sequence_id", "pos")
    return A.column_of(gold(spark, sf_dir, s), rows)


_FEATURES = "feat AS (SELECT l_returnflag AS letter, 's' || min(l_linestatus) || ' t' || max(l_linestatus) || ' n' || (count(*) % 2) AS features FROM lineitem GROUP BY l_returnflag)"


@query(f"WITH {_SUPPORT}, {_FEATURES} SELECT state1, state2, top_sym, bot_sym, a.features AS top_features, b.features AS bot_features FROM support LEFT JOIN feat a ON a.letter = top_name LEFT JOIN feat b ON b.letter = bot_name")
def letter_feature_lookup(spark, sf_dir):
    alphabet = model.build_alphabet(order_sequences(spark, sf_dir))
    listed = flag_features(spark, sf_dir).select(F.col("input").alias("letter"), F.split(F.regexp_replace("features", r"\[ | \]", ""), " ").alias("features"))
    got = model.letter_feature_lookup(model.transition_support(alphabet), alphabet, listed)
    return letters_text(letters_text(got, "top_features"), "bot_features").select("state1", "state2", "top_sym", "bot_sym", "top_features", "bot_features")


_SIGNED = "{0}_sig AS (SELECT aln_id, column_id, string_agg(sequence_id || ':' || pos, ',' ORDER BY sequence_id) AS sig FROM {0} GROUP BY ALL)"


@query(f"WITH {COLS}, {_SIGNED.format('gold')}, {_SIGNED.format('guess')} SELECT aln_id, column_id FROM gold_sig a WHERE EXISTS (SELECT 1 FROM guess_sig b WHERE a.aln_id = b.aln_id AND a.sig = b.sig)")
def shared_columns(spark, sf_dir):
    s = order_sequences(spark, sf_dir)
    return A.shared_columns(gold(spark, sf_dir, s), guess(spark, sf_dir, s))


# --- aggregations -----------------------------------------------------------


@query("""WITH one AS (SELECT CAST(user_id AS VARCHAR) AS group_id, event_type AS sequence_id, CAST(max(event_id) AS VARCHAR) AS letters, min(event_id) AS line FROM events GROUP BY ALL)
SELECT group_id, sequence_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY line) - 1 AS INTEGER) AS ord, letters FROM one""")
def dedupe_sequences(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("group_id"), F.col("event_type").alias("sequence_id"), F.col("event_id").alias("line_no"), F.array(F.col("event_id").cast("string")).alias("letters"))
    return letters_text(files.dedupe_sequences(rows))


@query("SELECT letter, CAST(row_number() OVER (ORDER BY letter) - 1 AS INTEGER) AS letter_id, longest FROM (SELECT DISTINCT event_type AS letter, CAST(max(len(event_type)) OVER () AS INTEGER) AS longest FROM events)")
def build_alphabet(spark, sf_dir):
    s = event_sequences(spark, sf_dir)
    return model.build_alphabet(s).join(model.longest_letter(s), F.lit(True))


@query(f"WITH {COLS}, sizes AS (SELECT aln_id, column_id, count(*) AS n FROM gold GROUP BY ALL) SELECT aln_id, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS n_edges FROM sizes GROUP BY aln_id")
def n_edges(spark, sf_dir):
    return M.n_edges(gold(spark, sf_dir))


@query(f"WITH {SEQ} SELECT group_id AS aln_id, count(*) AS n_sequences, round(avg(len(letters)), 9) AS mean_length FROM seq GROUP BY 1")
def sequence_summary(spark, sf_dir):
    return M.sequence_summary(order_sequences(spark, sf_dir)).withColumn("mean_length", rounded("mean_length"))


def _pair_sql(letters: bool, of: str = "gold") -> str:
    same = "AND a.letter = b.letter" if letters else ""
    return f"""WITH {COLS}, cell AS (SELECT g.*, letter, n FROM {of} g JOIN res USING (aln_id, sequence_id, pos)),
hits AS (SELECT a.aln_id, a.sequence_id AS t1, b.sequence_id AS t2, count(*) AS h FROM cell a JOIN cell b ON a.aln_id = b.aln_id AND a.column_id = b.column_id AND a.sequence_id <> b.sequence_id {same} GROUP BY ALL),
stat AS (SELECT a.group_id AS aln_id, a.sequence_id AS t1, b.sequence_id AS t2, coalesce(h, 0) / len(a.letters) AS value
  FROM seq a JOIN seq b ON a.group_id = b.group_id AND a.sequence_id <> b.sequence_id LEFT JOIN hits ON hits.aln_id = a.group_id AND t1 = a.sequence_id AND t2 = b.sequence_id)"""


@query(_pair_sql(False) + " SELECT aln_id, t1, t2, round(value, 9) AS value FROM stat")
def pair_statistic(spark, sf_dir):
    s = order_sequences(spark, sf_dir)
    return M.pair_statistic(gold(spark, sf_dir, s), s).withColumn("value", rounded("value"))


_MEAN = " SELECT group_id AS aln_id, coalesce(round(avg(value), 9), 'NaN'::DOUBLE) AS value FROM (SELECT DISTINCT group_id FROM seq) LEFT JOIN stat ON aln_id = group_id GROUP BY 1"


@query(_pair_sql(False) + _MEAN)
def aligned_statistic(spark, sf_dir):
    s = order_sequences(spark, sf_dir)
    return M.mean_pair_statistic(gold(spark, sf_dir, s), s).withColumn("value", rounded("value"))


@query(_pair_sql(True) + _MEAN)
def identity_statistic(spark, sf_dir):
    s = order_sequences(spark, sf_dir)
    return M.mean_pair_statistic(gold(spark, sf_dir, s), s, identical=True).withColumn("value", rounded("value"))


_ACCURACY = f"""WITH {COLS}, {edges_sql('gold')}, {edges_sql('guess')}, {_SIGNED.format('gold')}, {_SIGNED.format('guess')},
hits AS (SELECT aln_id, count(*) AS h FROM edges_gold JOIN edges_guess USING (aln_id, seq1, pos1, seq2, pos2) GROUP BY 1),
a AS (SELECT aln_id, count(*) AS n FROM edges_gold GROUP BY 1), b AS (SELECT aln_id, count(*) AS n FROM edges_guess GROUP BY 1),
cols AS (SELECT g.aln_id, count(*) AS n, count(s.sig) AS h FROM gold_sig g LEFT JOIN guess_sig s ON g.aln_id = s.aln_id AND g.sig = s.sig WHERE contains(g.sig, ',') GROUP BY 1),
every AS (SELECT DISTINCT aln_id FROM res),
acc AS (SELECT aln_id, coalesce(h, 0) / nullif(coalesce(a.n, 0), 0) AS recall, coalesce(h, 0) / nullif(coalesce(b.n, 0), 0) AS prec FROM every LEFT JOIN hits USING (aln_id) LEFT JOIN a USING (aln_id) LEFT JOIN b USING (aln_id))
SELECT aln_id, coalesce(round(recall, 9), 'NaN'::DOUBLE) AS edge_recall, coalesce(round(prec, 9), 'NaN'::DOUBLE) AS edge_precision,
  CASE WHEN recall IS NULL OR prec IS NULL THEN 'NaN'::DOUBLE WHEN recall + prec = 0 THEN 0.0 ELSE round(2 * recall * prec / (recall + prec), 9) END AS edge_f1,
  CASE WHEN cols.n IS NULL THEN 'NaN'::DOUBLE ELSE round(cols.h / cols.n, 9) END AS column_recall
FROM acc LEFT JOIN cols USING (aln_id)"""


@query(_ACCURACY)
def accuracy(spark, sf_dir):
    s = order_sequences(spark, sf_dir)
    got = M.accuracy(gold(spark, sf_dir, s), guess(spark, sf_dir, s))
    return got.select("aln_id", *[rounded(c).alias(c) for c in ("edge_recall", "edge_precision", "edge_f1", "column_recall")])


@query(f"WITH {COLS} SELECT aln_id, bool_and(gold.column_id = guess.column_id) AS equal FROM gold JOIN guess USING (aln_id, sequence_id, pos) GROUP BY 1")
def alignments_equal(spark, sf_dir):
    s = order_sequences(spark, sf_dir)
    return M.alignments_equal(gold(spark, sf_dir, s), guess(spark, sf_dir, s), s, s)


@query(f"""SELECT * FROM (WITH {SEQ} SELECT group_id AS aln_id, count(*) AS n_sequences, round(avg(len(letters)), 9) AS mean_length FROM seq GROUP BY 1)
LEFT JOIN (WITH {COLS}, sizes AS (SELECT aln_id, column_id, count(*) AS n FROM guess GROUP BY ALL) SELECT aln_id, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS n_edges FROM sizes GROUP BY 1) USING (aln_id)
LEFT JOIN (SELECT aln_id, value AS aligned FROM ({_pair_sql(False, 'guess')}{_MEAN})) USING (aln_id)
LEFT JOIN (SELECT aln_id, value AS identity FROM ({_pair_sql(True, 'guess')}{_MEAN})) USING (aln_id)
LEFT JOIN ({_ACCURACY}) USING (aln_id)""")
def alignment_report(spark, sf_dir):
    s = order_sequences(spark, sf_dir)
    got = M.alignment_report(guess(spark, sf_dir, s), s, gold(spark, sf_dir, s))
    return got.select(*[rounded(n).alias(n) if t == "double" else n for n, t in got.dtypes])


# --- windows, order ---------------------------------------------------------


@query(f"WITH {COLS}, n AS (SELECT *, first_value(sequence_id) OVER w AS seq1, first_value(pos) OVER w AS pos1 FROM gold WINDOW w AS (PARTITION BY aln_id, column_id ORDER BY sequence_id)) SELECT aln_id, seq1, pos1, sequence_id AS seq2, pos AS pos2 FROM n WHERE seq1 <> sequence_id")
def spanning_edges(spark, sf_dir):
    return A.spanning_edges(gold(spark, sf_dir))


@query(f"WITH {RES} SELECT aln_id, sequence_id, CAST(m - n + pos AS INTEGER) AS col, pos, letter FROM (SELECT *, max(n) OVER (PARTITION BY aln_id) AS m FROM res)")
def gapped_to_positions(spark, sf_dir):
    s = order_sequences(spark, sf_dir)
    text = files.fasta_text(guess(spark, sf_dir, s), s)
    rows = files.fasta_rows(text.select("aln_id", F.posexplode(F.split("value", "\n")).alias("line_no", "line")))
    return A.gapped_to_positions(rows.select("aln_id", "sequence_id", F.posexplode(F.split("gapped", "")).alias("col", "letter")))


@query(f"WITH {COLS} SELECT DISTINCT * FROM (SELECT aln_id, column_id AS src, lead(column_id) OVER (PARTITION BY aln_id, sequence_id ORDER BY pos) AS dst FROM guess) WHERE dst IS NOT NULL")
def column_arcs(spark, sf_dir):
    return A.column_arcs(guess(spark, sf_dir))


@query(f"WITH {RES} SELECT aln_id, sequence_id, pos, CAST(row_number() OVER (PARTITION BY aln_id ORDER BY pos / (1 + n), sequence_id, pos) - 1 AS INTEGER) AS place FROM res")
def initial_linearization(spark, sf_dir):
    return A.initial_linearization(order_sequences(spark, sf_dir))


@query(f"""WITH {SCORED}, w AS (SELECT *, lag(pos1) OVER o AS p1, lag(pos2) OVER o AS p2 FROM scored WINDOW o AS (PARTITION BY aln_id, seq1, seq2 ORDER BY pos1, pos2))
SELECT aln_id, seq1, pos1, seq2, pos2, score FROM w WHERE pos1 = p1 OR pos2 <= p2""")
def crossing_edges(spark, sf_dir):
    return A.crossing_edges(scored(spark, sf_dir))


@query(f"WITH {SCORED} SELECT *, CAST(row_number() OVER (PARTITION BY aln_id ORDER BY score DESC, seq1, pos1, seq2, pos2) AS INTEGER) AS rank FROM scored")
def rank_edges(spark, sf_dir):
    return A.rank_edges(scored(spark, sf_dir))


@query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY aln_id ORDER BY score DESC, seq1, pos1, seq2, pos2) AS k, count(*) OVER (PARTITION BY aln_id) AS n FROM scored)
SELECT aln_id, seq1, pos1, seq2, pos2, score, CAST(k AS INTEGER) AS k FROM r WHERE k = n OR k % greatest(n // 4, 1) = 0""")
def roc_sample_points(spark, sf_dir):
    return C.roc_sample_points(A.rank_edges(scored(spark, sf_dir)).withColumnRenamed("rank", "k"), 4)


@query(f"WITH {COLS} SELECT DISTINCT aln_id, column_id, CAST(pos AS INTEGER) AS place FROM gold")
def linearize_columns(spark, sf_dir):
    """Columns set flush left have one order only."""
    return A.linearize_columns(gold(spark, sf_dir))


_SPLIT = f"""WITH RECURSIVE {COLS}, n AS (SELECT *, count(*) OVER (PARTITION BY aln_id, column_id) AS n, min(sequence_id) OVER (PARTITION BY aln_id, column_id) AS low FROM gold),
s AS (SELECT *, n > 1 AND sequence_id = low AS side FROM n),
parted AS (SELECT aln_id, first_value(sequence_id || ':' || pos) OVER (PARTITION BY aln_id, column_id, side ORDER BY sequence_id) AS column_id, sequence_id, pos FROM s)"""


@query(_SPLIT + """, arcs AS (SELECT DISTINCT * FROM (SELECT aln_id, column_id AS src, lead(column_id) OVER (PARTITION BY aln_id, sequence_id ORDER BY pos) AS dst FROM parted) WHERE dst IS NOT NULL),
walk AS (SELECT DISTINCT aln_id, column_id, 0 AS depth FROM parted UNION SELECT w.aln_id, a.dst, depth + 1 FROM walk w JOIN arcs a ON a.aln_id = w.aln_id AND a.src = w.column_id)
SELECT aln_id, column_id, CAST(row_number() OVER (PARTITION BY aln_id ORDER BY max(depth), column_id) - 1 AS INTEGER) AS place FROM walk GROUP BY aln_id, column_id""")
def linearize_split_columns(spark, sf_dir):
    """Columns of which the least sequence is set apart have many orders: by depth, then id."""
    return A.linearize_columns(split_column(spark, sf_dir))


@query(f"WITH {COLS} SELECT 'all' AS aln_id, column_id, CAST(row_number() OVER (ORDER BY pos, column_id) - 1 AS INTEGER) AS place FROM (SELECT DISTINCT column_id, pos FROM gold)")
def linearize_one_alignment(spark, sf_dir):
    """All columns of all groups as one alignment, peeled over all tasks."""
    return A.linearize_columns(in_one_alignment(gold(spark, sf_dir)), alone=0)


@query(f"WITH {SEQ}{_PADDED} SELECT aln_id, sequence_id, r AS row FROM padded")
def render_alignment(spark, sf_dir):
    s = order_sequences(spark, sf_dir)
    g = gold(spark, sf_dir, s)
    return A.render_alignment(g, s, A.linearize_columns(g))


# --- sets -------------------------------------------------------------------


@query(f"WITH {COLS} SELECT * FROM gold")
def union_alignments(spark, sf_dir):
    """Two halves of an alignment's links, united."""
    s = order_sequences(spark, sf_dir)
    columns, residues = gold(spark, sf_dir, s), explode_residues(s).select(F.col("group_id").alias("aln_id"), "sequence_id", "pos")
    even = A.spanning_edges(columns).where("pos1 % 2 = 0")
    odd = A.spanning_edges(columns).where("pos1 % 2 = 1")
    united = A.union_alignments(C.columns_from_edges(residues, even), C.columns_from_edges(residues, odd))
    return united.where("valid").drop("valid")


@query(f"WITH {COLS} SELECT gold.aln_id, column_id, sequence_id, pos FROM gold JOIN (SELECT group_id, sequence_id AS s, row_number() OVER (PARTITION BY group_id ORDER BY sequence_id) - 1 AS ord FROM seq) o ON o.group_id = aln_id AND s = sequence_id")
def union_of_overlapping(spark, sf_dir):
    """The alignments of each group's even and odd sequences, both with its longest one, whose
    letters must be the same and which links the two."""
    s = order_sequences(spark, sf_dir)
    longest = F.max(F.struct(F.size("letters").alias("n"), F.col("ord")))
    first = s.groupBy("group_id").agg(longest.alias("m")).select("group_id", F.col("m.ord").alias("_ord"))
    even, odd = (s.join(first, "group_id").where((F.col("ord") == F.col("_ord")) | (F.col("ord") % 2 == r)).drop("_ord") for r in (0, 1))
    united = A.union_alignments(justified(even), justified(odd), sequences=(even, odd))
    return united.where("valid").drop("valid")


@query(f"WITH {SEQ} SELECT group_id AS aln_id, min(len(letters)) = max(len(letters)) AS valid FROM seq GROUP BY 1")
def union_conflicts(spark, sf_dir):
    """Flush left and flush right, united: sequences of unlike length cannot have both."""
    s = order_sequences(spark, sf_dir)
    return A.union_alignments(justified(s), justified(s, left=False)).select("aln_id", "valid").distinct()


@query(_SPLIT + " SELECT * FROM parted")
def split_column(spark, sf_dir):
    """The least sequence of every column is set apart."""
    g = gold(spark, sf_dir)
    low = g.groupBy("aln_id", "column_id").agg(F.min("sequence_id").alias("sequence_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return A.split_column(g, low)


@query(_SPLIT + """, ids AS (SELECT aln_id, column_id, list(sequence_id) AS ids FROM parted GROUP BY ALL)
SELECT a.aln_id, a.column_id AS column_a, b.column_id AS column_b FROM ids a JOIN ids b ON a.aln_id = b.aln_id AND a.column_id < b.column_id WHERE NOT list_has_any(a.ids, b.ids)""")
def disjoint_columns(spark, sf_dir):
    return A.disjoint_columns(None, split_column(spark, sf_dir))


@query(f"""WITH {COLS}, {edges_sql('gold')}, {edges_sql('guess')}
SELECT aln_id, seq1, pos1, seq2, pos2, CASE WHEN b.h IS NULL THEN 'gold' WHEN a.h IS NULL THEN 'guess' ELSE 'both' END AS side
FROM (SELECT *, 1 AS h FROM edges_gold) a FULL JOIN (SELECT *, 1 AS h FROM edges_guess) b USING (aln_id, seq1, pos1, seq2, pos2)""")
def edge_set_diff(spark, sf_dir):
    s = order_sequences(spark, sf_dir)
    return A.edge_set_diff(gold(spark, sf_dir, s), guess(spark, sf_dir, s))


# --- construction -----------------------------------------------------------


@query(f"WITH {SEQ}, n AS (SELECT group_id AS aln_id, len(letters) AS n, row_number() OVER (PARTITION BY group_id ORDER BY sequence_id) AS k FROM seq) SELECT aln_id, NOT (max(n) FILTER (k = 1) > 1 AND coalesce(max(n) FILTER (k > 1), 0) > 1) AS valid FROM n GROUP BY 1")
def validate_alignment(spark, sf_dir):
    """Flush left, but the first sequence runs backwards: a cycle with any other of two letters."""
    rows = order_sequences(spark, sf_dir).select(F.col("group_id").alias("aln_id"), "sequence_id", "ord", F.size("letters").alias("_n"), F.posexplode("letters").alias("pos", "letter"))
    at = F.when(F.col("ord") == 0, F.col("_n") - 1 - F.col("pos")).otherwise(F.col("pos"))
    return C.validate_alignment(named_columns(rows.withColumn("_at", at), "_at"))


@query(f"WITH {COLS} SELECT * FROM guess")
def columns_from_edges(spark, sf_dir):
    g = guess(spark, sf_dir)
    return C.columns_from_edges(g.select("aln_id", "sequence_id", "pos"), A.spanning_edges(g))


@query("SELECT 'all' AS aln_id, true AS valid")
def validate_one_alignment(spark, sf_dir):
    """All columns of all groups as one alignment, peeled over all tasks."""
    return C.validate_alignment(in_one_alignment(guess(spark, sf_dir)), alone=0)


@query(f"WITH {COLS} SELECT 'all' AS aln_id, column_id, sequence_id, pos FROM guess")
def columns_of_one_alignment(spark, sf_dir):
    """Every link of the table in one alignment."""
    g = in_one_alignment(guess(spark, sf_dir))
    return C.columns_from_edges(g.select("aln_id", "sequence_id", "pos"), A.spanning_edges(g))


@query(f"""WITH {SCORED}, ends AS (SELECT DISTINCT sequence_id, n FROM res)
SELECT s.aln_id, seq1, pos1, seq2, pos2, CASE WHEN pos1 = 0 AND pos2 = 0 THEN true WHEN pos1 = 0 THEN a.n = 1 WHEN pos2 = 0 THEN b.n = 1 ELSE pos1 > 1 AND pos2 > 1 END AS valid
FROM scored s JOIN ends a ON a.sequence_id = seq1 JOIN ends b ON b.sequence_id = seq2""")
def is_valid_addition_about_a_column(spark, sf_dir):
    """To an alignment of the second positions: a link across that column closes a cycle,
    unless one of its sequences ends before."""
    s = order_sequences(spark, sf_dir)
    return C.is_valid_addition(s, scored(spark, sf_dir, s), gold(spark, sf_dir, s).where("pos = 1"))


@query(f"""WITH {SCORED}, low AS (SELECT aln_id, pos, min(sequence_id) AS seq1 FROM res GROUP BY ALL)
SELECT s.aln_id, s.seq1, pos1, seq2, pos2, pos1 = pos2 AND pos1 > 0 AND s.seq1 = low.seq1 AS accepted FROM scored s JOIN low ON low.aln_id = s.aln_id AND low.pos = pos1""")
def try_adding_edges(spark, sf_dir):
    """Links of equal positions come first, by position, to an alignment of the first
    positions: each column's least sequence takes the others, which are linked by then;
    all other links would part a column."""
    s = order_sequences(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("aln_id").orderBy(F.col("pos1") != F.col("pos2"), "pos1", "seq1", "seq2", "pos2"))
    edges = scored(spark, sf_dir, s).drop("score").withColumn("rank", rank)
    return C.try_adding_edges(s, edges, gold(spark, sf_dir, s).where("pos = 0"))


@query(f"WITH {SCORED} SELECT aln_id, seq1, pos1, seq2, pos2, pos1 > 0 AND pos2 > 0 AS valid FROM scored")
def is_valid_addition(spark, sf_dir):
    """To an alignment of the first positions: each other position stands free."""
    s = order_sequences(spark, sf_dir)
    return C.is_valid_addition(s, scored(spark, sf_dir, s), gold(spark, sf_dir, s).where("pos = 0"))


@query(greedy_sql("score > 0.45") + f" SELECT d.aln_id, {_MERGED} LEFT JOIN accepted a ON {_LINKED}")
def consensus_alignment_of_duets(spark, sf_dir):
    s = duets(spark, sf_dir)
    return C.consensus_alignment(s, scored(spark, sf_dir, s), 0.45)


@query(greedy_sql("score > 0") + f" SELECT d.aln_id, {_MERGED} LEFT JOIN accepted a ON {_LINKED}")
def max_recall_alignment_of_duets(spark, sf_dir):
    s = duets(spark, sf_dir)
    return C.max_recall_alignment(s, scored(spark, sf_dir, s))


@query(greedy_sql("score > 0") + f", t AS (SELECT unnest([0.0::DOUBLE, 0.5, 0.75]) AS threshold) SELECT threshold, d.aln_id, {_MERGED} CROSS JOIN t LEFT JOIN accepted a ON {_LINKED} AND a.score > threshold")
def consensus_grid_of_duets(spark, sf_dir):
    s = duets(spark, sf_dir)
    return C.consensus_grid(s, scored(spark, sf_dir, s), [0.0, 0.5, 0.75])


@query(greedy_sql("true") + """, path AS (SELECT *, row_number() OVER w AS c, sum(CAST(pos1 = pos2 AS INTEGER)) OVER w AS shared, count(*) OVER (PARTITION BY aln_id) AS n FROM accepted WINDOW w AS (PARTITION BY aln_id ORDER BY k))
SELECT aln_id, CAST(c AS INTEGER) AS k, round(shared / c, 9) AS precision, round(shared / shorter, 9) AS recall, score AS posterior FROM path WHERE c = n OR c % greatest(n // 10, 1) = 0""")
def roc_curve_of_duets(spark, sf_dir):
    s = duets(spark, sf_dir)
    got = C.roc_curve(s, scored(spark, sf_dir, s), justified(s), 10)
    return got.select("aln_id", "k", rounded("precision").alias("precision"), rounded("recall").alias("recall"), "posterior")


@query()
def consensus_alignment(spark, sf_dir):
    s = order_sequences(spark, sf_dir)
    return C.consensus_alignment(s, scored(spark, sf_dir, s), 0.45)


@query()
def max_recall_alignment(spark, sf_dir):
    s = order_sequences(spark, sf_dir)
    return C.max_recall_alignment(s, scored(spark, sf_dir, s))


@query()
def consensus_grid(spark, sf_dir):
    s = order_sequences(spark, sf_dir)
    return C.consensus_grid(s, scored(spark, sf_dir, s), [0.0, 0.5, 0.75])


@query()
def roc_curve(spark, sf_dir):
    s = order_sequences(spark, sf_dir)
    got = C.roc_curve(s, scored(spark, sf_dir, s), gold(spark, sf_dir, s), 10)
    return got.select("aln_id", "k", rounded("precision").alias("precision"), rounded("recall").alias("recall"), "posterior")


# --- pair model -------------------------------------------------------------


@query(f"WITH {_SUPPORT} SELECT state1, state2, top_sym, bot_sym FROM support")
def transition_support(spark, sf_dir):
    return model.transition_support(model.build_alphabet(order_sequences(spark, sf_dir)))


_TRANSITION = f"""WITH {_SUPPORT}, f AS (
  SELECT *, 'selfsub' AS feature FROM support WHERE top_sym = bot_sym
  UNION ALL SELECT *, 'pair(' || CASE WHEN top_sym < bot_sym THEN top_name || ',' || bot_name ELSE bot_name || ',' || top_name END || ')' FROM support
  UNION ALL SELECT *, 'state(' || least(state1, 1) || ')' FROM support
  UNION ALL SELECT *, 'statePair(' || least(state1, 1) || ',' || least(state2, 1) || ')' FROM support)"""


@query(_TRANSITION + " SELECT state1, 0 AS stat, state2, top_sym, bot_sym, feature, 1.0::DOUBLE AS value FROM f")
def transition_features(spark, sf_dir):
    return model.transition_features(model.build_alphabet(order_sequences(spark, sf_dir)))


_LOGPROBS = _TRANSITION + """, s AS (SELECT state1, state2, top_sym, bot_sym, sum(CASE feature WHEN 'selfsub' THEN 1.5 WHEN 'statePair(0,0)' THEN 0.5 WHEN 'statePair(1,1)' THEN 0.25 ELSE 0.0 END::DOUBLE) AS score FROM f GROUP BY ALL),
lp AS (SELECT state1, state2, top_sym, bot_sym, score - ln(sum(exp(score)) OVER (PARTITION BY state1)) AS logp FROM s)"""


@query(_TRANSITION + """ SELECT state1, 0 AS stat, state2, top_sym, bot_sym, feature, 1.0::DOUBLE AS value FROM f
UNION ALL SELECT state1, 0, state2, top_sym, bot_sym, 'begins(' || top_name[1] || ')', 2.0::DOUBLE FROM support WHERE state1 = state2""")
def custom_transition_features(spark, sf_dir):
    """Beside the model's own features, one of the letter and the kept state."""
    own = lambda rows: rows.where("state1 = state2").select(*model.KEY, F.concat(F.lit("begins("), F.substring("top_name", 1, 1), F.lit(")")).alias("feature"), F.lit(2.0).alias("value"))
    return model.transition_features(model.build_alphabet(order_sequences(spark, sf_dir)), custom=own)


@query(_LOGPROBS + " SELECT state1, 0 AS stat, state2, top_sym, bot_sym, round(logp, 9) AS logp FROM lp")
def transition_logprobs(spark, sf_dir):
    alphabet = model.build_alphabet(order_sequences(spark, sf_dir))
    return model.transition_logprobs(model.transition_features(alphabet), fixed_weights(spark)).withColumn("logp", rounded("logp"))


# With zero weights a path's weight depends on lengths alone: one grid serves all pairs.
_GRID = f"""WITH RECURSIVE {SEQ}, v AS (SELECT count(DISTINCT l_returnflag) AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
p AS (SELECT s, 1.0::DOUBLE / CASE WHEN s < 2 THEN (v + 1) * (v + 1) ELSE v * v + v + 1 END AS p FROM v, (VALUES (0), (1), (2)) t(s)),
moves AS (SELECT p.s AS s1, m.s2, m.dx, m.dy, p.p FROM p, (VALUES (0, 1, 1), (1, 0, 1), (2, 1, 0)) m(s2, dx, dy) WHERE NOT (p.s = 2 AND m.s2 = 1)),
top AS (SELECT max(len(letters)) AS n FROM seq),
f AS (SELECT 0 AS step, 0 AS x, 0 AS y, 0 AS s, 1.0::DOUBLE AS w
  UNION ALL SELECT step + 1, x + dx, y + dy, s2, sum(w * p) FROM f JOIN moves ON s = s1, top WHERE x + dx <= n AND y + dy <= n GROUP BY step, x + dx, y + dy, s2),
fwd AS (SELECT x, y, s, sum(w) AS w FROM f GROUP BY ALL),
g AS (SELECT 0 AS step, 0 AS x, 0 AS y, s, p AS w FROM p
  UNION ALL SELECT step + 1, x + dx, y + dy, s1, sum(w * p) FROM g JOIN moves ON s = s2, top WHERE x + dx <= n AND y + dy <= n GROUP BY step, x + dx, y + dy, s1),
bwd AS (SELECT x, y, s, sum(w) AS w FROM g GROUP BY ALL),
total AS (SELECT x, y, sum(w * p) AS w FROM fwd JOIN p USING (s) GROUP BY ALL),
pair AS (SELECT a.group_id, a.sequence_id AS top_id, b.sequence_id AS bot_id, len(a.letters) AS n, len(b.letters) AS m FROM seq a JOIN seq b ON a.group_id = b.group_id AND a.sequence_id < b.sequence_id)"""


@query(_GRID + " SELECT group_id, top_id, bot_id, round(ln(w), 9) AS loglik FROM pair JOIN total ON x = n AND y = m")
def pair_log_likelihood(spark, sf_dir):
    paired, weights, n = modelled(spark, sf_dir)
    return pairs.pair_log_likelihood(paired, weights, n).withColumn("loglik", rounded("loglik"))


@query(_GRID + """, size AS (SELECT DISTINCT n, m FROM pair), into_cell AS (SELECT x, y, sum(w * p) AS w FROM fwd JOIN p USING (s) GROUP BY ALL),
post AS (SELECT n, m, i.x AS x, i.y AS y, round(i.w * b.w / t.w, 9) AS score FROM size JOIN into_cell i ON i.x < n AND i.y < m JOIN bwd b ON b.s = 0 AND b.x = n - i.x - 1 AND b.y = m - i.y - 1 JOIN total t ON t.x = n AND t.y = m)
SELECT group_id AS aln_id, top_id AS seq1, CAST(x AS INTEGER) AS pos1, bot_id AS seq2, CAST(y AS INTEGER) AS pos2, score FROM pair JOIN post USING (n, m)""")
def pair_posteriors(spark, sf_dir):
    paired, weights, n = modelled(spark, sf_dir)
    return pairs.pair_posteriors(paired, weights, n).withColumn("score", rounded("score"))


@query(_GRID + """, off AS (SELECT DISTINCT n - m AS d FROM pair),
f1 AS (SELECT 0 AS step, 0 AS x, 0 AS y, 0 AS s, 1.0::DOUBLE AS w
  UNION ALL SELECT step + 1, x + dx, y + dy, s2, sum(w * p * CASE WHEN s2 = 0 AND x = y THEN exp(1) ELSE 1 END) FROM f1 JOIN moves ON s = s1, top WHERE x + dx <= n AND y + dy <= n GROUP BY step, x + dx, y + dy, s2),
fwd1 AS (SELECT x, y, sum(w * p) AS w FROM f1 JOIN p USING (s) GROUP BY ALL),
g1 AS (SELECT d, 0 AS step, 0 AS x, 0 AS y, s, p AS w FROM p, off
  UNION ALL SELECT d, step + 1, x + dx, y + dy, s1, sum(w * p * CASE WHEN s2 = 0 AND x - y = d THEN exp(1) ELSE 1 END) FROM g1 JOIN moves ON s = s2, top WHERE x + dx <= n AND y + dy <= n GROUP BY d, step, x + dx, y + dy, s1),
bwd1 AS (SELECT d, x, y, sum(w) AS w FROM g1 WHERE s = 0 GROUP BY ALL),
size AS (SELECT DISTINCT n, m FROM pair),
post AS (SELECT n, m, i.x AS x, i.y AS y, round(i.w * CASE WHEN i.x = i.y THEN exp(1) ELSE 1 END * b.w / t.w, 9) AS score
  FROM size JOIN fwd1 i ON i.x < n AND i.y < m JOIN bwd1 b ON b.d = n - m AND b.x = n - i.x - 1 AND b.y = m - i.y - 1 JOIN fwd1 t ON t.x = n AND t.y = m)
SELECT group_id AS aln_id, top_id AS seq1, CAST(x AS INTEGER) AS pos1, bot_id AS seq2, CAST(y AS INTEGER) AS pos2, score FROM pair JOIN post USING (n, m)""")
def reweight_pairs(spark, sf_dir):
    """Posteriors with odds for positions of equal place."""
    paired, weights, n = modelled(spark, sf_dir)
    odds = paired.select("group_id", "top_id", "bot_id", F.explode(F.sequence(F.lit(0), F.least(F.size("top"), F.size("bot")) - 1)).alias("x")).select("*", F.col("x").alias("y"), F.lit(1.0).alias("log_odds"))
    return pairs.pair_posteriors(pairs.reweight_pairs(paired, odds), weights, n).withColumn("score", rounded("score"))


@query()
def expected_counts(spark, sf_dir):
    """A13 over M6: expected moves of all pairs."""
    paired, weights, n = modelled(spark, sf_dir, fixed_weights(spark))
    return pairs.expected_counts(paired, weights, n, n).withColumn("expected", F.round("expected", 6))


@query(_GRID + """, lettered AS (SELECT p.*, a.letters AS top, b.letters AS bot FROM pair p JOIN seq a ON a.group_id = p.group_id AND a.sequence_id = top_id JOIN seq b ON b.group_id = p.group_id AND b.sequence_id = bot_id),
size AS (SELECT DISTINCT n, m FROM pair),
step AS (SELECT n, m, f.x, f.y, s1, s2, dx, dy, f.w * mv.p * b.w / t.w AS e FROM size JOIN fwd f ON f.x <= n AND f.y <= m JOIN moves mv ON mv.s1 = f.s AND f.x + dx <= n AND f.y + dy <= m JOIN bwd b ON b.s = s2 AND b.x = n - f.x - dx AND b.y = m - f.y - dy JOIN total t ON t.x = n AND t.y = m),
last AS (SELECT n, m, f.s AS s1, f.w * p / t.w AS e FROM size JOIN fwd f ON f.x = n AND f.y = m JOIN p ON p.s = f.s JOIN total t ON t.x = n AND t.y = m),
ids AS (SELECT letter, row_number() OVER (ORDER BY letter) - 1 AS id FROM (SELECT DISTINCT l_returnflag AS letter FROM orders JOIN lineitem ON o_orderkey = l_orderkey)),
met AS (SELECT s1, s2, CASE WHEN dx = 1 THEN top[x + 1] END AS a, CASE WHEN dy = 1 THEN bot[y + 1] END AS b, sum(e) AS e FROM lettered JOIN step USING (n, m) GROUP BY ALL)
SELECT CAST(s1 AS INTEGER) AS state1, 0 AS stat, CAST(s2 AS INTEGER) AS state2, CAST(coalesce(i.id, v + 1) AS INTEGER) AS top_sym, CAST(coalesce(j.id, v + 1) AS INTEGER) AS bot_sym, round(e, 6) AS expected FROM met LEFT JOIN ids i ON i.letter = a LEFT JOIN ids j ON j.letter = b, v
UNION ALL SELECT CAST(s1 AS INTEGER), 0, 0, CAST(any_value(v) AS INTEGER), CAST(any_value(v) AS INTEGER), round(sum(e), 6) FROM pair JOIN last USING (n, m), v GROUP BY s1""")
def expected_counts_of_zero_weights(spark, sf_dir):
    paired, weights, n = modelled(spark, sf_dir)
    return pairs.expected_counts(paired, weights, n, n).withColumn("expected", F.round("expected", 6))


@query()
def viterbi_alignment(spark, sf_dir):
    paired, weights, n = modelled(spark, sf_dir, fixed_weights(spark))
    return pairs.viterbi_alignment(paired, weights, n, with_states=True)


@query()
def sample_alignments(spark, sf_dir):
    paired, weights, n = modelled(spark, sf_dir, fixed_weights(spark))
    return pairs.sample_alignments(paired, weights, n, n_draws=2)


@query()
def mbr_alignment(spark, sf_dir):
    paired, weights, n = modelled(spark, sf_dir, fixed_weights(spark))
    return pairs.mbr_alignment(paired, weights, n)


@query(f"""WITH RECURSIVE {SEQ}, each AS (SELECT group_id, sequence_id, i, letters[i] AS letter FROM (SELECT *, unnest(range(1, len(letters) + 1)) AS i FROM seq)),
share AS (SELECT letter, count(*) / sum(count(*)) OVER () AS q FROM each GROUP BY 1),
listed AS (SELECT group_id, sequence_id, list(letter ORDER BY i) AS l, list(q ORDER BY i) AS q FROM each JOIN share USING (letter) GROUP BY ALL),
pair AS (SELECT row_number() OVER () AS id, a.group_id, a.sequence_id AS top_id, b.sequence_id AS bot_id, a.l AS t, a.q AS tq, b.l AS b, b.q AS bq, len(a.l) AS n, len(b.l) AS m FROM listed a JOIN listed b ON a.group_id = b.group_id AND a.sequence_id < b.sequence_id),
moves AS (FROM (VALUES (1, 1), (1, 0), (0, 1)) v(dx, dy)),
f AS (SELECT id, 0 AS step, 0 AS x, 0 AS y, 1.0::DOUBLE AS w FROM pair
  UNION ALL SELECT f.id, step + 1, x + dx, y + dy, sum(w * CASE WHEN dx = 1 AND dy = 1 THEN CASE WHEN t[x + 1] = b[y + 1] THEN 0.8 ELSE 0.1 END * sqrt(tq[x + 1] * bq[y + 1]) WHEN dx = 1 THEN 0.1 * tq[x + 1] ELSE 0.1 * bq[y + 1] END)
  FROM f JOIN pair ON pair.id = f.id, moves WHERE x + dx <= n AND y + dy <= m GROUP BY f.id, step, x + dx, y + dy)
SELECT group_id, top_id, bot_id, round(ln(sum(w)), 9) AS loglik FROM f JOIN pair ON pair.id = f.id AND x = n AND y = m GROUP BY ALL""")
def homogeneous_pair_model(spark, sf_dir):
    """A one-state model from the letters' shares of all lines."""
    sequences, alphabet, paired, n = coded(spark, sf_dir)
    shares = sequences.select(F.explode("letters").alias("letter")).groupBy("letter").agg(F.count("*").alias("n")).join(alphabet, "letter")
    total = shares.agg(F.sum("n")).first()[0]
    one = shares.select(F.col("letter_id").alias("i"), (F.col("n") / total).alias("q"))
    zero, none = F.lit(0).alias("state1"), F.lit(0).alias("state2")
    sub = one.alias("a").join(one.alias("b"), F.lit(True)).select(F.lit("sub").alias("move"), zero, none, F.col("a.i").alias("a"), F.col("b.i").alias("b"), (F.when(F.col("a.i") == F.col("b.i"), 0.8).otherwise(0.1) * F.sqrt(F.col("a.q") * F.col("b.q"))).alias("weight"))
    gaps = one.select(F.lit("del"), zero, none, "i", F.lit(None).cast("int"), F.col("q") * 0.1).union(one.select(F.lit("ins"), zero, none, F.lit(None).cast("int"), "i", F.col("q") * 0.1))
    weights = {0: pairs.table_weights(sub.union(gaps), n, 1)}
    return pairs.pair_log_likelihood(paired, weights, None).withColumn("loglik", rounded("loglik"))


@query(f"""{_TRANSITION}, counts AS (SELECT * FROM ({ORACLE["expected_counts_of_zero_weights"]})),
n AS (SELECT state1, count(*) AS n FROM support GROUP BY 1), t AS (SELECT state1, sum(expected) AS t FROM counts GROUP BY 1)
SELECT feature, round(-sum(coalesce(expected, 0) - coalesce(t, 0) / n), 2) + 0.0 AS gradient FROM f JOIN n USING (state1) LEFT JOIN t USING (state1) LEFT JOIN counts USING (state1, state2, top_sym, bot_sym) GROUP BY 1""")
def fit_gradient(spark, sf_dir):
    """The slope that the fit starts with, added up in tasks."""
    _, alphabet, paired, n = coded(spark, sf_dir)
    features = model.transition_features(alphabet)
    table = model.model_tables(model.transition_logprobs(features, training.zero_weights(spark)), n)
    found = model.fit_gradient(features, pairs.expected_counts(paired, table, n, n))
    return found.withColumn("gradient", F.round("gradient", 2) + F.lit(0.0))


@query()
def m_step(spark, sf_dir):
    """Weights fitted to the expected counts of one round."""
    sequences, alphabet, paired, n = coded(spark, sf_dir)
    features = model.transition_features(alphabet)
    table = model.model_weights(model.transition_logprobs(features, training.zero_weights(spark)), n)
    return model.m_step(features, pairs.expected_counts(paired, table, n, n)).withColumn("weight", F.round("weight", 4))


@query()
def train(spark, sf_dir):
    """Weights after the last round."""
    return trained(order_sequences(spark, sf_dir)).withColumn("weight", F.round("weight", 4))


@query()
def align_groups(spark, sf_dir):
    sequences = order_sequences(spark, sf_dir)
    return training.align_groups(sequences, trained(sequences))


@query()
def align_event_groups(spark, sf_dir):
    """Long sequences: events of users, ten groups."""
    sequences = event_sequences(spark, sf_dir, groups=50)
    return training.align_groups(sequences, trained(sequences), thresholds=[0.5, 0.75])


@query("""WITH RECURSIVE ev AS (SELECT CAST(user_id AS VARCHAR) AS sequence_id, list(event_type ORDER BY ts, event_id) AS letters FROM events GROUP BY user_id)
SELECT 'all' AS group_id, a.sequence_id AS top_id, b.sequence_id AS bot_id, array_to_string(a.letters, ' ') AS top, array_to_string(b.letters, ' ') AS bot FROM ev a JOIN ev b ON a.sequence_id < b.sequence_id""")
def pairs_of_one_group(spark, sf_dir):
    """All users' events as one group, whose pairs are made block by block."""
    ev = event_sequences(spark, sf_dir, groups=1)
    # Texts are made once for each sequence, not for each pair.
    texts = saved(ev.select(F.lit("all").alias("group_id"), "sequence_id", "ord", F.array_join("letters", " ").alias("ids")), "texts")
    return pairs.sequence_pairs(texts, block=32).drop("stat")


@query(f"WITH {SEQ} SELECT a.group_id, a.sequence_id AS top_id, b.sequence_id AS bot_id, CAST(len(b.letters) - len(a.letters) AS INTEGER) AS stat FROM seq a JOIN seq b ON a.group_id = b.group_id AND a.sequence_id < b.sequence_id")
def pairs_of_own_statistic(spark, sf_dir):
    """Pairs told apart by how much longer the later sequence is."""
    coded = order_sequences(spark, sf_dir).withColumnRenamed("letters", "ids")
    return pairs.sequence_pairs(coded, F.size("bot") - F.size("top")).select("group_id", "top_id", "bot_id", "stat")


@query(f"WITH {SEQ}, p AS (SELECT DISTINCT a.sequence_id AS id1, b.sequence_id AS id2 FROM seq a JOIN seq b ON a.group_id = b.group_id AND a.sequence_id < b.sequence_id) SELECT id1, id2, id1 || '|' || id2 AS label, CAST(row_number() OVER (ORDER BY id1, id2) - 1 AS INTEGER) AS stat FROM p")
def pair_statistic_index(spark, sf_dir):
    return pairs.pair_statistic_index(order_sequences(spark, sf_dir))


def edges_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: edges of each group's alignment by the trained pair model."""
    return M.n_edges(align_groups(spark, sf_dir))


QUERIES["edges_by_group"] = edges_by_group
