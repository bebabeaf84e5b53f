"""Column functions on letters, sequences and pairwise alignments (derivations).

A derivation gives, for each position of the current sequence, the aligned position
of the ancestor or -1 if it was inserted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDARY = "#"
GAP = "-"


def chars_to_letters(text: Column) -> Column:
    """A string as one-character letters."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))


def subsequence(letters: Column, first: Column | int, end: Column | int) -> Column:
    """Letters first .. end - 1."""
    first, end = (F.lit(v) if isinstance(v, int) else v for v in (first, end))
    return F.slice(letters, first + 1, F.greatest(end - first, F.lit(0)))


def append_letter(letters: Column, letter: Column | str) -> Column:
    return F.array_append(letters, F.lit(letter) if isinstance(letter, str) else letter)


def collapse_indel_state(state: Column) -> Column:
    """0 stays, 1 and 2 are both 1; others are an error."""
    return F.when(state == 0, 0).when(state.isin(1, 2), 1).otherwise(F.raise_error(F.lit("no such state")).cast("int"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NaN where nothing is divided by nothing."""
    return F.when(whole == 0, F.lit(float("nan"))).otherwise(part / whole)


def f1_score(precision: Column, recall: Column) -> Column:
    """Harmonic mean; 0 if both are 0, NaN if either is NaN."""
    nan = F.isnan(precision) | F.isnan(recall)
    total = precision + recall
    return F.when(nan, F.lit(float("nan"))).when(total == 0, F.lit(0.0)).otherwise(2 * precision * recall / total)


def canonical_edge(seq1: Column, pos1: Column, seq2: Column, pos2: Column) -> Column:
    """struct(seq1, pos1, seq2, pos2) with seq1 < seq2."""
    keep = seq1 < seq2
    return F.struct(
        F.when(keep, seq1).otherwise(seq2).alias("seq1"), F.when(keep, pos1).otherwise(pos2).alias("pos1"),
        F.when(keep, seq2).otherwise(seq1).alias("seq2"), F.when(keep, pos2).otherwise(pos1).alias("pos2"),
    )


def parse_edge_literal(text: Column) -> Column:
    """`((i, a), (j, b))` as a canonical edge; another text is an error."""
    pattern = r"^\s*\(\((\d+), (.*?)\), \((\d+), (.*?)\)\)\s*$"
    mark = "\x01"
    # The parts are cut out by one match; by one for each where an id holds the mark.
    once = F.split(F.regexp_replace(text, pattern, "$1" + mark + "$2" + mark + "$3" + mark + "$4"), mark)
    each = F.when(text.rlike(pattern), F.array(*(F.regexp_extract(text, pattern, i) for i in range(1, 5))))
    error = F.raise_error(F.concat(F.lit("not an edge: "), text)).cast("struct<seq1:string,pos1:int,seq2:string,pos2:int>")
    # Within transform the parts are found once, however often the edge names them.
    edge = lambda p: F.when(F.size(p) == 4, canonical_edge(p[1], p[0].try_cast("int"), p[3], p[2].try_cast("int"))).otherwise(error)
    return F.transform(F.array(F.when(F.contains(text, F.lit(mark)), each).otherwise(once)), edge)[0]


def derivation_invert(ancestors: Column, ancestor_length: Column) -> Column:
    """Swap the two sides: for each ancestor position the current one, or -1."""
    places = F.sequence(F.lit(0), ancestor_length - 1)
    inverted = F.transform(places, lambda i: F.array_position(ancestors, i).cast("int") - 1)
    return F.when(ancestor_length == 0, F.array().cast("array<int>")).otherwise(inverted)


def derivation_is_monotonic(ancestors: Column) -> Column:
    """Aligned ancestor positions never decrease."""
    linked = F.filter(ancestors, lambda a: a >= 0)
    return linked == F.array_sort(linked)


def derivation_to_string(ancestors: Column) -> Column:
    """[0, X, 1]: inserted positions are X."""
    return F.concat(F.lit("["), F.array_join(F.transform(ancestors, lambda a: F.when(a < 0, F.lit("X")).otherwise(a.cast("string"))), ", "), F.lit("]"))


def remove_boundary(ancestors: Column, ancestor_letters: Column, current_letters: Column) -> Column:
    """Drop the last position of both sides, which must be linked boundaries.
    struct(ancestors, ancestor_letters, current_letters)."""
    good = (F.element_at(ancestor_letters, -1) == BOUNDARY) & (F.element_at(current_letters, -1) == BOUNDARY) & (F.element_at(ancestors, -1) == F.size(ancestor_letters) - 1)
    cut = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)
    out = F.struct(cut(ancestors).alias("ancestors"), cut(ancestor_letters).alias("ancestor_letters"), cut(current_letters).alias("current_letters"))
    return F.when(good, out).otherwise(F.raise_error(F.lit("the last pair is no boundary")).cast("struct<ancestors:array<int>,ancestor_letters:array<string>,current_letters:array<string>>"))
