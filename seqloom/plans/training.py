"""Training by expectation-maximisation, and alignment with a trained model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import construct
from ..sources.shared import saved
from . import model, pairs


@dataclass
class Step:
    """One round: log-likelihood under the weights before it, and the weights after it."""

    iteration: int
    log_likelihood: float
    weights: DataFrame


def zero_weights(spark) -> DataFrame:
    return spark.createDataFrame([], "feature string, weight double")


def init_weights(spark, given: str | DataFrame = "ZERO") -> DataFrame:
    """Weights to start from: ZERO, a file of weights, or a table."""
    if isinstance(given, DataFrame):
        return given.select("feature", "weight")
    if given == "ZERO":
        return zero_weights(spark)
    if given == "SAME":
        raise ValueError("SAME names no weights to start from")
    from ..sources.files import read_weights

    return read_weights(spark, given)


def regularization_centers(spark, given: str | DataFrame, start: DataFrame) -> DataFrame:
    """What the penalty pulls to: as init_weights, or SAME as the start."""
    return start if isinstance(given, str) and given == "SAME" else init_weights(spark, given)


def current_model(features: DataFrame, weights: DataFrame, n_letters: int):
    return model.model_weights(model.transition_logprobs(features, weights), n_letters)


def train(
    sequences: DataFrame, iterations: int = 10, letter_features: DataFrame | None = None, sigma: float = 1.0, initial: str | DataFrame = "ZERO", centers: str | DataFrame = "ZERO",
    pair_specific: bool = False, use_letter_pairs: bool = True, use_long_gaps: bool = True, custom: model.Custom | None = None, factors: DataFrame | None = None,
    outputs: str | None = None, thresholds: list[float] | None = None, write_every_iteration: bool = False,
) -> list[Step]:
    """Expected counts of all pairs, then new weights, `iterations` times. custom and factors:
    further features, and the penalty's factor of some. pair_specific: a model for each pair
    of ids, which meets its pairs by a shuffle, however many there are. outputs: a folder for the weights
    and the alignments at each threshold after the last round, or after each."""
    from ..sources.files import write_iteration_outputs

    if outputs is not None and pair_specific:
        raise ValueError("alignments are written for models that all pairs share")
    spark = sequences.sparkSession
    alphabet = saved(model.build_alphabet(sequences), "alphabet")
    n = alphabet.count()
    paired = pairs.sequence_pairs(model.with_letter_ids(sequences, alphabet))
    statistics = None
    if pair_specific:
        index = pairs.pair_statistic_index(sequences).cache()
        paired, statistics = pairs.with_statistics(paired, index), index
    paired = pairs.like_pairs(paired).cache()
    features = model.transition_features(alphabet, letter_features, statistics, use_letter_pairs, use_long_gaps, custom).cache()
    weights = init_weights(spark, initial)
    center = regularization_centers(spark, centers, weights)
    steps = []
    for i in range(iterations):
        if pair_specific:  # models and counts of all statistics stay in Spark
            tables = model.model_tables(model.transition_logprobs(features, weights), n)
            counts, loglik = pairs.counts_and_likelihood(paired, tables, n, n)
            weights = model.m_step_in_tasks(features, counts, weights, center, sigma, factors)
        else:
            counts, loglik = pairs.counts_and_likelihood(paired, current_model(features, weights, n), n, n)
            weights = model.m_step(features, counts, weights, center, sigma, factors)
        steps.append(Step(i, loglik, weights))
        if outputs is not None and (write_every_iteration or i == iterations - 1):
            grid = align_groups(sequences, weights, letter_features, thresholds or [0.0], custom)
            write_iteration_outputs(grid, sequences, weights, outputs, i)
    for df in (paired, features):
        df.unpersist()
    return steps


def align_groups(sequences: DataFrame, weights: DataFrame | None = None, letter_features: DataFrame | None = None, thresholds: list[float] | None = None, custom: model.Custom | None = None) -> DataFrame:
    """Consensus columns from the posteriors of all pairs: at threshold 0, or with column
    `threshold` for each of several."""
    alphabet = saved(model.build_alphabet(sequences), "alphabet")
    n = alphabet.count()
    table = current_model(model.transition_features(alphabet, letter_features, custom=custom), weights if weights is not None else zero_weights(sequences.sparkSession), n)
    paired = pairs.sequence_pairs(model.with_letter_ids(sequences, alphabet))
    edges = pairs.posterior_lists(paired, table, n, over=min(thresholds or [0.0]))
    if thresholds:
        return construct.consensus_grid(sequences, edges, thresholds)
    return construct.max_recall_alignment(sequences, edges)
