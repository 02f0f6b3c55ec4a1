"""The award job: quarterback seasons, labels, fit, and scored train and test seasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from snaplytics.operators import award_model
from snaplytics.operators.games import relabel_franchises
from snaplytics.operators.quarterbacks import (
    AwardRules,
    qb_ranks,
    qb_season,
    testing_rows,
    training_rows,
    winners,
    with_award,
    with_win_rank,
)
from snaplytics.session import cut_lineage


def labelled_quarterbacks(
    player_stats: DataFrame, standings: DataFrame, award: DataFrame, rules: AwardRules = AwardRules()
) -> DataFrame:
    """Ranked quarterback seasons with the award label; to be stored by whoever reads them more than once."""
    ranked = with_win_rank(qb_ranks(qb_season(player_stats, rules)), relabel_franchises(standings, rules.franchise_moves))
    return with_award(ranked, winners(award, rules.first_season))


@dataclass(frozen=True)
class AwardRun:
    model: award_model.AwardModel
    train: DataFrame
    test: DataFrame


def run_award_model(labelled: DataFrame, rules: AwardRules = AwardRules()) -> AwardRun:
    labelled = cut_lineage(labelled)
    train, test = training_rows(labelled, rules), testing_rows(labelled, rules)
    model = award_model.fit(train)
    return AwardRun(model, award_model.score(train, model.coefficients), award_model.score(test, model.coefficients))
