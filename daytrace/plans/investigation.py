"""Investigation of all episodes at once: bundles to findings."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from daytrace.operators import diagnose as og
from daytrace.operators import findings as on
from daytrace.session import checkpointed


class Investigation(NamedTuple):
    episodes: DataFrame
    bundle: DataFrame
    formed: DataFrame
    passes: DataFrame
    hypotheses: DataFrame
    findings: DataFrame
    scores: DataFrame


def form(episodes: DataFrame, days: DataFrame, group: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(episodes, bundles, hypotheses as formed): what an investigation has before its first search.

    `days` are the wells' classified days. `group` names a column of them: an episode is compared with
    the other wells of its value.
    """
    # Tables of episode size that several later steps read: checkpointed, so that none of those
    # steps repeats the sweep over all days, also not after an executor is lost.
    episodes = checkpointed(episodes)
    bundle = checkpointed(og.bundles(episodes, days))
    return episodes, bundle, checkpointed(on.form_hypotheses(bundle, og.offsets(episodes, days, group)))


def investigate(
    episodes: DataFrame, days: DataFrame, chunks: DataFrame, group: str
) -> Investigation:
    """`chunks` are the searchable narrative of the wells' reports; the rest is as in `form`."""
    episodes, bundle, formed = form(episodes, days, group)
    passes = checkpointed(on.evidence_passes(formed))
    hypotheses = checkpointed(on.attach(formed, on.retrieve(passes, chunks)))
    findings = checkpointed(on.conclude(formed, hypotheses))
    return Investigation(episodes, bundle, formed, passes, hypotheses, findings, on.evidence_score(findings, bundle))
