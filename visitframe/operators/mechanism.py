"""Tests of the dropout mechanism."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.functions.dist import chi2_sf
from visitframe.functions.scalar import binarize
from visitframe.operators import chains
from visitframe.operators.impute import Coded, load_sums
from visitframe.operators.logistic import LogitFit, VisitLogit, fit_visit_logits, previous
from visitframe.spec import DROPOUT_LOGIT, IPW_LOGIT, IPW_LOGIT_SIMPLE, PANEL, ImputationSpec, PanelSpec


def dropout_spec(terms=DROPOUT_LOGIT, categorical=("TRIAL", "SEX", "EDU", "JOB", "WZC"), spec: PanelSpec = PANEL) -> VisitLogit:
    """Missing at this visit on the previous visit's outcomes and the covariates."""
    response = {t: F.col(f"{spec.families[0]}{t}").isNull() for t in spec.visits[1:]}
    return VisitLogit(response, terms, categorical, varying={f"prev_{f}": previous(f, spec.visits) for f in spec.families})


def observation_spec(terms=IPW_LOGIT, categorical=("SEX", "WZC", "EDU", "JOB"), coding="effect", reference="last", spec: PanelSpec = PANEL) -> VisitLogit:
    """Next visit observed, at each observed visit up to the first gap."""
    response, at_risk, family = {}, F.lit(True), spec.families[0]
    for t, after in zip(spec.visits, spec.visits[1:]):
        response[t] = F.when(at_risk & F.col(f"{family}{t}").isNotNull(), F.col(f"{family}{after}").isNotNull().cast("int"))
        at_risk = at_risk & F.col(f"{family}{after}").isNotNull()
    return VisitLogit(response, terms, categorical, reference, coding, {"CDRSB_PREV": {t: F.col(f"{family}{t}") for t in spec.visits[:-1]}})


def response_spec(terms=IPW_LOGIT_SIMPLE, categorical=("SEX",), coding="effect", reference="last", cut: float = 10.0, spec: PanelSpec = PANEL) -> VisitLogit:
    """Observed at this visit on the response at the visit before (0 at the first)."""
    family, first = spec.families[0], spec.visits[0]
    response = {t: F.col(f"{family}{t}").isNotNull().cast("int") for t in spec.visits}
    before = {first: F.lit(0), **{t: binarize(f"{family}{s}", cut) for s, t in zip(spec.visits, spec.visits[1:])}}
    return VisitLogit(response, terms, categorical, reference, coding, {"prev_resp": before})


def dropout_model(wide: DataFrame, terms=DROPOUT_LOGIT, categorical=("TRIAL", "SEX", "EDU", "JOB", "WZC"),
                  spec: PanelSpec = PANEL) -> LogitFit:
    return fit_visit_logits(wide, {"dropout": dropout_spec(terms, categorical, spec)}, spec)["dropout"]


def observation_model(wide: DataFrame, terms=IPW_LOGIT, categorical=("SEX", "WZC", "EDU", "JOB"),
                      coding="effect", reference="last", spec: PanelSpec = PANEL) -> LogitFit:
    """P(next visit observed) on the person-period visits."""
    return fit_visit_logits(wide, {"next": observation_spec(terms, categorical, coding, reference, spec)}, spec)["next"]


def little_mcar_test(wide: DataFrame, cols) -> DataFrame:
    """Little's chi-square test that the patterns share one mean: statistic, df, p_value, n_patterns.

    One pass sums each pattern; likelihood and statistic need those sums only. Rows missing in every
    column carry no information and are left out.
    """
    spec = ImputationSpec("little", "mvn", tuple(cols))
    sums = load_sums(wide, Coded.build(wide, spec), drop_empty=True)
    stat, seen, patterns = sums.distance(*chains.em_normal(sums, 5000, 1e-12))
    df = seen - len(cols)
    row = (float(stat), int(df), float(chi2_sf(stat, df)) if df > 0 else 1.0, int(patterns))
    return wide.sparkSession.createDataFrame(
        [row], "statistic double, df int, p_value double, n_patterns int")
