"""Declarations: what a panel looks like, which models and imputations exist."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PanelSpec:
    """Column roles of a wide panel: one row per subject, one column per visit and family."""

    id: str = "PATID"
    time: str = "TIME"
    visits: tuple = tuple(range(7))
    families: tuple = ("cdrsb", "bprs", "abpet", "taupet")
    covariates: tuple = ("TRIAL", "SEX", "AGE", "EDU", "BMI", "INKOMEN", "JOB", "ADL", "WZC")
    categorical: tuple = ("TRIAL", "SEX", "EDU", "JOB", "WZC")

    def visit_columns(self, family, visits=None):
        return [f"{family}{t}" for t in (self.visits if visits is None else visits)]

    def all_visit_columns(self):
        return [c for f in self.families for c in self.visit_columns(f)]


PANEL = PanelSpec()


@dataclass(frozen=True)
class ModelSpec:
    """A panel model: outcome family, terms (each a tuple of factors) and coding of class columns.

    `outcome` names a visit family; `cut` turns it into the 0/1 response `value >= cut`.
    """

    name: str
    kind: str
    outcome: str
    terms: tuple
    cut: float | None = None
    categorical: tuple = ()
    reference: str | dict = "first"


def products(factors, names):
    """`factors` crossed with each name: products(("TIME",), ["AGE"]) -> (("TIME", "AGE"),)."""
    return tuple(tuple(factors) + (n,) for n in names)


def mains(*names):
    return tuple((n,) for n in names)


_T = ("TIME",)
_T2 = ("TIME", "TIME")

_LME = mains("TIME", "TRIAL", "SEX", "AGE", "EDU", "BMI", "JOB", "ADL", "WZC", "cdrsb0")
_LME_X = products(_T, ["AGE", "EDU", "JOB", "ADL", "cdrsb0"])
_GEE_REDUCED = (
    mains("TIME") + (_T2,) + mains("SEX", "BMI_STD", "ADL")
    + products(_T, ["BMI_STD", "ADL"]) + products(_T2, ["ADL"])
)
_GEE_COVS = ["SEX", "AGE_STD", "BMI_STD", "ADL", "TAUPET_STD", "ABPET_STD"]
_ALL12 = ["TRIAL", "SEX", "AGE", "EDU", "BMI", "INKOMEN", "JOB", "ADL", "WZC",
          "cdrsb0", "abpet0", "taupet0"]
_SHIFT_X = ["EDU", "JOB", "ADL_NUM", "cdrsb0"]
_CLS = ("TRIAL", "SEX", "EDU", "JOB", "WZC")

MODELS = {
    m.name: m
    for m in [
        ModelSpec("lme_primary", "lmm", "bprs", _LME + _LME_X, categorical=_CLS),
        ModelSpec("lme_full", "lmm", "bprs",
                  _LME + mains("abpet0", "taupet0", "INKOMEN") + _LME_X
                  + products(_T, ["abpet0", "taupet0", "INKOMEN"]), categorical=_CLS),
        ModelSpec("lme_all_by_time", "lmm", "bprs",
                  mains("TIME", *_ALL12) + products(_T, _ALL12), categorical=_CLS),
        ModelSpec("lme_reduced", "lmm", "bprs",
                  mains("SEX", "AGE", "BMI", "JOB", "ADL", "WZC", "cdrsb0", "taupet0", "TIME")
                  + products(_T, ["SEX", "cdrsb0"]), categorical=("SEX", "JOB", "WZC"), reference="last"),
        ModelSpec("lme_small", "lmm", "bprs",
                  mains("AGE_STD", "BMI_STD", "SEX", "TIME") + products(_T, ["AGE_STD"]),
                  categorical=("SEX",), reference="last"),
        ModelSpec("lmer_shift", "lmm", "bprs",
                  mains("TRIAL", "AGE_STD", "EDU", "BMI_STD", "JOB", "ADL_NUM", "WZC", "cdrsb0", "TIME")
                  + products(_T, ["AGE_STD", *_SHIFT_X]), categorical=("TRIAL", "EDU", "JOB", "WZC")),
        ModelSpec("lmer_shift_raw", "lmm", "bprs",
                  mains("TRIAL", "AGE", "EDU", "BMI", "JOB", "ADL_NUM", "WZC", "cdrsb0", "TIME")
                  + products(_T, ["AGE", *_SHIFT_X]), categorical=("TRIAL", "EDU", "JOB", "WZC")),
        ModelSpec("gee_reduced", "gee", "cdrsb", _GEE_REDUCED, cut=10.0,
                  categorical=("SEX",), reference="last"),
        ModelSpec("gee_full_quadratic", "gee", "cdrsb",
                  mains("TIME") + (_T2,) + mains(*_GEE_COVS) + products(_T, _GEE_COVS)
                  + products(_T2, _GEE_COVS), cut=10.0, categorical=("SEX",), reference={"SEX": 1}),
        ModelSpec("gee_full_linear", "gee", "cdrsb",
                  mains("TIME", *_GEE_COVS) + products(_T, _GEE_COVS),
                  cut=10.0, categorical=("SEX",), reference={"SEX": 1}),
        ModelSpec("glmm_primary", "glmm", "cdrsb",
                  mains("TIME", "BMI_STD", "TAUPET_STD") + products(_T, ["BMI_STD", "TAUPET_STD"]),
                  cut=10.0),
        ModelSpec("glmm_full", "glmm", "cdrsb",
                  mains("TIME", "AGE_STD", "BMI_STD", "SEX", "ADL", "ABPET_STD", "TAUPET_STD")
                  + products(_T, ["BMI_STD", "TAUPET_STD", "SEX", "AGE_STD", "ABPET_STD", "ADL"]),
                  cut=10.0),
        ModelSpec("glmm_draft", "glmm", "cdrsb",
                  mains("TIME", "BMI_STD", "AGE_STD") + products(_T, ["BMI", "AGE"]), cut=10.0),
    ]
}

DROPOUT_LOGIT = mains("prev_cdrsb", "prev_bprs", "prev_taupet", "prev_abpet", "TRIAL", "SEX", "AGE",
                      "EDU", "BMI", "INKOMEN", "JOB", "ADL_NUM", "WZC", "TIME")
IPW_LOGIT = mains("TIME", "SEX", "AGE", "EDU", "BMI", "ADL", "WZC", "CDRSB_PREV")
IPW_LOGIT_SIMPLE = mains("TIME", "SEX", "BMI", "prev_resp")


@dataclass(frozen=True)
class ImputationSpec:
    """How to fill a wide panel.

    `method`: mvn | fcs | monotone.  `columns` maps a variable to `reg`, `norm` or `pmm`
    (chained equations only).  `predictors` maps a variable to the variables that predict it.
    `delta` maps a variable to a constant added to each of its draws inside the chain.
    """

    name: str
    method: str
    variables: tuple
    m: int = 10
    seed: int = 1234
    iterations: int = 20
    categorical: tuple = ()
    ridge: float = 0.0
    columns: dict = field(default_factory=dict)
    predictors: dict = field(default_factory=dict)
    delta: dict = field(default_factory=dict)
    round_to: float | None = None
    proper: bool = True

    def variant(self, **changes):
        return ImputationSpec(**{**self.__dict__, **changes})


def _v(family, first=0):
    return tuple(f"{family}{t}" for t in range(first, 7))


def past_only(variables, family="bprs", always=()):
    """Predictors of each visit after the first: the covariates, earlier visits of the family, and `always`; the first keeps all."""
    visits = [v for v in variables if v[:-1] == family]
    others = [v for v in variables if v not in visits]
    return {v: tuple(others) + tuple(visits[:i]) + tuple(a for a in always if a not in others)
            for i, v in enumerate(visits) if i}


_BPRS_COVS = ("SEX", "AGE", "EDU", "BMI", "JOB", "ADL", "WZC", "cdrsb0")
_MICE_COVS = ("TRIAL", "SEX", "AGE", "EDU", "BMI", "INKOMEN", "JOB", "ADL", "WZC")
_INTERLEAVED = tuple(f"{f}{t}" for t in range(7) for f in ("cdrsb", "taupet", "abpet"))
_MICE_VARS = _MICE_COVS + ("cdrsb0",) + _v("bprs")
_MICE_ALL = _MICE_COVS + _v("cdrsb") + _v("abpet") + _v("taupet") + _v("bprs")
_MICE_METHODS = {**{c: "pmm" for c in _MICE_ALL}, **{c: "norm" for c in _v("bprs", 1)}}

IMPUTATIONS = {
    s.name: s
    for s in [
        ImputationSpec("fcs_bprs", "fcs", _BPRS_COVS + _v("bprs"), seed=11,
                       categorical=("SEX", "EDU", "JOB", "WZC")),
        ImputationSpec("fcs_bprs_full", "fcs", _BPRS_COVS + ("abpet0", "taupet0", "INKOMEN") + _v("bprs"),
                       seed=11111, categorical=("SEX", "EDU", "JOB", "WZC")),
        ImputationSpec("fcs_bprs_default", "fcs", ("AGE", "BMI", "EDU", "JOB", "ADL", "WZC", "cdrsb0", "SEX",
                       "TRIAL") + _v("bprs"), seed=11, categorical=("SEX", "TRIAL", "JOB", "WZC", "EDU")),
        ImputationSpec("fcs_bprs_mnar", "fcs", ("AGE", "BMI", "SEX") + _v("bprs"),
                       delta={c: 5.0 for c in _v("bprs", 1)}, round_to=1.0),
        ImputationSpec("fcs_cdrsb", "fcs", ("SEX", "AGE", "EDU", "BMI", "JOB", "ADL", "WZC") + _v("cdrsb"),
                       seed=12345, categorical=("SEX", "EDU", "JOB", "WZC")),
        ImputationSpec("monotone_glmm", "monotone", ("SEX", "AGE", "BMI", "ADL") + _INTERLEAVED,
                       seed=3, categorical=("SEX",)),
        ImputationSpec("mvn_gee", "mvn", ("AGE", "BMI", "SEX", "ADL") + _v("taupet") + _v("abpet") + _v("cdrsb"),
                       iterations=200, round_to=1.0),
        ImputationSpec("mvn_cdrsb", "mvn", ("AGE", "BMI", "SEX") + _v("cdrsb"), iterations=200, round_to=1.0),
        ImputationSpec("mvn_all", "mvn", ("SEX", "AGE", "EDU_NUM", "BMI", "INKOMEN", "JOB", "ADL", "WZC", "TRIAL")
                       + _v("cdrsb") + _v("bprs") + _v("abpet") + _v("taupet"), iterations=200, round_to=1.0),
        ImputationSpec("mice_shift", "fcs", _MICE_VARS, m=20, iterations=5, ridge=0.001,
                       categorical=("TRIAL", "SEX", "EDU", "JOB", "WZC"),
                       columns={c: "norm" for c in _v("bprs", 1)}),
        ImputationSpec("mice_pattern_shift", "fcs", ("pattern",) + _MICE_VARS, m=20, iterations=5, ridge=0.001,
                       categorical=("TRIAL", "SEX", "EDU", "JOB", "WZC", "pattern"),
                       columns={c: "norm" for c in _v("bprs", 1)},
                       predictors=past_only(("pattern",) + _MICE_VARS)),
        ImputationSpec("mice_ncmv", "fcs", ("pattern",) + _MICE_VARS, m=10, seed=486048, iterations=5, ridge=0.001,
                       categorical=("TRIAL", "SEX", "EDU", "JOB", "WZC", "pattern"),
                       columns={c: "norm" for c in _v("bprs", 1)},
                       predictors=past_only(("pattern",) + _MICE_VARS)),
        ImputationSpec("mice_whole_frame", "fcs", _MICE_ALL, m=20, iterations=5, ridge=0.001,
                       categorical=("TRIAL", "SEX", "EDU", "JOB", "WZC"), columns=_MICE_METHODS),
    ]
}
