"""Quality measures as SQL expressions over sufficient statistics.

Every measure is a text that Spark parses with ``expr``; names in it are columns
of doubles. Single nominal target: N, H, B, HB (rows, positives, covered rows,
covered positives). Single numeric: N, c0, S1, S2 (covered rows, sum and sum
of squares of the target less its mean), mu (mean), sigma (population deviation),
S2_all (sum of squares of all). Two numeric targets: c0, Sx, Sy, Sxy, Sxx, Syy, and
the same of the whole table with ``_b``. Two binary targets: nA, tA, nB, tB and
``_b``. Rankings: B, N and one mean preference for each pair and set.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Measure:
    """With ``call``, a function of kernels, the quality is that function of the expression, or of these columns."""

    name: str
    expression: str
    minimum: float
    call: str | None = None
    columns: tuple[str, ...] = ()


def _either(test: str, yes: str, no: str) -> str:
    return f"(case when {test} then {yes} else {no} end)"


def _cells(log: str) -> str:
    """Sum of p log(p / (px py)) over the four cells, empty cells counting nothing."""
    cells = [("HB", "H", "B"), ("(H - HB)", "H", "(N - B)"), ("(B - HB)", "(N - H)", "B"), ("(N - H - B + HB)", "(N - H)", "(N - B)")]
    return "(" + " + ".join(_either(f"{c} > 0", f"({c} / N) * {log}({c} * N / nullif({a} * {b}, 0))", "0.0") for c, a, b in cells) + ")"


def _entropy(p: str) -> str:
    part = lambda x: _either(f"{x} > 0", f"-({x}) * log2({x})", "0.0")
    return f"({part(p)} + {part(f'(1 - {p})')})"


WRACC = "(HB / N - (H / N) * (B / N))"
_CHI = "(" + " + ".join(f"power({obs} - {exp}, 2) / {exp}" for obs, exp in [("HB", "(H * B / N)"), ("(H - HB)", "(H * (N - B) / N)"), ("(B - HB)", "((N - H) * B / N)"), ("(N - H - B + HB)", "((N - H) * (N - B) / N)")]) + ")"


def _nominal(expression: str) -> str:
    return _either("H = 0 or H = N", "0.0", expression)


NOMINAL = {m.name: m if m.call else Measure(m.name, _nominal(m.expression), m.minimum) for m in [
    Measure("normalised_wracc", f"{WRACC} / (H / N - power(H / N, 2))", 0.1),
    Measure("wracc", WRACC, 0.02),
    Measure("abs_wracc", f"abs({WRACC})", 0.02),
    Measure("binomial", "sqrt(B / N) * (HB / B - H / N)", 0.05),
    Measure("chi_squared", _either("B = 0 or B = N", "0.0", _CHI), 50),
    Measure("information_gain", f"({_entropy('(H / N)')} - (B / N) * {_entropy('(HB / B)')} - (1 - B / N) * " + _either("N > B", _entropy("((H - HB) / nullif(N - B, 0))"), "0.0") + ")", 0.02),
    Measure("mutual_information", _cells("ln"), 0.01),
    Measure("target_share", "HB / B", 0),
    Measure("purity", "greatest(HB / B, 1 - HB / B)", 0.5),
    Measure("jaccard", "HB / (B + H - HB)", 0.2),
    Measure("coverage", "B", 10),
    Measure("specificity", "(N - H - B + HB) / (N - H)", 0.5),
    Measure("sensitivity", "HB / H", 0.5),
    Measure("laplace", "(HB + 1) / (B + 2)", 0.2),
    Measure("f_measure", "HB / (B + H)", 0.2),
    Measure("g_measure", "HB / (B - HB + H)", 0.2),
    Measure("correlation", _either("B = 0 or B = N", "0.0", "(HB * (N - H) - H * (B - HB)) / sqrt(nullif(H * (N - H) * B * (N - B), 0))"), 0.1),
    Measure("lift", "HB * N / (B * H)", 1),
    Measure("relative_lift", "HB * N / (B * H) - 1", 0),
    Measure("bayesian_score", "", 0, "bayesian_scores", ("N", "H", "B", "HB")),
]}
#: With ps, the covered rows' sum of propensity scores.
PROPENSITY = {"prop_score_wracc": Measure("prop_score_wracc", "(HB / B - ps / B) * B / N", -0.25), "prop_score_ratio": Measure("prop_score_ratio", "(HB / N) / nullif(ps / N, 0)", 1)}

_Z = "sqrt(c0) * (S1 / c0) / nullif(sigma, 0)"
_T = _either("c0 <= 1", "0.0", "coalesce(sqrt(c0) * (S1 / c0) / nullif(sqrt((S2 - S1 * S1 / c0) / nullif(c0 - 1, 0)), 0), 0.0)")
#: S1 is centred on mu, so S1 / c0 is the deviation of the mean.
NUMERIC = {m.name: m for m in [
    Measure("explained_variance", "1 - ((S2 - S1 * S1 / c0) + " + _either("N > c0", "(S2_all - S2) - S1 * S1 / nullif(N - c0, 0)", "0.0") + ") / nullif(S2_all, 0)", 0),
    Measure("z_score", _Z, 1), Measure("inverse_z_score", f"-({_Z})", 1), Measure("abs_z_score", f"abs({_Z})", 1),
    Measure("average", "S1 / c0 + mu", 0), Measure("inverse_average", "-(S1 / c0 + mu)", 0),
    Measure("sum", "S1 + c0 * mu", 0), Measure("inverse_sum", "-(S1 + c0 * mu)", 0),
    Measure("abs_deviation", "abs(S1 / c0)", 0),
    Measure("mean_test", "sqrt(c0) * (S1 / c0)", 0.01), Measure("inverse_mean_test", "-(sqrt(c0) * (S1 / c0))", 0.01), Measure("abs_mean_test", "abs(sqrt(c0) * (S1 / c0))", 0.01),
    Measure("t_test", _T, 1), Measure("inverse_t_test", f"-({_T})", 1), Measure("abs_t_test", f"abs({_T})", 1),
]}

_R = "coalesce((c0 * Sxy - Sx * Sy) / nullif(sqrt(greatest((c0 * Sxx - Sx * Sx) * (c0 * Syy - Sy * Sy), 0)), 0), 0.0)"


def _complement(text: str) -> str:
    """The expression for the rows outside: every statistic taken from the whole."""
    import re

    return re.sub(r"\b(c0|Sx|Sy|Sxy|Sxx|Syy)\b", lambda m: f"({m[0]}_b - {m[0]})", text)


_DISTANCE = _either("c0 <= 2 or c0_b - c0 <= 2", "0.0", f"abs({_complement(_R)} - {_R})")
_D = "(Sxy / nullif(Sy, 0) - (Sx - Sxy) / nullif(c0 - Sy, 0))"
#: Difference of two Fisher-transformed correlations in standard errors; null for three rows or fewer on a side.
_FISHER = f"(case when c0 > 3 and c0_b - c0 > 3 then (atanh(greatest(least({_R}, 1 - 1e-12), -1 + 1e-12)) - atanh(greatest(least({_complement(_R)}, 1 - 1e-12), -1 + 1e-12))) / (1 / sqrt(c0 - 3) + 1 / sqrt(c0_b - c0 - 3)) end)"
CORRELATION = {m.name: m for m in [
    Measure("correlation_r", _R, 0.2), Measure("correlation_r_neg", f"-({_R})", 0.2), Measure("correlation_r_neg_sq", f"-power({_R}, 2)", 0.2), Measure("correlation_r_sq", f"power({_R}, 2)", 0.2),
    Measure("correlation_distance", _DISTANCE, 0),
    Measure("correlation_p", _FISHER, 0, "greater_tail"),
    Measure("correlation_entropy", _either("c0 = 0", "0.0", f"-(c0 / c0_b) * log2(c0 / c0_b) * {_DISTANCE}"), 0),
    Measure("adapted_wracc", "(Sx / c0 - Sy / c0) * c0 / c0_b", 0),
    Measure("costs_wracc", "coalesce((Sx - c0 * Sx_b / c0_b) * (Sxy / nullif(Sx, 0) - (Sy_b - Sy) / nullif(c0_b - c0, 0)), 0.0)", 0),
    Measure("cwtpd", "coalesce((Sy - (c0 / c0_b) * Sy_b) * Sxy / nullif(Sy, 0), 0.0)", 0),
    Measure("tmcc", f"coalesce(Sy * {_D}, 0.0)", 0), Measure("mcc", f"coalesce({_D}, 0.0)", 0),
    Measure("pdc", "coalesce(Sxy / nullif(Sx_b, 0) - (Sxy_b / nullif(Sx_b, 0)) * (Sx / nullif(Sx_b, 0)), 0.0)", 0),
    Measure("mvpdc", "coalesce(Sxy - Sxy_b * Sx / nullif(Sx_b, 0), 0.0)", 0),
]}

_SLOPE = "((c0 * Sxy - Sx * Sy) / nullif(c0 * Sxx - Sx * Sx, 0))"
_ICEPT = f"((Sy - {_SLOPE} * Sx) / c0)"
_SSE = f"(Syy - 2 * {_ICEPT} * Sy - 2 * {_SLOPE} * Sxy + c0 * power({_ICEPT}, 2) + 2 * {_ICEPT} * {_SLOPE} * Sx + power({_SLOPE}, 2) * Sxx)"
_nc, _xc, _yc, _xyc, _xxc, _yyc = (f"({s}_b - {s})" for s in ("c0", "Sx", "Sy", "Sxy", "Sxx", "Syy"))
#: The complement's error is measured against the subgroup's line.
_SSE_C = f"({_yyc} - 2 * {_ICEPT} * {_yc} - 2 * {_SLOPE} * {_xyc} + {_nc} * power({_ICEPT}, 2) + 2 * {_ICEPT} * {_SLOPE} * {_xc} + power({_SLOPE}, 2) * {_xxc})"
_V = f"({_SSE} / nullif(c0 - 2, 0) / nullif(Sxx - Sx * Sx / c0, 0))"
_VC = f"({_SSE_C} / nullif({_nc} - 2, 0) / nullif({_xxc} - {_xc} * {_xc} / nullif({_nc}, 0), 0))"
_ERR = f"nullif(sqrt(greatest({_V} + {_VC}, 0)), 0)"
_SLOPE_B, _SLOPE_C = "((c0_b * Sxy_b - Sx_b * Sy_b) / nullif(c0_b * Sxx_b - Sx_b * Sx_b, 0))", _complement(_SLOPE)
_ICEPT_B, _ICEPT_C = f"((Sy_b - {_SLOPE_B} * Sx_b) / c0_b)", f"(({_yc} - {_SLOPE_C} * {_xc}) / nullif({_nc}, 0))"
#: Shift of the coefficients of the line of all rows when the subgroup is left out.
_D0, _D1 = f"({_ICEPT_B} - {_ICEPT_C})", f"({_SLOPE_B} - {_SLOPE_C})"
_S2 = f"((Syy_b - {_ICEPT_B} * Sy_b - {_SLOPE_B} * Sxy_b) / nullif(c0_b - 2, 0))"
_COOK = f"coalesce((c0_b * {_D0} * {_D0} + 2 * Sx_b * {_D0} * {_D1} + Sxx_b * {_D1} * {_D1}) / nullif(2 * {_S2}, 0), 0.0)"
_OUT = "c0 in (0, 2) or c0_b - c0 in (0, 2)"
REGRESSION = {m.name: m for m in [
    Measure("ssd_complement", _either(_OUT, "0.0", f"coalesce(abs({_complement(_SLOPE)} - {_SLOPE}) / {_ERR}, 0.0)"), 0),
    Measure("ssd_dataset", _either(_OUT, "0.0", f"coalesce(abs((c0_b * Sxy_b - Sx_b * Sy_b) / nullif(c0_b * Sxx_b - Sx_b * Sx_b, 0) - {_SLOPE}) / {_ERR}, 0.0)"), 0),
    Measure("flatness", _either(_OUT, "0.0", f"coalesce(-abs({_SLOPE}), 0.0)"), 0),
    Measure("ssd_4", _either(_OUT, "0.0", f"coalesce(abs({_complement(_SLOPE)} - {_SLOPE}) / {_ERR}, 0.0)"), 0),
    Measure("cooks_distance", _either(f"{_nc} > 2", _COOK, "0.0"), 0),
]}

_LA, _LB = ("((t{0} / nullif(n{0}, 0) - t{0}_b / nullif(n{0}_b, 0)) / nullif(t{0}_b / nullif(n{0}_b, 0), 0))".format(g) for g in "AB")
_BOTH = "nA > 0 and nB > 0"
_GA, _GB = ("(t{0} / n{0}_b - (t{0}_b / n{0}_b) * (n{0} / n{0}_b))".format(g) for g in "AB")
DOUBLE_BINARY = {m.name: m for m in [
    Measure("relative_wracc", _either(_BOTH, f"coalesce({_GA} / nullif({_GB}, 0), 3.4028234663852886e38)", "0.0"), 0),
    Measure("absolute_wracc", _either(_BOTH, f"{_GA} - {_GB}", "0.0"), 0),
    Measure("relative_risk", _either(_BOTH, f"coalesce({_LA} / nullif({_LB}, 0), 3.4028234663852886e38)", "0.0"), 0),
    Measure("absolute_risk", _either(_BOTH, f"coalesce({_LA} - {_LB}, 0.0)", "0.0"), 0),
]}

#: loss and loss_all: mean over positives of the negatives ranked above, ties a half.
SCAPE = {m.name: m for m in [Measure("subranking_loss", "loss", 0), Measure("negative_subranking_loss", "-loss", 0), Measure("relative_subranking_loss", "loss - loss_all", 0), Measure("reverse_relative_subranking_loss", "loss_all - loss", 0)]}

#: S1 is a sum of ranks, med and mad the covered ranks' median and median absolute deviation.
_W = "coalesce((S1 - B * (N + 1) / 2) / nullif(sqrt(B * (N - B) * (N + 1) / 12), 0), 0.0)"
ORDINAL = {m.name: m for m in [
    Measure("auc", "coalesce(1 + (B * (B + 1) / 2 - S1) / nullif(B * (N - B), 0), 0.0)", 0.5),
    Measure("wmw_ranks", _W, 1), Measure("inverse_wmw_ranks", f"-({_W})", 1), Measure("abs_wmw_ranks", f"abs({_W})", 1),
    Measure("mmad", "B / nullif(2 * med + mad, 0)", 0),
]}


def ranking(labels: int) -> dict[str, Measure]:
    """Label-ranking measures over mean preferences m_i_j (all rows) and s_i_j (covered), i < j; j preferred counts 1."""
    pairs = [(i, j) for i in range(labels) for j in range(i + 1, labels)]

    def d(i: int, j: int) -> str:
        return f"((m_{i}_{j} - s_{i}_{j}) / 2)" if i < j else f"(-(m_{j}_{i} - s_{j}_{i}) / 2)"

    def s(i: int, j: int) -> str:
        return "0.0" if i == j else f"s_{i}_{j}" if i < j else f"(-s_{j}_{i})"

    norm = f"(sqrt({' + '.join(f'power({d(i, j)}, 2)' for i, j in pairs)}) / {len(pairs)})"
    frobenius = f"sqrt({' + '.join(f'2 * power(s_{i}_{j}, 2)' for i, j in pairs)})"
    by_label = [f"(sqrt({' + '.join(f'power({d(i, j)}, 2)' for j in range(labels) if j != i)}) / {labels - 1})" for i in range(labels)]
    least = lambda f: f"{f}({', '.join(by_label)})"
    def m(i: int, j: int) -> str:
        return f"m_{i}_{j}" if i < j else f"(-m_{j}_{i})"

    others = lambda i: [j for j in range(labels) if j != i]
    mean = lambda f, i: f"(({' + '.join(f(i, j) for j in others(i))}) / {labels - 1})"
    cov = " + ".join("(-(" + " + ".join(f"({m(i, j)} - {mean(m, i)}) * ({s(i, j)} - {mean(s, i)})" for j in others(i)) + f") / {max(labels - 2, 1)})" for i in range(labels))
    weight = "sqrt(B / N)"
    return {m.name: m for m in [
        Measure("lr_norm", f"{weight} * {norm}", 0), Measure("lr_norm_mode", f"{weight} * {norm}", 0), Measure("lr_wnorm", f"{weight} * {norm} * {frobenius}", 0),
        Measure("lr_labelwise_min", f"{weight} * {least('least')}", 0), Measure("lr_labelwise_max", f"{weight} * {least('greatest')}", 0),
        Measure("lr_pairwise_max", f"{weight} * greatest({', '.join(f'abs({d(i, j)})' for i, j in pairs)})" if len(pairs) > 1 else f"{weight} * abs({d(0, 1)})", 0),
        Measure("lr_covariance", f"{weight} * (({cov}) / {labels})", 0),
    ]}


#: Measures by target type; density and network measures are in kernels.
BY_TARGET = {"single_nominal": NOMINAL, "single_numeric": NUMERIC, "double_correlation": CORRELATION, "double_regression": REGRESSION, "double_binary": DOUBLE_BINARY, "scape": SCAPE, "single_ordinal": ORDINAL}
