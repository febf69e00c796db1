"""Statistics that are not sums: densities, networks and Bayes factors, in numpy.

Densities are sums over rows at grid points that are fixed beforehand, so that
partial sums of any split of the rows add up; rows are distinct values with
counts. Nothing here keeps state, and every function can be sent to a task.
"""

from __future__ import annotations

import math

import numpy as np

#: Grid points of a density, deviations at which a kernel is cut, and the greatest weighted squared Hellinger distance.
GRID, CUT, MOST_HELLINGER = 1001, 4.0, 4 / 27
#: Fixed values of densities of two columns: deviations by which a grid reaches beyond all rows, and grid steps in a deviation.
REACH, STEPS = 3.0, math.sqrt(2)
#: Grid points of a column that a row is spread over, and the steepness of the bell by which it is.
SPREAD, BELL = 14, 2.3 * 14
#: Deviations beyond which exp(-z^2 / 2) is 0 as a double.
VANISHED = 38.7


def log_gamma(x) -> np.ndarray:
    """ln of the gamma function for positive numbers: Stirling's series, arguments below 10 shifted up by 10."""
    x = np.asarray(x, float)
    low = x < 10
    y = np.where(low, x + 10, x)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series
    if low.any():
        small = np.where(low, x, 1.0)
        out = out - np.where(low, sum(np.log(small + i) for i in range(10)), 0.0)
    return out


def bandwidth_of(n: float, sd: float, q1: float, q3: float, low: float, high: float) -> float:
    """0.9 min(sd, IQR / 1.34) n^-0.2, at least a thousandth of the range."""
    return max(0.9 * min(sd, (q3 - q1) / 1.34) * n**-0.2, (high - low) / 1000, 1e-12)


def grid_of(low: float, high: float, h: float) -> np.ndarray:
    return np.linspace(low - CUT * h, high + CUT * h, GRID)


def kernel_sums(values: np.ndarray, counts: np.ndarray, grid: np.ndarray, h: float) -> np.ndarray:
    """Sum of cut Gaussian kernels (height 1) at the grid points, in blocks."""
    out = np.zeros(len(grid))
    for a in range(0, len(values), 2048):
        z = (grid[:, None] - values[None, a : a + 2048]) / h
        k = np.exp(-0.5 * z * z)
        k[np.abs(z) > CUT + 1e-9] = 0  # grid points lie on the edge but for rounding
        out += k @ counts[a : a + 2048]
    return out


def density(values: np.ndarray, counts: np.ndarray, grid: np.ndarray, h: float) -> np.ndarray:
    return kernel_sums(values, counts, grid, h) / (counts.sum() * h * math.sqrt(2 * math.pi))


def weighted(name: str) -> bool:
    """Whether a divergence is multiplied by the subgroup's share of rows."""
    base = name.replace("_2d", "")
    return base.endswith("weighted") and not base.endswith("unweighted") or base.endswith("adjusted") or base == "cwracc"


def divergence(name: str, p: np.ndarray, q: np.ndarray, share: float) -> float:
    """Plain sums over the points of one column's grid: the density p of all rows against the subgroup's density q."""
    if "hellinger" in name:
        value = 0.5 * ((np.sqrt(p) - np.sqrt(q)) ** 2).sum()
    elif "kullback" in name:
        ok = q > 0
        with np.errstate(divide="ignore"):
            value = float((q[ok] * np.log(q[ok] / p[ok])).sum())
    else:
        value = np.abs(p - q).sum()
    value *= share if weighted(name) else 1.0
    return float(value / MOST_HELLINGER if name.endswith("adjusted") else value)


DENSITY = ("squared_hellinger", "squared_hellinger_weighted", "squared_hellinger_weighted_adjusted", "kullback_leibler", "kullback_leibler_weighted", "cwracc", "cwracc_unweighted")
DENSITY_2D = tuple(f"{m}_2d" for m in DENSITY)




def moments(n: float, sx: float, sy: float, sxx: float, syy: float, sxy: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (n - 1) from sums."""
    mean = np.array([sx, sy]) / n
    second = np.array([[sxx, sxy], [sxy, syy]])
    return mean, (second - n * np.outer(mean, mean)) / (n - 1)


def plane_of(n: float, cov: np.ndarray, n_out: float, cov_out: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict | None:
    """Bandwidth matrices of subgroup and complement (covariance times n^(-1/3)) and their common grid; None for degenerate data.

    The grid reaches three of the larger deviation beyond all rows, in steps of the smaller one by sqrt 2.
    """
    if min(n, n_out) < 3:
        return None
    ha, hb = cov * n ** (-1 / 3), cov_out * n_out ** (-1 / 3)
    if any(np.diag(h).min() <= 0 or np.linalg.det(h) <= 1e-12 * np.diag(h).prod() for h in (ha, hb)):
        return None
    sd = np.sqrt([np.diag(ha), np.diag(hb)])
    reach, step = REACH * sd.max(axis=0), sd.min(axis=0) / STEPS
    size = np.floor((high - low + 2 * reach) / step).astype(int)
    return {"inside": ha, "outside": hb, "axes": [low[j] - reach[j] + step[j] * np.arange(size[j]) for j in (0, 1)], "cell": float(step.prod())}


def plane_sums(rows: np.ndarray, counts: np.ndarray, axes: list[np.ndarray], h: np.ndarray, block: int = 256) -> np.ndarray:
    """Sum of Gaussian kernels (height 1) of two columns at the points of a grid; in coordinates where the kernel is round.

    Neighbouring rows go together to the part of the grid where their kernels have not vanished.
    """
    w, reach = np.linalg.cholesky(np.linalg.inv(h)), VANISHED * np.sqrt(np.diag(h))
    out = np.zeros((len(axes[0]), len(axes[1])))
    tile = [np.floor(rows[:, j] / reach[j]) for j in (0, 1)]
    order = np.lexsort((rows[:, 1], tile[1], tile[0]))
    for a in range(0, len(order), block):
        own, c = rows[order[a : a + block]], counts[order[a : a + block]]
        part = tuple(slice(*np.searchsorted(axes[j], (own[:, j].min() - reach[j], own[:, j].max() + reach[j]))) for j in (0, 1))
        grid = np.stack(np.meshgrid(axes[0][part[0]], axes[1][part[1]], indexing="ij"), axis=-1)
        shape, points, x = grid.shape[:2], grid.reshape(-1, 2) @ w, own @ w
        each = max(1, 4_000_000 // max(1, len(points)))
        for b in range(0, len(x), each):
            z = (points[:, :1] - x[None, b : b + each, 0]) ** 2
            z += (points[:, 1:] - x[None, b : b + each, 1]) ** 2
            z *= -0.5
            out[part] += (np.exp(z, out=z) @ c[b : b + each]).reshape(shape)
    return out.ravel()


def plane_factor(n: float, h: np.ndarray) -> float:
    """What a sum of kernels is multiplied by to be a density."""
    return float(1 / (n * 2 * math.pi * math.sqrt(np.linalg.det(h))))


def silverman(n: float, columns: int) -> float:
    """(4 / (d + 2))^(1 / (d + 4)) n^(-1 / (d + 4))."""
    return (4 / (columns + 2)) ** (1 / (columns + 4)) * n ** (-1 / (columns + 4))


def l2_scale(n: float, sd: np.ndarray, n_out: float, sd_out: np.ndarray) -> np.ndarray:
    """Deviations of the kernel between a member and another row: both sides' bandwidths, squared and added."""
    d = len(sd)
    return np.sqrt((silverman(n, d) * sd) ** 2 + (silverman(n_out, d) * sd_out) ** 2)


def l2_of(kernel_sum: float, scale: np.ndarray, n: float, n_out: float) -> float:
    """The sum of kernels over all pairs of a member and another row, scaled."""
    return float(kernel_sum / ((2 * math.pi) ** (len(scale) / 2) * np.prod(scale) * math.sqrt(n * n_out)))


def pair_kernel_sum(a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray, scale: np.ndarray) -> float:
    """Sum of exp(-M^2 / 2) over pairs of rows with counts, in blocks."""
    a, b, total = a / scale, b / scale, 0.0
    for i in range(0, len(a), 256):
        z = ((a[i : i + 256, None, :] - b[None, :, :]) ** 2).sum(axis=2)
        total += ca[i : i + 256] @ np.exp(-0.5 * z) @ cb
    return float(total)


def wave_grid(low: np.ndarray, high: np.ndarray, scales: np.ndarray) -> dict:
    """A grid over the rows' range on which kernels of one or two columns, of all these scales, are Fourier series.

    The period leaves 9 of the largest deviations beyond the range, so that copies of a kernel do not reach in; waves
    beyond frequency 9 of the smallest weigh below 3e-18 and are left out. The grid has two points for each wave that stays.
    """
    period = high - low + 9 * scales.max(axis=0)
    most = np.ceil(9 * period / (2 * math.pi * scales.min(axis=0))).astype(int)
    size = 2 * (2 * most + 1)
    return {"low": low, "period": period, "most": most, "size": size, "step": period / size}


def spread_over(rows: np.ndarray, grid: dict, out: np.ndarray) -> None:
    """Adds each row to the SPREAD nearest grid points of every column, by a bell whose waves are known: sums of any split of the rows add up."""
    size = grid["size"]
    for a in range(0, len(rows), 4096):
        t = (rows[a : a + 4096] - grid["low"]) / grid["step"]
        at = np.ceil(t - SPREAD / 2).astype(np.int64)[:, None, :] + np.arange(SPREAD)[None, :, None]
        bell = _bell((at - t[:, None, :]) * (2 / SPREAD))
        at %= size
        place, weight = at[:, :, 0], bell[:, :, 0]
        if len(size) > 1:
            place, weight = place[:, :, None] * size[1] + at[:, None, :, 1], weight[:, :, None] * bell[:, None, :, 1]
        out += np.bincount(place.ravel(), weight.ravel(), len(out))


def _bell(z: np.ndarray) -> np.ndarray:
    return np.exp(BELL * (np.sqrt(np.maximum(1 - z * z, 0)) - 1))


def _wave_weights(grid: dict, scale: np.ndarray) -> np.ndarray:
    """What the product of two sides' waves is multiplied by: the kernel's own weight, less what the bell has done to both."""
    z, share = np.polynomial.legendre.leggauss(200)
    out = np.ones(())
    for j, (size, most, period) in enumerate(zip(grid["size"], grid["most"], grid["period"])):
        k = np.abs(np.rint(np.fft.fftfreq(size) * size))
        of_bell = SPREAD / 2 * (np.cos(np.outer(np.minimum(k, most), z) * (math.pi * SPREAD / size)) @ (share * _bell(z)))
        own = math.sqrt(2 * math.pi) * scale[j] / period * np.exp(-0.5 * (2 * math.pi * k * scale[j] / period) ** 2)
        out = np.multiply.outer(out, np.where(k <= most, own / of_bell**2, 0.0))
    return out


def wave_kernel_sum(a: np.ndarray, b: np.ndarray, grid: dict, scale: np.ndarray) -> float:
    """The sum of exp(-M^2 / 2) over all pairs of a row of one side and one of the other, from both sides' sums at the grid points."""
    a, b = (np.fft.fftn(x.reshape(tuple(grid["size"]))) for x in (a, b))
    return float((_wave_weights(grid, scale) * (a * b.conj()).real).sum())


# --- Bayes factor of a subgroup ------------------------------------------------


#: Priors of the models equal, higher and lower.
PRIORS = (0.33333333, 0.33333333, 0.33333334)
#: Terms summed at once; terms that are left out come to less than e^-VANISHING of the greatest one, all together.
TERMS, VANISHING = 1 << 20, 42.0


def _log_beta(a, b):
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def _last(holds, low: int, high: int) -> int:
    """The last whole number of low..high up to which a falling condition holds; it holds at low."""
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if holds(middle) else (low, middle - 1)
    return low


def log_exceeds(c: int, d: int, a: int, b: int) -> float:
    """ln P(X > Y) of X ~ Beta(c, d), Y ~ Beta(a, b), whole numbers: a sum of c terms or, mirrored, of b, whichever are fewer.

    The ratio of term k + 1 to term k is (a + k)(d + k) / ((a + b + d + k)(1 + k)), which is above 1 just where
    (b + 1) k < ad - a - b - d: terms rise to one greatest and fall from there. Only those are summed that can count
    for a double, about the square root of the number of rows; the others are c at most, and each below e^-VANISHING / c of
    the greatest.
    """
    if b < c:
        a, b, c, d = d, c, b, a
    term = lambda k: _log_beta(a + k, b + d) - np.log(d + k) - _log_beta(1 + k, d) - _log_beta(a, b)
    peak = min(max(-((a + b + d - a * d) // (b + 1)), 0), c - 1)
    least = float(term(float(peak))) - VANISHING - math.log(c)
    counts = lambda k: float(term(float(k))) >= least
    first, last = peak - _last(lambda j: counts(peak - j), 0, peak), _last(counts, peak, c - 1)
    total = -math.inf
    for start in range(first, last + 1, TERMS):
        k = np.arange(start, min(last + 1, start + TERMS), dtype=float)
        logs = term(k)
        top = float(logs.max())
        total = float(np.logaddexp(total, top + math.log(np.exp(logs - top).sum())))
    return total


def bayesian_score(n: float, h: float, b: float, hb: float) -> float:
    """ln posterior of 'higher inside' less that of 'equal or lower', with flat beta priors. Both tails are sums of logarithms, so neither saturates."""
    n11, n12, n21 = int(hb), int(b - hb), int(h - hb)
    n22 = int(n) - n11 - n12 - n21
    inside, outside = (n11 + 1, n12 + 1), (n21 + 1, n22 + 1)
    equal = float(_log_beta(n11 + n21 + 1, n12 + n22 + 1))
    whole = float(_log_beta(*inside) + _log_beta(*outside)) + math.log(2)
    e, up, low = map(math.log, PRIORS)
    higher, lower = whole + log_exceeds(*inside, *outside), whole + log_exceeds(*outside, *inside)
    return up + higher - float(np.logaddexp(e + equal, low + lower))


def bayesian_scores(n: np.ndarray, h: np.ndarray, b: np.ndarray, hb: np.ndarray) -> np.ndarray:
    return np.array([bayesian_score(*x) for x in zip(n, h, b, hb)])


# --- Bayesian networks over boolean targets ------------------------------------


def bdeu(counts: dict[int, int], child: int, parents: tuple[int, ...]) -> float:
    """Family score with alpha = 1 / 2^(1 + parents) a cell; counts by bit mask."""
    q = 1 << len(parents)
    cells = np.zeros((q, 2))
    for mask, n in counts.items():
        key = sum(((mask >> p) & 1) << i for i, p in enumerate(parents))
        cells[key, (mask >> child) & 1] += n
    alpha = 1.0 / (2 * q)
    rows = cells.sum(axis=1)
    return float((log_gamma(cells + alpha) - math.lgamma(alpha)).sum() - (log_gamma(rows + 2 * alpha) - math.lgamma(2 * alpha)).sum())


def _reaches(edges: set, a: int, b: int) -> bool:
    seen, stack = set(), [a]
    while stack:
        x = stack.pop()
        if x == b:
            return True
        if x not in seen:
            seen.add(x)
            stack += [v for u, v in edges if u == x]
    return False


def learn_network(counts: dict[int, int], k: int, seed: int = 1, max_parents: int = 3, restarts: int = 2) -> frozenset:
    """Hill climbing over add, remove and reverse; seeded reversals of arcs between restarts."""
    rng = np.random.default_rng(seed)
    parents = lambda e, x: tuple(sorted(u for u, v in e if v == x))
    memo: dict = {}

    def family(x: int, own: tuple) -> float:
        if (x, own) not in memo:
            memo[x, own] = bdeu(counts, x, own)
        return memo[x, own]

    def climb(edges: set) -> tuple[set, float]:
        while True:
            best, move = 1e-9, None
            for a in range(k):
                for b in range(k):
                    if a == b:
                        continue
                    if (a, b) in edges:
                        options = [edges - {(a, b)}]
                        if not _reaches(edges - {(a, b)}, a, b):
                            options.append(edges - {(a, b)} | {(b, a)})
                    elif (b, a) in edges or _reaches(edges, b, a):
                        continue
                    else:
                        options = [edges | {(a, b)}]
                    for new in options:
                        if len(parents(new, a)) <= max_parents and len(parents(new, b)) <= max_parents:
                            gain = sum(family(x, parents(new, x)) - family(x, parents(edges, x)) for x in (a, b))
                            if gain > best:
                                best, move = gain, new
            if move is None:
                return edges, sum(family(x, parents(edges, x)) for x in range(k))
            edges = move

    best, score = climb(set())
    for _ in range(restarts):
        trial = set(best)
        for a, b in list(trial):
            if rng.random() < 0.5 and not _reaches(trial - {(a, b)}, a, b):
                trial = trial - {(a, b)} | {(b, a)}
        found, value = climb(trial)
        if value > score + 1e-9:
            best, score = found, value
    return frozenset(best)


def v_structures(edges: frozenset) -> set:
    """Unconnected pairs with a common child."""
    joined = {frozenset(e) for e in edges}
    return {frozenset((a, b)) for a, c in edges for b, d in edges if c == d and a != b} - joined


def edit_distance(a: frozenset, b: frozenset, k: int) -> float:
    """Pairs that only one network connects, and pairs that neither connects but of which only one makes a v-structure, over the number of pairs."""
    one, two = ({frozenset(e) for e in x} for x in (a, b))
    return (len(one ^ two) + len((v_structures(a) ^ v_structures(b)) - one - two)) / (k * (k - 1) / 2)


def weed(distance: float, share: float, alpha: float = 0.5, beta: float = 1.0) -> float:
    h = 0.0 if share in (0, 1) else -(share * math.log2(share) + (1 - share) * math.log2(1 - share))
    return h**alpha * distance**beta


def normal_cdf(z) -> np.ndarray:
    return np.array([0.5 * (1 + math.erf(x / math.sqrt(2))) if x == x else math.nan for x in np.asarray(z, float)])


def greater_tail(z) -> np.ndarray:
    """The greater of the normal distribution's tails at z; 0 where there is none."""
    return np.nan_to_num(normal_cdf(np.abs(np.asarray(z, float))), nan=0.0)
