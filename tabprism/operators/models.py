"""Model fitting from sufficient statistics, and Newton steps for the logistic family.

Linear models (least squares, ridge, lasso, elastic net, and the reference's
gradient-descent simple regression) depend on the data only through the mean
vector and covariance matrix of (features, target).  Those come from ONE
aggregate pass (``moments``); the (p×p) solve runs on the driver.  This is
exact and costs one scan however large the table is.

Logistic and softmax regression have no closed form: they are fitted by
Newton steps.  Each step is one pass over the (persisted) training design in
which every task sums its rows' gradient and Hessian with numpy
(``partial_sums``: one small vector per partition reaches the driver), then a
(p+1)-sized solve on the driver.  A handful of passes reach the exact optimum
of the reference's objective (C = 1).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprism.functions.expressions import clip, nan_to_null, rnd, sigmoid, to_double
from tabprism.operators.positions import row_index
from tabprism.constants import (ENET_ALPHA, ENET_L1_RATIO, GD_ALPHA, GD_EPOCHS, LASSO_ALPHA, LOGISTIC_C,  # noqa: E501
                                 RANGE_TEXT, RIDGE_ALPHA, SIG_EPS, TRAIN_FRACTION, Z_CLIP)



# ---------------------------------------------------------------- preparation
@dataclass
class Prepared:
    data: DataFrame          # key, features, target (double), pos, split
    n: int
    n_train: int

    @property
    def train(self) -> DataFrame:
        return self.data.where(F.col("split") == "train")

    @property
    def test(self) -> DataFrame:
        return self.data.where(F.col("split") == "test")

    @property
    def n_test(self) -> int:
        return self.n - self.n_train


def prepare(df: DataFrame, features: Sequence[str], target: str, order_by: Sequence[str] | str,
            train_fraction: float = TRAIN_FRACTION, keep: Sequence[str] = (),
            coerce_target: bool = True, exclude: str | None = None) -> Prepared:
    """Select → leave out flagged rows → coerce to numbers → drop incomplete rows → positional split.

    ``exclude`` names a 0/1 (or boolean) column; rows flagged 1 take no part in
    the fit or its validation, rows with a missing flag do.

    Positions are taken after cleaning (first floor(0.8·n) rows are train),
    as the reference does.  The numbered frame is checkpointed by
    ``row_index``, so train and test never overlap, even after a lost executor.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    feats = list(features)
    tgt = to_double(target) if coerce_target else F.col(target)
    # a key that is also a feature is carried once, as the (double) feature
    key_cols = [k for k in keys if k not in feats and k != target]
    if exclude is not None:
        df = df.where(F.coalesce(F.col(exclude).cast("double"), F.lit(0.0)) != 1)
    d = df.select(*key_cols, *[to_double(c).alias(c) for c in feats], tgt.alias(target),
                  *[c for c in keep if c not in keys and c not in feats and c != target])
    d = d.dropna(how="any", subset=[*feats, target])
    numbered, n = row_index(d, keys, "pos", with_count=True)
    n_train = int(n * float(train_fraction))
    data = numbered.withColumn("split", F.when(F.col("pos") < n_train, "train").otherwise("test"))
    return Prepared(data, n, n_train)


# ---------------------------------------------------------------- moments
@dataclass
class Moments:
    n: int
    mean: np.ndarray
    cov: np.ndarray          # population covariance


def moments(df: DataFrame, cols: Sequence[str]) -> Moments:
    """Count, means and population covariances of ``cols`` in one aggregate."""
    cols = list(cols)
    k = len(cols)
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.avg(F.col(c).cast("double")).alias(f"_m{i}") for i, c in enumerate(cols)]
    aggs += [F.covar_pop(F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double")).alias(f"_c{i}_{j}")
             for i in range(k) for j in range(i, k)]
    r = df.agg(*aggs).first()
    mean = np.array([r[f"_m{i}"] if r[f"_m{i}"] is not None else np.nan for i in range(k)], dtype=float)
    cov = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            v = r[f"_c{i}_{j}"]
            cov[i, j] = cov[j, i] = np.nan if v is None else v
    return Moments(int(r["_n"]), mean, cov)


# ---------------------------------------------------------------- Newton partial sums
def partial_sums(design: DataFrame, cols: Sequence[str], fn) -> np.ndarray:
    """Σ over all rows of ``fn(batch)``: numpy on each Arrow batch inside the tasks,
    one partial-sum vector per partition, added up by a keyed aggregate.

    Used for Newton steps: the coefficients travel in the closure (a few numbers),
    nothing is recompiled between steps, and the per-partition vectors are
    summed inside Spark, so the driver receives one vector.
    """
    cols = list(cols)

    def run(batches):
        acc = None
        for pdf in batches:
            if len(pdf):
                v = fn(pdf[cols].to_numpy(dtype="float64"))
                acc = v if acc is None else acc + v
        if acc is not None:
            yield pd.DataFrame({"_v": [acc.tolist()]})

    parts = design.mapInPandas(run, "_v array<double>")
    # reduce the per-partition vectors inside Spark (map-side combined): the
    # driver receives one vector, however many partitions there are
    rows = (parts.select(F.posexplode("_v").alias("_i", "_x")).groupBy("_i")
            .agg(F.sum("_x").alias("_x")).collect())
    if not rows:
        return None
    out = np.zeros(len(rows))
    for r in rows:
        out[r["_i"]] = r["_x"]
    return out


# ---------------------------------------------------------------- linear models
@dataclass
class LinearParams:
    features: list[str]
    mu: list[float]
    sig: list[float]
    coef: list[float]
    intercept: float
    extra: dict = field(default_factory=dict)

    def z(self, j: int, fill_missing: float | None = None) -> Column:
        x = nan_to_null(F.col(self.features[j]).cast("double"))
        if fill_missing is not None:
            x = F.coalesce(x, F.lit(float(fill_missing)))
        return (x - F.lit(self.mu[j])) / F.lit(self.sig[j])

    def predict(self, fill_missing: float | None = None) -> Column:
        out = F.lit(float(self.intercept))
        for j, w in enumerate(self.coef):
            out = out + F.lit(float(w)) * self.z(j, fill_missing)
        return out


def _std_scales(m: Moments, p: int, eps: float = SIG_EPS, zero_to_one: bool = False):
    sd = np.sqrt(np.maximum(np.diag(m.cov)[:p], 0.0))
    if zero_to_one:
        sd = np.where(sd == 0, 1.0, sd)
    return sd + eps


def fit_mlr(train: DataFrame, features: Sequence[str], target: str) -> LinearParams:
    """M1 + M3: least squares on train-standardised features (population σ + 1e-9).

    With z centred on train the intercept is ȳ and the slopes solve
    corr-scaled normal equations; ``lstsq`` gives the minimum-norm answer for
    constant features, like the reference's solver.
    """
    feats = list(features)
    p = len(feats)
    m = moments(train, [*feats, target])
    sig = _std_scales(m, p)
    czz = m.cov[:p, :p] / np.outer(sig, sig)
    czy = m.cov[:p, p] / sig
    theta = np.linalg.lstsq(czz, czy, rcond=None)[0] if p else np.array([])
    return LinearParams(feats, m.mean[:p].tolist(), sig.tolist(), theta.tolist(), float(m.mean[p]),
                        {"n_train": m.n})


def fit_ridge(train: DataFrame, features: Sequence[str], target: str, alpha: float = RIDGE_ALPHA) -> LinearParams:
    """M2 + M5: ridge on library-standardised features (population σ, constant → 1)."""
    return _fit_penalised(train, features, target, l1=0.0, l2=alpha)


def fit_lasso(train: DataFrame, features: Sequence[str], target: str, alpha: float = LASSO_ALPHA) -> LinearParams:
    """M6: (1/2n)‖y − Zw − b‖² + α‖w‖₁."""
    return _fit_penalised(train, features, target, l1=alpha, l2=0.0, per_n=True)


def fit_elasticnet(train: DataFrame, features: Sequence[str], target: str, alpha: float = ENET_ALPHA,
                   l1_ratio: float = ENET_L1_RATIO) -> LinearParams:
    """M7: (1/2n)‖y − Zw − b‖² + αρ‖w‖₁ + ½α(1−ρ)‖w‖²."""
    return _fit_penalised(train, features, target, l1=alpha * l1_ratio,
                          l2=alpha * (1 - l1_ratio), per_n=True)


def _fit_penalised(train, features, target, l1, l2, per_n=False, tol=1e-13, max_sweeps=100_000):
    feats = list(features)
    p = len(feats)
    m = moments(train, [*feats, target])
    sd = _std_scales(m, p, eps=0.0, zero_to_one=True)
    n = m.n
    G = n * m.cov[:p, :p] / np.outer(sd, sd)          # ZᵀZ of centred, scaled features
    b = n * m.cov[:p, p] / sd                         # Zᵀ(y − ȳ)
    if l1 == 0.0:
        lam = l2 * n if per_n else l2
        w = np.linalg.solve(G + lam * np.eye(p), b)
    else:
        a1, a2 = (l1 * n, l2 * n) if per_n else (l1, l2)
        w = np.zeros(p)
        for _ in range(max_sweeps):
            delta = 0.0
            for j in range(p):
                if G[j, j] + a2 == 0:
                    continue
                rho = b[j] - G[j] @ w + G[j, j] * w[j]
                new = np.sign(rho) * max(abs(rho) - a1, 0.0) / (G[j, j] + a2)
                delta = max(delta, abs(new - w[j]))
                w[j] = new
            if delta <= tol * max(1.0, np.max(np.abs(w))):
                break
        else:
            raise RuntimeError(f"coordinate descent did not converge in {max_sweeps} sweeps")
    return LinearParams(feats, m.mean[:p].tolist(), sd.tolist(), w.tolist(), float(m.mean[p]),
                        {"n_train": n})


@dataclass
class GDResult:
    params: LinearParams
    alpha: float
    epochs: int
    s: float
    c: float
    ybar: float
    q: float

    def theta(self, k: int) -> tuple[float, float]:
        t0 = self.ybar * (1 - (1 - 2 * self.alpha) ** k)
        t1 = (self.c / self.s) * (1 - (1 - 2 * self.alpha * self.s) ** k) if self.s > 0 else 0.0
        return t0, t1

    def cost(self, k: int) -> float:
        t0, t1 = self.theta(k)
        return t0 * t0 + t1 * t1 * self.s + self.q - 2 * t0 * self.ybar - 2 * t1 * self.c


def fit_slr_gd(train: DataFrame, x: str, y: str, alpha: float = GD_ALPHA, epochs: int = GD_EPOCHS) -> GDResult:
    """M4: batch gradient descent from θ = 0 on a train-standardised feature.

    The squared loss is quadratic, so after k epochs the iterates are
    θ₀ = ȳ(1 − (1−2α)^k) and θ₁ = (c/s)(1 − (1−2αs)^k), with s = mean z²,
    c = mean z·y; the train MSE before epoch k is
    q − 2θ₀ȳ − 2θ₁c + θ₀² + θ₁²s (q = mean y²).  One aggregate pass gives
    n, ȳ, s, c, q: no per-epoch job.
    """
    m = moments(train, [x, y])
    sig = math.sqrt(max(m.cov[0, 0], 0.0)) + SIG_EPS
    s = m.cov[0, 0] / (sig * sig)
    c = m.cov[0, 1] / sig
    ybar = float(m.mean[1])
    q = m.cov[1, 1] + ybar * ybar
    r = GDResult(None, alpha, epochs, s, c, ybar, q)
    t0, t1 = r.theta(epochs)
    r.params = LinearParams([x], [float(m.mean[0])], [sig], [t1], t0, {"n_train": m.n})
    return r


def fit_lpm(train: DataFrame, x: str, y: str) -> tuple[float, float]:
    """Simple OLS (intercept, slope) of a 0/1 class on one raw feature."""
    r = train.agg(F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("b"),
                  F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("w")).first()
    return r["b"], r["w"]


def lpm_range(train: DataFrame, x: str, y: str, digits: int = 2) -> DataFrame:
    """Min and max fitted value of the straight-line model over the train rows."""
    b, w = fit_lpm(train, x, y)
    fitted = F.lit(b) + F.lit(w) * F.col(x).cast("double") if w is not None else F.lit(None)
    out = train.agg(rnd(F.min(fitted), digits).alias("lin_min"), rnd(F.max(fitted), digits).alias("lin_max"))
    return out.withColumn("lin_range", F.format_string(RANGE_TEXT, F.col("lin_min").cast("string"),
                                                       F.col("lin_max").cast("string")))


# ---------------------------------------------------------------- logistic family
@dataclass
class LogisticParams:
    features: list[str]
    coef: list[float]
    intercept: float
    mu: list[float] | None = None       # set when inputs are standardised before the dot product
    sig: list[float] | None = None
    iterations: int | None = None

    def z(self) -> Column:
        out = F.lit(float(self.intercept))
        for j, c in enumerate(self.features):
            # a missing input counts as 0, as in the linear scores
            x = F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(0.0))
            if self.mu is not None:
                x = (x - F.lit(self.mu[j])) / F.lit(self.sig[j])
            out = out + F.lit(float(self.coef[j])) * x
        return out

    def probability(self) -> Column:
        return sigmoid(clip(self.z(), -Z_CLIP, Z_CLIP))


class NewtonFit:
    """One penalised maximum-likelihood fit, advanced by gradient and Hessian sums over the rows.

    ``sums(Z, y, beta)`` gives a batch's gradient, Hessian and loss as one vector;
    ``pen`` is the penalty per parameter.  A step that raises the loss is halved.
    """

    def __init__(self, name: str, column: str, beta: np.ndarray, pen: np.ndarray, sums):
        self.name, self.column, self.beta, self.pen, self.sums = name, column, beta, pen, sums
        self.last: tuple | None = None
        self.steps, self.done = 0, False

    def advance(self, total: np.ndarray, tol: float) -> None:
        k = len(self.beta)
        self.steps += 1
        loss = float(total[-1] + 0.5 * (self.pen * self.beta * self.beta).sum())
        if self.last is not None and loss > self.last[1] + 1e-10 * (1.0 + abs(self.last[1])):
            before = self.last[0]
            self.beta = (before + self.beta) / 2.0          # the step overshot: halve it
            if np.max(np.abs(self.beta - before)) <= tol * (1.0 + np.max(np.abs(self.beta))):
                self.beta, self.done = before, True
            return
        self.last = (self.beta, loss)
        gradient = total[:k] + self.pen * self.beta
        step = np.linalg.lstsq(total[k:-1].reshape(k, k) + np.diag(self.pen), gradient, rcond=None)[0]
        self.beta = self.beta - step
        self.done = bool(np.max(np.abs(step)) <= tol * (1.0 + np.max(np.abs(self.beta))))


def newton(design: DataFrame, inputs: Sequence[str], fits: Sequence[NewtonFit], max_iter: int = 100, tol: float = 1e-8) -> None:
    """Advance several fits over one design together: one pass over the rows per round serves all that aren't done."""
    p = len(inputs)
    for _ in range(max_iter):
        open_fits = [f for f in fits if not f.done]
        if not open_fits:
            return
        parts = [(f.sums, f.beta.copy()) for f in open_fits]

        def stacked(m, parts=parts):
            z = np.hstack([np.ones((len(m), 1)), m[:, :p]])
            return np.concatenate([sums(z, m[:, p + i], beta) for i, (sums, beta) in enumerate(parts)])

        total = partial_sums(design, [*inputs, *[f.column for f in open_fits]], stacked)
        if total is None:
            break
        for f in open_fits:
            size = len(f.beta) + len(f.beta) ** 2 + 1
            f.advance(total[:size], tol)
            total = total[size:]
    if missing := [f.name for f in fits if not f.done]:
        raise RuntimeError(f"{', '.join(missing)} did not converge in {max_iter} Newton steps")


def _logistic_sums(z: np.ndarray, y: np.ndarray, beta: np.ndarray) -> np.ndarray:
    u = z @ beta
    pr = 1.0 / (1.0 + np.exp(-np.clip(u, -Z_CLIP, Z_CLIP)))
    loss = (np.logaddexp(0.0, u) - y * u).sum()
    return np.concatenate([z.T @ (pr - y), ((z * (pr * (1.0 - pr))[:, None]).T @ z).ravel(), [loss]])


@dataclass
class Design:
    """Standardised inputs of several fits (columns ``_z1``.. and one per target), persisted while they run."""

    frame: DataFrame
    features: list[str]
    mu: list[float]
    sd: list[float]
    span: list[float]                  # max − min, 1 for a constant feature
    facts: dict                        # further aggregates of the training rows

    @property
    def inputs(self) -> list[str]:
        return [f"_z{j + 1}" for j in range(len(self.features))]

    def raw(self, beta) -> tuple[list[float], float]:
        """Coefficients and intercept on the raw inputs."""
        coef = [float(beta[j + 1] / self.sd[j]) for j in range(len(self.features))]
        return coef, float(beta[0] - sum(c * m for c, m in zip(coef, self.mu)))


def build_design(train: DataFrame, features: Sequence[str], targets: dict[str, Column] | Callable[[dict], dict[str, Column]],
                 facts: dict[str, Column] | None = None) -> Design:
    """One aggregate of the training rows (means, deviations, ranges, ``facts``), then the persisted design.

    ``targets`` are columns, or a function of the facts that gives them.
    """
    feats = list(features)
    x = [F.col(c).cast("double") for c in feats]
    st = train.agg(F.count(F.lit(1)).alias("_n"), *[v.alias(k) for k, v in (facts or {}).items()],
                   *[f(c).alias(f"_{k}{j}") for j, c in enumerate(x)
                     for k, f in (("m", F.avg), ("s", F.stddev_pop), ("a", F.min), ("b", F.max))]).first()
    mu = [st[f"_m{j}"] if st[f"_m{j}"] is not None else 0.0 for j in range(len(feats))]
    sd = [st[f"_s{j}"] if st[f"_s{j}"] not in (None, 0.0) else 1.0 for j in range(len(feats))]
    span = [((st[f"_b{j}"] or 0.0) - (st[f"_a{j}"] or 0.0)) or 1.0 for j in range(len(feats))]
    known = {k: st[k] for k in (facts or {})}
    if callable(targets):
        targets = targets(known)
    # re-read by every step: kept (a lost block is recomputed from its checkpointed source)
    frame = train.select(*[((c - F.lit(mu[j])) / F.lit(sd[j])).alias(f"_z{j + 1}") for j, c in enumerate(x)],
                         *[v.cast("double").alias(k) for k, v in targets.items()]).persist(StorageLevel.MEMORY_AND_DISK)
    return Design(frame, feats, mu, sd, span, known)


def logistic_fit_of(design: Design, name: str, column: str, share: float, scale: Sequence[float], C: float = LOGISTIC_C) -> NewtonFit:
    """The fit on inputs divided by ``scale``: on the shared standardised design only its penalty differs."""
    if share is None or not 0.0 < share < 1.0:
        raise ValueError("logistic regression needs both classes in the training rows")
    pen = np.array([0.0] + [(b / s) ** 2 / C for b, s in zip(scale, design.sd)])
    beta = np.zeros(len(pen))
    beta[0] = math.log(share / (1.0 - share))     # start at the intercept-only answer
    return NewtonFit(name, column, beta, pen, _logistic_sums)


def scaler_scales(design: Design) -> dict[str, list[float]]:
    """What each scaler divides the inputs by; a shift of the inputs only moves the intercept."""
    return {"Unscaled": [1.0] * len(design.features), "StandardScaler": design.sd, "MinMaxScaler": design.span}


def fit_logistic(train: DataFrame, features: Sequence[str], label: str, n_train: int | None = None,
                 C: float = LOGISTIC_C, max_iter: int = 100, tol: float = 1e-8) -> LogisticParams:
    """L2 logistic regression, objective Σ log-loss + ‖w‖²/(2C), intercept free.

    Newton's method (IRLS): every step is ONE pass over the training rows —
    per-partition gradient and Hessian sums, (p+1)(p+2) numbers per
    partition — and a (p+1)×(p+1) solve on the driver.  It reaches the exact optimum in a handful of passes
    (quadratic convergence: once a step is below ``tol`` the remaining error
    is of order tol², i.e. machine precision), where first-order solvers need
    dozens.  Steps are taken on internally standardised features for
    conditioning; the penalty is mapped so it still acts on the raw
    coefficients.
    """
    y = F.col(label).cast("double")
    design = build_design(train, features, {"_y": y}, {"_share": F.avg(y)})
    try:
        fit = logistic_fit_of(design, "logistic regression", "_y", design.facts["_share"], [1.0] * len(design.features), C)
        newton(design.frame, design.inputs, [fit], max_iter, tol)
    finally:
        design.frame.unpersist()
    return LogisticParams(design.features, *design.raw(fit.beta), iterations=fit.steps)


@dataclass
class SoftmaxParams:
    classes: list[str]                 # sorted labels; index = class id
    features: list[str]
    coef: list[list[float]]            # per class, raw-scale weights
    intercept: list[float]
    iterations: int | None = None

    def scores(self) -> list[Column]:
        out = []
        for k in range(len(self.classes)):
            s_ = F.lit(float(self.intercept[k]))
            for j, c in enumerate(self.features):
                # a missing input counts as 0, as in the other scores
                x = F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(0.0))
                s_ = s_ + F.lit(float(self.coef[k][j])) * x
            out.append(s_)
        return out

    def predict_label(self) -> Column:
        """Class with the highest score (first one on ties)."""
        sc = self.scores()
        best = F.lit(self.classes[-1])
        for k in range(len(self.classes) - 2, -1, -1):
            cond = F.lit(True)
            for m in range(len(self.classes)):
                if m != k:
                    cond = cond & (sc[k] >= sc[m]) if m > k else cond & (sc[k] > sc[m])
            best = F.when(cond, F.lit(self.classes[k])).otherwise(best)
        return best


def _softmax_layout(classes: int, p: int) -> list[tuple[int, int]]:
    """(class, term) of each parameter; term 0 is the intercept, the last class's is pinned to 0."""
    return [(k, j) for k in range(classes) for j in range(p + 1) if not (k == classes - 1 and j == 0)]


def softmax_fit_of(design: Design, name: str, column: str, classes: Sequence[str], scale: Sequence[float],
                   C: float = LOGISTIC_C) -> NewtonFit:
    """The multinomial fit on inputs divided by ``scale``; ``column`` holds the class number."""
    K, p = len(classes), len(design.features)
    if K < 2:
        raise ValueError("softmax regression needs at least two classes in the training rows")
    layout = _softmax_layout(K, p)
    place = np.array([k * (p + 1) + j for k, j in layout])         # inside the K×(p+1) grid
    pen = np.array([0.0 if j == 0 else (scale[j - 1] / design.sd[j - 1]) ** 2 / C for _, j in layout])

    def sums(z, y, theta):
        grid = np.zeros(K * (p + 1))
        grid[place] = theta
        score = z @ grid.reshape(K, p + 1).T
        peak = score.max(axis=1, keepdims=True)
        e = np.exp(score - peak)
        pr = e / e.sum(axis=1, keepdims=True)
        y = y.astype(int)
        off = pr.copy()
        off[np.arange(len(y)), y] -= 1.0
        hessian = np.zeros((K, p + 1, K, p + 1))
        for k in range(K):
            for l in range(k, K):
                block = (z * (pr[:, k] * ((k == l) - pr[:, l]))[:, None]).T @ z
                hessian[k, :, l], hessian[l, :, k] = block, block.T
        loss = (peak[:, 0] + np.log(e.sum(axis=1)) - score[np.arange(len(y)), y]).sum()
        flat = hessian.reshape(K * (p + 1), K * (p + 1))[np.ix_(place, place)]
        return np.concatenate([(off.T @ z).ravel()[place], flat.ravel(), [loss]])

    return NewtonFit(name, column, np.zeros(len(layout)), pen, sums)


def softmax_params(design: Design, fit: NewtonFit, classes: Sequence[str]) -> SoftmaxParams:
    """Raw-scale weights and intercepts of a finished fit."""
    K, p = len(classes), len(design.features)
    grid = np.zeros((K, p + 1))
    for value, (k, j) in zip(fit.beta, _softmax_layout(K, p)):
        grid[k, j] = value
    raw = [design.raw(row) for row in grid]
    return SoftmaxParams(list(classes), design.features, [c for c, _ in raw], [i for _, i in raw], fit.steps)


def class_number(label: Column, classes: Sequence[str]) -> Column:
    """Place of a label among ``classes``."""
    return F.element_at(F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))]), label)


def fit_softmax(train: DataFrame, features: Sequence[str], label: str, n_train: int | None = None,
                C: float = LOGISTIC_C, max_iter: int = 100, tol: float = 1e-8, max_classes: int | None = None) -> SoftmaxParams:
    """M9: multinomial logistic regression, Σ −log p(y) + Σ_k ‖w_k‖²/(2C), by Newton steps.

    Every class has its own weights (all penalised) and intercept; the last
    intercept is pinned to 0, which removes the shift degeneracy of the
    intercepts without changing any prediction.  Each step is one pass of
    per-partition gradient and Hessian sums over the training rows.
    """
    known = train.select(F.col(label).cast("string")).where(F.col(label).isNotNull()).distinct()
    # a class is a row of parameters, so the classes fit where the model fits
    classes = sorted(r[0] for r in (known if max_classes is None else known.limit(max_classes + 1)).collect())
    if max_classes is not None and len(classes) > max_classes:
        raise ValueError(f"more than {max_classes} classes")
    if len(classes) < 2:
        raise ValueError("softmax regression needs at least two classes in the training rows")
    design = build_design(train.where(F.col(label).isNotNull()), features, {"_yi": class_number(F.col(label).cast("string"), classes)})
    try:
        fit = softmax_fit_of(design, "softmax regression", "_yi", classes, [1.0] * len(design.features), C)
        newton(design.frame, design.inputs, [fit], max_iter, tol)
    finally:
        design.frame.unpersist()
    return softmax_params(design, fit, classes)


# ---------------------------------------------------------------- standardisation helpers
def fit_standardiser(train: DataFrame, features: Sequence[str], ddof: int = 0,
                     eps: float = 0.0, zero_to_one: bool = True) -> tuple[list[float], list[float]]:
    """(μ, σ) of each feature on train: σ population (ddof 0) or sample (ddof 1), + eps."""
    aggs = []
    for i, c in enumerate(features):
        x = nan_to_null(F.col(c).cast("double"))
        aggs += [F.avg(x).alias(f"_m{i}"), (F.stddev_pop(x) if ddof == 0 else F.stddev_samp(x)).alias(f"_s{i}")]
    r = train.agg(*aggs).first()
    mu = [r[f"_m{i}"] for i in range(len(features))]
    sd = [r[f"_s{i}"] for i in range(len(features))]
    sd = [(1.0 if (zero_to_one and s == 0) else s) + eps if s is not None else None for s in sd]
    return mu, sd


def standardise(df: DataFrame, features: Sequence[str], mu, sig, digits: int | None = None) -> DataFrame:
    """M1/M2 transform: (x − μ)/σ with fitted literals."""
    out = {}
    for j, c in enumerate(features):
        v = (F.col(c).cast("double") - F.lit(mu[j])) / F.lit(sig[j])
        out[c] = rnd(v, digits) if digits is not None else v
    return df.withColumns(out)


# ---------------------------------------------------------------- tiers
# The three outcome tiers of the reference's salary split.
TIER_LABELS = ("Not Placed", "Standard Package", "Premium Package")


def positive_median(train: DataFrame, col: str) -> float | None:
    """P5: median of the strictly positive values of ``col`` (after coercion) on train."""
    from tabprism.operators.quantiles import quantiles
    v = to_double(col)
    r = quantiles(train.select(F.when(v > 0, v).alias("_v")), ["_v"], {"m": 0.5}).first()
    return r["m"]


def tier_expr(col: str, median: float | None, labels=TIER_LABELS) -> Column:
    """Missing / 0 / not a number → labels[0]; below the median → labels[1]; else labels[2]."""
    v = to_double(col)
    m = F.lit(median).cast("double")
    return (F.when(v.isNull() | (v == 0), F.lit(labels[0]))
            .when(v < m, F.lit(labels[1])).otherwise(F.lit(labels[2])))


# ---------------------------------------------------------------- grids / lines
def linspace_expr(idx: Column, lo: float, hi: float, num: int) -> Column:
    """Element ``idx`` of numpy.linspace(lo, hi, num) (the last one is exactly ``hi``)."""
    if num == 1:
        return F.lit(float(lo))
    step = (hi - lo) / (num - 1)
    return F.when(idx == num - 1, F.lit(float(hi))).otherwise(idx.cast("double") * F.lit(step) + F.lit(float(lo)))


# ---------------------------------------------------------------- M14 scaler comparison
def fit_scaler_variants(train: DataFrame, features: Sequence[str], label: str) -> dict[str, LogisticParams]:
    """The same classifier on raw, standardised (population σ, constant → 1) and min-max inputs, all in raw-input form.

    The three designs are affine images of one another, so one standardised
    design serves all and the fits advance together, one pass per step.
    """
    y = F.col(label).cast("double")
    design = build_design(train, features, {"_y": y}, {"_share": F.avg(y)})
    try:
        fits = {k: logistic_fit_of(design, k, "_y", design.facts["_share"], b) for k, b in scaler_scales(design).items()}
        newton(design.frame, design.inputs, list(fits.values()))
    finally:
        design.frame.unpersist()
    return {k: LogisticParams(design.features, *design.raw(f.beta), iterations=f.steps) for k, f in fits.items()}


def scaler_accuracy(test: DataFrame, variants: dict[str, LogisticParams], label: str) -> DataFrame:
    """Accuracy % of each variant on ``test``, one pass."""
    row = test.agg(*[F.avg(((p.z() > 0).cast("int") == F.col(label)).cast("double")).alias(k) for k, p in variants.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("scaler"), rnd(F.col(k) * 100, 2).alias("accuracy")) for k in variants])))


def scaler_comparison(prep: Prepared, features: Sequence[str], label: str) -> DataFrame:
    """Validation accuracy % of the same classifier on raw, standardised
    (population σ, constant → 1) and min-max inputs, each fitted on train only."""
    return scaler_accuracy(prep.test, fit_scaler_variants(prep.train, features, label), label)
