"""Objectives: per-row gradient and hessian, base score and inverse link, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Clamp of probabilities in base scores and log losses (fixed value).
EPS = 1e-15


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp(p: Column) -> Column:
    return F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))


def _logistic(y, r, a):
    p = sigmoid(r)
    return p - y, F.greatest(p * (1 - p), F.lit(1e-16))


def _poisson(y, r, a):
    return F.exp(r) - y, F.exp(r + a.get("max_delta_step", 0.7))


def _huber(y, r, a):
    d, k = r - y, a.get("alpha", 0.9)
    return F.greatest(F.lit(-k), F.least(F.lit(k), d)), F.lit(1.0)


def _quantile(y, r, a):
    k = a.get("alpha", 0.9)
    return F.when(r - y >= 0, F.lit(1 - k)).otherwise(F.lit(-k)), F.lit(1.0)


def _mape(y, r, a):
    w = 1 / F.greatest(F.lit(1.0), F.abs(y))
    return F.signum(r - y) * w, w


def _fair(y, r, a):
    d, c = r - y, a.get("fair_c", 1.0)
    return c * d / (F.abs(d) + c), c * c / ((F.abs(d) + c) * (F.abs(d) + c))


def _tweedie(y, r, a):
    rho = a.get("tweedie_variance_power", 1.5)
    one, two = F.exp((1 - rho) * r), F.exp((2 - rho) * r)
    return -y * one + two, -y * (1 - rho) * one + (2 - rho) * two


@dataclass(frozen=True)
class Objective:
    """How a row's label and raw score give derivatives, and how raw scores become responses."""

    name: str
    derivatives: Callable[[Column, Column, dict], tuple[Column, Column]]
    link: str = "identity"
    #: whether leaves and the start are percentiles of what is left, as the hessian says nothing
    renews: bool = False
    aliases: tuple[str, ...] = field(default=())

    def response(self, raw: Column) -> Column:
        return {"identity": lambda r: r, "exp": F.exp, "sigmoid": sigmoid}[self.link](raw)

    def alpha(self, args: dict | None = None) -> float:
        """The percentile of leaves that are renewed."""
        return (args or {}).get("alpha", 0.9) if self.name == "quantile" else 0.5

    def renewal_weight(self, label: Column, weight: Column | None) -> Column | None:
        """The weights of that percentile: for relative errors, those of the labels too."""
        if self.name != "mape":
            return weight
        own = 1 / F.greatest(F.lit(1.0), F.abs(label))
        return own if weight is None else weight * own

    def base_score(self, df: DataFrame, label: str, weight: str | None = None, args: dict | None = None) -> float:
        """The constant raw score the first tree starts from: a percentile, or the link of the weighted mean."""
        from ..operators.ranges import percentile

        y, w = F.col(label).cast("double"), F.col(weight).cast("double") if weight else None
        if self.renews:
            r = percentile(df, y, self.alpha(args), self.renewal_weight(y, w)).first()
            return float(r["value"]) if r is not None and r["value"] is not None else 0.0
        w = F.lit(1.0) if w is None else w
        r = df.agg(F.sum(y * w).alias("s"), F.sum(w).alias("w"), F.count(y).alias("n")).first()
        if not r["n"]:
            return 0.0
        if not r["w"] > 0:
            raise ValueError("weights need a positive sum")
        mean = r["s"] / r["w"]
        if self.link == "exp":
            if mean <= 0:
                raise ValueError(f"{self.name} needs a positive mean label")
            return math.log(mean)
        if self.link == "sigmoid":
            mean = min(1 - EPS, max(EPS, mean))
            return math.log(mean / (1 - mean))
        return mean


OBJECTIVES = {
    o.name: o
    for o in (
        Objective("l2", lambda y, r, a: (r - y, F.lit(1.0)), aliases=("regression", "mse", "mean_squared_error", "l2_root", "rmse")),
        Objective("binary", _logistic, "sigmoid", aliases=("logistic",)),
        Objective("cross_entropy", _logistic, "sigmoid", aliases=("xentropy",)),
        Objective("poisson", _poisson, "exp"),
        Objective("huber", _huber),
        Objective("quantile", _quantile, renews=True),
        Objective("l1", lambda y, r, a: (F.signum(r - y), F.lit(1.0)), renews=True, aliases=("mae", "mean_absolute_error")),
        Objective("gamma", lambda y, r, a: (1 - y * F.exp(-r), y * F.exp(-r)), "exp"),
        Objective("tweedie", _tweedie, "exp"),
        Objective("mape", _mape, renews=True, aliases=("mean_absolute_percentage_error",)),
        Objective("fair", _fair),
    )
}


def objective(name: str) -> Objective:
    for o in OBJECTIVES.values():
        if name == o.name or name in o.aliases:
            return o
    raise ValueError(f"unknown objective {name!r}; known: {', '.join(OBJECTIVES)}")


def softmax(raws: list[Column]) -> list[Column]:
    """Class probabilities of raw scores, shifted by the largest."""
    top = F.greatest(*raws) if len(raws) > 1 else raws[0]
    e = [F.exp(r - top) for r in raws]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


def multiclass_derivatives(label: Column, raws: list[Column]) -> list[tuple[Column, Column]]:
    k = len(raws)
    return [(p - F.when(label == c, 1.0).otherwise(0.0), k / (k - 1) * p * (1 - p)) for c, p in enumerate(softmax(raws))]


def multi_rmse_derivatives(labels: list[Column], raws: list[Column]) -> list[tuple[Column, Column]]:
    """Per target residual and one; a missing target counts nothing."""
    return [(F.coalesce(r - y, F.lit(0.0)), F.when(y.isNotNull(), 1.0).otherwise(0.0)) for y, r in zip(labels, raws)]


def _noise(kind: str):
    """Of standard noise: density, distribution, and the density's first and second derivative over itself."""
    if kind == "logistic":
        pdf = lambda x: sigmoid(x) * (1 - sigmoid(x))
        return pdf, sigmoid, lambda x: 1 - 2 * sigmoid(x), lambda x: 1 - 6 * pdf(x)
    if kind == "normal":
        return lambda x: F.exp(-x * x / 2) / math.sqrt(2 * math.pi), normal_cdf, lambda x: -x, lambda x: x * x - 1
    if kind == "extreme":
        w = lambda x: F.exp(F.least(x, F.lit(300.0)))
        return lambda x: w(x) * F.exp(-w(x)), lambda x: 1 - F.exp(-w(x)), lambda x: 1 - w(x), lambda x: w(x) * w(x) - 3 * w(x) + 1
    raise ValueError(f"unknown noise {kind!r}")


#: Coefficients of a rational approximation of the normal tail (fixed values, G. West 2005, after Hart 1968).
TAIL_ABOVE = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution to about 14 digits."""
    a = F.abs(x)

    def fold(coefficients):
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * a + c
        return out

    near = F.exp(-a * a / 2) * fold(TAIL_ABOVE) / fold(TAIL_BELOW)
    far = F.exp(-a * a / 2) / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def aft(df: DataFrame, lower: str, upper: str, raw: str, scale: float = 1.0, noise: str = "logistic") -> DataFrame:
    """Add grad and hess of accelerated failure time with logistic, normal or extreme-value noise; a bound of -1 is open.

    Gradients are clipped to +-15, hessians to 1e-16 and 15. Intermediate values are columns of their own, so that plans stay
    small.
    """
    pdf, cdf, first, second = _noise(noise)
    lo, up = F.col(lower).cast("double"), F.col(upper).cast("double")
    z = lambda t: (F.log(F.greatest(t, F.lit(1e-300))) - F.col(raw)) / scale
    zl, zu = F.col("__zl"), F.col("__zu")
    out = df.withColumns({"__zl": z(lo), "__zu": z(up)})
    out = out.withColumns({"__fl": F.when(lo > 0, cdf(zl)).otherwise(0.0), "__fu": F.when(up < 0, 1.0).otherwise(cdf(zu)), "__dl": F.when(lo > 0, pdf(zl)).otherwise(0.0), "__du": F.when(up < 0, 0.0).otherwise(pdf(zu))})
    fl, fu, dl, du = (F.col(c) for c in ("__fl", "__fu", "__dl", "__du"))
    out = out.withColumns({"__span": F.greatest(fu - fl, F.lit(1e-12)), "__bend": F.when(up < 0, 0.0).otherwise(du * first(zu)) - F.when(lo > 0, dl * first(zl)).otherwise(0.0)})
    span, exact = F.col("__span"), lo == up
    # d/draw of the negative log likelihood
    g = F.when(exact, first(zl) / scale).otherwise((du - dl) / (scale * span))
    h = F.when(exact, (first(zl) * first(zl) - second(zl)) / (scale * scale)).otherwise((((du - dl) * (du - dl)) / (span * span) - F.col("__bend") / span) / (scale * scale))
    out = out.withColumns({"grad": F.greatest(F.lit(-15.0), F.least(F.lit(15.0), g)), "hess": F.greatest(F.lit(1e-16), F.least(F.lit(15.0), h))})
    return out.drop("__zl", "__zu", "__fl", "__fu", "__dl", "__du", "__span", "__bend")


def aft_time(raw: Column) -> Column:
    """The predicted time of an accelerated failure time model."""
    return F.exp(raw)


def aft_distance(lower: Column, upper: Column, raw: Column) -> Column:
    """How far the predicted time lies from the nearer bound, 0 inside of both; without a lower bound, always from the upper."""
    t = F.exp(raw)
    outside = (lower < 0) | (t <= lower) | (upper >= 0) & (t >= upper)
    near = F.least(F.when(lower >= 0, F.abs(t - lower)), F.when(upper >= 0, F.abs(t - upper)))
    return F.when(outside, F.coalesce(near, F.lit(0.0))).otherwise(0.0)
