"""A sparse variational Gaussian-process classifier with a logistic likelihood, in NumPy.

q(u) = N(m, S = L L') at inducing points; the expected log-likelihood is a Monte-Carlo mean over
reparametrised draws. Inducing points are kept as inputs and encoded at each step, as the rows are.
All gradients are analytic: the objective's are taken in the kernel's tables, and kernel and encoder
carry them on to their parameters and points. Kernel and encoder are exchangeable; a plain kernel
function is differentiated by one difference a parameter and a coordinate. Kernel parameters are
logarithms with Gamma priors. A collective variable and a bias on it may be added to the objective.
The mean offset enters both objective and prediction.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from numpy.linalg import cholesky, inv, slogdet

Params = dict[str, np.ndarray]


class SquaredExponential:
    """exp(log_amp - sum of gamma_k (a_k - b_k)^2), with a gamma for each coordinate (ard) or one for all."""

    def __init__(self, ard: bool = True):
        self.ard = ard

    def init(self, d: int) -> Params:
        return {"log_gamma": np.full(d if self.ard else 1, -np.log(d)), "log_amp": np.zeros(1)}

    def value(self, p: Params, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = np.exp(p["log_gamma"] / 2)
        a, b = a * s, b * s
        d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
        return np.exp(p["log_amp"][0] - np.maximum(d, 0))

    def diag(self, p: Params, a: np.ndarray) -> np.ndarray:
        return np.full(len(a), np.exp(p["log_amp"][0]))

    def pull(self, p: Params, a: np.ndarray, b: np.ndarray, k: np.ndarray, g: np.ndarray) -> tuple[Params, np.ndarray, np.ndarray]:
        """From the gradient in the table k = value(p, a, b) to those in p, a and b."""
        w, gamma = g * k, np.exp(p["log_gamma"])
        rows, cols, across = w.sum(1), w.sum(0), w.T @ a
        each = -gamma * (rows @ (a * a) + cols @ (b * b) - 2 * (across * b).sum(0))
        return {"log_gamma": each if self.ard else np.array([each.sum()]), "log_amp": np.array([w.sum()])}, -2 * gamma * (rows[:, None] * a - w @ b), -2 * gamma * (cols[:, None] * b - across)

    def pull_diag(self, p: Params, a: np.ndarray, g: np.ndarray) -> tuple[Params, np.ndarray]:
        return {"log_amp": np.array([np.exp(p["log_amp"][0]) * g.sum()])}, np.zeros_like(a)


class KernelFunction:
    """A kernel from a function f(a, b, **parameters) of two sets of points, by central differences."""

    def __init__(self, f: Callable[..., np.ndarray], start: Callable[[int], Params], step: float = 1e-5):
        self.f, self.start, self.step = f, start, step

    def init(self, d: int) -> Params:
        return {k: np.array(v, float) for k, v in self.start(d).items()}

    def value(self, p: Params, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.f(a, b, **p)

    def diag(self, p: Params, a: np.ndarray) -> np.ndarray:
        return np.array([self.f(a[i : i + 1], a[i : i + 1], **p)[0, 0] for i in range(len(a))])

    def slopes(self, p: Params, table: Callable[[Params], np.ndarray], g: np.ndarray) -> Params:
        out = {k: np.zeros_like(v) for k, v in p.items()}
        for k, v in p.items():
            for i in np.ndindex(v.shape):
                up, down = v.copy(), v.copy()
                up[i] += self.step
                down[i] -= self.step
                out[k][i] = (g * (table(p | {k: up}) - table(p | {k: down}))).sum() / (2 * self.step)
        return out

    def pull(self, p: Params, a: np.ndarray, b: np.ndarray, k: np.ndarray, g: np.ndarray) -> tuple[Params, np.ndarray, np.ndarray]:
        da, db = np.zeros_like(a), np.zeros_like(b)
        for i in range(a.shape[1]):  # an entry of the table depends on one point of each side, so a coordinate of all points moves at once
            h = np.zeros(a.shape[1])
            h[i] = self.step
            da[:, i] = (g * (self.f(a + h, b, **p) - self.f(a - h, b, **p))).sum(1) / (2 * self.step)
            db[:, i] = (g * (self.f(a, b + h, **p) - self.f(a, b - h, **p))).sum(0) / (2 * self.step)
        return self.slopes(p, lambda q: self.f(a, b, **q), g), da, db

    def pull_diag(self, p: Params, a: np.ndarray, g: np.ndarray) -> tuple[Params, np.ndarray]:
        out = np.zeros_like(a)
        for i in range(a.shape[1]):
            h = np.zeros(a.shape[1])
            h[i] = self.step
            out[:, i] = g * (self.diag(p, a + h) - self.diag(p, a - h)) / (2 * self.step)
        return self.slopes(p, lambda q: self.diag(q, a), g), out


class LinearEncoder:
    """x W, with W drawn from N(0, 2 / inputs)."""

    def __init__(self, dim: int):
        self.dim = dim

    def init(self, rng: np.random.Generator, d: int) -> Params:
        return {"w": rng.normal(0, np.sqrt(2 / d), (d, self.dim))}

    def value(self, p: Params, x: np.ndarray) -> np.ndarray:
        return x @ p["w"]

    def pull(self, p: Params, x: np.ndarray, g: np.ndarray) -> tuple[Params, np.ndarray]:
        """From the gradient in value(p, x) to those in p and x."""
        return {"w": x.T @ g}, g @ p["w"].T


class Identity:
    def init(self, rng: np.random.Generator, d: int) -> Params:
        return {}

    def value(self, p: Params, x: np.ndarray) -> np.ndarray:
        return x

    def pull(self, p: Params, x: np.ndarray, g: np.ndarray) -> tuple[Params, np.ndarray]:
        return {}, g


@dataclass
class Settings:
    inducing: int = 100
    lr: float = 1e-3
    jitter: float = 1e-4
    prior: tuple[float, float] = (2.0, 2.0)
    draws: int = 20
    batch: int = 128
    epochs: int = 300
    seed: int = 42
    #: "adam", or "sgld" with noise of this temperature.
    optimizer: str = "adam"
    temperature: float = 1e-3
    learn_kernel: bool = True
    #: One gamma a coordinate, or one for all; with a kernel of one's own it has no meaning.
    ard: bool = True
    #: An object like SquaredExponential or KernelFunction.
    kernel: object | None = None
    #: A linear encoder to so many dimensions, trained with the rest; 0 for none. Or an object like LinearEncoder.
    encoder_dim: int = 0
    encoder: object | None = None
    learn_encoder: bool = True
    #: Without it the inducing points stay the inputs that were drawn; an encoder moves them nevertheless.
    learn_inducing: bool = False
    learn_offset: bool = True
    #: collective(state, metrics) gives a number and its gradients by parameter name.
    collective: Callable | None = None
    #: bias(value, its own state) gives an energy, its slope in the value, and its next state, from None on.
    bias: Callable | None = None


@dataclass
class State:
    """raw: the inducing points, as inputs."""

    raw: np.ndarray
    m: np.ndarray
    low: np.ndarray
    params: Params
    offset: float = 0.0
    encoding: Params = field(default_factory=dict)
    settings: Settings = field(default_factory=Settings)
    bias_state: object = None

    @property
    def kernel(self):
        return self.settings.kernel or SquaredExponential(self.settings.ard)

    @property
    def encoder(self):
        return self.settings.encoder or (LinearEncoder(self.settings.encoder_dim) if self.settings.encoder_dim else Identity())

    def encode(self, x: np.ndarray) -> np.ndarray:
        return self.encoder.value(self.encoding, x)

    @property
    def z(self) -> np.ndarray:
        return self.encode(self.raw)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def moments(s: State, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, variance and projection A = Kxz Kzz^-1 at rows."""
    z, e = s.z, s.encode(x)
    kzz = s.kernel.value(s.params, z, z) + s.settings.jitter * np.eye(len(z))
    kxz = s.kernel.value(s.params, e, z)
    a = np.linalg.solve(kzz, kxz.T).T
    var = s.kernel.diag(s.params, e) - (a * kxz).sum(1) + ((a @ s.low) ** 2).sum(1)
    return a @ s.m + s.offset, np.maximum(var, 1e-10), a


def divergence(s: State) -> float:
    """KL(q || p)."""
    n, z = len(s.raw), s.z
    kzz = s.kernel.value(s.params, z, z) + s.settings.jitter * np.eye(n)
    ki = inv(kzz)
    return 0.5 * float(np.trace(ki @ s.low @ s.low.T) + s.m @ ki @ s.m - n + slogdet(kzz)[1] - 2 * np.log(np.abs(np.diag(s.low)) + 1e-300).sum())


def log_prior(s: State) -> float:
    shape, rate = s.settings.prior
    return float(sum(((shape - 1) * v - rate * np.exp(v)).sum() for v in s.params.values()))


def loss(s: State, x: np.ndarray, y: np.ndarray, n: int, noise: np.ndarray) -> float:
    """The negative bound for a batch of labels 0/1, plus the hyper-prior."""
    mean, var, _ = moments(s, x)
    ll = -np.logaddexp(0, -(2 * y - 1) * (mean + np.sqrt(var) * noise)).mean(0).sum()
    return -n / len(x) * ll + divergence(s) - log_prior(s)


def gradients(s: State, x: np.ndarray, y: np.ndarray, n: int, noise: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, float]]:
    """Of the loss, by name: m, low, offset, raw, kernel.<name>, encoder.<name>; and the loss's parts from the same pass."""
    kernel, encoder, up = s.kernel, s.encoder, n / len(x)
    e, z = s.encode(x), s.z
    plain = kernel.value(s.params, z, z)
    kzz = plain + s.settings.jitter * np.eye(len(z))
    ki, k, cov = inv(kzz), kernel.value(s.params, e, z), s.low @ s.low.T
    a = k @ ki
    mean = a @ s.m + s.offset
    sd = np.sqrt(np.maximum(kernel.diag(s.params, e) - (a * k).sum(1) + ((a @ s.low) ** 2).sum(1), 1e-10))
    f = mean + sd * noise
    slope = y - sigmoid(f)  # of the log-likelihood in f
    g_mean, g_var = slope.mean(0), (slope * noise).mean(0) / (2 * sd)
    g_k = -up * (g_mean[:, None] * (ki @ s.m)[None, :] - 2 * g_var[:, None] * (k @ (ki - ki @ cov @ ki)))
    kk = (k * g_var[:, None]).T @ k
    g_ki = -up * (np.outer(k.T @ g_mean, s.m) - kk + kk @ ki @ cov + cov @ ki @ kk) + 0.5 * (cov + np.outer(s.m, s.m))
    g_kzz = -ki @ g_ki @ ki + 0.5 * ki
    p1, de, dz = kernel.pull(s.params, e, z, k, g_k)
    p2, dz1, dz2 = kernel.pull(s.params, z, z, plain, g_kzz)
    p3, de1 = kernel.pull_diag(s.params, e, -up * g_var)
    dz = dz + dz1 + dz2
    shape, rate = s.settings.prior
    prior = {name: rate * np.exp(v) - (shape - 1) for name, v in s.params.items()}
    w1, _ = encoder.pull(s.encoding, x, de + de1)
    w2, raw = encoder.pull(s.encoding, s.raw, dz)
    out = {"m": -up * a.T @ g_mean + ki @ s.m, "low": np.tril(-up * 2 * (a.T * g_var) @ a @ s.low + ki @ s.low - np.diag(1 / np.diag(s.low))), "offset": np.array(-up * g_mean.sum()), "raw": raw}
    out |= {f"kernel.{name}": prior[name] + sum(p.get(name, 0) for p in (p1, p2, p3)) for name in s.params}
    out |= {f"encoder.{name}": w1[name] + w2[name] for name in s.encoding}
    ll = -np.logaddexp(0, -(2 * y - 1) * f).mean(0).sum()
    kl = 0.5 * float((ki * cov).sum() + s.m @ ki @ s.m - len(z) + slogdet(kzz)[1] - 2 * np.log(np.abs(np.diag(s.low)) + 1e-300).sum())
    potential = float(-up * ll + kl - log_prior(s))
    return out, {"loss": potential, "physical_potential": potential, "kl_divergence": kl, "participation_ratio": participation_ratio(s), "cv_val": 0.0, "bias_energy": 0.0}


def biased(s: State, g: dict[str, np.ndarray], metrics: dict[str, float]) -> None:
    """Adds the collective variable and the bias on it to gradients and metrics."""
    c = s.settings
    if c.collective is None:
        return
    metrics["cv_val"], slopes = c.collective(s, metrics)
    if c.bias is not None:
        energy, slope, s.bias_state = c.bias(metrics["cv_val"], s.bias_state)
        metrics["bias_energy"], metrics["loss"] = float(energy), metrics["loss"] + float(energy)
        for name, d in slopes.items():
            g[name] = g[name] + slope * d


def fit(x: np.ndarray, y: np.ndarray, settings: Settings | None = None, log: Callable[[int, State, dict[str, float]], None] | None = None) -> State:
    """y in 0/1. log(epoch from 0, state, means of the epoch's metrics) is called after each epoch. The remainder of a batch is left out of an epoch, unless all rows are fewer than a batch."""
    c = settings or Settings()
    rng = np.random.default_rng(c.seed)
    s = State(x[:0], np.zeros(0), np.zeros((0, 0)), {}, settings=c)
    s.encoding = s.encoder.init(rng, x.shape[1])
    s.raw = x[rng.choice(len(x), min(c.inducing, len(x)), replace=False)].copy()
    z = s.z
    s.params = s.kernel.init(z.shape[1])
    s.m, s.low = np.zeros(len(z)), cholesky(s.kernel.value(s.params, z, z) + c.jitter * np.eye(len(z)))
    fixed = {n for n, learn in (("kernel", c.learn_kernel), ("encoder", c.learn_encoder), ("raw", c.learn_inducing), ("offset", c.learn_offset)) if not learn}
    first, second, t = {}, {}, 0
    size = min(c.batch, len(x))
    for epoch in range(c.epochs):
        order, total = rng.permutation(len(x)), []
        for k in range(0, len(x) - size + 1, size):
            at = order[k : k + size]
            g, metrics = gradients(s, x[at], y[at], len(x), rng.standard_normal((c.draws, size)))
            biased(s, g, metrics)
            total.append(metrics)
            t += 1
            for name, d in g.items():
                part, _, leaf = name.partition(".")
                if part in fixed:
                    continue
                if c.optimizer == "adam":
                    first[name] = 0.9 * first.get(name, 0) + 0.1 * d
                    second[name] = 0.999 * second.get(name, 0) + 0.001 * d * d
                    move = -c.lr * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.999**t)) + 1e-8)
                else:
                    move = -c.lr * d + np.sqrt(2 * c.lr * c.temperature) * rng.standard_normal(np.shape(d))
                    move = np.tril(move) if name == "low" else move
                if leaf:
                    held = s.params if part == "kernel" else s.encoding
                    held[leaf] = held[leaf] + move
                else:
                    setattr(s, name, getattr(s, name) + (move if np.ndim(move) else float(move)))
        if log:
            log(epoch, s, {n: float(np.mean([m[n] for m in total])) for n in total[0]})
    return s


def predict(s: State, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, variance and probability of the label 1."""
    mean, var, _ = moments(s, x)
    return mean, var, sigmoid(mean / np.sqrt(1 + np.pi * var / 8))


def participation_ratio(s: State) -> float:
    """(sum of gammas)^2 / sum of their squares; NaN for a kernel without gammas."""
    if "log_gamma" not in s.params:
        return float("nan")
    g = np.exp(s.params["log_gamma"])
    return float(g.sum() ** 2 / (g * g).sum())


def participation(s: State, metrics: dict[str, float]) -> tuple[float, dict[str, np.ndarray]]:
    """A collective variable: the participation ratio of the kernel's gammas."""
    g = np.exp(s.params["log_gamma"])
    one, two = g.sum(), (g * g).sum()
    return float(one * one / two), {"kernel.log_gamma": g * (2 * one / two - 2 * g * (one / two) ** 2)}


def harmonic(centre: float, stiffness: float) -> Callable:
    """A bias that pulls the variable to a centre."""
    return lambda v, state: (0.5 * stiffness * (v - centre) ** 2, stiffness * (v - centre), state)


def hills(height: float, width: float, every: int = 100) -> Callable:
    """A bias that fills the places where the variable has been: a Gaussian hill is left every so many steps."""

    def bias(v: float, state: tuple | None) -> tuple[float, float, tuple]:
        step, centres = state or (0, ())
        d = v - np.array(centres)
        bumps = height * np.exp(-d * d / (2 * width * width))
        return float(bumps.sum()), float((-d / (width * width) * bumps).sum()), (step + 1, (*centres, v) if step % every == 0 else centres)

    return bias
