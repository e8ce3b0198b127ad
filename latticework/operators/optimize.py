"""Minimisers of Python functions. An objective may run a Spark aggregation; the loops count its calls."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from ..functions import validation as V


@dataclass(frozen=True)
class Minimum:
    x: object
    fun: float
    converged: bool
    iterations: int
    fun_evals: int


_GOLD = (math.sqrt(5) - 1) / 2


class GoldenSection:
    @staticmethod
    def minimize(a: float, b: float, fun: Callable[[float], float], tol: float = 1e-5, maxiter: int = 500) -> Minimum:
        """In [a, b]; one call an iteration, as one inner point is always kept."""
        V.positive_number(tol)
        c, d = b - _GOLD * (b - a), a + _GOLD * (b - a)
        fc, fd, calls, k = fun(c), fun(d), 2, 0
        while b - a > tol and k < maxiter:
            if fc < fd:
                b, d, fd = d, c, fc
                c = b - _GOLD * (b - a)
                fc = fun(c)
            else:
                a, c, fc = c, d, fd
                d = a + _GOLD * (b - a)
                fd = fun(d)
            calls, k = calls + 1, k + 1
        x = (a + b) / 2
        return Minimum(x, float(fun(x)), b - a <= tol, k, calls + 1)


class Brent:
    """Parabolas through the three best points, golden sections where these don't help."""

    @staticmethod
    def minimize(a: float, b: float, fun: Callable[[float], float], tol: float = 1e-5, maxiter: int = 500) -> Minimum:
        V.positive_number(tol)
        x = w = v = a + (1 - _GOLD) * (b - a)
        fx = fw = fv = fun(x)
        step = last = 0.0
        calls = 1
        for k in range(maxiter):
            mid, near = (a + b) / 2, tol * abs(x) + 1e-10
            if abs(x - mid) <= 2 * near - (b - a) / 2:
                return Minimum(x, float(fx), True, k, calls)
            golden = True
            if abs(last) > near:
                r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
                p, q = (x - v) * q - (x - w) * r, 2 * (q - r)
                p, q = (-p, q) if q > 0 else (p, -q)
                if q and abs(p) < abs(q * last / 2) and q * (a - x) < p < q * (b - x):
                    last, step, golden = step, p / q, False
                    u = x + step
                    if u - a < 2 * near or b - u < 2 * near:
                        step = math.copysign(near, mid - x)
            if golden:
                last = (b if x < mid else a) - x
                step = (1 - _GOLD) * last
            u = x + (step if abs(step) >= near else math.copysign(near, step))
            fu = fun(u)
            calls += 1
            if fu <= fx:
                a, b = (x, b) if u >= x else (a, x)
                v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
            else:
                a, b = (u, b) if u < x else (a, u)
                if fu <= fw or w == x:
                    v, fv, w, fw = w, fw, u, fu
                elif fu <= fv or v in (x, w):
                    v, fv = u, fu
        return Minimum(x, float(fx), False, maxiter, calls)


class BFGS:
    @staticmethod
    def minimize(x0: np.ndarray, fun: Callable[[np.ndarray], float], gradient: Callable[[np.ndarray], np.ndarray] | None = None, gtol: float = 1e-5, maxiter: int = 500) -> Minimum:
        """Quasi-Newton with backtracking; without ``gradient``, central differences."""
        V.positive_number(gtol)
        calls = 0

        def f(z: np.ndarray) -> float:
            nonlocal calls
            calls += 1
            return float(fun(z))

        def g(z: np.ndarray) -> np.ndarray:
            if gradient is not None:
                return np.asarray(gradient(z), float)
            h = np.cbrt(np.finfo(float).eps) * np.maximum(1, np.abs(z))
            return np.array([(f(z + h[k] * e) - f(z - h[k] * e)) / (2 * h[k]) for k, e in enumerate(np.eye(len(z)))])

        x = np.asarray(x0, float).copy()
        n = len(x)
        inv, value, slope, k = np.eye(n), f(x), g(x), 0
        while np.abs(slope).max() > gtol and k < maxiter:
            way = -inv @ slope
            if slope @ way >= 0:
                inv, way = np.eye(n), -slope
            t = 1.0
            while (new := f(x + t * way)) > value + 1e-4 * t * (slope @ way) and t > 1e-12:
                t /= 2
            s = t * way
            g2 = g(x + s)
            y = g2 - slope
            if (sy := float(s @ y)) > 1e-12:
                rho, one = 1 / sy, np.eye(n)
                inv = (one - rho * np.outer(s, y)) @ inv @ (one - rho * np.outer(y, s)) + rho * np.outer(s, s)
            if t <= 1e-12:
                break
            x, value, slope, k = x + s, new, g2, k + 1
        return Minimum(x, value, bool(np.abs(slope).max() <= gtol), k, calls)


class NelderMead:
    @staticmethod
    def minimize(x0: np.ndarray, fun: Callable[[np.ndarray], float], tol: float = 1e-5, maxiter: int = 500, initial_simplex_step: float = 0.05) -> Minimum:
        V.positive_number(tol)
        x0 = np.asarray(x0, float)
        points = [x0] + [x0 + (initial_simplex_step * (abs(x0[k]) or 1.0)) * e for k, e in enumerate(np.eye(len(x0)))]
        simplex = sorted(((float(fun(p)), tuple(p)) for p in points))
        calls, k = len(points), 0

        def at(p: np.ndarray) -> tuple[float, tuple[float, ...]]:
            nonlocal calls
            calls += 1
            return float(fun(p)), tuple(p)

        while k < maxiter:
            best, worst = simplex[0], simplex[-1]
            spread = max(np.abs(np.array(p) - np.array(best[1])).max() for _, p in simplex)
            if worst[0] - best[0] <= tol and spread <= tol:
                return Minimum(np.array(best[1]), best[0], True, k, calls)
            k += 1
            c, w = np.mean([p for _, p in simplex[:-1]], axis=0), np.array(worst[1])
            r = at(2 * c - w)
            if r[0] < best[0]:
                new = min(r, at(3 * c - 2 * w))
            elif r[0] < simplex[-2][0]:
                new = r
            else:
                new = at(1.5 * c - 0.5 * w) if r[0] < worst[0] else at(0.5 * c + 0.5 * w)
                if new[0] >= min(r[0], worst[0]):
                    b = np.array(best[1])
                    simplex = sorted([best] + [at(b + 0.5 * (np.array(p) - b)) for _, p in simplex[1:]])
                    continue
            simplex = sorted([*simplex[:-1], new])
        return Minimum(np.array(simplex[0][1]), simplex[0][0], False, k, calls)
