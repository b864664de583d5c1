"""Glicko-2 update on numpy arrays (Glickman, "Example of the Glicko-2 system"). Used inside tasks."""
from __future__ import annotations

import math

import numpy as np

from touchline.functions.scalars import GLICKO_SCALE

RATING, RD, VOLATILITY, TAU, EPS = 1500.0, 350.0, 0.06, 0.5, 1e-6


def spread(phi):
    return 1.0 / np.sqrt(1.0 + 3.0 * np.square(phi) / np.pi ** 2)


def expected(mu, mu_other, phi_other):
    return 1.0 / (1.0 + np.exp(-spread(phi_other) * (mu - mu_other)))


def solve_volatility(sigma, phi, v, delta, tau: float = TAU):
    """Root of the volatility equation for all rows at once, by bracketed false position."""
    sigma, phi, v, delta = (np.asarray(x, dtype=float) for x in (sigma, phi, v, delta))
    base = 2.0 * np.log(sigma)
    known = np.square(phi) + v
    surprise = np.square(delta)

    def gap(x):
        e = np.exp(x)
        return e * (surprise - known - e) / (2.0 * np.square(known + e)) - (x - base) / tau ** 2

    left = base.copy()
    right = np.where(surprise > known, np.log(np.maximum(surprise - known, 1e-300)), base - tau)
    low = (surprise <= known) & (gap(right) < 0)
    steps = 1
    while low.any() and steps < 100:
        steps += 1
        right = np.where(low, base - steps * tau, right)
        low &= gap(right) < 0
    f_left, f_right = gap(left), gap(right)
    active = np.abs(right - left) > EPS
    while active.any():
        with np.errstate(divide="ignore", invalid="ignore"):
            mid = np.where(active, left + (left - right) * f_left / (f_right - f_left), right)
        f_mid = gap(mid)
        crossed = f_mid * f_right <= 0
        left = np.where(active & crossed, right, left)
        f_left = np.where(active, np.where(crossed, f_right, f_left / 2.0), f_left)
        right, f_right = np.where(active, mid, right), np.where(active, f_mid, f_right)
        active &= np.abs(right - left) > EPS
    return np.exp(left / 2.0)


def update(rating, rd, volatility, v_inverse, gain, tau: float = TAU):
    """New (rating, rd, volatility) from the period's sums; v_inverse = 0 (no contest) only widens rd."""
    rating, rd, volatility, v_inverse, gain = (np.asarray(x, dtype=float) for x in (rating, rd, volatility, v_inverse, gain))
    mu, phi = (rating - RATING) / GLICKO_SCALE, rd / GLICKO_SCALE
    played = v_inverse > 0
    v = 1.0 / np.where(played, v_inverse, 1.0)
    sigma = np.where(played, solve_volatility(volatility, phi, v, v * gain, tau), volatility)
    wide = np.sqrt(np.square(phi) + np.square(sigma))
    phi_new = np.where(played, 1.0 / np.sqrt(1.0 / np.square(wide) + 1.0 / v), wide)
    mu_new = np.where(played, mu + np.square(phi_new) * gain, mu)
    return mu_new * GLICKO_SCALE + RATING, phi_new * GLICKO_SCALE, sigma


def _volatility_one(sigma: float, phi2: float, v: float, delta2: float, tau: float) -> float:
    """The same root for one player, by bisection kept inside a bracket and sped up by secants."""
    base = 2.0 * math.log(sigma)
    known = phi2 + v

    def gap(x: float) -> float:
        e = math.exp(x)
        return e * (delta2 - known - e) / (2.0 * (known + e) ** 2) - (x - base) / (tau * tau)

    # gap falls through zero: positive at `low`, negative at `high`.
    low, high = base, base
    if gap(base) > 0:
        high = max(base, math.log(delta2 - known)) if delta2 > known else base + tau
        while gap(high) > 0:
            high += tau
    else:
        low = base - tau
        while gap(low) < 0:
            low -= tau
    g_low, g_high = gap(low), gap(high)
    while high - low > 1e-9:
        x = low + (high - low) * g_low / (g_low - g_high) if g_low != g_high else low
        if not low + 1e-10 < x < high - 1e-10:
            x = 0.5 * (low + high)
        g = gap(x)
        wide = high - low
        if g > 0:
            low, g_low = x, g
        else:
            high, g_high = x, g
        if high - low > 0.5 * wide:
            x = 0.5 * (low + high)
            g = gap(x)
            low, g_low, high, g_high = (x, g, high, g_high) if g > 0 else (low, g_low, x, g)
    return math.exp(0.25 * (low + high))


def rate_pair(a: tuple, b: tuple, score: float, tau: float = TAU) -> tuple[tuple, tuple]:
    """Both players' new (rating, rd, volatility) after one contest; score is a's."""
    out = []
    for me, other, s in ((a, b, score), (b, a, 1.0 - score)):
        mu, phi = (me[0] - RATING) / GLICKO_SCALE, me[1] / GLICKO_SCALE
        phi_o = other[1] / GLICKO_SCALE
        g = 1.0 / math.sqrt(1.0 + 3.0 * phi_o * phi_o / math.pi ** 2)
        e = 1.0 / (1.0 + math.exp(-g * (mu - (other[0] - RATING) / GLICKO_SCALE)))
        v = 1.0 / (g * g * e * (1.0 - e))
        gain = g * (s - e)
        sigma = _volatility_one(me[2], phi * phi, v, (v * gain) ** 2, tau)
        phi2 = 1.0 / (1.0 / (phi * phi + sigma * sigma) + 1.0 / v)
        out.append(((mu + phi2 * gain) * GLICKO_SCALE + RATING, math.sqrt(phi2) * GLICKO_SCALE, sigma))
    return out[0], out[1]
