"""Sums over pairs of places i < j of one group: gap x = j - i, cosine distance y, without making the pairs.

For unit vectors u = m + d about any fixed m, y = |u - u'|^2 / 2 = q + q' - d.d' with q = |d|^2 / 2: a bilinear form e J e' of
e = (1, q, d), where J swaps the first two parts and negates the rest. So the sums of y, y^2 and xy follow from the sums S of
e, T of place * e, M of e e^T, and blocks of neighbouring places join by these. m is the block's first vector, hence vectors
that are nearly alike lose no digits. A zero vector is at distance 1 from everything and is counted only.

A block: n, p, pp, x (count, sums of place and its square, sum of gaps; whole numbers) of all its vectors, n1, p1, x1 of those
that are not zero, and either these themselves (`at`, `u`; while they are at most their length + 1) or m, S, T, M, the sum xy
and the largest q. Only that few vectors can all be at one distance above 0, which their own pairs show.
"""

from __future__ import annotations

import numpy as np

#: Distances below this are rounding (they were rounded to 12 digits).
NONE = 5e-13


def _places(at: np.ndarray) -> tuple[int, int, int, int]:
    n, p = len(at), int(at.sum())
    return n, p, int((at * at).sum()), int(((2 * np.arange(n) - n + 1) * at).sum())


def block(at: np.ndarray, rows: np.ndarray) -> dict:
    """Of vectors (rows) and their places, ascending."""
    with np.errstate(all="ignore"):
        norm = np.sqrt((rows * rows).sum(1))
        some = norm != 0
        u = rows[some] / norm[some][:, None]
    at = at.astype(np.int64)
    n, p, pp, x = _places(at)
    n1, p1, _, x1 = _places(at[some])
    b = {"n": n, "p": p, "pp": pp, "x": x, "n1": n1, "p1": p1, "x1": x1, "at": at[some], "u": u}
    return b if n1 <= rows.shape[1] + 1 else _moments(b)


def _swapped(e: np.ndarray) -> np.ndarray:
    """J e, along the last axis."""
    return np.concatenate([e[..., 1:2], e[..., 0:1], -e[..., 2:]], -1)


def _moments(b: dict) -> dict:
    """A block with sums in place of its vectors (one at least)."""
    if "u" not in b:
        return b
    with np.errstate(all="ignore"):
        m, at = b["u"][0], b["at"].astype(float)
        d = b["u"] - m
        q = (d * d).sum(1) / 2
        e = np.concatenate([np.ones((len(d), 1)), q[:, None], d], 1)
        te = (at - at[0])[:, None] * e
        before, tbefore = np.cumsum(e, 0) - e, np.cumsum(te, 0) - te
        xy = float((_swapped(e) * ((at - at[0])[:, None] * before - tbefore)).sum())
        s = e.sum(0)
        return {k: v for k, v in b.items() if k not in ("at", "u")} | {"m": m, "s": s, "t": te.sum(0) + at[0] * s, "mm": e.T @ e, "xy": xy, "q": float(q.max())}


def shifted(b: dict, by: int) -> dict:
    """A block whose places begin `by` later."""
    out = b | {"p": b["p"] + by * b["n"], "pp": b["pp"] + 2 * by * b["p"] + by * by * b["n"], "p1": b["p1"] + by * b["n1"]}
    return out | ({"at": b["at"] + by} if "u" in b else {"t": b["t"] + by * b["s"]})


def joined(a: dict, b: dict, by: int) -> dict:
    """Two blocks as one: b's places begin `by` later and lie behind those of a."""
    b = shifted(b, by)
    out = {k: a[k] + b[k] for k in ("n", "p", "pp", "n1", "p1")}
    out["x"] = a["x"] + b["x"] + a["n"] * b["p"] - a["p"] * b["n"]
    out["x1"] = a["x1"] + b["x1"] + a["n1"] * b["p1"] - a["p1"] * b["n1"]
    if "u" in a and "u" in b and out["n1"] <= a["u"].shape[1] + 1:
        return out | {"at": np.concatenate([a["at"], b["at"]]), "u": np.concatenate([a["u"], b["u"]])}
    if not a["n1"] or not b["n1"]:
        one = b if b["n1"] else a
        return one | out
    with np.errstate(all="ignore"):
        a, b = _moments(a), _moments(b)
        v = b["m"] - a["m"]
        to = np.eye(len(v) + 2)
        to[1, 0], to[1, 2:], to[2:, 0] = v @ v / 2, v, v
        s, t = to @ b["s"], to @ b["t"]
        xy = a["xy"] + b["xy"] + float(a["s"] @ _swapped(t) - a["t"] @ _swapped(s))
        return out | {"m": a["m"], "s": a["s"] + s, "t": a["t"] + t, "mm": a["mm"] + to @ b["mm"] @ to.T, "xy": xy, "q": float(np.max([a["q"], b["q"], v @ v / 2]))}


def _distances(b: dict) -> tuple[float, float, float, list[float]]:
    """Sums of y, y^2 and xy over the pairs without zero vectors; the least and largest y, or two values that differ."""
    with np.errstate(all="ignore"):
        if "u" in b:
            i, j = np.triu_indices(b["n1"], 1)
            y = np.round(1 - b["u"] @ b["u"].T, 12)[i, j] + 0.0
            return float(y.sum()), float((y * y).sum()), float(((b["at"][j] - b["at"][i]) * y).sum()), [float(y.min()), float(y.max())] if len(y) else []
        jm = np.concatenate([b["mm"][1:2], b["mm"][:1], -b["mm"][2:]])
        return float(b["s"] @ _swapped(b["s"]) / 2), float((jm * jm.T).sum() / 2), b["xy"], [0.0, 0.0 if b["q"] < NONE else b["q"]]


def correlation(parts: dict[int, dict]) -> float:
    """Of a group's blocks by length of vectors; 0 where gaps or distances do not vary."""
    n = x = xx = 0
    y, yy, xy, seen = 0.0, 0.0, 0.0, []
    for b in parts.values():
        d, dd, xd, ends = _distances(b)
        pairs = b["n"] * (b["n"] - 1) // 2
        rest = pairs - b["n1"] * (b["n1"] - 1) // 2  # with a zero vector: distance 1
        n, x, xx = n + pairs, x + b["x"], xx + b["n"] * b["pp"] - b["p"] ** 2
        y, yy, xy, seen = y + d + rest, yy + dd + rest, xy + xd + (b["x"] - b["x1"]), seen + ends + [1.0] * (rest > 0)
    wide = n * xx - x * x
    if wide <= 0 or not seen or np.ptp(seen) == 0:
        return 0.0
    far = n * yy - y * y
    return 0.0 if far <= 0 else float((n * xy - x * y) / np.sqrt(float(wide) * far))
