"""Masks of plots against whole-array computations in NumPy."""

from __future__ import annotations

import numpy as np

from tessera.operators import pixels as X


def brute(level: np.ndarray) -> dict[str, np.ndarray]:
    h, w = level.shape
    r = X.BLOCK // 2
    weights = np.array(X._weights(X.BLOCK))
    wide = np.pad(level.astype(float), r, mode="edge")
    mean = sum(weights[i] * weights[j] * wide[i : i + h, j : j + w] for i in range(X.BLOCK) for j in range(X.BLOCK))
    dark = level - np.round(mean) <= -X.DARKER

    def opened(a: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros_like(a)
        for y in range(a.shape[0]):
            for x in range(a.shape[1] - n + 1):
                if a[y, x : x + n].all():
                    out[y, x : x + n] = True
        return out

    clean = dark & ~(opened(dark, max(w // 3, 1)) | opened(dark.T, max(h // 3, 1)).T)

    def fold(a: np.ndarray, any_: bool) -> np.ndarray:
        p = np.pad(a, 1, constant_values=not any_)
        three = np.stack([p[1:-1, 1:-1], p[:-2, 1:-1], p[1:-1, :-2]])
        return three.any(0) if any_ else three.all(0)

    healed = clean
    for any_ in (True, False, False, True):
        healed = fold(healed, any_)
    seen, best = np.zeros_like(healed), np.zeros_like(healed)
    for y, x in zip(*np.nonzero(healed), strict=True):
        if not seen[y, x]:
            part, stack = np.zeros_like(healed), [(y, x)]
            seen[y, x] = True
            while stack:
                b, a = stack.pop()
                part[b, a] = True
                for c in range(max(b - 1, 0), min(b + 2, h)):
                    for d in range(max(a - 1, 0), min(a + 2, w)):
                        if healed[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            stack.append((c, d))
            if part.sum() > best.sum():
                best = part
    return {"dark": dark, "clean": clean, "healed": healed, "mask": best}


def plot(rng: np.random.Generator, h: int, w: int) -> np.ndarray:
    level = rng.integers(235, 256, (h, w))
    level[:, :: max(w // 4, 1)] = 60
    level[:: max(h // 3, 1), :] = 80
    for x in range(w):
        y = int(h / 2 + h / 3 * np.sin(x / 6))
        level[max(y - 1, 0) : y + 2, x] = 20
    for _ in range(6):
        y, x = rng.integers(0, h - 3), rng.integers(0, w - 3)
        level[y : y + 3, x : x + 3] = 10
    return level


def test_masks(spark):
    rng = np.random.default_rng(1)
    pictures = {"a": plot(rng, 40, 60), "b": plot(rng, 33, 31), "flat": np.full((5, 4), 200), "one": np.array([[3]]), "noise": rng.integers(0, 256, (30, 30))}
    rows = [(k, int(x), int(y), int(v)) for k, p in pictures.items() for (y, x), v in np.ndenumerate(p)]
    found = X.plot_mask(spark.createDataFrame(rows, "image string, x int, y int, level int")).collect()
    got = {k: {c: np.zeros(p.shape, bool) for c in ("dark", "clean", "healed", "mask")} for k, p in pictures.items()}
    for r in found:
        for c in ("dark", "clean", "healed", "mask"):
            got[r["image"]][c][r["y"], r["x"]] = r[c]
    assert len(found) == len(rows) and got["a"]["mask"].sum() > 40
    for k, p in pictures.items():
        for c, want in brute(p).items():
            assert (got[k][c] == want).all(), (k, c)
