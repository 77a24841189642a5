"""Dense work on one raster or one pair of photos, for Arrow-fed functions. NumPy only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def resized(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """The raster at another size, each pixel the mean of the area it covers."""

    def weights(old: int, new: int) -> np.ndarray:
        edges = np.linspace(0, old, new + 1)
        cells = np.arange(old)
        w = np.clip(np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells), 0, None)
        return w / w.sum(axis=1, keepdims=True)

    out = np.tensordot(weights(img.shape[0], height), img.astype(float), axes=(1, 0))
    return np.moveaxis(np.tensordot(weights(img.shape[1], width), out, axes=(1, 1)), 0, 1)


def sampled(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values between the four pixels around (x, y); places outside read the border."""
    h, w = img.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.minimum(x.astype(int), max(w - 2, 0)), np.minimum(y.astype(int), max(h - 2, 0))
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = x - x0, y - y0
    if img.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    return (img[y0, x0] * (1 - fx) + img[y0, x1] * fx) * (1 - fy) + (img[y1, x0] * (1 - fx) + img[y1, x1] * fx) * fy


def _cubic(t: np.ndarray) -> np.ndarray:
    """Weights of the pixels at -1, 0, 1, 2 for a place t after pixel 0; the cubic convolution with slope -0.75."""
    a, d = -0.75, np.abs(np.stack([t + 1, t, 1 - t, 2 - t], axis=-1))
    return np.where(d <= 1, ((a + 2) * d - (a + 3)) * d * d + 1, ((a * d - 5 * a) * d + 8 * a) * d - 4 * a)


def _lanczos(t: np.ndarray) -> np.ndarray:
    """Weights of the eight pixels around a place t after pixel 0, adding up to 1."""
    w = np.sinc(t[..., None] - np.arange(-3, 5)) * np.sinc((t[..., None] - np.arange(-3, 5)) / 4)
    return w / w.sum(axis=-1, keepdims=True)


#: Weights by name of the interpolation, and the first pixel that they are for.
TAPS = {"cubic": (_cubic, -1), "lanczos": (_lanczos, -3)}


def interpolated(img: np.ndarray, x: np.ndarray, y: np.ndarray, kind: str = "linear") -> np.ndarray:
    """Values at (x, y) by nearest, linear, cubic or lanczos interpolation; places outside read the border."""
    h, w = img.shape[:2]
    if kind == "nearest":
        return img[np.clip(np.rint(y), 0, h - 1).astype(int), np.clip(np.rint(x), 0, w - 1).astype(int)].astype(float)
    if kind not in TAPS:
        return sampled(img, x, y)
    weights, first = TAPS[kind]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    wx, wy = weights(x - x0), weights(y - y0)
    out = 0.0
    for j in range(wy.shape[-1]):
        row = np.clip(y0 + first + j, 0, h - 1)
        line = sum(img[row, np.clip(x0 + first + i, 0, w - 1)] * wx[..., i, None] for i in range(wx.shape[-1]))
        out = out + line * wy[..., j, None]
    return np.clip(out, 0, 255)


def blurred(img: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur with repeated borders."""
    if sigma <= 0:
        return img.astype(float)
    r = max(1, int(3 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = img.astype(float)
    for axis in (0, 1):
        pad = [(0, 0)] * out.ndim
        pad[axis] = (r, r)
        wide = np.pad(out, pad, mode="edge")
        n = out.shape[axis]
        out = sum(k[i] * np.take(wide, np.arange(i, i + n), axis=axis) for i in range(2 * r + 1))
    return out


def depth(mask: np.ndarray, wrap: bool = False) -> np.ndarray:
    """How many steps of 1 or sqrt 2 each pixel of the mask is from the nearest one outside it.

    What is outside the raster counts as outside the mask, except across a wrapped border.
    """
    h, w = mask.shape
    base = np.concatenate([mask] * 3, axis=1) if wrap else mask
    d = np.where(np.pad(base, 1), np.inf, 0.0)
    for flip in (False, True):
        v = d[::-1, ::-1] if flip else d
        for y in range(1, v.shape[0]):
            up = v[y - 1]
            row = np.minimum(v[y], up + 1)
            row[1:] = np.minimum(row[1:], up[:-1] + 2**0.5)
            row[:-1] = np.minimum(row[:-1], up[1:] + 2**0.5)
            run = np.arange(len(row))
            v[y] = np.minimum.accumulate(row - run) + run
    d = d[1:-1, 1:-1]
    return d[:, w : 2 * w] if wrap else d


def grown(mask: np.ndarray, steps: int = 1) -> np.ndarray:
    """The mask and its eight neighbours, `steps` times."""
    for _ in range(steps):
        p = np.pad(mask, 1)
        mask = np.logical_or.reduce([p[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(3) for j in range(3)])
    return mask


def labelled(mask: np.ndarray) -> np.ndarray:
    """8-connected parts of the mask, numbered from 1 in reading order; 0 outside."""
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        p = np.pad(label, 1, constant_values=0)
        stack = np.stack([p[i : i + h, j : j + w] for i in range(3) for j in range(3)])
        low = np.where(stack > 0, stack, h * w + 1).min(axis=0)
        new = np.where(mask, low, 0)
        flat = new.ravel()
        jump = np.where(flat > 0, flat[np.maximum(flat - 1, 0)], 0).reshape(h, w)
        new = np.where(mask, np.minimum(new, jump), 0)
        if (new == label).all():
            return np.where(mask, np.searchsorted(np.unique(label[mask]), label) + 1, 0)
        label = new


def seam(a: np.ndarray, b: np.ndarray, both: np.ndarray, upright: bool = True) -> np.ndarray:
    """Which of two overlapping rasters owns each pixel of `both`: True for the first.

    A path through the overlap from end to end, across which colours and colour steps differ
    least, by dynamic programming row by row.
    """
    if not upright:
        return seam(a.swapaxes(0, 1), b.swapaxes(0, 1), both.T).T
    diff = np.abs(a.astype(float) - b).sum(axis=-1)
    for axis in (0, 1):
        diff += np.abs(np.diff(a.astype(float), axis=axis, prepend=np.take(a, [0], axis)) - np.diff(b.astype(float), axis=axis, prepend=np.take(b, [0], axis))).sum(axis=-1)
    cost = np.where(both, diff, diff.max() + 1e3)
    total, back = cost.copy(), np.zeros(cost.shape, int)
    for y in range(1, len(cost)):
        up = np.pad(total[y - 1], 1, constant_values=np.inf)
        near = np.stack([up[:-2], up[1:-1], up[2:]])
        back[y] = near.argmin(axis=0) - 1
        total[y] += near.min(axis=0)
    x, first = int(total[-1].argmin()), np.zeros(both.shape, bool)
    for y in range(len(cost) - 1, -1, -1):
        first[y, : x + 1] = True
        x += back[y, x]
    return first & both


def multiband(images: list[np.ndarray], masks: list[np.ndarray], bands: int) -> np.ndarray:
    """Rasters of one size, with masks that don't overlap, blended in frequency bands.

    Each band is the difference of two blurs and is blended over a seam as wide as the blur;
    pixels that an image doesn't have are first filled from its edge.
    """
    out = np.zeros(images[0].shape, float)
    whole = np.logical_or.reduce(masks)
    level = [filled(i.astype(float), m) for i, m in zip(images, masks, strict=True)]
    for k in range(bands + 1):
        sigma = 2.0**k
        weights = [blurred(m.astype(float), sigma) for m in masks]
        total = np.maximum(sum(weights), 1e-6)[..., None]
        low = [blurred(i, sigma) for i in level] if k < bands else [np.zeros_like(i) for i in level]
        out += sum(w[..., None] * (i - j) for w, i, j in zip(weights, level, low, strict=True)) / total
        level = low
    return np.where(whole[..., None], np.clip(out, 0, 255), 0)


def filled(img: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The raster with pixels outside the mask averaged from the nearest inside, coarse to fine."""
    if mask.all() or not mask.any():
        return img
    levels, value, weight = [], np.where(mask[..., None], img, 0).astype(float), mask.astype(float)
    while min(weight.shape) > 1:
        levels.append((value, weight))
        h, w = (weight.shape[0] + 1) // 2, (weight.shape[1] + 1) // 2
        pad = ((0, h * 2 - weight.shape[0]), (0, w * 2 - weight.shape[1]))
        value = np.pad(value, (*pad, (0, 0))).reshape(h, 2, w, 2, -1).sum(axis=(1, 3))
        weight = np.pad(weight, pad).reshape(h, 2, w, 2).sum(axis=(1, 3))
    coarse = value / np.maximum(weight, 1e-9)[..., None]
    if not (weight > 0).all():
        coarse = np.where((weight > 0)[..., None], coarse, value.sum(axis=(0, 1)) / max(weight.sum(), 1e-9))
    for value, weight in reversed(levels):
        up = coarse.repeat(2, axis=0).repeat(2, axis=1)[: weight.shape[0], : weight.shape[1]]
        coarse = np.where((weight > 0)[..., None], value / np.maximum(weight, 1e-9)[..., None], up)
    return coarse


@dataclass(frozen=True)
class Patch:
    """A part of a canvas, from (x, y) on, that a photo covers."""

    x: int
    y: int
    img: np.ndarray
    mask: np.ndarray

    @property
    def box(self) -> tuple[slice, slice]:
        return np.s_[self.y : self.y + self.mask.shape[0], self.x : self.x + self.mask.shape[1]]


def smooth_gains(patches: list[Patch], shape: tuple[int, int], strength: float, wrap: bool = False, most: int = 128, limit: float = 1.9) -> list[np.ndarray]:
    """A gain for each patch, on a coarse copy of the whole canvas, that brings it near the mean of all where they overlap.

    Only what changes slowly is wanted, so the canvas is cut into at most `most` cells a side: sums per
    cell of a patch and of all patches give its ratio to the mean where others lie too, and a
    blur of a sixth of the canvas takes the ratio everywhere. A canvas that wraps is blurred around.
    """
    step = max(1, -(-max(shape) // most))
    size = (-(-shape[0] // step), -(-shape[1] // step))

    def cells(p: Patch) -> tuple[np.ndarray, np.ndarray]:
        ys, xs = np.nonzero(p.mask)
        at = (ys + p.y) // step * size[1] + (xs + p.x) // step
        n = np.bincount(at, minlength=size[0] * size[1])
        sums = [np.bincount(at, weights=p.img[ys, xs, c], minlength=len(n)) for c in range(3)]
        return n.reshape(size) / step**2, np.stack(sums, axis=-1).reshape(*size, 3) / step**2

    parts = [cells(p) for p in patches]
    weight, light = sum(n for n, _ in parts), sum(v for _, v in parts)
    mean, sigma = light / np.maximum(weight, 1e-6)[..., None], max(1.0, 0.16 * max(size))

    def soft(v: np.ndarray) -> np.ndarray:
        around = np.concatenate([v, v, v], axis=1) if wrap else v
        out = blurred(around, sigma)
        return out[:, v.shape[1] : 2 * v.shape[1]] if wrap else out

    fields = []
    for n, v in parts:
        shared = n * (weight > 1.2 * np.maximum(n, 1e-6)) * (n > 0.75)
        if shared.sum() * step**2 < 32:
            fields.append(np.ones((*size, 3), np.float32))
            continue
        ratio = np.clip(mean / np.maximum(v / np.maximum(n, 1e-6)[..., None], 1.0), 1 / limit, limit)
        smooth = soft(ratio * shared[..., None]) / np.maximum(soft(shared), 1e-6)[..., None]
        fields.append(np.clip(1 + strength * (smooth - 1), 1 / limit, limit).astype(np.float32))
    return fields


def owners(patches: list[Patch], shape: tuple[int, int], seams: bool, wrap: bool = False) -> list[np.ndarray]:
    """The part of each patch's box that its photo owns: where it is deepest, borders moved to where photos differ least.

    Depths and pairs are looked at in the patches' boxes; of the canvas only two rasters are kept.
    """
    deepest, owner = np.zeros(shape), np.full(shape, -1, dtype=np.int32)
    for k, p in enumerate(patches):
        d = depth(p.mask, wrap and p.mask.shape[1] == shape[1])
        more = d > deepest[p.box]
        deepest[p.box][more], owner[p.box][more] = d[more], k
    parts = [owner[p.box] == k for k, p in enumerate(patches)]
    if seams:
        middle = [np.argwhere(p.mask).mean(axis=0) + (p.y, p.x) for p in patches]
        for i, a in enumerate(patches):
            for j in range(i + 1, len(patches)):
                b = patches[j]
                x0, y0 = max(a.x, b.x), max(a.y, b.y)
                x1, y1 = (min(a.x + a.mask.shape[1], b.x + b.mask.shape[1]), min(a.y + a.mask.shape[0], b.y + b.mask.shape[0]))
                if x0 >= x1 or y0 >= y1:
                    continue
                box = [np.s_[y0 - p.y : y1 - p.y, x0 - p.x : x1 - p.x] for p in (a, b)]
                both = a.mask[box[0]] & b.mask[box[1]] & (parts[i][box[0]] | parts[j][box[1]])
                if both.sum() < 64:
                    continue
                ys, xs = np.nonzero(both)
                inner = np.s_[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
                upright = abs(middle[i][1] - middle[j][1]) >= abs(middle[i][0] - middle[j][0])
                first = seam(a.img[box[0]][inner], b.img[box[1]][inner], both[inner], upright)
                swap = (middle[i][1] > middle[j][1]) if upright else (middle[i][0] > middle[j][0])
                mine = both[inner] & (~first if swap else first)
                for k, box_, own in ((i, box[0], mine), (j, box[1], both[inner] & ~mine)):
                    part = parts[k][box_][inner]
                    part[:] = np.where(both[inner], own, part)
    seen = np.zeros(shape, bool)
    for p, part in zip(patches, parts, strict=True):
        part &= ~seen[p.box]
        seen[p.box] |= part
    return parts


def ncc_best(patch: np.ndarray, area: np.ndarray) -> tuple[int, int, float]:
    """(x, y, score) of where in `area` the patch correlates most, by whole pixels."""
    p = patch.astype(float)
    windows = np.lib.stride_tricks.sliding_window_view(area.astype(float), p.shape)
    p = p - p.mean()
    centred = windows - windows.mean(axis=(2, 3), keepdims=True)
    norm = np.sqrt((centred**2).sum(axis=(2, 3)) * (p**2).sum())
    score = np.where(norm > 1e-9, (centred * p).sum(axis=(2, 3)) / np.maximum(norm, 1e-9), 0)
    y, x = np.unravel_index(score.argmax(), score.shape)
    return int(x), int(y), float(score[y, x])


def homography(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """The projective map from points a to points b, least squares on normalised coordinates."""

    def normal(p: np.ndarray) -> np.ndarray:
        s = 2**0.5 / max(np.sqrt(((p - p.mean(axis=0)) ** 2).sum(axis=1)).mean(), 1e-9)
        return np.array([[s, 0, -s * p[:, 0].mean()], [0, s, -s * p[:, 1].mean()], [0, 0, 1]])

    ta, tb = normal(a), normal(b)
    one = np.ones((len(a), 1))
    (x, y, _), (u, v, _) = (ta @ np.hstack([a, one]).T), (tb @ np.hstack([b, one]).T)
    zero, ones = np.zeros(len(a)), np.ones(len(a))
    rows = np.concatenate([np.stack([x, y, ones, zero, zero, zero, -u * x, -u * y, -u], 1), np.stack([zero, zero, zero, x, y, ones, -v * x, -v * y, -v], 1)])
    try:
        h = np.linalg.inv(tb) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ ta
    except np.linalg.LinAlgError:
        return None
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def mapped(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.hstack([p, np.ones((len(p), 1))]) @ h.T
    return q[:, :2] / np.where(np.abs(q[:, 2:]) < 1e-12, 1e-12, q[:, 2:])


def ransac(a: np.ndarray, b: np.ndarray, threshold: float = 3.0, rounds: int = 8000, confidence: float = 0.9995) -> tuple[np.ndarray | None, np.ndarray]:
    """(map, inliers): the homography that most pairs fit within `threshold` pixels; a fixed seed."""
    best, most = np.zeros(len(a), bool), None
    if len(a) < 4:
        return None, best
    rng, need, done = np.random.default_rng(len(a)), rounds, 0
    while done < need:
        done += 1
        pick = rng.choice(len(a), 4, replace=False)
        h = homography(a[pick], b[pick])
        if h is None:
            continue
        inside = ((mapped(h, a) - b) ** 2).sum(axis=1) <= threshold**2
        if inside.sum() > best.sum():
            best, most = inside, h
            share = min(best.mean(), 0.999)
            need = min(rounds, int(np.ceil(np.log(1 - confidence) / np.log(1 - share**4 + 1e-12))))
    if best.sum() >= 4:
        most = homography(a[best], b[best])
    return most, best


def detected(gray: np.ndarray, most: int = 1500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, responses, descriptors) of corners, with 128 values of gradient histograms each.

    Harris corners that are the largest of their 5 x 5 surroundings; the descriptor has 4 x 4
    cells of 8 gradient directions around the point, turned to its main direction.
    """
    g = blurred(gray.astype(float), 1.0)
    dy, dx = np.gradient(g)
    xx, yy, xy = blurred(dx * dx, 2.0), blurred(dy * dy, 2.0), blurred(dx * dy, 2.0)
    r = xx * yy - xy * xy - 0.04 * (xx + yy) ** 2
    top = np.lib.stride_tricks.sliding_window_view(np.pad(r, 2, mode="edge"), (5, 5)).max(axis=(2, 3))
    edge = 14
    ok = (r >= top) & (r > 1e-4 * r.max())
    ok[:edge], ok[-edge:], ok[:, :edge], ok[:, -edge:] = False, False, False, False
    ys, xs = np.nonzero(ok)
    order = np.argsort(-r[ys, xs], kind="stable")[:most]
    ys, xs = ys[order], xs[order]
    size, angle = np.hypot(dx, dy), np.arctan2(dy, dx)
    off = (np.arange(16) - 7.5) * 1.2
    gx, gy = np.meshgrid(off, off)
    fall = np.exp(-(gx**2 + gy**2) / (2 * 8.0**2))
    out = np.zeros((len(xs), 128))
    for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
        near_size, near_angle = size[y - 9 : y + 10, x - 9 : x + 10], angle[y - 9 : y + 10, x - 9 : x + 10]
        hist = np.bincount(((near_angle.ravel() / (2 * np.pi) * 36).astype(int)) % 36, near_size.ravel(), 36)
        turn = (hist.argmax() + 0.5) / 36 * 2 * np.pi
        c, s = np.cos(turn), np.sin(turn)
        px, py = x + c * gx - s * gy, y + s * gx + c * gy
        m = sampled(size, px, py) * fall
        a = (angle[np.clip(np.rint(py).astype(int), 0, g.shape[0] - 1), np.clip(np.rint(px).astype(int), 0, g.shape[1] - 1)] - turn) % (2 * np.pi)
        cell = (np.arange(16) // 4)[:, None] * 4 + np.arange(16) // 4
        out[i] = np.bincount((cell * 8 + (a / (2 * np.pi) * 8).astype(int) % 8).ravel(), m.ravel(), 128)
    return np.stack([xs, ys], 1).astype(float), r[ys, xs], out
