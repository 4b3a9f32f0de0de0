"""A convolutional network over bytes, trained and applied in numpy.

Each byte has a learned vector. Filters of several widths slide over a window of bytes; the largest
value of each filter (at least 0) is its feature, and a softmax over linear scores of the features
gives the class. Windows have a fixed length, shorter texts are padded with byte 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 16     # of each width
EMBED = 8
LEAST_STEPS = 120  # gradient steps that even a small sample gets


#: Widest filter; narrower ones have zeros in their last rows.
REACH = max(WIDTHS)
_USED = np.concatenate([np.repeat((np.arange(REACH) < w)[:, None], FILTERS, axis=1) for w in WIDTHS], axis=1)
#: Upper-case A-Z is read as lower case.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


@dataclass
class ByteCNN:
    labels: list[str]
    embed: np.ndarray      # 256 x EMBED
    filters: np.ndarray    # REACH x EMBED x (FILTERS * len(WIDTHS))
    offset: np.ndarray
    dense: np.ndarray
    bias: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """A byte's vector times a filter row is a lookup: 256 rows for each offset."""
        return [np.ascontiguousarray((self.embed @ f).astype(np.float32)) for f in self.filters]

    def scorer(self):
        """``f(windows)``: log-probability of each class. Two offsets share one lookup."""
        one = self.tables()
        pairs = [np.ascontiguousarray((one[j + 1][:, None] + one[j][None]).reshape(1 << 16, -1))
                 for j in range(0, REACH - 1, 2)]  # row: second byte * 256 + first byte
        rest = one[-1] if REACH % 2 else None
        width = self.filters.shape[2]
        step = 16
        total = np.empty((step * WINDOW, width), np.float32)
        extra = np.empty_like(total)

        def run(windows: np.ndarray) -> np.ndarray:
            out = np.empty((len(windows), len(self.labels)), np.float32)
            for lo in range(0, len(windows), step):
                n = len(windows[lo:lo + step])
                x = np.zeros((n, WINDOW + REACH), np.intp)
                x[:, :WINDOW] = FOLD[windows[lo:lo + step]]
                code = x[:, :-1] + (x[:, 1:] << 8)
                t, e = total[:n * WINDOW], extra[:n * WINDOW]
                np.take(pairs[0], code[:, :WINDOW].ravel(), axis=0, out=t, mode="clip")
                for j in range(1, len(pairs)):
                    np.take(pairs[j], code[:, 2 * j:2 * j + WINDOW].ravel(), axis=0, out=e, mode="clip")
                    t += e
                if rest is not None:
                    np.take(rest, x[:, REACH - 1:REACH - 1 + WINDOW].ravel(), axis=0, out=e, mode="clip")
                    t += e
                pooled = np.maximum(t.reshape(n, WINDOW, width).max(axis=1) + self.offset, 0)
                z = pooled @ self.dense + self.bias
                z -= z.max(axis=1, keepdims=True)
                out[lo:lo + n] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
            return out
        return run


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text index, bytes used of each window) covering every byte of every text. A last
    window of a longer text is moved back to be full; its weight is the bytes not yet covered."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    count = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), count)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    raw = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
    begin = np.cumsum(sizes) - sizes
    start = np.minimum(index * WINDOW, np.maximum(sizes[owner] - WINDOW, 0))
    out = raw[(begin[owner] + start)[:, None] + np.arange(WINDOW)]
    out[np.arange(WINDOW) >= (sizes[owner] - start)[:, None]] = 0
    return out, owner, np.minimum(sizes[owner] - index * WINDOW, WINDOW)


def train(windows: np.ndarray, target: np.ndarray, labels: list[str], epochs: int = 4,
          batch: int = 64, rate: float = 3e-3, seed: int = 7) -> ByteCNN:
    """Fit by Adam on cross-entropy; the same input gives the same network. A share of each
    window's tail is blanked so that short texts are known too."""
    rng = np.random.default_rng(seed)
    width = FILTERS * len(WIDTHS)
    used = np.repeat(_USED[:, None], EMBED, axis=1)
    scale = (_USED.sum(axis=0) * EMBED) ** -0.5
    net = ByteCNN(labels, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
                  (rng.normal(0, 1, (REACH, EMBED, width)) * used * scale).astype(np.float32),
                  np.zeros(width, np.float32), np.zeros((width, len(labels)), np.float32),
                  np.zeros(len(labels), np.float32))
    params = [net.embed, net.filters, net.offset, net.dense, net.bias]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(max(epochs, -(-LEAST_STEPS * batch // max(len(windows), batch)))):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), batch):
            pick = order[lo:lo + batch]
            n = len(pick)
            cut = np.where(rng.random(n) < 0.3, rng.integers(8, WINDOW, n), WINDOW)
            x = np.zeros((n, WINDOW + REACH), np.uint8)
            x[:, :WINDOW] = FOLD[windows[pick]] * (np.arange(WINDOW) < cut[:, None])
            tables = net.tables()
            total = tables[0][x[:, :WINDOW]]
            for j in range(1, REACH):
                total += tables[j][x[:, j:j + WINDOW]]
            at = total.argmax(axis=1)
            pooled = np.maximum(np.take_along_axis(total, at[:, None], axis=1)[:, 0] + net.offset, 0)
            z = pooled @ net.dense + net.bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), target[pick]] -= 1
            p /= n
            back = (p @ net.dense.T) * (pooled > 0)
            hit = x[np.arange(n)[:, None, None], at[:, :, None] + np.arange(REACH)]
            grad_filters = np.einsum("nf,nfje->jef", back, net.embed[hit]) * used
            grad_embed = np.zeros_like(net.embed)
            np.add.at(grad_embed, hit.reshape(-1), np.einsum(
                "nf,jef->nfje", back, net.filters).reshape(-1, EMBED))
            grads = [grad_embed, grad_filters, back.sum(axis=0), pooled.T @ p, p.sum(axis=0)]
            step += 1
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= (rate * (m / (1 - 0.9 ** step))
                      / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net
