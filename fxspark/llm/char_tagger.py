"""A character tagger: bidirectional LSTM emissions, a linear-chain CRF over tags, in numpy with its own gradients."""

from __future__ import annotations

import numpy as np

HIDDEN = 24
#: Printable ASCII characters have a class each; then digits, letters and anything else outside ASCII; 0 pads.
CLASSES = 99


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where((code >= 32) & (code < 127), code - 31, np.where(code < 32, 1, 98)).astype(np.int16)
    for i in np.flatnonzero(code >= 127).tolist():
        out[i] = 96 if text[i].isdigit() else 97 if text[i].isalpha() else 98
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Tags 0 (outside), then begin and inside of each kind. Inside may only follow its own begin or inside."""

    def __init__(self, kinds: int, hidden: int = HIDDEN, seed: int = 5):
        r, self.h, self.k = np.random.default_rng(seed), hidden, 1 + 2 * kinds
        w = lambda *shape: (r.standard_normal(shape) * 0.15).astype(np.float32)
        self.p = {"xf": w(CLASSES, 4 * hidden), "hf": w(hidden, 4 * hidden), "xb": w(CLASSES, 4 * hidden), "hb": w(hidden, 4 * hidden),
                  "o": w(2 * hidden, self.k), "ob": w(self.k), "a": w(self.k, self.k), "s": w(self.k)}
        self.ban = np.zeros((self.k, self.k), np.float32)
        for inside in range(2, self.k, 2):
            self.ban[[j for j in range(self.k) if j not in (inside - 1, inside)], inside] = -1e4
        self.first_ban = np.where((np.arange(self.k) > 0) & (np.arange(self.k) % 2 == 0), -1e4, 0).astype(np.float32)

    # ---- emissions

    def _run(self, x, m, wx, wh):
        n, h = x.shape[1], self.h
        state, cell, saved = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), []
        out = np.zeros((len(x), n, h), np.float32)
        for t in range(len(x)):
            z = wx[x[t]] + state @ wh
            gates, g = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            before, mask = cell, m[t][:, None]
            cell = (f * cell + i * g) * mask
            tc = np.tanh(cell)
            saved.append((i, f, o, g, before, tc, state))
            state = o * tc * mask
            out[t] = state
        return out, saved

    def _back(self, d, x, m, saved, wh):
        h = self.h
        dwx, dwh = np.zeros((CLASSES, 4 * h), np.float32), np.zeros_like(wh)
        ds, dc = np.zeros_like(d[0]), np.zeros_like(d[0])
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g, before, tc, state = saved[t]
            mask = m[t][:, None]
            ds = (ds + d[t]) * mask
            dc = (dc + ds * o * (1 - tc * tc)) * mask
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), ds * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            np.add.at(dwx, x[t], dz)
            dwh += state.T @ dz
            ds, dc = dz @ wh.T, dc * f
        return dwx, dwh

    def emissions(self, x: np.ndarray, m: np.ndarray) -> tuple:
        """``x`` and ``m`` are length by windows; emissions length by windows by tags."""
        p = self.p
        f, sf = self._run(x, m, p["xf"], p["hf"])
        b, sb = self._run(x[::-1], m[::-1], p["xb"], p["hb"])
        both = np.concatenate([f, b[::-1]], 2)
        return both @ p["o"] + p["ob"], (both, sf, sb)

    # ---- the chain

    def _chain(self) -> tuple[np.ndarray, np.ndarray]:
        return self.p["a"] + self.ban, self.p["s"] + self.first_ban

    def marginals(self, e: np.ndarray, m: np.ndarray) -> tuple:
        """Log partition, tag posteriors and summed pair posteriors of a padded batch."""
        a, s = self._chain()
        length, n, k = e.shape
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = s + e[0]
        for t in range(1, length):
            step = _lse(alpha[t - 1][:, :, None] + a[None], 1) + e[t]
            alpha[t] = np.where(m[t][:, None] > 0, step, alpha[t - 1])
        z = _lse(alpha[-1], 1)
        pairs = np.zeros((k, k), np.float64)
        for t in range(length - 1, 0, -1):
            onward = a[None] + (e[t] + beta[t])[:, None, :]
            on = m[t][:, None] > 0
            beta[t - 1] = np.where(on, _lse(onward, 2), beta[t])
            joint = np.exp(np.minimum(alpha[t - 1][:, :, None] + onward - z[:, None, None], 0)) * m[t][:, None, None]
            pairs += joint.sum(0)
        return z, np.exp(np.minimum(alpha + beta - z[None, :, None], 0)) * m[:, :, None], pairs

    def best(self, e: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Most likely tags (Viterbi), length by windows; 0 behind the end."""
        a, s = self._chain()
        length, n, _ = e.shape
        score, back = s + e[0], np.zeros(e.shape, np.int8)
        for t in range(1, length):
            step = score[:, :, None] + a[None]
            back[t] = step.argmax(1)
            score = np.where(m[t][:, None] > 0, step.max(1) + e[t], score)
        out, tag = np.zeros((length, n), np.int8), score.argmax(1)
        for t in range(length - 1, -1, -1):
            on = m[t] > 0
            out[t] = np.where(on, tag, 0)
            if t:
                tag = np.where(on, back[t][np.arange(n), tag], tag)
        return out

    # ---- training

    def loss(self, x: np.ndarray, m: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of tags ``y`` and its gradients."""
        p, (length, n) = self.p, x.shape
        e, (both, sf, sb) = self.emissions(x, m)
        a, s = self._chain()
        z, post, pairs = self.marginals(e, m)
        cols = np.arange(n)
        gold = (s[y[0]] + e[0, cols, y[0]]).astype(np.float64)
        de = post.copy()
        de[0, cols, y[0]] -= m[0]
        for t in range(1, length):
            gold += (a[y[t - 1], y[t]] + e[t, cols, y[t]]) * m[t]
            de[t, cols, y[t]] -= m[t]
            np.add.at(pairs, (y[t - 1], y[t]), -m[t])
        de = (de / n).astype(np.float32)
        dboth = de @ p["o"].T
        gf = self._back(dboth[:, :, : self.h], x, m, sf, p["hf"])
        gb = self._back(dboth[::-1, :, self.h :], x[::-1], m[::-1], sb, p["hb"])
        grads = {"xf": gf[0], "hf": gf[1], "xb": gb[0], "hb": gb[1], "o": np.tensordot(both, de, ((0, 1), (0, 1))), "ob": de.sum((0, 1)),
                 "a": (pairs / n).astype(np.float32), "s": de[0].sum(0)}
        return float((z - gold).mean()), grads

    def fit(self, x: np.ndarray, m: np.ndarray, y: np.ndarray, steps: int = 240, batch: int = 64, rate: float = 0.02, seed: int = 7) -> float:
        """Adam over random batches; windows are the columns."""
        r = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            pick = r.integers(0, x.shape[1], min(batch, x.shape[1]))
            loss, grads = self.loss(x[:, pick], m[:, pick], y[:, pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return loss
