"""Modified Kneser-Ney in dense tables of a small alphabet: the yardstick of the joined model."""

from dataclasses import dataclass

import numpy as np

from auditspark.llm.rules import ORDER

#: Characters of the alphabet, and their bits.
CLASSES, BITS = 32, 5


@dataclass
class Model:
    """Interpolated modified Kneser-Ney probabilities in sorted arrays, one set for each order: the
    packed n-gram, log10 probability, and the log10 weight of backing off from it as a context."""

    keys: list[np.ndarray]
    logp: list[np.ndarray]
    back: list[np.ndarray]

    def score(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of the last class of each packed n-gram after the others."""
        out, rest = np.zeros(len(key)), np.arange(len(key))
        for n in range(ORDER, 0, -1):
            part = key[rest] & ((1 << (BITS * n)) - 1)
            at = np.minimum(np.searchsorted(self.keys[n - 1], part), len(self.keys[n - 1]) - 1)
            hit = self.keys[n - 1][at] == part
            out[rest[hit]] += self.logp[n - 1][at[hit]]
            rest, part = rest[~hit], part[~hit]
            if n > 1 and len(rest):
                context = part >> BITS
                at = np.minimum(np.searchsorted(self.keys[n - 2], context), len(self.keys[n - 2]) - 1)
                hit = self.keys[n - 2][at] == context
                out[rest[hit]] += self.back[n - 2][at[hit]]
        return out


def discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts of counts 1, 2 and 3 or more from the counts of counts; fixed ones where these fail."""
    n1, n2, n3, n4 = ((counts == k).sum() for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, 0.0, [0.0, 0.99, 1.99, 2.99])


def kneser_ney(keys: np.ndarray, counts: np.ndarray) -> Model:
    """The model of an alphabet of CLASSES characters, in dense tables, from packed n-grams of the highest
    order and their counts. rules.train() gives the same for any alphabet, in joins."""
    full = np.zeros(CLASSES**ORDER, np.int64)
    full[keys] = counts
    tables = [full.reshape(-1, CLASSES)]
    for n in range(ORDER - 1, 0, -1):  # below the highest order, how many classes precede the n-gram
        tables.insert(0, (tables[0].reshape(CLASSES, -1) > 0).sum(0).reshape(-1, CLASSES))
    prob = np.full((1, CLASSES), 1 / CLASSES)
    model = Model([], [], [])
    for n, c in enumerate(tables, 1):
        d = discounts(c)
        total = c.sum(1, keepdims=True)
        cut = d[np.minimum(c, 3)]
        weight = np.where(total > 0, cut.sum(1, keepdims=True) / np.maximum(total, 1), 1.0)
        lower = np.tile(prob, (CLASSES if n > 1 else 1, 1)) if n > 1 else prob
        prob = np.maximum(c - cut, 0) / np.maximum(total, 1) + weight * lower.reshape(len(c), CLASSES)
        if n > 1:
            model.back[-1] = np.log10(np.maximum(weight.reshape(-1)[model.keys[-1]], 1e-12))
        used = c.reshape(-1) > 0
        if n < ORDER:  # contexts that begin texts end no longer n-gram, yet have weights to back off with
            used |= tables[n].sum(1) > 0
        seen = np.arange(CLASSES) if n == 1 else np.flatnonzero(used)
        model.keys.append(seen.astype(np.int32))
        model.logp.append(np.log10(np.maximum(prob.reshape(-1)[seen], 1e-12)))
        model.back.append(np.zeros(len(seen)))
        prob = prob.reshape(-1, CLASSES)
    return model
