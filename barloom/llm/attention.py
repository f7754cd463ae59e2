"""A small causal self-attention model in numpy, mixed with probabilities from a tree of word beginnings.

Every id, and the end of every word, has probability ``gate * network + (1 - gate) * tree``.  The network reads the
subword ids before (one attention head over a window, relative positions) and has two heads: the classes of a word's first
id, and inside words those of the next id, the word's end among them.  Classes are the commonest ids alone and the others
in clusters that are followed alike, inside which counts decide.  A head tells a class in two steps, the branch and then
the class in it, so that an event needs two short rows of logits and not one over all classes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

#: Where the gate of the second head starts: inside words the tree knows most, and the network has to earn its share.
INSIDE = -3.0
#: Classes of a head that are branches of their own, beside the last one; the others share branches.
ALONE = 8
#: Starting logit of a place in a branch that no class has.
NOBODY = -30.0
#: Logits below this in size need no largest one taken off before they are raised.
EXACT = 40.0


@dataclass
class Vocabulary:
    """From counts of training words."""

    common: object  # id -> place among the common ids, the number of common ids for others
    size: int  # number of common ids
    inside: object  # log probability of place b, or of the word's end (last column), after place a
    rest: object  # id -> log probability among the ids that are not common (0 for common ones)
    begins: object  # id -> probability to begin a word
    classes: object  # id -> class
    n_classes: int
    within: object  # id -> log probability inside its class
    start: object  # log probability of each class
    goes: object  # id -> class inside words; the last class is the word's end
    n_goes: int
    goes_within: object  # id -> log probability inside that class
    goes_start: object  # log probability of each of those classes

    @classmethod
    def from_counts(cls, counts, first, pairs, order, single: int, clusters: int, seed: int = 3):
        """``counts`` and ``first`` per id (all, and at word beginnings); ``pairs`` of places, rest and boundary last; ``order``: the common ids."""
        import numpy as np

        n = len(order)
        place = np.full(len(counts), n)
        place[order] = np.arange(n)
        smooth = counts + 0.1
        other = place == n
        rest = np.where(other, np.log(smooth) - np.log(max(smooth[other].sum(), 1e-300)), 0.0)
        prior = np.concatenate([smooth[order], [smooth[other].sum(), pairs[: n + 1, n + 1].sum() + 0.1]])
        prior = prior / prior.sum()
        inside = pairs[: n + 1] + 4.0 * prior
        inside = inside / inside.sum(axis=1, keepdims=True)
        begun = first + 0.1
        goes = np.maximum(counts - first, 0) + 0.1
        left = {"inside": inside, "place": place, "other": other, "single": single, "clusters": clusters, "seed": seed}
        label, mass, within = _grouped(first, begun, **left)
        inner, weight, inner_within = _grouped(goes - 0.1, goes, **left)
        weight = np.append(weight, pairs[: n + 1, n + 1].sum() + 0.1)
        start, inner_start = (np.log(np.maximum(m, 1e-9) / m.sum()).astype("f4") for m in (mass, weight))
        return cls(
            place, n, np.log(inside).astype("f4"), rest.astype("f4"), begun / begun.sum(), label, len(mass), within.astype("f4"), start,
            inner, len(weight), inner_within.astype("f4"), inner_start,
        )


def _grouped(seen, weight, inside, place, other, single: int, clusters: int, seed: int):
    """Class per id, weight per class, log share of an id: the most ``seen`` alone, the others by what follows them inside words."""
    import numpy as np

    ranked = np.argsort(-seen, kind="stable")[: max(single, 1)]
    label = np.full(len(seen), -1)
    label[ranked] = np.arange(len(ranked))
    left = np.flatnonzero((label < 0) & ~other)
    k = min(clusters, max(1, len(left)))
    if len(left):
        rows = np.sqrt(inside[place[left]])
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
        middle = rows[np.random.default_rng(seed).choice(len(rows), k, replace=False)]
        for _ in range(10):
            to = (rows @ middle.T).argmax(axis=1)
            for c in range(k):
                if (to == c).any():
                    middle[c] = rows[to == c].sum(axis=0)
                    middle[c] /= np.linalg.norm(middle[c])
        label[left] = len(ranked) + to
    label[label < 0] = len(ranked) + k
    mass = np.bincount(label, weight, minlength=len(ranked) + k + 1)
    return label, mass, np.log(weight) - np.log(np.maximum(mass[label], 1e-300))


@lru_cache
def branches(n: int):
    """Branch and place in it of each of ``n`` classes, the number of shared branches and of places in one.

    The first ``ALONE`` classes and the last one are branches of their own, behind the shared ones; the others are dealt
    over shared branches in turn, so that common classes are spread.
    """
    import numpy as np

    alone = min(ALONE, n - 1)
    others = n - 1 - alone
    shared = max(1, round(others**0.5)) if others else 0
    nth = np.arange(others)
    branch = np.concatenate([shared + np.arange(alone), nth % max(shared, 1), [shared + alone]])
    place = np.concatenate([np.zeros(alone, int), nth // max(shared, 1), [0]])
    return branch, place, shared, -(-others // max(shared, 1))


def _head(start, width: int, rng, head: str) -> dict:
    """Starting weights of a head whose classes have log probabilities ``start``."""
    import numpy as np

    branch, _, shared, places = branches(len(start))
    told = branch < shared
    top = np.full(branch.max() + 1, -np.inf)
    np.logaddexp.at(top, branch, start)
    leaf = start[told] - top[branch[told]]
    n = len(top)
    return {
        "out" + head: (0.1 * rng.normal(size=(width, n)) / np.sqrt(width)).astype("f4"), "bias" + head: top.astype("f4"),
        "leaf" + head: (0.1 * rng.normal(size=(shared, width, places)) / np.sqrt(width)).astype("f4"), "leaf_bias" + head: leaf.astype("f4"),
    }


def fresh(vocabulary: Vocabulary, width: int, window: int, seed: int = 5) -> dict:
    """Starting weights."""
    import numpy as np

    rng = np.random.default_rng(seed)

    def w(*shape):
        return (rng.normal(size=shape) / np.sqrt(shape[0])).astype("f4")

    return {
        "embed": (0.5 * rng.normal(size=(vocabulary.size + 2, width))).astype("f4"), "q": w(width, width), "k": w(width, width), "v": w(width, width), "o": w(width, width),
        "near": np.zeros(window, "f4"), "w": w(width, width), "b": np.zeros(width, "f4"),
        **_head(vocabulary.start, width, rng, ""), "gate": np.zeros(width, "f4"), "gate_bias": np.zeros(1, "f4"),
        **_head(vocabulary.goes_start, width, rng, "_in"), "gate_in": np.zeros(width, "f4"), "gate_bias_in": np.full(1, INSIDE, "f4"),
    }


def _told(p: dict, places) -> tuple:
    """What each of the ``places`` asks, answers to, passes on and keeps: with one layer these depend on the place alone."""
    x = p["embed"][places]
    return x, (x @ p["q"]) * x.dtype.type(x.shape[1] ** -0.5), x @ p["k"], x @ (p["v"] @ p["o"] @ p["w"]), x @ p["w"] + p["b"]


def _attend(p: dict, inputs, known: tuple | None = None, skip: int = 0):
    """Hidden states of windows of places, but for the first ``skip`` of each, and what the way back needs.

    ``known`` holds what :func:`_told` says of all places; without it this is worked out for the different places here.
    """
    import numpy as np

    n, length = inputs.shape
    places, at = None, inputs.ravel()
    if known is None:
        seen = np.zeros(len(p["embed"]), bool)
        seen[at] = True
        places, at = np.flatnonzero(seen), (np.cumsum(seen) - 1)[at]
        known = _told(p, places)
    x, asks, answers, passes, keeps = known
    asked = at.reshape(n, length)[:, skip:].ravel() if skip else at
    q, k, v = (t.take(i, axis=0).reshape(n, -1, x.shape[1]) for t, i in ((asks, asked), (answers, at), (passes, at)))
    gap = np.arange(skip, length)[:, None] - np.arange(length)[None, :]
    a = q @ k.transpose(0, 2, 1)
    near = p["near"][:length]
    if max(a.max(initial=0), -a.min(initial=0), np.abs(near).max(initial=0)) < EXACT:
        np.exp(a, out=a)
        a *= np.where(gap >= 0, np.exp(near)[np.maximum(gap, 0)], 0).astype(a.dtype)
    else:
        a += np.where(gap >= 0, near[np.maximum(gap, 0)], -1e9).astype(a.dtype)
        a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
    a /= (a @ np.ones(length, a.dtype))[:, :, None]
    c = a @ v
    u = c.reshape(-1, x.shape[1]) + keeps.take(asked, axis=0)
    np.tanh(u, out=u)
    return u, (places, at, x, q, k, v, a, c, gap)


def _mixed(p: dict, vocabulary: Vocabulary, u, tree, ids):
    """Natural log probability of first ids in states ``u``, given the tree's; parts for the way back."""
    return _priced(p, "", u, tree, vocabulary.classes[ids], vocabulary.within[ids])


def _shares(u, out, bias, gate=None):
    """Softmax over the last axis of ``u @ out + bias``, as powers and their sum, and the logit of a ``gate``, a column more."""
    import numpy as np

    opened = None
    if gate is None:
        logits = u @ out
        logits += bias
    else:
        logits = u @ np.column_stack([out, gate[0]])
        logits += np.append(bias, gate[1])
        opened = logits[..., -1].copy()
        logits[..., -1] = -np.inf
    reach = np.abs(out).sum(axis=-2, keepdims=True)  # states are within -1 and 1
    if (bias + reach).max(initial=0) >= EXACT or (bias - reach).max(axis=-1).min(initial=0) <= -EXACT:
        logits -= logits.max(axis=-1, keepdims=True)
    np.exp(logits, out=logits)
    return logits, logits @ np.ones(logits.shape[-1], logits.dtype), opened


def _priced(p: dict, head: str, u, tree, cls, within):
    """Natural log probability of an id of share ``within`` in class ``cls`` of a head, given the tree's; parts for the way back."""
    import numpy as np

    kind = u.dtype.type
    tree = tree.astype(kind, copy=False)
    leaf_bias = p["leaf_bias" + head]
    shared, _, places = p["leaf" + head].shape
    branch, place, _, _ = branches(len(leaf_bias) + len(p["bias" + head]) - shared)
    of = branch[cls]
    tops, total, g = _shares(u, p["out" + head], p["bias" + head], (p["gate" + head], p["gate_bias" + head]))
    g = 1 / (1 + np.exp(-g))
    net = np.log(tops[np.arange(len(cls)), of] / total + kind(1e-30)) + within
    low = None
    if shared:
        # events of shared branches, a row of slots for each branch
        at = np.flatnonzero(of < shared)
        own = of[at].astype(np.int16)
        order = np.argsort(own, kind="stable")
        number = np.bincount(own, minlength=shared)
        most = max(1, number.max())
        at, own = at[order], own[order].astype(np.int64)
        slot = own * most + np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number)
        states = np.zeros((shared * most, u.shape[1]), u.dtype)
        states[slot] = u.take(at, axis=0)
        states = states.reshape(shared, most, -1)
        nobody = np.full(shared * places - len(leaf_bias), NOBODY, leaf_bias.dtype)
        leaves, sums, _ = _shares(states, p["leaf" + head], np.concatenate([leaf_bias, nobody]).reshape(places, shared).T[:, None])
        leaves, sums, nth = leaves.reshape(-1, places), sums.ravel(), place[cls[at]]
        net[at] += np.log(leaves[slot, nth] / sums[slot] + kind(1e-30))
        low = at, slot, nth, states, leaves, sums
    one, two = np.log(g + kind(1e-9)) + net, np.log(1 - g + kind(1e-9)) + tree
    return np.logaddexp(one, two), (tops, total, of, low, g, one, two)


def _going_on(vocabulary: Vocabulary, ids, tree, first, closing):
    """Which positions tell how a word goes on, and the class, share and tree value of what does: the id, or the end before a first id."""
    import numpy as np

    if closing is None:
        return np.zeros(len(ids), bool), ids, tree, tree
    return (
        ~first | np.isfinite(closing), np.where(first, np.int32(vocabulary.n_goes - 1), vocabulary.goes.astype(np.int32)[ids]),
        np.where(first, np.float32(0), vocabulary.goes_within[ids]), np.where(first, closing, tree),
    )


def windows(starts, ends, window: int, stride: int):
    """Windows over rows ``starts[i] .. ends[i]``: first input, inputs, and from which input on it scores.

    Each input is scored in exactly one window: the first covers its whole width, later ones their last ``stride``.
    """
    import numpy as np

    sizes = ends - starts
    number = np.where(sizes > window, 1 + -(-(sizes - window) // stride), np.minimum(sizes, 1))
    row = np.repeat(np.arange(len(sizes)), number)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    first = starts[row] + nth * stride
    return first, np.minimum(window, ends[row] - first), np.where(nth > 0, window - stride, 0)


def _inputs(vocabulary: Vocabulary, ids, starts, ends):
    """The place read before each id; the start of a row reads the start mark."""
    import numpy as np

    before = np.full(len(ids), vocabulary.size + 1, dtype=np.int32)
    before[1:] = vocabulary.common[ids[:-1]]
    before[starts[starts < ends]] = vocabulary.size + 1
    return before


def log_probabilities(p: dict, vocabulary: Vocabulary, ids, tree, first, starts, ends, stride: int, batch: int = 128, closing=None):
    """Natural log probability of each id of the rows: every id is scored once with the ids before it in its window.

    ``tree`` holds the tree's values of all ids, ``first`` marks ids that begin a word.  ``closing`` holds the tree's
    value of the end of the word before a first id, NaN where there is none; such an end is scored in the state before
    that id and counted with it.  Without ``closing`` only first ids are scored, the others keep the tree's value.
    """
    import numpy as np

    window = len(p["near"])
    before = _inputs(vocabulary, ids, starts, ends)
    at0, size, since = windows(starts, ends, window, stride)
    out, steps = np.array(tree, dtype=np.float64), np.arange(window)
    going, cls, within, known = _going_on(vocabulary, ids, tree, first, closing)
    classes, inside_class, told = vocabulary.classes.astype(np.int32)[ids], vocabulary.within[ids], _told(p, slice(None))
    for skip in np.unique(since):  # windows that score from the same input on
        of = np.flatnonzero(since == skip)
        for at in range(0, len(of), batch):
            f, n = at0[of[at : at + batch], None], size[of[at : at + batch], None]
            inside = steps < n
            index = np.where(inside, f + steps, 0)
            u, _ = _attend(p, np.where(inside, before[index], vocabulary.size + 1), told, skip)
            inside, index = inside[:, skip:].ravel(), index[:, skip:].ravel()
            picked = np.flatnonzero(inside & first[index])
            target = index[picked]
            out[target], _ = _priced(p, "", u.take(picked, axis=0), tree[target], classes[target], inside_class[target])
            if closing is not None:
                picked = np.flatnonzero(inside & going[index])
                target = index[picked]
                value, _ = _priced(p, "_in", u.take(picked, axis=0), known[target], cls[target], within[target])
                out[target] = np.where(first[target], out[target] + value, value)
    return out


def train(p: dict, vocabulary: Vocabulary, ids, tree, first, starts, ends, epochs: int = 2, rate: float = 0.005, batch: int = 48, seed: int = 9, closing=None) -> dict:
    """Adam over shuffled windows of the rows, on first ids, and with ``closing`` on all ids and ends of words; returns the trained weights."""
    import numpy as np

    window = len(p["near"])
    at0, size, _ = windows(starts, ends, window, window)
    if not len(at0):
        return p
    before = _inputs(vocabulary, ids, starts, ends)
    going, cls, within, known = _going_on(vocabulary, ids, tree, first, closing)
    classes, inside_class = vocabulary.classes.astype(np.int32)[ids], vocabulary.within[ids]
    rng, steps = np.random.default_rng(seed), np.arange(window)
    shapes, cuts = {k: v.shape for k, v in p.items()}, np.cumsum([0, *(v.size for v in p.values())])
    inside = steps < size[:, None]
    index = np.where(inside, (at0[:, None] + steps).astype(np.int32 if len(ids) < 1 << 31 else np.int64), 0)
    inputs = np.where(inside, before[index], np.int32(vocabulary.size + 1))
    begun, gone = inside & first[index], inside & going[index]
    # one array of all weights, of which each weight is a part
    flat = np.concatenate([v.ravel() for v in p.values()])
    p = {k: flat[i:j].reshape(shapes[k]) for k, i, j in zip(shapes, cuts, cuts[1:])}
    m, s = np.zeros_like(flat), np.zeros_like(flat)
    total, t = epochs * -(-len(at0) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(at0))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            marked, more, at_row = np.flatnonzero(begun[rows]), np.flatnonzero(gone[rows]), index[rows].ravel()
            one, two = at_row[marked], at_row[more]
            heads = {"": (marked, classes[one], inside_class[one], tree[one]), "_in": (more, cls[two], within[two], known[two])}
            grads = _back(p, inputs[rows], heads)
            g = np.concatenate([grads[k].ravel() for k in p])
            t += 1
            step = rate * min(1.0, t / 20) * (1.0 - 0.9 * t / total)
            m += 0.1 * (g - m)
            g *= g
            g -= s
            g *= flat.dtype.type(0.01)
            s += g
            np.divide(s, 1 - 0.99**t, out=g)
            np.sqrt(g, out=g)
            g += flat.dtype.type(1e-8)
            np.divide(m, g, out=g)
            g *= flat.dtype.type(step / (1 - 0.9**t))
            flat -= g
    return p


def _gradients(p: dict, vocabulary: Vocabulary, inputs, ids, tree, marked, more=None) -> dict:
    """Gradient of the mean negative log probability of the ``ids`` that are ``marked``, plus that of ``more`` by their number.

    ``more`` holds places in the windows with the class, share and tree value of how a word goes on there.
    """
    import numpy as np

    at = np.flatnonzero(marked.ravel())
    flat = ids.ravel()[at]
    if more is None:
        more = (np.zeros(0, np.int64),) * 4
    return _back(p, inputs, {"": (at, vocabulary.classes[flat], vocabulary.within[flat], tree.ravel()[at]), "_in": more})


def _back(p: dict, inputs, heads: dict) -> dict:
    """Gradient of the negative log probabilities of both heads' events, over the number of the first's.

    A head's events are places in the windows with class, share and tree value.
    """
    import numpy as np

    u, (places, place, x, q, k, v, a, c, gap) = _attend(p, inputs)
    n, length = inputs.shape
    width, kind = x.shape[1], x.dtype.type
    scale = kind(1.0 / max(1, len(heads[""][0])))
    d_u, out = np.zeros_like(u), {}
    for head, (at, cls, within, known) in heads.items():
        own = u.take(at, axis=0)
        value, (d_top, total, of, low, g, one, two) = _priced(p, head, own, known, cls, within)
        share = np.exp(one - value).astype(kind) * scale
        d_top *= (share / total)[:, None]
        d_top[np.arange(len(cls)), of] -= share
        d_top[:, -1] = g * scale - share
        made, sums = own.T @ d_top, np.ones(len(cls), kind) @ d_top
        out |= {"out" + head: made[:, :-1], "bias" + head: sums[:-1], "gate" + head: made[:, -1], "gate_bias" + head: sums[-1:]}
        back = d_top @ np.column_stack([p["out" + head], p["gate" + head]]).T
        if low is None:
            out |= {k + head: np.zeros_like(p[k + head]) for k in ("leaf", "leaf_bias")}
        else:
            on, slot, nth, states, d_leaf, sums = low
            portion = np.zeros(len(sums), kind)
            portion[slot] = share[on]
            d_leaf *= (portion / sums)[:, None]
            d_leaf[slot, nth] -= share[on]
            d_leaf = d_leaf.reshape(len(states), -1, d_leaf.shape[1])
            out |= {"leaf" + head: states.transpose(0, 2, 1) @ d_leaf, "leaf_bias" + head: d_leaf.sum(axis=1).T.ravel()[: len(p["leaf_bias" + head])]}
            back[on] += (d_leaf @ p["leaf" + head].transpose(0, 2, 1)).reshape(-1, width).take(slot, axis=0)
        d_u[at] += back
    u *= u
    np.subtract(1, u, out=u)
    u *= d_u
    d_pre = u.reshape(n, length, width)
    d_s = d_pre @ v.transpose(0, 2, 1)
    d_s -= np.einsum("nlw,nlw->nl", d_pre, c)[:, :, None]
    d_s *= a
    out["near"] = np.bincount(np.maximum(gap, 0).ravel(), np.where(gap >= 0, d_s.sum(axis=0), 0).ravel(), minlength=len(p["near"])).astype(kind)
    read, on = x.take(place, axis=0), p["v"] @ p["o"]
    parts = np.concatenate([d.reshape(-1, width) for d in (d_pre, a.transpose(0, 2, 1) @ d_pre, d_s @ k, d_s.transpose(0, 2, 1) @ q)], axis=1)
    shrunk = kind(width**-0.5)
    kept, passed, asked, answered = np.split(read.T @ parts, 4, axis=1)
    back = passed @ p["w"].T
    out |= {"w": kept + on.T @ passed, "b": np.ones(len(parts), kind) @ parts[:, :width], "o": p["v"].T @ back, "v": back @ p["o"].T, "q": asked * shrunk, "k": answered}
    d_x = parts @ np.concatenate([p["w"].T, (on @ p["w"]).T, p["q"].T * shrunk, p["k"].T])
    # sums over all inputs that read the same place
    number = np.bincount(place, minlength=len(places))
    order = np.argsort(place.astype(np.int16 if len(places) < 1 << 15 else np.int64), kind="stable")
    out["embed"] = np.zeros_like(p["embed"])
    out["embed"][places] = np.add.reduceat(d_x.take(order, axis=0), np.cumsum(number) - number, axis=0)
    return out
