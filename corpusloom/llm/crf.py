"""Linear-chain conditional random field over word-shape features: training and batched Viterbi in numpy.

Tokens are runs of bytes above the space. A token's shape is its sequence of byte classes with repeats collapsed (so
`555-2652` is `9-9`); features are hashes of the shapes and coarse lengths of a token and its neighbours, of its
digits, dots and signs in any order, and of the bytes of the token before. Each feature has a weight for each label in a
hashed table.

Memory goes with the tokens of a text, a few dozen bytes each: features are made and weighed in slices, and Viterbi runs
over the stretches that can hold anything but O, those of like length together, so one long line costs short ones nothing.
"""

from __future__ import annotations

import random

import numpy as np

from .words import BYTE, LOWER, mix, powers, randoms

LABELS = ("O", "email", "ip", "card", "phone", "secret")
BUCKETS = 1 << 15
CLASS = np.zeros(256, np.uint8)
CLASS[0x21:0x80] = np.arange(0x21, 0x80)  # punctuation is its own class
CLASS[0x30:0x3A], CLASS[0x41:0x5B], CLASS[0x61:0x7B], CLASS[0x80:] = 1, 2, 3, 4
HEX = np.zeros(256, bool)
HEX[0x30:0x3A] = HEX[0x61:0x67] = True
KIND = randoms(256, 41)
POWER = powers(4096, int(randoms(1, 42)[0]) | 1)
#: Tokens, and bytes of them, whose features are made at once; padded places of one Viterbi pass.
SLICE, STEP, CELLS = 1 << 15, 1 << 18, 200_000
SALT, TEMPLATE = randoms(3, 43), randoms(10, 44)
U = np.uint64


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, one past the last, sequence) of every token; a sequence is a line of a text."""
    inside = data > 0x20
    heads = offs[:-1][offs[:-1] < len(data)]
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    new[heads] = inside[heads]
    starts = np.flatnonzero(new)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    tails = offs[1:][offs[1:] > 0] - 1
    stop[tails] = inside[tails]
    breaks = data == 0x0A
    breaks[heads] = True
    return starts, np.flatnonzero(stop) + 1, np.cumsum(breaks, dtype=np.int32)[starts] if len(starts) else starts


def polynomial(table: np.ndarray, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each run of table[codes] that starts at `first`, worked out in steps of bounded size."""
    n = np.diff(np.append(first, len(codes)))
    out = np.zeros(len(first), np.uint64)
    for a in range(0, len(codes), STEP):
        b = min(a + STEP, len(codes))
        runs = slice(int(np.searchsorted(first, a, "right")) - 1, int(np.searchsorted(first, b)))
        heads = np.maximum(first[runs], a)
        place = np.arange(a, b) - np.repeat(first[runs], np.diff(np.append(heads, b)))
        out[runs] += np.add.reduceat(table[codes[a:b]] * POWER[np.minimum(place, len(POWER) - 1)], heads - a)
    return mix(out + n.astype(np.uint64))


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Buckets of each token's features, a row for each token."""
    n = ends - starts
    raw = data[starts[0] : ends[-1]]
    raw = raw[raw > 0x20]
    first = np.cumsum(n) - n
    kind = CLASS[raw]
    change = np.append(True, kind[1:] != kind[:-1])
    change[first] = True
    at = np.cumsum(change, dtype=np.int32)[first] - 1
    shape = polynomial(KIND, kind[change], at)
    digits = np.add.reduceat(kind == 1, first, dtype=np.int64)
    hexes = np.add.reduceat(HEX[raw], first, dtype=np.int64) == n
    dots = np.add.reduceat(raw == 0x2E, first, dtype=np.int64)
    signs = np.add.reduceat(raw == 0x40, first, dtype=np.int64)
    word = polynomial(BYTE, raw, first)
    size = np.minimum(np.log2(n).astype(np.int64), 7).astype(np.uint64) + U(8) * hexes.astype(np.uint64)
    count = np.minimum(digits, 20).astype(np.uint64) * U(4) + np.minimum(dots, 3).astype(np.uint64)
    marks = np.minimum(signs, 2) + 3 * (dots > 0)  # whatever their order and number
    edge = U(1)
    same = np.append(False, line[1:] == line[:-1])
    before = lambda x: np.where(same, np.append(edge, x[:-1]), edge)
    after = lambda x: np.where(np.append(same[1:], False), np.append(x[1:], edge), edge)
    columns = [shape, shape + size * SALT[0], shape ^ count * SALT[1], before(shape), after(shape), mix(before(shape) + shape * U(3)), mix(after(shape) + shape * U(5)), before(word), mix(count * SALT[2] + before(count)), marks.astype(np.uint64)]
    return np.stack([(mix(c ^ TEMPLATE[i]) >> U(64 - 15)).astype(np.int32) for i, c in enumerate(columns)], 1)


class Crf:
    """Weights (feature bucket x label), transitions (label x label)."""

    def __init__(self) -> None:
        self.weights = np.zeros((BUCKETS, len(LABELS)), np.float32)
        self.moves = np.zeros((len(LABELS), len(LABELS)), np.float32)

    def emissions(self, f: np.ndarray) -> np.ndarray:
        out = self.weights[f[:, 0]]
        for k in range(1, f.shape[1]):
            out = out + self.weights[f[:, k]]
        return out

    def fit(self, f: np.ndarray, line: np.ndarray, labels: np.ndarray, steps: int = 90, rate: float = 0.1, ridge: float = 2e-4) -> Crf:
        """Adam on the penalised likelihood; all sequences go forward and backward at once, padded."""
        grid, mask = padded(line)
        n, t, c = *grid.shape, len(LABELS)
        gold, held = np.where(mask, labels[grid], 0), mask[:, :, None]
        truth = np.eye(c)[gold] * held
        pairs = np.zeros((c, c))
        np.add.at(pairs, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
        used, local = np.unique(f, return_inverse=True)
        local = local.reshape(f.shape)
        w, a = np.zeros((len(used), c)), np.zeros((c, c))
        state = [np.zeros_like(x) for x in (w, w, a, a)]
        rows = np.repeat(np.arange(len(f)), f.shape[1])
        for step in range(1, steps + 1):
            e = w[local].sum(1)[grid] * held
            forward, backward = np.zeros((n, t, c)), np.zeros((n, t, c))
            forward[:, 0] = e[:, 0]
            for k in range(1, t):
                x = lse(forward[:, k - 1, :, None] + a, 1) + e[:, k]
                forward[:, k] = np.where(held[:, k], x, forward[:, k - 1])
            for k in range(t - 2, -1, -1):
                x = lse(a + (e[:, k + 1] + backward[:, k + 1])[:, None, :], 2)
                backward[:, k] = np.where(held[:, k + 1], x, 0)
            z = lse(forward[:, -1], 1)
            p = np.exp(forward + backward - z[:, None, None]) * held
            both = np.exp(forward[:, :-1, :, None] + a + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]) * held[:, 1:, :, None]
            d = np.zeros((len(f), c))
            d[grid[mask]] = (truth - p)[mask]
            gw = np.stack([np.bincount(local.ravel(), d[rows, y], len(used)) for y in range(c)], 1) / n - ridge * w
            ga = (pairs - both.sum((0, 1))) / n - ridge * a
            for x, g, m, v in ((w, gw, *state[:2]), (a, ga, *state[2:])):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        self.weights[used], self.moves = w, a.astype(np.float32)
        return self

    def label(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The best label of every token. A slice's features see one token to each side of it."""
        out = np.zeros((len(starts), len(LABELS)), np.float32)
        a, size = 0, np.concatenate([[0], np.cumsum(ends - starts)])
        while a < len(starts):
            b = max(a + 1, min(a + SLICE, int(np.searchsorted(size, size[a] + STEP, "right")) - 1))
            lo, hi = max(0, a - 1), min(len(starts), b + 1)
            out[a:b] = self.emissions(features(data, starts[lo:hi], ends[lo:hi], line[lo:hi])[a - lo : b - lo])
            a = b
        return self.decode(out, line)

    def stretches(self, e: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, one past the last) of the stretches of a line outside of which a best path is O throughout.

        A token is O in a best path if no other label gains on O under any neighbours. Between two such tokens a run of
        other labels gains on O at most each token's gain and twice the best gain of a transition on O to O, so a
        stretch without a token for which that is above zero is O too."""
        m = self.moves
        enter, leave = np.maximum((m[:, 1:] - m[:, :1]).max(0), 0), np.maximum((m[1:] - m[:1]).max(1), 0)
        free = (e[:, 1:] + (enter + leave) > e[:, :1]).any(1)
        hot = e[:, 1:].max(1) - e[:, 0] + 2 * max(0.0, float((m - m[0, 0]).max())) > 0
        near = np.append(False, free[1:] & free[:-1] & (line[1:] == line[:-1]))  # belongs with the token before
        first = np.flatnonzero(free & ~near)
        last = np.flatnonzero(free & ~np.append(near[1:], False)) + 1
        sums = np.concatenate([[0], np.cumsum(hot)])
        alive = sums[last] > sums[first]
        return first[alive], last[alive]

    def decode(self, e: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The best label of every token from its emissions."""
        out = np.zeros(len(line), np.int64)
        if not len(line):
            return out
        first, last = self.stretches(e, line)
        size = last - first
        by = np.argsort(size, kind="stable")
        first, last, size = first[by], last[by], size[by]
        a = 0
        while a < len(size):  # stretches of like length go together
            b = max(a + 1, min(int(np.searchsorted(size, 2 * size[a], "right")), a + max(1, CELLS // int(2 * size[a]))))
            span = np.arange(size[b - 1])
            mask = span < size[a:b, None]
            at = np.where(mask, first[a:b, None] + span, 0)
            x = e[at]
            before, after = first[a:b] - 1, last[a:b]
            inside = (before >= 0) & (line[before] == line[first[a:b]])
            x[inside, 0] += self.moves[0]
            inside = (after < len(line)) & (line[np.minimum(after, len(line) - 1)] == line[last[a:b] - 1])
            x[np.flatnonzero(inside), size[a:b][inside] - 1] += self.moves[:, 0]
            out[at[mask]] = viterbi(x, mask, self.moves)[mask]
            a = b
        return out


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def padded(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of each line, a row for each line, and which of them are real."""
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    n = np.diff(np.append(first, len(line)))
    span = np.arange(n.max())
    mask = span < n[:, None]
    return np.where(mask, first[:, None] + span, 0), mask


def viterbi(e: np.ndarray, mask: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best paths of padded sequences (sequence, place, label)."""
    n, t, c = e.shape
    back, best = np.zeros((n, t, c), np.int8), e[:, 0].copy()
    for k in range(1, t):
        x = best[:, :, None] + moves
        back[:, k] = x.argmax(1)
        best = np.where(mask[:, k, None], x.max(1) + e[:, k], best)
    path = np.zeros((n, t), np.int64)
    at = best.argmax(1)
    for k in range(t - 1, -1, -1):
        path[:, k] = at
        if k:
            at = np.where(mask[:, k], back[np.arange(n), k, at], at)
    return path


def labelled_table(n: int = 600, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """The small training table: (tokens, labels) of made-up lines with and without personal data."""
    rng = random.Random(seed)
    parts = "the an en ti er es on re ha ing tion ed nd ly ent que der sch ung keit ció ña eux ai ou le la de los über é ö ß ç st wh".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(1, 6)))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    tail = lambda: rng.choice(["", "", "", "", ",", ".", ";", "!", "?", ")", "***", "%%%", "&&&", "$$$", "###", "!!"])

    def mixed(k: int, more: str = "") -> str:
        return "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + more) for _ in range(k))

    def prose() -> str:
        w = word()
        x = rng.random()
        w = w.capitalize() if x < 0.15 else w.upper() if x < 0.2 else w
        return w + tail()

    def other() -> list[str]:
        """What looks like data but is not personal."""
        k = rng.randrange(12)
        return [
            [digits(rng.randrange(1, 6)) + tail()], [f"{digits(4)}-{digits(2)}-{digits(2)}"], [f"{digits(2)}:{digits(2)}"], [f"{digits(1)}.{digits(1)}" + tail()], [f"v{digits(1)}.{digits(2)}.{digits(1)}"], ["|"], [f"${digits(3)}.{digits(2)}"],
            [f"{word()}/{word()}.html"], [f"http://{word()}.example.com/{word()}"], ["version", f"{digits(1)}.{digits(1)},"], ["Licensed", "under", "CC", "BY-NC", "4.0."], [f"#{digits(3)}", "=", f'"{word()}"'],
        ][k]

    def entity() -> tuple[str, list[str]]:
        name, host = word() + rng.choice(["", ".", "_"]) + rng.choice([word(), digits(2)]), word() + digits(rng.randrange(0, 2))
        top = rng.choice(["com", "org", "net", "example.com", "de"])
        area, a, b = digits(3), digits(3), digits(4)
        d = [digits(4) for _ in range(4)]
        token = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 40, 40, 64])))
        kind, forms = rng.choice([
            ("email", [[f"{name}@{host}.{top}"], [f"<{name}@{host}.{top}>"], [name, "[at]", host, "[dot]", top], [name, "(at)", f"{host}.{top}"], [f"{name}@{host}.{top}"]]),
            ("ip", [[".".join(str(rng.randrange(256)) for _ in range(4))]]),
            ("card", [["".join(d)], ["".join(d)], d, ["-".join(d)], [".".join(d)]]),
            ("phone", [[f"+{digits(1)}", f"({area})", f"{a}-{b}"], [f"+{digits(2)}", area, a, b], [f"({area})", f"{a}-{b}"], [f"{area}-{a}-{b}"], [f"+{digits(11)}"], [f"{area}.{a}.{b}"]]),
            ("secret", [["token", "=", f'"{token}"'], ["token", "=", f'"{token}"'], ["secret_key", "=", f'"{token}"'], ["api_key:", token], ["password", "=", f'"{mixed(24)}"'], ["aws_secret", "=", f'"{mixed(40, "+/")}"'], ["api_key:", f"sk-{mixed(32)}"], ["token:", f"ghp_{mixed(36)}"], ["token", "=", f'"{mixed(43, "_-")}="'], ["Bearer", mixed(40, "._-")]]),
        ])
        form = list(rng.choice(forms))
        form[-1] += rng.choice(["", "", "", ",", ".", "###", "!!"])
        return kind, form

    rows = []
    for _ in range(n):
        words, labels = [], []
        for _ in range(rng.randrange(1, 7)):
            x = rng.random()
            add, kind = [prose() for _ in range(rng.randrange(1, 7))], "O"
            if x < 0.3:
                kind, add = entity()
            elif x < 0.5:
                add = other()
            words += add
            named = kind == "secret"
            labels += [kind if not named or k == len(add) - 1 else "O" for k in range(len(add))]
        rows.append((words, labels))
    return rows


def fit_labelled(rows: list[tuple[list[str], list[str]]]) -> Crf:
    """A field trained on (tokens, labels) lines."""
    data = np.frombuffer("\n".join(" ".join(words) for words, _ in rows).encode(), np.uint8)
    starts, ends, line = tokens(data, np.array([0, len(data)]))
    labels = np.array([LABELS.index(y) for _, ys in rows for y in ys])
    return Crf().fit(features(data, starts, ends, line), line, labels)
