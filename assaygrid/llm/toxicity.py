"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters the network as a word (a trained vector of its own, and how much more often toxic texts
have it) and by its characters: read one after the other, forwards and backwards, by gated recurrent
layers of their own, and as n-grams of 3 to 5 bytes (the mean of their trained vectors, and the largest
log-odds among them), so that forms of a word that were never seen still count. Windows of
words overlap and cover the whole text; a text's score is that of its highest window, calibrated on
labelled texts that were kept out of training.

Labels are of whole texts, so training picks windows: of a toxic text those that score highest so far,
of others their highest too and some at random. It takes a bounded sample of labelled rows (MOST_TOXIC,
MOST_CLEAN, MOST_BYTES), the same for the same table, in one task of an executor; everything else is over all rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaygrid.llm import ragged
from assaygrid.llm.tables import arrow_batches, without

#: A text of this score or more is toxic.
REJECT = 0.7
#: Bounds of the training sample, in rows of either label.
MOST_TOXIC, MOST_CLEAN = 1500, 3000
#: Characters of all texts of the sample together; bytes of a piece of a model on its way to the driver.
MOST_BYTES, PART = 32 << 20, 1 << 20
#: Words of a window, and from one window to the next.
WINDOW, STRIDE = 48, 32
#: Sizes: trained vectors of a word and of an n-gram, hidden units of a direction, attention.
VECTOR, HIDDEN, ATTEND = 8, 12, 12
#: Of the layers that read a word's bytes: trained vectors of a byte, hidden units of a direction; bytes of a window of a word, and from one window to the next.
BYTE, SPELL = 6, 6
LETTERS, STEP = 24, 16
#: Words and n-grams in fewer training texts have no vector; most n-grams kept.
LEAST_TEXTS, MOST_GRAMS = 3, 40_000
#: Epochs of training, and more until so many steps are done.
EPOCHS, STEPS = 5, 60
#: Words whose inputs a worker remembers; beyond that it forgets all and starts anew.
REMEMBERED = 200_000

_WORD = np.zeros(256, np.uint8)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER_C3 = np.zeros(256, bool)
_UPPER_C3[[b for b in range(0x80, 0x9F) if b != 0x97]] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and starts, ends and hashes of words."""
    data = _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    data[lead[_UPPER_C3[data[lead + 1]]] + 1] += 32
    s, e, k = ragged.runs(_WORD[data], offsets)
    s, e = s[k == 1], e[k == 1]
    return data, s, e, ragged.hashes(data, s, e) if len(s) else np.zeros(0, np.uint64)


#: Words taken at a time where many are, to bound memory.
CHUNK = 8192


SIZES = (3, 4, 5)


def _all_grams(words: list[bytes], places) -> tuple[np.ndarray, np.ndarray]:
    """places(codes) of all words' n-grams, by chunks of words, and each word's number of them."""
    parts = [_grams(words[i : i + CHUNK]) for i in range(0, len(words), CHUNK)]
    return np.concatenate([places(c) for c, _ in parts]), np.concatenate([n for _, n in parts])


def _grams(words: list[bytes], lengths: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of 3 to 5 bytes of each word between marks, and each word's number of them."""
    marked = [b"\x02" + w + b"\x03" for w in words]
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    heads = np.cumsum(sizes) - sizes
    codes, owner = [], []
    for n in lengths:
        count = np.maximum(sizes - n + 1, 0)
        at = ragged.expand(heads, count)
        code = np.full(len(at), n, np.uint64)
        for j in range(n):
            code = code << np.uint64(8) | data[at + j]
        codes.append(code)
        owner.append(np.repeat(np.arange(len(words)), count))
    codes, owner = np.concatenate(codes), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return codes[order], np.bincount(owner, minlength=len(words))


def _find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of x in a sorted table, from 1; 0 where it is not there."""
    if not len(table):
        return np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at + 1, 0)


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of known words
    grams: np.ndarray  # sorted codes of known n-grams
    word_odds: np.ndarray  # from place 1; place 0 stands for all others
    gram_odds: np.ndarray
    p: dict[str, np.ndarray]  # trained parameters
    scale: tuple[float, float]  # calibration of a text's highest window
    none: float  # the score of a text without words

    def inputs(self, hashes: np.ndarray, words: list[bytes]) -> np.ndarray:
        """The network's input of each word."""
        if len(words) > CHUNK:
            return np.concatenate([self.inputs(hashes[i : i + CHUNK], words[i : i + CHUNK]) for i in range(0, len(words), CHUNK)])
        word = _find(self.words, hashes)
        codes, count = _grams(words)
        gram = _find(self.grams, codes)
        odds, top = _fixed(self.word_odds, self.gram_odds, word, gram, count)
        return np.column_stack([self.p["word"][word], _mean(self.p["gram"][gram], count), spelled(self.p, Letters(words)), odds / 4, top / 4]).astype(np.float32)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What inputs of words add to the gates of both directions."""
        p = self.p
        return np.concatenate([x @ p["wf"].astype(np.float32) + p["bf"].astype(np.float32), x @ p["wb"].astype(np.float32) + p["bb"].astype(np.float32)], 1)


class Letters:
    """Bytes of words in windows that overlap and cover each word; most words are one window."""

    def __init__(self, words: list[bytes]):
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.count = np.where(sizes <= LETTERS, 1, -(-(sizes - LETTERS) // STEP) + 1)
        self.head = np.cumsum(self.count) - self.count
        owner = np.repeat(np.arange(len(words)), self.count)
        begin = np.minimum(ragged.expand(np.zeros(len(words), np.int64), self.count) * STEP, np.maximum(sizes - LETTERS, 0)[owner])
        at = (np.cumsum(sizes) - sizes)[owner] + begin
        self.length = np.minimum(sizes, LETTERS)[owner]
        self.codes = data[np.minimum(at[:, None] + np.arange(LETTERS), len(data) - 1)] if len(data) else np.zeros((len(owner), LETTERS), np.uint8)


def _read(p: dict, letters: Letters, which: np.ndarray, keep: bool = False):
    """Last states of both directions over windows of bytes."""
    steps = int(letters.length[which].max(initial=1))
    codes, mask = letters.codes[which, :steps].T, np.arange(steps)[:, None] < letters.length[which]
    out, saved = [], []
    for d, order in (("f", slice(None)), ("b", slice(None, None, -1))):
        h, back = _pass((p["byte"] @ p[f"cw{d}"] + p[f"cb{d}"])[codes[order]], p[f"cu{d}"], mask[order], keep)
        out.append(h[-1])
        saved.append(back)
    return np.concatenate(out, 1), (codes, mask, saved)


def _alike(length: np.ndarray, which: np.ndarray) -> list[np.ndarray]:
    """Places in which, of windows of like lengths together."""
    found = np.digitize(length[which], (7, 10, 13, 17))
    return [at for i in range(5) if len(at := np.flatnonzero(found == i))]


def _unread(p: dict, dout: np.ndarray, state) -> dict:
    """Gradients of _read."""
    codes, mask, saved = state
    g: dict[str, np.ndarray] = {"byte": np.zeros_like(p["byte"])}
    for i, (d, order) in enumerate((("f", slice(None)), ("b", slice(None, None, -1)))):
        dh = np.zeros((*codes.shape, SPELL))
        dh[-1] = dout[:, i * SPELL : (i + 1) * SPELL]
        dx, g[f"cu{d}"] = _back(dh, p[f"cu{d}"], mask[order], saved[i])
        each = _summed(codes[order].ravel().astype(np.int64), dx.reshape(-1, 3 * SPELL), 256)
        g["byte"] += each @ p[f"cw{d}"].T
        g[f"cw{d}"], g[f"cb{d}"] = p["byte"].T @ each, each.sum(0)
    return g


def spelled(p: dict, letters: Letters) -> np.ndarray:
    """Of each word the mean of its windows' last states."""
    q = {k: p[k].astype(np.float32) for k in ("byte", "cwf", "cwb", "cuf", "cub", "cbf", "cbb")}
    out = np.zeros((len(letters.length), 2 * SPELL), np.float32)
    for at in _alike(letters.length, np.arange(len(letters.length))):
        out[at] = _read(q, letters, at)[0]
    return np.add.reduceat(out, letters.head, axis=0) / letters.count[:, None] if len(letters.head) else out


def _fixed(word_odds: np.ndarray, gram_odds: np.ndarray, word: np.ndarray, gram: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words given by places: their own log-odds, and the largest of their n-grams'."""
    top = np.zeros(len(word))
    has = count > 0
    if has.any():
        heads = np.cumsum(count) - count
        top[has] = np.maximum.reduceat(gram_odds[gram], heads[has])
    return word_odds[word], top


def _mean(x: np.ndarray, count: np.ndarray) -> np.ndarray:
    out = np.zeros((len(count), x.shape[1]), x.dtype)
    has = count > 0
    if has.any():
        heads = np.cumsum(count) - count
        out[has] = np.add.reduceat(x, heads[has], axis=0) / count[has, None]
    return out


def _summed(index: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows of x by their index, 0 to size - 1."""
    out = np.zeros((size, x.shape[1]))
    if len(index):
        order = np.argsort(index, kind="stable")
        index = index[order]
        heads = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
        out[index[heads]] = np.add.reduceat(x[order], heads, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _pass(x: np.ndarray, u: np.ndarray, mask: np.ndarray | None, keep: bool) -> tuple[np.ndarray, list]:
    """A gated recurrent layer over time-major gate inputs x (time, window, 3 * units): all states, and what the way back needs."""
    steps, n, _ = x.shape
    size = len(u)
    h = np.zeros((n, size), x.dtype)
    out = np.empty((steps, n, size), x.dtype)
    saved = []
    for t in range(steps):
        hu = h @ u
        zr = x[t, :, : 2 * size] + hu[:, : 2 * size]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr[:, :size], zr[:, size:]
        c = np.tanh(x[t, :, 2 * size :] + r * hu[:, 2 * size :])
        fresh = c + z * (h - c)
        if mask is not None:
            fresh = np.where(mask[t][:, None], fresh, h)
        if keep:
            saved.append((h, z, r, c, hu[:, 2 * size :]))
        h = fresh
        out[t] = h
    return out, saved


def _back(dh_all: np.ndarray, u: np.ndarray, mask: np.ndarray | None, saved: list) -> tuple[np.ndarray, np.ndarray]:
    steps, n, size = dh_all.shape
    dx = np.empty((steps, n, 3 * size), dh_all.dtype)
    du = np.zeros_like(u)
    carry = np.zeros((n, size), dh_all.dtype)
    for t in range(steps - 1, -1, -1):
        h, z, r, c, hn = saved[t]
        d = dh_all[t] + carry
        on = d if mask is None else np.where(mask[t][:, None], d, 0)
        dc = on * (1 - z) * (1 - c * c)
        g = np.concatenate([on * (h - c) * z * (1 - z), dc * hn * r * (1 - r), dc], 1)
        dx[t] = g
        inner = np.concatenate([g[:, : 2 * size], dc * r], 1)
        du += h.T @ inner
        carry = on * z + inner @ u.T
        if mask is not None:
            carry += np.where(mask[t][:, None], 0, d)
    return dx, du


def _logits(p: dict, x: np.ndarray, mask: np.ndarray | None, keep: bool = False):
    """Of windows (time, window, input): their logits; with keep also what the way back needs. Without keep, x is what inputs add to the gates."""
    steps = len(x)
    gf, gb = (x @ p["wf"] + p["bf"], (x @ p["wb"] + p["bb"])[::-1]) if keep else (x[:, :, : 3 * HIDDEN], x[::-1, :, 3 * HIDDEN :])
    back_mask = None if mask is None else mask[::-1]
    hf, sf = _pass(gf, p["uf"], mask, keep)
    hb, sb = _pass(gb, p["ub"], back_mask, keep)
    h = np.concatenate([hf, hb[::-1]], 2)
    a = np.tanh(h @ p["wa"] + p["ba"])
    s = a @ p["va"]
    if mask is not None:
        s = np.where(mask, s, -1e9)
    s = np.exp(s - s.max(0))
    alpha = s / s.sum(0)
    pooled = (alpha[:, :, None] * h).sum(0)
    out = pooled @ p["wo"] + p["bo"][0]
    return (out, (x, h, a, alpha, pooled, sf, sb, mask, back_mask, steps)) if keep else out


def _gradients(p: dict, dout: np.ndarray, state) -> tuple[dict, np.ndarray]:
    x, h, a, alpha, pooled, sf, sb, mask, back_mask, _ = state
    g = {"wo": pooled.T @ dout, "bo": np.array([dout.sum()])}
    dpooled = dout[:, None] * p["wo"]
    dh = alpha[:, :, None] * dpooled
    dalpha = (h * dpooled).sum(2)
    ds = alpha * (dalpha - (alpha * dalpha).sum(0))
    g["va"] = np.einsum("tn,tna->a", ds, a)
    da = ds[:, :, None] * p["va"] * (1 - a * a)
    flat = lambda y: y.reshape(-1, y.shape[-1])
    g["wa"], g["ba"] = flat(h).T @ flat(da), flat(da).sum(0)
    dh = dh + da @ p["wa"].T
    df, g["uf"] = _back(np.ascontiguousarray(dh[:, :, :HIDDEN]), p["uf"], mask, sf)
    db, g["ub"] = _back(np.ascontiguousarray(dh[::-1, :, HIDDEN:]), p["ub"], back_mask, sb)
    db = db[::-1]
    g["wf"], g["bf"] = flat(x).T @ flat(df), flat(df).sum(0)
    g["wb"], g["bb"] = flat(x).T @ flat(db), flat(db).sum(0)
    return g, df @ p["wf"].T + db @ p["wb"].T


def _starts(n: int) -> list[int]:
    """Where the windows of a text of n words begin: the last ends with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


class Texts:
    """Training texts as places in a table of their different words."""

    def __init__(self, texts: list[str]):
        column = pa.array([t or "" for t in texts], pa.string())
        words: dict[int, int] = {}
        names: list[bytes] = []
        self.rows: list[np.ndarray] = []
        for a, b, data, offsets in ragged.slices(column):
            data, s, e, h = _words(data, offsets)
            u, at, back = np.unique(h, return_index=True, return_inverse=True)
            raw = data.tobytes()
            place = np.empty(len(u), np.int64)
            for i, (x, j) in enumerate(zip(u.tolist(), at.tolist(), strict=True)):
                if x not in words:
                    words[x] = len(names)
                    names.append(raw[s[j] : e[j]])
                place[i] = words[x]
            counts = np.bincount(ragged.row_of(s, offsets), minlength=b - a) if len(s) else np.zeros(b - a, np.int64)
            self.rows += np.split(place[back], np.cumsum(counts)[:-1])
        self.names, self.hashes = names, np.array(list(words), np.uint64)


def _odds(keys: Iterator[np.ndarray], toxic: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each key 0..size-1: in how many texts it is, and the log-odds of a text with it being toxic (little for few texts).

    The log-odds come three times: without one clean text that has the key, without one toxic text that has it, and of all texts.
    What a training text is given leaves that text's own label out, or the network would learn to trust its own answers.
    """
    n = np.zeros((2, size))
    for k, y in zip(keys, toxic, strict=True):
        n[int(y), np.unique(k)] += 1
    texts = np.bincount(toxic.astype(int), minlength=2).astype(float)

    def odds(less: tuple[int, int]) -> np.ndarray:
        left = [np.maximum(n[y] - less[y], 0) for y in (0, 1)]
        share = [(left[y] + 0.5) / (texts[y] - less[y] + 1) for y in (0, 1)]
        total = left[0] + left[1]
        return (np.log(share[1]) - np.log(share[0])) * total / (total + 3)

    return n.sum(0), np.stack([odds((1, 0)), odds((0, 1)), odds((0, 0))])


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """A model of labelled texts (1: toxic). Without texts of both labels, every score is the share of toxic ones."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, bool)
    share = float(y.mean()) if len(y) else 0.0
    none = np.zeros(0, np.uint64)
    if y.all() or not y.any():
        return Model(none, none, np.zeros(1), np.zeros(1), {}, (0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6)))), share)
    data = Texts(texts)
    held = rng.random(len(y)) < 0.2  # for calibration
    fit = np.flatnonzero(~held)
    n_word, word_odds = _odds((data.rows[i] for i in fit), y[fit], len(data.names))
    keep_word = np.flatnonzero(n_word >= LEAST_TEXTS)
    keep_word = keep_word[np.argsort(data.hashes[keep_word])]
    known, known_odds = [], []
    for n in SIZES:  # one length at a time, to bound memory
        codes, count = _grams(data.names, (n,))
        heads = np.cumsum(count) - count
        names, of = np.unique(codes, return_inverse=True)
        of = of.astype(np.int32)
        del codes
        n_gram, gram_odds = _odds((of[ragged.expand(heads[u], count[u])] for u in (np.unique(data.rows[i]) for i in fit)), y[fit], len(names))
        often = n_gram >= LEAST_TEXTS
        known.append(names[often])
        known_odds.append(gram_odds[:, often])
        del names, of
    known, known_odds = np.concatenate(known), np.concatenate(known_odds, 1)
    best = np.argsort(-np.abs(known_odds[2]), kind="stable")[:MOST_GRAMS]
    best = best[np.argsort(known[best])]
    known, known_odds = known[best], np.pad(known_odds[:, best], ((0, 0), (1, 0)))
    word_odds = np.pad(word_odds[:, keep_word], ((0, 0), (1, 0)))
    wide = 2 * VECTOR + 2 * SPELL + 2
    letters = Letters(data.names)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"word": rng.normal(0, 0.1, (len(keep_word) + 1, VECTOR)), "gram": rng.normal(0, 0.1, (len(known) + 1, VECTOR))}
    p |= {"wf": draw(wide, 3 * HIDDEN), "uf": draw(HIDDEN, 3 * HIDDEN), "bf": np.zeros(3 * HIDDEN), "wb": draw(wide, 3 * HIDDEN), "ub": draw(HIDDEN, 3 * HIDDEN), "bb": np.zeros(3 * HIDDEN)}
    for k in ("wf", "wb"):  # words and n-grams speak first
        p[k][2 * VECTOR : 2 * VECTOR + 2 * SPELL] *= 0.1
    p |= {"wa": draw(2 * HIDDEN, ATTEND), "ba": np.zeros(ATTEND), "va": draw(ATTEND), "wo": draw(2 * HIDDEN), "bo": np.zeros(1)}
    p |= {"byte": rng.normal(0, 0.5, (256, BYTE)), "cbf": np.zeros(3 * SPELL), "cbb": np.zeros(3 * SPELL)}
    p |= {"cwf": draw(BYTE, 3 * SPELL), "cuf": draw(SPELL, 3 * SPELL), "cwb": draw(BYTE, 3 * SPELL), "cub": draw(SPELL, 3 * SPELL)}
    p["word"][0] = p["gram"][0] = 0
    model = Model(data.hashes[keep_word], known, word_odds[2], known_odds[2], p, (1.0, 0.0), share)
    word = _find(model.words, data.hashes)
    gram, count = _all_grams(data.names, lambda codes: _find(model.grams, codes).astype(np.int32))
    heads = np.cumsum(count) - count
    odds, top = (np.stack(x) for x in zip(*(_fixed(word_odds[y], known_odds[y], word, gram, count) for y in (0, 1, 2)), strict=True))
    strength = np.maximum(odds[2], top[2])

    windows = [(i, s) for i in range(len(y)) if len(data.rows[i]) for s in _starts(len(data.rows[i]))]
    owner = np.array([i for i, _ in windows])
    begin = np.array([s for _, s in windows])
    size = np.array([len(r) for r in data.rows])[owner]
    pad = len(data.names)  # a place past the table: no word
    place = np.full((len(windows), WINDOW), pad, np.int64)
    for j, (i, s) in enumerate(windows):
        got = data.rows[i][s : s + WINDOW]
        place[j, : len(got)] = got
    rank = np.append(strength, -9.0)[place].max(1)  # before the network knows: the strongest word
    moment: dict[str, tuple[np.ndarray, np.ndarray]] = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    mean = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    epoch = -1
    while (epoch := epoch + 1) < EPOCHS or step < STEPS:
        if epoch:
            rank = _scored(model, data, place, size)
        order = np.lexsort((-rank, owner))
        first = np.append(True, owner[order][1:] != owner[order][:-1])
        nth = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        best = order[(nth < np.where(y[owner[order]], 1 if epoch == 0 else 2, 1)) & ~held[owner[order]]]
        clean = np.flatnonzero(~y[owner] & ~held[owner])
        some = rng.choice(clean, min(len(clean), len(fit)), replace=False)
        chosen = np.unique(np.concatenate([best, some]))
        rng.shuffle(chosen)
        weight = np.where(y[owner], 0.5 / max(1, y[owner[chosen]].sum()), 0.5 / max(1, (~y[owner[chosen]]).sum())) * len(chosen)
        for at in range(0, len(chosen), 128):
            step += 1
            j = chosen[at : at + 128]
            # a word of a toxic and of a clean text are told apart: their log-odds leave out another text
            used, back = np.unique(np.where(place[j] < pad, place[j] + y[owner[j], None] * pad, 2 * pad), return_inverse=True)
            used = used[used < 2 * pad]
            label, used = used // pad, used % pad
            dropped = rng.random(len(used)) < 0.1  # single words must not decide all
            w = np.where(dropped, 0, word[used])
            pairs, c = ragged.expand(heads[used], count[used]), count[used]
            parts = letters.count[used]
            wins = ragged.expand(letters.head[used], parts)
            states, reading = np.zeros((len(wins), 2 * SPELL)), []
            for rows in _alike(letters.length, wins):
                states[rows], read = _read(p, letters, wins[rows], keep=True)
                reading.append((rows, read))
            spelt = np.add.reduceat(states, np.cumsum(parts) - parts, axis=0) / parts[:, None]
            vectors = np.column_stack([p["word"][w], _mean(p["gram"][gram[pairs]], c), spelt, np.where(dropped, 0, odds[label, used]) / 4, top[label, used] / 4])
            x = np.concatenate([vectors, np.zeros((1, wide))])[back.reshape(len(j), WINDOW).T]
            mask = (place[j] < pad).T
            out, state = _logits(p, x, None if mask.all() else mask, keep=True)
            target = y[owner[j]]
            g, dx = _gradients(p, (_sigmoid(out) - target) * weight[j] / len(j), state)
            dv = _summed(back.reshape(len(j), WINDOW).T.ravel(), dx.reshape(-1, wide), len(used) + 1)[:-1]
            gw = _summed(w, dv[:, :VECTOR], len(p["word"]))
            gg = _summed(gram[pairs], np.repeat(dv[:, VECTOR : 2 * VECTOR] / np.maximum(c, 1)[:, None], c, axis=0), len(p["gram"]))
            gw[0] = gg[0] = 0
            ds = np.repeat(dv[:, 2 * VECTOR : 2 * VECTOR + 2 * SPELL] / parts[:, None], parts, axis=0)
            for rows, read in reading:
                for k, d in _unread(p, ds[rows], read).items():
                    g[k] = g[k] + d if k in g else d
            for k, d in (g | {"word": gw, "gram": gg}).items():
                m, v = moment[k]
                m *= 0.9
                m += 0.1 * d
                v *= 0.99
                v += 0.01 * d * d
                p[k] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            for k, v in p.items():  # the mean of late steps wavers less than the last one
                mean[k] += (v - mean[k]) * max(1 / step, 0.03)
    p.update({k: v.astype(np.float32) for k, v in mean.items()})
    high = np.full(len(y), -9.0)
    np.maximum.at(high, owner, _scored(model, data, place, size))
    model.scale = _calibrate(high[held], y[held]) if 0 < y[held].sum() < held.sum() else (1.0, -1.0)
    return model


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid a * x + b, a of 0.5 or more, with his targets, both labels weighing alike."""
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    a, b = 1.0, 0.0
    for _ in range(3000):
        d = (_sigmoid(a * x + b) - target) * weight
        a, b = max(0.5, a - 0.2 * float((d * x).sum())), b - 0.2 * float(d.sum())
    return a, b


def _scored(model: Model, data: Texts, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    table = np.zeros((len(data.names) + 1, 6 * HIDDEN), np.float32)  # filled in place, to bound memory
    for i in range(0, len(data.names), CHUNK):
        table[i : min(i + CHUNK, len(data.names))] = model.gates(model.inputs(data.hashes[i : i + CHUNK], data.names[i : i + CHUNK]))
    return window_logits(model, table, place, size >= WINDOW)


def window_logits(model: Model, table: np.ndarray, place: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Logits of windows of places in a table of gates, whose last place is no word; full: has no such place."""
    p = {k: v.astype(np.float32) for k, v in model.p.items() if k not in ("word", "gram")}
    out = np.zeros(len(place))
    pad = len(table) - 1
    for which in (True, False):
        at = np.flatnonzero(full == which)
        for i in range(0, len(at), 768):
            j = at[i : i + 768]
            x = table[place[j].T]
            out[j] = _logits(p, x, None if which else (place[j] != pad).T)
    return out


class Scorer:
    """Scores of texts with the inputs of words remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.table = np.zeros((1 << 16, 2 * VECTOR + 2 * SPELL + 2), np.float32)

    def places(self, hashes: np.ndarray, words: list[bytes]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.forget()
        keys = hashes.tolist()
        fresh = [i for i, k in enumerate(keys) if k not in self.known]
        if fresh:
            a = len(self.known)
            while a + len(fresh) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[a : a + len(fresh)] = self.model.inputs(hashes[fresh], [words[i] for i in fresh])
            self.known.update((keys[i], a + n) for n, i in enumerate(fresh))
        return np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))

    def column(self, column: pa.Array) -> np.ndarray:
        model = self.model
        out = np.full(len(column), model.none)
        if not model.p:
            return out
        for a, b, data, offsets in ragged.slices(column):
            data, s, e, h = _words(data, offsets)
            if not len(s):
                continue
            u, at, back = np.unique(h, return_index=True, return_inverse=True)
            raw = data.tobytes()
            found = self.places(u, [raw[x:y] for x, y in zip(s[at].tolist(), e[at].tolist(), strict=True)])
            table = np.concatenate([model.gates(self.table[found]), np.zeros((1, 6 * HIDDEN), np.float32)])
            back = np.append(back, len(u))
            sizes = np.bincount(ragged.row_of(s, offsets), minlength=b - a)
            heads = np.cumsum(sizes) - sizes
            begin, owner = [], []
            for i in np.flatnonzero(sizes).tolist():
                starts = _starts(int(sizes[i]))
                begin += [int(heads[i]) + x for x in starts]
                owner += [i] * len(starts)
            begin, owner = np.array(begin), np.array(owner)
            high = np.full(b - a, -np.inf)
            for i in range(0, len(begin), 3072):
                w = begin[i : i + 3072, None] + np.arange(WINDOW)
                end = (heads + sizes)[owner[i : i + 3072], None]
                place = back[np.where(w < end, w, len(back) - 1)]
                np.maximum.at(high, owner[i : i + 3072], window_logits(model, table, place, (w[:, -1:] < end)[:, 0]))
            some = sizes > 0
            out[a:b][some] = _sigmoid(model.scale[0] * high[some] + model.scale[1])
        return out


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Model:
    """A model of labelled documents: at most MOST_TOXIC rows of label 1 and MOST_CLEAN of 0, the first by a hash of their id.

    Of these, texts that would bring the sample beyond MOST_BYTES are left out (none is shortened). One task trains, so that
    neither texts nor what training holds pass through the driver; only the model comes back.
    Rows without a label, an id or a document are left out. Repeated labels, and rows that repeat an id and its text, are taken once.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)").distinct()
    pick = lambda y, most: known.where(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
    sample = pick(1, MOST_TOXIC).unionByName(pick(0, MOST_CLEAN))
    # bounded by the two limits above
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
    rows = rows.select(F.xxhash64("_id").alias("_rank"), F.col("_id").cast("string").alias("_id"), F.coalesce("_text", F.lit("")).alias("_text"), "_label")

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks, size, last = [], [], 0, None
        for batch in batches:
            for key, content, mark in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                fresh, last = (key, content, mark) != last, (key, content, mark)
                if fresh and size + len(content) <= MOST_BYTES:
                    size += len(content)
                    texts.append(content)
                    marks.append(mark)
        data = pickle.dumps(train(texts, marks))
        parts = [data[i : i + PART] for i in range(0, len(data), PART)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["part", "model"])

    arrow_batches(docs.sparkSession)
    one = rows.repartition(1).sortWithinPartitions("_rank", "_id", "_text", "_label").mapInArrow(trained, "part int, model binary")
    parts = sorted((r["part"], bytes(r["model"])) for r in one.collect())  # a model is of bounded size
    return pickle.loads(b"".join(p for _, p in parts)) if parts else train([], [])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) of every whole text.

    Null and empty texts, and those without words: the share of label 1 in training. Repeated rows score alike. A column
    named score is replaced. An empty table gives an empty result.
    """
    arrow_batches(docs.sparkSession)
    base = without(docs, "score")
    schema = T.StructType([*base.schema, T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            got = scorer.column(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], [*batch.schema.names, "score"])

    return base.mapInArrow(scored, schema)
