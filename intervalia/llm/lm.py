"""Language-model scoring: a causal self-attention model on subword ids, trained in numpy, beside and mixed with word counts of all training documents.

Tokens of the base are the words of a text (A-Z lower-cased, split at ASCII white space) and one end. The base counts tokens over all training documents: workers send (word,
occurrences), summed by word into a written table. The words of the largest counts, HOT at most, go to the workers; all others meet the table in a join, so the vocabulary, which
grows with the corpus, is never sent to the driver or to every worker, and words in every document send no rows. Which side a word is on changes no result.

The model reads subword ids of the same words: byte-level BPE by the first PIECES ranks of a public rank file, each word after a space, then the end. It has one head of causal
attention over windows of WINDOW positions, a hidden layer, and an output in two steps, group and member. Windows overlap by OVERLAP positions; each
id is scored once, with at least that many before it where the text has them. It learns on the executors from every id of every training document, nothing is drawn: a text's windows follow each
other, so each id is a target once, after what its window holds of the text before it. Three rounds take the documents by a hash of their id, a 64th, seven and the other 56; in a round each task goes on from the
same weights through the windows of its documents, in random order within a lot of texts, and the tasks' changes are averaged by their number of windows. A small corpus is read several times. The weights depend on how rows lie
in partitions, as the order of reading does. So what the model learns from, like the counts, is the whole corpus.

A token's probability mixes both: KEEP * (1 - n1 / N) of the share c / N of its count, the rest of the model's probability of its ids. n1 is the number of words that training
documents hold once, n1 / N the chance of a new word (Good-Turing). The score is the sum of log10 probabilities of a text's tokens.

Defined cases: null text is an empty text: its only token is the end; without training documents counts are zero and the model is left as it starts, near
uniform; a null id is not held out and not trained on; repeated rows are scored and counted as often as they stand; a text of any length is scored whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import parse_ranks, rank_file
from .common import bucket, checkpointed, parts

PIECES = 4095
GROUP = 64
WIDTH = 32
HIDDEN = 32
WINDOW = 16
OVERLAP = WINDOW // 2
#: Rounds of learning: each over the documents whose hash, modulo PARTS, is below its first number and not below the one before; its batch of windows; its rate.
PARTS = 64
ROUNDS = ((1, 128, 16e-3), (8, 256, 12e-3), (64, 1024, 8e-3))
#: Fewer tokens than so many steps of so many windows take are read again until they make as many; so many times at most as there are steps.
STEPS, BATCH = 900, 128
#: Bytes of the texts that a worker learns from at once.
LEARNT_BYTES = 6_000_000
#: Tasks' changes are summed in so many groups, then on the driver.
GROUPS = 16
KEEP = 0.5
#: Words whose counts go to the workers, and their bytes; documents that a worker counts at once.
HOT, HOT_LENGTH = 500_000, 64
COUNTED_DOCUMENTS, COUNTED_BYTES = 16384, 24_000_000
BLOCK_DOCUMENTS = 4096
BLOCK_BYTES = 12_000_000
#: Words whose windows are in memory at once.
SCORED_WORDS = 200_000
COUNT_BITS = 19
END = PIECES


class Pieces:
    """Subword ids of words, by the first ranks of a rank file."""

    def __init__(self, raw: bytes, pieces: int = PIECES):
        import tiktoken

        ranks = {t: r for t, r in parse_ranks(raw).items() if r < pieces}
        self.encoding = tiktoken.Encoding("pieces", pat_str=" [^ ]+", mergeable_ranks=ranks, special_tokens={})
        # Pieces in the order of their bytes; neighbours share a group of the output.
        order = sorted(ranks)
        self.place = np.zeros(pieces + 1, np.int16)
        self.starts = np.zeros(pieces + 1, bool)
        for k, t in enumerate(order):
            self.place[ranks[t]] = k
            self.starts[ranks[t]] = t[:1] == b" "
        self.place[pieces] = pieces

    def ids(self, words: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pieces of the words, each after a space, joined; the number of each word's pieces. Broken UTF-8 is read as U+FFFD."""
        words = pa.array(words, pa.binary()) if isinstance(words, list) else words
        places, sizes = [np.zeros(0, np.int16)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 8192):
            some = words.slice(at, 8192)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), b" ")
            found = np.array(self.encoding.encode_ordinary(" " + joined[0].as_py().decode("utf-8", "replace")), np.int64)
            # Words hold no space, so a piece that begins with one begins a word.
            first = np.flatnonzero(self.starts[found])
            places.append(self.place[found])
            sizes.append(np.diff(np.append(first, len(found))))
        return np.concatenate(places), np.concatenate(sizes)


def started(seed: int = 4) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    groups, d = (PIECES + 1) // GROUP, WIDTH
    draw = lambda *shape: (r.normal(size=shape) / np.sqrt(shape[-2])).astype(np.float32)
    return {
        "E": (r.normal(size=(PIECES + 1, d)) * 0.3).astype(np.float32),
        "P": (r.normal(size=(WINDOW, d)) * 0.1).astype(np.float32),
        "Q": draw(d, d), "K": draw(d, d), "V": draw(d, d), "O": draw(d, d) * 0.5,
        "A": draw(d, HIDDEN), "a": np.zeros(HIDDEN, np.float32), "B": draw(HIDDEN, d) * 0.5,
        "G": draw(d, groups) * 0.1, "g": np.zeros(groups, np.float32),
        "M": draw(groups, d, GROUP) * 0.1, "m": np.zeros((groups, GROUP), np.float32),
    }


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    x /= x.sum(axis=-1, keepdims=True)
    return x


MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)


def hidden(w: dict[str, np.ndarray], context: np.ndarray, start: int = 0) -> tuple[np.ndarray, ...]:
    """States of the positions from start on, and what the gradient needs."""
    x = w["E"][context] + w["P"]
    q, k, v = x[:, start:] @ w["Q"], x @ w["K"], x @ w["V"]
    s = q @ k.transpose(0, 2, 1)
    s *= np.float32(WIDTH**-0.5)
    s += MASK[start:]
    att = softmax(s)
    c = att @ v
    h = x[:, start:] + c @ w["O"]
    r = np.maximum(h @ w["A"] + w["a"], 0)
    return h + r @ w["B"], x, q, k, v, att, c, h, r


def log_probabilities(w: dict[str, np.ndarray], states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """log10 probability of each target after its state, both flat. Targets are sorted by group, so that each group is one product."""
    group = (targets // GROUP).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(w["g"])))])
    states, group, member = states[order], group[order], (targets % GROUP)[order]
    rows = np.arange(len(order))
    out = np.empty(len(order), np.float64)
    for a in range(0, len(order), 2048):
        b = min(a + 2048, len(order))
        logits = states[a:b] @ w["G"] + w["g"]
        out[a:b] = logits[rows[: b - a], group[a:b]] - log_sum(logits)
    for c in np.flatnonzero(np.diff(ends)):
        a, b = ends[c], ends[c + 1]
        logits = states[a:b] @ w["M"][c] + w["m"][c]
        out[a:b] += logits[rows[: b - a], member[a:b]] - log_sum(logits)
    back = np.empty(len(order))
    back[order] = out
    return back / np.log(10)


def log_sum(logits: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials of each row; if a sum leaves the range of its type, rows are shifted first."""
    ones = np.ones(logits.shape[1], logits.dtype)
    with np.errstate(over="ignore"):
        total = np.exp(logits) @ ones
    if len(total) and not (total.min() > 1e-30 and total.max() < 1e37):
        top = logits.max(axis=1)
        return np.log(np.exp(logits - top[:, None]) @ ones) + top
    return np.log(total)


class Room:
    """Arrays that are used again: memory that is given back and asked for anew costs page faults."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, kind: np.dtype, *shape: int) -> np.ndarray:
        size, x = math.prod(shape), self.held.get(name)
        if x is None or len(x) < size or x.dtype != kind:
            x = self.held[name] = np.empty(size, kind)
        return x[:size].reshape(shape)


def row_sums(logits: np.ndarray) -> np.ndarray | None:
    """The logits become their exponentials; the sum of each row, or none if a sum leaves the range of its type: then rows have to be shifted first."""
    with np.errstate(over="ignore"):
        total = np.exp(logits, out=logits) @ np.ones(logits.shape[1], logits.dtype)
    return total if total.min() > 1e-30 and total.max() < 1e37 else None


def shares_left(states: np.ndarray, weights: np.ndarray, at: np.ndarray, weight: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Of each row of states @ weights: its weight times the shares of the exponentials, less the weight at `at`. In room."""
    p = room[: len(states) * weights.shape[1]].reshape(len(states), -1)
    total = row_sums(np.matmul(states, weights, out=p))
    if total is None:
        np.matmul(states, weights, out=p)
        p -= p.max(axis=1, keepdims=True)
        total = row_sums(p)
    p *= (weight / total)[:, None]
    p.reshape(-1)[np.arange(0, p.size, p.shape[1]) + at] -= weight
    return p


def gradient(w: dict[str, np.ndarray], context: np.ndarray, targets: np.ndarray, weight: np.ndarray, some: int = 64, several: int = 1024, room: Room | None = None) -> dict[str, np.ndarray]:
    """Of the mean negative log likelihood of the weighted positions. Windows and positions are taken in lots that stay in cache; which changes no result."""
    n, d, kind, room = targets.size, WIDTH, w["E"].dtype, room or Room()
    scale, mask, ones, wide = kind.type(d**-0.5), MASK.astype(kind), np.ones(WINDOW, kind), np.ones(d, kind)
    inner = np.concatenate([w["Q"] * scale, w["K"], w["V"]], axis=1)
    three = lambda y: (y[..., :d], y[..., d : 2 * d], y[..., 2 * d :])
    out = {k: np.zeros_like(w[k]) for k in "EPOB"}
    # A bias is one more row of its product.
    groups, members, first = (np.concatenate([w[k], w[k.lower()][..., None, :]], axis=-2) for k in "GMA")
    of_first, of_inner = np.zeros_like(first), np.zeros_like(inner)
    every = {"x": d, "y": 3 * d, "att": WINDOW, "c": d, "h": d + 1, "r": HIDDEN, "states": d + 1, "sorted": d + 1, "ds": d, "sorted_ds": d}
    every = {k: room(k, kind, n, m) for k, m in every.items()}
    every["h"][:, d] = every["states"][:, d] = 1
    few = [room(f"few{k}", kind, some * WINDOW, m) for k, m in enumerate((d, HIDDEN, d, d, 3 * d, WINDOW, d))]
    keys = lambda x: x.reshape(-1, WINDOW, x.shape[1])
    lots = [(slice(a * WINDOW, min(a + some, len(context)) * WINDOW), context[a : a + some]) for a in range(0, len(context), some)]
    for here, ids in lots:
        x, y, att, c, h, r, last = (every[k][here] for k in ("x", "y", "att", "c", "h", "r", "states"))
        add = few[0][: len(x)]
        np.take(w["E"], ids, axis=0, mode="clip", out=keys(x))
        keys(x)[...] += w["P"]
        np.matmul(x, inner, out=y)
        q, k, v = three(keys(y))
        z = keys(att)
        np.matmul(q, k.transpose(0, 2, 1), out=z)
        z += mask
        if float(z.max()) > 60 or float(z[:, :, 0].min()) < -60:
            z -= z.max(axis=-1, keepdims=True)
        np.exp(att, out=att)
        att *= (1 / (att @ ones))[:, None]
        np.matmul(z, v, out=keys(c))
        np.add(np.matmul(c, w["O"], out=add), x, out=h[:, :d])
        np.matmul(h, first, out=r)
        np.maximum(r, 0, out=r)
        np.add(np.matmul(r, w["B"], out=add), h[:, :d], out=last[:, :d])

    # The output, sorted by group: each group's members are one product.
    flat = targets.ravel()
    group = (flat // GROUP).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(w["g"])))]).tolist()
    states, group, member = np.take(every["states"], order, axis=0, mode="clip", out=every["sorted"]), group[order], (flat % GROUP)[order]
    share = (weight.ravel() / max(1.0, weight.sum())).astype(kind)[order]
    of_groups, of_members, sorted_ds = np.zeros_like(groups), np.zeros_like(members), every["sorted_ds"]
    logits, add = room("logits", kind, several * max(GROUP, len(w["g"]))), room("add", kind, several, d)
    back = np.ascontiguousarray(w["G"].T)
    for a in range(0, n, several):
        b = min(a + several, n)
        p = shares_left(states[a:b], groups, group[a:b], share[a:b], logits)
        of_groups += states[a:b].T @ p
        np.matmul(p, back, out=sorted_ds[a:b])
    for g in range(len(w["g"])):
        for a in range(ends[g], ends[g + 1], several):
            b = min(a + several, ends[g + 1])
            p = shares_left(states[a:b], members[g], member[a:b], share[a:b], logits)
            of_members[g] += states[a:b].T @ p
            sorted_ds[a:b] += np.matmul(p, w["M"][g].T, out=add[: b - a])
    place = np.empty_like(order)
    place[order] = np.arange(n)
    every_ds, every_dx, back = np.take(sorted_ds, place, axis=0, mode="clip", out=every["ds"]), sorted_ds, np.ascontiguousarray(inner.T)

    for here, _ in lots:
        x, y, att, c, h, r, ds, dx = (every[k][here] for k in ("x", "y", "att", "c", "h", "r", "ds", "sorted_ds"))
        _, dr, dh, dc, dy, dz, room_c = (f[: len(x)] for f in few)
        np.matmul(ds, w["B"].T, out=dr)
        dr *= r > 0
        out["B"] += r.T @ ds
        of_first += h.T @ dr
        np.matmul(dr, w["A"].T, out=dh)
        dh += ds
        out["O"] += c.T @ dh
        np.matmul(dh, w["O"].T, out=dc)
        q, k, v = three(keys(y))
        np.matmul(keys(dc), v.transpose(0, 2, 1), out=keys(dz))
        # The sum over the keys of share and change is the product of c and its change.
        dz -= (np.multiply(dc, c, out=room_c) @ wide)[:, None]
        dz *= att
        dq, dk, dv = three(keys(dy))
        np.matmul(keys(dz), k, out=dq)
        np.matmul(keys(dz).transpose(0, 2, 1), q, out=dk)
        np.matmul(keys(att).transpose(0, 2, 1), keys(dc), out=dv)
        of_inner += x.T @ dy
        np.matmul(dy, back, out=dx)
        dx += dh
    dq, dk, dv = three(of_inner)
    out |= {"Q": dq * scale, "K": dk, "V": dv, "A": of_first[:d], "a": of_first[d]}
    out |= {"G": of_groups[:d], "g": of_groups[d], "M": of_members[:, :d], "m": of_members[:, d]}
    out["P"] += every_dx.reshape(-1, WINDOW * d).sum(0).reshape(WINDOW, d)
    ids = context.ravel().astype(np.int16)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    out["E"][ids[start]] = np.add.reduceat(np.take(every_dx, order, axis=0, mode="clip", out=every["ds"]), start, axis=0)
    return out


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sequences of so many targets: the first window of each, and the later ones, as (sequence, first position)."""
    step = WINDOW - OVERLAP
    later = np.maximum(0, -(-(lengths - WINDOW) // step))
    seq = np.repeat(np.arange(len(lengths)), later)
    nth = np.arange(len(seq)) - np.repeat(np.cumsum(later) - later, later)
    return seq, (nth + 1) * step


class Adam:
    def __init__(self, w: dict[str, np.ndarray]):
        self.w, self.step = w, 0
        self.first, self.second, self.room = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(3))

    def down(self, grad: dict[str, np.ndarray], rate: float) -> None:
        """The gradient's arrays are used up."""
        self.step += 1
        # The square of 0.1 g is 0.01 g * g; the correction of the second moment is taken out of the root.
        root = math.sqrt(1 / (1 - 0.99**self.step))
        rate, least = rate / (1 - 0.9**self.step) / root, 1e-8 / root
        for k, g in grad.items():
            m, v, room = self.first[k], self.second[k], self.room[k]
            g *= 0.1
            m *= 0.9
            m += g
            g *= g
            v *= 0.99
            v += g
            np.sqrt(v, out=room)
            room += least
            np.divide(m, room, out=room)
            room *= rate
            self.w[k] -= room


class Windows:
    """The ids of binary texts, each with its end and after one, and windows of them: every id is the target of one window."""

    def __init__(self, pieces: Pieces, texts: pa.Array):
        index, lengths, names = numbered(texts)
        places, sizes = pieces.ids(names)
        first, sizes = np.append(np.cumsum(sizes) - sizes, len(places)), np.append(sizes, 1)
        # The end has the last number.
        words, last = np.full(len(index) + len(lengths), len(names)), np.cumsum(lengths + 1) - 1
        inner = np.ones(len(words), bool)
        inner[last] = False
        words[inner] = index
        ids = spelled(np.append(places, np.int16(END)), sizes, first, words)
        self.joined = np.concatenate([[END], ids, np.full(WINDOW, END)]).astype(np.int16)
        stops = np.cumsum(sizes[words])[last]
        base = np.append(0, stops[:-1])
        each = -(-(stops - base) // WINDOW)
        self.stop = np.repeat(stops, each)
        self.start = np.repeat(base - WINDOW * (np.cumsum(each) - each), each) + WINDOW * np.arange(len(self.stop))

    def __len__(self) -> int:
        return len(self.start)

    def take(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts, targets and weights of these windows; positions behind a text's end weigh nothing."""
        at = self.start[some][:, None] + np.arange(WINDOW + 1)
        found = self.joined[at]
        return found[:, :-1], found[:, 1:], (at[:, :-1] < self.stop[some][:, None]).astype(np.float32)


class Scorer:
    """The model with its input products looked up: each is a row for the id plus a row for the position. Batches are small, so that they stay in cache, and their memory is used again."""

    def __init__(self, w: dict[str, np.ndarray], batch: int = 128, several: int = 64):
        self.w, self.batch, self.several = w, batch, several
        scaled = w["Q"] * np.float32(WIDTH**-0.5)
        one = np.concatenate([np.eye(WIDTH, dtype=np.float32), scaled, w["K"], w["V"]], axis=1)
        ids, places = w["E"] @ one, w["P"] @ one
        cut = 2 * WIDTH
        self.own, self.seen = (np.ascontiguousarray(ids[:, :cut]), places[:, :cut]), (np.ascontiguousarray(ids[:, cut:]), places[:, cut:])
        self.ones = np.ones(max(WINDOW, GROUP), np.float32)
        # A bias is one more row of its product.
        self.groups = np.concatenate([w["G"], w["g"][None]])
        self.members = np.concatenate([w["M"], w["m"][:, None]], axis=1)
        empty = lambda *shape: np.empty(shape, np.float32)
        self.own_room, self.seen_room, self.att, self.sums = empty(batch, WINDOW, cut), empty(batch, WINDOW, cut), empty(batch, WINDOW, WINDOW), empty(batch, WINDOW, WIDTH)
        self.inner, self.added = empty(batch * WINDOW, HIDDEN), empty(batch * WINDOW, WIDTH)
        self.logits = empty(4096, max(GROUP, len(w["g"])))

    def states(self, context: np.ndarray, start: int, out: np.ndarray) -> None:
        """The same as hidden(), flat, into out."""
        d, n, q = WIDTH, WINDOW - start, len(context)
        own, seen = self.own_room.reshape(-1)[: q * n * 2 * d].reshape(q, n, 2 * d), self.seen_room[:q]
        np.take(self.own[0], context[:, start:], axis=0, out=own, mode="clip")
        own += self.own[1][start:]
        np.take(self.seen[0], context, axis=0, out=seen, mode="clip")
        seen += self.seen[1]
        att, c = self.att.reshape(-1)[: q * n * WINDOW].reshape(q, n, WINDOW), self.sums.reshape(-1)[: q * n * d].reshape(q, n, d)
        np.matmul(own[..., d:], seen[..., :d].transpose(0, 2, 1), out=att)
        att += MASK[start:]
        # Shifting by the largest changes no share; it is done only where a row could leave the range of its type.
        if float(att.max()) > 60 or float(att[:, :, 0].min()) < -60:
            att -= att.max(axis=-1, keepdims=True)
        np.exp(att, out=att)
        total = att.reshape(-1, WINDOW) @ self.ones[:WINDOW]
        np.matmul(att, seen[..., d:], out=c)
        c = c.reshape(-1, d)
        c /= total[:, None]
        r, more = self.inner[: q * n], self.added[: q * n]
        np.matmul(c, self.w["O"], out=out)
        out.reshape(q, n, d)[...] += own[..., :d]
        np.matmul(out, self.w["A"], out=r)
        r += self.w["a"]
        np.maximum(r, 0, out=r)
        out += np.matmul(r, self.w["B"], out=more)

    def share(self, states: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural logarithm of the share of the one at `at` of each row's exponentials."""
        out = np.empty(len(states), np.float32)
        for a in range(0, len(states), len(self.logits)):
            b = min(a + len(self.logits), len(states))
            logits = self.logits.reshape(-1)[: (b - a) * weights.shape[1]].reshape(b - a, -1)
            np.matmul(states[a:b], weights, out=logits)
            picked = logits.reshape(-1)[np.arange(0, logits.size, logits.shape[1]) + at[a:b]]
            # As in log_sum().
            top = logits.max(axis=1) if float(logits.max()) > 60 or float(logits.min()) < -60 else None
            if top is not None:
                logits -= top[:, None]
                picked -= top
            np.exp(logits, out=logits)
            out[a:b] = picked - np.log(logits @ self.ones[: logits.shape[1]])
        return out

    def found(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """log10 probabilities, as log_probabilities() of the states, which have a last column of ones here."""
        group = (targets // GROUP).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(self.members)))])
        states, member = states[order], (targets % GROUP)[order]
        out = self.share(states, self.groups, group[order])
        for g in np.flatnonzero(np.diff(ends)):
            a, b = ends[g], ends[g + 1]
            out[a:b] += self.share(states[a:b], self.members[g], member[a:b])
        back = np.empty(len(order))
        back[order] = out
        back /= np.log(10)
        return back

    def positions(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each id, of all sequences joined; every id is scored once."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        if not len(sequences):
            return np.zeros(0)
        # One more id before each sequence: the end of the one before.
        joined = np.full(int((lengths + 1).sum()) + WINDOW + 1, END, np.int64)
        base = np.cumsum(lengths + 1) - (lengths + 1)
        for s, b in zip(sequences, base.tolist(), strict=True):
            joined[b + 1 : b + 1 + len(s)] = s
        out = np.zeros(len(joined))
        seq, at = windows(lengths)
        batch = self.batch
        for which, position, start in ((np.arange(len(lengths)), np.zeros(len(lengths), np.int64), 0), (seq, at, OVERLAP)):
            n = WINDOW - start
            for i in range(0, len(which), batch * self.several):
                some, place = which[i : i + batch * self.several], position[i : i + batch * self.several]
                index = (base[some] + place)[:, None] + np.arange(WINDOW)
                context = joined[index]
                states = np.empty((len(some) * n, WIDTH + 1), np.float32)
                states[:, WIDTH] = 1
                room = np.empty((batch * n, WIDTH), np.float32)
                for k in range(0, len(some), batch):
                    part = context[k : k + batch]
                    self.states(part, start, room[: len(part) * n])
                    states[k * n : (k + len(part)) * n, :WIDTH] = room[: len(part) * n]
                inside = (place[:, None] + np.arange(start, WINDOW) < lengths[some][:, None]).ravel()
                after = (index[:, start:] + 1).ravel()
                if not inside.all():
                    states, after = states[inside], after[inside]
                out[after] = self.found(states, joined[after])
        real = np.ones(len(joined), bool)
        real[base] = False
        real[int((lengths + 1).sum()) :] = False
        return out[real]

    def score(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each sequence."""
        lengths = [len(s) for s in sequences]
        return np.bincount(np.repeat(np.arange(len(lengths)), lengths), self.positions(sequences), len(lengths))


def spelled(places: np.ndarray, sizes: np.ndarray, first: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The ids of word numbers. A word's ids are the sizes[word] places from first[word] on."""
    each = sizes[text]
    stop = np.cumsum(each)
    at = np.repeat(first[text] - (stop - each), each)
    at += np.arange(len(at))
    return places[at]


def sequences_of(pieces: Pieces, texts: list[list[bytes]]) -> list[np.ndarray]:
    """The ids of texts given as lists of words, each with the end."""
    number: dict[bytes, int] = {}
    numbers = [np.fromiter((number.setdefault(x, len(number)) for x in t), np.int32, len(t)) for t in texts]
    places, sizes = pieces.ids(list(number))
    return [np.append(spelled(places, sizes, np.cumsum(sizes) - sizes, t), np.int16(END)) for t in numbers]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of binary texts: their words as numbers, joined; each text's number of words; the distinct words by number. The same words as words_of()."""
    # The view asks nothing of the bytes; what follows treats ASCII only.
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").view(pa.string())))
    words, sizes = split.flatten(), pc.list_value_length(split).to_numpy().astype(np.int64)
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not real.all():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
        words = words.filter(pa.array(real))
    codes = words.dictionary_encode()
    return codes.indices.to_numpy(), sizes, codes.dictionary.view(pa.binary())


def portions(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most so many, of about `size` bytes in the last column, which becomes binary."""
    waiting, held, total = [], 0, 0

    def out() -> pa.RecordBatch:
        return pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

    for batch in parts(batches):
        batch = batch.set_column(batch.num_columns - 1, batch.schema.names[-1], batch.columns[-1].cast(pa.binary()))
        at = 0
        for k, n in enumerate(pc.fill_null(pc.binary_length(batch.columns[-1]), 0).to_pylist()):
            total += n
            if total >= size or held + k + 1 - at >= rows:
                waiting.append(batch.slice(at, k + 1 - at))
                yield out()
                waiting, held, total, at = [], 0, 0, k + 1
        if at < batch.num_rows:
            waiting.append(batch.slice(at))
            held += batch.num_rows - at
    if waiting:
        yield out()


def trained(docs: DataFrame, rule, raw: bytes, tokens: int) -> dict[str, np.ndarray]:
    """The model after every document that rule selects; these have so many tokens. In rounds, each over documents of its own; few tokens are read several times, in small batches."""
    times = min(STEPS, -(-STEPS * BATCH * WINDOW // max(1, tokens)))
    part, w = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(PARTS)), started()
    for k, (below, batch, rate) in enumerate(ROUNDS):
        w = refined(docs, rule & (part >= (ROUNDS[k - 1][0] if k else 0)) & (part < below), raw, w, BATCH if times > 1 else batch, rate, times)
    return w


def refined(docs: DataFrame, rule, raw: bytes, start: dict[str, np.ndarray], batch: int = 128, rate: float = 1e-3, times: int = 1) -> dict[str, np.ndarray]:
    """The model after every id of every row that rule selects: each task goes on from the start; the mean of the tasks' changes, by their windows."""
    shared = docs.sparkSession.sparkContext.broadcast((raw, start))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, w, task, n = None, None, TaskContext.get().partitionId(), 0
        for some in portions(batches, COUNTED_DOCUMENTS, LEARNT_BYTES):
            if pieces is None:
                raw, start = shared.value
                pieces, w = Pieces(raw), {k: v.copy() for k, v in start.items()}
                rng, adam, room = np.random.default_rng(task), Adam(w), Room()
            source = Windows(pieces, some.columns[0])
            for time in range(times):
                for at in np.array_split(rng.permutation(len(source)), -(-len(source) // batch)):
                    adam.down(gradient(w, *source.take(at), room=room), rate * min(1.0, (adam.step + 1) / 20) * (1 - 0.9 * time / times))
            n += len(source)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([task % GROUPS], pa.int32()), pa.array([n], pa.int64()), pa.array([n * (flat(w) - flat(start))], pa.list_(pa.float32()))], names=["_g", "_n", "_w"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for k in range(batch.num_rows):
                n += batch.column(1)[k].as_py()
                w = batch.column(2)[k].values.to_numpy().astype(np.float64)
                total = w if total is None else total + w
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([total.astype(np.float32)], pa.list_(pa.float32()))], names=["_g", "_n", "_w"])

    kind = "_g int, _n bigint, _w array<float>"
    rows = docs.where(rule).select(docs["text"].cast("string")).mapInArrow(learn, kind)
    found = rows.repartition(GROUPS, "_g").mapInArrow(summed, kind).toArrow()
    n = sum(found["_n"].to_pylist())
    if not n:
        return start
    change = sum(np.array(x.values, np.float64) for x in found["_w"]) / n
    return raised(start, change.astype(np.float32))


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def raised(w: dict[str, np.ndarray], change: np.ndarray) -> dict[str, np.ndarray]:
    """w plus the change, which is flat."""
    out, at = {}, 0
    for k in sorted(w):
        out[k] = w[k] + change[at : at + w[k].size].reshape(w[k].shape)
        at += w[k].size
    return out


def word_counts(docs: DataFrame, rule) -> DataFrame:
    """_word, _c: occurrences in all rows that rule selects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in portions(batches, COUNTED_DOCUMENTS, COUNTED_BYTES):
            index, _, words = numbered(some.columns[0])
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(index, minlength=len(words)), pa.int64())], names=["_word", "_c"])

    return docs.where(rule).select(docs["text"].cast("string")).mapInArrow(run, "_word binary, _c bigint").groupBy("_word").agg(F.sum("_c").alias("_c"))


def hot_words(counts: DataFrame, most: int = HOT) -> tuple[pa.Array, np.ndarray]:
    """Words of the largest counts, and these: all at or over the least power of 2 ** (1 / 4) that at most `most` of them reach. Nothing is sorted."""
    step = F.floor(4 * F.log2(F.col("_c").cast("double"))).cast("int")
    short = counts.where(F.octet_length("_word") <= HOT_LENGTH)
    held, least = 0, None
    for r in sorted(short.groupBy(step.alias("_s")).agg(F.count(F.lit(1)).alias("_n")).collect(), key=lambda r: -r._s):
        held += r._n
        if held > most:
            break
        least = r._s
    if least is None:
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    found = short.where(step >= least).toArrow()
    return found["_word"].combine_chunks().cast(pa.binary()), found["_c"].to_numpy()


@dataclass(frozen=True)
class Totals:
    """Of the training documents: tokens, distinct tokens, ends, words that occur once."""

    n: int
    v: int
    ends: int
    once: int

    @property
    def kept(self) -> float:
        """The weight of the counts in the score."""
        return KEEP * (1 - self.once / self.n) if self.n else 0.0


#: Columns of a block's rows beside doc_id, of words, of both, of documents.
SCHEMA = [("_word", pa.binary(), T.BinaryType()), ("_at", pa.list_(pa.int32()), T.ArrayType(T.IntegerType())), ("_q", pa.list_(pa.float32()), T.ArrayType(T.FloatType()))]
SCHEMA += [("_block", pa.int64(), T.LongType()), ("_i", pa.int32(), T.IntegerType()), ("n_tokens", pa.int64(), T.LongType()), ("held_out", pa.bool_(), T.BooleanType())]
SCHEMA += [("_l0", pa.float64(), T.DoubleType()), ("_k0", pa.int64(), T.LongType()), ("_s0", pa.float64(), T.DoubleType())]


def listed(word: np.ndarray, doc: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in lists by word: the words, the lists' offsets, document and times packed, q. Equal occurrences are one entry."""
    order = np.lexsort((q, doc, word))
    word, doc, q = word[order], doc[order], q[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (doc[1:] != doc[:-1]) | (q[1:] != q[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(word)))
    most = (1 << COUNT_BITS) - 1
    repeats = -(-times // most)
    value = np.full(int(repeats.sum()), most, np.int64)
    value[np.cumsum(repeats) - 1] = times - (repeats - 1) * most
    first = np.repeat(first, repeats)
    words, n = np.unique(word[first], return_counts=True)
    return words, np.concatenate([[0], np.cumsum(n)]), (doc[first] << COUNT_BITS | value).astype(np.int32), q[first]


def blocks(docs: DataFrame, w: dict[str, np.ndarray], hot: tuple[pa.Array, np.ndarray], totals: Totals, raw: bytes) -> DataFrame:
    """Rows of two kinds. A word of a block that isn't hot: _word, _at (document of the block and times, packed) and _q (log10 of the model's probability). A document: doc_id, _i, its sums over hot words and the end."""
    shared = docs.sparkSession.sparkContext.broadcast((w, hot, raw))
    n_log = np.log10(totals.n + 0.5 * (totals.v + 1))
    kept = totals.kept

    def made(pieces: Pieces, scorer: Scorer, hot: tuple[pa.Array, np.ndarray], block: int, some_docs: pa.RecordBatch) -> pa.RecordBatch:
        index, lengths, names = numbered(some_docs.columns[2])
        texts = np.split(index, np.cumsum(lengths)[:-1])
        id_type, ids, held = some_docs.schema.field(0).type, some_docs.columns[0], some_docs.columns[1]
        places, sizes = pieces.ids(names)
        first, sizes = np.cumsum(sizes) - sizes, np.append(sizes, 1)
        # Counts of hot words and of the end, which has the last number; -1 for others.
        at = pc.fill_null(pc.index_in(names, value_set=hot[0]), -1).to_numpy(zero_copy_only=False)
        count = np.append(np.append(hot[1], -1)[at], totals.ends)
        log_c = np.log10(np.maximum(count, 0) + 0.5) - n_log
        m = len(texts)
        sums, cold = [np.zeros(m) for _ in range(3)], []
        some: list[int] = []
        size = 0

        def flush() -> None:
            made = [np.append(spelled(places, sizes, first, texts[i]), np.int16(END)) for i in some]
            own = lengths[some] + 1
            doc, word = np.repeat(some, own), np.full(int(own.sum()), len(names), np.int64)
            inner = np.ones(len(word), bool)
            inner[np.cumsum(own) - 1] = False
            word[inner] = np.concatenate([texts[i] for i in some])
            each = sizes[word]
            q = np.add.reduceat(scorer.positions(made), np.cumsum(each) - each)
            c = count[word]
            known = c >= 0
            d, x = doc[known], c[known]
            mixed = np.log10(kept * x / max(1, totals.n) + (1 - kept) * 10 ** np.maximum(q[known], -300))
            for total, value in zip(sums, (log_c[word[known]], x > 0, mixed), strict=True):
                total += np.bincount(d, value, m)
            cold.append((word[~known], doc[~known], q[~known].astype(np.float32)))

        for i, t in enumerate(texts):
            some.append(i)
            size += len(t)
            if size >= SCORED_WORDS:
                flush()
                some, size = [], 0
        if some:
            flush()
        words, offsets, at, q = listed(*(np.concatenate(x) for x in zip(*cold, strict=True)))
        n, nothing = len(words), pa.nulls
        of_words = [names.take(pa.array(words)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(at)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(q))]
        of_documents = [range(m), lengths + 1, held, sums[0], sums[1].astype(np.int64), sums[2]]
        kinds = [t for _, t, _ in SCHEMA]
        columns = [pa.concat_arrays([nothing(n, id_type), ids])]
        columns += [pa.concat_arrays([x, nothing(m, t)]) for x, t in zip(of_words, kinds, strict=False)]
        columns += [pa.array([block] * (n + m), pa.int64())]
        columns += [pa.concat_arrays([nothing(n, t), pa.array(x, t)]) for x, t in zip(of_documents, kinds[4:], strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", *(k for k, _, _ in SCHEMA)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, hot, raw = shared.value
        pieces, scorer = Pieces(raw), Scorer(w)
        for block, some in enumerate(portions(batches, BLOCK_DOCUMENTS, BLOCK_BYTES), TaskContext.get().partitionId() << 32):
            yield made(pieces, scorer, hot, block, some)

    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(k, t) for k, _, t in SCHEMA)])
    return docs.mapInArrow(run, schema)


def scored(docs: DataFrame, path: str, mod: int = 5, rest: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    raw = rank_file(path)
    rule = F.coalesce(bucket(F.col("doc_id"), mod) != rest, F.lit(False))
    held = F.coalesce(bucket(F.col("doc_id"), mod) == rest, F.lit(False))
    counts = checkpointed(word_counts(docs, rule))
    words, kinds, once = counts.agg(F.coalesce(F.sum("_c"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("_c") == 1)).first()
    ends = docs.where(rule).count()
    totals = Totals(words + ends, kinds + int(ends > 0), ends, once)
    w = trained(docs, rule, raw, totals.n)
    source = docs.select("doc_id", held.alias("_held"), docs["text"].cast("string").alias("_text"))
    # Written once: a block's rows refer to places in it.
    rows = checkpointed(blocks(source, w, hot_words(counts), totals, raw))
    others, documents = rows.where(F.col("_i").isNull()), rows.where(F.col("_i").isNotNull())
    c = F.coalesce(F.col("_c"), F.lit(0))
    base = F.log10((c + F.lit(0.5)) / F.lit(totals.n + 0.5 * (totals.v + 1)))
    part = F.lit(totals.kept) * c / F.lit(max(1, totals.n))
    # Each word's share goes to its documents; sums are combined before the shuffle.
    shares = others.select("_word", "_block", "_at", "_q").join(counts, "_word", "left").select("_block", F.explode(F.arrays_zip("_at", "_q")).alias("_e"), base.alias("_l"), (c > 0).cast("bigint").alias("_k"), part.alias("_p"))
    times = F.expr(f"_e._at & {(1 << COUNT_BITS) - 1}")
    # Far below the range of doubles the model's part alone counts, as a logarithm.
    q = F.col("_e._q").cast("double")
    mixed = F.when((q < -300) & (F.col("_p") == 0), F.lit(math.log10(1 - totals.kept)) + q).otherwise(F.log10(F.col("_p") + F.lit(1 - totals.kept) * F.pow(F.lit(10.0), q)))
    sums = shares.select("_block", F.shiftright("_e._at", COUNT_BITS).alias("_i"), (times * F.col("_l")).alias("_l"), (times * F.col("_k")).alias("_k"), (times * mixed).alias("_s"))
    sums = sums.groupBy("_block", "_i").agg(*[F.sum(x).alias(x) for x in ("_l", "_k", "_s")])
    out = documents.drop("_word", "_at", "_q").join(sums, ["_block", "_i"], "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("_k0") + F.coalesce("_k", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(totals.n).cast("bigint").alias("train_tokens"),
        (F.col("_l0") + F.coalesce("_l", F.lit(0.0))).alias("base_score"),
        (F.col("_s0") + F.coalesce("_s", F.lit(0.0))).alias("score"),
    )
