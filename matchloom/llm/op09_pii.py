"""Operator 9: personal data by a character-level bidirectional LSTM with CRF transitions.

Four kinds of spans have an exact base: e-mail addresses, IP addresses, card numbers and phone
numbers by pattern and check; a fifth, secrets (keys and tokens), is only the tagger's. The tagger is
trained in numpy on labelled spans of at most LABELLED documents (those with the smallest hash of their
id): base spans, assigned keys, and both written in ways that no pattern here matches (FORMS). WINDOWS
bounds the windows that are learned from, by a hash of document and place: a third hold a labelled span,
a third digits or an @ without one, a third neither.

Every text is read whole, in windows that overlap. Where windows overlap their emissions are averaged,
nearer to a window's middle counting more, and one path is decoded over each stretch in which any place
could leave the tag of none (elsewhere transitions can't make up for it, so the path is known). A span
is added if the tags' posteriors are SURE of it on average, its number is valid (Luhn, length, parts up
to 255) and it touches no base span. Base spans always stay; no pattern decides on added ones.

Null and empty texts have no spans. Repeated rows find the same. With no labelled spans at all nothing
is added. Offsets are code points. An empty table gives an empty result. Extra columns are ignored
unless named in `keep`; one that is named like a result column is an error.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import no_clash
from matchloom.session import Scratch

#: Documents that are learned from at most, and windows.
LABELLED, WINDOWS = 20_000, 6_000
#: Characters in a window, that two windows share, and in a window that is learned from.
WINDOW, SHARED, LEARNED = 384, 32, 96
HIDDEN, STEPS = 10, 600
SURE = 0.8
KINDS = ("email", "ip", "card", "phone")
TAGGED = (*KINDS, "secret")

_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NAME = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_SECRET = re.compile(r"(?i)(?:token|secret|key|password)\s*[:=]+\s*[\"']?([A-Za-z0-9/+_-]{16,})")
_HARD = re.compile(r"[0-9@]")

#: Signs that are a symbol of their own to the tagger.
_SIGNS = "@._%+-() \n,:;/\"'=<>[]#*|&"
_ALPHABET = 6 + len(_SIGNS)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str):
    """(start, end) of each address, in a time that grows with the text: from each @ the name is read backwards and the domain forwards."""
    at, done = text.find("@"), 0
    while at >= 0:
        left = at
        while left > done and _NAME.match(text[left - 1]):
            left -= 1
        domain = _DOMAIN.match(text, at + 1) if left < at else None
        done = domain.end() if domain else at + 1
        if domain:
            yield left, done
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(int(p) <= 255 for p in m[0].split(".")) if len(m[0]) <= 60 else all(p.lstrip("0") == "" or len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = digits_of(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(found)


def labelled_spans(text: str) -> list[tuple[int, int, int]]:
    """Base spans, and what is assigned to a name of secrets."""
    base = base_spans(text)
    more = [(m.start(1), 4, m.end(1)) for m in _SECRET.finditer(text)]
    return sorted(base + [x for x in more if all(x[2] <= a or e <= x[0] for a, _, e in base)])


#: Symbols of ASCII characters (3: any other), and 4 for all that isn't ASCII.
_SYMBOLS = np.array([0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 6 + _SIGNS.index(chr(c)) if chr(c) in _SIGNS else 3 for c in range(128)] + [4])


def symbols(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return _SYMBOLS[np.minimum(c, 128)]


def _gate(z):
    """Piecewise linear sigmoid."""
    z *= 0.2
    z += 0.5
    np.maximum(z, 0, out=z)
    return np.minimum(z, 1, out=z)


def _bent(x):
    """Piecewise linear hyperbolic tangent."""
    x = np.maximum(x, -1)
    return np.minimum(x, 1, out=x)


class Tagger:
    """A bidirectional LSTM over symbols, with piecewise linear gates, and a linear-chain CRF over the kinds' tags (0: none)."""

    TAGS = len(TAGGED) + 1

    def __init__(self, hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        h, t = hidden, self.TAGS
        self.p = {"out": r.normal(0, 0.3, (2 * h, t)), "bias": np.zeros(t), "pair": np.zeros((t, t))}
        for d in "fb":
            gate = np.zeros(4 * h)
            gate[h : 2 * h] = 1.5  # what is forgotten, at first little
            self.p |= {f"x{d}": r.normal(0, 0.5, (_ALPHABET, 4 * h)), f"h{d}": r.normal(0, 1 / np.sqrt(h), (h, 4 * h)), f"g{d}": gate}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, ids, d, keep):
        """Hidden states (time, batch, hidden) in one direction, and what the way back needs. ids: (time, batch)."""
        t, n = ids.shape
        size = self.p[f"h{d}"].shape[0]
        dtype = self.p["out"].dtype
        h, c = np.zeros((n, size), dtype), np.zeros((n, size), dtype)
        x = self.p[f"x{d}"] + self.p[f"g{d}"]
        out, kept = np.zeros((t, n, size), dtype), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = x[ids[k]]
            z += h @ self.p[f"h{d}"]
            gates = _gate(z[:, : 3 * size].copy() if keep else z[:, : 3 * size])
            i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
            u = _bent(z[:, 3 * size :])
            before_c, before_h = c, h
            c = f * c
            c += i * u
            tc = _bent(c)
            h = o * tc
            out[k] = h
            if keep:
                kept.append((k, i, f, o, u, before_c, before_h, tc))
        return out, kept

    def emissions(self, ids, keep=False):
        """(batch, time, tags) for ids (batch, time)."""
        turned = np.ascontiguousarray(ids.T)
        hf, kf = self._run(turned, "f", keep)
        hb, kb = self._run(turned, "b", keep)
        size = hf.shape[2]
        emit = hf.reshape(-1, size) @ self.p["out"][:size]
        emit += hb.reshape(-1, size) @ self.p["out"][size:]
        emit += self.p["bias"]
        both = np.concatenate([hf, hb], 2).transpose(1, 0, 2) if keep else None
        return emit.reshape(*turned.shape, -1).transpose(1, 0, 2), both, (kf, kb)

    def emitted(self, ids, width):
        """(time, tags, batch) for ids (batch, time): emissions() of the first `width` places of each window, widest window first, without what learning needs.

        Windows lie side by side, so that each step works on whole rows of memory; what gates are scaled by is in their weights.
        """
        turned = np.ascontiguousarray(ids.T)
        (t, n), size = turned.shape, self.p["hf"].shape[0]
        scale = np.repeat(np.array([0.2, 1], np.float32), [3 * size, size])
        shift = np.repeat(np.array([0.5, 0], np.float32), [3 * size, size])
        total = np.broadcast_to(self.p["bias"][:, None], (t, self.TAGS, n)).copy()
        wide = np.searchsorted(-np.asarray(width), -np.arange(t)).tolist()  # windows that have a place k
        for d, out in (("f", self.p["out"][:size]), ("b", self.p["out"][size:])):
            x = np.ascontiguousarray(((self.p[f"x{d}"] + self.p[f"g{d}"]) * scale + shift).T)
            w = np.ascontiguousarray(np.concatenate([self.p[f"h{d}"] * scale, out], 1).T)
            states, told, z, step = np.zeros((2, size, n), np.float32), np.zeros((4 * size + self.TAGS, n), np.float32), np.empty(4 * size * n, np.float32), np.empty((size, n), np.float32)
            for k in range(t) if d == "f" else range(t - 1, -1, -1):
                m = wide[k]  # the others are at their end, or begin later
                (h, c), said, fed, new = states[:, :, :m], told[:, :m], z[: 4 * size * m].reshape(-1, m), step[:, :m]
                np.take(x, turned[k, :m], axis=1, out=fed, mode="clip")
                fed += said[: 4 * size]
                gates, u = fed[: 3 * size], fed[3 * size :]
                np.clip(gates, 0, 1, out=gates)
                np.clip(u, -1, 1, out=u)
                c *= gates[size : 2 * size]
                np.multiply(gates[:size], u, out=new)
                c += new
                np.clip(c, -1, 1, out=new)
                np.multiply(gates[2 * size :], new, out=h)
                np.matmul(w, h, out=said)  # for the next step, and this one's tags
                total[k, :, :m] += said[4 * size :]
        return total

    def marginals(self, emit):
        """(P of each tag at each place, expected pairs, log of the sum over paths)."""
        n, t, tags = emit.shape
        pair = self.p["pair"]
        a, b = np.zeros((n, t, tags)), np.zeros((n, t, tags))

        def lse(x, axis):
            m = x.max(axis, keepdims=True)
            return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)

        a[:, 0] = emit[:, 0]
        for k in range(1, t):
            a[:, k] = emit[:, k] + lse(a[:, k - 1][:, :, None] + pair[None], 1)
        for k in range(t - 2, -1, -1):
            b[:, k] = lse(pair[None] + (emit[:, k + 1] + b[:, k + 1])[:, None, :], 2)
        total = lse(a[:, -1], 1)
        p = np.exp(a + b - total[:, None, None])
        joint = np.exp(a[:, :-1, :, None] + pair + (emit[:, 1:] + b[:, 1:])[:, :, None, :] - total[:, None, None, None]).sum((0, 1))
        return p, joint, total

    def gradient(self, ids, tags):
        emit, both, kept = self.emissions(ids, True)
        p, joint, _ = self.marginals(emit.astype(np.float64))
        n, t = ids.shape
        delta = p.copy()
        delta[np.arange(n)[:, None], np.arange(t)[None], tags] -= 1
        delta = (delta / n).astype(np.float32)
        seen = np.zeros_like(joint)
        np.add.at(seen, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        g = {"out": both.reshape(n * t, -1).T @ delta.reshape(n * t, -1), "bias": delta.sum((0, 1)), "pair": (joint - seen) / n}
        back = delta @ self.p["out"].T
        size = self.p["hf"].shape[0]
        for d, part, steps in (("f", back[:, :, :size], kept[0]), ("b", back[:, :, size:], kept[1])):
            gx, gh = np.zeros((n, t, 4 * size), np.float32), np.zeros_like(self.p[f"h{d}"])
            dh, dc = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
            for k, i, f, o, u, before_c, before_h, tc in reversed(steps):
                dh = dh + part[:, k]
                dc = dc + dh * o * (np.abs(tc) < 1)
                open_ = lambda g: 0.2 * ((g > 0) & (g < 1))
                dz = np.concatenate([dc * u * open_(i), dc * before_c * open_(f), dh * tc * open_(o), dc * i * (np.abs(u) < 1)], 1)
                gx[:, k] = dz
                gh += before_h.T @ dz
                dh, dc = dz @ self.p[f"h{d}"].T, dc * f
            table = np.zeros_like(self.p[f"x{d}"])
            np.add.at(table, ids.ravel(), gx.reshape(n * t, -1))
            g |= {f"x{d}": table, f"h{d}": gh, f"g{d}": gx.sum((0, 1))}
        return g

    def train(self, ids, tags, steps: int = STEPS, size: int = 96, rate: float = 0.015, seed: int = 11):
        r = np.random.default_rng(seed)
        m, v = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            at = r.integers(0, len(ids), size)
            g = self.gradient(ids[at], tags[at])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            now = rate * min(1.0, 3 * (1 - step / (steps + 1)))
            for k in self.p:
                x = (g[k] * min(1.0, 5 / max(norm, 1e-9))).astype(np.float32)
                m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.999 * v[k] + 0.001 * x * x
                self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def margin(self) -> float:
        """The most that a step between tags can gain on staying at none; a place whose tags are twice that behind none can't leave it."""
        pair = self.p["pair"]
        return float(max(0.0, pair.max() - pair[0, 0]))

    def decode(self, emit: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best paths (stretch, time) and the posteriors of their tags; emit: (stretch, time, tags), with `size` places each."""
        n, t, _ = emit.shape
        emit = emit.astype(np.float64)
        pair = self.p["pair"].astype(np.float64)
        for k, m in enumerate(size):  # beyond a stretch's end nothing is tagged
            emit[k, m:] = 0
            emit[k, m:, 1:] = -1e9
        best, back = emit[:, 0].copy(), np.zeros(emit.shape, np.int8)
        for k in range(1, t):
            step = best[:, :, None] + pair[None]
            back[:, k] = step.argmax(1)
            best = step.max(1) + emit[:, k]
        path = np.zeros((n, t), np.int64)
        path[:, -1] = best.argmax(1)
        for k in range(t - 1, 0, -1):
            path[:, k - 1] = back[np.arange(n), k, path[:, k]]
        p = self.marginals(emit)[0]
        return path, np.take_along_axis(p, path[:, :, None], 2)[:, :, 0]


def windows_of(n: int) -> list[int]:
    """Where the windows over a text of n characters begin."""
    return list(range(0, max(1, n - SHARED), WINDOW - SHARED)) if n else []


def padded(text: str, size: int = WINDOW) -> np.ndarray:
    ids = symbols(text[:size])
    return ids if len(ids) == size else np.concatenate([ids, np.full(size - len(ids), 5)])


def valid(kind: int, text: str) -> bool:
    """What a number of this kind must be, however it is written."""
    d = digits_of(text)
    if kind == 0:
        return sum(c.isalnum() for c in text) >= 4
    if kind == 1:
        parts = [x for x in re.split(r"[^0-9]+", text) if x]
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == 2:
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == 3:
        return 9 <= len(d) <= 15
    return sum(c.isalnum() for c in text) >= 16


def text_emissions(texts: list[str], tagger: Tagger):
    """(text, first place, emissions) of each stretch that can hold a span, overlapping windows averaged."""
    need = -2 * tagger.margin()
    places = [(d, at) for d, t in enumerate(texts) for at in windows_of(len(t))]
    ids = [symbols(t) for t in texts]
    cut = [ids[d][at : at + WINDOW] for d, at in places]
    width = np.array([-(-len(x) // 32) * 32 for x in cut], np.int64)
    found: dict[int, list[tuple[int, np.ndarray]]] = {}
    order = np.argsort(-width, kind="stable")
    for part in np.array_split(order, -(-len(order) // 1024)) if len(order) else []:
        block = np.full((len(part), int(width[part[0]])), 5)
        for r, i in enumerate(part.tolist()):
            block[r, : len(cut[i])] = cut[i]
        emit = tagger.emitted(block, width[part])
        live = emit[:, 1:].max(1) > emit[:, 0] + need
        live &= block.T != 5
        for r in np.flatnonzero(live.any(0)).tolist():
            d, at = places[part[r]]
            found.setdefault(d, []).append((at, emit[: len(cut[part[r]]), :, r].copy()))
    for d, parts in found.items():
        parts.sort(key=lambda x: x[0])
        runs: list[list[tuple[int, np.ndarray]]] = []
        for at, e in parts:
            if runs and at <= runs[-1][-1][0] + len(runs[-1][-1][1]):
                runs[-1].append((at, e))
            else:
                runs.append([(at, e)])
        for run in runs:
            first, end = run[0][0], run[-1][0] + len(run[-1][1])
            total, weight = np.zeros((end - first, Tagger.TAGS)), np.zeros((end - first, 1))
            for at, e in run:
                near = np.minimum(np.arange(1, len(e) + 1), np.arange(len(e), 0, -1))[:, None]
                total[at - first : at - first + len(e)] += near * e
                weight[at - first : at - first + len(e)] += near
            total /= weight
            live = np.flatnonzero(total[:, 1:].max(1) - total[:, 0] > need)
            if len(live):
                for piece in np.split(live, np.flatnonzero(np.diff(live) > 1) + 1):
                    a, b = max(0, piece[0] - 1), min(len(total), piece[-1] + 2)  # none before and after
                    yield d, first + a, total[a:b]


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """What the tagger adds to each text's base spans."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    pieces = sorted(text_emissions(texts, tagger), key=lambda x: len(x[2]))
    at = 0
    while at < len(pieces):
        size = max(32, 2 * len(pieces[at][2]))
        group = [p for p in pieces[at : at + 512] if len(p[2]) <= size]
        at += len(group)
        lens = np.array([len(e) for _, _, e in group])
        emit = np.zeros((len(group), int(lens.max()), Tagger.TAGS))
        for k, (_, _, e) in enumerate(group):
            emit[k, : len(e)] = e
        for (d, first, e), tags, sure in zip(group, *tagger.decode(emit, lens)):
            tags, n = tags[: len(e)], len(e)
            edges = [0, *(np.flatnonzero(np.diff(tags)) + 1).tolist(), n]
            for x, y in zip(edges, edges[1:]):
                if tags[x] and sure[x:y].mean() >= SURE:
                    piece, kind = texts[d][first + x : first + y], int(tags[x]) - 1
                    start = first + x + len(piece) - len(piece.lstrip(" .,;:\n\"'"))
                    end = first + y - (len(piece) - len(piece.rstrip(" .,;:\n\"'")))
                    clear = all(end <= s or e2 <= start for s, _, e2 in base[d]) and all(end <= s or e2 <= start for s, _, e2 in out[d])
                    if start < end and clear and valid(kind, texts[d][start:end]):
                        out[d].append((start, kind, end))
    return out


def written(spans) -> str:
    return ",".join(f"{TAGGED[k]}:{a}:{b}" for a, k, b in sorted(spans))


# ---- training ------------------------------------------------------------------------------------


def _examples(batches):
    """Windows with their labelled spans: share 0 with a span, 1 with digits or an @ and no span, 2 with neither."""
    for b in batches:
        rows = []
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            text = t or ""
            spans = labelled_spans(text)
            for at in range(0, len(text), LEARNED):
                piece = text[at : at + LEARNED]
                inside = [x for x in spans if x[0] < at + LEARNED and x[2] > at]
                for s, k, e in inside:  # a span is learned whole, somewhere in its window
                    if s >= at:
                        begin = max(0, s - (d + s) % 30)
                        near = [v for q, kind, z in spans if q >= begin and z <= begin + LEARNED for v in (q - begin, kind, z - begin)]
                        rows.append((d ^ s, 0, text[begin : begin + LEARNED], near))
                if not inside:
                    rows.append((d ^ at, 1 if _HARD.search(piece) else 2, piece, []))
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.list_(pa.int64())),
        ], names=["key", "share", "piece", "marks"])


def _grouped(digits: str, n: int, sep: str) -> str:
    return sep.join(digits[i : i + n] for i in range(0, len(digits), n))


#: Ways to write a span that the patterns miss; the last of each kind is never learned from, only tried.
FORMS = {
    0: (lambda x: x.replace("@", " @ "), lambda x: x.replace("@", " (at) "), lambda x: x.replace("@", "[at]").replace(".", "[dot]"), lambda x: x.replace("@", " at ").replace(".", " dot "), lambda x: x.replace("@", "(at)").replace(".", "(dot)")),
    1: (lambda x: x.replace(".", " . "), lambda x: x.replace(".", "[.]"), lambda x: x.replace(".", "(.)"), lambda x: x.replace(".", ", "), lambda x: x.replace(".", ". ")),
    2: (lambda x: _grouped(digits_of(x), 4, "."), lambda x: _grouped(digits_of(x), 4, "/"), lambda x: _grouped(digits_of(x), 4, "  "), lambda x: _grouped(digits_of(x), 4, " - "), lambda x: _grouped(digits_of(x), 4, "_")),
    3: (lambda x: "00" + digits_of(x), lambda x: f"({digits_of(x)[:3]}) {_grouped(digits_of(x)[3:], 4, ' ')}", lambda x: _grouped(digits_of(x)[-10:], 3, "."), lambda x: _grouped(digits_of(x)[-10:], 3, "-"), lambda x: f"0{digits_of(x)[-10:-6]} {digits_of(x)[-6:]}", lambda x: _grouped(digits_of(x)[-10:], 3, "/")),
    4: (lambda x: x, lambda x: x.upper(), lambda x: x[: 20 + len(x) // 4], lambda x: _grouped(x, 8, "-")),
}


def variant(piece: str, marks: list[tuple[int, int, int]], r, unseen: bool = False) -> tuple[str, list[tuple[int, int, int]]]:
    """The same window with its spans written another way, and where they are then."""
    out, spans, at = "", [], 0
    for s, k, e in sorted(marks):
        forms = FORMS[k]
        inner = (forms[-1] if unseen else forms[r.integers(0, len(forms) - 1)])(piece[s:e])
        out += piece[at:s]
        if k == 4 and not unseen and r.random() < 0.5:  # another name, without quotes
            out = re.sub(r"\w+\s*[:=]+\s*[\"']?$", lambda m: r.choice(["api_key=", "secret: ", "password = '", "key="]), out)
        spans.append((len(out), k, len(out) + len(inner)))
        out += inner
        at = e
    return (out + piece[at:])[:LEARNED], [(s, k, min(e, LEARNED)) for s, k, e in spans if s < LEARNED]


def tag_array(marks, size: int = LEARNED) -> np.ndarray:
    tags = np.zeros(size, np.int64)
    for s, k, e in marks:
        tags[s:e] = k + 1
    return tags


def examples(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LABELLED, windows: int = WINDOWS) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows to learn from, with their spans."""
    chosen = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(limit)  # 8 bytes a row
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(F.broadcast(chosen), F.col("id") == F.col("__id")).select(F.xxhash64("__id").alias("k"), "t")
    scratch = Scratch(docs.sparkSession)
    told = scratch.keep(rows.mapInArrow(_examples, "key long, share int, piece string, marks array<long>"), "examples")  # of `limit` documents at most
    place = F.xxhash64("key", "piece")
    found = []
    for share in range(3):
        for row in told.where(F.col("share") == share).orderBy(place, "key", "piece").limit(windows // 3).collect():
            m = row["marks"]
            found.append((row["piece"], [tuple(m[i : i + 3]) for i in range(0, len(m), 3)]))
    scratch.clear()
    return found


def elsewhere(piece: str, marks: list[tuple[int, int, int]], plain: list[str], r) -> tuple[str, list[tuple[int, int, int]]]:
    """One span of a window, a secret with what names it, between the words of a window without spans: spans are learned wherever they stand."""
    s, k, e = marks[r.integers(0, len(marks))]
    begin = max(0, s - 24) if k == 4 else s
    host = plain[r.integers(0, len(plain))]
    gaps = [i for i, c in enumerate(host) if c == " "] or [0]
    at = gaps[r.integers(0, len(gaps))]
    left = host[max(0, at - max(0, LEARNED - (e - begin) - 2 - int(r.integers(0, LEARNED // 2)))) : at] + " "
    text = left + piece[begin:e] + " " + host[at:].lstrip(" ")
    where = len(left) + s - begin
    return text[:LEARNED], [(where, k, min(LEARNED, where + e - s))] if where < LEARNED else []


def fit(found: list[tuple[str, list[tuple[int, int, int]]]], steps: int = STEPS) -> Tagger | None:
    """A tagger trained on windows and on variants of those with spans, half of them moved between other words, or None where there is none."""
    r = np.random.default_rng(3)
    ids, tags = [], []
    plain = [piece for piece, marks in found if not marks and piece]
    for piece, marks in found:
        ids.append(padded(piece, LEARNED))
        tags.append(tag_array(marks))
        for turn in range(6 if marks else 0):
            other, moved = variant(piece, marks, r)
            if turn % 2 and plain and moved:
                other, moved = elsewhere(other, moved, plain, r)
            ids.append(padded(other, LEARNED))
            tags.append(tag_array(moved))
        for _ in range(3 if plain and not marks else 0):  # as many windows without spans, cut and joined anew
            left, right = piece[int(r.integers(0, len(piece) + 1)) :], plain[r.integers(0, len(plain))]
            ids.append(padded(f"{left} {right}", LEARNED))
            tags.append(tag_array([]))
    return Tagger().train(np.stack(ids), np.stack(tags), steps) if any(m for _, m in found) else None


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LABELLED, windows: int = WINDOWS) -> Tagger | None:
    return fit(examples(docs, doc_id, text, limit, windows))


RESULT = (*[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added", "n_secret", "secrets", "n_found")


def find(docs: DataFrame, tagger: Tagger | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`; n_email, n_ip, n_card, n_phone and base_sha256 of the base spans; spans: these and the added ones of the
    four kinds, n_added: how many were added; n_secret and secrets: of the fifth kind; n_found: all."""
    no_clash(keep, *RESULT)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    weights = None if tagger is None else tagger.p

    def run(batches):
        model = None
        if weights is not None:
            model = Tagger()
            model.p = weights
        for b in batches:
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, model) if model else [[]] * len(texts)
            four, fifth = [[x for x in m if x[1] < 4] for m in more], [[x for x in m if x[1] == 4] for m in more]
            number = lambda xs: pa.array(xs, pa.int64())
            cols = [number([sum(k == j for _, k, _ in s) for s in base]) for j in range(len(KINDS))]
            cols += [pa.array([hashlib.sha256(written(s).encode()).hexdigest() for s in base], pa.string()), pa.array([written([*s, *m]) for s, m in zip(base, four)], pa.string())]
            cols += [number([len(x) for x in four]), number([len(x) for x in fifth]), pa.array([written(x) for x in fifth], pa.string()), number([len(s) + len(m) for s, m in zip(base, more)])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*keep, *RESULT])

    kinds = ", ".join(f"{c} {'string' if c in ('base_sha256', 'spans', 'secrets') else 'long'}" for c in RESULT)
    return docs.select(*keep, F.col(text)).mapInArrow(run, f"{ddl}, {kinds}")
