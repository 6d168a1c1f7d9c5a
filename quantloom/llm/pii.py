"""Personal data: pattern spans, and spans a character-level bidirectional LSTM with CRF transitions adds.

The tagger is trained in numpy, in one task, on a bounded sample of labelled windows: windows of the corpus, and windows
with planted spans of further spellings (national phone numbers, spelled-out and accented addresses, IPv6, cards with
other separators, keys and passwords) or numbers and codes that are none of these, in stretches of the corpus and of
made-up words. Bare numbers are never labelled as cards: there the checksum decides, which is the patterns' part.

Every character of every text is decoded, in overlapping windows. A document's decoded spans are reconciled over all its
windows: of overlapping ones that lying furthest inside its window wins, then the surer one. Gates and cells use
x / (1 + |x|), which costs a tenth of exponentials. The best path of a window is traced where it holds a tag.
Pattern spans always stay; an added span holds each pattern span that it touches whole, and more than it.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")  # the patterns know the first four
TAGS = 1 + 2 * len(KINDS)
WIDTH, STRIDE = 96, 48  # windows to learn from
LONG, OVERLAP, ROUND = 768, 64, 32  # windows to decode: their most characters, those shared by two in a row, what their width is a multiple of
BLOCK, GROUP = 384, 1 << 23  # most windows decoded side by side, characters of texts whose windows are sorted by width together
EMBED, CHARS = 16, 99

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"\d|@|(?<!\w)(?:dot|Dot|DOT)(?!\w)")
TRIGGER = r"\p{Nd}|@|\b(?:dot|Dot|DOT)\b"  # for whole texts: all that hold a trigger, and a few more
_CLASSES: list[np.ndarray] = []
_EMAIL = re.compile(r"[\w.%+-]*@[\w-]+(?:\.[\w-]+)*\w")
_SECRET = re.compile(r"""(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)["']?\s*[=:]\s*["']?([^\s"',;]{8,})""", re.IGNORECASE)
_NAMES = ("token", "secret", "passw", "pwd", "key")  # each match of _SECRET, folded, holds one


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """The pattern spans of a text, by kind, then start. Each search is linear in the text."""
    out, stop = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > stop and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            stop = m.end()
        at = text.find("@", max(at + 1, stop))
    if not re.search("[0-9]", text):
        return out
    for m in _CHAIN.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            end = at + sum(map(len, parts[i : i + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                out.append(("ip", at, end))
            at = end + 1
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group()) if m.end() - m.start() < 80 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def char_ids(text: str) -> list[int]:
    """Ids: 1 to 95 printable ASCII, 96 other white space, 97 other letters, 98 the rest; 0 pads. Digits of any script
    are those of ASCII."""
    return [ord(c) - 31 if " " <= c <= "~" else 96 if c.isspace() else 97 if c.isalpha() else 17 + int(c) if c.isdecimal() else 98 for c in text]


def classes() -> np.ndarray:
    """Ids of all code points."""
    if not _CLASSES:
        _CLASSES.append(np.array(char_ids("".join(map(chr, range(0x110000)))), dtype=np.uint8))
    return _CLASSES[0]


def places(size: int) -> tuple[int, list[int]]:
    """Width and starts of the windows to decode in a text of so many characters: as few of one width as hold all of them, two
    in a row share OVERLAP or more. Width and starts depend on the size alone."""
    if size <= 0:
        return 0, []
    n = max(1, -(-(size - OVERLAP) // (LONG - OVERLAP)))
    width = -(-(size + (n - 1) * OVERLAP) // (n * ROUND)) * ROUND
    return width, [i * (width - OVERLAP) for i in range(n)]


def windows(text: str) -> list[int]:
    """Starts of the windows to learn labels from: all of the grid that hold a trigger, and the one before."""
    starts: set[int] = set()
    for m in _TRIGGER.finditer(text):
        k = m.start() // STRIDE
        starts.update(s for s in (k * STRIDE, (k - 1) * STRIDE) if s >= 0)
    return sorted(starts)


def labelled(text: str) -> list[tuple[str, int, int]]:
    """The spans that the tagger learns from a text of the corpus: those of the patterns but cards, addresses with their
    letters outside ASCII, and values of keys and passwords."""
    out = [s for s in pattern_spans(text) if s[0] in ("ip", "phone")]
    if "@" in text:
        out += [("email", *m.span()) for m in _EMAIL.finditer(text) if pattern_spans(m.group())]
    folded = text.casefold()
    return out + [("secret", *m.span(1)) for m in _SECRET.finditer(text)] if any(x in folded for x in _NAMES) else out


def tags_of(spans: list[tuple[str, int, int]], start: int, size: int) -> np.ndarray:
    out = np.zeros(WIDTH, dtype=np.int64)
    for kind, a, z in spans:
        a, z, k = max(a - start, 0), min(z - start, size), 1 + 2 * KINDS.index(kind)
        if a < z:
            out[a:z] = k + 1
            out[a] = k
    return out


def soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Tagger:
    """BiLSTM emissions and linear-chain CRF; arrays are (time, window, ...), both directions side by side in axis 1 of the
    LSTM's. Gates in order: forget, in, out, candidate."""

    def __init__(self, seed: int = 5, dtype: type = np.float32, hidden: int = 32):
        r = np.random.default_rng(seed)
        g = lambda *s: r.normal(0, 1 / np.sqrt(s[-2]), s)
        bias = np.concatenate([np.ones((2, 1, hidden)), np.zeros((2, 1, 3 * hidden))], axis=2)
        p = {"E": r.normal(0, 0.3, (CHARS, EMBED)), "Wx": g(2, EMBED, 4 * hidden), "Wh": g(2, hidden, 4 * hidden), "b": bias, "Wo": g(2 * hidden, TAGS), "bo": np.zeros(TAGS), "T": np.zeros((TAGS, TAGS))}
        self.p = {k: v.astype(dtype) for k, v in p.items()}

    @property
    def hidden(self) -> int:
        return self.p["Wh"].shape[1]

    def emissions(self, ids: np.ndarray, keep: bool = False):
        """Tag scores of windows of character ids (a row each), and with ``keep`` what the gradients need."""
        x = self.p["E"][ids].transpose(1, 0, 2)
        x = np.stack([x, x[::-1]], axis=1)
        z = x @ self.p["Wx"] + self.p["b"]
        t, _, n, _ = z.shape
        h, tape = np.zeros((t + 1, 2, n, self.hidden), z.dtype), []
        c = np.zeros((2, n, self.hidden), z.dtype)
        for i in range(t):
            zi = z[i] + h[i] @ self.p["Wh"]
            s, a = 0.5 + 0.5 * soft(zi[:, :, : 3 * self.hidden]), soft(zi[:, :, 3 * self.hidden :])
            before, c = c, s[:, :, :self.hidden] * c + s[:, :, self.hidden : 2 * self.hidden] * a
            tc = soft(c)
            np.multiply(s[:, :, 2 * self.hidden :], tc, out=h[i + 1])
            if keep:
                tape.append((s, a, before, tc))
        both = np.concatenate([h[1:, 0], h[:0:-1, 1]], axis=2)
        return both @ self.p["Wo"] + self.p["bo"], (x, h, both, tape)

    def quick_emissions(self, ids: np.ndarray) -> np.ndarray:
        """The same tag scores for decoding alone, as (time, tag, window): one product a step gives the gates, from states and
        characters side by side, and the scores of the states before; gates in rows, everything in place."""
        p, (n, t), size = self.p, ids.shape, self.hidden
        w = np.zeros((2, size + EMBED + 1, 4 * size + TAGS), p["E"].dtype)
        w[:, :, : 4 * size] = np.concatenate([p["Wh"] / 2, p["Wx"], p["b"]], axis=1)  # states are kept doubled
        w[0, :size, 4 * size :], w[1, :size, 4 * size :] = p["Wo"][:size] / 2, p["Wo"][size:] / 2
        w, chars, at = w.transpose(0, 2, 1), np.ascontiguousarray(p["E"].T), ids.T.astype(np.intp)
        hx, e = np.zeros((2, size + EMBED + 1, n), w.dtype), np.empty((t, TAGS, n), w.dtype)
        e[:] = p["bo"][:, None]
        hx[:, -1] = 1
        both, c = np.empty((2, 4 * size + TAGS, n), w.dtype), np.zeros((2, size, n), w.dtype)
        z, (ahead, behind) = both[:, : 4 * size], both[:, 4 * size :]
        f, gi, o, a = (z[:, k * size : (k + 1) * size] for k in range(4))
        gates, h, xs = z[:, : 3 * size], hx[:, :size], hx[:, size:-1]
        room, low = np.empty((2, 4 * size, n), w.dtype), np.empty_like(c)
        for i in range(t + 1):
            if i < t:
                chars.take(at[i], axis=1, out=xs[0], mode="clip")
                chars.take(at[t - 1 - i], axis=1, out=xs[1], mode="clip")
            np.matmul(w, hx, out=both)
            if i:
                e[i - 1] += ahead
                e[t - i] += behind
            np.abs(z, out=room)
            room += 1
            z /= room
            gates += 1  # twice the gates' values
            c *= f
            gi *= a
            c += gi
            c *= 0.5
            np.abs(c, out=low)
            low += 1
            np.divide(c, low, out=low)
            np.multiply(o, low, out=h)
        return e

    def open_windows(self, e: np.ndarray) -> np.ndarray:
        """Windows (of quick emissions) whose best path holds a span."""
        some = self.candidates(e)
        return some[self.best(e[:, :, some])[0].any(axis=1)]

    def candidates(self, e: np.ndarray) -> np.ndarray:
        """Windows (of quick emissions) but those whose best path is surely that of no tags; hardly more than the open ones."""
        return np.flatnonzero(self.bound(e) > -0.01)

    def bound(self, e: np.ndarray) -> np.ndarray:
        """Of each window (of quick emissions) a score that no path with a span beats, where the path of no tags has 0: first and
        inner tags count as one each, with the best score and the best transitions of their kinds."""
        step = self.p["T"] - self.p["T"][0, 0]
        kinds = [step[1 + k :: 2, 1 + j :: 2].max() for k in range(2) for j in range(2)]
        first, inner = np.array(kinds[:2], e.dtype)[:, None], np.array(kinds[2:], e.dtype)[:, None]
        enter = np.array([step[0, 1::2].max(), step[0, 2::2].max()], e.dtype)[:, None]
        leave = np.array([step[1::2, 0].max(), step[2::2, 0].max()], e.dtype)[:, None]
        x = e[:, 1:3].copy()
        for k in range(3, TAGS, 2):
            np.maximum(x, e[:, k : k + 2], out=x)
        x -= e[:, :1]
        now, top = x[0].copy(), x[0].copy()
        more, room = np.empty_like(now), np.empty_like(now)
        for y in x[1:]:
            np.add(now[:1], first, out=room)
            np.add(now[1:], inner, out=more)
            np.maximum(room, more, out=room)
            np.maximum(room, enter, out=room)
            np.add(room, y, out=now)
            np.maximum(top, now, out=top)
        return np.maximum(top + leave, now).max(axis=0)

    def marginals(self, e: np.ndarray):
        """Forward-backward over e, scaled at each step: tag marginals, expected transitions, log partition."""
        top, m = e.max(axis=2, keepdims=True), np.exp(self.p["T"])
        x, a, b = np.exp(e - top), np.empty_like(e), np.ones_like(e)
        total = np.empty_like(top)
        for i in range(len(e)):
            a[i] = (a[i - 1] @ m) * x[i] if i else x[0]
            total[i] = a[i].sum(axis=1, keepdims=True)
            a[i] /= total[i]
        for i in range(len(e) - 2, -1, -1):
            b[i] = (x[i + 1] * b[i + 1] / total[i + 1]) @ m.T
        pair = m * (a[:-1].reshape(-1, TAGS).T @ (x[1:] * b[1:] / total[1:]).reshape(-1, TAGS))
        return a * b, pair, (np.log(total) + top).sum(axis=(0, 2))

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        e, (x, h, both, tape) = self.emissions(ids, True)
        t, n, _ = e.shape
        prob, pair, _ = self.marginals(e)
        y = tags.T
        prob[np.arange(t)[:, None], np.arange(n), y] -= 1
        np.subtract.at(pair, (y[:-1], y[1:]), 1)
        de, g = prob / n, {"T": pair / n}
        g["Wo"], g["bo"] = both.reshape(t * n, -1).T @ de.reshape(t * n, -1), de.sum(axis=(0, 1))
        dh = de @ self.p["Wo"].T
        dh = np.stack([dh[:, :, :self.hidden], dh[::-1, :, self.hidden:]], axis=1)
        dz, back = np.empty((t, 2, n, 4 * self.hidden), e.dtype), self.p["Wh"].transpose(0, 2, 1)
        nh, nc = np.zeros((2, n, self.hidden), e.dtype), np.zeros((2, n, self.hidden), e.dtype)
        for i in range(t - 1, -1, -1):
            s, a, before, tc = tape[i]
            f, gi, o = s[:, :, :self.hidden], s[:, :, self.hidden : 2 * self.hidden], s[:, :, 2 * self.hidden :]
            own = dh[i] + nh
            c = nc + own * o * (1 - np.abs(tc)) ** 2
            dz[i, :, :, :self.hidden], dz[i, :, :, self.hidden : 2 * self.hidden] = c * before, c * a
            dz[i, :, :, 2 * self.hidden : 3 * self.hidden], dz[i, :, :, 3 * self.hidden :] = own * tc, c * gi * (1 - np.abs(a)) ** 2
            dz[i, :, :, : 3 * self.hidden] *= 0.5 * (1 - np.abs(2 * s - 1)) ** 2
            nh, nc = dz[i] @ back, c * f
        flat = lambda v: v.transpose(1, 0, 2, 3).reshape(2, t * n, -1)
        g["Wx"], g["Wh"], g["b"] = flat(x).transpose(0, 2, 1) @ flat(dz), flat(h[:-1]).transpose(0, 2, 1) @ flat(dz), dz.sum(axis=(0, 2))[:, None, :]
        dx = dz @ self.p["Wx"].transpose(0, 2, 1)
        seen = (np.arange(CHARS)[:, None] == ids.T.reshape(-1)).astype(e.dtype)
        g["E"] = seen @ (dx[:, 0] + dx[::-1, 1]).reshape(t * n, -1)
        return g

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 48, rate: float = 0.02, seed: int = 5) -> None:
        """Adam over shuffled batches, with a rate that falls to a twentieth."""
        steps = max(1, epochs * -(-len(ids) // batch))
        r, m, v, step = np.random.default_rng(seed), {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for _ in range(epochs):
            order = r.permutation(len(ids))
            for i in range(0, len(order), batch):
                step += 1
                now = rate * (1 - 0.95 * step / steps)
                for k, g in self.gradients(ids[order[i : i + batch]], tags[order[i : i + batch]]).items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of each window (Viterbi), and how sure each is (its marginal, 0 in windows without any span)."""
        tags, sure = np.zeros(ids.shape, dtype=np.int64), np.zeros(ids.shape, dtype=self.p["E"].dtype)
        e = self.quick_emissions(ids)
        some = self.candidates(e)
        tags[some], sure[some] = self.best(e[:, :, some])
        return tags, sure

    def best(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of quick emissions."""
        e = e.transpose(0, 2, 1)
        tags = self.path(e)
        sure, some = np.zeros(tags.shape, e.dtype), np.flatnonzero(tags.any(axis=1))
        if len(some):
            sure[some] = np.take_along_axis(self.marginals(np.ascontiguousarray(e[:, some]))[0].transpose(1, 0, 2), tags[some][:, :, None], axis=2)[:, :, 0]
        return tags, sure

    def path(self, e: np.ndarray) -> np.ndarray:
        """Viterbi's best tags for emissions e (time first), a row for each window."""
        t, n, _ = e.shape
        x, step = np.ascontiguousarray(e.transpose(0, 2, 1)), self.p["T"]
        best, room = np.empty_like(x), np.empty((TAGS, TAGS, n), x.dtype)
        best[0] = x[0]
        for i in range(1, t):
            np.add(best[i - 1][:, None], step[:, :, None], out=room)
            np.max(room, axis=0, out=best[i])
            best[i] += x[i]
        tags = np.zeros((t, n), dtype=np.int64)
        tags[-1] = best[-1].argmax(axis=0)
        for i in range(t - 1, 0, -1):  # the tag before that led to the best score
            tags[i - 1] = (best[i - 1] + step[:, tags[i]]).argmax(axis=0)
        return tags.T


def generated(n: int, seed: int = 3, stretches: tuple[str, ...] = ()) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled windows with further spellings, and numbers and codes that are no personal data, each cut at random from
    a longer text of made-up words or of one of the ``stretches`` without triggers."""
    r, out = random.Random(seed), []
    word = lambda: "".join(r.choice("aeinorstlhdumcgpbéüß"[: r.choice([13, 17, 17, 20])]) for _ in range(r.randint(2, 9)))
    plain = lambda: "".join(r.choice("aeinorstlhdumcgpb") for _ in range(r.randint(2, 9)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexed = lambda k: "%0*x" % (k, r.getrandbits(4 * k))
    tail = lambda: r.choice(["com", "org", "net", "de", "fr", "io", "co.uk", "example.com"])
    host = lambda: f"{plain()}{r.choice(['', num(1), '-' + plain()])}"
    case = lambda s: r.choice([s, s, s.title(), s.upper()])

    def grouped(s: str, sep: str) -> str:
        return sep.join(s[i : i + 4] for i in range(0, len(s), 4))

    def checked(valid: bool = True) -> str:
        base = r.choice("3456") + num(14)
        return base + r.choice([x for x in "0123456789" if luhn(base + x) == valid])

    def spelled() -> str:
        at, dot = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" AT ", " DOT "), ("[at]", "[dot]")])
        return f"{plain()}{r.choice(['', '.' + plain(), dot + plain(), num(2)])}{at}{host()}{dot}{r.choice(['com', 'org', 'net', 'de'])}"

    def six() -> str:
        parts = [format(r.getrandbits(r.choice([4, 8, 16, 16])), "x") for _ in range(8)]
        k = r.randint(2, 5)
        return r.choice([":".join(parts), "2" + ":".join(parts[:k])[1:] + "::" + ":".join(parts[k + 1 :]), f"fe80::{num(1)}" + ":".join(parts[:3]), f"2001:db8::{num(2)}"])

    def key() -> tuple[str, str]:
        name = r.choice(["token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "auth_token", "client_secret", "key"])
        value = r.choice([hexed(40), hexed(32), hexed(r.randint(16, 44)), "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(r.randint(10, 30))), num(1) + "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789_-") for _ in range(r.randint(10, 38)))])
        quote = r.choice(['"', "'", "", '"'])
        return f"{case(name)}{r.choice([' = ', '=', ': ', ':'])}{quote}", value + "|" + quote

    make = {
        "email": lambda: r.choice([lambda: f"{case(word())}{r.choice(['', '.', '_', '.'])}{r.choice([word(), num(2)])}@{host()}.{tail()}", spelled])(),
        "ip": lambda: r.choice([lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), six])(),
        "card": lambda: grouped(checked(), r.choice([".", "/", "  ", " . ", "_", "\u00a0", " - "])),
        "phone": lambda: r.choice([
            lambda: f"+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", lambda: f"+{r.randint(1, 99)} {num(3)} {num(7)}", lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}",
            lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"00{r.randint(10, 99)} {num(2)} {num(7)}", lambda: f"0{num(2)} / {num(7)}", lambda: "0" + r.choice("123456") + "".join(f" {num(2)}" for _ in range(4)), lambda: f"0{num(3)}-{num(6)}",
        ])(),
    }
    other = [
        lambda: num(r.randint(1, 6)), lambda: hexed(r.choice([18, 32, 40])), lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(1)}.{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: f"v{num(1)}.{num(1)}.{num(1)}",
        lambda: "@" + word(), lambda: f"| {num(2)} | {num(3)} |", lambda: checked(r.random() < 0.1), lambda: grouped(checked(False), r.choice([" ", "-"])), lambda: num(r.randint(9, 19)), lambda: f"{num(3)},{num(3)},{num(3)}",
        lambda: f"{num(2)}.{num(2)}.{num(4)}", lambda: f"{word()} dot {word()}", lambda: f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", lambda: f"{num(4)}-{num(2)}-{num(2)} {num(2)}:{num(2)}:{num(2)}", lambda: f"{num(2)}-{num(2)}", lambda: f"BY-NC {num(1)}.0", lambda: f"sha256 {hexed(40)}", lambda: f"{num(1)}.{num(1)}.{num(1)}.{r.randint(300, 9999)}",
    ]
    for _ in range(n):
        some = lambda sep: sep.join([case(word())] * r.randint(5, 20) if r.random() < 0.1 else [case(word()) for _ in range(r.randint(1, 7))])
        fill = lambda: r.choice(stretches) if stretches and r.random() < 0.6 else some(" ") if r.random() < 0.9 else some("!! ").upper()
        text, spans = fill(), []
        for _ in range(r.choice([0, 1, 1, 2, 2, 2, 3, 3, 3])):
            text += r.choice([" ", " ", " ", "\n", ": ", ", ", " | "])
            kind = r.choice([*KINDS, "", "", ""])
            if kind == "secret":
                lead, value = key()
                value, quote = value.rsplit("|", 1)
                spans.append((kind, len(text) + len(lead), len(text) + len(lead) + len(value)))
                text += lead + value + quote
            elif kind:
                s = make[kind]()
                spans.append((kind, len(text), len(text) + len(s)))
                text += s
            else:
                text += r.choice(other)()
            text += r.choice(["", "", ",", ".", "!!", ";"]) + r.choice([" ", " ", "\n"]) + fill()
        text += "" if spans or r.random() < 0.5 else " " + fill()
        at = max(0, r.randint(-40, max(0, len(text) - 60)))
        out.append((text[at : at + WIDTH], [(k, max(a - at, 0), min(z - at, WIDTH)) for k, a, z in spans if a - at < WIDTH and z > at]))
    return out


def padded(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), WIDTH), dtype=np.int64)
    for i, t in enumerate(texts):
        out[i, : len(t)] = char_ids(t)
    return out


def quiet(text: str) -> list[str]:
    """Stretches of a text without triggers, cut at blanks."""
    return [x.strip() for x in _TRIGGER.split(text) if len(x.strip()) >= 12]


def smallest(batches: Iterator[Iterator[tuple[str, int, str]]], n: int) -> Iterator[pa.RecordBatch]:
    """Labelled windows of (hash, start, text): of a task's those with the n smallest hashes, with some more. Texts are labelled when
    their windows are chosen."""
    seen: list[str] = []  # smallest hashes so far
    for rows in batches:
        last = seen[-1] if len(seen) >= n else "g"  # after all hashes
        rows = sorted((r for r in rows if r[0] <= last), key=lambda r: r[0])[:n]
        seen = sorted([*seen, *(r[0] for r in rows)])[:n]
        spans = {x: labelled(x) for x in {r[2] for r in rows}}
        out = [[at for at, _, _ in rows], [x[s : s + WIDTH] for _, s, x in rows], [tags_of(spans[x], s, min(WIDTH, len(x) - s)).tolist() for _, s, x in rows]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.string(), pa.string(), pa.list_(pa.int64())), strict=True)], ["at", "part", "tags"])


def fit(docs: DataFrame, sample_windows: int = 2500, generated_windows: int = 24000, epochs: int = 5, text: str = "text", plain_windows: int = 2500) -> bytes:
    """Train a tagger; its parameters, pickled. ``sample_windows`` bounds the corpus windows: those with the smallest
    hash, of all windows of all texts that hold a trigger; ``plain_windows`` bounds those drawn from all windows, one at a
    hashed place of each text. Null texts teach nothing; without any text it learns from made-up windows."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(b: pa.RecordBatch) -> Iterator[tuple[str, int, str]]:
            for x in filter(None, b.column(0).to_pylist()):
                digest = hashlib.md5(x.encode("utf-8", "surrogatepass")).hexdigest()
                yield digest, int(digest[:12], 16) % max(1, len(x) - WIDTH), x

        return smallest(map(rows, batches), plain_windows)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(b: pa.RecordBatch) -> Iterator[tuple[str, int, str]]:
            col = b.column(0).fill_null("")
            for x in col.filter(pc.match_substring_regex(col, TRIGGER)).to_pylist():
                for s in windows(x):
                    yield hashlib.md5(x[s : s + WIDTH].encode("utf-8", "surrogatepass")).hexdigest(), s, x

        return smallest(map(rows, batches), sample_windows)

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group[group["part"].notna()].sort_values(["at", "part"])
        made = generated(generated_windows, stretches=tuple(x for part in group["part"] for x in quiet(part)))
        ids = np.concatenate([padded(group["part"].tolist()), padded([t for t, _ in made])])
        tags = np.concatenate([*[np.asarray(x, dtype=np.int64).reshape(1, -1) for x in group["tags"]], *[tags_of(s, 0, len(t)).reshape(1, -1) for t, s in made]])
        tagger = Tagger(hidden=16)
        tagger.fit(ids, tags, epochs)
        return pd.DataFrame({"model": [pickle.dumps(tagger.p)]})

    spark = docs.sparkSession
    texts, kinds = docs.select(F.col(text).cast("string").alias("text")), "at string, part string, tags array<long>"
    some = texts.mapInArrow(examples, kinds).orderBy("at", "part").limit(sample_windows)
    some = some.unionByName(texts.mapInArrow(drawn, kinds).orderBy("at", "part").limit(plain_windows))
    one = spark.createDataFrame([(None, None, None)], "at string, part string, tags array<long>")  # trains on generated windows where there are none
    return bytes(some.unionByName(one).groupBy(F.lit("all").alias("part_")).applyInPandas(train, "model binary").first()[0])


def decoded(tagger: Tagger, texts: list[str], sure: float) -> list[list[tuple[int, float, str, int, int]]]:
    """Of each text the spans its windows are ``sure`` of: how far inside its window each lies (an end of the text counts
    as far), its mean marginal, kind, start and stop, without white space at its ends."""
    ids = classes()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    ids, first = np.concatenate([ids, np.zeros(LONG + ROUND, np.uint8)]), np.cumsum([0, *map(len, texts)])
    found: list[list[tuple]] = [[] for _ in texts]
    for width, place in sorted(by_width(texts).items()):
        blocks, inside, held = -(-len(place) // BLOCK), np.arange(width), []
        for k in range(blocks):
            part = place[k * len(place) // blocks : (k + 1) * len(place) // blocks]
            some = ids[np.array([first[i] + s for i, s in part])[:, None] + inside]
            some[inside >= np.array([len(texts[i]) - s for i, s in part])[:, None]] = 0
            e = tagger.quick_emissions(some)
            held += [(*part[w], e[:, :, w].copy()) for w in tagger.candidates(e).tolist()]
            if not held or len(held) < BLOCK and k + 1 < blocks:
                continue
            tags, prob = tagger.best(np.stack([x for _, _, x in held], axis=2))
            for row in np.flatnonzero(tags.any(axis=1)).tolist():
                i, s, _ = held[row]
                found[i] += window_spans(texts[i], s, width, tags[row], prob[row], sure)
            held = []
    return found


def by_width(texts: list[str]) -> dict[int, list[tuple[int, int]]]:
    """Windows to decode, as places of the text and their starts, by their padded width, which depends on the text alone."""
    out: dict[int, list[tuple[int, int]]] = {}
    for i, t in enumerate(texts):
        width, starts = places(len(t))
        if starts:
            out.setdefault(width, []).extend((i, s) for s in starts)
    return out


def window_spans(text: str, s: int, width: int, tags: np.ndarray, prob: np.ndarray, sure: float) -> list[tuple]:
    """The spans of a window that starts at ``s``, as ``decoded`` gives them."""
    out, size, a = [], min(width, len(text) - s), 0
    while a < size:
        kind = (int(tags[a]) - 1) // 2
        if kind < 0:
            a += 1
            continue
        z = a + 1
        while z < size and tags[z] == 2 + 2 * kind:
            z += 1
        p, word = float(prob[a:z].mean()), text[s + a : s + z]
        if p >= sure and word.strip():
            inside = min(a if s else LONG, width - z if s + width < len(text) else LONG)
            out.append((inside, p, KINDS[kind], s + z - len(word.lstrip()), s + a + len(word.rstrip())))
        a = z
    return out


def reconciled(found: list[tuple[int, float, str, int, int]], base: list[tuple[str, int, int]], text: str) -> list[tuple[str, int, int]]:
    """One text's added spans: in order of depth in the window, then sureness, each that overlaps none before. One that touches
    pattern spans must hold them whole, be of their kind and go further without a blank, as an address with a letter that its
    pattern doesn't know: a neighbouring word or number is no part of what the pattern found. Spans at a window's very edge
    are cut off ones: none of them."""
    keep: list[tuple[str, int, int]] = []

    def grows(kind: str, a: int, z: int) -> bool:
        touched = [b for b in base if b[1] < z and a < b[2]]
        whole = all(k == kind and a <= x and y <= z and z - a > y - x for k, x, y in touched)
        return whole and not (touched and any(c.isspace() for x, y in ((a, min(b[1] for b in touched)), (max(b[2] for b in touched), z)) for c in text[x:y]))

    for inside, _, kind, a, z in sorted(set(found), key=lambda x: (-x[0], -x[1], x[2:])):
        if inside > 0 and all(z <= x or y <= a for _, x, y in keep) and grows(kind, a, z):
            keep.append((kind, a, z))
    return keep


def text_spans(tagger: Tagger, col: pa.Array, sure: float) -> Iterator[tuple[int, list, list]]:
    """Rows of a column that have pattern or added spans, with the pattern ones and all, by kind, then start."""
    ends = np.cumsum(pc.utf8_length(col).to_numpy(zero_copy_only=False), dtype=np.int64) // GROUP
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(col)]
    for k, stop in itertools.pairwise(cuts):
        texts = col.slice(k, stop - k).to_pylist()
        base = [pattern_spans(t) for t in texts]
        for i, t, own, more in zip(range(k, stop), texts, base, decoded(tagger, texts, sure), strict=True):
            every = sorted([*own, *reconciled(more, own, t)], key=lambda s: (KINDS.index(s[0]), *s[1:]))
            if every:
                yield i, own, every


def personal_data(docs: DataFrame, model: bytes, sure: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id, base, spans``: the patterns' spans and all, arrays of (kind, start, stop), code points, stop
    exclusive, by kind as in KINDS, then start. Null and empty texts have none; null ids stay null; repeated rows are
    answered each; an empty table gives an empty one; other columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger()
        tagger.p = pickle.loads(sent.value)
        listed = lambda spans: [dict(zip(("kind", "start", "stop"), s, strict=True)) for s in spans]
        for b in batches:
            base, every = [[]] * b.num_rows, [[]] * b.num_rows
            for i, x, y in text_spans(tagger, b.column(1).fill_null(""), sure):
                base[i], every[i] = listed(x), listed(y)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, span), pa.array(every, span)], ["doc_id", "base", "spans"])

    kind = "array<struct<kind: string, start: long, stop: long>>"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, base {kind}, spans {kind}")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    parts, stop = [], 0
    for kind, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= stop:
            parts += [text[stop:a], f"<{kind.upper()}>"]
        stop = max(stop, z)
    return "".join(parts) + text[stop:]


def redacted(docs: DataFrame, model: bytes, sure: float = 0.8, text: str = "text") -> DataFrame:
    """``docs`` with each personal span of ``text`` replaced by its kind, as in ``<EMAIL>``; of overlapping spans the
    stretch they cover together takes the first one's kind. Null texts stay null, all other columns as they are. Spans are
    found and replaced in one pass."""
    columns = docs.columns
    at, sent = columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger()
        tagger.p = pickle.loads(sent.value)
        for b in batches:
            texts = b.column(at)
            found = {i: y for i, _, y in text_spans(tagger, texts.fill_null(""), sure)}
            if found:
                out = texts.to_pylist()
                for i, spans in found.items():
                    out[i] = masked(out[i], spans)
                texts = pa.array(out, texts.type)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], texts, *b.columns[at + 1 :]], [f"in_{i}" for i in range(len(columns))])

    rows = docs.select(*[(F.col(c).cast("string") if c == text else F.col(c)).alias(f"in_{i}") for i, c in enumerate(columns)])
    types = ", ".join(f"in_{i} {t}" for i, t in enumerate(f.dataType.simpleString() for f in rows.schema.fields))
    return rows.mapInArrow(run, types).toDF(*columns)
