"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions that adds spans.

The base finds e-mail addresses, IP addresses, card and phone numbers by pattern, leftmost and
without overlap for each kind; matches that fail their check are dropped. All searches take time
linear in the text. The model is a bidirectional LSTM over character classes whose scores feed a
linear-chain CRF, trained here in numpy, by gradient of the exact log-likelihood, from labelled
spans: windows of invented text in which spans of the kinds, in forms that the patterns know and
in others (phone numbers without a plus, addresses spelled with "at" and "dot", IPv6, cards with
other separators, access tokens), and look-alikes that are none, are planted. Texts are cut into
overlapping windows; the scores of a position in all its windows are averaged, weighted by how
far inside the window it lies, and one Viterbi pass over each run of overlapping windows decodes
it globally. A window without a TRIGGER is not scored: no span lacks one. Spans of the model are
kept if they pass the check of their kind and touch no base span; of overlapping ones the
leftmost, then the longest, stays. Access tokens are the kind ``secret``: ``redact`` replaces
them, ``find`` gives them in a column of their own.

Null and empty texts have no spans. Repeated rows give repeated results, equal texts the same
spans. Only ``doc_id`` and ``text`` are read; empty tables give empty results; windows go
through the model in batches over many texts, so memory is bounded by a slice of texts or by the
longest text.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import ipaddress
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The same matches as PATTERNS["ip"]: if a run of digits can't begin a match, no later place in it can.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGIT = re.compile("[0-9]")
DIGITS_12 = re.compile(r"[0-9]([\x20-]?[0-9]){11}")
TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]|\x20at\x20[a-z0-9-]+(?:\.[a-z0-9-]|\x20?[\[(]dot[\])]|\x20dot\x20)|:[0-9a-f]*:", re.I)
#: What the model tags: the kinds of the base, and secrets.
TAGGED = (*KINDS, "secret")
WINDOW, STRIDE, BATCH = 96, 64, 512
HIDDEN, EPOCHS, TRAIN_WINDOWS, RATE = 32, 6, 4000, 0.02
TAGS = 1 + 2 * len(TAGGED)
CLASSES = 64


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    """Whether a decimal number of any length is at most 255."""
    x = part.lstrip("0")
    return len(x) < 4 and int(x or "0") <= 255


def valid(kind: str, s: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(map(_small, s.split(".")))
    digits = "".join(DIGIT.findall(s))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By start, then by kind in the order of KINDS. The screens only skip texts that can't match."""
    out = []
    if "@" in text:
        out += [("email", m.start(), m.end()) for m in _emails(text)]
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if valid("ip", m[0])]
        if DIGITS_12.search(text):
            out += [("card", *m.span()) for m in PATTERNS["card"].finditer(text) if valid("card", m[0])]
        if "+" in text:
            out += [("phone", *m.span()) for m in PATTERNS["phone"].finditer(text) if valid("phone", m[0])]
    return sorted(out, key=_order)


_HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def _emails(text: str):
    """Matches of the pattern, found from each @: the same ones, in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        if start < at and _HOST.match(text, at):
            m = PATTERNS["email"].match(text, start)
            yield m
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _order(span: tuple[str, int, int]):
    return span[1], TAGGED.index(span[0]), span[2]


def spell(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- character classes and labelled windows -----------------------------------------------

_CLASS = np.full(0x250, 3, np.uint8)  # other letters
_CLASS[ord("0") : ord("9") + 1] = 1
_CLASS[[9, 10, 11, 12, 13, 32]] = 2
for _i in range(26):
    _CLASS[65 + _i] = _CLASS[97 + _i] = 5 + _i
for _i, _c in enumerate("@.+-()_%/:=#\"',&*!?;<>[]{}|$~\\"):
    _CLASS[ord(_c)] = 31 + _i


def classes(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(x < 0x250, _CLASS[np.minimum(x, 0x24F)], 4).astype(np.intp)


def _planted(rng: random.Random) -> list[tuple[str, str | None]]:
    """Pieces of text, each with its kind or none."""
    one = rng.choice
    d = lambda n: "".join(one("0123456789") for _ in range(n))
    w = lambda a, b: "".join(one("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    hexa = lambda n: "".join(one("0123456789abcdef") for _ in range(n))
    cased = lambda x: x.upper() if rng.random() < 0.15 else x
    kind = one([*TAGGED, *TAGGED, None, None, None])
    if kind == "email":
        at, dot = one([("@", "."), ("@", "."), ("@", "."), (" at ", " dot "), ("(at)", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)")])
        name = one([f"{w(3, 9)}.{d(2)}", f"{w(2, 8)}_{w(2, 6)}", w(3, 8), f"{w(1, 1)}.{w(3, 9)}", f"{w(3, 7)}{d(3)}", f"{w(3, 6)}+{w(2, 5)}"])
        return [(cased(name + at + dot.join([w(3, 9) + one(["", d(1)]), *([w(3, 8)] if rng.random() < 0.3 else []), one(["com", "org", "net", "de", "fr", "es", w(2, 5)])])), kind)]
    if kind == "ip":
        if rng.random() < 0.25:
            g = [hexa(rng.randint(1, 4)) for _ in range(8)]
            cut = rng.randint(1, 6)
            return [(one([":".join(g), ":".join(g[:cut]) + "::" + ":".join(g[cut + 1 :]), f"2001:db8::{hexa(rng.randint(1, 4))}", f"fe80::{hexa(4)}:{hexa(4)}"]), kind)]
        ip = ".".join(str(rng.randint(0, 255)) for _ in range(4))
        return one([[(ip, kind)], [(ip, kind)], [(ip, kind), (":" + d(4), None)], [("http://", None), (ip, kind), ("/" + w(2, 5), None)]])
    if kind == "card":
        body = one("3456") + d(one([13, 14, 14, 14]))
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = one(["", "", " ", "-", ".", "  ", " - "])
        return [(sep.join(body[i : i + 4] for i in range(0, len(body), 4)), kind)]
    if kind == "phone":
        return [(one([f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(11)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)}/{d(7)}", f"0{d(3)} {d(3)} {d(4)}", f"00{d(2)} {d(3)} {d(6)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+{d(2)}-{d(4)}-{d(6)}"]), kind)]
    if kind == "secret":
        key = one([hexa(32), hexa(40), hexa(40), hexa(rng.randint(33, 39)), "AKIA" + w(8, 8).upper() + d(2) + w(6, 6).upper(), "ghp_" + "".join(one("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(36))])
        lead, tail = one([('token = "', '"'), ('token = "', '"'), ("password=", ""), ("api_key: ", ""), ("secret='", "'"), ('"key": "', '"'), ("", "")])
        return [(cased(lead), None), (cased(key), kind), (tail, None)]
    bad = d(15)
    bad += next(c for c in "9876543210" if not luhn(bad + c))
    return [(one([
        f"{d(1)}.{d(1)}", d(4), f"version {d(1)}", f"{d(2)}:{d(2)}", f"{w(2, 4)}-{d(2)}", f"{d(1)},{d(3)}", f"@{w(3, 8)}", f"{d(4)}-{d(2)}-{d(2)}", f"{d(3)}.{d(2)}", f"{d(1)}.{d(1)}.{d(2)}", f"v{d(1)}.{d(2)}.{d(1)}",
        bad, d(rng.randint(5, 8)), f"{d(1)},{d(3)},{d(3)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(2)}.{d(2)}.{d(4)}", f"#{d(5)}", f"${d(3)}.{d(2)}", f"{d(4)}-{d(4)}", f"({d(4)})", f"{d(3)} {w(3, 6)} {d(3)}", f"{d(2)}:{d(2)}:{d(2)}", "look at the dot", f"{w(3, 6)} at {w(3, 6)}",
        f"{300 + int(d(2))}.{d(3)}.{d(1)}.{d(1)}", f"ISBN {d(3)}-{d(1)}-{d(2)}", f"{d(2)} %", f"{w(12, 24)}", f"{w(5, 9)}_{w(5, 9)}_{d(1)}", f"page {d(3)}", f"{d(1)}) {w(3, 5)}",
    ]), None)]


def labelled_windows(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Character classes and tags (0 outside, then begin and inside of each kind) of n windows."""
    rng = random.Random(seed)
    syllable = ["th", "an", "er", "ing", "ion", "de", "que", "ló", "ü", "ent", "os", "re", "ou", "ge", "é", "sch", "at", "dot", "to", "ken"]
    xs, ys = np.zeros((n, WINDOW), np.intp), np.zeros((n, WINDOW), np.intp)
    for i in range(n):
        text, tags = "", []
        noise, shout = rng.choice(["", "", "", "", "!!", "|", "%%%", "&&&", "$$$"]), rng.random() < 0.1
        while len(text) < WINDOW + 40:
            if rng.random() < 0.3:
                pieces = [*_planted(rng), (rng.choice(["", "", "", ".", ",", ";", ")"]), None)]
            else:
                s = "".join(rng.choice(syllable) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ".", ",", ":"])
                pieces = [(s.upper() if shout else s.capitalize() if rng.random() < 0.2 else s, None)]
            for s, kind in [*pieces, (noise + (" " if rng.random() < 0.95 else "\n"), None)]:
                k = 0 if kind is None else 1 + 2 * TAGGED.index(kind)
                tags += [k + (k > 0 and j > 0) for j in range(len(s))]
                text += s
        at = rng.randint(0, 40)
        xs[i], ys[i] = classes(text)[at : at + WINDOW], tags[at : at + WINDOW]
    return xs, ys


# ---- the model ----------------------------------------------------------------------------


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Parameters: for each direction input rows (CLASSES, 4H), recurrent (H, 4H); output (2H, TAGS); CRF."""

    def __init__(self, seed: int = 5, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        self.h = hidden
        self.p = {"wx0": init(CLASSES, 4 * hidden), "wh0": init(hidden, 4 * hidden), "wx1": init(CLASSES, 4 * hidden), "wh1": init(hidden, 4 * hidden), "wo": init(2 * hidden, TAGS), "bo": np.zeros(TAGS, np.float32), "tr": init(TAGS, TAGS)}

    def _lstm(self, x: np.ndarray, k: int, keep: bool):
        """Hidden states (T, N, H) for classes x (N, T)."""
        n, t = x.shape
        h = self.h
        wx, wh = self.p[f"wx{k}"], self.p[f"wh{k}"]
        hs, cache = np.zeros((t, n, h), np.float32), []
        hp, cp = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for s in range(t) if k == 0 else range(t - 1, -1, -1):
            z = wx[x[:, s]] + hp @ wh
            g = _sigmoid(z[:, : 3 * h])
            u = np.tanh(z[:, 3 * h :])
            c = g[:, h : 2 * h] * cp + g[:, :h] * u
            tc = np.tanh(c)
            if keep:
                cache.append((s, hp, cp, g, u, tc))
            hp, cp = g[:, 2 * h :] * tc, c
            hs[s] = hp
        return hs, cache

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Tag scores (T, N, TAGS)."""
        return np.concatenate([self._lstm(x, 0, False)[0], self._lstm(x, 1, False)[0]], axis=2) @ self.p["wo"] + self.p["bo"]

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags and its gradient."""
        (n, t), h, p = x.shape, self.h, self.p
        (h0, c0), (h1, c1) = self._lstm(x, 0, True), self._lstm(x, 1, True)
        hs = np.concatenate([h0, h1], axis=2)
        e = hs @ p["wo"] + p["bo"]
        tr = p["tr"]
        alpha, beta = np.zeros((t, n, TAGS), np.float32), np.zeros((t, n, TAGS), np.float32)
        alpha[0] = e[0]
        for s in range(1, t):
            m = alpha[s - 1].max(1, keepdims=True)
            alpha[s] = e[s] + m + np.log(np.exp(alpha[s - 1] - m) @ np.exp(tr))
        for s in range(t - 2, -1, -1):
            b = beta[s + 1] + e[s + 1]
            m = b.max(1, keepdims=True)
            beta[s] = m + np.log(np.exp(b - m) @ np.exp(tr).T)
        m = alpha[-1].max(1, keepdims=True)
        logz = (m + np.log(np.exp(alpha[-1] - m).sum(1, keepdims=True)))[:, 0]
        de = np.exp(alpha + beta - logz[None, :, None])
        rows = np.arange(n)
        gold = sum(e[s, rows, y[:, s]] for s in range(t)) + sum(tr[y[:, s - 1], y[:, s]] for s in range(1, t))
        dtr = np.zeros_like(tr)
        for s in range(1, t):
            de[s - 1, rows, y[:, s - 1]] -= 1
            b = beta[s] + e[s]
            ma, mb = alpha[s - 1].max(1, keepdims=True), b.max(1, keepdims=True)
            dtr += np.exp(tr) * ((np.exp(alpha[s - 1] - ma) * np.exp(ma + mb - logz[:, None])).T @ np.exp(b - mb))
            np.subtract.at(dtr, (y[:, s - 1], y[:, s]), 1)
        de[t - 1, rows, y[:, t - 1]] -= 1
        de /= n
        g = {"tr": dtr / n, "wo": np.einsum("tnh,tnk->hk", hs, de), "bo": de.sum((0, 1))}
        dhs = de @ p["wo"].T
        for k, cache in ((0, c0), (1, c1)):
            wh = p[f"wh{k}"]
            dwx, dwh = np.zeros_like(p[f"wx{k}"]), np.zeros_like(wh)
            dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for s, hp, cp, gate, u, tc in reversed(cache):
                dh = dh + dhs[s][:, k * h : (k + 1) * h]
                i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * u * i * (1 - i), dc * cp * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1)
                np.add.at(dwx, x[:, s], dz)
                dwh += hp.T @ dz
                dh, dc = dz @ wh.T, dc * f
            g[f"wx{k}"], g[f"wh{k}"] = dwx, dwh
        return float((logz - gold).mean()), g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 50) -> float:
        rng = np.random.default_rng(3)
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step, loss, total = 0, 0.0, epochs * ((len(x) + batch - 1) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                loss, g = self.gradient(x[order[at : at + batch]], y[order[at : at + batch]])
                norm = float(np.sqrt(sum((v * v).sum() for v in g.values())))
                step += 1
                rate = RATE * (1 - step / (total + 1))
                for k, v in g.items():
                    v = v * min(1.0, 5 / norm)
                    a, b = m[k]
                    a *= 0.9
                    a += 0.1 * v
                    b *= 0.99
                    b += 0.01 * v * v
                    self.p[k] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
        return loss

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tags for scores (T, TAGS)."""
        back = np.zeros(e.shape, np.int8)
        best = e[0]
        for s in range(1, len(e)):
            step = best[:, None] + self.p["tr"]
            back[s] = step.argmax(0)
            best = step.max(0) + e[s]
        out = np.zeros(len(e), np.intp)
        out[-1] = best.argmax()
        for s in range(len(e) - 1, 0, -1):
            out[s - 1] = back[s, out[s]]
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Spans of whole texts from overlapping windows, decoded together; windows of all texts share batches."""
        found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        runs: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # text, begin, sums of weighted scores, sums of weights
        wait: list[tuple[int, int, np.ndarray]] = []  # run, start, classes

        def score() -> None:
            block = np.zeros((len(wait), WINDOW), np.intp)
            for j, (_, _, part) in enumerate(wait):
                block[j, : len(part)] = part
            e = self.scores(block)
            for j, (r, s, part) in enumerate(wait):
                _, begin, total, weight = runs[r]
                n = len(part)
                total[s - begin : s - begin + n] += e[:n, j] * _CENTRE[:n]
                weight[s - begin : s - begin + n] += _CENTRE[:n]
            wait.clear()

        for t, text in enumerate(texts):
            hits = np.array([m.start() for m in TRIGGER.finditer(text)])
            if not len(hits):
                continue
            last = max(0, -(-(len(text) - WINDOW) // STRIDE))
            # every window with a trigger and its neighbours, so that a span that starts or ends in plain letters is inside
            near = np.unique(np.clip(np.concatenate([hits // STRIDE + k for k in (-2, -1, 0, 1)]), 0, last))
            x = classes(text)
            for run in np.split(near, np.flatnonzero(np.diff(near) > 1) + 1):
                begin, end = int(run[0]) * STRIDE, min(len(x), int(run[-1]) * STRIDE + WINDOW)
                runs.append((t, begin, np.zeros((end - begin, TAGS), np.float32), np.zeros((end - begin, 1), np.float32)))
                for s in (run * STRIDE).tolist():
                    wait.append((len(runs) - 1, s, x[s : s + WINDOW]))
                    if len(wait) == BATCH:
                        score()
        if wait:
            score()
        for t, begin, total, weight in runs:
            tags = self.viterbi(total / np.maximum(weight, 1)).tolist()
            at = 0
            while at < len(tags):
                if not tags[at]:
                    at += 1
                    continue
                kind, start = (tags[at] - 1) // 2, at
                at += 1
                while at < len(tags) and tags[at] == 2 + 2 * kind:
                    at += 1
                found[t].append((TAGGED[kind], begin + start, begin + at))
        return found


_CENTRE = (1 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])).astype(np.float32)[:, None]
#: What a span of the model must look like, besides the check of its kind.
SHAPES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+(?:@|\x20?[(\[]at[)\]]\x20?|\x20at\x20)[A-Za-z0-9-]+(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]+)+\Z", re.I),
    "ip": re.compile(r"[0-9]++(?:\.[0-9]++){3}\Z|(?=[0-9A-Fa-f:]{3,39}\Z)[0-9A-Fa-f]*:[0-9A-Fa-f]*:[0-9A-Fa-f:]*\Z"),
    "card": re.compile(r"[0-9](?:[\x20.-]{0,3}[0-9])+\Z"),
    "phone": re.compile(r"[+(0-9][\x20()./0-9-]+[0-9]\Z"),
    "secret": re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}\Z"),
}


def accepted(kind: str, s: str) -> bool:
    """Whether a span of the model looks like its kind and passes its check."""
    if not SHAPES[kind].match(s):
        return False
    if kind == "ip" and ":" in s:
        try:
            return ipaddress.ip_address(s).version == 6
        except ValueError:
            return False
    return kind == "secret" or valid(kind, s)


def add_spans(tagged: list[tuple[str, int, int]], text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans, and those of the model that are accepted and touch no base span."""
    taken: list[list[int]] = []
    for _, a, b in base:
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    ends = [e for _, e in taken]
    added, end = [], -1
    for kind, a, b in sorted(tagged, key=lambda s: (s[1], -s[2])):
        at = bisect.bisect_right(ends, a)
        free = at == len(taken) or taken[at][0] >= b
        if a >= end and free and accepted(kind, text[a:b]):
            added.append((kind, a, b))
            end = b
    return sorted(base + added, key=_order)


def all_spans(tagger: Tagger, texts: list[str]) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, all spans) of each text."""
    return [(base, add_spans(tagged, t, base)) for t, tagged in zip(texts, tagger.spans(texts)) for base in [base_spans(t)]]


def evaluate(tagger: Tagger, windows: int = 500, seed: int = 77) -> dict[str, tuple[float, float]]:
    """(precision, recall) of whole spans by kind over labelled windows."""
    x, y = labelled_windows(windows, seed)
    e = tagger.scores(x)

    def spans(tags) -> set[tuple[int, int, int]]:
        starts = [j for j, t in enumerate(tags) if t % 2]
        return {(int(tags[j]), j, next((i for i in range(j + 1, len(tags)) if tags[i] != tags[j] + 1), len(tags))) for j in starts}

    hit, said, true = Counter(), Counter(), Counter()
    for i in range(windows):
        got, want = spans(tagger.viterbi(e[:, i])), spans(y[i])
        for c, s in ((hit, got & want), (said, got), (true, want)):
            c.update(k for k, _, _ in s)
    return {k: (hit[t] / max(1, said[t]), hit[t] / max(1, true[t])) for k, t in zip(TAGGED, range(1, TAGS, 2))}


@functools.cache
def trained(seed: int = 5, windows: int = TRAIN_WINDOWS, epochs: int = EPOCHS) -> Tagger:
    t = Tagger(seed)
    t.fit(*labelled_windows(windows, seed), epochs=epochs)
    return t


def find(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_secret, secrets) of every row.

    The first four counts are of base spans; ``spans`` and ``n_spans`` are all spans of these four
    kinds, ``secrets`` and ``n_secret`` the spans of the kind secret.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(tagger or trained())
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "n_secret", "secrets"]

    def make():
        t = shared.value

        def one(base, spans) -> tuple:
            n = [sum(s[0] == k for s in base) for k in KINDS]
            secrets = [s for s in spans if s[0] == "secret"]
            others = [s for s in spans if s[0] != "secret"]
            return (*n, hashlib.sha256(spell(base).encode()).hexdigest(), spell(others), len(others), len(secrets), spell(secrets))

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = [one(*x) for x in all_spans(t, C.texts_of(b))]
            return C.records(names, [b.column(0), *zip(*rows)], [None, *[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()])

        return work

    return C.map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_secret long, secrets string")


def redact(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """The rows with every span of ``text`` replaced by its kind in brackets; other columns as they are, null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger or trained())

    @F.pandas_udf("string")
    def clean(texts):
        t = shared.value
        whole = [x if x is not None else "" for x in texts]

        def one(text: str, spans) -> str:
            out, at = [], 0
            for kind, a, b in spans:
                if b <= at:
                    continue
                out += [text[at : max(a, at)], f"[{kind.upper()}]"]
                at = b
            return "".join(out) + text[at:]

        return pd.Series([None if x is None else one(x, spans) for x, (_, spans) in zip(texts, all_spans(t, whole))], dtype=object)

    return docs.withColumn("text", clean("text"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(C.read(spark, sf_dir, "documents"))
