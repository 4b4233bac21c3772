"""Operator 9: personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The tokens of a document that hold a digit or an @ then form a graph: tokens
side by side share a chain edge, and tokens that repeat each other (by their letters and digits, or by
the last digits of a number) share skip edges, however far apart: each free mention with a mention of each kind that a base span holds,
or, where there is none, with a node that stands for what the mentions have in common. So any mention is two edges
from any other, and there are as many edges as mentions.
Loopy belief propagation over kinds and "none", with the base spans' tokens held fixed, carries the kind of
an entity to its other mentions; tokens whose kind it raises over one half become spans too. Unary weights
(word shapes and neighbours) and the edges' weights are learned from the base spans of a bounded sample.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, documents, spread

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
#: Documents, in expectation, that the field's weights are learned from.
MAX_DOCS = 4_000
#: Messages are passed on until an undamped step would change none by more.
SETTLED = 1e-4
#: What a label that can't be weighs: no number of messages outweighs it.
NEVER = -1e9
#: Messages that go round in cycles are damped twice as much after so many rounds each time; at the least step they are taken
#: as they are.
PATIENCE, LEAST_STEP = 200, 0.002

_domain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A digit run's first digit is the leftmost place from which a match can begin: no run is read twice.
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, kind's number), by start, then kind."""
    out: list[tuple[int, int, int]] = []
    if not text:
        return out
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _local:
            start -= 1
        m = _domain.match(text, start) if start < at else None
        last = m.end() if m else at + 1
        if m:
            out.append((m.start(), m.end(), 0))
        at = text.find("@", last)
    if _digit.search(text):
        out += [(m.start(), m.end(), 1) for m in _ip.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _card.finditer(text):
            if m.end() - m.start() < 12:
                continue
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in _phone.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def _tokens(text: str) -> list[tuple[int, int]]:
    """Spans of runs without white space that hold a digit or an @."""
    out, at = [], 0
    space, mark = re.compile(r"\s"), re.compile(r"[0-9@]")
    while m := mark.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        e = space.search(text, m.end())
        out.append((start, e.start() if e else len(text)))
        at = out[-1][1]
    return out


_core = re.compile(r"[+(]?[0-9A-Za-z](?:.*[0-9A-Za-z)])?", re.S)


def _shape(token: str) -> str:
    """Letters as a, digits as d, with long runs counted; long shapes by their hash."""
    s = re.sub(r"[0-9]", "d", re.sub(r"[^\W\d_]+", "a", token))
    s = re.sub(r"d{8,}", lambda m: f"d<{len(m[0])}>", s)
    return s if len(s) <= 64 else hashlib.md5(s.encode()).hexdigest()


def _digits(token: str) -> str:
    return "".join(c for c in token if c in "0123456789")


def _allowed(token: str) -> tuple[bool, ...]:
    """Kinds that a token could be of, and none: what a pattern's own test rules out stays out."""
    d = _digits(token)
    quads = token.split(".")
    return (
        "@" in token.strip("@"),
        len(quads) == 4 and all(q.isdecimal() and q.isascii() and len(q) <= 3 and int(q) <= 255 for q in quads),
        12 <= len(d) <= 19 and not re.search(r"[^0-9 .-]", token) and luhn(d),
        2 <= len(d) <= 15 and not re.search(r"[^0-9 ().+-]", token) and len(quads) < 4,
        True,
    )


class Graph:
    """The tokens of a text, their labels from base spans (-1: free), and the edges."""

    def __init__(self, text: str, spans: list[tuple[int, int, int]]):
        self.at, self.label, self.core = [], [], []
        k = 0
        for a, b in _tokens(text):
            while k < len(spans) and spans[k][1] <= a:
                k += 1
            j = k
            while j < len(spans) and spans[j][0] < b and spans[j][1] <= a:
                j += 1
            held = spans[j][2] if j < len(spans) and spans[j][0] < b else -1
            m = _core.search(text, a, b)
            if not m or m.end() > b:
                continue
            self.at.append((m.start(), m.end()))
            self.core.append(text[m.start() : m.end()])
            self.label.append(held)
        n = len(self.at)
        self.chain = [k for k in range(n - 1) if self.at[k + 1][0] - self.at[k][1] <= 3 and text[self.at[k][1] : self.at[k + 1][0]].isspace()]
        forms: dict[str, list[int]] = {}
        for k, c in enumerate(self.core):
            d = _digits(c)
            form = "#" + d[-7:] if len(d) >= 7 and "@" not in c else "=" + c.lower()
            forms.setdefault(form, []).append(k)
        self.again, self.skip, self.nodes = [], [], n  # pairs of mentions, one after the other; edges; tokens and common nodes
        for ks in forms.values():
            self.again += zip(ks, ks[1:])
            held: dict[int, int] = {}
            for k in ks:
                if self.label[k] >= 0:
                    held.setdefault(self.label[k], k)
            free = [k for k in ks if self.label[k] < 0]
            if held:
                self.skip += [(h, k) for k in free for h in held.values()]
            elif len(free) > 1:
                self.skip += [(self.nodes, k) for k in free]
                self.nodes += 1

    def features(self, k: int, chain: set[int]) -> tuple[str, ...]:
        c = self.core[k]
        before = _shape(self.core[k - 1]) if k - 1 in chain else "-"
        after = _shape(self.core[k + 1]) if k in chain else "-"
        return ("s:" + _shape(c), f"n:{min(len(_digits(c)), 20)}", "b:" + before, "a:" + after, "*")


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _summed(x: np.ndarray, axis: int) -> np.ndarray:
    """Logarithms of sums of exponentials."""
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class Field:
    """The weights: of features by label, of a chain edge's labels, and of a skip edge's agreement."""

    def __init__(self, rows: dict[tuple[tuple[str, ...], int], int], chain: dict[tuple[int, int], int], agree: tuple[int, int], steps: int = 150):
        n = NONE + 1
        names = sorted({f for fs, _ in rows for f in fs})
        self.index = {f: k for k, f in enumerate(names)}
        self.weights = np.zeros((len(names) + 1, n))
        self.weights[-1, NONE] = 0.5  # of features that the sample doesn't hold
        if rows:
            x = np.array([[self.index[f] for f in fs] for fs, _ in rows])
            y, c = np.array([k for _, k in rows]), np.array([*rows.values()], float)
            aim = np.eye(n)[y]
            step = np.zeros_like(self.weights)
            for _ in range(steps):  # gradients scaled by their past squares
                p = _softmax(self.weights[x].sum(axis=1))
                g = np.zeros_like(self.weights)
                np.add.at(g, x.ravel(), np.repeat((p - aim) * np.sqrt(c)[:, None], x.shape[1], axis=0))
                g += 0.01 * self.weights
                step += g * g
                self.weights -= 0.5 * g / np.sqrt(step + 1e-9)
        pairs = np.full((n, n), 0.5)
        for (a, b), k in chain.items():
            pairs[a, b] += k
        pairs /= pairs.sum()
        self.chain = np.clip(np.log(pairs / (pairs.sum(1, keepdims=True) * pairs.sum(0, keepdims=True))), -2, 2)
        same, other = agree
        self.skip = np.eye(n) * float(np.clip(np.log((same + 1) / (other + 1)), 0.5, 4))

    def marginals(self, g: Graph) -> np.ndarray:
        """Beliefs of each token after loopy belief propagation, run until it settles."""
        chain = set(g.chain)
        unary = np.array([self.weights[[self.index.get(f, -1) for f in g.features(k, chain)]].sum(axis=0) for k in range(len(g.at))])
        for k, held in enumerate(g.label):
            if held >= 0:
                unary[k] = NEVER
                unary[k, held] = 0
            else:
                unary[k, ~np.array(_allowed(g.core[k]))] = NEVER
        edges = [(k, k + 1, self.chain) for k in g.chain] + [(a, b, self.skip) for a, b in g.skip]
        if not edges:
            return _softmax(unary)
        unary = np.concatenate([unary, np.zeros((g.nodes - len(unary), NONE + 1))])
        a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
        psi = np.array([e[2] for e in edges])
        ahead, back = np.zeros((len(edges), NONE + 1)), np.zeros((len(edges), NONE + 1))
        step, rounds, change = 0.5, 0, np.inf
        while change > SETTLED:
            belief = unary.copy()
            np.add.at(belief, b, ahead)
            np.add.at(belief, a, back)
            new, old = _summed((belief[a] - back)[:, :, None] + psi, 1), _summed((belief[b] - ahead)[:, None, :] + psi, 2)
            new, old = new - new.max(axis=1, keepdims=True) - ahead, old - old.max(axis=1, keepdims=True) - back
            change = max(np.abs(new).max(), np.abs(old).max())
            ahead, back, rounds = ahead + step * new, back + step * old, rounds + 1
            if rounds % PATIENCE == 0:
                if (step := step / 2) < LEAST_STEP:
                    break
        belief = unary
        np.add.at(belief, b, ahead)
        np.add.at(belief, a, back)
        return _softmax(belief[: len(g.at)])

    def spans(self, text: str | None, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Base spans and those that the field adds, by start, then kind."""
        if not text or not re.search(r"[0-9@]", text):
            return base
        g = Graph(text, base)
        free = [k for k, held in enumerate(g.label) if held < 0]
        if not any(any(_allowed(g.core[k])[:NONE]) for k in free):
            return base
        found = self.marginals(g)
        out, chain = [], set(g.chain)
        for k in free:
            kind = int(found[k].argmax())
            if kind == NONE or found[k, kind] <= 0.5:
                continue
            a, b = g.at[k]
            if out and out[-1][2] == kind and k - 1 in chain and out[-1][1] == g.at[k - 1][1]:
                out[-1] = (out[-1][0], b, kind)  # tokens side by side are one span
            else:
                out.append((a, b, kind))
        # a number of fewer digits than a local one has isn't a phone's
        ok = [(a, b, k) for a, b, k in out if k != 3 or len(_digits(text[a:b])) >= 7]
        free_of, at, last = [], 0, -1
        for x in ok:  # both lists are in order: `last` is the furthest end of base spans that start before x's end
            while at < len(base) and base[at][0] < x[1]:
                last, at = max(last, base[at][1]), at + 1
            if last <= x[0]:
                free_of.append(x)
        return sorted(base + free_of)


def learn(docs: DataFrame, max_docs: int = MAX_DOCS) -> Field:
    """From the base spans of a sample of about max_docs documents, drawn by a hash of the row (see bounded())."""
    n = docs.count()
    src = documents(docs)
    if n > max_docs:
        src = bounded(src.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(max_docs / n * (1 << 30))), max_docs)

    def count(batches):
        rows: Counter = Counter()
        for b in batches:
            for text in b.column(1).to_pylist():
                g = Graph(text or "", base_spans(text))
                chain, lab = set(g.chain), [NONE if x < 0 else x for x in g.label]
                for k in range(len(lab)):
                    rows["n", g.features(k, chain), lab[k]] += 1
                for k in g.chain:
                    rows["c", (), lab[k] * 10 + lab[k + 1]] += 1
                for a, b2 in g.again:
                    rows["s", (), int(lab[a] == lab[b2])] += 1
        yield pa.RecordBatch.from_pydict({"what": pa.array([k[0] for k in rows], pa.string()), "features": pa.array([list(k[1]) for k in rows], pa.list_(pa.string())), "label": pa.array([k[2] for k in rows], pa.int32()), "n": pa.array(list(rows.values()), pa.int64())})

    found = src.mapInArrow(count, "what string, features array<string>, label int, n long").groupBy("what", "features", "label").agg(F.sum("n").alias("n")).collect()
    nodes: dict = defaultdict(int)
    chain: dict = {}
    agree = [0, 0]
    for r in sorted(found, key=lambda r: (r["what"], r["features"], r["label"])):
        if r["what"] == "n":
            nodes[tuple(r["features"]), r["label"]] += r["n"]
        elif r["what"] == "c":
            chain[divmod(r["label"], 10)] = r["n"]
        else:
            agree[1 - r["label"]] += r["n"]
    return Field(nodes, chain, (agree[0], agree[1]))


def _mapped(docs: DataFrame, field: Field, finish, schema, columns: list[str]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            yield finish(b, texts, base, [sent.value.spans(t, s) for t, s in zip(texts, base)])

    return spread(docs.select(*[F.col(f"`{c}`") for c in columns])).mapInArrow(run, schema)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def report(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans alone), base_sha256 (of the base spans) and spans (all of them).

    Null and empty texts have no spans. Equal rows give equal rows. Other columns are ignored.
    """

    def finish(b, texts, base, spans):
        n = [Counter(k for _, _, k in s) for s in base]
        cols = {f"n_{kind}": pa.array([c[k] for c in n], pa.int64()) for k, kind in enumerate(KINDS)}
        digest = [hashlib.sha256(_joined(s).encode()).hexdigest() for s in base]
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), **cols, "base_sha256": pa.array(digest, pa.string()), "spans": pa.array(map(_joined, spans), pa.string())})

    shape = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return _mapped(docs, field or learn(docs), finish, shape, ["doc_id", "text"])


def masked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """text with each span (overlapping ones as one, by the first one's kind) as its kind in brackets."""
    out, at, last = [], 0, -1
    for a, b, k in spans:
        if a >= last:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        last = at = max(last, b)
    return "".join([*out, text[at:]]) if out else text


def mask(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs, with all its columns, with personal data masked; n_chars, if there, follows. Null texts stay."""

    def finish(b, texts, base, spans):
        new = [masked(t, s) for t, s in zip(texts, spans)]
        b = b.set_column(b.schema.get_field_index("text"), "text", pa.array(new, pa.string()))
        at = b.schema.get_field_index("n_chars")
        if at >= 0:
            n = [old if t is None or not s else len(t) for old, t, s in zip(b.column(at).to_pylist(), new, spans)]
            b = b.set_column(at, "n_chars", pa.array(n, b.schema.field(at).type))
        return b

    return _mapped(docs, field or learn(docs), finish, docs.schema, docs.columns)
