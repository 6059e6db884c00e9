"""Personal data: patterns, and a skip-chain conditional random field that extends them.

Nodes are the tokens with a digit or "@"; all other tokens count as observed outside of entities. A node has features of
its shape and surroundings, chain edges to the nodes beside it, and skip edges to the last earlier token with the same
or a similar content (same letters and digits, the same last digits, or a part of an address). Weights are learnt by
pseudo-likelihood on a bounded sample of documents, labelled by the patterns and by assignments to words such as "token" (kind
secret). Half of these texts also repeat what the patterns found in forms that no pattern sees (a number without its country
code, a spaced address), beside other numbers of the same form: there only the earlier mention tells the label, so that
weight falls on the skip edges. Loopy sum-product over chain and skip edges then gives each token's label, so that a
number that is a phone in one place is one in another where no pattern sees it. Edges only link a token with the last one
of its kind, so that a document's graph has a few edges a token, however often one repeats.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .vectors import slices, flat

KINDS = ("email", "ip", "card", "phone")
#: Kinds of all spans; no pattern of the base has the last.
ALL = (*KINDS, "secret")
LABELS = ("o", *ALL)
#: Documents that are looked at to learn weights, at most; nodes of a part of one; hashed features; rounds of messages.
SAMPLE, NODES, WIDTH, ROUNDS = 20_000, 64, 1 << 12, 8
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# a digit before would have begun the match
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_NODE = re.compile(r"[0-9@]")
_EDGE = ".,;:!?()[]{}<>\"'"
_SECRET = re.compile(r"(?i)(?<![a-z])(?:token|secret|passw(?:or)?d|(?:api|access)[_-]?key)\s*[=:]\s*[\"']?([A-Za-z0-9_+/-]{16,})")
_HEX = re.compile(r"[0-9A-Fa-f]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            yield s, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches that hold, by start, then kind."""
    found = [(s, e, "email") for s, e in emails(text)]
    if "." in text:
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def taught_spans(text: str) -> list[tuple[int, int, str]]:
    """What the field learns from: the patterns' spans and assigned secrets."""
    base = base_spans(text)
    secrets = [(m.start(1), m.end(1), "secret") for m in _SECRET.finditer(text) if any("0" <= c <= "9" for c in m.group(1))]
    return sorted(base + [s for s in secrets if not any(a < s[1] and b > s[0] for a, b, _ in base)])


def with_repeats(text: str, spans: list[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """The text and spans, and after it phones and addresses once more in forms that no pattern sees, and other numbers of the same form without a span."""
    out, spans = text, list(spans)

    def add(before: str, form: str, kind: str | None) -> None:
        nonlocal out
        out += f"{before} "
        if kind:
            spans.append((len(out), len(out) + len(form), kind))
        out += form

    for a, b, kind in spans[:8]:
        if kind == "phone":
            d = "".join(c for c in text[a:b] if "0" <= c <= "9")[-10:]
            other = "".join(str((int(c) * 7 + k + zlib.crc32(d.encode())) % 10) for k, c in enumerate(d))
            for x, label in ((other, None), (d, "phone")):
                add("\nand", f"({x[:-7]}) {x[-7:-4]}-{x[-4:]}" if len(x) == 10 else f"{x[:-4]}-{x[-4:]}", label)
        elif kind == "email":
            add("\nto", " @ ".join(text[a:b].split("@")), "email")
    return out + " or", spans


@dataclass
class Graph:
    """Nodes of one document: spans, features, edges (chain and skip), and the label that the patterns give each."""

    spans: list[tuple[int, int]]
    features: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    alone: list[int]
    label: list[int]


def _shape(token: str) -> str:
    out = re.sub(r"[0-9]", "d", token)
    out = re.sub(r"[A-Z]", "A", out)
    out = re.sub(r"[^\W\dA_]", "a", out.replace("d", "\0").replace("A", "\1")).replace("\0", "d").replace("\1", "A")
    return re.sub(r"a+", "a", re.sub(r"A+", "A", out))


FEATURES = 12


def graph(text: str, base: list[tuple[int, int, str]]) -> Graph:
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    out = Graph([], [], [], [], [], [])
    last, before, k = {}, -2, 0
    for t, (s, e) in enumerate(tokens):
        word = text[s:e]
        if not _NODE.search(word):
            continue
        core = word.strip(_EDGE)
        a = s + word.find(core) if core else s
        b = a + len(core) if core else e
        digits = "".join(c for c in core if "0" <= c <= "9")
        left = text[tokens[t - 1][0] : tokens[t - 1][1]] if t else ""
        right = text[tokens[t + 1][0] : tokens[t + 1][1]] if t + 1 < len(tokens) else ""
        shape = _shape(core)[:40]
        names = [f"s{shape}", f"n{len(digits)}", f"c{re.sub('d+', 'd', shape)}", f"l{_shape(left)[:12]}", f"r{_shape(right)[:12]}", f"h{core[:1]}", f"@{core.count('@')}.{min(4, core.count('.'))}", f"u{len(digits) >= 12 and luhn(digits[:20])}", f"x{bool(_HEX.fullmatch(core))}{min(len(core) // 8, 5)}", f"k{text[tokens[t - 2][0] : tokens[t - 2][1]].lower()[:12] if t > 1 and left in '=:' else ''}", f"w{left[-1:]}{right[:1] if not right[:1].isalpha() else 'a'}", "1"]
        out.features.append([zlib.crc32(x.encode()) % WIDTH for x in names])
        i = len(out.spans)
        out.spans.append((a, b))
        while k < len(base) and base[k][1] <= a:
            k += 1
        out.label.append(next((LABELS.index(x[2]) for x in base[max(0, k - 3) : k + 3] if x[0] < b and x[1] > a), 0))
        out.alone.append((t - 1 != before) + (not right or not _NODE.search(right)))
        if t - 1 == before:
            out.chain.append((i - 1, i))
        before = t
        keys = [("c", "".join(c for c in x if c.isalnum())) for x in dict.fromkeys([core.lower(), *core.lower().split("@")])]
        for key in keys + [("d", digits[-7:])] * (7 <= len(digits) <= 19):
            if key[1] and len(key[1]) >= 4:
                if key in last and (last[key], i) not in out.chain[-1:] + out.skip[-1:]:
                    out.skip.append((last[key], i))
                last[key] = i
    return out


@dataclass
class Field:
    """Weights: of features, of neighbouring labels (chain), of equal labels on skip edges, and of a label beside tokens outside of entities."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    alone: np.ndarray

    def marginals(self, graphs: list[Graph]) -> np.ndarray:
        """Label probabilities of all nodes of the graphs, by loopy sum-product over all of them at once."""
        n = sum(len(g.spans) for g in graphs)
        if not n:
            return np.zeros((0, len(LABELS)))
        base = np.append(0, np.cumsum([len(g.spans) for g in graphs]))
        f = np.array([x for g in graphs for x in g.features])
        local = self.unary[f].sum(1) + np.array([x for g in graphs for x in g.alone])[:, None] * self.alone
        pairs = [(a + o, b + o, k) for g, o in zip(graphs, base, strict=False) for k, e in ((0, g.chain), (1, g.skip)) for a, b in e]
        if not pairs:
            return _softmax(local)
        u, v, kind = np.array(pairs).T
        potential = np.stack([self.chain, np.diag(self.skip)])[kind]
        # messages u -> v, then v -> u
        source, target = np.concatenate([u, v]), np.concatenate([v, u])
        potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(u)) + len(u), np.arange(len(u))])
        m = np.zeros((len(source), len(LABELS)))
        for _ in range(ROUNDS):
            belief = local.copy()
            np.add.at(belief, target, m)
            out = belief[source] - m[back]
            new = _logsum(out[:, :, None] + potential)
            m = 0.5 * m + 0.5 * (new - new.max(1, keepdims=True))
        np.add.at(local, target, m)
        return _softmax(local)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def _logsum(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    return top + np.log(np.exp(x - top[:, None, :]).sum(1))


def fit(graphs: list[Graph], steps: int = 150, rate: float = 0.1, l2: float = 1e-3) -> Field:
    """Pseudo-likelihood: each label given its neighbours' labels, by gradient steps with momentum estimates."""
    k = len(LABELS)
    field = Field(np.zeros((WIDTH, k)), np.zeros((k, k)), np.zeros(k), np.zeros(k))
    base = np.append(0, np.cumsum([len(g.spans) for g in graphs])).astype(int)
    n = int(base[-1])
    if not n:
        return field
    f = np.array([x for g in graphs for x in g.features])
    y = np.array([x for g in graphs for x in g.label])
    alone = np.array([x for g in graphs for x in g.alone])
    edges = [np.array([(a + o, b + o) for g, o in zip(graphs, base, strict=False) for a, b in e(g)], int).reshape(-1, 2) for e in (lambda g: g.chain, lambda g: g.skip)]
    one = np.eye(k)[y]
    weight = np.ones(n)
    params = [field.unary, field.chain, field.skip, field.alone]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        logits = field.unary[f].sum(1) + alone[:, None] * field.alone
        (cu, cv), (su, sv) = edges[0].T, edges[1].T
        np.add.at(logits, cv, field.chain[y[cu]])
        np.add.at(logits, cu, field.chain[:, y[cv]].T)
        np.add.at(logits, sv, one[su] * field.skip)
        np.add.at(logits, su, one[sv] * field.skip)
        d = (one - _softmax(logits)) * weight[:, None]
        grads = [np.zeros_like(p) for p in params]
        np.add.at(grads[0], f.ravel(), np.repeat(d, f.shape[1], axis=0))
        np.add.at(grads[1], y[cu], d[cv])
        np.add.at(grads[1].T, y[cv], d[cu])
        grads[2] = (one[su] * d[sv]).sum(0) + (one[sv] * d[su]).sum(0)
        grads[3] = (alone[:, None] * d).sum(0)
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            g = g / n - l2 * p / max(1, len(p))
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return field


def extra_spans(g: Graph, p: np.ndarray, base: list[tuple[int, int, str]], text: str, least: float = 0.5) -> list[tuple[int, int, str]]:
    """Runs of nodes with one label that no base span touches."""
    chained = {b for _, b in g.chain}
    out: list[tuple[int, int, str]] = []
    open_ = False
    best = p.argmax(1)
    for i, (a, b) in enumerate(g.spans):
        kind = LABELS[best[i]]
        if best[i] and p[i, best[i]] >= least and b > a:
            if open_ and i in chained and out[-1][2] == kind:
                out[-1] = (out[-1][0], b, kind)
            else:
                out.append((a, b, kind))
            open_ = True
        else:
            open_ = False
    found, k = [], 0
    ends = sorted(base)
    for s in out:
        while k < len(ends) and ends[k][1] <= s[0]:
            k += 1
        if not any(x[0] < s[1] and x[1] > s[0] for x in ends[max(0, k - 4) : k + 4]):
            found.append(s)
    return found


def _documents(batch: pa.RecordBatch) -> Iterator[list[tuple[int, str]]]:
    """Lists of (row, text) of a slice, without texts that have neither digit nor "@"."""
    data, at = flat(batch.column("text"))
    node = np.zeros(256, bool)
    node[[*range(48, 58), 64]] = True
    for i, j in slices(at):
        part = data[at[i] : at[j]]
        some = np.append(0, np.cumsum(node[part]))
        raw, own = part.tobytes(), at[i : j + 1] - at[i]
        yield [(i + d, raw[own[d] : own[d + 1]].decode()) for d in np.flatnonzero(some[own[1:]] > some[own[:-1]])]


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Learns from about `sample` documents, those whose hash lies under a bound; graphs are cut into parts of NODES nodes, and `sample` parts count at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part in _documents(batch):
                for _, text in part:
                    taught = taught_spans(text)
                    if zlib.crc32(text.encode()) % 2:
                        text, taught = with_repeats(text, taught)
                    g = graph(text, taught)
                    for k in range(0, len(g.spans), NODES):
                        near = lambda e, k=k: [x - k for p in e if k <= min(p) and max(p) < k + NODES for x in p]
                        rows.append((sum(g.features[k : k + NODES], []), near(g.chain), near(g.skip), g.alone[k : k + NODES], g.label[k : k + NODES]))
            ints = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, ints) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], ["features", "chain", "skip", "alone", "label"])

    n = docs.count()
    own = F.xxhash64("doc_id", "text")
    # uniform hashes: the bound lets through about `sample` rows of any table, the limit exactly so many at most
    bound = int(-(1 << 63) + min(1.0, 1.05 * sample / max(1, n)) * ((1 << 64) - 1)) - 1
    chosen = docs.select("doc_id", "text").where(own <= F.lit(min(bound, (1 << 63) - 1))).where(F.col("text").rlike("[0-9@]"))
    found = chosen.mapInArrow(run, "features array<long>, chain array<long>, skip array<long>, alone array<long>, label array<long>").limit(sample).toArrow().to_pylist()
    pairs = lambda x: list(zip(x[::2], x[1::2], strict=True))
    return fit([Graph([(0, 0)] * len(r["label"]), np.array(r["features"]).reshape(-1, FEATURES).tolist(), pairs(r["chain"]), pairs(r["skip"]), r["alone"], r["label"]) for r in found if r["label"]])


def personal_data(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and the digest (of kind:start:end, comma-joined) are of the patterns' spans; `spans` holds these and the field's
    (of the same kinds, and secret), by start, then kind. Offsets are code points, ends exclusive. Null counts as empty: no spans, the digest of "". Repeated
    rows have equal results; an empty table gives an empty result; other columns of docs are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, sample))
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        for batch in batches:
            counts = np.zeros((batch.num_rows, len(KINDS)), np.int64)
            digest, spans = [nothing] * batch.num_rows, [""] * batch.num_rows
            for part in _documents(batch):
                base = [base_spans(text) for _, text in part]
                graphs = [graph(text, b) for (_, text), b in zip(part, base, strict=True)]
                p, at = model.value.marginals(graphs), 0
                for (row, text), b, g in zip(part, base, graphs, strict=True):
                    extra = extra_spans(g, p[at : at + len(g.spans)], b, text)
                    at += len(g.spans)
                    for x in b:
                        counts[row, KINDS.index(x[2])] += 1
                    digest[row] = hashlib.sha256(join(b).encode()).hexdigest()
                    spans[row] = join(sorted(b + extra, key=lambda s: (s[0], ALL.index(s[2]), s[1])))
            cols = [batch.column("doc_id").cast(pa.int64()), *map(pa.array, counts.T), pa.array(digest, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
