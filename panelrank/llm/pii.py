"""Personal data: base patterns, and a skip-chain conditional random field that adds to them.

Base spans are the leftmost non-overlapping matches of four patterns (e-mail, ip address, card
number with a valid check digit, phone number); matches that fail their test are dropped.

The field labels every token between blanks that holds a digit or an at sign: none, or one of the
kinds. A token's own potentials come from its shape and the words beside it; tokens side by side
share a transition potential; tokens that repeat or resemble each other in the document (equal,
equal digits, equal first or last digits, the name part of an address) share a potential that favours
equal labels, however far apart they stand. Tokens inside base spans are fixed to their kind. Loopy
belief propagation runs until its messages settle, and a free token whose probability of one kind
reaches ``sure`` becomes a span; such tokens side by side are one.

All tokens with the same key meet in one node, so links grow with the tokens, not with their pairs,
and any two mentions are two steps apart. Evidence counts once, however often it is repeated: a kind
that base spans give to some of the node's tokens reaches each other one with the potential's full
strength a single time, over all the keys that it shares; free tokens of a node send it what they
find likely, at a strength divided by their number, and each takes from it how the others differ from
itself. So fifty repeats of a number that stands once in full are all found, while repeats of a
token that nothing speaks for change nothing.

Weights are fitted in numpy by pseudo-likelihood on a bounded sample of documents, with the base
labels as truth and without telling the field which tokens a pattern matched. Every text is read
whole. A missing text counts as empty; offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrank.llm.common import bounded_sample, map_texts

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0 is none
FEATURES = 1 << 13

# Fixed by the definition of the base spans.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start where a run of digits starts, which spares rescans of long runs.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_DIGITS = re.compile(r"[0-9]+")
_EDGE = " \t\n.,;:!?\"'()[]{}<>|*#&%$"

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, by kind and then by start."""
    out: list[Span] = []
    if not _HINT.search(text):
        return out
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _NAME:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append(("email", start, end))
        else:
            end = at + 1
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


@dataclass
class Graph:
    """Tokens of one document: places, features, base labels (0: free), links, and shared nodes.

    ``chain`` has pairs of tokens side by side, ``member`` pairs (token, node) of nodes that hold two
    tokens or more.
    """

    places: list[tuple[int, int]]
    features: list[list[int]]
    label: np.ndarray
    chain: list[tuple[int, int]]
    member: list[tuple[int, int]]


def _hash(*parts: object) -> int:
    return zlib.crc32("\0".join(map(str, parts)).encode()) % FEATURES


def _shape(token: str) -> str:
    """Runs of digits by length, runs of letters as one sign, other signs as they are."""
    marked = _DIGITS.sub(lambda m: f"9{min(len(m[0]), 20)}.", token)
    return re.sub(r"[^\W\d_]+", "a", marked)[:60]


def _keys(token: str) -> list[tuple[str, str]]:
    digits = "".join(_DIGITS.findall(token))
    keys = [("same", token)]
    if len(digits) >= 6:
        keys.append(("digits", digits))
    if len(digits) >= 9:
        keys.append(("first", digits[:8]))
    if len(digits) >= 7:
        keys.append(("last", digits[-7:]))
    name = token.split("@")[0]
    if len(name) >= 5:
        keys.append(("name", name))
    return keys


def graph(text: str, spans: list[Span]) -> Graph:
    places, features, chain = [], [], []
    words = list(_TOKEN.finditer(text)) if _HINT.search(text) else []
    held: dict[tuple[str, str], list[int]] = {}
    before = -2
    for i, word in enumerate(words):
        if not _HINT.search(word[0]):
            continue
        bare = word[0].strip(_EDGE)
        if not bare:
            continue
        start = word.start() + word[0].index(bare)
        here = len(places)
        places.append((start, start + len(bare)))
        token = bare.lower()
        digits = sum(map(len, _DIGITS.findall(token)))
        left = words[i - 1][0].strip(_EDGE).lower() if i else "^"
        right = words[i + 1][0].strip(_EDGE).lower() if i + 1 < len(words) else "$"
        features.append(
            [
                _hash("bias"),
                _hash("shape", _shape(token)),
                _hash("digits", min(digits, 25)),
                _hash("all digits", token.isdigit(), min(digits, 25)),
                _hash("at", token.count("@"), "." in token.rpartition("@")[2]),
                _hash("dots", min(4, token.count("."))),
                _hash("opens", word[0][0] if not word[0][0].isalnum() else "a"),
                _hash("left", _shape(left)),
                _hash("right", _shape(right)),
                _hash("left word", left),
            ]
        )
        if before == i - 1:
            chain.append((here - 1, here))
        before = i
        for key in _keys(token):
            held.setdefault(key, []).append(here)
    label = np.zeros(len(places), dtype=np.int64)
    starts = np.array([a for a, _ in places], dtype=np.int64)
    ends = np.array([b for _, b in places], dtype=np.int64)
    for kind, a, b in reversed(spans):
        # Tokens are in order: those that the span touches stand side by side.
        label[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b)] = (
            KINDS.index(kind) + 1
        )
    nodes = [tokens for tokens in held.values() if len(tokens) > 1]
    member = [(token, node) for node, tokens in enumerate(nodes) for token in tokens]
    return Graph(places, features, label, chain, member)


@dataclass
class Field:
    own: np.ndarray  # FEATURES x LABELS
    transition: np.ndarray  # LABELS x LABELS
    alike: float  # added for a label that another token of a shared node has


def _pairs(links: list[list[tuple[int, int]]], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    found = [
        np.array(x, dtype=np.int64).reshape(-1, 2) + (i, j) for x, i, j in zip(links, first, second)
    ]
    return np.concatenate([np.empty((0, 2), np.int64), *found])


def _starts(sizes: list[int]) -> np.ndarray:
    sizes = np.array(sizes, dtype=np.int64)
    return np.cumsum(sizes) - sizes


def _join(graphs: list[Graph]):
    offsets = _starts([len(g.places) for g in graphs])
    features = [f for g in graphs for f in g.features]
    features = np.array(features, dtype=np.int64).reshape(len(features), -1)
    label = np.concatenate([np.empty(0, np.int64), *[g.label for g in graphs]])
    chain = _pairs([g.chain for g in graphs], offsets, offsets)
    nodes = _starts([max((n for _, n in g.member), default=-1) + 1 for g in graphs])
    member = _pairs([g.member for g in graphs], offsets, nodes)
    return features, label, chain, member, offsets


def _told(label: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Per token and kind, 1 if another token of one of its nodes has the kind."""
    token, node = member.T
    count = np.zeros((node.max() + 1 if len(node) else 0, LABELS))
    np.add.at(count, (node, label[token]), 1)
    others = count[node]
    others[np.arange(len(token)), label[token]] -= 1
    told = np.zeros((len(label), LABELS))
    np.maximum.at(told, token, np.minimum(others, 1))
    told[:, 0] = 0
    return told


def fit(graphs: list[Graph], steps: int = 300, rate: float = 0.05, decay: float = 2e-4) -> Field:
    """Adam on the pseudo-likelihood: each token given its features and its neighbours' labels."""
    field = Field(np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), 2.0)
    graphs = [g for g in graphs if g.places]
    if not graphs:
        field.own[_hash("bias"), 0] = 5.0
        return field
    features, label, chain, member, _ = _join(graphs)
    n, truth = len(label), np.eye(LABELS)[label]
    a, b = chain.T
    near = _told(label, member)
    used, slot = np.unique(features, return_inverse=True)
    slot = slot.reshape(features.shape)
    own = np.zeros((len(used), LABELS))
    transition, alike = field.transition, np.array([field.alike])
    weights = [own, transition, alike]
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    for step in range(1, steps + 1):
        score = own[slot].sum(1) + alike * near
        np.add.at(score, b, transition[label[a]])
        np.add.at(score, a, transition[:, label[b]].T)
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = (p - truth) / n
        grad = np.zeros_like(own)
        for k in range(slot.shape[1]):
            np.add.at(grad, slot[:, k], error)
        grad_t = np.zeros_like(transition)
        np.add.at(grad_t, label[a], error[b])
        np.add.at(grad_t.T, label[b], error[a])
        grads = [grad, grad_t, np.array([(error * near).sum()])]
        for w, g, m, v in zip(weights, grads, first, second):
            g = g + decay * (w if w is not alike else w - 2.0)
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    field.own[used] = own
    field.alike = float(max(0.0, alike[0]))
    return field


def _sent(held: np.ndarray, potential: np.ndarray) -> np.ndarray:
    """Messages along potentials from what their senders hold, as logarithms."""
    raised = held[:, :, None] + potential
    top = raised.max(axis=1)
    return top + np.log(np.exp(raised - top[:, None, :]).sum(axis=1))


def marginals(graphs: list[Graph], field: Field, settled: float = 1e-3) -> list[np.ndarray]:
    """Label probabilities of every token by loopy belief propagation, base tokens fixed."""
    features, label, chain, member, offsets = _join(graphs)
    local = field.own[features].sum(1).reshape(-1, LABELS)
    fixed = label > 0
    local += field.alike * _told(label, member)
    local[fixed] = -50.0
    local[fixed, label[fixed]] = 0.0
    # Each link carries a message either way; the second half runs against the first.
    source = np.concatenate([chain[:, 0], chain[:, 1]])
    target = np.concatenate([chain[:, 1], chain[:, 0]])
    pot = np.broadcast_to(field.transition, (len(chain), LABELS, LABELS))
    pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
    message, half = np.zeros((len(source), LABELS)), len(chain)
    # Free tokens in nodes, and by how many each node and each token divides.
    token, node = member[~fixed[member[:, 0]]].T
    in_node = np.bincount(node, minlength=1)[:, None].clip(1)
    in_nodes = np.bincount(token, minlength=len(label))[:, None].clip(1)
    shared = np.zeros_like(local)
    same = np.broadcast_to(field.alike * np.eye(LABELS), (1, LABELS, LABELS))
    belief = local.copy()
    for _ in range(len(label) + 50):  # no path is longer
        back = np.concatenate([message[half:], message[:half]])
        new = _sent(belief[source] - back, pot)
        new -= new.max(axis=1, keepdims=True)
        says = _sent(belief - shared, same)
        says -= says.mean(axis=1, keepdims=True)
        mean = np.zeros((len(in_node), LABELS))
        np.add.at(mean, node, says[token])
        mean /= in_node
        pull = np.zeros_like(local)
        np.add.at(pull, token, mean[node] - says[token])
        pull /= in_nodes
        moved = max(np.abs(new - message).max(initial=0.0), np.abs(pull - shared).max(initial=0.0))
        message, shared = 0.5 * (message + new), 0.5 * (shared + pull)
        belief = local + shared
        np.add.at(belief, target, message)
        if moved < settled:
            break
    belief -= belief.max(axis=1, keepdims=True)
    p = np.exp(belief)
    p /= p.sum(axis=1, keepdims=True)
    return np.split(p, offsets[1:]) if len(graphs) else []


def added_spans(texts: list[str], bases: list[list[Span]], field: Field, sure: float) -> list[list[Span]]:
    """For every text the spans of free tokens whose kind the field is sure of."""
    graphs = [graph(t, s) for t, s in zip(texts, bases)]
    busy = [i for i, g in enumerate(graphs) if g.places and (g.label == 0).any()]
    out: list[list[Span]] = [[] for _ in texts]
    for i, p in zip(busy, marginals([graphs[i] for i in busy], field) if busy else []):
        g = graphs[i]
        best = p.argmax(axis=1)
        side_by_side = set(g.chain)
        before = -1
        for k in np.flatnonzero((g.label == 0) & (best > 0) & (p.max(axis=1) >= sure)).tolist():
            kind, (start, end) = KINDS[best[k] - 1], g.places[k]
            if (before, k) in side_by_side and out[i][-1][0] == kind:
                start = out[i].pop()[1]
            out[i].append((kind, start, end))
            before = k
    return out


def sample(
    docs: DataFrame,
    rows: int = 4000,
    longest: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> list[str]:
    """At most ``rows`` texts of at most ``longest`` characters that hold a digit or an at sign."""
    usable = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(
        (F.length("_text") <= longest) & F.col("_text").rlike("[0-9@]")
    )
    found = bounded_sample(usable, rows, "_id", "_text")
    return found.select("_text").toArrow().column("_text").to_pylist()


def train(texts: list[str]) -> Field:
    return fit([graph(t, base_spans(t)) for t in texts])


def find(
    docs: DataFrame, field: Field, sure: float = 0.95, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """For every row: id, base and added spans (arrays of kind, start, end), each by kind and start."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(texts, kept):
        texts = [t or "" for t in texts]
        bases = [base_spans(t) for t in texts]
        hinted = [i for i, t in enumerate(texts) if _HINT.search(t)]
        found = added_spans([texts[i] for i in hinted], [bases[i] for i in hinted], field, sure)
        added: list[list[Span]] = [[] for _ in texts]
        for i, spans in zip(hinted, found):
            added[i] = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))
        return {id_col: kept[id_col], "base": bases, "added": added}

    span = "array<struct<kind:string, start:long, end:long>>"
    return map_texts(docs, [id_col], text_col, f"`{id_col}` {id_type}, base {span}, added {span}", work)
