"""Personal data in texts: fixed patterns, and a skip-chain conditional random field around them.

``scan`` finds, in each whole text, the base spans (``base_spans``: e-mail, IP, card
and phone) and the other candidates: words with a digit or "@"; numbers that one
space separates are taken together where their digits are those of a base span. These are
a document's nodes. Potentials are on
single nodes (shape and neighbouring words), on nodes close together (the chain)
and on distant nodes that are the same or similar (skip edges): the same string,
digits or octets; the same last seven digits; an e-mail's local part.

``fit`` learns them by pseudo-likelihood from base spans and other candidates.
To learn what a later mention looks like, each base span also gives a damaged
copy (no plus sign, other separators, the local part alone) that keeps the label
where a skip edge to the span supports it, and has none where nothing does; so
shape alone rarely makes a span, and agreement within the document does.

``decode`` passes messages over all edges of a document (loopy sum-product,
damped) with the base spans held at their labels, and adds the candidates whose
likeliest label is a kind. Occurrences of one key are linked one to the next and
each to the key's first base span, so edges grow with the nodes, not their square.

Candidates without digit and "@" do not exist, so a name is never found. Nodes of
all texts are scored; only the fit is bounded, by ``MAX_ROWS`` a label.

Defined results: a null text counts as empty and has no spans. Rows of null or
repeated ids are separate documents. Where no base span exists, none is added. An
empty table gives no rows; other columns are ignored. Positions are code points.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textops

KINDS = ("email", "ip", "card", "phone")    # labels 1 to 4; 0 is no entity
MAX_ROWS = 2000         # rows of the fit for each label
ROUNDS = 30             # of message passing, at most
FIRST_ROUNDS = 8        # in which what base spans say spreads first
DAMPING = 0.3
NEAR = 40               # code points between neighbours on the chain
GROUP = 6               # numbers that may make up one
AT_ONCE = 20_000        # nodes in memory at once (one document at least)
BUCKETS = 64            # of neighbouring words

_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_MARK = re.compile(r"[0-9@]")
_RUN = re.compile(r"[A-Za-z0-9._%+@()\[\]-]++")
_NEXT = re.compile(r" [().\[\]+-]*+[0-9][0-9().\[\]+-]*+(?![A-Za-z@%_])")
_LETTER = re.compile(r"[A-Za-z@]")
_GROUPS = re.compile(r"[0-9]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def _luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits]
    for i in range(len(doubled) - 2, -1, -2):
        doubled[i] = doubled[i] * 2 - 9 * (doubled[i] > 4)
    return sum(doubled) % 10 == 0


def _digits(s: str) -> str:
    return "".join(_GROUPS.findall(s))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(label, start, end) of the fixed patterns, by label and start; linear in the text."""
    out, last, seen = [], 0, 0
    at = text.find("@")
    while at >= 0:
        low = max(last, seen)
        start = low + len(text[low:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((1, start, m.end()))
            last = m.end()
        seen = at + 1
        at = text.find("@", max(seen, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.group().split(".")):
            out.append((2, m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and _luhn(d):
            out.append((3, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append((4, m.start(), m.end()))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of the other words with a digit or "@", without those that overlap a base span.

    Up to ``GROUP`` numbers are one span if their digits are a base span's, or the last seven or more of a phone's.
    """
    taken = sorted((a, b) for _, a, b in base)
    known = {d[i:] for k, a, b in base if len(d := _digits(text[a:b])) > 6 for i in range(len(d) - 6 if KINDS[k - 1] == "phone" else 1)}
    out, at, k, reach = [], 0, 0, 0
    while m := _MARK.search(text, at):
        start = at + len(text[at:m.start()].rstrip(_LOCAL + "()[]"))
        end = _RUN.match(text, m.start()).end()
        if known and not _LETTER.search(text, start, end):
            last = end
            for _ in range(GROUP - 1):
                if not (more := _NEXT.match(text, last)):
                    break
                last = more.end()
                if _digits(text[start:last]) in known:
                    end = last
        at = end
        while k < len(taken) and taken[k][0] < end:     # base spans that begin before this one's end
            reach = max(reach, taken[k][1])
            k += 1
        if reach > start:
            at = max(at, reach)
            continue
        own = text[start:end]       # brackets without their other half go, as other signs at the edges do
        left = ".-_%)]" + ("" if ")" in own or "]" in own else "([")
        right = ".-_%+([" + ("" if "(" in own or "[" in own else ")]")
        start, end = end - len(own.lstrip(left)), start + len(own.rstrip(right))
        if start < end:
            out.append((start, end))
    return out


# Features: each has a number of values; a node has one value of each.
_SIZES = (11, 3, 2, 5, 4, 2, 2, 5, 6, 2, 2, BUCKETS, BUCKETS, BUCKETS)
_OFFSETS = np.concatenate([[0], np.cumsum(_SIZES)])
N_FEATURES = int(_OFFSETS[-1])
WIDTH = len(_SIZES)


def _shape(s: str) -> list[int]:
    d = _digits(s)
    groups = _GROUPS.findall(s)
    letters = re.findall(r"[A-Za-z]", s)
    octets = len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)
    size = len(d)
    bucket = size if size < 5 else 5 if size < 7 else 6 if size < 9 else 7 if size < 13 else 8 if size < 16 else 9 if size < 20 else 10
    return [bucket, 0 if not letters else 1 if all(c in "abcdefABCDEF" for c in letters) else 2, int("@" in s),
            min(s.count("."), 4), min(s.count("-"), 3), int("(" in s or "[" in s), int("+" in s), min(s.count(" "), 4),
            min(len(groups), 5), int(octets), int(13 <= size <= 19 and _luhn(d))]


def _word(words: list[str], i: int) -> int:
    return zlib.crc32(words[i].lower().encode()) % BUCKETS if -len(words) <= i < len(words) else 0


def features(text: str, start: int, end: int) -> list[int]:
    """The feature numbers of one node."""
    before = [w for w in _SPACE.split(text[max(0, start - NEAR):start]) if w]
    after = [w for w in _SPACE.split(text[end:end + NEAR]) if w]
    values = [*_shape(text[start:end]), _word(before, -1), _word(before, -2), _word(after, 0)]
    return [int(o) + v for o, v in zip(_OFFSETS, values)]


def keys(s: str) -> list[tuple[str, bool]]:
    """What another mention may share with this node, and whether sharing it makes them the same."""
    low, d, groups = s.lower(), _digits(s), _GROUPS.findall(s)
    out = [("s" + low, True)] if len(low) > 3 else []
    if len(d) > 6:
        out.append(("d" + d, True))
        if len(d) < 16 and not re.search(r"[A-Za-z]", s):
            out.append(("t" + d[-7:], False))
    if len(groups) == 4 and len(d) > 5:
        out.append(("g" + ".".join(groups), True))
    local = low.split("@")[0].strip("._%+-")
    if len(local) > 3 and re.search("[a-z]", local):
        out.append(("l" + local, False))
    return out


def damaged(s: str, label: int, seed: int) -> str:
    """Another way to write a base span, picked by ``seed``."""
    if label == 1:
        return s.split("@")[0]
    if label == 2:
        return s.replace(".", ("-", "[.]", " ")[seed % 3])
    if label == 3:
        return _digits(s) if not s.isdigit() else "-.".join([s]) if seed % 2 else ".".join([s[:4], s[4:8], s[8:12], s[12:]])
    d = _digits(s)
    return (d, f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}", f"{d[-7:-4]}-{d[-4:]}")[seed % 4]


class Nodes(NamedTuple):
    """A document's nodes in text order, and its edges (0: chain, 1: same, 2: similar)."""

    start: list[int]
    end: list[int]
    label: list[int]        # of base spans, 0 for others
    features: list[int]     # WIDTH for each node
    damaged: list[int]      # for each base span: features of its damaged copy and the kind of edge to it, 0 for none
    edges: list[int]        # first node, second node, kind


def nodes(text: str) -> Nodes:
    base = base_spans(text)
    spans = sorted([(a, b, k) for k, a, b in base] + [(a, b, 0) for a, b in candidates(text, base)])
    owners: dict[str, list[int]] = defaultdict(list)
    strong: dict[str, bool] = {}
    out = Nodes([], [], [], [], [], [])
    for i, (a, b, label) in enumerate(spans):
        own = text[a:b]
        out.start.append(a)
        out.end.append(b)
        out.label.append(label)
        out.features.extend(features(text, a, b))
        mine = keys(own)
        for key, same in mine:
            owners[key].append(i)
            strong[key] = same
        if label:
            copy = damaged(own, label, zlib.crc32(own.encode()))
            shared = {key: same for key, same in mine}
            common = [shared[key] for key, _ in keys(copy) if key in shared]
            out.damaged.extend([*[int(o) + v for o, v in zip(_OFFSETS, _shape(copy))], *out.features[-3:],
                                1 if True in common else 2 if common else 0])
    edges: dict[tuple[int, int], int] = {}
    for i in range(len(spans) - 1):
        if spans[i + 1][0] - spans[i][1] <= NEAR:
            edges[i, i + 1] = 0
    for key, members in owners.items():
        first = next((i for i in members if spans[i][2]), None)
        pairs = list(zip(members, members[1:]))
        if first is not None:
            pairs += [(min(i, first), max(i, first)) for i in members if not spans[i][2]]
        for pair in pairs:
            if pair[0] != pair[1]:
                edges[pair] = min(edges.get(pair) or 2, 1 if strong[key] else 2)
    for (i, j), kind in edges.items():
        out.edges.extend((i, j, kind))
    return out


_EMPTY = Nodes([], [], [], [], [], [])
_CANDIDATE = np.zeros(256, bool)
_CANDIDATE[[*range(48, 58), 64]] = True


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in textops.slices(batch):
            data, rows = textops.buffers(piece.column("text"))
            some = textops.sums(_CANDIDATE[data], rows) > 0
            found = [nodes(data[rows[i]:rows[i + 1]].tobytes().decode()) if some[i] else _EMPTY for i in range(piece.num_rows)]
            lists = [pa.array([x[k] for x in found], pa.list_(pa.int32())) for k in range(len(Nodes._fields))]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *lists], names=["doc_id", *Nodes._fields])


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: its nodes and edges (see ``Nodes``). Written once, read by fit and decode."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    lists = ", ".join(f"`{c}` array<int>" for c in Nodes._fields)
    return scratch.write(rows.mapInArrow(_scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {lists}"), "nodes")[0]


class Model(NamedTuple):
    """Log potentials: of nodes (feature, label), of the chain (label, label), of skip edges whose ends agree."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray        # same, similar


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the fit: label, features, the chain's neighbours (label + 1, 0 for none) and the skip neighbours' labels."""
    n_labels = len(KINDS) + 1
    for batch in batches:
        rows = []
        for doc in batch.to_pylist():
            label, around = doc["label"], defaultdict(lambda: [0] * (2 + 2 * n_labels))
            unsure = set()
            edges = doc["edges"]
            for i, j, kind in zip(edges[0::3], edges[1::3], edges[2::3]):
                if kind == 0:
                    around[i][1], around[j][0] = label[j] + 1, label[i] + 1
                    continue
                for x, y in ((i, j), (j, i)):
                    if label[x] and not label[y]:
                        unsure.add(y)           # may well be another mention: no example of either
                    else:
                        around[x][2 + n_labels * (kind - 1) + label[y]] += 1
            base = 0
            for i, y in enumerate(label):
                f, a = doc["features"][i * WIDTH:(i + 1) * WIDTH], around[i]
                if i not in unsure:
                    rows.append([y, *f, *a])
                if y:
                    *copy, kind = doc["damaged"][base * (WIDTH + 1):(base + 1) * (WIDTH + 1)]
                    base += 1
                    for side in (0, 1) if kind else ():     # alone, and between others that are no entities
                        support = [side, side, *[0] * (2 * n_labels)]
                        rows.append([0, *copy, *support])
                        support[2 + n_labels * (kind - 1) + y] = 1
                        rows.append([y, *copy, *support])
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array(rows, pa.list_(pa.int32()))],
                                         names=["label", "row"])


def fit(scanned: DataFrame, max_rows: int = MAX_ROWS, steps: int = 600) -> Model:
    """Pseudo-likelihood fit on at most ``max_rows`` examples a label, drawn by hash."""
    n = len(KINDS) + 1
    examples = scanned.where(F.size("label") > 0).select("label", "features", "damaged", "edges") \
        .mapInArrow(_examples, "label int, row array<int>").withColumn("key", F.xxhash64("row"))
    drawn = [np.array(r.row) for y in range(n) for r in
             examples.where(F.col("label") == y).orderBy("key", "row").limit(max_rows).collect()]
    node, chain, skip = np.zeros((N_FEATURES, n)), np.zeros((n, n)), np.zeros(2)
    if not any(r[0] for r in drawn):
        node[:, 0] = 1.0        # nothing to learn from: no entity
        return Model(node, chain, skip)
    x = np.stack(drawn)
    y, f = x[:, 0], x[:, 1:1 + WIDTH]
    left, right, around = x[:, 1 + WIDTH], x[:, 2 + WIDTH], x[:, 3 + WIDTH:].reshape(len(x), 2, n)
    dense = np.zeros((len(x), N_FEATURES), np.float32)
    dense[np.arange(len(x))[:, None], f] = 1
    truth = np.eye(n)[y]
    has_left, has_right = np.eye(n + 1)[left][:, 1:], np.eye(n + 1)[right][:, 1:]
    weights = [node, chain, skip]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for t in range(1, steps + 1):
        score = dense @ node + has_left @ chain + has_right @ chain.T + np.einsum("rkl,k->rl", around, skip)
        p = np.exp(score - score.max(1, keepdims=True))
        off = (p / p.sum(1, keepdims=True) - truth) / len(x)
        slopes = [dense.T @ off + 1e-4 * node, has_left.T @ off + (has_right.T @ off).T + 1e-4 * chain,
                  np.einsum("rkl,rl->k", around, off) + 1e-4 * skip]
        for w, g, m, v in zip(weights, slopes, mean, square):     # Adam
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return Model(node, chain, np.maximum(skip, 0.0))


def beliefs(unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray, rounds: int = ROUNDS,
            known: np.ndarray | None = None) -> np.ndarray:
    """Marginals by loopy sum-product: ``unary`` (node, label) and ``potentials`` (kind, label, label)
    are logarithms, ``edges`` has first node, second node and kind. Exact on trees, given enough rounds.

    Nodes that ``known`` marks send first, then those they reach, for a few rounds; then all do. Else many
    mentions would tell one another that they are nothing before the one that is known is heard.
    """
    m = len(edges)
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    psi = np.concatenate([potentials[edges[:, 2]], potentials[edges[:, 2]].transpose(0, 2, 1)])
    back = np.concatenate([np.arange(m) + m, np.arange(m)])
    sent = np.zeros((2 * m, unary.shape[1]))
    order = np.argsort(target, kind="stable")
    ends = np.flatnonzero(np.diff(target[order], append=-1))
    receivers = target[order][ends] if m else target
    total = unary.astype(float)
    reached = np.ones(len(unary), bool) if known is None else known.copy()
    for k in range(rounds if m else 0):
        out = (total[source] - sent[back])[:, :, None] + psi
        top = out.max(1, keepdims=True)
        new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
        new -= new.max(1, keepdims=True)
        # later rounds are damped: what oscillates on loops settles
        new = new if k < rounds // 2 else (1 - DAMPING) * new + DAMPING * sent
        if known is not None:
            new[known[target]] = 0.0        # nothing changes what is known, however many send
        sends = reached[source]
        if sends.all() or k == FIRST_ROUNDS:
            reached[:] = True
        else:
            new[~sends] = sent[~sends]
            reached[target[sends]] = True
        still = sends.all() and np.abs(new - sent).max() < 1e-6
        sent = new
        sums = np.add.reduceat(sent[order], np.concatenate([[0], ends[:-1] + 1]), axis=0)
        total = unary.astype(float)
        total[receivers] += sums
        if still:
            break
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def label(found: list[dict], model: Model) -> list[np.ndarray]:
    """The labels of some documents' nodes: base spans keep theirs."""
    n = len(KINDS) + 1
    agree = np.eye(n)
    potentials = np.stack([model.chain, model.skip[0] * agree, model.skip[1] * agree])
    size = [len(d["label"]) for d in found]
    at = np.concatenate([[0], np.cumsum(size)])
    own = np.concatenate([np.array(d["label"], np.int64) for d in found])
    f = np.concatenate([np.array(d["features"], np.int64) for d in found]).reshape(-1, WIDTH)
    unary = model.node[f].sum(1) if len(f) else np.zeros((0, n))
    held = own > 0
    unary[held] = np.where(agree[own[held]] > 0, 0.0, -1e3)
    edges = np.concatenate([np.array(d["edges"], np.int64).reshape(-1, 3) + [a, a, 0] for d, a in zip(found, at.tolist())])
    best = beliefs(unary, edges, potentials, known=held).argmax(1) if len(unary) else own
    best = np.where(held, own, best)
    return [best[a:b] for a, b in zip(at, at[1:])]


def _chunks(found: list[dict]) -> Iterator[list[dict]]:
    some, size = [], 0
    for d in found:
        if some and size + len(d["label"]) > AT_ONCE:
            yield some
            some, size = [], 0
        some.append(d)
        size += len(d["label"])
    if some:
        yield some


_ENTITIES = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _entities(d: dict, best: np.ndarray) -> list[dict]:
    spans = sorted((int(k), a, b, own > 0) for k, a, b, own in zip(best, d["start"], d["end"], d["label"]) if k)
    return [{"kind": KINDS[k - 1], "start": a, "end": b, "base": base} for k, a, b, base in spans]


def decode(scanned: DataFrame, model: Model) -> DataFrame:
    """One row a document: doc_id and its entities (kind, start, end, base) by kind and start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.select(["start", "end", "label", "features", "edges"]).to_pylist()
            out = [_entities(d, best) for some in _chunks(found) for d, best in zip(some, label(some, model))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, _ENTITIES)], names=["doc_id", "entities"])

    kind = scanned.schema["doc_id"].dataType.simpleString()
    return scanned.select("doc_id", "start", "end", "label", "features", "edges").mapInArrow(
        run, f"doc_id {kind}, entities array<struct<kind: string, start: long, end: long, base: boolean>>")


def find(docs: DataFrame, model: Model | None = None, **columns: str) -> DataFrame:
    """Entities of all documents; without ``model``, one is fitted on them."""
    scanned = scan(docs, **columns)
    return decode(scanned, model or fit(scanned))


def mask(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with every entity's place in the text taken by its kind, as in "[PHONE]"."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textops.slices(batch, text):
                texts = piece.column(at).to_pylist()
                for i, t in enumerate(texts):
                    d = nodes(t)._asdict() if t else None
                    if d and d["label"]:
                        out, end = [], 0
                        for e in sorted(_entities(d, label([d], model)[0]), key=lambda e: (e["start"], -e["end"])):
                            if e["start"] >= end:
                                out += [t[end:e["start"]], f"[{e['kind'].upper()}]"]
                            end = max(end, e["end"])
                        texts[i] = "".join(out) + t[end:]
                columns = piece.columns
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=piece.schema.names)
    return docs.mapInArrow(run, docs.schema)


def report(entities: DataFrame) -> DataFrame:
    """Digest columns: counts of base spans, their SHA-256, and all spans as kind:start:end."""
    shown = "concat_ws(':', e.kind, e.start, e.end)"
    base = f"array_join(transform(filter(entities, e -> e.base), e -> {shown}), ',')"
    return entities.select(
        "doc_id", *[F.expr(f"CAST(size(filter(entities, e -> e.base AND e.kind = '{k}')) AS BIGINT) AS n_{k}") for k in KINDS],
        F.sha2(F.expr(base), 256).alias("base_sha256"),
        F.expr(f"array_join(transform(entities, e -> {shown}), ',') AS spans"),
        F.expr("CAST(size(filter(entities, e -> NOT e.base)) AS BIGINT) AS n_added"))
