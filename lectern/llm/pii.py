"""Personal data: exact recognisers, and a skip-chain conditional random field that adds what they miss.

The recognisers find e-mail addresses, IP addresses, card numbers and phone numbers. The field labels tokens as one of
these, as a secret (a credential), or as outside. Its graph has a
node for each token with a digit or an @, and for each that holds the local part of an address found in the text. All other tokens
are outside for certain, so what they tell a neighbour is a feature of it, and they part the chain. There are chain edges between
neighbours, and skip edges between distant tokens that repeat or resemble each other; edges tie each to the one
before it and to the last and the next that a recogniser found, so their number follows that of tokens and a label that a
recogniser gave reaches every mention, ahead of it or after, in one step. Loopy message passing over each document makes labels agree along both kinds: a
number that is named in full once is found again where it is cut short or written otherwise. Tokens inside a
recogniser's span are observed; spans are added for the others where the field is sure enough.

It is trained by distant supervision on about SAMPLE documents (those of least hash among those with a digit or an @ and
at most SAMPLE_CHARS long). Labels are the recognisers' own spans, secrets that stand behind a word for them and a sign of
assignment, and cut or respelt mentions of what was recognised in a document, put into it for training.
Beside each such mention the document gets a look-alike: a word of the same form with other digits and letters, in the same
surroundings, that nothing in the document answers to. Its label is outside. So what a mention itself shows cannot settle its
label, and the field has to learn it from the edges: ten digits are a phone number where one recognised elsewhere ends
in them, and outside where none does; so are numbers of a card's length with a wrong check digit. Other tokens that look like
personal data and have no label (seven digits or more, an @, or tied to a recognised one) are neither taken for it nor
for outside: they are latent, and training maximises the likelihood of the labels that are known.

An empty table trains a field of zero weights and has no spans; extra columns are left out.
"""

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import sample_by_hash, texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("outside", *KINDS, "secret")
SAMPLE, SAMPLE_CHARS = 1_500, 20_000
#: Least marginal probability of an added label, and rounds of message passing.
SURE, ROUNDS = 0.8, 12
#: Characters of the texts that share one graph; a longer text has its own.
GRAPH_CHARS = 2_000_000
SPANS = "array<struct<kind:string,start:long,stop:long,base:boolean>>"

_ANY = re.compile("[0-9@]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_LOCALS = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_SECRET = re.compile(r"\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[ ]?[=:][ ]?[\"']?([A-Za-z0-9_/+-]{16,256})", re.I)
_NUMBERS = re.compile(r"[0-9()+./-]*[0-9][0-9()+./-]*")
_THREE = re.compile(r"([0-9]{1,3})[.-]([0-9]{1,3})[.-]([0-9]{1,3})(?:[.-][0-9x]{1,3})?$")
_EDGE = "\"'.,;:!?<>[]{}#*%$&|"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) << (k & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(t: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ outwards, in time linear in the text."""
    done, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(t, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(t, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = t.find("@", max(done, at + 1))


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) by kind, then start; a match that fails its check is dropped."""
    if not _ANY.search(t):
        return []
    out = [("email", a, b) for a, b in emails(t)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(t) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(t):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(t):
        if 8 <= sum(map(m[0].count, "0123456789")) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _bucket(n: int) -> int:
    return next((k for k, top in enumerate((0, 1, 3, 6, 8, 11, 15, 19)) if n <= top), 8)


def node_features(token: str, before: str, after: str) -> list[str]:
    """Names of a token's features; before and after are its neighbours in the text, empty at an end."""
    core = token.strip(_EDGE)
    digits = re.sub("[^0-9]", "", core)
    shape = re.sub("[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", core))[:12]
    parts = core.split(".")
    out = ["1", f"digits {_bucket(len(digits))}", f"shape {shape}", f"dots {min(4, core.count('.'))}", f"long {_bucket(len(core) // 2)}"]
    octets = len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", p) and int(p) <= 255 for p in parts)
    out += [f"at {'@' in core}", f"plus {core.startswith('+')}", f"brackets {'(' in core or ')' in core}", f"digits only {core.isdigit()}", f"octets {octets}"]
    if 12 <= len(digits) <= 19:
        out.append(f"luhn {luhn(digits)} {len(digits) >= 16}")
    turns = len(re.findall("[0-9][A-Za-z]|[A-Za-z][0-9]", core))
    out += [f"turns {_bucket(turns)}", f"one word {len(core) >= 16 and core.isalnum()}", f"quoted {token[:1] in QUOTES}"]
    named = re.fullmatch(r"([A-Za-z_-]{3,12}) ?([=:])", before) or re.match(r"([A-Za-z_-]{3,12})([=:])", token)
    if named and named[1].lower() in CONTEXT:
        out.append("assigned")
    before = before.split()[-1] if before.strip() else ""
    for side, near in (("before", before), ("after", after)):
        near = re.sub("[0-9]+", "9", near.strip(_EDGE).lower())
        out.append(f"{side} {'9' if near and '9' in near else near if re.fullmatch('[a-z.:=+#-]{2,8}', near) and near.rstrip('.:=') in CONTEXT else ''}")
    return out


QUOTES = ("'", '"')
#: Words beside personal data in several languages; all others are one feature.
CONTEXT = frozenset("tel phone call fax mobile cell mail email contact card visa account ip host server token key secret password passwd version telefon karte correo llame carte".split())


def similar_keys(token: str, digits: str = "") -> list[str]:
    """Keys of a token: tokens with a key in common are joined by skip edges.

    The token itself, and what stands behind a sign of assignment in it; an address's local part, or the token as one; of the
    digits of the number that it is a part of (its own, if digits is empty), all, the first six and the last seven, as far as
    there are so many; the first three of four numbers or of three and a sign, parted by dots or dashes.
    """
    core = token.strip(_EDGE).lower()
    digits = digits or re.sub("[^0-9]", "", core)
    out = [f"= {core}"]
    _, sign, value = core.rpartition("=")
    out += [f"= {value.strip(_EDGE)}"] if sign and value.strip(_EDGE) else []
    if parts := _THREE.match(core):
        out.append(f". {parts[1]} {parts[2]} {parts[3]}")
    at = core.find("@")
    if at < 0:
        out += [f"9 {digits}", f"9< {digits[:6]}"] if len(digits) >= 6 else []
        out += [f"9> {digits[-7:]}"] if len(digits) >= 7 else []
        local = _LOCALS.match(core)
        out += [f"@ {local[0]}"] if local and len(local[0]) > 2 else []
    elif at > 2:
        out.append(f"@ {core[:at]}")
    return out


def candidates(t: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """(start, stop) of the tokens that are nodes: those with a digit or an @, and those with the local part of a recognised address in them."""
    marks = {m.start() for m in _ANY.finditer(t)}
    locals_ = {x for k, a, b in base if k == "email" and len(x := t[a:b].split("@")[0]) >= 4}
    if locals_:
        marks.update(m.start() for m in _LOCALS.finditer(t) if m[0] in locals_ or m[0].rstrip("._%+-") in locals_)
    out, place = [], 0
    for a in sorted(marks):
        if a < place:
            continue
        while a > place and t[a - 1] not in " \t\n\v\f\r":
            a -= 1
        place = _TOKEN.match(t, a).end()
        out.append((a, place))
    return out


def _numbers(t: str, tokens: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> list[str]:
    """For each token the digits of the number that it is a part of: of its recognised card or phone number, or of its run of neighbouring tokens of digits and signs."""
    own = [t[a:b].strip(_EDGE) for a, b in tokens]
    out, run = [re.sub("[^0-9]", "", w) if "@" not in w else "" for w in own], []

    def close():
        if len(run) > 1:
            whole = "".join(out[i] for i in run)
            if len(whole) <= 24:
                for i in run:
                    out[i] = whole
        run.clear()

    for i, w in enumerate(own):
        if run and t[tokens[i - 1][1] : tokens[i][0]].strip(" \t"):
            close()
        if _NUMBERS.fullmatch(w):
            run.append(i)
        else:
            close()
    close()
    spans = [(a, b) for k, a, b in base if k in ("card", "phone")]
    starts = [a for a, _ in tokens]
    for a, b in spans:
        digits, i = re.sub("[^0-9]", "", t[a:b]), max(0, bisect.bisect_right(starts, a) - 1)
        while i < len(tokens) and tokens[i][0] < b:
            if tokens[i][1] > a:
                out[i] = digits
            i += 1
    return out


class Graph:
    """Nodes and edges of a batch of texts; edge types are 0 chain and 1 skip, for repeated and for similar tokens.

    known: for each text, further spans (kind, start, stop) that training has labels for; they aren't observed.
    """

    def __init__(self, all_texts: list[str], known: list[list[tuple[str, int, int]]] | None = None):
        self.nodes, self.labels, self.observed, self.latent, self.features = [], [], [], [], []
        edges, self.base = [], []
        for d, t in enumerate(all_texts):
            base = base_spans(t)
            self.base.append(base)
            if not _ANY.search(t):
                continue
            more = known[d] if known else []
            tokens = candidates(t, base)
            numbers = _numbers(t, tokens, base)
            last: dict[str, int] = {}
            seen: dict[str, int] = {}  # the last one that a recogniser found
            own: list[tuple[int, list[str], set[int]]] = []  # each node's keys, and the earlier ones it is tied to
            before = None
            at = _Cover(base)
            for (a, b), digits in zip(tokens, numbers, strict=True):
                n, word = len(self.nodes), t[a:b]
                self.nodes.append((d, a, b))
                hit = at.kind(a, b)
                given = hit or next((k for k, x, y in more if x < b and a < y), None)
                self.labels.append(LABELS.index(given) if given else 0)
                self.observed.append(hit is not None)
                self.latent.append(not given and ("@" in word or len(digits) >= 7))
                # an observed token's label is given, so only training asks for its features
                self.features.append([] if hit and known is None else node_features(word, *_near(t, a, b)))
                if before is not None and not t[before:a].strip(" \t\n\v\f\r"):
                    edges.append((n - 1, n, 0))
                before = b
                joined, keys = set(), similar_keys(word, digits)
                own.append((n, keys, joined))
                for key in keys:
                    for x in {last.get(key), seen.get(key)} - {None} - joined:
                        edges.append((x, n, 1))
                        joined.add(x)
                    last[key] = n
                    if hit:
                        seen[key] = n
            tied = {n: joined for n, _, joined in own}
            ahead: dict[str, int] = {}  # the next one that a recogniser found
            for n, keys, _ in reversed(own):
                for x in sorted({ahead[key] for key in keys if key in ahead}):
                    if n not in tied[x]:
                        edges.append((n, x, 1))
                        tied[x].add(n)
                if self.observed[n]:
                    ahead.update(dict.fromkeys(keys, n))
        self.edges = np.array(edges, np.int64).reshape(-1, 3)
        self.texts = np.array([self.nodes[e[0]][0] for e in edges], np.int64)
        for i, j, kind in edges:
            for x, y in ((i, j), (j, i)):
                if kind and self.observed[x] and not self.labels[y]:
                    self.latent[y] = True


class _Cover:
    """Which of a text's spans, the first by kind, a token meets."""

    def __init__(self, base: list[tuple[str, int, int]]):
        self.by = [(k, [a for x, a, _ in base if x == k], [b for x, _, b in base if x == k]) for k in KINDS]

    def kind(self, a: int, b: int) -> str | None:
        for k, starts, stops in self.by:
            i = bisect.bisect_left(starts, b) - 1
            if i >= 0 and stops[i] > a:
                return k
        return None


def _near(t: str, a: int, b: int, most: int = 24) -> tuple[str, str]:
    """The tokens before and after, as far as they are within a few characters; before a sign of assignment, with the word before that."""
    left, right = t[max(0, a - most) : a].split(), t[b : b + most].split()
    return " ".join(left[-2:] if left[-1:] in (["="], [":"]) else left[-1:]), right[0] if right else ""


def _norm(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1, keepdims=True)
    return x - top - np.log(np.exp(x - top).sum(axis=1, keepdims=True))


def propagate(node: np.ndarray, edges: np.ndarray, pair: np.ndarray, rounds: int = ROUNDS, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Loopy sum-product: log marginals of the nodes and of the edges (labels of first and second end).

    node: (nodes, labels) log potentials; pair: (types, labels, labels); groups: each edge's text. A text's messages stop when
    they have settled, so what comes out doesn't depend on the texts that share its graph.
    """
    n, k = node.shape
    e = len(edges)
    if not e:
        return _norm(node), np.zeros((0, k, k))
    src, dst, psi = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]]), pair[edges[:, 2]]
    ways, mats = np.concatenate([edges[:, 2], edges[:, 2] + len(pair)]), np.exp(np.concatenate([pair, pair.transpose(0, 2, 1)]))
    back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
    msg, order = np.zeros((2 * e, k)), np.argsort(dst, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(dst[order]) > 0])
    into = dst[order][starts]

    def belief():
        b = node.copy()
        b[into] += np.add.reduceat(msg[order], starts)
        return b

    groups = np.zeros(e, np.int64) if groups is None else np.unique(groups, return_inverse=True)[1]
    groups, live = np.concatenate([groups, groups]), np.arange(2 * e)
    for _ in range(rounds):
        x = belief()[src[live]] - msg[back[live]]
        x, way = np.exp(x - x.max(axis=1, keepdims=True)), ways[live]
        out = np.empty_like(x)
        for w in np.unique(way):
            out[way == w] = x[way == w] @ mats[w]
        new = _norm(np.log(out))
        moved = np.zeros(groups.max() + 1)
        np.maximum.at(moved, groups[live], np.abs(np.exp(new) - np.exp(msg[live])).max(axis=1))
        done = moved[groups[live]] < 1e-4
        msg[live] = np.where(done[:, None], new, np.logaddexp(np.log(0.3) + msg[live], np.log(0.7) + new))
        live = live[~done]
        if not len(live):
            break
    b = belief()
    left, right = (b[edges[:, 0]] - msg[e:])[:, :, None], (b[edges[:, 1]] - msg[:e])[:, None, :]
    both = (left + right + psi).reshape(e, -1)
    return _norm(b), _norm(both).reshape(e, k, k)


class Field:
    """Weights: names maps features to rows of weight; pair has a table of label pairs for each edge type."""

    def __init__(self, names: dict[str, int], weight: np.ndarray, pair: np.ndarray):
        self.names, self.weight, self.pair = names, weight, pair

    def node(self, g: Graph) -> np.ndarray:
        out = np.zeros((len(g.nodes), len(LABELS)))
        for i, fs in enumerate(g.features):
            out[i] = self.weight[[self.names[f] for f in fs if f in self.names]].sum(axis=0)
        return out

    def label(self, g: Graph) -> np.ndarray:
        """Marginals (nodes, labels), given the observed tokens' labels."""
        node = self.node(g)
        seen = np.flatnonzero(g.observed)
        node[seen] = -50.0
        node[seen, np.array(g.labels)[seen]] = 0.0
        return np.exp(propagate(node, g.edges, self.pair, groups=g.texts)[0])


def variants(kind: str, span: str) -> list[str]:
    """Ways to write a recognised span short or otherwise, as people do; each of one token, or of numbers side by side."""
    digits = re.sub("[^0-9]", "", span)
    if kind == "email":
        local, host = span.split("@", 1)
        return [f"{local}@{host.split('.')[0]}", local, f"{local}(at){host}", f"{local}@"]
    if kind == "ip":
        parts = span.split(".")
        return [".".join(parts[:3]), "-".join(parts), ".".join(parts[:3]) + ".x"]
    if kind == "card":
        at = (len(digits) - 1) // 2
        slip = digits[:at] + str((int(digits[at]) + 1) % 10) + digits[at + 1 :]
        return [digits[:12], digits[:10], digits[:8], slip, ".".join(digits[k : k + 4] for k in range(0, len(digits), 4)), digits[:-1]]
    return [span.lstrip("+"), digits, digits[-10:], f"{digits[-10:-7]} {digits[-7:-4]} {digits[-4:]}"]


def _put(t: str, words: list[tuple[str, str]], rng: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with each word of a label put in at a white space outside of the recognised spans, and where these are."""
    gaps = [m.start() for m in re.finditer(r"[\x20\n]", t)]
    busy = [(a, b) for _, a, b in base_spans(t)]
    free = [g for g in gaps if all(g < x or g > y for x, y in busy)] or [len(t)]
    put = [(free[int(rng.integers(0, len(free)))], kind, word) for kind, word in words]
    parts, at, size, spans = [], 0, 0, []
    for place, kind, way in sorted(put):
        parts += [t[at:place], " then ", way, " said"]
        start = size + place - at + 6
        spans.append((kind, start, start + len(way)))
        size, at = start + len(way) + 5, place
    return "".join([*parts, t[at:]]), spans


def planted(t: str, rng: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with a variant of each of its recognised spans put in at a white space somewhere, and where these are."""
    ways = [(kind, variants(kind, t[a:b])) for kind, a, b in base_spans(t)]
    return _put(t, [(kind, w[int(rng.integers(0, len(w)))]) for kind, w in ways], rng)


def look_alike(word: str, rng: np.random.Generator) -> str:
    """A word of the same form, its digits and letters drawn anew; no card number."""
    while True:
        letter = lambda c: chr(ord("a" if c.islower() else "A") + int(rng.integers(0, 6 if c in "abcdef" else 26)))
        out = "".join(str(int(rng.integers(1, 10))) if c in "0123456789" else letter(c) if c.isascii() and c.isalpha() else c for c in word)
        if not base_spans(out):
            return out


def _abroad(rng: np.random.Generator) -> str:
    """A phone number with another country's code, in groups of digits."""
    digits = lambda n: "".join(str(x) for x in rng.integers(1, 10, n))
    return " ".join(["+" + digits(2), *(digits(int(n)) for n in rng.integers(2, 5, 3))])


def contested(t: str, secrets: list[tuple[str, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with a variant of each recognised span and a repeat of each secret put in, and for each of these a look-alike, now and then two of it, labelled outside.

    For each phone number the same is done with one of another country, whose whole form is put in too.
    """
    words, known = [], [(kind, t[a:b]) for kind, a, b in [*base_spans(t), *secrets]]
    abroad = [("phone", _abroad(rng)) for kind, _ in known if kind == "phone"]
    words += abroad
    for kind, word in known + abroad:
        ways = variants(kind, word) if kind != "secret" else [word, f'"{word}"']
        way = ways[int(rng.integers(0, len(ways)))]
        other = look_alike(way, rng)
        words += [(kind, way)] + [("outside", other)] * (1 + int(rng.integers(0, 3) == 0))
    return _put(t, words, rng)


def fit(sample: list[str], rounds: int = 80, rate: float = 0.2, ridge: float = 0.02, seed: int = 0) -> Field:
    """Maximises the likelihood of the known labels, latent ones summed over, with the marginals of loopy message passing, by Adam. No texts give weights of zero."""
    rng = np.random.default_rng(seed)
    secrets = lambda t: [("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(t)]
    rows = [(u, spans + secrets(u)) for u, spans in (contested(t, secrets(t), rng) for t in sample)]
    g = Graph([t for t, _ in rows], [k for _, k in rows])
    names: dict[str, int] = {}
    for fs in g.features:
        for f in fs:
            names.setdefault(f, len(names))
    k, n = len(LABELS), len(g.nodes)
    y = np.array(g.labels)
    field = Field(names, np.zeros((len(names), k)), np.zeros((2, k, k)))
    if not n:
        return field
    at = np.array([(i, names[f]) for i, fs in enumerate(g.features) for f in fs])
    fixed = np.flatnonzero(~np.array(g.latent))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (field.weight, field.pair)]
    for r in range(1, rounds + 1):
        node = np.zeros((n, k))
        np.add.at(node, at[:, 0], field.weight[at[:, 1]])
        lb, le = propagate(node, g.edges, field.pair, 6)
        held = node.copy()
        held[fixed] = -50.0
        held[fixed, y[fixed]] = 0.0
        hb, he = propagate(held, g.edges, field.pair, 6)
        gw, gp = np.zeros_like(field.weight), np.zeros_like(field.pair)
        np.add.at(gw, at[:, 1], (np.exp(hb) - np.exp(lb))[at[:, 0]])
        if len(g.edges):
            np.add.at(gp, g.edges[:, 2], np.exp(he) - np.exp(le))
        for p, grad, (m, v) in zip((field.weight, field.pair), (gw, gp), state, strict=True):
            grad = grad - ridge * p
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            p += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return field


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> Field:
    """fit() on the bounded sample that the module's docstring states."""
    d = texts(docs, id_col, text_col).filter((F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike("[0-9@]"))
    rows = sample_by_hash(d, F.xxhash64("doc_id", "text"), most)
    return fit(sorted(r.text for r in rows.select("text").collect()))


def spans_of(all_texts: list[str], field: Field, sure: float = SURE, skip: bool = True) -> list[list[tuple[str, int, int, bool]]]:
    """For each text, (kind, start, stop, base) by kind, then start. Added spans run over neighbouring tokens of one label and meet no base span.

    Texts share a graph while they have GRAPH_CHARS together; this changes no result. skip=False leaves the skip edges out, to measure what they do.
    """
    out, some, size = [], [], 0
    for t in all_texts:
        if some and size + len(t) > GRAPH_CHARS:
            out += _graph_spans(some, field, sure, skip)
            some, size = [], 0
        some.append(t)
        size += len(t)
    return out + _graph_spans(some, field, sure, skip)


def _graph_spans(all_texts: list[str], field: Field, sure: float, skip: bool) -> list[list[tuple[str, int, int, bool]]]:
    g = Graph(all_texts)
    if not skip:
        chain = g.edges[:, 2] == 0
        g.edges, g.texts = g.edges[chain], g.texts[chain]
    out = [[(k, a, b, True) for k, a, b in base] for base in g.base]
    if g.nodes:
        p = field.label(g)
        best = p.argmax(axis=1)
        best[(p.max(axis=1) < sure) | np.array(g.observed)] = 0
        chained = {(int(i), int(j)) for i, j, t in g.edges if t == 0}
        run = None
        for i in np.flatnonzero(best).tolist():
            d, a, b = g.nodes[i]
            t = all_texts[d][a:b]
            core = t.strip(_EDGE)
            a += t.find(core)
            b = a + len(core)
            if run and run[0] == i - 1 and run[1] == best[i] and (i - 1, i) in chained:
                out[d][-1] = (out[d][-1][0], out[d][-1][1], b, False)
            else:
                out[d].append((LABELS[best[i]], a, b, False))
            run = i, best[i]
    return [sorted(x, key=lambda s: (LABELS.index(s[0]), s[1])) for x in out]


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every whole text, spans by kind, then start, in code points, base telling the recognisers' own.

    A null text is empty and has none; repeated rows and null ids stay; an empty table has no rows; extra columns are left out. No shuffle; the field, whose size the sample bounds, is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf(SPANS)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "start", "stop", "base"), x, strict=True)) for x in spans] for spans in spans_of(s.tolist(), sent.value)], dtype=object)

    return texts(docs, id_col, text_col).select("doc_id", run("text").alias("spans"))


def redacted(field: Field, spark):
    """A function from a text column to the text with each span replaced by its kind in brackets; overlapping spans are replaced once, by the first."""
    sent = spark.sparkContext.broadcast(field)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        whole = s.fillna("").tolist()
        out = []
        for null, t, spans in zip(s.isna(), whole, spans_of(whole, sent.value), strict=True):
            parts, at = [], 0
            for kind, a, b, _ in sorted(spans, key=lambda x: (x[1], x[2])):
                if a >= at:
                    parts += [t[at:a], f"[{kind.upper()}]"]
                at = max(at, b)
            out.append(None if null else "".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    return run


def digests(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text, of find()'s rows."""
    show = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(show(base), 256).alias("base_sha256"),
        show(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: ~x["base"])).cast("long").alias("n_added"),
        F.size("spans").cast("long").alias("n_spans"),
    )
