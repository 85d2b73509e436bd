"""PII: a skip-chain conditional random field with loopy message passing."""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import ragged
from quern.llm.shared import map_arrow, need, table

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "SSN", "IBAN", "SECRET", "NAME")
#: Labelled training documents (synthetic, seeded) and steps of gradient ascent.
TRAIN_DOCS, STEPS = 700, 120
#: Messages are passed until none changes by more than this, or for so many rounds where they don't settle.
TOLERANCE, ROUNDS = 1e-3, 100
#: Tokens that share so many first letters and digits, but not all, are similar.
PREFIX = 6
SCHEMA = "doc_id long, entity string, start int, stop int"

_CUES = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|key|credential"
_TESTS = {
    "email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    "at": r"@",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "dotted": r"\d+\.\d+\.\d+\.\d+",
    "card": r"(?<!\d)(?:4\d{12}(?:\d{3})?|5[1-5]\d{14}|2[2-7]\d{14}|3[47]\d{13}|6(?:011|5\d\d)\d{12})(?!\d)",
    "card_parts": r"(?<!\d)(?:\d{4}-){3}\d{4}(?!\d)",
    "long_number": r"(?<!\d)\d{13,19}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "plus": r"^[(\"']*\+\d{1,3}(?!\d)",
    "area": r"^\(\d{2,4}\)",
    "local": r"^\(?\d{3}[-.]\d{4}(?!\d|-\d)",
    "phone": r"(?<![\d-])(?:\+?\d{1,3}[-.])?\(?\d{3}\)?[-.]\d{3}[-.]\d{4}(?![\d-])",
    "aws": r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])",
    "prefixed": r"(?<!\w)(?:ghp_|gho_|sk-|sk_live_|xox[bp]-)[A-Za-z0-9_-]{16,}",
    "assigned": rf"(?i)(?<![a-z])(?:{_CUES})\w*[\"']?[=:][\"']?[^\s\"']{{4,}}",
    "equals": r"=",
    "hex": r"(?i)(?<![0-9a-f])(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{16,}(?![0-9a-f])",
    "mixed": r"(?=\S*\d)(?=\S*[A-Za-z])[A-Za-z0-9+/_-]{16,}",
    "year": r"^\W*(?:1[89]|20)\d\d\W*$",
    "small": r"^\W*\d{1,3}\W*$",
    "whole": r"^\W*\d+\W*$",
    "decimal": r"^\W*\d+[.,]\d+\W*$",
    "ordinal": r"^\W*\d+(?:st|nd|rd|th|s)\W*$",
    "ipv6": r"(?i)(?<![\w:])(?=[0-9a-f:]*\d)(?=(?:[0-9a-f]*:){3}|[0-9a-f]*::)[0-9a-f:]{5,44}[0-9a-f](?![\w:])",
    "quad": r"^\W*\d{4}\W*$",
    "iban_head": r"^\W*[A-Z]{2}\d{2}$",
    "area_code": r"^0\d{2,4}$",
    "seven": r"^\W*\d{5,8}\W*$",
    "clock": r"^\W*\d{1,2}:\d{2}(?::\d{2})?\W*$",
    "url": r"^\W*(?:https?://|www\.)",
    "letters": r"[A-Za-z]",
}
_RX = {k: re.compile(v) for k, v in _TESTS.items()}
_CUE = re.compile(rf"(?i)^\W*(?:{_CUES})\W*$")
_FEATURES = ("bias", *_TESTS, "luhn", "cue_before", "cue_equals_before", "cue_is_before", "phone_word_before", "long_word", "titled", "capital", "quoted")
_AT = {f: i for i, f in enumerate(_FEATURES)}
_HONORIFIC = np.sort(ragged.hash_words(["mr", "mrs", "ms", "dr", "prof", "herr", "frau", "señor", "señora", "madame", "monsieur", "contact", "dear"]).hash)
_CUE_WORD = np.sort(ragged.hash_words(["password", "passwd", "passphrase", "pwd", "secret", "token", "key", "apikey", "credential", "auth"]).hash)
#: Names go on for so many capitalised words.
NAME_WORDS = 3
_PHONE_WORD = re.compile(r"(?i)^\W*(?:tel|phone|telephone|call|fax|mobile|cell)\W*$")
_VALUE = re.compile(r"[\"']?[=:][\"']?(.*)$", re.S)
_FLAG = np.zeros(256, bool)
_FLAG[48:58] = _FLAG[ord("@")] = _FLAG[ord("=")] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def features(token: str, before: str, before2: str, named: bool) -> list[int]:
    """Indices of the features that a node has."""
    out = [0]
    if named:
        out.append(_AT["titled"])
    if token[:1].isupper():
        out.append(_AT["capital"])
    if _CUE.match(before):
        out.append(_AT["cue_before"])
    if before.strip("\"'*#&$%|!") in ("=", ":", ":=") and _CUE.match(before2):
        out.append(_AT["cue_equals_before"])
    if before == "is" and _CUE.match(before2):
        out.append(_AT["cue_is_before"])
    if token[:1] in "\"'":
        out.append(_AT["quoted"])
    if not any(c.isdigit() or c in "@=" for c in token):
        if len(token) >= 12:
            out.append(_AT["long_word"])
        return out
    out += [_AT[k] for k, r in _RX.items() if r.search(token)]
    if (m := _RX["long_number"].search(token)) and _luhn(m[0]):
        out.append(_AT["luhn"])
    if _PHONE_WORD.match(before):
        out.append(_AT["phone_word_before"])
    return out


def likeness(token: str) -> str:
    """What repeated and similar tokens have in common: their letters and digits, without a value's name."""
    m = _VALUE.search(token) if "=" in token or _RX["assigned"].search(token) else None
    return "".join(c for c in (m[1] if m else token).lower() if c.isalnum())


class Graph:
    """Nodes of many documents: feature lists, chain edges, edges between repeats and between similar tokens, and
    whether a side is plain text.

    keys: (document, likeness) of each node.  Of each likeness the node with the most features, the telling one, is
    joined with all others, so that no mention is further from it than one step; likenesses with a common
    prefix are joined by theirs.  `scale` divides the evidence of mentions that look alike in every feature among them:
    a hundred bare mentions weigh as much as one.
    """

    def __init__(self, feats: list[list[int]], chain: np.ndarray, keys: list[tuple]):
        n = len(feats)
        self.n = n
        self.rows = np.repeat(np.arange(n), [len(f) for f in feats])
        self.cols = np.array([x for f in feats for x in f], np.int64)
        self.edges = [chain.reshape(-1, 2), *_skips(keys, feats)]
        self.open_left, self.open_right = np.ones(n, bool), np.ones(n, bool)
        self.open_right[self.edges[0][:, 0]] = False
        self.open_left[self.edges[0][:, 1]] = False
        alike = [(k, tuple(f)) if len(k[1]) >= 4 else (i,) for i, (k, f) in enumerate(zip(keys, feats))]
        count: dict[tuple, int] = {}
        for k in alike:
            count[k] = count.get(k, 0) + 1
        self.scale = np.array([1 / count[k] for k in alike])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def potentials(g: Graph, w: dict[str, np.ndarray]) -> tuple[np.ndarray, list]:
    """Unary log potentials of the nodes, and each kind of edge with its log potential."""
    unary = np.zeros((g.n, len(LABELS)))
    np.add.at(unary, g.rows, w["unary"][g.cols])
    unary[g.open_left] += w["chain"][0]
    unary[g.open_right] += w["chain"][:, 0]
    return unary * g.scale[:, None], list(zip(g.edges, (w["chain"], w["skip"], w["near"])))


def beliefs(g: Graph, w: dict[str, np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE):
    """Log marginals of the nodes and of all kinds of edges, by loopy sum-product message passing.

    Tokens that are no nodes are plain text with label O, so a node at the end of a run of nodes meets
    the potential of a step from or to O.  Messages are sent along all edges of all documents at once,
    until they settle.
    """
    size = len(LABELS)
    unary, sides = potentials(g, w)
    right = [np.zeros((len(e), size)) for e, _ in sides]
    left = [np.zeros((len(e), size)) for e, _ in sides]
    total = unary
    for _ in range(rounds):
        change = 0.0
        for k, (e, p) in enumerate(sides):
            if not len(e):
                continue
            a = _lse((total[e[:, 0]] - left[k])[:, :, None] + p, 1)
            b = _lse((total[e[:, 1]] - right[k])[:, None, :] + p, 2)
            a = 0.3 * right[k] + 0.7 * (a - a.max(1, keepdims=True))
            b = 0.3 * left[k] + 0.7 * (b - b.max(1, keepdims=True))
            change = max(change, np.abs(a - right[k]).max(), np.abs(b - left[k]).max())
            right[k], left[k] = a, b
        total = unary.copy()
        for k, (e, _) in enumerate(sides):
            np.add.at(total, e[:, 1], right[k])
            np.add.at(total, e[:, 0], left[k])
        if change <= tolerance:
            break
    node = total - _lse(total, 1)[:, None]
    pairs = []
    for k, (e, p) in enumerate(sides):
        x = (total[e[:, 0]] - left[k])[:, :, None] + p + (total[e[:, 1]] - right[k])[:, None, :]
        pairs.append(x - _lse(x.reshape(len(e), -1), 1)[:, None, None] if len(e) else x)
    return node, pairs


def _skips(keys: list[tuple], feats: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the telling node of each likeness and its other mentions, and between the telling nodes
    of a document's likenesses that share a prefix; likenesses of under 4 letters and digits have none."""
    members: dict[tuple, list[int]] = {}
    for i, k in enumerate(keys):
        if len(k[1]) >= 4:
            members.setdefault(k, []).append(i)
    same, near, prefix = [], [], {}
    for (doc, like), nodes in members.items():
        centre = max(nodes, key=lambda i: (len(feats[i]), -i))
        same += [(centre, i) for i in nodes if i != centre]
        if len(like) >= PREFIX:
            prefix.setdefault((doc, like[:PREFIX]), []).append(centre)
    for centres in prefix.values():
        hub = max(centres, key=lambda i: (len(feats[i]), -i))
        near += [(hub, i) for i in centres if i != hub]
    return tuple(np.array(e, np.int64).reshape(-1, 2) for e in (same, near))


def training_documents(n: int = TRAIN_DOCS, seed: int = 7) -> list[list[tuple[str, str, bool]]]:
    """Synthetic documents as (token, label, follows an honorific), with entities, mentions of them later
    in bare form, and numbers that are no entities."""
    r = random.Random(seed)
    many = lambda: 40 if r.random() < 0.03 else r.choice([0, 1, 1, 2, 3, 6])
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k - 2)) + "7c"
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8)))
    tail = lambda x: x + r.choice(["", "", "", ",", ".", ";", "!!", "###", "&&&", ")"])
    card = lambda: r.choice(["4" + digits(15), "5" + r.choice("12345") + digits(14), "37" + digits(13)])
    ip = lambda: ".".join(str(r.randint(1, 255)) for _ in range(4))
    docs = []
    for _ in range(n):
        doc: list[tuple[str, str, bool]] = []
        late: list[list[tuple[str, str, bool]]] = []
        add = lambda *x: doc.extend((t, y, False) for t, y in x)
        for _ in range(r.randint(2, 7)):
            doc += [(word(), "O", False) for _ in range(r.choice([0, 1, 2, 3, 4, 5]))]
            kind = r.choice((*range(23), 9, 9, 14, 14, 14))
            if kind == 0:
                e = f"{word()}.{digits(2)}@{word()}.{r.choice(['com', 'org', 'example.com', 'co.uk'])}"
                add((tail(e), "EMAIL"))
                late += [[(tail(e), "EMAIL", False)] for _ in range(r.randint(0, 2))]
            elif kind == 1:
                add(("+" + str(r.randint(1, 99)), "PHONE"), (f"({digits(3)})", "PHONE"), (tail(f"{digits(3)}-{digits(4)}"), "PHONE"))
            elif kind == 2:
                p = r.choice([f"{digits(3)}-{digits(3)}-{digits(4)}", f"({digits(3)}){digits(3)}-{digits(4)}".replace(")", ")-"), f"{digits(3)}.{digits(3)}.{digits(4)}"])
                add((tail(p), "PHONE"))
            elif kind == 3:
                i = ip()
                add((tail(i), "IP"))
                late.append([(tail(i), "IP", False)])
            elif kind == 4:
                c = card()
                add((tail(c), "CARD"))
                late.append([(tail("-".join(c[i : i + 4] for i in range(0, 16, 4)) if len(c) == 16 and r.random() < 0.3 else c), "CARD", False)])
            elif kind == 5:
                add((tail(f"{digits(3)}-{digits(2)}-{digits(4)}"), "SSN"))
            elif kind == 6:
                add((tail(r.choice(["DE", "FR", "ES", "GB"]) + digits(2) + digits(18)), "IBAN"))
            elif kind == 7:
                h = hexes(r.choice([16, 18, 32, 40]))
                add((r.choice(["token", "secret", "password", "api_key"]), "O"), (r.choice(["=", ":"]), "O"), (tail(f'"{h}"'), "SECRET"))
                late += [[(h, "SECRET", False)] for _ in range(many())]
                if r.random() < 0.2:
                    late.append([(h[: r.randint(12, 15)], "SECRET", False)])
            elif kind == 8:
                h = hexes(r.choice([12, 16, 18, 24]))
                add((tail(f"{r.choice(['password', 'token', 'pwd', 'secret'])}{r.choice('=:')}{h}"), "SECRET"))
                late += [[(h, "SECRET", False)] for _ in range(many())]
            elif kind == 9:
                add((tail(r.choice(["AKIA" + "".join(r.choice("ABCDEFGH234567") for _ in range(15)) + "7", "ghp_" + hexes(32)])), "SECRET"))
            elif kind == 10:
                name = word().title() + r.choice(["s", "son", "er"])
                first = [(word().title() + "a", "NAME", True)] if r.random() < 0.4 else []
                doc += [(r.choice(["Mr.", "Mrs.", "Dr.", "Prof."]), "O", False), *first, (tail(name), "NAME", True)]
                late += [[(tail(name), "NAME", False)] for _ in range(r.randint(0, 2))]
            elif kind == 11:
                add((tail(r.choice([digits(r.randint(1, 5)), str(r.randint(1800, 2030)), f"{digits(1)}.{digits(r.randint(1, 3))}", f"{digits(2)}th", f"x={digits(2)}"])), "O"))
            elif kind == 12:
                add((tail(f"{r.randint(256, 999)}.{digits(1)}.{digits(2)}.{r.randint(256, 999)}"), "O"))
            elif kind == 13:
                add((tail(r.choice(["v", "id", "n"]) + digits(r.randint(2, 9))), "O"), (tail(digits(r.choice([6, 8, 9, 10, 12, 20, 24]))), "O"))
            elif kind == 14:
                h = hexes(r.choice([16, 32, 40, 64]))
                add((r.choice(["commit", "sha", "digest", word()]), "O"), (tail(h), "O"))
                late += [[(h, "O", False)] for _ in range(r.choice([0, 0, 0, 1, 2, 6]))]
            elif kind == 15:
                c = digits(16)
                add(*((x, "CARD") for x in (c[:4], c[4:8], c[8:12], tail(c[12:]))))
            elif kind == 16:
                i = [r.choice(["DE", "FR", "ES", "GB"]) + digits(2), *(digits(4) for _ in range(r.randint(3, 5))), *[digits(2)] * r.randint(0, 1)]
                add(*((x, "IBAN") for x in i[:-1]), (tail(i[-1]), "IBAN"))
            elif kind == 17:
                add((r.choice(["call", "tel", "phone", word()]), "O"), ("0" + digits(r.randint(2, 4)), "PHONE"), (tail(digits(r.randint(5, 8))), "PHONE"))
            elif kind == 18:
                add((tail(r.choice(["2001:db8::", "fe80::", f"{hexes(4)}:{hexes(4)}:{digits(4)}:"]) + f"{hexes(4)}:{digits(2)}:{hexes(4)}"), "IP"))
            elif kind == 19:
                h = "".join(word() for _ in range(4))[: r.randint(8, 20)] + "xy"
                add(*r.choice([[("password:", "O")], [("secret", "O"), ("=", "O")], [("token", "O"), (":", "O")]]), (tail(h), "SECRET"))
            elif kind == 20:
                h = ("".join(word() for _ in range(5)) + "abcdefghijk")[: r.randint(14, 24)]
                add(("key", "O"), ("is", "O"), (tail(h), "SECRET"))
            elif kind == 21:
                add((tail(f"{digits(2)}:{digits(2)}:{digits(2)}"), "O"), (tail(digits(4)), "O"), (word(), "O"), (tail(digits(4)), "O"), (digits(3), "O"), (tail(digits(r.randint(5, 8))), "O"))
            else:
                add((f"https://{word()}.com/{digits(4)}?a={digits(2)}", "O"), (tail(f"{r.randint(1, 12)}/{r.randint(1, 28)}/20{digits(2)}"), "O"), (tail(f"20{digits(2)}-0{r.randint(1, 9)}-1{digits(1)}"), "O"))
        for mention in late:
            doc += [(word(), "O", False) for _ in range(r.randint(1, 3))] + mention
        docs.append(doc)
    return docs


def _after_cue(doc: list[tuple[str, str, bool]], i: int) -> bool:
    """Whether a token stands where a secret of letters alone may stand."""
    before = [t for t, *_ in doc[max(0, i - 2) : i]]
    if len(doc[i][0]) < 5 or not before:
        return False
    if _CUE.match(before[-1]) and before[-1][-1:] in ":=":
        return True
    return len(before) > 1 and bool(_CUE.match(before[0])) and (before[1] in ("=", ":", ":=") or before[1] == "is" and len(doc[i][0]) >= 12)


def graph_of(docs: list[list[tuple[str, str, bool]]]) -> tuple[Graph, np.ndarray]:
    """The graph and labels of tokenised documents."""
    feats, keys, chain, labels = [], [], [], []
    for d, doc in enumerate(docs):
        names = {likeness(t) for t, _, named in doc if named}
        last = -2
        for i, (t, y, named) in enumerate(doc):
            if named or any(c.isdigit() or c in "@=" for c in t.strip('"')) and t != "=" or (t[:1].isupper() and likeness(t) in names) or _after_cue(doc, i):
                feats.append(features(t, doc[i - 1][0] if i else "", doc[i - 2][0] if i > 1 else "", named))
                keys.append((d, likeness(t)))
                labels.append(LABELS.index(y))
                if last == i - 1:
                    chain.append((len(feats) - 2, len(feats) - 1))
                last = i
    return Graph(feats, np.array(chain, np.int64), keys), np.array(labels)


@lru_cache(maxsize=1)
def trained() -> dict[str, np.ndarray]:
    """Weights that maximise the regularised likelihood of the training documents, with the expected
    counts of the gradient taken from loopy marginals (Adam steps)."""
    g, y = graph_of(training_documents())
    size = len(LABELS)
    w = {"unary": np.zeros((len(_FEATURES), size)), "chain": np.zeros((size, size)), "skip": np.zeros((size, size)), "near": np.zeros((size, size))}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    hot = np.eye(size)[y]
    for step in range(1, STEPS + 1):
        node, pairs = beliefs(g, w, 5)
        diff = hot - np.exp(node)
        grad = {"unary": np.zeros_like(w["unary"]), "chain": np.zeros((size, size)), "skip": np.zeros((size, size)), "near": np.zeros((size, size))}
        diff = diff * g.scale[:, None]
        np.add.at(grad["unary"], g.cols, diff[g.rows])
        for k, (e, p) in zip(("chain", "skip", "near"), zip(g.edges, pairs)):
            np.add.at(grad[k], (y[e[:, 0]], y[e[:, 1]]), 1.0)
            grad[k] -= np.exp(p).sum(0)
        grad["chain"][0] += diff[g.open_left].sum(0)
        grad["chain"][:, 0] += diff[g.open_right].sum(0)
        # one weight for agreement, whatever the label: else the mentions' number would speak for some
        grad["skip"], grad["near"] = (np.eye(size) * np.trace(grad[k]) / size for k in ("skip", "near"))
        for k in w:
            d = grad[k] / g.n - 1e-4 * w[k]
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            w[k] += 0.3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return w


def _core(token: str, label: str) -> tuple[int, int]:
    """Which part of a token is the entity."""
    rx = {"EMAIL": ("email",), "IP": ("ip", "ipv6"), "CARD": ("card", "card_parts", "long_number"), "SSN": ("ssn",), "IBAN": ("iban",), "PHONE": ("phone",), "SECRET": ("aws", "prefixed", "hex")}.get(label, ())
    if label == "SECRET" and _RX["assigned"].search(token) and (m := _VALUE.search(token)):
        return m.start(1), m.start(1) + max(1, len(m[1].rstrip("\"'.,;:!?*#&$%)|")))
    for k in rx:
        if m := _RX[k].search(token):
            return m.span()
    a = len(token) - len(token.lstrip("\"'*#&$%|,;:!?[{<" + ("" if label == "PHONE" else "(")))
    b = len(token.rstrip("\"'.,;:!?*#&$%|]}>" + ("" if label == "PHONE" and token[:1] == "(" else ")")))
    return (a, b) if b > a else (0, len(token))


def _secrets_at(raw: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, cue: np.ndarray) -> np.ndarray:
    """Tokens that `_after_cue` would take, by the tokens that hold a cue."""
    mark = lambda i: np.isin(raw[i], (58, 61))
    size = end - start
    cue = cue[cue + 1 < start.size]
    ends = mark(end[cue] - 1)
    one = cue[~ends & (cue + 2 < start.size)]
    apart = mark(start[one + 1]) & (size[one + 1] <= 2)
    said = (size[one + 1] == 2) & (raw[start[one + 1]] == 105) & (raw[np.minimum(start[one + 1] + 1, raw.size - 1)] == 115) & (size[one + 2] >= 12)
    at, by = np.concatenate([cue[ends] + 1, one[apart | said] + 2]), np.concatenate([cue[ends], one[apart | said]])
    return at[(doc[at] == doc[by]) & (size[at] >= 5)]


def spans(col: pa.Array, lo: int, hi: int, w: dict[str, np.ndarray]) -> list[tuple[int, str, int, int]]:
    """Entities of the texts lo..hi as (text index, label, first byte, end byte in the slice)."""
    off = ragged.offsets(col)[lo : hi + 1]
    base, size = int(off[0]), int(off[-1] - off[0])
    if not size:
        return []
    raw = np.frombuffer(col.buffers()[2], np.uint8, size, base)
    at = off - base
    ink = np.zeros(size + 2, np.int8)
    ink[1:-1] = ~_BLANK[raw]
    edge = np.diff(ink)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = at[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < size)])
    cut = cut[(ink[cut] == 1) & (ink[cut + 1] == 1)]
    if cut.size:
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    flags = np.zeros(size + 1, np.int64)
    np.cumsum(_FLAG[raw], out=flags[1:])
    node = flags[end] > flags[start]
    named = np.zeros(start.size, bool)
    doc = np.searchsorted(at, start, side="right") - 1
    words = ragged.words(col, lo, hi)
    title = np.flatnonzero(ragged.member(_HONORIFIC, words.hash))
    title = title[title + 1 < words.hash.size]
    title = title[(words.doc[title] == words.doc[title + 1]) & (words.start[title + 1] - words.end[title] <= 3)]
    upper = lambda i: ((raw[words.start[i]] >= 65) & (raw[words.start[i]] <= 90)) | (raw[words.start[i]] == 0xC3)
    lower = lambda i: (words.end[i] - words.start[i] > 1) & (words.low[words.end[i] - 1] == raw[words.end[i] - 1])
    title = title[upper(title) & upper(title + 1) & lower(title + 1)] + 1
    run = title
    for _ in range(NAME_WORDS - 1):  # names of more than one word
        run = run[run + 1 < words.hash.size] + 1
        run = run[(words.doc[run] == words.doc[run - 1]) & (words.start[run] - words.end[run - 1] == 1) & (raw[words.end[run - 1]] == 32) & upper(run) & lower(run)]
        title = np.append(title, run)
    cue = np.flatnonzero(ragged.member(_CUE_WORD, words.hash))
    if cue.size:
        node[_secrets_at(raw, start, end, doc, np.unique(np.searchsorted(start, words.start[cue], side="right") - 1))] = True
    if title.size:
        token = np.searchsorted(start, words.start[title], side="right") - 1
        named[token] = node[token] = True
        salt = ragged.mix(words.doc.astype(np.uint64))
        again = np.flatnonzero(np.isin(words.hash ^ salt, np.unique((words.hash ^ salt)[title])))
        again = again[upper(again) & lower(again)]
        node[np.searchsorted(start, words.start[again], side="right") - 1] = True
    pick = np.flatnonzero(node)
    if not pick.size:
        return []
    buf = raw.tobytes()
    text = lambda i: buf[start[i] : end[i]].decode("utf-8", "replace")
    tokens = [text(i) for i in pick.tolist()]
    # a node that is "=" alone is plain text
    ok = [t.strip("\"'*#&$%|!") not in ("=", "") for t in tokens]
    pick, tokens = pick[ok], [t for t, o in zip(tokens, ok) if o]
    if not pick.size:
        return []
    feats, keys = [], []
    for i, t in zip(pick.tolist(), tokens):
        b1 = text(i - 1) if i and doc[i - 1] == doc[i] else ""
        b2 = text(i - 2) if i > 1 and doc[i - 2] == doc[i] else ""
        feats.append(features(t, b1, b2, bool(named[i])))
        keys.append((int(doc[i]), likeness(t)))
    next_to = np.flatnonzero((np.diff(pick) == 1) & (np.diff(doc[pick]) == 0))
    g = Graph(feats, np.stack([next_to, next_to + 1], 1), keys)
    label = beliefs(g, w)[0].argmax(1)
    out: list[tuple[int, str, int, int]] = []
    for k in np.flatnonzero(label).tolist():
        name, i = LABELS[label[k]], int(pick[k])
        a, b = _core(tokens[k], name)
        s = int(start[i]) + len(tokens[k][:a].encode())
        e = int(start[i]) + len(tokens[k][:b].encode())
        joined = (name in ("PHONE", "NAME", "IBAN") or name == "CARD" and _RX["quad"].search(tokens[k])) and k and label[k - 1] == label[k] and pick[k - 1] == i - 1 and doc[pick[k - 1]] == doc[i] and not tokens[k].startswith("+") and not _RX["phone"].search(tokens[k]) and not _RX["iban"].search(tokens[k])
        if joined and out:
            out[-1] = (*out[-1][:3], e)
        else:
            out.append((lo + int(doc[i]), name, s, e))
    return out


def find_pii(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Entities of every text: (doc_id, entity, start, stop), offsets in code points.

    Nodes of the field are the tokens (between white space) with a digit, an @ or an =, up to NAME_WORDS capitalised
    words after an honorific or `contact`, other capitalised mentions of those in the document, and what follows
    a cue such as `password:` or `key is`; all other tokens are plain text, so that names in other places aren't found.
    Nodes side by side are chained; nodes of a document with the same letters and digits are joined with
    the most telling of them, wherever they stand, and those with a common prefix with each other, so that one
    mention in a telling place decides all others, however many.  One pass without a shuffle; the model is trained
    on the driver from synthetic labelled documents.

    A null or empty text has no entities; a null doc_id is kept; repeated rows are labelled each; an empty
    table gives an empty result; other columns are ignored.
    """
    weights = trained()

    def work(it):
        for batch, col in ragged.batches(it, "text"):
            ids = batch.column(0).cast(pa.int64())
            off = ragged.offsets(col)
            for lo, hi in ragged.slices(col):
                found = spans(col, lo, hi, weights)
                if not found:
                    continue
                raw = np.frombuffer(col.buffers()[2], np.uint8, int(off[hi] - off[lo]), int(off[lo]))
                chars = np.zeros(raw.size + 1, np.int64)
                np.cumsum((raw & 0xC0) != 0x80, out=chars[1:])
                doc, name, s, e = zip(*found)
                doc = np.array(doc)
                first = chars[off[doc] - off[lo]]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(name), pa.array((chars[list(s)] - first).astype(np.int32)), pa.array((chars[list(e)] - first).astype(np.int32))], names=["doc_id", "entity", "start", "stop"])

    return map_arrow(need(docs, key, text).toDF("doc_id", "text"), work, SCHEMA)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows with each entity of `text` replaced by its label in angle brackets.

    All other columns are kept as they are, whatever their names; a null text stays null and an empty one empty;
    repeated rows are treated alike; an empty table gives an empty result.  A column `n_chars` is brought up to
    date where the text changed.
    """
    weights = trained()
    fields = docs.schema

    def work(it):
        for batch in it:
            if not batch.num_rows:
                continue
            i = batch.schema.get_field_index(text)
            col = ragged._string(batch.column(i))
            off = ragged.offsets(col)
            data = memoryview(col.buffers()[2] or b"")
            edits: dict[int, list] = {}
            for lo, hi in ragged.slices(col):
                for d, name, s, e in spans(col, lo, hi, weights):
                    edits.setdefault(d, []).append((name, int(off[lo]) + s, int(off[lo]) + e))
            if edits:
                texts = col.to_pylist()
                for d, found in edits.items():
                    at, parts = int(off[d]), []
                    for name, s, e in found:
                        parts += [bytes(data[at:s]), f"<{name}>".encode()]
                        at = e
                    texts[d] = b"".join([*parts, bytes(data[at : int(off[d + 1])])]).decode()
                batch = batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))
            yield batch

    out = map_arrow(docs, work, fields)
    return out.withColumn("n_chars", F.length(text).cast(fields["n_chars"].dataType)) if "n_chars" in docs.columns and text == "text" else out


def op3_pii_crf(spark, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


QUERIES = {"op3_pii_crf": op3_pii_crf}
ORACLE_SQL: dict[str, str] = {}
