"""Secret scans (operator 1): rules, and a character convolutional network in numpy over every candidate and its context.

Candidates are of four kinds. Rules find assignments to words like password and token, access keys and long hexadecimal runs;
these findings stand, whatever the network says of them. The fourth kind, net, is what the rules leave: runs of RUN or more
of the characters of keys with a digit and a letter, or with letters of both cases or capitals only, and runs of SHORT or more after a
name like key, auth or credential and a colon or an equals sign; of a run that a rule finding covers in part, the rest.

The network reads every candidate of every kind between LEFT and RIGHT bytes of context, as one-byte characters: an
embedding with a mark for the candidate, a convolution, the largest and the mean activation, and a logit; a long
candidate is read in overlapping parts and its highest logit counts. It is trained on labelled findings: by default those
that ``labelled_findings`` makes up from the formats of well-known keys and of things that look like keys. The logits
are calibrated on findings that were not trained on. Each kind has a threshold of its own, the highest at which RECALL of
its held-out findings is kept, where a finding that is no candidate counts as lost. A net candidate at or above its threshold
is a span more; a rule finding at or above its own is confirmed.

Cases: null text counts as empty, without spans; texts of any length are scanned whole; equal texts have equal spans;
an empty table gives an empty result; further columns are kept by ``redact`` and not read by ``scan``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textkit as K

#: Fixed patterns, on UTF-8 bytes, where letters of either case are ASCII ones.
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "net")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Names beyond those of the rules after which a short run is a candidate, and how they stand before it.
NAMES = (b"pwd", b"passphrase", b"credential", b"auth", b"private", b"bearer", b"access", b"client", b"signature", b"key")
NAMED = re.compile(rb"""(?i:pwd|passphrase|credential|auth|private|bearer|access|client|signature|key)[A-Za-z0-9_-]{0,24}["']?\x20*(?:[:=]|=>)\x20*["']?([A-Za-z0-9+/_.=-]{8,})""")
RUN, SHORT = 16, 8
LEFT, BODY, RIGHT = 24, 48, 12
RECALL = 0.95
FINDINGS = 4000

_KEY, _DIGIT, _SMALL, _CAPITAL = (np.zeros(256, bool) for _ in range(4))
_DIGIT[48:58] = _SMALL[97:123] = _CAPITAL[65:91] = True
_KEY[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.=-"]] = True


def rule_spans(raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, leftmost and not overlapping within a kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(raw) if m.end() - m.start() >= 16]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(raw) if m.end() - m.start() >= 32]


def _has(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: np.ndarray) -> np.ndarray:
    n = np.concatenate(([0], np.cumsum(which[data], dtype=np.int64)))
    return n[ends] > n[starts]


def runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text of every run of RUN key characters, and whether it may be a key. A run ends with its text."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(bool)
    key = _KEY[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(key & (~np.append(False, key[:-1]) | edge[:-1]))
    ends = np.flatnonzero(key & (~np.append(key[1:], False) | edge[1:])) + 1
    long = ends - starts >= RUN
    starts, ends = starts[long], ends[long]
    digit, small, capital = (_has(data, starts, ends, c) for c in (_DIGIT, _SMALL, _CAPITAL))
    return starts, ends, np.searchsorted(offs[1:], starts, "right"), capital | (digit & small)  # small letters alone are words


def _trimmed(raw: bytes, a: int, z: int) -> tuple[int, int]:
    core = raw[a:z]
    return a + len(core) - len(core.lstrip(b".-_=/+")), z - (len(core) - len(core.rstrip(b".-_/+")))


def net_candidates(raw: bytes, found: list[tuple[int, int, str]], long: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places of the kind net: ``long`` runs and short ones after a name, without what the rule findings cover."""
    wanted = sorted({(a, z, RUN) for a, z in long} | {(*m.span(1), SHORT) for m in NAMED.finditer(raw)})
    taken, out, at, upto = sorted((a, z) for a, z, _ in found), [], 0, 0
    for a, z, least in wanted:
        a = max(a, upto)  # a run after a name may be part of a long one
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        k = at
        while a < z:
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            stop = min(z, taken[k][0]) if k < len(taken) else z
            if stop > a:
                x, y = _trimmed(raw, a, stop)
                if y - x >= least:
                    out.append((x, y))
            a = max(stop, min(z, taken[k][1])) if k < len(taken) else z
        upto = max(upto, z)
    return out


def windows(raw: bytes, start: int, end: int) -> list[tuple[bytes, int, int]]:
    """Strips of LEFT + BODY + RIGHT bytes, with the candidate's place in them."""
    out = []
    for a in range(start, max(start + 1, end - BODY // 2), BODY // 2):
        z = min(end, a + BODY)
        left = raw[max(0, a - LEFT) : a].rjust(LEFT)
        out.append(((left + raw[a:z] + raw[z : z + RIGHT]).ljust(LEFT + BODY + RIGHT), LEFT, LEFT + z - a))
    return out


def labelled_findings(n: int = FINDINGS, seed: int = 1) -> tuple[list[bytes], list[tuple[int, int]], np.ndarray, list[str]]:
    """Made-up texts, the finding's place in each, its label and its kind: keys of known formats, and things that look like keys."""
    rng = np.random.default_rng(seed)
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda chars, k: "".join(rng.choice(list(chars), k))
    size = lambda a, z: int(rng.integers(a, z + 1))
    syllables = "the on re sti an ler ka mo der ein que ion pa vi tra ne so lu".split()
    word = lambda: "".join(rng.choice(syllables, size(1, 4)))
    host = lambda: f"{rng.choice(['mail', 'www', 'smtp', 'api', 'cdn', 'db', word()])}{size(0, 99)}.{rng.choice(['example', word()])}.{rng.choice(['com', 'org', 'net'])}"
    keys = [
        lambda: some(lower + upper + digit, size(20, 64)), lambda: some(lower + upper + digit + "+/", size(28, 88)) + rng.choice(["", "=", "=="]), lambda: "ghp_" + some(lower + upper + digit, 36),
        lambda: "sk_live_" + some(lower + upper + digit, 24), lambda: "xoxb-" + some(digit, 12) + "-" + some(lower + upper + digit, 24), lambda: "AIza" + some(lower + upper + digit + "-_", 35),
        lambda: "eyJ" + some(lower + upper + digit, size(17, 40)) + "." + some(lower + upper + digit + "-_", size(20, 60)), lambda: some(upper + "234567", size(26, 40)), lambda: some("ABCDEF" + digit, size(32, 64)), lambda: some(lower + digit, size(24, 48)),
        lambda: some(lower + upper, size(32, 64)),
    ]
    others = [
        lambda: some(digit, size(16, 22)), host, host, lambda: f"{word()}.{size(0, 99)}.{host()}", lambda: f"20{size(10, 30)}-0{size(1, 9)}-{size(10, 28)}T{size(10, 23)}.{size(10, 59)}.{size(10, 59)}",
        lambda: "/".join([word() for _ in range(size(3, 5))]) + f"/{size(1, 9999)}", lambda: f"{word()}_{word()}_{word()}_{size(1, 99)}", lambda: f"{word()}-{word()}-{size(1, 9)}.{size(0, 30)}.{size(0, 9)}-{word()}",
        lambda: rng.choice(["DE", "FR", "ES", "IT", "GB"]) + some(digit, size(18, 22)), lambda: f"IMG_{some(digit, 8)}_{some(digit, 6)}.jpg", lambda: "-".join(some("abcdef" + digit, k) for k in (8, 4, 4, 4, 12)),
        lambda: word() + word() + word() + word() + word() + some(digit, 1), lambda: (word() + "." + word() + word() + "." + word() + some(digit, 2)).ljust(16, "0"), lambda: "=" * size(4, 20) + word() + str(size(1, 9)) + "=" * size(4, 20),
        lambda: "".join(word().title() for _ in range(size(3, 7))), lambda: "".join(word().upper() for _ in range(size(3, 8))), lambda: "_".join(word().upper() for _ in range(size(3, 6))), lambda: word().title() + "-" + "-".join(word() for _ in range(size(3, 5))),
        lambda: "/".join(word().title() for _ in range(size(3, 5))) + ".html", lambda: word().title() + word() + word() + word() + word(),
    ]
    short = [lambda: some(lower + upper + digit, size(8, 15)), lambda: some(lower, size(4, 6)) + some(digit, size(3, 5)) + some(upper, 2)]
    plain = [lambda: word().ljust(8, "a"), lambda: f"{word()}{word()}-{word()}", lambda: f"{word()}.{word()}.{word()}"]
    names = ["key", "AUTH", "Authorization: Bearer", "client_id", "aws", "private", "value", "credential", "x"]
    texts, places, labels, kinds = [], [], np.arange(n) % 2, []
    for y in labels:
        kind = str(rng.choice(["net", "short", "assign", "access", "hex"], p=[0.55, 0.1, 0.15, 0.1, 0.1]))
        pool = {"net": keys if y else others, "short": short if y else plain, "assign": keys + short if y else others + plain}.get(kind)
        if kind == "access":
            body = "AKIA" + (some(upper + digit, 16) if y else (word() + word() + word()).upper().ljust(12, "X"))
        elif kind == "hex":
            body = some("abcdef" + digit, size(32, 64)) if y else (some("abcdef" + digit, size(1, 4)) * 40)[: size(32, 64)]
        else:
            body = str(pool[rng.integers(len(pool))]())
        if kind == "net" and len(body) < RUN:
            body += some(digit, RUN - len(body))
        if kind in ("short", "assign") and len(body) < SHORT:
            body = body.ljust(SHORT, "e")
        sep = str(rng.choice([" = ", "=", ": ", ":"])) + str(rng.choice(["", '"', "'"]))
        lead = " ".join(word() for _ in range(size(0, 5)))
        before = ""
        if kind == "assign":
            before = str(rng.choice(["password", "Passwd", "SECRET", "token", "api_key", "apikey"])) + sep
        elif kind == "short":
            lead += f" {rng.choice(['auth_key', 'credential', 'PWD', 'client_auth', 'privateKey'])}{sep}"
        elif kind == "net" and rng.random() < (0.5 if y else 0.15):
            lead += f" {rng.choice(names)}{rng.choice([' = ', '=', ': ', ' '])}{rng.choice(['', chr(34)])}"
        if lead and lead[-1] not in " ='\":":
            lead += str(rng.choice([" ", "\n", " | "]))
        tail = rng.choice(["", " ", "\n", ". ", '" ']) + " ".join(word() for _ in range(size(0, 4)))
        texts.append((lead + before + body + tail).encode())
        places.append((len(lead.encode()), len((lead + before + body).encode())))
        kinds.append("net" if kind == "short" else kind)
    return texts, places, labels, kinds


EMBED, FILTERS, WIDTH = 8, 24, 5


class Network:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        w = lambda *s: (rng.standard_normal(s) / np.sqrt(np.prod(s[:-1]))).astype(np.float32)
        self.p = {"E": w(256, EMBED) * 8, "W": w(WIDTH, EMBED + 1, FILTERS), "b": np.zeros(FILTERS, np.float32), "o": w(2 * FILTERS, 1), "c": np.zeros(1, np.float32)}
        self.slope, self.offset, self.thresholds = 1.0, 0.0, dict.fromkeys(KINDS, 0.5)

    def _read(self, x: np.ndarray, mark: np.ndarray):
        p, T = self.p, x.shape[1] - WIDTH + 1
        e = np.concatenate((p["E"][x], mark[..., None]), 2)
        z = sum((e[:, k : k + T] @ p["W"][k] for k in range(WIDTH)), p["b"])
        a = np.maximum(z, 0)
        most = a.argmax(1)
        pooled = np.concatenate((np.take_along_axis(a, most[:, None], 1)[:, 0], a.mean(1)), 1)
        return e, z, most, pooled, (pooled @ p["o"])[:, 0] + p["c"]

    def logits(self, x: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.float32), *(self._read(x[i : i + 1024], mark[i : i + 1024])[-1] for i in range(0, len(x), 1024))])

    def gradients(self, x, mark, y):
        p, B, T = self.p, len(x), x.shape[1] - WIDTH + 1
        e, z, most, pooled, logit = self._read(x, mark)
        d = ((1 / (1 + np.exp(-logit)) - y) / B).astype(np.float32)
        g = {"o": pooled.T @ d[:, None], "c": np.array([d.sum()])}
        dp = d[:, None] * p["o"][:, 0]
        da = np.repeat(dp[:, None, FILTERS:] / T, T, 1)
        np.put_along_axis(da, most[:, None], np.take_along_axis(da, most[:, None], 1) + dp[:, None, :FILTERS], 1)
        dz = da * (z > 0)
        g["b"] = dz.sum((0, 1))
        g["W"] = np.stack([np.einsum("bte,btf->ef", e[:, k : k + T], dz) for k in range(WIDTH)])
        de = np.zeros_like(e)
        for k in range(WIDTH):
            de[:, k : k + T] += dz @ p["W"][k].T
        g["E"] = np.zeros_like(p["E"])
        np.add.at(g["E"], x, de[..., :EMBED])
        return g

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.offset, -40, 40)))


def arrays(strips: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(s for s, _, _ in strips), np.uint8).reshape(len(strips), LEFT + BODY + RIGHT)
    at = np.arange(x.shape[1])
    return x, np.array([(at >= a) & (at < z) for _, a, z in strips], np.float32).reshape(x.shape)


def highest(net: Network, raws: list[bytes], places: list[list[tuple[int, int]]]) -> list[np.ndarray]:
    """The probability of each place of each text: that of its part with the highest logit."""
    strips, of = [], []
    for k, (raw, here) in enumerate((r, a) for r, all_ in zip(raws, places, strict=True) for a in all_):
        w = windows(raw, *here)
        strips += w
        of += [k] * len(w)
    best = np.full(sum(map(len, places)), -np.inf)
    for i in range(0, len(strips), 8192):
        np.maximum.at(best, of[i : i + 8192], net.logits(*arrays(strips[i : i + 8192])))
    return np.split(net.probability(best), np.cumsum([len(p) for p in places])[:-1]) if places else []


def candidates(raw: bytes) -> list[tuple[int, int, str]]:
    """All candidates of a text, in bytes."""
    data, offs = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    found = rule_spans(raw)
    starts, ends, _, may = runs(data, offs)
    return found + [(a, z, "net") for a, z in net_candidates(raw, found, list(zip(starts[may].tolist(), ends[may].tolist(), strict=True)))]


def found_with(net: Network, texts: list[bytes], places: list[tuple[int, int]], kinds: list[str]) -> np.ndarray:
    """The probability of each labelled finding by way of its text's candidates: the best one of its kind that overlaps it, 0 if there is none."""
    of_kind = [[(a, z) for a, z, k in candidates(t) if k == kind and a < place[1] and z > place[0]] for t, place, kind in zip(texts, places, kinds, strict=True)]
    return np.array([p.max() if len(p) else 0.0 for p in highest(net, texts, of_kind)])


def train(texts: list[bytes], places: list[tuple[int, int]], labels: np.ndarray, kinds: list[str], epochs: int = 12, seed: int = 1) -> Network:
    """Train on three quarters of the findings; calibrate and set the thresholds on the rest."""
    rng, net = np.random.default_rng(seed), Network(seed)
    parts = [windows(t, a, z) for t, (a, z) in zip(texts, places, strict=True)]
    x, mark = arrays([w[0] for w in parts])
    order = rng.permutation(len(labels))
    cut = len(order) * 3 // 4
    moment, step = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}, 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(order[:cut]), max(1, cut // 64)):
            step += 1
            for k, g in net.gradients(x[part], mark[part], labels[part]).items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] -= (0.005 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    held = order[cut:]
    z, y = net.logits(x[held], mark[held]).astype(float), labels[held].astype(float)
    a, b = 1.0, 0.0
    for _ in range(40):  # logistic regression of the label on the logit
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        s = p * (1 - p) + 1e-6
        H = np.array([[(s * z * z).sum() + 1, (s * z).sum()], [(s * z).sum(), s.sum() + 1]])
        da, db = np.linalg.solve(H, [((p - y) * z).sum() + (a - 1), (p - y).sum() + b])
        a, b = a - da, b - db
    net.slope, net.offset = float(a), float(b)
    true = [k for k in held.tolist() if labels[k] == 1]
    p = found_with(net, *([v[k] for k in true] for v in (texts, places, kinds)))
    for kind in KINDS:
        mine = np.sort(p[[kinds[k] == kind for k in true]])
        net.thresholds[kind] = max(1e-6, float(mine[int((1 - RECALL) * len(mine))])) if len(mine) else 1.0
    return net


@lru_cache(maxsize=1)
def default_network() -> Network:
    return train(*labelled_findings())


@dataclass
class Scanner:
    net: Network

    def spans(self, column: pa.Array) -> list[list[tuple[int, int, str, float]]]:
        """(start, end, kind, probability) of each text, in code points, by start and then kind: rule findings, and net candidates from the threshold on."""
        out: list[list[tuple[int, int, str, float]]] = []
        for i, j, data, offs in K.pieces(column):
            starts, ends, text, may = runs(data, offs)
            lower, whole = K.LOWER[data].tobytes(), data.tobytes()
            long: dict[int, list[tuple[int, int]]] = {}
            for a, z, t in zip((starts - offs[text])[may].tolist(), (ends - offs[text])[may].tolist(), text[may].tolist(), strict=True):
                long.setdefault(t, []).append((a, z))
            busy = set(text.tolist())
            for w in (*WORDS, *NAMES):  # every text with such a word is read by the patterns
                at = lower.find(w)
                while at >= 0:
                    busy.add(t := int(np.searchsorted(offs[1:], at, "right")))
                    at = lower.find(w, int(offs[t + 1]))
            texts = sorted(busy)
            raws = [whole[offs[t] : offs[t + 1]] for t in texts]
            found = []
            for t, raw in zip(texts, raws, strict=True):
                rules = rule_spans(raw)
                found.append(rules + [(a, z, "net") for a, z in net_candidates(raw, rules, long.get(t, []))])
            scores = highest(self.net, raws, [[(a, z) for a, z, _ in f] for f in found])
            here: dict[int, list[tuple[int, int, str, float]]] = {}
            for t, raw, all_, p in zip(texts, raws, found, scores, strict=True):
                kept = sorted(((a, z, k, float(q)) for (a, z, k), q in zip(all_, p, strict=True) if k != "net" or q >= self.net.thresholds["net"]), key=lambda s: (s[0], KINDS.index(s[2])))
                if kept and not raw.isascii():  # code points up to each byte
                    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
                    kept = [(int(points[a]), int(points[z]), k, q) for a, z, k, q in kept]
                here[t] = kept
            out += [here.get(t, []) for t in range(j - i)]
        return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{z}" for a, z, k, _ in spans)


def scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed, n_net) of ``docs(doc_id, text)``; n_confirmed: rule findings that the network takes for secrets too."""
    told = docs.sparkSession.sparkContext.broadcast(Scanner(net or default_network()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = told.value.net.thresholds
        for b in batches:
            found = told.value.spans(b.column(1))
            base = [[s for s in f if s[2] != "net"] for f in found]
            counts = [pa.array([sum(s[2] == k for s in f) for f in base], pa.int64()) for k in KINDS[:3]]
            sums = pa.array([hashlib.sha256(_joined(f).encode()).hexdigest() for f in base], pa.string())
            more = [pa.array([sum(s[3] >= least[s[2]] for s in f) for f in base], pa.int64()), pa.array([len(f) - len(g) for f, g in zip(found, base, strict=True)], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, sums, pa.array([_joined(f) for f in found], pa.string()), *more], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed", "n_net"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(K.tidy(run), f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long, n_net long")


def redact(docs: DataFrame, net: Network | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; texts without spans, null ones too, stay as they are."""
    told, at = docs.sparkSession.sparkContext.broadcast(Scanner(net or default_network())), docs.columns.index("text")

    def cut(text: str, spans) -> str:
        out, done = [], 0
        for a, z, *_ in spans:
            if z > done:
                out += [text[done : max(a, done)], mark if a >= done else ""]
                done = z
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = told.value.spans(b.column(at))
            texts = [t.as_py() if not f else cut(t.as_py(), f) for t, f in zip(b.column(at), found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.column(at).type) if k == at else c for k, c in enumerate(b.columns)], b.schema.names)

    return docs.mapInArrow(K.tidy(run), docs.schema)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op1_secrets": op1_secrets}
SQL: dict[str, str] = {}
