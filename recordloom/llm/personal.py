"""Personal data by candidate gradient boosting.

Generators propose overlapping spans with high recall: the base patterns before their checks, number groups under any
punctuation, addresses spelt with at and dot, and long runs of letters and digits that may be secrets. Boosted trees (depth
DEPTH, logistic loss, histogram splits) score each candidate from its format and its context. They are fitted on candidates
of a sample of at most SAMPLE texts, at most EACH drawn from one: base matches, altered copies of them (spelt-out addresses,
regrouped numbers) and runs that are assigned to the name of a credential, against candidates that fail the checks and runs
under other names. Scores are calibrated on a held-out fifth, where each kind gets the least threshold at which PRECISION of
what it selects is right; a kind without such a threshold adds nothing. Base matches are always selected.

Every generator takes time in proportion to the text, and so does the choice among overlapping candidates; texts of any
length are searched whole.

Defined results: null and empty texts have no spans; without candidates to learn from only base matches are selected; rows
that repeat have equal spans; of overlapping candidates the higher score wins, and of equal scores the earlier kind, then the
earlier start; an empty table gives an empty result; other columns are ignored by find.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, tuned

KINDS = ("email", "ip", "card", "phone")
#: What the method adds beside the base kinds.
ADDED = (*KINDS, "secret")
#: Texts that the trees are fitted on, at most.
SAMPLE = 4000
#: Candidates that are learned from in one text, at most.
EACH = 64
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 32
PRECISION = 0.98
CONTEXT = 24

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DOTTED = re.compile(r"[0-9][0-9.]{6,}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELT = re.compile(r"[A-Za-z0-9._%+-]+\s*(?:@|[\[({]\s*at\s*[\])}]|\sat\s)\s*[A-Za-z0-9-]+(?:\s*(?:\.|[\[({]\s*dot\s*[\])}]|\sdot\s)\s*[A-Za-z0-9-]+)+", re.I)
_AT = re.compile(r"@|[\[({]\s*[aA][tT]\s*[\])}]|[aA](?<=\s[aA])[tT](?=\s)")  # each way begins with a character, which is searched for fast
_AT_WORDS = frozenset(("at", "At", "aT", "AT"))
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_GROUPS = re.compile(r"(?:\([0-9]|[0-9])(?:[\x20()./_-]{0,3}[0-9]){6,24}")
_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}")  # LONG or more
_NAMED = re.compile(r"([A-Za-z][A-Za-z0-9_.-]{0,30})[\"']?\s{0,2}(?:=>|:=|=|:)\s{0,2}[\"']?\Z")
_CREDENTIAL = re.compile(r"token|secret|passw|pwd|api.?key|access.?key|private.?key|credential|auth|bearer", re.I)
_ASSIGNED = "[=:][\"' ]{0,3}[A-Za-z0-9+/_-]{20}"
LONG = 20
_OTHER_NAMES = ("hash", "sha1", "commit", "digest", "id", "etag", "checksum")
_OTHER_SECRETS = ("secret", "api_key", "password", "access_token", "auth_token", "Bearer", "client_secret")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d // 5 + 2 * d % 10 for d in map(int, digits[-2::-2]))) % 10 == 0


def digits_of(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, at sign and dotted domain: a match ends at its at sign's domain and begins with the run before it."""
    out, done = [], 0
    if "@" not in text:
        return out
    for m in _DOMAIN.finditer(text):
        a = m.start()
        while a > done and (text[a - 1].isascii() and (text[a - 1].isalnum() or text[a - 1] in "._%+-")):
            a -= 1
        if a < m.start():
            out.append((a, m.end()))
        done = m.end() if a < m.start() else done
    return out


def dotted(text: str) -> list[tuple[int, int]]:
    """What _IP finds, looked for only in runs of digits and dots."""
    return [(m.start() + x.start(), m.start() + x.end()) for m in _DOTTED.finditer(text) for x in _IP.finditer(m.group())] if "." in text else []


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in emails(text)]
    found += [("ip", a, b) for a, b in dotted(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in text[a:b].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = digits_of(m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return found


def spelt(text: str, words: list[str]) -> list[tuple[int, int]]:
    """What _SPELT finds, looked for only where an @ or at stands. words: the text split at white space."""
    out, end = [], 0
    if _AT_WORDS.isdisjoint(words) and not any(c in text for c in "@[({"):
        return out
    for m in _AT.finditer(text):
        a = m.start()
        while a > end and text[a - 1].isspace():
            a -= 1
        while a > end and text[a - 1] in _NAME:
            a -= 1
        found = _SPELT.match(text, a) if m.start() >= end else None
        if found:
            end = found.end()
            out.append((a, end))
    return out


def candidates(text: str) -> set[tuple[str, int, int]]:
    """Overlapping spans of every kind that they may be."""
    words = text.split()
    out = {("email", a, b) for a, b in emails(text)}
    out |= {("email", a, b) for a, b in spelt(text, words)}
    out |= {("ip", a, b) for a, b in dotted(text)}
    for m in _GROUPS.finditer(text):
        a, b = m.span()
        n = len(digits_of(m.group()))
        if 12 <= n <= 19:
            out.add(("card", a, b))
        if 9 <= n <= 15:
            out.add(("phone", a - 1 if a and text[a - 1] == "+" else a, b))
    if "+" in text:
        out |= {("phone", m.start(), m.end()) for m in _PHONE.finditer(text)}
    out |= {("secret", a, b) for a, b in runs(text, words)}
    return out


def runs(text: str, words: list[str]) -> list[tuple[int, int]]:
    """Long runs of both letters and digits."""
    if max(map(len, words), default=0) < LONG:
        return []
    return [m.span() for m in _RUN.finditer(text) if re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group())]


def credential(text: str, a: int) -> bool:
    """Whether what begins at a is assigned to the name of a credential."""
    m = _NAMED.search(text, max(0, a - 40), a)
    return bool(m and _CREDENTIAL.search(m[1]))


def entropy(s: str) -> float:
    """Bits of a character, by how often each stands in s."""
    n = np.unique(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)[1] / max(1, len(s))
    return float(-(n * np.log2(n)).sum())


def describe(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context of a candidate."""
    s, d = text[a:b], digits_of(text[a:b])
    groups = [len(x) for x in re.findall("[0-9]+", s)] or [0]
    octets = [int(x[:9]) for x in re.findall("[0-9]+", s)] or [0]
    before, after = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    words = {w.lower() for w in _WORD.findall(before)}
    lead, tail = before[-1:], after[:1]
    named = _NAMED.search(text, max(0, a - 40), a)
    return [
        ADDED.index(kind), len(s), len(d), len(d) / len(s), len(groups), max(groups), min(groups), groups[0], groups[-1], max(octets), octets[0],
        s.startswith("+"), "(" in s, s.count("."), s.count("-"), s.count(" "), "@" in s, "dot" in s.lower(), len(s.rpartition(".")[2]), sum(c.isalpha() for c in s),
        len(set(d)), int(d[:1] or 0), bool(d) and luhn(d), lead.isspace() or not lead, lead.isalnum(), lead in "=:\"'#$", tail.isspace() or not tail, tail.isalnum(), tail in ".,;)",
        bool(words & {"tel", "phone", "call", "fax", "mobile"}), bool(words & {"mail", "email", "contact", "write"}), bool(words & {"card", "visa", "credit", "account"}), bool(words & {"ip", "host", "server", "address"}),
        entropy(s[:256]), sum(c in "0123456789abcdef" for c in s.lower()) / len(s), s.lower() != s, named is not None, bool(named and _CREDENTIAL.search(named[1])), bool(_CREDENTIAL.search(before)),
    ]


def altered(text: str, kind: str, a: int, b: int, draw: np.random.Generator) -> tuple[str, int, int] | None:
    """A base match written otherwise, in its own context."""
    s = text[a:b]
    if kind == "email":
        at, dot = [(" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), (" at ", "."), (" [ at ] ", "."), (" @ ", " . ")][draw.integers(6)]
        name, _, domain = s.partition("@")
        new = name + at + domain.replace(".", dot)
    elif kind == "card":
        d = digits_of(s)
        new = "./_"[draw.integers(3)].join(d[i : i + 4] for i in range(0, len(d), 4))
    elif kind == "phone":
        d = digits_of(s)
        new = [f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}.{d[-7:-4]}.{d[-4:]}", f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}"][draw.integers(3)]
    else:
        return None
    return text[max(0, a - CONTEXT) : a] + new + text[b : b + CONTEXT], min(a, CONTEXT), min(a, CONTEXT) + len(new)


def renamed(text: str, a: int, b: int, names: tuple[str, ...], draw: np.random.Generator) -> tuple[str, int, int]:
    """A run under another name."""
    lead = text[max(0, a - CONTEXT) : a].rpartition(" ")[0]
    name, sign = names[draw.integers(len(names))], [" = ", "=", ": ", ' = "', " "][draw.integers(5)]
    head = f"{lead} {name}{sign}"
    return head + text[a:b] + text[b : b + CONTEXT], len(head), len(head) + b - a


def examples(text: str, draw: np.random.Generator, each: int = EACH) -> list[tuple[list[float], int]]:
    """Described candidates: 1 for a base match, 2 for an altered one or a run under a credential's name, 0 for one that fails the checks. At most each of a text, and their copies."""
    base = set(base_spans(text))
    some = sorted(candidates(text) | base)
    if len(some) > each:
        some = [some[i] for i in sorted(draw.choice(len(some), each, replace=False))]
    out = []
    for c in some:
        k, a, b = c
        secret = k == "secret" and credential(text, a)
        out.append((describe(text, *c), 1 if c in base else 2 * secret))
        copies = [(altered(text, *c, draw), 2)] if c in base else []
        if secret:
            copies = [(renamed(text, a, b, _OTHER_SECRETS, draw), 2), (renamed(text, a, b, _OTHER_NAMES, draw), 0), ((text[b : b + CONTEXT] + " " + text[a:b], min(len(text) - b, CONTEXT) + 1, min(len(text) - b, CONTEXT) + 1 + b - a), 0)]
        out += [(describe(x[0], k, x[1], x[2]), y) for x, y in copies if x]
    return out


class Boosted:
    """Trees of fixed depth over binned features, with a threshold for each kind."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        draw = np.random.default_rng(3)
        base, y = y == 1, np.minimum(y, 1)
        fold = draw.random(len(x)) < 0.2
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.prior = float(np.log((y[~fold].mean() + 1e-3) / (1 - y[~fold].mean() + 1e-3))) if (~fold).any() else 0.0
        self.trees: list[tuple[list[tuple[int, int]], np.ndarray]] = []
        bins = self._bins(x)
        f = np.full(len(x), self.prior)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = np.where(fold, 0, y - p), np.where(fold, 0, p * (1 - p))
            leaf, splits = np.zeros(len(x), np.int64), []
            for level in range(DEPTH):  # one split for a level, so a tree is a table
                n = 1 << level
                best = (-1.0, 0, 0)
                for j in range(x.shape[1]):
                    width = len(self.cuts[j]) + 1
                    gs, hs = (np.bincount(leaf * width + bins[:, j], v, n * width).reshape(n, width).cumsum(1) for v in (g, h))
                    gain = (gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1)).sum(0)[:-1]
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), j, int(gain.argmax()))
                splits.append(best[1:])
                leaf = 2 * leaf + (bins[:, best[1]] > best[2])
            values = RATE * np.bincount(leaf, g, 1 << DEPTH) / (np.bincount(leaf, h, 1 << DEPTH) + 1)
            self.trees.append((splits, values))
            f += values[leaf]
        self.cut = {}
        for k in range(len(ADDED)):
            own = fold & (x[:, 0] == k) & ~base  # base matches are selected anyway, and would hide what else a threshold lets in
            order = np.argsort(-f[own], kind="stable")
            right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
            good = np.flatnonzero(right >= PRECISION)
            if len(good) and good[-1] >= 10:
                self.cut[k] = float(f[own][order][good[-1]])

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins, f = self._bins(x), np.full(len(x), self.prior)
        for splits, values in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for j, c in splits:
                leaf = 2 * leaf + (bins[:, j] > c)
            f += values[leaf]
        return f

    def select(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Candidates over their kind's threshold that no better candidate overlaps, and no base match but in a secret."""
        new = sorted(candidates(text).difference(base))
        if not new:
            return []
        f = np.concatenate([self.margin(np.array([describe(text, *c) for c in new[a : a + 4096]], float)) for a in range(0, len(new), 4096)])
        fixed, taken = np.zeros((2, len(text)), bool)
        for _, a, b in base:
            fixed[a:b] = True
        new = sorted(zip(-f, (ADDED.index(k) for k, _, _ in new), new, strict=True), key=lambda x: (x[0], x[1], x[2][1]))
        out = []
        for less, k, c in new:
            if -less >= self.cut.get(k, np.inf) and not taken[c[1] : c[2]].any() and (c[0] == "secret" or not fixed[c[1] : c[2]].any()):
                out.append(c)
                taken[c[1] : c[2]] = True
        return out


def learn(docs: DataFrame, sample: int = SAMPLE) -> Boosted | None:
    """Trees fitted on a sample of at most that many texts, taken by a hash of the text."""
    tuned(docs.sparkSession)
    likely = docs.select("text", F.xxhash64("text").alias("h")).where(F.col("text").rlike(f"[0-9]{{3}}|@|{_ASSIGNED}"))
    last = likely.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]  # hashes move, not texts
    if last is None:
        return None
    some = likely.where(F.col("h") <= last).groupBy("h").agg(F.first("text").alias("text")).select("text")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [e for x in batch.column(0).to_pylist() for e in examples(x, np.random.default_rng(zlib.crc32(x.encode())))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.list_(pa.float64())), pa.array([y for _, y in rows], pa.int32())], names=["x", "y"])

    got = some.mapInArrow(collect, "x array<double>, y int").toArrow()  # at most sample texts, EACH candidates of each and their copies
    if len(got) < 50 or not {0} < set(got["y"].to_pylist()):
        return None
    return Boosted(np.array(got["x"].to_pylist(), float), np.array(got["y"].to_pylist(), float))


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], ADDED.index(s[0]), s[2]))


def find(docs: DataFrame, model: Boosted | None) -> DataFrame:
    """doc_id and three arrays of (kind, start, end): base, spans (base and added, of the base kinds) and secrets."""
    spark = tuned(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)  # TREES small trees
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(x, span) for x in ("base", "spans", "secrets"))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        for batch in batches:
            cols: tuple[list, list, list] = ([], [], [])
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                more = trees.select(text, base) if text and trees else []
                mine = [c for c in more if c[0] != "secret"]
                for out, spans in zip(cols, (base, base + mine, [c for c in more if c[0] == "secret"]), strict=True):
                    out.append([{"kind": k, "start": a, "end": b} for k, a, b in ordered(spans)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, arrow) for x in cols)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; overlapping spans merge under the first's kind."""
    out, at = [], 0
    for k, a, b in ordered(spans):
        if a >= at:
            out += [text[at:a], f"[{k}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])



def op6_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs, learn(docs))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    added = (F.size("spans") - F.size("base") + F.size("secrets")).cast("long")
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"), added.alias("n_added"), F.size("secrets").cast("long").alias("n_secret"), joined("secrets").alias("secrets"))
