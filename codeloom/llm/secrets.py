"""Secrets in texts: three base rules, and automata inferred from the credentials that they find."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_pieces, tidy, written

# The base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "format")
NEEDLES = (b"passw", b"secret", b"token", b"apikey", b"api_key")

#: Labelled credentials of a kind that its automaton is learned from (those of lowest hash).
SAMPLE = 2000
#: Characters that a labelled credential may have to be learned from.
LONGEST = 256
#: Characters that a candidate has at least: the shortest credential that a base rule finds.
SHORTEST = 8

#: A run of credential characters; '=' ends it (a name before its value) but as padding.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{%d,}(?:={1,2}(?![A-Za-z0-9+/_.=-]))?" % SHORTEST)
#: What a text's words look like: letters of one case, or with a capital first, or such joined by hyphens, points and the like; numbers and dates.
_WORD = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,14})?(?:[+/_.-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,14})?)*")
_WORDS = re.compile(_WORD.pattern.encode())
_HEXMAP = bytes(0x78 if b in b"0123456789abcdef" else 0x20 for b in range(256))
_RUNS = bytes(b if 0x30 <= b <= 0x39 or chr(b).isalpha() and b < 0x80 or b in b"+/_.-" else 0x20 for b in range(256))


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, kind's place in KINDS, end, credential) by the base rules, leftmost and non-overlapping per kind."""
    raw, found = text.encode("utf-8", "surrogatepass"), []
    low = raw.lower()
    if any(n in low for n in NEEDLES):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if b"x" * 32 in raw.translate(_HEXMAP):
        found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str]]:
    """Runs of at least SHORTEST credential characters that aren't words, without dots at their ends, as far as they lie outside the base spans."""
    runs = text.encode("utf-8", "surrogatepass").translate(_RUNS).split()
    if not any(len(r) >= SHORTEST and not _WORDS.fullmatch(r) for r in runs):
        return []
    out = []
    for m in CANDIDATE.finditer(text):
        at = m.start()
        for a, _, b, _ in [*taken, (m.end(), 0, m.end(), "")]:
            if b <= at or a > m.end():
                continue
            v = text[at:a].strip(".") if a > at else ""
            if len(v) >= SHORTEST and not _WORD.fullmatch(v):
                s = text.index(v, at)
                out.append((s, s + len(v), v))
            at = max(at, b)
    return out


def symbol(c: str) -> str:
    """The class of a character: digit, hexadecimal letter, other letter by case, or itself."""
    return "9" if c.isdigit() else "f" if c in "abcdef" else "a" if c.islower() else "A" if c.isupper() else c


class Automaton:
    """A probabilistic automaton inferred by merging states of a prefix tree.

    The prefix tree counts the labelled strings by classes of characters. States are taken in
    breadth-first order; each is merged into the first kept state that it is compatible with (the
    shares of each symbol and of ending differ no more than Hoeffding's bound allows, in all
    states that both can reach), else kept.
    """

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        self.final, self.total = [0], [0]
        self.chars: Counter = Counter()
        for s in strings:
            q = 0
            for c in s:
                k = symbol(c)
                self.chars[c] += 1
                if k not in self.next[q]:
                    self.next[q][k] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                    self.final.append(0)
                    self.total.append(0)
                self.count[q][k] += 1
                self.total[q] += 1
                q = self.next[q][k]
            self.final[q] += 1
            self.total[q] += 1
        self.of_class = Counter()
        for c, n in self.chars.items():
            self.of_class[symbol(c)] += n
        self.scale = math.sqrt(0.5 * math.log(2 / alpha))
        self.shortest = min(map(len, strings))
        self._merge()
        scores = sorted(self.score(s) for s in strings)
        self.least = scores[len(scores) // 100]  # the labelled strings' first percentile

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.scale * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = self.total[a], self.total[b]
            if not n or not m:
                continue
            if self._differ(self.final[a], n, self.final[b], m):
                return False
            for k in self.count[a].keys() | self.count[b].keys():
                if self._differ(self.count[a][k], n, self.count[b][k], m):
                    return False
            stack += [(self.next[a][k], self.next[b][k]) for k in self.next[b] if k in self.next[a]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the subtree at b to the state a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.final[a] += self.final[b]
            self.total[a] += self.total[b]
            self.count[a] += self.count[b]
            for k, t in self.next[b].items():
                if k in self.next[a]:
                    stack.append((self.next[a][k], t))
                else:
                    self.next[a][k] = t

    def _merge(self) -> None:
        kept = [0]
        front = [(0, k) for k in sorted(self.next[0])]
        while front:
            q, k = front.pop(0)
            b = self.next[q][k]
            if b in kept:
                continue
            for a in kept:
                if self._compatible(a, b):
                    self.next[q][k] = a
                    self._fold(a, b)
                    break
            else:
                kept.append(b)
            front = [(s, k) for s in kept for k in sorted(self.next[s]) if self.next[s][k] not in kept]
        self.states = len(kept)

    def score(self, s: str) -> float:
        """Mean log probability of a character (and the end), -inf for a string that the format excludes."""
        q, out = 0, 0.0
        for c in s:
            k = symbol(c)
            if not self.count[q][k] or not self.chars[c]:
                return -math.inf
            out += math.log(self.count[q][k] / self.total[q] * self.chars[c] / self.of_class[k])
            q = self.next[q][k]
        if not self.final[q]:
            return -math.inf
        return (out + math.log(self.final[q] / self.total[q])) / (len(s) + 1)

    def accepts(self, s: str) -> bool:
        return len(s) >= self.shortest and self.score(s) >= self.least


SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs but the text as c0, c1 and so on, and __base and __candidates, its spans, written to the shared folder: the text is read once."""
    base, names = docs, [c for c in docs.columns if c != text]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        one, two = [], []
        for t in batch.column(text).to_pylist():
            spans = base_spans(t or "")
            one.append([{"start": s, "kind": k, "end": e, "value": v} for s, k, e, v in spans])
            two.append([{"start": s, "kind": 3, "end": e, "value": v} for s, e, v in candidates(t or "", spans)])
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(one, kind), pa.array(two, kind)], names=[*plain, "__base", "__candidates"])

    plain = [f"c{i}" for i in range(len(names))]
    schema = ", ".join([*(f"{p} {base.schema[c].dataType.simpleString()}" for p, c in zip(plain, names, strict=True)), f"__base {SPAN}, __candidates {SPAN}"])
    return written(map_pieces(base, text, fn, schema), "secrets")


def learn(scanned: DataFrame) -> dict[int, Automaton]:
    """An automaton for each kind with labelled credentials: a sample of SAMPLE of the distinct ones, by hash."""
    values = scanned.select(F.explode("__base").alias("s")).select("s.kind", "s.value").where(F.length("value") <= LONGEST).where(F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")).distinct()
    out = {}
    for k in range(3):
        some = [r.value for r in values.where(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(SAMPLE).collect()]
        if some:
            out[k] = Automaton(some)
    return out


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs but the text, and n_assign, n_access, n_hex, base, spans ('kind:start:end' arrays, code points).

    A scan finds the base spans and the candidates (runs of credential characters that aren't words
    or numbers as texts have them, and what of a run lies outside base spans; a name before '=' is a
    run of its own). The base spans' values label a bounded sample from which a
    prefix tree is grown and merged into an automaton per kind. A candidate becomes a span of
    kind 'format' if an automaton gives it at least the mean log probability that 99 % of its
    labelled credentials have, and is as long as the shortest of them.

    Defined cases: null or empty texts have no spans; very long ones are scanned whole; equal texts
    have equal spans; an empty table gives none; without a credential of a kind nothing is learned
    from it; output names replace columns of docs, and all others stay, whatever their names.
    """
    out = ("n_assign", "n_access", "n_hex", "base", "spans")
    base = docs.drop(*out)
    given = [c for c in base.columns if c != text]
    scanned = scan(base, text)
    shared = docs.sparkSession.sparkContext.broadcast(learn(scanned))
    names = [c for c in scanned.columns if c not in ("__base", "__candidates")]

    def run(batches):
        for batch in batches:
            counts, base, spans = ([], [], []), [], []
            for one, two in zip(batch.column("__base").to_pylist(), batch.column("__candidates").to_pylist(), strict=True):
                n = Counter(s["kind"] for s in one)
                for k in range(3):
                    counts[k].append(n[k])
                more = [s for s in two if any(a.accepts(s["value"]) for a in shared.value.values())]
                base.append([_shown(s) for s in one])
                spans.append([_shown(s) for s in sorted(one + more, key=lambda s: (s["start"], s["kind"]))])
            cols = [*(batch.column(c) for c in names), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *out])

    schema = ", ".join([*(f"`{c}` {scanned.schema[c].dataType.simpleString()}" for c in names), "n_assign long, n_access long, n_hex long, base array<string>, spans array<string>"])
    return scanned.mapInArrow(tidy(run), schema).select(*(F.col(c).alias(g) for c, g in zip(names, given, strict=True)), *out)


def _shown(s: dict) -> str:
    return f"{KINDS[s['kind']]}:{s['start']}:{s['end']}"


def redact(docs: DataFrame, text: str = "text", mask: str = "[REDACTED]") -> DataFrame:
    """docs with every secret's span replaced by a mask (of an assignment, only its value); texts without any stay as they are.

    Scanned twice: once to learn the automata, once to replace. Null, empty and repeated texts stay
    what they are or are masked alike, very long ones whole; all columns keep their names; an empty
    table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(scan(docs.select(text), text)))
    names = docs.columns

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = [t if t is None else masked(t, shared.value, mask) for t in batch.column(text).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == text else batch.column(c) for c in names], names=names)

    return map_pieces(docs, text, fn, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def masked(text: str, automata: dict[int, Automaton], mask: str) -> str:
    base = base_spans(text)
    cut = [(e - len(v), e) for _, _, e, v in base]
    cut += [(s, e) for s, e, v in candidates(text, base) if any(a.accepts(v) for a in automata.values())]
    out, at = [], 0
    for s, e in sorted(cut):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def secret_report(docs: DataFrame) -> DataFrame:
    """Per document doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = find_secrets(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.concat_ws(",", "base"), 256).alias("base_sha256"), F.concat_ws(",", "spans").alias("spans"))
